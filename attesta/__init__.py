"""Spark jobs for auditable identity verification, and for preparing training text."""
