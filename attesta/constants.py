"""Names and fixed values that the jobs share."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

AS_OF = datetime.date(2006, 1, 1)

# Closed sets of names in the public schema.
DECISIONS = ("approve", "reject", "request_resubmission", "escalate_to_human")
WEIGHTS = ("in_favor", "against", "neutral")
FRONT_FIELDS = ("nuip", "surnames", "given_names", "birth_date", "expiry_date")
CROSS_FIELDS = ("nuip", "birth_date", "expiry_date", "surnames", "given_names", "sex")
COVERED_FIELDS = ("nuip", "birth_date", "expiry_date")
MONTHS = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC")
UNAVAILABLE = "NO DISPONIBLE"

# The registry's texts for what could not be measured, by what is missing; they are stored, and shown to models as they are.
REASONS = {
    "field": "el campo no se localizo en el anverso",
    "zone": "la MRZ no se pudo interpretar",
    "birth_date": "no se pudo leer la fecha de nacimiento",
    "expiry_date": "no se pudo leer la fecha de expiracion",
    "three_dates": "falta alguna de las tres fechas",
    "expiry": "falta la fecha de expiracion",
    "face_document": "en el anverso del documento, ",
    "face_selfie": "en la selfie, ",
    "face": "no se detecto ninguna cara",
}

# Similarity tolerance of a citation.
TOLERANCE = 0.011 + 1e-9


@dataclass(frozen=True)
class Thresholds:
    min_sharpness: float = 300
    max_glare: float = 0.80
    max_missing: int = 0
