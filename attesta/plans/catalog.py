"""The registered queries of the library, by inventory id."""

from __future__ import annotations

from attesta.plans import queries_audit, queries_measures, queries_registry

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (queries_audit, queries_measures, queries_registry):
    for _name, (_query, _sql) in _module.ENTRIES.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLES[_name] = _sql


def flagship(spark, sf_dir):
    return QUERIES["ag4_baseline_by_split"](spark, sf_dir)
