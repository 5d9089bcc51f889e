"""The fixed-rule baseline over signals: first rule that fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.constants import CROSS_FIELDS, UNAVAILABLE, Thresholds

KEY = "verification_id"

GRID = 10_000

RULE_SIGNALS = ("mrz.readable", "quality.front_sharpness", "quality.front_glare", "ocr.fields_missing", "mrz.checks_ok", "document.expired", *[f"cross.{c}" for c in CROSS_FIELDS])
DECISION_OF = {"mrz.readable": "request_resubmission", "quality.front_sharpness": "request_resubmission", "quality.front_glare": "request_resubmission", "ocr.fields_missing": "request_resubmission", "mrz.checks_ok": "reject", "cross": "reject", "document.expired": "reject", "approve": "approve"}


def widened(signals: DataFrame, key: str = KEY) -> DataFrame:
    """One row for each verification with the signals that rules read; a signal that isn't available is null."""
    only = signals.filter(F.col("signal_id").isin(*RULE_SIGNALS))
    return only.groupBy(key).agg(*[F.max(F.when((F.col("signal_id") == s) & F.col("disponible"), F.col("valor"))).alias(s.replace(".", "_")) for s in RULE_SIGNALS])


def _rule(limits, at=lambda name, value: F.lit(value)) -> Column:
    value = lambda s: F.col(s.replace(".", "_"))
    bad = F.size("disagreements") > 0
    return (
        F.when(value("mrz.readable") == "false", "mrz.readable").when(value("quality.front_sharpness").cast("double") < at("min_sharpness", limits.min_sharpness), "quality.front_sharpness")
        .when(value("quality.front_glare").cast("double") > at("max_glare", limits.max_glare), "quality.front_glare").when(value("ocr.fields_missing").cast("int") > at("max_missing", limits.max_missing), "ocr.fields_missing")
        .when(value("mrz.checks_ok") == "false", "mrz.checks_ok").when(bad, "cross").when(value("document.expired") == "true", "document.expired").otherwise("approve")
    )


def _disagreements() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f"cross_{c}") == "mismatch", F.lit(c)) for c in sorted(CROSS_FIELDS)]))


def decided(wide: DataFrame, limits: Thresholds | None = None) -> DataFrame:
    """wide with disagreements, rule, decision and groundings (signal_id, cited_value, weight, text)."""
    df = wide.withColumn("disagreements", _disagreements()).withColumn("rule", _rule(limits or Thresholds()))
    decision = F.lit(None).cast("string")
    for rule, name in DECISION_OF.items():
        decision = F.when(F.col("rule") == rule, name).otherwise(decision)

    def cite(signal, value, weight):
        return F.struct((F.lit(signal) if isinstance(signal, str) else signal).alias("signal_id"), F.coalesce(value, F.lit(UNAVAILABLE)).alias("cited_value"), F.lit(weight).alias("weight"), F.lit("regla fija de la linea base").alias("text"))

    value = lambda s: F.col(s.replace(".", "_"))
    groundings = F.array(*[cite(s, value(s), "in_favor") for s in ("mrz.checks_ok", "cross.nuip", "document.expired")])
    groundings = F.when(F.col("rule") == "cross", F.transform("disagreements", lambda c: cite(F.concat(F.lit("cross."), c), F.lit("mismatch"), "against"))).otherwise(groundings)
    for rule in DECISION_OF:
        if rule not in ("cross", "approve"):
            groundings = F.when(F.col("rule") == rule, F.array(cite(rule, value(rule), "against"))).otherwise(groundings)
    return df.withColumn("decision", decision).withColumn("groundings", groundings)


def grid(wide: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rule by rule over a grid (min_sharpness, max_glare, max_missing): every row meets every point. A grid of up to GRID points is broadcast, a larger one is refused."""
    if thresholds.limit(GRID + 1).count() > GRID:
        raise ValueError(f"a grid has at most {GRID} points")
    both = wide.withColumn("disagreements", _disagreements()).crossJoin(F.broadcast(thresholds))
    return both.withColumn("rule", _rule(Thresholds(), at=lambda name, value: F.col(name)))
