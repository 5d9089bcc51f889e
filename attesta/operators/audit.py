"""Audits of an explanation: is what it cites true, and what does it leave unsaid?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.constants import TOLERANCE, UNAVAILABLE
from attesta.functions import text
from attesta.operators.signals import adverse

KEY = "verification_id"


def typed_match(kind: Column, actual: Column, cited: Column, latin_only: bool = True) -> Column:
    """Does a cited text name the measured value? Scores within a tolerance, counts as numbers, the rest as loose text."""
    a, c = text.number(actual), text.number(cited)
    return F.coalesce(F.when(kind.isin("score", "confidence"), F.abs(c - a) <= TOLERANCE).when(kind == "count", c == a).otherwise(text.loose(cited, latin_only) == text.loose(actual, latin_only)), F.lit(False))


def audit_citations(groundings: DataFrame, signals: DataFrame, key: str = KEY, latin_only: bool = True) -> DataFrame:
    """groundings (key, orden, signal_id, cited_value) with status and actual_value; one row each, by place, not by signal."""
    s = signals.select(key, "signal_id", "tipo", F.col("valor").alias("actual_value"), "disponible")
    df = groundings.join(s, [key, "signal_id"], "left")
    status = citation_status(F.col("tipo"), F.col("disponible"), F.col("actual_value"), F.col("cited_value"), latin_only)
    return df.withColumn("status", status).drop("tipo", "disponible")


def audit_gathered(groundings: DataFrame, measured: DataFrame, signals: Column, key: str = KEY, latin_only: bool = True) -> DataFrame:
    """audit_citations() against signals that are made of a row of `measured` (a row for each key) as an array of signal_sets().

    Groundings go to their verification's row, and signals are made there: no row for each signal is made or dealt out.
    """
    held = groundings.groupBy(key).agg(F.collect_list(F.struct(*[c for c in groundings.columns if c != key])).alias("_held"))
    # after the join, as arrays of signals are far longer than what they are made of; a verification that was not measured has none
    df = held.join(measured.withColumn("_there", F.lit(True)), key, "left").select(key, "_held", F.when(F.col("_there"), signals).alias("_signals"))
    df = df.withColumn("_ids", F.coalesce(F.transform("_signals", lambda s: s["signal_id"]), F.array().cast("array<string>")))
    found = lambda g: F.get("_signals", F.array_position("_ids", g["signal_id"]).cast("int") - 1)
    df = df.select(key, F.inline_outer(F.transform("_held", lambda g: F.struct(g.alias("g"), found(g).alias("s")))))
    status = citation_status(F.col("s.tipo"), F.col("s.disponible"), F.col("s.valor"), F.col("g.cited_value"), latin_only)
    return df.select(key, "g.*", F.col("s.valor").alias("actual_value"), status.alias("status"))


def citation_status(kind: Column, available: Column, actual: Column, cited: Column, latin_only: bool = True) -> Column:
    """What an audit says of a cited value; kind is null where there is no such signal."""
    absent = F.coalesce(text.loose(cited, latin_only) == UNAVAILABLE.lower(), F.lit(False))
    return (
        F.when(kind.isNull(), "unknown_signal").when(~available, F.when(absent, "valid").otherwise("unavailable_signal"))
        .when(cited.isNull(), "missing_cited_value").when(typed_match(kind, actual, cited, latin_only), "valid").otherwise("value_mismatch")
    )


def audited_sets(runs: DataFrame, latin_only: bool = True) -> DataFrame:
    """runs (decision; signals of signal_sets(), groundings) with audited, unsaid, and what fidelity() counts, all from the row itself.

    audited: array of (orden, signal_id, cited_value, actual_value, status); unsaid: adverse signals that a decided run does not cite, by their place among the signals.
    """
    none = F.array().cast("array<string>")
    df = runs.withColumn("_ids", F.transform("signals", lambda s: s["signal_id"])).withColumn("_cited", F.coalesce(F.transform("groundings", lambda g: g["signal_id"]), none))
    found = lambda g: F.get("signals", F.array_position("_ids", g["signal_id"]).cast("int") - 1)
    df = df.withColumn("_met", F.coalesce(F.transform("groundings", lambda g, i: F.struct(i.alias("orden"), g["signal_id"].alias("signal_id"), g["cited_value"].alias("cited_value"), found(g).alias("s"))), F.array()))
    status = lambda g: citation_status(g["s"]["tipo"], g["s"]["disponible"], g["s"]["valor"], g["cited_value"], latin_only)
    df = df.withColumn("audited", F.transform("_met", lambda g: F.struct(g["orden"].alias("orden"), g["signal_id"].alias("signal_id"), g["cited_value"].alias("cited_value"), g["s"]["valor"].alias("actual_value"), status(g).alias("status"))))
    has = F.col("decision").isNotNull()
    df = df.withColumn("unsaid", F.when(has, F.array_except(F.transform(F.filter("signals", lambda s: adverse(s)), lambda s: s["signal_id"]), F.col("_cited"))).otherwise(none)).drop("_ids", "_cited", "_met")
    df = df.withColumns({"citations_valid": F.size(F.filter("audited", lambda a: a["status"] == "valid")).cast("long"), "citations_total": F.size("audited").cast("long"), "n_omitted": F.size("unsaid").cast("long")})
    return df.withColumn("faithful", has & (F.col("citations_valid") == F.col("citations_total"))).withColumn("complete", has & (F.col("n_omitted") == 0))


def adverse_signals(signals: DataFrame, key: str = KEY) -> DataFrame:
    return signals.filter(adverse()).select(key, "signal_id")


def omitted(signals: DataFrame, groundings: DataFrame, key: str = KEY) -> DataFrame:
    """Adverse signals that no grounding cites, whatever its weight."""
    return adverse_signals(signals, key).join(groundings.select(key, "signal_id"), [key, "signal_id"], "left_anti")


def omitted_sets(signals: DataFrame, groundings: DataFrame, key: str = KEY) -> DataFrame:
    """key, adverse, omitted as arrays, for every verification of signals."""
    a = signals.groupBy(key).agg(F.array_sort(F.collect_set(F.when(adverse(), F.col("signal_id")))).alias("adverse"))
    g = groundings.groupBy(key).agg(F.collect_set("signal_id").alias("cited"))
    return a.join(g, key, "left").select(key, "adverse", F.array_except("adverse", F.coalesce("cited", F.array().cast("array<string>"))).alias("omitted"))


def fidelity(runs: DataFrame, audited: DataFrame, unsaid: DataFrame, keys=(KEY,)) -> DataFrame:
    """runs with valid and total citations, faithful and complete; without a decision neither holds."""
    keys = list(keys)
    a = audited.groupBy(*keys).agg(F.count_if(F.col("status") == "valid").alias("citations_valid"), F.count("*").alias("citations_total"))
    o = unsaid.groupBy(*keys).agg(F.count("*").alias("n_omitted"))
    df = runs.join(a, keys, "left").join(o, keys, "left").na.fill(0, ["citations_valid", "citations_total", "n_omitted"])
    has = F.col("decision").isNotNull()
    return df.withColumn("faithful", has & (F.col("citations_valid") == F.col("citations_total"))).withColumn("complete", has & (F.col("n_omitted") == 0))
