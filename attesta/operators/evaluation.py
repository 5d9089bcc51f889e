"""Evaluations on equal denominators: agent against rules, models side by side, readings against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOPPING = ("bad_credential", "out_of_quota")


def check_access(split: str, final_measurement: bool = False) -> str:
    """The split's name; the holdout only for a final measurement."""
    if split not in ("calibration", "holdout"):
        raise ValueError(f"unknown split: {split}")
    if split == "holdout" and not final_measurement:
        raise PermissionError("the holdout is for the final measurement")
    return split


def in_split(cases: DataFrame, split: str, final_measurement: bool = False) -> DataFrame:
    return cases.filter(F.col("split") == check_access(split, final_measurement))


def cut_batch(runs: DataFrame, batch: str, order: str) -> DataFrame:
    """runs up to and including the first stopping outcome of each batch; `before` marks those that count as answered.

    One minimum for each batch and an equi-join, not one ordered partition for each batch.
    """
    stops = runs.filter(F.col("outcome").isin(*STOPPING)).groupBy(batch).agg(F.min(order).alias("_stop"))
    df = runs.join(stops, batch, "left").filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))
    return df.withColumn("before", F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def agent_against_rules(runs: DataFrame, *by: str) -> DataFrame:
    """Counts by group; a hit was decided and is right, a coincidence is right through the fallback alone."""
    right = F.coalesce("decision", F.lit("escalate_to_human")) == F.col("expected")
    decided, answered = F.col("outcome") == "decided", F.col("outcome") != "unavailable"
    rule = F.col("rule_decision") == F.col("expected")
    n = F.count_if
    return runs.groupBy(*by).agg(
        F.count("*").alias("cases"), n(answered).alias("answered"), n(decided & right).alias("hits"), n(answered & ~decided & right).alias("coincidences"), n(F.col("faithful")).alias("faithful"), n(F.col("complete")).alias("complete"),
        F.sum("citations_valid").alias("citations_valid"), F.sum("citations_total").alias("citations_total"), n(rule).alias("rule_hits"), n(rule & answered).alias("rule_hits_answered"),
    )


def rules_measured(cases: DataFrame) -> DataFrame:
    """cases (split, expected, decision, faithful): split, expected (TOTAL for a split as a whole), cases, hits, faithful."""
    n = cases.groupingSets([["split", "expected"], ["split"]], "split", "expected").agg(
        F.grouping("expected").alias("all"), F.count("*").alias("cases"), F.count_if(F.col("decision") == F.col("expected")).alias("hits"), F.count_if("faithful").alias("faithful")
    )
    return n.select("split", F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("expected")).alias("expected"), "cases", "hits", "faithful")


def rule_failures(cases: DataFrame) -> DataFrame:
    """The cases that the rules decide otherwise than expected, and by which rule."""
    wrong = ~F.coalesce(F.col("decision") == F.col("expected"), F.lit(False))
    return cases.filter(wrong).select("verification_id", "split", "expected", F.col("decision").alias("got"), "rule")


def model_hits(runs: DataFrame) -> DataFrame:
    """model, answered, hits, broke_contract: each over the cases that this model answered, so the denominators differ."""
    answered, decided = F.col("outcome") != "unavailable", F.col("outcome") == "decided"
    n = F.count_if
    return runs.groupBy("model").agg(n(answered).alias("answered"), n(decided & (F.col("decision") == F.col("expected"))).alias("hits"), n(answered & ~decided).alias("broke_contract"))


def differing_cases(runs: DataFrame) -> DataFrame:
    """verification_id, models, answers: cases that at least two models answered, and not alike; a broken contract is an answer of its own."""
    shown = F.when(F.col("outcome") == "decided", F.col("decision")).when(F.col("outcome") != "unavailable", "broke_contract")
    by = runs.withColumn("shown", shown).filter("shown is not null").groupBy("verification_id")
    n = by.agg(F.count("*").alias("models"), F.min("shown").alias("least"), F.max("shown").alias("most"), F.countDistinct("shown").alias("answers"))
    return n.filter("models > 1 and least <> most").select("verification_id", "models", "answers")


def facial_cases_judged(cases: DataFrame, readings: DataFrame, runs: DataFrame) -> DataFrame:
    """model, case_id, kind, expected, got, similarity, reason, answered, hit, strict_hit, faithful, rule_hit for each run of a facial case.

    cases: case_id, kind, expected, rule_decision; readings: case_id, side, similarity, reason (several a
    case, of which the largest that has a similarity counts, else the largest); runs: case_id, model,
    outcome, decision, faithful. A hit may be the fallback's; a strict one was decided. Runs that got no answer are no hit of either kind.
    """
    best = readings.groupBy("case_id").agg(F.max_by(F.struct("similarity", "reason"), F.struct(F.col("similarity").isNotNull().alias("has"), "side", "similarity")).alias("r"))
    df = cases.join(best, "case_id", "left").join(runs, "case_id")
    answered, got = F.col("outcome") != "unavailable", F.coalesce("decision", F.lit("escalate_to_human"))
    right = answered & (got == F.col("expected"))
    return df.select(
        "model", "case_id", "kind", "expected", F.when(answered, got).alias("got"), "r.similarity", "r.reason", answered.alias("answered"), right.alias("hit"),
        (right & (F.col("outcome") == "decided")).alias("strict_hit"), (answered & F.coalesce("faithful", F.lit(False))).alias("faithful"), (F.col("rule_decision") == F.col("expected")).alias("rule_hit"),
    )


def facial_totals(judged: DataFrame) -> DataFrame:
    """By model: cases of either kind, answered ones, hits of both definitions, faithful ones, and the rules' hits over all cases."""
    n = F.count_if
    return judged.groupBy("model").agg(
        n(F.col("kind") == "legit").alias("legit"), n(F.col("kind") == "impersonation").alias("impersonation"), n("answered").alias("answered"), n("hit").alias("hits"), n("strict_hit").alias("strict_hits"),
        n("faithful").alias("faithful"), n("rule_hit").alias("rule_hits"), n(F.col("similarity").isNull()).alias("without_similarity"),
    )


def disagreements(runs: DataFrame, most: int = 200) -> DataFrame:
    wrong = (F.col("outcome") == "decided") & (F.col("decision") != F.col("expected"))
    return runs.filter(wrong).select("verification_id", "model", "expected", F.col("decision").alias("got"), F.substring(F.concat(F.lit("got "), "decision", F.lit(" for "), "expected"), 1, most).alias("said"))


def lost_runs(runs: DataFrame) -> DataFrame:
    """model, verification_id: a row for each case that a model did not answer."""
    return runs.filter("outcome = 'unavailable'").select("model", "verification_id")


def models_side_by_side(runs: DataFrame, models: list[str]) -> DataFrame:
    """One row for each case with each model's decision (or how it broke the contract), and whether answering models differ."""
    shown = F.when(F.col("outcome") == "decided", F.col("decision")).otherwise(F.col("outcome"))
    df = runs.withColumn("shown", shown).withColumn("answer", F.when(F.col("outcome") == "decided", F.col("decision")))
    return df.groupBy("verification_id").pivot("model", models).agg(F.first("shown").alias("shown"), F.first("answer").alias("answer")).withColumn("differ", F.coalesce(_differ([f"{m}_answer" for m in models]), F.lit(False))).drop(*[f"{m}_answer" for m in models])


def _differ(columns: list[str]) -> Column:
    return F.size(F.array_distinct(F.array_compact(F.array(*columns)))) > 1


def readings_by_condition(readings: DataFrame) -> DataFrame:
    """readings (condition, exact, checks_ok, repaired, readable): counts by condition and in total."""
    n = F.count_if
    df = readings.rollup("condition").agg(F.grouping("condition").alias("all"), F.count("*").alias("readings"), n("exact").alias("exact"), n("checks_ok").alias("checks_ok"), n("repaired").alias("repaired"), n(F.col("checks_ok") & ~F.col("exact")).alias("false_ok"), n(~F.col("readable")).alias("no_mrz"))
    return df.withColumn("condition", F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("condition").cast("string"))).drop("all")


def fields_by_condition(scored: DataFrame) -> DataFrame:
    """scored (condition, field, found, correct): the matrix of conditions and fields with its totals."""
    n = scored.cube("condition", "field").agg(F.grouping("condition").alias("c"), F.grouping("field").alias("f"), F.count("*").alias("readings"), F.count_if("found").alias("found"), F.count_if("correct").alias("correct"))
    named = lambda all_, c: F.when(F.col(all_) == 1, "TOTAL").otherwise(F.col(c).cast("string")).alias(c)
    return n.select(named("c", "condition"), named("f", "field"), "readings", "found", "correct")


def first_of_each(rows: DataFrame, group: str, order: str, n: int = 12) -> DataFrame:
    """The first n rows of each group; tasks drop what cannot be among them before the rows are dealt out."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def silent_failures(readings: DataFrame, n: int = 12) -> DataFrame:
    """condition, place, verification_id: the first n readings of each condition that the check digits pass and that are wrong."""
    return first_of_each(readings.filter(F.col("checks_ok") & ~F.col("exact")), "condition", "verification_id", n).select("condition", "place", "verification_id")


def first_difference(read: Column, truth: Column) -> Column:
    """(line, marks): the first line that differs, with ^ below the characters that do."""
    marks = F.transform(F.arrays_zip(read.alias("a"), truth.alias("b")), lambda p: F.array_join(F.transform(F.arrays_zip(F.split(p["a"], "").alias("x"), F.split(p["b"], "").alias("y")), lambda c: F.when(c["x"].eqNullSafe(c["y"]), " ").otherwise("^")), ""))
    line = F.array_position(F.transform(marks, lambda m: m.contains("^")), True)
    return F.when(line > 0, F.struct(line.cast("int").alias("line"), F.get(marks, (line - 1).cast("int")).alias("marks")))


def confidence_by_correctness(fields: DataFrame) -> DataFrame:
    return fields.groupBy("correct").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("least"))


def capture_margin(sweeps: DataFrame) -> DataFrame:
    """sweeps (sweep, value, good): the last good value before the first failure, and the last good one at all."""
    seen = Window.partitionBy("sweep").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = sweeps.withColumn("failed", F.max((~F.col("good")).cast("int")).over(seen) == 1)
    return df.groupBy("sweep").agg(F.max(F.when(~F.col("failed"), F.col("value"))).alias("before_failure"), F.max(F.when(F.col("good"), F.col("value"))).alias("last_good"))
