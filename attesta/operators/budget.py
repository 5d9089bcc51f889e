"""Request budgets by quota day, account and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.answers import quota_day


def with_day(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("day", quota_day(F.col("ts")))


def spent(attempts: DataFrame, limit: int | None = None) -> DataFrame:
    """day, account, model, spent, remaining (null without a limit), by_others: the same model's other accounts."""
    n = attempts.groupBy("day", "account", "model").agg(F.count("*").alias("spent"))
    others = F.sum("spent").over(Window.partitionBy("day", "model")) - F.col("spent")
    left = F.greatest(F.lit(0), F.lit(limit) - F.col("spent")) if limit is not None else F.lit(None).cast("int")
    return n.select("day", "account", "model", "spent", left.alias("remaining"), others.alias("by_others"))


def spent_with_legacy(attempts: DataFrame, limit: int | None = None) -> DataFrame:
    """spent() where attempts without an account were booked by model alone: they count for every account that asks, and for none of the others.

    by_others leaves them out. Days and models that have nothing else keep a row without an account.
    """
    n = attempts.groupBy("day", "account", "model").agg(F.count("*").alias("n"))
    slot = Window.partitionBy("day", "model")
    old, named = F.col("account").isNull(), F.sum(F.when(F.col("account").isNotNull(), F.col("n")).otherwise(0)).over(slot)
    df = n.withColumn("legacy", F.sum(F.when(old, F.col("n")).otherwise(0)).over(slot)).withColumn("named", named).filter(~old | (F.col("named") == 0))
    total = F.when(old, F.col("n")).otherwise(F.col("n") + F.col("legacy"))
    left = F.greatest(F.lit(0), F.lit(limit) - total) if limit is not None else F.lit(None).cast("long")
    return df.select("day", "account", "model", total.alias("spent"), "legacy", left.alias("remaining"), F.when(~old, F.col("named") - F.col("n")).otherwise(0).alias("by_others"))


def balances(attempts: DataFrame) -> DataFrame:
    """attempts (day, account, model, ts, event_id, delta) with the running balance, which a refund never takes below 0."""
    w = Window.partitionBy("day", "account", "model").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = attempts.withColumn("_s", F.sum("delta").over(w))
    return df.withColumn("balance", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def admitted(attempts: DataFrame, limit: int) -> DataFrame:
    """The first `limit` attempts of each day, account and model."""
    w = Window.partitionBy("day", "account", "model").orderBy("ts", "event_id")
    return attempts.withColumn("_n", F.row_number().over(w)).withColumn("admitted", F.col("_n") <= limit).drop("_n")


def unanswered(cases: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    return cases.join(responses.select(key), key, "left_anti")


def batch_plan(cases: DataFrame, responses: DataFrame, key: str, retries: int, remaining: int) -> DataFrame:
    """One row: cases, cached, missing, worst case, and whether it fits."""
    known = responses.select(key).distinct().withColumn("_known", F.lit(True))
    n = cases.join(known, key, "left").agg(F.count("*").alias("cases"), F.count("_known").alias("cached"))
    n = n.withColumn("missing", F.col("cases") - F.col("cached")).withColumn("worst", F.col("missing") * (retries + 1))
    return n.withColumn("fits", F.col("worst") <= remaining)
