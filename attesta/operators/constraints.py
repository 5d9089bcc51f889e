"""Declared rules over tables: counted in the pass that reads the rows, with the rows that break them.

A table's row rules are one array expression; `Dataset.observe` counts them while the broken rows are
written, so a suite is one scan of each table, and one aggregation for each key that must be unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attesta.sources.tables import scratch

VIOLATIONS = "table string, rule string, key string, times long"


@dataclass(frozen=True)
class Rule:
    """A condition that no row may meet; null does not meet it."""

    name: str
    broken: Column


@dataclass(frozen=True)
class Unique:
    """Columns that no two rows may share. Null is a value of its own."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Gathered:
    """A table whose rows lie in arrays: items (an array of structs) beside the column `owner`, which all rows of the array share."""

    df: DataFrame
    owner: str
    items: str = "items"

    def rows(self) -> DataFrame:
        # outer, and empty arrays left out afterwards: Spark would put a filter for them below the steps that make the array, and take them all twice
        return self.df.select(self.owner, F.explode_outer(self.items).alias("_x")).filter("_x is not null").select(self.owner, "_x.*")

    def repeats(self, column: str) -> DataFrame:
        """owner, column, times of what stands more than once. Owners alone are dealt out, not their rows: an owner of one array repeats within it; the arrays of others are laid out and grouped."""
        of, df = F.transform(self.items, lambda x: F.struct(x[column].alias(column))), self.df
        one = df.select(self.owner, of.alias("_ids"))
        laid_out = lambda d, c: d.select(self.owner, F.explode_outer(c).alias("_x")).filter("_x is not null").select(self.owner, "_x.*")
        twice = F.when(F.size("_ids") > F.size(F.array_distinct("_ids")), F.col("_ids"))
        many = df.groupBy(self.owner).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(self.owner).alias("_owner"))
        if many.isEmpty():
            within = laid_out(one, twice)
        else:
            same = F.col(self.owner).eqNullSafe(F.col("_owner"))
            within = laid_out(one.join(many, same, "left_anti"), twice).unionByName(laid_out(one.join(many, same, "left_semi"), F.col("_ids")))
        return within.groupBy(self.owner, column).agg(F.count("*").alias("times")).filter("times > 1")


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def checked(df: DataFrame | Gathered, table: str, key: Sequence[str], rules: Sequence[Rule | Unique], path: str) -> list[tuple[str, str, int, int]]:
    """Writes what breaks the rules (table, rule, key, times) under path; (table, rule, rows, violations) of each rule.

    A key that stands n times is one violation, with n as its times.
    """
    sets, df = (df, df.rows()) if isinstance(df, Gathered) else (None, df)
    of_rows, of_keys = [r for r in rules if isinstance(r, Rule)], [r for r in rules if isinstance(r, Unique)]
    flags = {r.name: F.coalesce(r.broken, F.lit(False)) for r in of_rows}
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"r_{n}") for n, c in flags.items()])
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])) if flags else F.array().cast("array<string>")
    out = rows.select(F.lit(table).alias("table"), F.explode(broken).alias("rule"), _key(key).alias("key"), F.lit(1).cast("long").alias("times"))
    out.write.mode("append").parquet(path)
    got = seen.get
    found = [(table, r.name, got["rows"], got[f"r_{r.name}"]) for r in of_rows]
    for r in of_keys:
        many = Observation()
        if sets is not None and len(r.columns) == 2 and r.columns[0] == sets.owner:
            groups = sets.repeats(r.columns[1])
        else:
            groups = df.groupBy(*r.columns).agg(F.count("*").alias("times")).filter("times > 1")
        groups = groups.observe(many, F.count(F.lit(1)).alias("n"))
        groups.select(F.lit(table).alias("table"), F.lit(r.name).alias("rule"), _key(r.columns).alias("key"), "times").write.mode("append").parquet(path)
        found.append((table, r.name, got["rows"], many.get["n"]))
    return found


def suite(spark, tables: dict[str, tuple[DataFrame | Gathered, Sequence[str], Sequence[Rule | Unique]]]) -> tuple[DataFrame, DataFrame]:
    """(table, rule, rows, violations) for every rule, and the violations themselves. tables: name -> (rows, key, rules)."""
    path = scratch(spark, "violations")
    counts = [c for name, (df, key, rules) in tables.items() for c in checked(df, name, key, rules, path)]
    return spark.createDataFrame(counts, "table string, rule string, rows long, violations long"), spark.read.schema(VIOLATIONS).parquet(path)


def signal_rules() -> list[Rule | Unique]:
    """A signal has a value or a reason, is one of its kinds, and stands once in a verification."""
    has, why = F.col("valor").isNotNull(), F.col("motivo_indisponible").isNotNull()
    return [
        Rule("value_and_reason", has & why), Rule("neither_value_nor_reason", ~has & ~why), Rule("available_without_value", F.col("disponible") != has),
        Rule("unknown_kind", ~F.coalesce(F.col("tipo").isin("score", "confidence", "count", "text", "flag"), F.lit(False))), Unique("one_signal", ("verification_id", "signal_id")),
    ]


def grounding_rules() -> list[Rule | Unique]:
    return [Rule("negative_place", F.col("orden") < 0), Unique("one_place", ("verification_id", "orden"))]


def case_rules(least: int = 55, least_disputed: int = 150) -> list[Rule | Unique]:
    """Labels of cases: a fraud that leaves no trace is to be approved, and a label that may be disputed is explained at length."""
    size, disputed = F.coalesce(F.length("reason"), F.lit(0)), F.col("ambiguous") | ~F.col("detectable")
    return [
        Rule("undetectable_not_approved", ~F.col("detectable") & (F.col("expected_decision") != "approve")), Rule("reason_too_short", size < least),
        Rule("disputed_reason_too_short", disputed & (size <= least_disputed)), Unique("one_case", ("id",)),
    ]
