"""The registry of verifications: three tables, the full record, and the summary of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "verification_id"
TABLES = ("verificaciones", "verificacion_senales", "verificacion_fundamentos")


def registry_tables(runs: DataFrame, signals: DataFrame, audited: DataFrame, unsaid: DataFrame) -> dict[str, DataFrame]:
    """Header, signals and groundings of runs. `adversa` is said of every verification, `omitida` only where there was a decision."""
    from attesta.operators.signals import adverse

    head = runs.select(KEY, "creado_en", "outcome", "decision", "citations_valid", "citations_total", "faithful", "complete", F.col("creado_en").cast("date").alias("creado_dia"))
    left_out = unsaid.select(KEY, "signal_id", F.lit(True).alias("omitida"))
    rows = signals.join(runs.select(KEY, F.col("decision").isNotNull().alias("decided")), KEY).join(left_out, [KEY, "signal_id"], "left")
    rows = rows.select(KEY, "signal_id", "tipo", "valor", "disponible", "motivo_indisponible", adverse().alias("adversa"), (F.col("decided") & F.coalesce("omitida", F.lit(False))).alias("omitida"))
    return {"verificaciones": head, "verificacion_senales": rows, "verificacion_fundamentos": audited.select(KEY, "orden", "signal_id", "cited_value", "actual_value", "status")}


def tables_of_sets(runs: DataFrame) -> dict[str, DataFrame]:
    """registry_tables() of runs as audit.audited_sets() leaves them, with creado_en: all three are read off the same row."""
    from attesta.operators.signals import adverse

    head = runs.select(KEY, "creado_en", "outcome", "decision", "citations_valid", "citations_total", "faithful", "complete", F.col("creado_en").cast("date").alias("creado_dia"))
    rows = runs.select(KEY, "unsaid", F.inline_outer("signals"))
    rows = rows.select(KEY, "signal_id", "tipo", "valor", "disponible", "motivo_indisponible", adverse().alias("adversa"), F.array_contains("unsaid", F.col("signal_id")).alias("omitida"))
    return {"verificaciones": head, "verificacion_senales": rows, "verificacion_fundamentos": runs.select(KEY, F.inline_outer("audited")).filter("orden is not null")}


def write_registry(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Three Parquet tables; the header is partitioned by day, the others follow its key."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        (w.partitionBy("creado_dia") if "creado_dia" in df.columns else w).parquet(f"{path}/{name}")


def store(tables: dict[str, DataFrame], name: str, path: str, buckets: int = 64) -> None:
    """The three tables as name_<table>, bucketed and sorted by verification, a file for each bucket.

    What meets by verification afterwards (audits, full records) needs no exchange of them.
    """
    for t, df in tables.items():
        df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{path}/{t}").mode("overwrite").saveAsTable(f"{name}_{t}")


def store_sets(runs: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """store() of tables_of_sets(runs). Runs are audited once, into a table of their own; the three tables are made of it, bucket by bucket, without an exchange.

    runs are dealt out by verification into as many partitions as there are buckets.
    """
    runs.write.bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{path}/runs").mode("overwrite").saveAsTable(f"{name}_runs")
    for t, df in tables_of_sets(runs.sparkSession.table(f"{name}_runs")).items():
        df.write.bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{path}/{t}").mode("overwrite").saveAsTable(f"{name}_{t}")


def stored(spark, name: str) -> dict[str, DataFrame]:
    """The tables of store(). Joins by verification and signal use their buckets too, as rows of one verification lie in one bucket."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return {t: spark.table(f"{name}_{t}") for t in TABLES}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def full_records(tables: dict[str, DataFrame]) -> DataFrame:
    """Header with its ordered signals and groundings."""
    s = tables["verificacion_senales"].groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("signal_id", "valor", "adversa", "omitida"))).alias("senales"))
    g = tables["verificacion_fundamentos"].groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("orden", "signal_id", "status"))).alias("fundamentos"))
    return tables["verificaciones"].join(s, KEY, "left").join(g, KEY, "left")


def full_sets(runs: DataFrame) -> DataFrame:
    """full_records() of runs as audit.audited_sets() leaves them, with creado_en: the record is made in the run's own row, no exchange."""
    from attesta.operators.signals import adverse

    s = lambda x: F.struct(x["signal_id"].alias("signal_id"), x["valor"].alias("valor"), adverse(x).alias("adversa"), F.array_contains("unsaid", x["signal_id"]).alias("omitida"))
    g = lambda x: F.struct(x["orden"].alias("orden"), x["signal_id"].alias("signal_id"), x["status"].alias("status"))
    some = lambda c: F.when(F.size(c) > 0, c)
    return runs.select(
        KEY, "creado_en", "outcome", "decision", "citations_valid", "citations_total", "faithful", "complete", F.col("creado_en").cast("date").alias("creado_dia"),
        some(F.array_sort(F.transform("signals", s))).alias("senales"), some(F.array_sort(F.transform("audited", g))).alias("fundamentos"),
    )


def summary(head: DataFrame) -> DataFrame:
    """One row of counts, never rates."""
    decided = F.col("outcome") == "decided"
    return head.agg(F.count("*").alias("total"), F.count_if(~decided).alias("escalated_without_judgement"), F.count_if(F.col("citations_total") > 0).alias("with_explanation"), F.count_if(decided & F.col("faithful")).alias("faithful"), F.count_if(decided & F.col("complete")).alias("complete"))


def summary_sets(head: DataFrame) -> DataFrame:
    """level (total, decision, outcome, day), value, and the counts of summary() for each, from one scan by grouping sets.

    Each level but a day's adds up to the total. Where there was no decision, the value is null.
    """
    decided, keys = F.col("outcome") == "decided", ("decision", "outcome", "creado_dia")
    sets = head.groupingSets([[k] for k in keys] + [[]], *keys)
    n = sets.agg(
        F.grouping_id().alias("_g"), F.count("*").alias("total"), F.count_if(~decided).alias("escalated_without_judgement"), F.count_if(decided).alias("with_explanation"),
        F.count_if(decided & F.col("faithful")).alias("faithful"), F.count_if(decided & F.col("complete")).alias("complete"),
    )
    # the bits of grouping_id() are 0 for the keys of a set
    level = F.when(F.col("_g") == 3, "decision").when(F.col("_g") == 5, "outcome").when(F.col("_g") == 6, "day").otherwise("total")
    value = F.coalesce("decision", "outcome", F.col("creado_dia").cast("string"))
    return n.select(level.alias("level"), value.alias("value"), "total", "escalated_without_judgement", "with_explanation", "faithful", "complete")


def counts_by(head: DataFrame, column: str) -> DataFrame:
    return head.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def most_omitted(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.filter("omitida").groupBy("signal_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signal_id").limit(n)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
