"""Sources: capture files, stored model responses, budget journals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024
MAX_PIXELS = 40_000_000


def capture_files(spark, path: str) -> DataFrame:
    """path, length, sha256 of files; the bytes are not kept."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def capture_hashes(spark, path: str, most: int = MAX_BYTES) -> DataFrame:
    """path, length, sha256, reject_reason of every file below path, with the columns of its partition folders.

    Lengths come from the listing: the bytes of files that are too large are never read. Files without
    bytes are left out by the scan itself; a capture that has none is missing.
    """
    found = spark.read.format("binaryFile").load(path)
    own = [c for c in found.columns if c not in ("path", "modificationTime", "length", "content")]
    none = F.lit(None).cast("string")
    fine = found.filter(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("sha256"), none.alias("reject_reason"), *own)
    large = found.filter(F.col("length") > most).select("path", "length", none.alias("sha256"), F.lit("too_large").alias("reject_reason"), *own)
    return fine.unionByName(large)


def admission(captures: DataFrame) -> DataFrame:
    """captures (length, width, height, optional) with reject_reason; an absent or empty optional capture is null, not an error."""
    empty = F.coalesce(F.col("length") == 0, F.lit(True))
    reason = F.when(empty & F.col("optional"), None).when(empty, "empty").when(F.col("length") > MAX_BYTES, "too_large").when(F.col("width").cast("long") * F.col("height") > MAX_PIXELS, "too_many_pixels")
    return captures.withColumn("present", ~empty).withColumn("reject_reason", reason)


RESPONSE = "cached_at string, model string, request string, response string, _corrupt string"


def stored_responses(spark, path: str, schema: str = RESPONSE) -> DataFrame:
    """One JSON object a file; a corrupt file, or one without a response, is not there."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.filter("response is not null and _corrupt is null").drop("_corrupt")


def responses_for(spark, path: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """The stored responses of the wanted keys, with their key. Files lie in folders prefix=<first two digits of the key>/key=<key>.

    Only the folders of prefixes that are wanted are listed into the scan (a few hundred at most); the key itself meets by a semi-join.
    """
    wanted = keys.select(F.col(key).cast("string").alias("key")).distinct()
    prefixes = [r[0] for r in wanted.select(F.substring("key", 1, 2)).distinct().collect()]
    found = stored_responses(spark, path, f"{RESPONSE}, prefix string, key string")
    return found.filter(F.col("prefix").isin(prefixes)).join(wanted, "key", "left_semi")


def budget_journal(texts: DataFrame, column: str = "value") -> DataFrame:
    """day, slot, spent of journals (JSON day -> slot -> count); a corrupt one is empty."""
    parsed = texts.select(F.from_json(column, "map<string,map<string,int>>").alias("j"))
    return parsed.select(F.explode("j").alias("day", "slots")).select("day", F.explode("slots").alias("slot", "spent"))
