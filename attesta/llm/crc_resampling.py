"""Target-distribution importance resampling with length-bucketed CRC matrices.

Features of a text are its runs of 1 to `n` words; a feature's bucket is the CRC-32 of its UTF-8
bytes modulo `buckets`. A task collects the distinct features of a slice of texts, groups them by
equal length into matrices of bytes, updates the checksums of a whole matrix column by column, and
scatters the buckets back. They are written once in the shared folder, two bytes for each feature
(four if there are more than 65,536 buckets); counting and weighing read them from there.

A bucket's gain is the log ratio of target to raw text with one added to every count. A text's
weight is the mean of its features' gains; Gumbel noise from the id makes the highest scores a
draw without replacement. Counts by bucket and by score are of a fixed size (there are at most some
ten thousand different scores, as gains and noise are bounded); the highest scores are ranked by ranges of
(score, id), so that no task holds them all.

Cases: null, empty and blank texts have no features and weight 0. Null ids are kept, take part
with the noise of an empty id and stand last among ties; repeated rows are drawn each by itself.
Texts are taken whole. Empty tables count 0 everywhere. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.bpe import slices
from attesta.llm.tables import read, written

#: The checksum's polynomial makes the table of the 256 single bytes.
TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
TABLE ^= TABLE[0]
#: Bytes to lower-case letters, digits and bytes of other characters; all else separates words.
KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct features whose buckets a task keeps.
KEPT = 300_000


def crc32_of(features: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of each: equal lengths make a matrix whose checksums are updated column by column."""
    out = np.zeros(len(features), np.uint32)
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(group):
            size = int(sizes[group[0]])
            rows = np.frombuffer(b"".join([features[i] for i in group]), np.uint8).reshape(len(group), size)
            crc = np.full(len(group), 0xFFFFFFFF, np.uint32)
            for column in rows.T:
                crc = TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[group] = ~crc
    return out


class Buckets:
    """feature -> bucket; the distinct new ones of a slice are worked out together."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.known = n, buckets, {}

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Buckets of each text's features, and its number of words."""
        cut, words = [], []
        for t in texts:
            found = t.encode().translate(KEEP).split()
            words.append(len(found))
            runs = list(found)
            for k in range(2, self.n + 1):
                runs += [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
            cut.append(runs)
        if len(self.known) > KEPT:
            self.known = {}
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, (crc32_of(new) % np.uint32(self.buckets)).tolist()))
        return [np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs)) for runs in cut], words


def featured(docs: DataFrame, n: int, buckets: int, id_col="doc_id", text_col="text") -> DataFrame:
    """id, words, features (binary: a little-endian number for each feature's bucket)."""
    docs = docs.select(id_col, text_col)
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        found = Buckets(n, buckets)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                got, words = found.of(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(words, pa.int64()), pa.array([g.astype(kind).tobytes() for g in got], pa.binary())], ["id", "words", "features"])

    return docs.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, words long, features binary")


def counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket stands in the features: a count for each task and bucket, then their sums."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    # at most `buckets` rows
    for r in features.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    n, t_all, s_all = len(raw), float(target.sum()), float(raw.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for t, s in zip(target.tolist(), raw.tolist())], np.int64)


def scored(features: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """id, words, n_features, weight, score of (id, words, features)."""
    kind, id_kind = "<u2" if len(gain) <= 1 << 16 else "<u4", features.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(2)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            sums = np.fromiter((gain[f].sum() for f in found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(sums // np.maximum(sizes, 1))], ["id", "words", "n_features", "weight"])

    out = features.select("id", "words", "features").mapInArrow(run, f"id {id_kind}, words long, n_features long, weight long")
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(first, 16, 10).cast("double")
    return out.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long"))


def drawn(rows: DataFrame, eligible, k: int) -> DataFrame:
    """rows (a table with id and score) with rank: 1 .. k for the highest scores among the eligible, ties to smaller ids, else null.

    Counts by score tell where the k-th lies; rows from there up are dealt by ranges of (score, id,
    row), numbered within a range, and moved on by the sizes of the ranges before.
    """
    count = rows.filter(eligible).groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    # as many rows as there are different scores
    cut = count.withColumn("above", F.coalesce(above, F.lit(0))).filter(F.col("above") < k).agg(F.min("score")).first()[0]
    null = F.lit(None).cast("long")
    if cut is None:
        return rows.withColumn("rank", null)
    top = F.coalesce(eligible & (F.col("score") >= cut), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    table = rows.withColumn("row", F.monotonically_increasing_id())
    ranged = table.filter(top).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # as many rows as there are partitions
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranks = numbered.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + nth + 1)
    ranks = ranks.select(*rows.columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return rows.filter(~top).withColumn("rank", null).unionByName(ranks)


def resample(docs: DataFrame, target: DataFrame, n=1, buckets=10_000, seed=2024, min_words=20, share=(10, 100), id_col="doc_id", text_col="text", target_col="text") -> DataFrame:
    """id, n_features, weight, score, rank of every row of docs; share: numerator and denominator of the part to draw."""
    features = written(featured(docs, n, buckets, id_col, text_col), "features")
    wanted = featured(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), n, buckets, "id", "text")
    table = written(scored(features, gains(counts(wanted, buckets), counts(features, buckets)), seed), "scores")
    eligible = F.col("words") >= min_words
    out = drawn(table, eligible, share[0] * table.filter(eligible).count() // share[1])
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def query(spark, sf_dir):
    return resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))


#: The checksums of distinct words, four bits at a time, from the polynomial; everything else as in the contract.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), crc AS (
  SELECT word, hex(encode(word)) AS digits, 1 AS pos, 4294967295::BIGINT AS c FROM (SELECT DISTINCT word FROM words)
  UNION ALL
  SELECT word, digits, pos + 2, list_reduce(range(9), lambda a, i: CASE WHEN i = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(c, ('0x' || substr(digits, pos, 2))::BIGINT)) FROM crc WHERE pos < length(digits)
), buckets AS (
  SELECT word, xor(c, 4294967295::BIGINT) % 10000 AS bucket FROM crc WHERE pos > length(digits)
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM words JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), sums AS (
  SELECT id, count(*) AS n, sum(gain)::DOUBLE AS total FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight,
    coalesce(floor(total / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN sums ON doc_id = id
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""
