"""Line dedup by site-relative frequency, with DataFrame operations only.

Documents are grouped by host. A line's ratio is the number of the host's documents that contain
it divided by all documents of the host; lines above `ratio` are boilerplate and are dropped
wherever they occur in that host, however few documents it has. A line that stands in one document
alone repeats nothing, and is none. For a host with P documents of L distinct lines on average
there are fewer than L / ratio such lines, so the list that a host carries is bounded by what one
document holds, not by the number of documents. A document looks its lines up in a hash set of the
list once; what it then compares line by line is its own share of the list.

Cases: a null host is a host of its own. Blank lines are neither counted nor dropped. Null text
stays null with 0 lines; an empty text has no lines. Texts are taken whole. A document counts once
for a line that it repeats. Repeated rows count each by itself. A ratio equal to the limit stays.
An empty table gives an empty result. Other columns are left as they are, whatever their names
are; n_lines_col and n_dropped_col name the two counts that are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.tables import fresh, read, written

NOT_BLANK = r"[^\x20\x09-\x0D]"


def _line_key(line):
    """64 bits, compared within a host with the host's list alone."""
    return F.xxhash64(line)


def boilerplate(docs: DataFrame, text_col: str, host_col: str, ratio: float) -> DataFrame:
    """host, lines (array of line keys) of the hosts that have any."""
    text, host = F.col(text_col), F.col(host_col)
    totals = docs.groupBy(host.alias("of_host")).agg(F.count("*").alias("pages"))
    lines = docs.select(host.alias("host"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")).filter(F.col("line").rlike(NOT_BLANK))
    counts = lines.select("host", _line_key(F.col("line")).alias("key")).groupBy("host", "key").count().filter(F.col("count") > 1)
    common = counts.join(totals, F.col("host").eqNullSafe(F.col("of_host"))).filter(F.col("count") > F.col("pages") * F.lit(ratio))
    return common.groupBy("host").agg(F.collect_list("key").alias("boilerplate"))


def drop_boilerplate(docs: DataFrame, text_col="text", host_col="source", ratio=0.02, n_lines_col="_n_lines", n_dropped_col="_n_dropped") -> DataFrame:
    """docs with the text's boilerplate lines dropped, and the numbers of its lines and of those dropped."""
    host, keys, hits, kept = (fresh(docs, c) for c in ("host_of_lines", "boilerplate", "boilerplate_hits", "kept_lines"))
    common = written(boilerplate(docs, text_col, host_col, ratio), "boilerplate").toDF(host, keys)
    out = docs.join(common, F.col(host_col).eqNullSafe(F.col(host)), "left")
    lines = F.split(F.col(text_col), "\n")
    out = out.withColumn(hits, F.array_intersect(F.transform(lines, _line_key), F.col(keys)))
    drop = lambda line: F.array_contains(F.col(hits), _line_key(line))
    out = out.withColumn(kept, F.when(F.coalesce(F.size(hits), F.lit(0)) == 0, lines).otherwise(F.filter(lines, lambda line: ~line.rlike(NOT_BLANK) | ~drop(line))))
    n_lines = F.coalesce(F.when(F.col(text_col) == "", 0).otherwise(F.size(lines)), F.lit(0)).cast("long")
    n_dropped = F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long")
    text = F.when(n_dropped > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], n_lines.alias(n_lines_col), n_dropped.alias(n_dropped_col))


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = drop_boilerplate(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT d.doc_id, d.source, u.ln, u.pos
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS ln, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u
), c AS (
  SELECT source, ln, count(DISTINCT doc_id) AS n FROM l WHERE regexp_matches(ln, '[^\x20\x09-\x0D]') GROUP BY source, ln
), t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (
  SELECT c.source, c.ln FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n > 1 AND c.n > t.pages * CAST(0.02 AS DOUBLE)
), k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.ln) AS n_dropped,
         coalesce(string_agg(l.ln, chr(10) ORDER BY l.pos) FILTER (WHERE b.ln IS NULL), '') AS kept
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.ln = b.ln GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE k.n_lines END AS BIGINT) AS n_lines,
       CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
