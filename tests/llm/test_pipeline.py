"""The pipeline's stages in order, each on what the one before kept."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
        assert docs.columns == columns, name
        if name != "mixing sources":
            assert 0.3 * rows < docs.count() <= rows, name
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    import public_tokenizers as P
    import tiktoken

    from attesta.llm import bpe

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array(e.encode_ordinary(r.text), "<u4")
        want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in got) == want


def _folder(spark, docs, labels, where) -> str:
    docs.write.parquet(f"{where}/documents.parquet")
    labels.write.parquet(f"{where}/labels.parquet")
    return str(where)


def _stay(rows) -> collections.Counter:
    """(id, text) that stay of rows with as many: all pairs of their five-word shingles, the smallest id of each component."""
    sets = []
    for _, text in rows:
        w = ["".join(c.lower() if c < "\x80" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    groups = collections.defaultdict(list)
    for r, (i, text) in zip(root, rows, strict=True):
        groups[r].append((i is None, i, text))
    return collections.Counter(min(g, key=lambda x: (x[0], x[1] or 0))[1:] for g in groups.values())


def test_run_on_hard_documents(spark, sf, tmp_path):
    """Nulls, empty texts, repeated rows, near copies and clashing names through all stages, and through run()."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.filter("text is not null").orderBy("doc_id").limit(6)
    near = first.withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("text", F.concat("text", F.lit(" zuletzt noch etwas")))
    bare = first.limit(2).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" \n")))
    hard = docs.union(first).union(near).union(bare).union(first.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("row", "id", "key", "weight", "kept", "Line", "node", "block"):
        hard = hard.withColumn(name, F.lit(name))
    folder = _folder(spark, hard, spark.read.parquet(f"{sf}/labels.parquet"), tmp_path)
    kept = hard = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, kept = kept, corpus_pipeline.written(stage(spark, kept, folder), "stage")
        assert kept.columns == hard.columns, name
        assert kept.filter("row <> 'row' or block <> 'block' or Line <> 'Line' or row is null").isEmpty(), name
        if k == 0:
            assert kept.subtract(hard).isEmpty() and kept.filter("text is null or trim(text) = ''").isEmpty()
        if name == "n-gram Jaccard join":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            stay = _stay(rows)
            assert sum(stay.values()) < len(rows) and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i, _ in stay.elements())
        if name == "mixing sources":
            assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in before.collect()}
    by_stages = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == collections.Counter(map(tuple, by_stages.collect()))


def test_run_on_empty_tables(spark, sf, tmp_path):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet").limit(0) for name in ("documents", "labels"))
    assert corpus_pipeline.run(spark, _folder(spark, docs, labels, tmp_path)).collect() == []


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
