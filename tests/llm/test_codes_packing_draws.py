"""Vector codes, packing and target resampling against plain versions, on hard inputs."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import crc_resampling, packing, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, id string, code string"
DOCS = "doc_id long, text string, ids string, rank int"


# 11
def plain_codes(rows, parts, entries, rounds):
    kept = [(r[0], [math.floor(1024 * float(np.float32(c))) for c in r[1]], r[2]) for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(first[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = collections.defaultdict(list)
            for r in kept:
                members[nearest(cut(r[1], p), book)[1]].append(cut(r[1], p))
            for e, vs in members.items():
                book[e] = tuple(sum(c) // len(vs) for c in zip(*vs))
    out = []
    for i, v, label in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, bytes(e for _, e in best), sum(d for d, _ in best)))
    return out, books


def vectors(kind, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "ties":
        v = rng.integers(-2, 3, (300, 8)) / 1024
    elif kind == "large":
        v = rng.normal(size=(120, 8)) * 3e3
    else:
        v = rng.normal(size=(400, 8)) + rng.integers(0, 4, (400, 1)) * 5
    rows = [(i, [float(x) for x in r], int(i % 3) or None, "x", "y") for i, r in enumerate(v)]
    rows += [rows[5]] * 150 + [(None, rows[7][1], 1, None, None), (5, rows[9][1], 2, None, None)]
    return rows + [(900, None, 1, "", ""), (-1, [None] * 8, 1, "", ""), (-2, [math.nan] * 8, 1, "", ""), (-3, [math.inf] + [0.0] * 7, 1, "", "")]


@pytest.mark.parametrize("kind,entries", [("ties", 16), ("large", 20), ("clusters", 40), ("clusters", 256)])
def test_codes_as_plain_rounds(spark, kind, entries):
    rows = vectors(kind)
    got, books = vector_codes.encode(spark.createDataFrame(rows, VECTORS).repartition(3), 4, entries, 4)
    want, plain = plain_codes(rows, 4, entries, 4)
    assert [[tuple(e) for e in b.tolist()] for b in books] == plain
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(2000, 4)) * 300).astype(np.int64)
    before = (rng.normal(size=(64, 4)) * 300).astype(np.int64)
    book = vector_codes.Part.of(before, 0)
    code, _, near, lower, outer = book.closest(x, 8)
    spared = 0
    for _ in range(3):
        after = before + rng.integers(-6, 7, before.shape)
        book = vector_codes.Part.of(after, 0, before)
        code, own, near, lower, outer, need = book.assign(x, code, near, lower, outer, 8)
        d = vector_codes.distances(x, after)
        assert (code == d.argmin(1)).all() and (own == d.min(1)).all()
        assert (np.diff(lower, axis=1) >= 0).all() and (lower**2 <= np.take_along_axis(d, near, 1)).all()
        np.put_along_axis(d, near, np.iinfo(np.int64).max, 1)
        assert (outer**2 <= d.min(1)).all()
        spared += (need >= 0).sum()
        before = after
    assert spared > 3000
    big = np.array([0, 1, 2, 3, 4, (1 << 52) - 1, 1 << 52, (1 << 56) + 1, (1 << 62) - 1], np.int64)
    assert vector_codes.root(big).tolist() == [math.isqrt(int(v)) for v in big]


def test_codes_of_nothing_and_of_odd_lengths(spark):
    none = spark.createDataFrame([], VECTORS)
    got, books = vector_codes.encode(none)
    assert got.count() == 0 and got.columns == ["vec_id", "label", "code", "error"] and vector_codes.with_total(got, "label", "error", "label_error").count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0, "", "")], VECTORS)
    with pytest.raises(ValueError):
        vector_codes.encode(odd)
    mixed = spark.createDataFrame([(1, [1.0] * 4, 0, "", ""), (2, [1.0] * 8, 0, "", "")], VECTORS)
    assert [r.vec_id for r in vector_codes.encode(mixed)[0].collect()] == [1]


@pytest.mark.parametrize("labels", [100_000, 0])
def test_totals_of_hot_and_rare_labels(spark, monkeypatch, labels):
    monkeypatch.setattr(vector_codes, "LABELS", labels)
    rows = [(i, None if i % 3 == 0 else i, i) for i in range(3000)]
    got = vector_codes.with_total(spark.createDataFrame(rows, "k long, label long, e long"), "label", "e", "total").collect()
    nulls = sum(r[2] for r in rows if r[1] is None)
    assert len(got) == 3000 and all(r.total == (nulls if r.label is None else r.e) for r in got)


# 12
TOKENIZER = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh éß中") for _ in range(rng.randint(1, 9)))
    out = [None, "", " ", "\n\n  x", "a<|endoftext|>b", "é" * 3000, " " * 600_000 + "x", "1234567890" * 700, "it's we'll \U0001f642"]
    out += [" ".join(word() for _ in range(rng.randint(1, 900))) for _ in range(120)]
    return out + ["same words here"] * 90


def test_ids_as_the_files_own_library(texts):
    from tokenizers import Tokenizer

    path = TOKENIZER.path("byte_bpe_50k.json")
    whole, ids = Tokenizer.from_file(path), packing.Ids(path, TOKENIZER.PATTERN)
    for t in texts:
        assert ids.encode(t or "").tolist() == whole.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("length,max_padding", [(1024, 0), (64, 3)])
def test_each_id_in_one_piece(spark, texts, length, max_padding):
    from tokenizers import Tokenizer

    path = TOKENIZER.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = [(i if i % 11 else None, t, "i", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = packing.pack(packing.tokenize(docs, path, TOKENIZER.PATTERN), length, max_padding).collect()
    want = collections.Counter(tuple(whole.encode(t or "", add_special_tokens=False).ids) + (0,) for t in texts)
    by = collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 > 0
        by[r.sequence_id].append(r)
    padding = 0
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        ends = list(itertools.accumulate(r.length for r in pieces))
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= length
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else length - ends[-1]
    assert padding <= max_padding * len(by)
    # pieces of one document follow each other; rows with a null id are told apart by their tokens
    docs_of = collections.defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            docs_of[r.doc_id].append(r)
    for i, pieces in docs_of.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *list(itertools.accumulate(r.length for r in pieces))[:-1]]
        ids = tuple(np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist())
        assert ids in want and {r.doc_tokens for r in pieces} == {len(ids)}
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
    assert collections.Counter(x for r in got for x in np.frombuffer(bytes(r.ids), "<u4").tolist()) == sum((collections.Counter({x: c * n for x, c in collections.Counter(k).items()}) for k, n in want.items()), collections.Counter())


@pytest.mark.parametrize("counts", [{600: 1000}, {600: 1000, 400: 500}, {1: 5}, {1023: 7, 1: 3}, {341: 9000, 683: 10, 2: 40}, {}, {512: 4}, {s: s % 7 + 1 for s in range(1, 1024)}, {7: 10**12, 1017: 10**12}])
def test_layout_places_every_rest_once(counts):
    used = collections.Counter()
    for items, n in packing.patterns(counts, 1024):
        assert sum(s * c for s, c in items.items()) == 1024 and n > 0
        used.update({s: c * n for s, c in items.items()})
    assert all(used[s] <= n for s, n in counts.items())
    layout = packing.Layout.of(counts, 1024)
    assert layout.taken == dict(used)
    if sum(counts.values()) < 20_000:
        held = collections.defaultdict(list)
        for s, n in counts.items():
            for rank in range(n):
                found = layout.place(s, rank)
                assert [a for a, *_ in found] == [0, *itertools.accumulate(b for _, b, *_ in found)][:-1] and sum(b for _, b, *_ in found) == s
                for _, b, sequence, offset in found:
                    held[sequence].append((offset, b))
        for pieces in held.values():
            pieces.sort()
            end = 0
            for offset, b in pieces:
                assert offset == end
                end += b
            assert end & (end - 1) == 0 and end <= 1024


def test_program_reaches_the_best_number_of_sequences():
    # 3 halves of 45 and 55 by pattern: known optimum of a small instance, by trying all
    sizes, demand = np.array([20, 35, 45, 55]), np.array([7.0, 4.0, 6.0, 5.0])
    got = sum(x for _, x in packing.relaxed(sizes, demand, 100, gap=0, rounds=500))
    assert (sizes * demand).sum() / 100 - 1e-9 <= got < math.ceil((sizes * demand).sum() / 100) + 1
    values = np.array([0.21, 0.36, 0.44, 0.56])
    best, _ = packing.cheapest(values, sizes, 100)
    brute = max(sum(v * c for v, c in zip(values, cs)) for cs in itertools.product(range(6), range(3), range(3), range(2)) if sum(s * c for s, c in zip(sizes, cs)) <= 100)
    assert best[100] == pytest.approx(brute)


def test_packing_nothing(spark):
    none = packing.pack(packing.tokenize(spark.createDataFrame([], DOCS), TOKENIZER.path("byte_bpe_50k.json"), TOKENIZER.PATTERN))
    assert none.count() == 0 and none.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


# 13
def test_checksums_in_matrices():
    rng = random.Random(4)
    features = [b"", b"a", "é".encode(), *[bytes(rng.randrange(256) for _ in range(rng.randrange(40))) for _ in range(500)]]
    assert crc_resampling.crc32_of(features).tolist() == [zlib.crc32(f) for f in features]


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (2, 97), (3, 70_000)])
def test_draw_as_plain(spark, n, buckets):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abC9éß-") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " - ", "one", "x " * 20_000, "Z" * 5000] + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(i, t, "i", 7) for i, t in enumerate(texts)] + [(11, texts[11], "", 0)] * 40 + [(None, texts[12], "", 0)]
    target = [t for t in texts[50:70]]
    docs, wanted = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame([(t, "b") for t in target] + [(None, "")], "text string, bucket string")

    def features(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for x in target:
        t.update(features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    want = []
    for i, text, *_ in rows:
        n_words, f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = collections.defaultdict(list)
    for place, r in enumerate(able[: 10 * len(able) // 100], 1):
        ranks[tuple(r[:4])].append(place)
    got = crc_resampling.resample(docs, wanted, n, buckets).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[:4]) for r in got), key=key) == sorted((tuple(r[:4]) for r in want), key=key)
    found = collections.defaultdict(list)
    for r in got:
        if r["rank"] is not None:
            found[tuple(r[:4])].append(r["rank"])
    assert {k: sorted(v) for k, v in found.items()} == dict(ranks) and ranks


def test_draw_of_nothing(spark):
    none, empty = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert crc_resampling.resample(none, empty).count() == 0
    one = crc_resampling.resample(spark.createDataFrame([(1, "a b", "", 0)], DOCS), empty).first()
    assert one.n_features == 2 and one["rank"] is None


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_crc_resampling"])
def test_queries_as_their_sql(spark, sf, name):
    import duckdb

    from attesta.llm import registry

    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    db.execute(registry.ORACLES[name])
    names = [d[0] for d in db.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in db.fetchall()), key=str)
    assert sorted(names) == columns and sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def test_packing_query(spark, sf):
    from attesta.llm import registry

    got = registry.QUERIES["op12_packing"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.select("doc_id").distinct().count() == docs.count()
    by = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert by.filter("n <> t").count() == 0 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("(n & (n - 1)) <> 0").count() == 0
