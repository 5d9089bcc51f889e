"""Vector codes by product quantization, with adaptive bounds that spare distances.

A vector of integers is cut into `parts` equal consecutive parts, each with a codebook of its own.
The codebooks are refined in rounds of assignment and floored means. Each part keeps, from round
to round, its b closest entries with lower bounds of their distances in ascending order, and one outer bound
for all others. After the entries have moved, each bound falls by the movement of its entry (the
outer one by the largest movement), and stays ordered by taking the least of those behind it. The distance to the own entry is worked
out; where the outer bound lies above it, only the kept entries with bounds not above it are
uncertain, and integer distances decide among them; else all entries are compared anew. b
follows what the last round needed: most parts are settled within it, and never more than
an eighth of the entries are kept.

Bounds are whole numbers rounded to the safe side, two bytes each (shifted right where distances are
large); every choice rests on exact integer distances, ties go to the lower index. The state is a
table in the shared folder, written once a round; tasks add up the parts of each entry
before the shuffle, so that a vector that stands in a third of all rows is no hot key. The driver holds
the codebooks alone.

Cases: vectors that are null, or hold null or non-finite components, are dropped. So are those of another
length than the vector of the smallest id; a length that the parts do not divide is an error. Integers are
held within +-2^24. With fewer than `entries` vectors the codebooks are as short. Equal ids are
told apart by their vectors; null ids come last as first entries, and are encoded like others. A null
label is a label. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.tables import made, read, release, written

MOST = 1 << 24
#: Vectors whose distances to all entries are held at a time.
ROWS = 4096
#: Labels whose totals are broadcast; beyond, so are only those of labels with a thousandth of all rows.
LABELS = 100_000


def integers(rows: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", scale=1024) -> DataFrame:
    """id, label, x (array of floor(scale * component)) of the vectors that are whole."""
    v = F.col(vector_col)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))
    return rows.filter(whole).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))


def root(x: np.ndarray) -> np.ndarray:
    """Floor of the square root of whole numbers."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries; in floating point where all sums stay below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


@dataclass
class Part:
    """The codebook of one part position, how far its entries have moved since the last round, and the unit of bounds (a shift)."""

    entries: np.ndarray
    moved: np.ndarray
    shift: int = 0

    @classmethod
    def of(cls, entries: np.ndarray, shift: int, before: np.ndarray | None = None):
        moved = np.zeros(len(entries), np.int64)
        if before is not None:
            step = ((entries - before) ** 2).sum(1)
            moved = root(step)
            moved += moved * moved < step  # up
        return cls(entries, moved, shift)

    def closest(self, x: np.ndarray, keep: int):
        """All distances: code, squared distance, the `keep` closest entries, their bounds, the outer bound."""
        d = distances(x, self.entries)
        keep = min(keep, d.shape[1])
        code = d.argmin(1)  # the first of equals
        own = d[np.arange(len(d)), code]
        if keep < d.shape[1]:
            at = np.argpartition(d, keep, axis=1)
            outer = d[np.arange(len(d)), at[:, keep]]
            at = at[:, :keep]
        else:
            at, outer = np.tile(np.arange(keep), (len(d), 1)), np.full(len(d), np.iinfo(np.int64).max // 4)
        near = np.take_along_axis(d, at, 1)
        order = np.argsort(near, axis=1, kind="stable")
        return code, own, np.take_along_axis(at, order, 1), root(np.take_along_axis(near, order, 1)), root(outer)

    def assign(self, x: np.ndarray, code: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray, keep: int):
        """As closest(), from a round's codes, kept entries, bounds and outer bounds; and how many entries each row needed (-1: all)."""
        own = ((x - self.entries[code]) ** 2).sum(1)
        lower = np.maximum(0, lower - self.moved[near])
        outer = np.maximum(0, outer - self.moved.max(initial=0))
        lower = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], 1)[:, ::-1], axis=1)[:, ::-1]
        lower, outer = lower[:, :-1], lower[:, -1]
        need = (lower * lower <= own[:, None]).sum(1)  # bounds ascend
        need[outer * outer <= own] = -1
        if near.shape[1] < keep:
            need[:] = -1
        some = np.flatnonzero(need > 0)
        if len(some):
            width = int(need[some].max())
            row, rank = np.nonzero(np.arange(width) < need[some][:, None])
            entry = near[some[row], rank]
            d = ((x[some[row]] - self.entries[entry]) ** 2).sum(1)
            lower[some[row], rank] = root(d)
            # least distance, then least index
            order = np.lexsort((entry, d, row))
            first = order[np.searchsorted(row[order], np.arange(len(some)))]
            better = (d[first] < own[some]) | ((d[first] == own[some]) & (entry[first] < code[some]))
            code, own = code.copy(), own.copy()
            code[some[better]], own[some[better]] = entry[first[better]], d[first[better]]
            order = np.argsort(lower[some], axis=1, kind="stable")
            near, lower[some] = near.copy(), np.take_along_axis(lower[some], order, 1)
            near[some] = np.take_along_axis(near[some], order, 1)
        # fewer entries kept than before: the first one left out bounds the rest
        if near.shape[1] > keep:
            outer = np.minimum(outer, lower[:, keep])
            near, lower = near[:, :keep], lower[:, :keep]
        every = np.flatnonzero(need < 0)
        if len(every):
            code, own, near, lower, outer = (np.array(a) for a in (code, own, near[:, :keep], lower[:, :keep], outer))
            wide = [np.zeros((len(x), keep), np.int64) for _ in range(2)]
            wide[0][:, : near.shape[1]], wide[1][:, : near.shape[1]] = near, lower
            near, lower = wide
            code[every], own[every], near[every], lower[every], outer[every] = self.closest(x[every], keep)
        return code, own, near, lower, outer, need


STATE = "id {id}, label {label}, x array<int>, code binary, near binary, lower binary, outer binary, need binary, error long"


def step(state: DataFrame, books: list[Part], kept: int | None, keep: int) -> DataFrame:
    """The state after one assignment. kept: how many entries it holds from the last one (None: none, x alone); keep: how many are kept now (0: none)."""
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    n, width = len(books), books[0].entries.shape[1]
    schema = STATE.format(**kinds)
    keep_ = min(keep, len(books[0].entries)) if keep else 0

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield one(batch.slice(at, ROWS))

    def one(batch):
        rows = batch.num_rows
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, n, width)
        held = None
        if kept is not None:
            cols = [np.frombuffer(b"".join(v.as_buffer() for v in batch.column(i)), t).astype(np.int64) for i, t in ((3, "u1"), (4, "u1"), (5, "<u2"), (6, "<u2"))]
            held = cols[0].reshape(rows, n), cols[1].reshape(rows, n, kept), cols[2].reshape(rows, n, kept), cols[3].reshape(rows, n)
        code, outer = np.zeros((rows, n), np.uint8), np.zeros((rows, n), "<u2")
        near, lower = np.zeros((rows, n, keep_), np.uint8), np.zeros((rows, n, keep_), "<u2")
        need, error = np.zeros((rows, n), np.uint8), np.zeros(rows, np.int64)
        for p, book in enumerate(books):
            if held is None:
                got = (*book.closest(x[:, p], max(1, keep_)), np.full(rows, -1))
            else:
                got = book.assign(x[:, p], held[0][:, p], held[1][:, p], held[2][:, p] << book.shift, held[3][:, p] << book.shift, max(1, keep_))
            code[:, p], need[:, p] = got[0], np.where(got[5] < 0, 255, got[5])
            error += got[1]
            if keep_:
                near[:, p] = got[2]
                # bounds only fall by rounding down and by the largest number
                lower[:, p], outer[:, p] = np.minimum(got[3] >> book.shift, 65535), np.minimum(got[4] >> book.shift, 65535)
        packed = [pa.array([a[i].tobytes() for i in range(rows)], pa.binary()) for a in (code, near, lower, outer, need)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *packed, pa.array(error)], schema_names)

    schema_names = ["id", "label", "x", "code", "near", "lower", "outer", "need", "error"]
    cols = ["id", "label", "x", "code", "near", "lower", "outer"] if kept is not None else ["id", "label", "x"]
    return state.select(*cols).mapInArrow(run, schema)


def means(state: DataFrame, parts: int, width: int, entries: int) -> tuple[dict, dict]:
    """Sums and counts by (part, entry), and how many rows needed how many entries: one row a task and place, then their sums."""

    def run(batches):
        sums, counts, needs = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros(256, np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, width)
            code = np.frombuffer(b"".join(v.as_buffer() for v in batch.column(1)), np.uint8).reshape(-1, parts)
            needs += np.bincount(np.frombuffer(b"".join(v.as_buffer() for v in batch.column(2)), np.uint8), minlength=256)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        used = np.argwhere(counts)
        cells = [(p, e, k, int(sums[p, e, k]), int(counts[p, e])) for p, e in used for k in range(width)] + [(-1, int(v), 0, 0, int(needs[v])) for v in np.flatnonzero(needs)]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "place", "total", "n"), c)) for c in cells], schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())]))

    cells = state.select("x", "code", "need").mapInArrow(run, "part int, entry int, place int, total long, n long")
    # at most one row for each component of the codebooks, and 256
    got = cells.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    return {(r["part"], r["entry"], r["place"]): (r["total"], r["n"]) for r in got if r["part"] >= 0}, {r["entry"]: r["n"] for r in got if r["part"] < 0}


def adapted(needs: dict[int, int], keep: int, entries: int) -> int:
    """How many entries to keep next: what 98 of 100 of the parts needed that the kept ones settled, one more each round that too few were settled."""
    most, settled, every = max(2, entries // 8), sum(n for k, n in needs.items() if k != 255), sum(needs.values())
    if settled < 0.9 * every:
        return min(most, keep + max(1, keep // 2))
    seen = 0
    for k in sorted(needs):
        seen += needs[k]
        if k == 255 or seen >= 0.98 * settled:
            return max(2, min(most, k if k != 255 else most))
    return keep


def encode(rows: DataFrame, parts=4, entries=256, rounds=4, id_col="vec_id", vector_col="embedding", label_col="label") -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, code (a byte for each part), error; and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("codes are bytes: at most 256 entries")
    spark, whole = rows.sparkSession, integers(rows, id_col, vector_col, label_col)
    # `entries` rows
    first = whole.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
    length = len(first[0]["x"]) if first else 0
    if length % parts or (first and not length):
        raise ValueError(f"{parts} parts do not divide vectors of length {length}")
    whole = whole.filter(F.size("x") == length)
    start = np.array([r["x"] for r in first if len(r["x"]) == length], np.int64).reshape(-1, parts, max(1, length // parts))
    # twice the longest first entry fits into two bytes; longer distances are held as the largest number
    shift = int(2 * np.abs(start).max(initial=0) * np.sqrt(start.shape[2])).bit_length() - 16
    books = [Part.of(start[:, p], max(0, shift)) for p in range(parts)]
    if not len(start):
        none = whole.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return none.toDF(id_col, label_col, "code", "error"), [b.entries for b in books]
    keep, kept, state, old = max(2, len(start) // 16), None, whole, []
    for _ in range(rounds):
        at = len(made(spark))
        state = written(step(state, books, kept, keep), "codes")
        release(spark, old, state)
        old = made(spark, at)
        kept = min(keep, len(start))
        got, needs = means(state, parts, start.shape[2], len(start))
        for p, b in enumerate(books):
            new = b.entries.copy()
            for e in range(len(new)):
                for k in range(new.shape[1]):
                    if (p, e, k) in got:
                        total, n = got[p, e, k]
                        new[e, k] = total // n
            books[p] = Part.of(new, b.shift, b.entries)
        keep = adapted(needs, kept, len(start))
    out = written(step(state, books, kept, 0).select("id", "label", "code", "error"), "codes")
    release(spark, old, out)
    return out.toDF(id_col, label_col, "code", "error"), [b.entries for b in books]


def with_total(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows (a table) with the sum of `value` over equal keys, nulls together. Totals of few keys, or of the keys with many rows, are broadcast; the others are joined by key."""
    totals = rows.groupBy(F.col(key).alias("of")).agg(F.sum(value).alias(name), F.count("*").alias("n"))
    size = totals.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    same, few = F.col(key).eqNullSafe(F.col("of")), totals.select("of", name)
    if size["keys"] <= LABELS:
        return rows.join(F.broadcast(few), same).select(*rows.columns, name)
    # at most a thousand keys have a thousandth of all rows
    hot = F.broadcast(totals.filter(F.col("n") * 1000 >= size["rows"]).select("of", name))
    cold = rows.join(hot.select("of"), same, "left_anti").join(few.hint("shuffle_hash"), same).select(*rows.columns, name)
    return rows.join(hot, same).select(*rows.columns, name).unionByName(cold)


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, with commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def query(spark, sf_dir):
    codes, books = encode(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = with_total(codes, "label", "error", "label_error")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _oracle(parts=4, entries=256, rounds=4) -> str:
    """Plain rounds: all parts against all entries."""
    steps = [
        "whole AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"cut AS (SELECT vec_id, label, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS v FROM whole, range({parts}) r(p))",
        f"book_0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM cut QUALIFY e < {entries})",
    ]
    for i in range(rounds + 1):
        far = "list_sum(list_transform(range(1, len(v) + 1), lambda k: (v[k] - c[k]) * (v[k] - c[k])))"
        steps.append(f"code_{i} AS MATERIALIZED (SELECT vec_id, label, p, any_value(v) AS v, min(({far}::BIGINT, e)) AS best FROM cut JOIN book_{i} USING (p) GROUP BY vec_id, label, p)")
        if i < rounds:
            steps.append(f"mean_{i} AS (SELECT p, e, list(m ORDER BY k) AS c FROM (SELECT p, best[2] AS e, k, floor(sum(v[k])::DOUBLE / count(*))::BIGINT AS m FROM code_{i}, range(1, len(v) + 1) r(k) GROUP BY ALL) GROUP BY p, e)")
            steps.append(f"book_{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book_{i} b LEFT JOIN mean_{i} m USING (p, e))")
    steps.append(f"done AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM code_{rounds} GROUP BY vec_id)")
    sha = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book_{rounds})"
    return "WITH " + ", ".join(steps) + f" SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {sha} AS codebooks_sha256 FROM done"


ORACLE = _oracle()
