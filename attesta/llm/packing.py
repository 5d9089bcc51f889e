"""Packing of token sequences by column generation for the cutting-stock problem.

A document's tokens are cut into whole sequences of `length` and a rest. The rests are the items of
a cutting-stock problem: the number of rests of each length, a histogram of fewer than `length`
numbers, is all that the driver sees. A linear program over patterns (how many rests of which
lengths make one sequence) is solved by the simplex method; a knapsack by dynamic programming
prices new columns. It starts from patterns filled greedily by subset sums. The solution is rounded
down, patterns of large fractions are taken once more, and what is left is filled up by subset sums. A pattern counts only if it
needs at most `max_padding` tokens of padding.

Documents with equal rests are ranked, and the n-th of them takes the n-th place that the patterns
have for its length. A rank is a number within the part of the table that a task wrote, plus the
counts of the parts before; so no task orders all documents of one length. Rests for which no
pattern has a place are laid end to end, by length and rank, and cut every `length` tokens; the end
of that stream is cut into sequences of powers of two, which need no padding.

Cases: a null or empty text has the end token alone. Null, equal or repeated ids are kept, each row
is packed by itself. Texts of any length are cut. An empty table gives no pieces. The columns that
the functions add come after the caller's id, whatever its name is; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.bpe import slices
from attesta.llm.tables import read, written

#: Texts of more characters go to the tokenizer file's own library, whose pattern matcher has no limit on runs.
LONG = 500_000
#: Sequences that hold a whole run of one document are numbered from here on, by part.
PART = 1 << 40


class Ids:
    """Ids of texts as a byte-level tokenizer file gives them, without special tokens around them.

    The file's merges are its ranks, so a rank encoder gives the same ids for a third of the time; texts
    that hold an added token's string, and very long ones, are encoded by the file's own library.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # the printed form of bytes: printable ones stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(map(back.__getitem__, token)): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token not in self.added}
        self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


def tokenize(docs: DataFrame, path: str, pattern: str, end: int | None = 0, id_col="doc_id", text_col="text") -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit) of every text, with the id `end` after it."""
    docs = docs.select(id_col, text_col)
    tail = np.array([] if end is None else [end], np.uint32)

    def run(batches):
        ids = Ids(path, pattern)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                found = [np.concatenate([ids.encode(t), tail]).astype("<u4").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(found, pa.binary())], [id_col, "ids"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary")


def counted(tokens: DataFrame, length: int) -> DataFrame:
    """(id, ids) with n (tokens), rest (n modulo length), part (the task), nth (rank among the part's equal rests) and whole (whole sequences before it in the part)."""
    names, kind = tokens.columns, tokens.schema[tokens.columns[0]].dataType.simpleString()

    def run(batches):
        part, seen, before = TaskContext.get().partitionId(), np.zeros(length, np.int64), 0
        for batch in batches:
            n = np.fromiter((len(x.as_buffer()) // 4 for x in batch.column(1)), np.int64, batch.num_rows)
            rest, whole = n % length, n // length
            order = np.argsort(rest, kind="stable")
            ordered = rest[order]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(n), np.int64)
            nth[order] = seen[ordered] + np.arange(len(n)) - first
            seen += np.bincount(rest, minlength=length)
            ends = before + np.cumsum(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(rest), pa.array(np.full(len(n), part, np.int64)), pa.array(nth), pa.array(ends - whole)], [*names, "n", "rest", "part", "nth", "whole"])
            before = int(ends[-1]) if len(n) else before

    return tokens.mapInArrow(run, f"`{names[0]}` {kind}, `{names[1]}` binary, n long, rest long, part long, nth long, whole long")


# The cutting-stock problem, over the histogram
def cheapest(values: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for each capacity 0..length, and the item taken last there (-1: none). sizes ascend."""
    best, last = np.zeros(length + 1), np.full(length + 1, -1, np.int64)
    upto = np.searchsorted(sizes, np.arange(length + 1), side="right")
    for c in range(1, length + 1):
        best[c] = best[c - 1]
        if upto[c]:
            got = best[c - sizes[: upto[c]]] + values[: upto[c]]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], last[c] = got[j], j
    return best, last


def _pattern(c: int, last: np.ndarray, sizes: np.ndarray, found: dict[int, int]) -> dict[int, int]:
    """Items taken from capacity c on, added to `found`."""
    while c > 0:
        j = int(last[c])
        if j < 0:
            c -= 1
        else:
            found[j] = found.get(j, 0) + 1
            c -= int(sizes[j])
    return found


def first_basis(sizes: np.ndarray, demand: np.ndarray, length: int) -> tuple[list[dict[int, int]], np.ndarray, np.ndarray]:
    """A pattern for each size, how often it is used, and the inverse of the patterns' matrix.

    A pattern is the largest size left, filled up as far as it goes with large ones, until one of its
    sizes is used up. That size stands in no later pattern, so the matrix is triangular. (Solved here by
    substitution: threads of a numeric library may hang in a driver that has started other processes.)
    """
    left, basis, times, gone = {int(s): float(n) for s, n in zip(sizes, demand)}, [], [], []
    where = {int(s): j for j, s in enumerate(sizes)}
    while left:
        top = max(left)
        room, have = length - top, {s: int(np.ceil(n)) for s, n in left.items()}
        have[top] -= 1
        found = fill(room, have)
        found[top] = found.get(top, 0) + 1
        n, out = min((left[s] / c, s) for s, c in found.items())
        for s, c in found.items():
            left[s] = max(0.0, left[s] - n * c)
        del left[out]
        basis.append({where[s]: c for s, c in found.items()})
        times.append(n)
        gone.append(where[out])
    with_size: list[list[tuple[int, int]]] = [[] for _ in basis]
    for i, items in enumerate(basis):
        for j, c in items.items():
            with_size[j].append((i, c))
    inverse = np.zeros((len(basis), len(basis)))
    for i, j in enumerate(gone):
        row = np.zeros(len(basis))
        row[j] = 1
        for k, c in with_size[j]:
            if k < i:
                row -= c * inverse[k]
        inverse[i] = row / basis[i][j]
    return basis, np.array(times), inverse


def relaxed(sizes: np.ndarray, demand: np.ndarray, length: int, gap=1e-4, rounds=200, columns=64) -> list[tuple[dict[int, int], float]]:
    """Patterns (item: copies) and how often the linear program uses each; few sequences that hold the demand exactly.

    A round prices every item's best pattern by one knapsack and takes the best `columns` of them,
    each if it still improves when its turn comes. Ends within `gap`, or less than one sequence, of a
    lower bound (the tokens, or the duals divided by the best pattern's value), or after `rounds`:
    every basis on the way is a solution.
    """
    basis, x, inverse = first_basis(sizes, demand, length)
    least = float((sizes * demand).sum()) / length
    for _ in range(rounds):
        y = inverse.sum(axis=0)
        positive = np.flatnonzero(y > 1e-9)
        best, last = cheapest(y[positive], sizes[positive], length)
        bound = max(least, float((y * demand).sum()) / max(1.0, best[length]))
        if best[length] <= 1 + 1e-7 or x.sum() < max((1 + gap) * bound, bound + 1 - 1e-6):
            break
        worth = y[positive] + best[length - sizes[positive]]
        for k in np.argsort(-worth)[:columns]:
            items = _pattern(int(length - sizes[positive[k]]), last, sizes[positive], {int(k): 1})
            items = {int(positive[j]): c for j, c in items.items()}
            at, copies = np.array(list(items)), np.array(list(items.values()), float)
            cost = 1 - float((y[at] * copies).sum())
            u = (inverse[:, at] * copies).sum(axis=1)
            usable = np.flatnonzero(u > 1e-7)
            if cost > -1e-7 or not len(usable):
                continue
            ratio = x[usable] / u[usable]
            r, step = int(usable[ratio.argmin()]), max(0.0, float(ratio.min()))
            row = inverse[r] / u[r]
            x -= step * u
            u[r] -= 1  # the pivot row becomes row itself
            inverse -= np.outer(u, row)
            x[r] = step
            y, basis[r] = y + cost * row, items
    return list(zip(basis, np.maximum(x, 0)))


def fill(room: int, left: dict[int, int]) -> dict[int, int]:
    """Some of the items (size: how many there are) that fill `room` as far as they can, with large ones first."""
    steps, reach = [], 1
    for size in sorted((s for s, n in left.items() if n > 0 and s <= room), reverse=True):
        for _ in range(min(left[size], room // size)):
            more = reach | (reach << size & (1 << room + 1) - 1)
            if more == reach:
                break
            steps.append((size, reach))
            reach = more
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for size, before in reversed(steps):
        if not before >> at & 1:
            found[size] = found.get(size, 0) + 1
            at -= size
    return found


def patterns(counts: dict[int, int], length: int, max_padding=0) -> list[tuple[dict[int, int], int]]:
    """Patterns (rest: copies) with how often each is used, an integer; they take at most the counts."""
    left = {s: n for s, n in counts.items() if n and s}
    sizes = np.array(sorted(left), np.int64)
    out: dict[tuple, int] = {}

    def use(items: dict[int, int], times: int):
        times = min([times, *(left[s] // c for s, c in items.items())])
        if times > 0:
            key = tuple(sorted(items.items(), reverse=True))
            out[key] = out.get(key, 0) + times
            for s, c in items.items():
                left[s] -= c * times

    if len(sizes):
        demand = np.array([left[int(s)] for s in sizes], float)
        solved = [({int(sizes[j]): c for j, c in items.items()}, x) for items, x in relaxed(sizes, demand, length)]
        solved = [(items, x) for items, x in solved if x > 1e-9 and length - sum(s * c for s, c in items.items()) <= max_padding]
        for items, x in solved:
            use(items, int(x + 1e-6))
        for items, x in sorted(solved, key=lambda p: -(p[1] - int(p[1] + 1e-6))):
            use(items, 1)
        for s in sorted(left, reverse=True):
            while left[s]:
                left[s] -= 1
                found = fill(length - s, left)
                left[s] += 1
                if length - s - sum(size * c for size, c in found.items()) > max_padding:
                    break
                found[s] = found.get(s, 0) + 1
                use(found, left[s])
    return [(dict(key), n) for key, n in out.items()]


@dataclass
class Layout:
    """Where the n-th rest of each length goes."""

    length: int
    #: by rest: starts of the rank ranges, and (copies, first sequence, offset) of each
    ranges: dict[int, tuple[np.ndarray, list[tuple[int, int, int]]]] = field(default_factory=dict)
    #: by rest: rests that patterns take, and the place in the stream of the first one after them
    taken: dict[int, int] = field(default_factory=dict)
    stream: dict[int, int] = field(default_factory=dict)
    first_of_stream: int = 0
    #: starts of the sequences at the end of the stream, and its end
    ends: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, counts: dict[int, int], length: int, max_padding=0) -> Layout:
        out, places, sequence = cls(length), {}, 0
        for items, times in patterns(counts, length, max_padding):
            offset = 0
            for size, copies in sorted(items.items(), reverse=True):
                lo = out.taken.get(size, 0)
                places.setdefault(size, []).append((lo, copies, sequence, offset))
                out.taken[size] = lo + copies * times
                offset += copies * size
            sequence += times
        out.ranges = {s: (np.array([p[0] for p in found]), [p[1:] for p in found]) for s, found in places.items()}
        out.first_of_stream, at = sequence, 0
        for size in sorted(counts):
            if size:
                out.stream[size] = at
                at += size * (counts[size] - out.taken.get(size, 0))
        out.ends = [at - at % length]
        for bit in reversed(range(length.bit_length())):
            if at % length >> bit & 1:
                out.ends.append(out.ends[-1] + (1 << bit))
        return out

    def place(self, size: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start within the rest, length, sequence, offset) of the rank-th rest of this size."""
        if rank < self.taken.get(size, 0):
            starts, found = self.ranges[size]
            i = int(np.searchsorted(starts, rank, side="right")) - 1
            copies, sequence, offset = found[i]
            n = rank - int(starts[i])
            return [(0, size, sequence + n // copies, offset + n % copies * size)]
        at = begin = self.stream[size] + (rank - self.taken.get(size, 0)) * size
        out, tail = [], self.ends[0]
        while at < begin + size:
            if at < tail:
                sequence, start, stop = at // self.length, at - at % self.length, at - at % self.length + self.length
            else:
                i = int(np.searchsorted(self.ends, at, side="right")) - 1
                sequence, start, stop = tail // self.length + i, self.ends[i], self.ends[i + 1]
            stop = min(stop, begin + size)
            out.append((at - begin, stop - at, self.first_of_stream + sequence, at - start))
            at = stop
        return out


def pack(tokens: DataFrame, length=1024, max_padding=0) -> DataFrame:
    """Pieces of (id, ids): id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    length: a power of two. Every id stands in one piece; a sequence's pieces have offsets without gaps from 0.
    """
    if length < 2 or length & (length - 1):
        raise ValueError("length must be a power of two")
    tokens = tokens.select(*tokens.columns[:2])
    id_col, kind = tokens.columns[0], tokens.schema[tokens.columns[0]].dataType.simpleString()
    inner = written(counted(tokens.toDF("id", "ids"), length), "tokens")
    counts = written(inner.groupBy("part", "rest").agg(F.count("*").alias("rows")), "rests")
    # fewer than `length` rows, whatever the table's size
    layout = Layout.of({r["rest"]: r["rows"] for r in counts.groupBy("rest").agg(F.sum("rows").alias("rows")).collect()}, length, max_padding)
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(counts.select("part", "rest", before.alias("base")), "bases")
    placed = inner.join(bases, ["part", "rest"]).select("id", "ids", "n", "rest", (F.col("base") + F.col("nth")).alias("rank"), "part", "whole")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield _pieces(batch.slice(at, 256), layout, length)

    out = placed.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def _pieces(batch: pa.RecordBatch, layout: Layout, length: int) -> pa.RecordBatch:
    rows, cut = [], []
    n, rest, rank, part, whole = (batch.column(i).to_pylist() for i in range(2, 7))
    for i in range(batch.num_rows):
        ids = batch.column(1)[i].as_buffer()
        full = n[i] - rest[i]
        found = [(k * length, length, PART * (part[i] + 1) + whole[i] + k, 0) for k in range(full // length)]
        if rest[i]:
            found += [(full + a, b, sequence, offset) for a, b, sequence, offset in layout.place(rest[i], rank[i])]
        rows += [(i, a, b, n[i], sequence, offset) for a, b, sequence, offset in found]
        cut += [ids.slice(4 * a, 4 * b).to_pybytes() for a, b, _, _ in found]
    at, start, size, tokens, sequence, offset = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 6))
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), start, size, pa.array(cut, pa.binary()), tokens, sequence, offset], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def query(spark, sf_dir):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack(tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
