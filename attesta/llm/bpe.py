"""Byte-level BPE encoding and decoding in numpy matrices.

A text is cut by a pattern; every piece is merged by itself. Distinct pieces of a batch go into
matrices of padded rows, bucketed by length; in each round every row merges its leftmost pair of
minimum rank, found by a hashed pair lookup, and the row is compacted. Pieces longer than `WIDE`
bytes are matrices of one row, in which a round merges all pairs of the minimum rank from left to
right, as the next rounds would do one by one; if one of them makes a pair of a lower rank, the
round merges the leftmost pair alone. So a long run without blanks takes as many rounds as it has
different merges.

A task builds its tables from the ranks, keeps the ids of a bounded number of pieces, and lets go
of both when it ends.

Cases: a null or empty text has no tokens, and decodes to no bytes. Texts are taken whole.
Repeated rows give equal results; null ids are kept; an empty table gives an empty result. Other
columns are left alone, whatever their names are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.tables import read

WIDE = 512
#: Characters of text to a slice of a batch, and distinct pieces that a task keeps in either generation.
SLICE, KEPT = 1 << 20, 60_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left, right) -> rank of the pair's bytes, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 0
        left, vals, at = np.array(keys, np.int64), np.array(values, np.int32), None
        at = self._slot(left)
        while len(left):
            self.probes += 1
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[at[took]], self.values[at[took]] = left[took], vals[took]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, vals, at = left[rest], vals[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left, right):
        keys = left.astype(np.int64) << 32 | right
        shape, keys = keys.shape, keys.ravel()
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out.reshape(shape)


class Kept(dict):
    """Ids by piece in two generations: what is used moves to the young one, the old one goes as a whole."""

    def __init__(self, old: dict | None = None):
        super().__init__()
        self.old = old or {}

    def __missing__(self, piece):
        found = self[piece] = self.old[piece]
        return found


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs, self.pattern = ranks, PairTable(ranks), regex.compile(pattern)
        self.bytes_to_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        top = max(ranks.values()) + 1
        self.tokens = [b""] * top
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ids = Kept()

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece: every row merges its leftmost minimum-rank pair in each round."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            if width > WIDE:
                for i in order[at:]:
                    out[i] = self._wide_row(pieces[i])
                break
            width = width if width <= 16 else 1 << (width - 1).bit_length()
            to = int(np.searchsorted(lengths[order], width, side="right"))
            to = min(to, at + max(256, (1 << 21) // width))
            rows = order[at:to]
            for i, ids in zip(rows, self._matrix([pieces[i] for i in rows], int(lengths[rows[-1]])), strict=True):
                out[i] = ids
            at = to
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = self.bytes_to_id[raw]
        n = np.array([len(p) for p in pieces], np.int64)
        ranks = np.full((len(pieces), width), NONE, np.int32)
        if width > 1:
            ranks[:, : width - 1] = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
            ranks[np.arange(width)[None, :] >= (n - 1)[:, None]] = NONE
        done_ids: list[np.ndarray | None] = [None] * len(pieces)
        who = np.arange(len(pieces))
        while len(who):
            spot = ranks.argmin(axis=1)
            best = ranks[np.arange(len(who)), spot]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done_ids[who[k]] = ids[k, : n[k]].copy()
                on = ~over
                who, ids, ranks, n, spot, best = who[on], ids[on], ranks[on], n[on], spot[on], best[on]
                if not len(who):
                    break
            width = ids.shape[1]
            # compaction: what stands right of the merged pair moves one place to the left
            column = np.arange(width - 1)[None, :]
            right = column > spot[:, None]
            ids = np.where(right, ids[:, 1:], ids[:, :-1])
            ranks = np.where(column >= spot[:, None] + 1, ranks[:, 1:], ranks[:, :-1])
            k = np.arange(len(who))
            ids[k, spot], n = best, n - 1
            if width - 1 == 1:
                ranks[:, 0] = NONE
                continue
            # the merged token meets new neighbours on both sides
            has = spot + 1 < n
            ranks[k, spot] = NONE
            ranks[k[has], spot[has]] = self.pairs.ranks(ids[k[has], spot[has]], ids[k[has], spot[has] + 1])
            has = spot > 0
            ranks[k[has], spot[has] - 1] = self.pairs.ranks(ids[k[has], spot[has] - 1], ids[k[has], spot[has]])
            most = int(n.max())
            ids, ranks = ids[:, :most], ranks[:, :most]
        return done_ids

    def _wide_row(self, piece: bytes) -> np.ndarray:
        """As _matrix, for one long row: all pairs of the minimum rank in a round."""
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # of pairs that overlap (a run of one token), every other one from the left
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1]))
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            new = self._merged(ids, ranks, at, best)
            if new[2].min(initial=NONE) < best and len(at) > 1:
                new = self._merged(ids, ranks, at[:1], best)
            ids, ranks = new[:2]
        return ids

    def _merged(self, ids, ranks, at, best):
        """ids and ranks after merging the pairs at `at`, and the ranks of the pairs that this makes."""
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        ids = ids.copy()
        ids[at] = best
        ids, place = ids[stay], np.cumsum(stay)[at] - 1
        # a pair lies where its left token does; the pairs around a merged token are new
        ranks = np.append(ranks, NONE)[stay][:-1]
        touched = np.union1d(place[place > 0] - 1, place[place < len(ids) - 1])
        ranks[touched] = self.pairs.ranks(ids[touched], ids[touched + 1])
        return ids, ranks, ranks[touched]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.ids) > KEPT:
            self.ids = Kept(dict(self.ids))
        known, old = self.ids, self.ids.old
        new = [p for p in set().union(*cut) if p not in known and p not in old]
        for p, ids in zip(new, self.merge_rows([p.encode() for p in new]), strict=True):
            known[p] = ids.astype("<u4").tobytes()
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about `size` characters, nulls as empty; a batch may hold very long texts."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        held.append(t)
        n += len(t)
        if n >= size:
            yield at, held
            at, held, n = i + 1, [], 0
    if held:
        yield at, held


def encode(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit numbers) of every row."""
    docs = docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = Codec(load_ranks(path), pattern)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(c.encode(texts), pa.binary())], [id_col, "ids"])

    return docs.mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, id_col="doc_id") -> DataFrame:
    """id, ids, decoded (binary) of rows of (id, ids)."""
    encoded = encoded.select(id_col, "ids")
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = Codec(load_ranks(path), pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.decode(x.as_buffer()) for x in part.column(1)], pa.binary())], [id_col, "ids", "decoded"])

    return encoded.mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """id, ids, decoded (both binary) of every row: encode() and decode() in one pass of a task, with one set of tables."""
    docs = docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = Codec(load_ranks(path), pattern)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids = c.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())], [id_col, "ids", "decoded"])

    return docs.mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip."""
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = round_trip(docs, path, pattern)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir):
    return digests(read(spark, sf_dir, "documents"))
