"""Jaccard join of documents' n-grams by PartEnum signatures, and the components of its links.

Sets of distinct shingles fall into bands of nearly equal size, [l, l / threshold]; linked sets lie
in one band or in neighbours, so a set takes part in the instance of its band (with the band below)
and in the next one. In an instance linked sets differ in at most k elements. The domain is cut
into n1 first-level parts of n2 second-level parts each; in one first-level part two linked sets
differ by at most k2 elements, so they agree on some n2 - k2 of its parts. All subsets of so many
parts are enumerated; a signature is the content of one of them. From k = 4 on subsets are two of
three parts; in smaller bands two of k + 2.

Sets that share a signature are not paired with each other. Each is compared with the pivot of the
signature, the set that shares the most signatures. Of two linked sets x and y under a pivot p,
either both are linked with p, and nothing is lost, or one is not; then their differences from p
overlap, as |x ^ y| = |x ^ p| + |y ^ p| - 2 |(x ^ p) & (y ^ p)|, so that in any order of elements
the first ones of both differences (their prefixes) have a common one. Sets that share a prefix
element under a pivot are a group again and have a second pivot among them. What is left are sets
of different components, as far as links are known: they meet where they are together in as many
groups as a link needs, at places that let them overlap enough. So a group of near copies costs as many comparisons as it has
members, whether it is linked with its first pivot or not, and no link is lost.

A set may have many pivots. It first meets the highest of them alone; signatures whose sets these
links have joined into one component have nothing more to say, and the others go on as above.

Before two sets are compared by their elements, they meet by counts of elements in 256 buckets,
whose sum of differences is never above the sets' own difference: what this bound leaves out has
no link. A pair beyond it is compared only if a third set shares the signature. In the groups by
first elements of differences the parities of these counts, 256 bits, are a bound of the same kind,
cheap enough to be looked at before a pair is a row.

Equal sets are one node from the start. Components come from alternating large-star and small-star
rounds over written tables. Elements, sets and signatures are 64-bit hashes.

Texts are cut into words three times (sets, signatures, elements of the sets that are compared):
that is cheaper than to keep a hundred signatures or some hundred elements for every document.

Cases: null, empty and blank texts have no shingles and link with nothing. With fewer words than
the width the whole sequence is one shingle. Null ids come after all others; a component of null
ids alone has a null component_id. Any 64-bit id is a valid id. Repeated rows are equal sets. An
empty table gives an empty result. Columns other than id and text are left alone, whatever their
names are.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.tables import fresh, made, numbered, read, release, written
from attesta.llm.words import Hashes, lower_words, mix, shingles, word_hashes

#: Buckets of a set's counts, and distinct sets that a task remembers to cut signatures once.
SKETCH, SEEN = 256, 100_000
#: Elements that the prefixes of linked sets have in common, where the link needs as many.
COMMON = 8


@dataclass(frozen=True)
class Parts:
    """The parts of an instance: n1 first-level parts of n2 each, subsets of n2 - k2 of them, and how many signatures a set keeps."""

    k: int
    n1: int
    n2: int
    k2: int
    subsets: np.ndarray
    kept: int


class Bands:
    """Bands of sizes, and the parts of each instance, for links of percent * union <= 100 * intersection."""

    def __init__(self, percent: int):
        self.percent, self.ends, self.known = percent, [0], {}

    def band(self, size: int) -> int:
        while self.ends[-1] < size:
            low = self.ends[-1] + 1
            self.ends.append(low * 100 // self.percent)
        return int(np.searchsorted(self.ends, size))

    def parts(self, instance: int) -> Parts:
        """Of the instance that joins a band with the one below it, and that one with itself.

        Of k differences, spread evenly, the fewest signatures stay equal (their number is convex in
        the differences of a part). One less than these need not be kept.
        """
        if instance not in self.known:
            while len(self.ends) <= instance:
                self.band(self.ends[-1] + 1)
            k = int((self.ends[instance - 1] + self.ends[instance]) * Fraction(100 - self.percent, 100 + self.percent))
            k2 = 1 if k >= 4 else k
            n2 = k2 + 2 if k else 1
            n1 = k // (k2 + 1) + 1 + (k + 1) // 24
            each, more = divmod(k, n1)
            equal = (n1 - more) * comb(n2 - each, n2 - k2) + more * (comb(n2 - each - 1, n2 - k2) if each < k2 else 0)
            subsets = np.array(list(combinations(range(n2), n2 - k2)))
            self.known[instance] = Parts(k, n1, n2, k2, subsets, n1 * len(subsets) - equal + 1)
        return self.known[instance]


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set in both of its instances: the fullest subsets of parts in each.

    Two linked sets agree on so many signatures at least that each can leave out its least ones, in
    an order that their content alone gives: the greatest of those on which they agree is then left
    out by neither.
    """
    out = []
    of_part, content = mix(elements ^ np.uint64(0x5851F42D4C957F2D)), mix(elements ^ np.uint64(0x14057B7EF767814F))
    own = bands.band(len(elements))
    for instance in (own, own + 1):
        p = bands.parts(instance)
        total = p.n1 * p.n2
        part = (of_part % np.uint64(total)).astype(np.intp)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, part, content)
        sums, sizes = mix(sums).reshape(p.n1, p.n2), np.bincount(part, minlength=total).reshape(p.n1, p.n2)
        which, first = np.arange(len(p.subsets), dtype=np.uint64)[None, :], np.arange(p.n1, dtype=np.uint64)[:, None]
        sigs = (np.uint64(instance) << np.uint64(40)) | (which << np.uint64(32)) | first
        full = np.zeros(sigs.shape, np.int64)
        for column in p.subsets.T:
            sigs = mix(sigs + sums[:, column])
            full += sizes[:, column]
        sigs, full = sigs.ravel(), full.ravel()
        if p.kept < len(sigs):
            sigs = sigs[np.lexsort((sigs, full))[len(sigs) - p.kept :]]
        out.append(sigs)
    return np.concatenate(out)


def _texts(batch, text_at):
    return (x.as_py() for x in batch.column(text_at))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """row, n, key (hash of the set), counts (of elements by bucket, 127 at most), odd (is the bucket's count? as bits) of docs (row, text)."""

    def run(batches):
        known = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(word_hashes(lower_words(t), known), width) for t in _texts(part, 1)]
                counts, odd = np.zeros((len(sets), SKETCH), np.int8), np.zeros((len(sets), SKETCH // 64), np.int64)
                for i, s in enumerate(sets):
                    full = np.bincount((mix(s) % np.uint64(SKETCH)).astype(np.intp), minlength=SKETCH)
                    counts[i], odd[i] = np.minimum(full, 127), np.packbits(full & 1).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (counts, odd)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.int64()), *lists], ["row", "n", "key", "counts", "odd"])

    return docs.select("row", "text").mapInArrow(run, "row bigint, n bigint, key bigint, counts array<tinyint>, odd array<bigint>")


def _key(elements: np.ndarray) -> int | None:
    return int(mix(np.array([mix(elements).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0]) if len(elements) else None


def set_signatures(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """sig, key: a row for each signature of the sets of docs (text).

    A task cuts the signatures of equal sets once, so that copies come together before the exchange.
    """

    def run(batches):
        known, bands, seen = Hashes(), Bands(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, sigs = [], []
                for text in _texts(batch.slice(at, 500), 0):
                    s = shingles(word_hashes(lower_words(text), known), width)
                    key = _key(s)
                    if key is None or key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    sigs.append(signatures(s, bands).view(np.int64))
                    keys.append(np.full(len(sigs[-1]), key, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(keys))], ["sig", "key"])

    return docs.select("text").mapInArrow(run, "sig bigint, key bigint")


def set_elements(docs: DataFrame, width: int) -> DataFrame:
    """key, elements of docs (key, text)."""

    def run(batches):
        known = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(word_hashes(lower_words(t), known), width).view(np.int64) for t in _texts(part, 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["key", "elements"])

    return docs.mapInArrow(run, "key bigint, elements array<bigint>")


def _most_apart(n, m, percent: int) -> Column:
    """100 + percent times the most elements in which linked sets of n and m elements differ."""
    return (F.col(n) + F.col(m)) * (100 - percent)


def _within_reach(pairs: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, wide) without those that their counts show to have no link, but for wide ones."""
    x, y = kinds.select("key", "n", "counts").toDF("a", "a_n", "a_counts"), kinds.select("key", "n", "counts").toDF("b", "b_n", "b_counts")
    apart = F.aggregate(F.zip_with("a_counts", "b_counts", lambda v, w: F.abs(v.cast("int") - w)), F.lit(0), lambda total, d: total + d)
    return pairs.join(x, "a").join(y, "b").filter(F.col("wide") | (apart * (100 + percent) <= _most_apart("a_n", "b_n", percent))).select("a", "b", "wide")


def compared(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """a, b, linked, n (of a), h (elements in which they differ), common (prefix elements of a link), prefix (of the difference; null unless wide) of pairs (a, b, wide).

    The order of a difference from b: what b lacks, then what a lacks, each in the elements' order.
    """
    of = lambda side: elements.select(F.col("key").alias(side), F.col("elements").alias(f"{side}_elements"))
    got = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("n", F.size("a_elements")).withColumn("b_n", F.size("b_elements"))
    got = got.withColumn("diff", F.concat(F.array_except("a_elements", "b_elements"), F.array_except("b_elements", "a_elements"))).withColumn("h", F.size("diff"))
    got = got.withColumn("linked", F.col("h") * (100 + percent) <= _most_apart("n", "b_n", percent))
    # the partner differs from the pivot by as much, less what links allow; it is at most 100 / percent times as large
    tight = F.lit((100 - percent) / (100 + percent))
    shared = F.col("h") - F.col("n") * (1 + 100 / percent) * tight
    # of a set that is linked with the pivot only partners matter that are not
    shared = F.when(F.col("linked"), F.greatest(shared, (F.col("h") + (F.col("b_n") - F.col("n")) * tight) / 2)).otherwise(shared)
    # two sets with so many common elements have the first `common` of them in both prefixes
    got = got.withColumn("least", F.greatest(F.lit(1), F.ceil(shared - F.lit(1e-9))).cast("int")).withColumn("common", F.least(F.lit(COMMON), F.col("least")))
    prefix = F.slice("diff", F.lit(1), F.col("h") - F.col("least") + F.col("common"))
    return got.select("a", "b", "linked", "n", "h", "common", F.when(F.col("wide"), prefix).alias("prefix"))


def _with_pivots(members: DataFrame) -> DataFrame:
    """members (group, key, mass, ...) with pivot, the one of the greatest mass in the group, and size of the group.

    Pivots are a table, so that both sides of the join are plain exchanges, of which Spark splits hot ones.
    """
    top = members.groupBy("group").agg(F.max(F.struct("mass", "key")).alias("top"), F.count("*").alias("size"))
    return members.join(written(top.select("group", F.col("top.key").alias("pivot"), "size"), "pivots"), "group")


def linked_sets(docs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """node, root: for each key of a set that is linked with others the smallest key of its component, but for these themselves."""
    # one exchange by signature: the signatures are the bulk of what moves
    of_sig = Window.partitionBy("sig")
    shared = set_signatures(docs, percent, width).select("sig", "key", F.min("key").over(of_sig).alias("low"), F.max("key").over(of_sig).alias("high"), F.count("*").over(of_sig).alias("sharers"))
    shared = written(shared.filter("low < high").select(F.col("sig").alias("group"), "key", "sharers").distinct(), "shared")
    mass = written(shared.groupBy("key").agg(F.sum("sharers").alias("mass")), "mass")
    kinds = sets.groupBy("key").agg(F.min(F.struct("row", "n", "counts", "odd")).alias("one")).join(mass, "key").select("key", "one.*")
    kinds = written(kinds, "kinds")  # one document of each set that shares a signature

    # a shuffle at every size: the rows grow with the documents, so they are not for broadcasting
    needed = kinds.select("key", "row")
    elements = written(set_elements(docs.select("row", "text").join(needed.hint("merge"), "row").select("key", "text"), width), "elements")

    # first every set with the highest of its pivots: what these links join is settled, and so are groups within one component
    rows = written(_with_pivots(shared.select("group", "key").join(mass, "key")), "by_signature")
    ranks = mass.select(F.col("key").alias("pivot"), F.col("mass").alias("rank"))
    best = rows.filter("key <> pivot").select("key", "pivot").distinct().join(ranks, "pivot").groupBy(F.col("key").alias("a")).agg(F.max(F.struct("rank", "pivot")).alias("b"))
    best = _within_reach(best.select("a", F.col("b.pivot").alias("b"), F.lit(False).alias("wide")), kinds, percent)
    roots = components(compared(best, elements, percent).filter("linked").select("a", "b"))
    rows = written(rows.filter("key <> pivot").join(_unsettled(rows, roots), "group"), "open")
    pairs = rows.groupBy(F.col("key").alias("a"), F.col("pivot").alias("b")).agg((F.max("size") > 2).alias("wide"))
    first = written(compared(written(_within_reach(pairs, kinds, percent), "pairs"), elements, percent), "compared")
    roots = components(roots.union(first.filter("linked").select("a", "b")))

    # signatures of a third set, and of one that is not linked with the pivot: groups by the prefixes' elements
    loose = first.filter("not linked and prefix is not null").select(F.col("a").alias("key"), F.col("b").alias("pivot"))
    loose = written(rows.filter("size > 2").join(loose, ["key", "pivot"], "left_semi").select("group").distinct(), "loose")
    open_ = rows.join(loose, "group").select(F.col("key").alias("a"), F.col("pivot").alias("b"), "mass").distinct()
    items = open_.join(first, ["a", "b"]).select(F.col("a").alias("key"), "b", "mass", "linked", "n", "h", "common", F.posexplode("prefix").alias("at", "e"))
    items = written(items.withColumn("group", F.xxhash64("b", "e")).drop("b", "e"), "items")
    some = items.groupBy("group").agg(F.count("*").alias("size"), F.bool_and("linked").alias("all")).filter("size > 1 and not all").select("group")
    items = _rooted(items.join(written(some, "some"), "group"), roots)
    items = written(_with_pivots(items.join(_unsettled(items, None), "group")).filter("key <> pivot").drop("mass"), "in_groups")
    pairs = _rooted(items.select("pivot", F.col("root").alias("of"), "key").distinct().withColumnRenamed("key", "member").withColumnRenamed("pivot", "key"), roots)
    pairs = pairs.filter("of <> root").select(F.col("member").alias("a"), F.col("key").alias("b"), F.lit(False).alias("wide"))
    second = compared(_within_reach(pairs, kinds, percent), elements, percent).filter("linked").select("a", "b")
    roots = components(roots.union(second))

    # in a group: sets of different components, one of them not linked with the first pivot, where they can overlap enough
    rest = written(_rooted(items.filter("size > 2").drop("root"), roots), "rest")
    odd = [f"odd_{i}" for i in range(SKETCH // 64)]
    of_key = kinds.select("key", *[F.col("odd")[i].alias(c) for i, c in enumerate(odd)])
    rest = written(rest.join(_unsettled(rest, None), "group").join(of_key, "key"), "rest_of_groups")
    least = (F.col("x.h") + F.col("y.h") - (F.col("x.n") + F.col("y.n")) * (100 - percent) / (100 + percent)) / 2 - F.lit(1e-9)
    reach = F.least(F.col("x.h") - F.col("x.at"), F.col("y.h") - F.col("y.at"))
    # where one bucket's count is odd and the other's even, the sets differ in one element at least
    differ = sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in odd)
    may = (reach + COMMON - 1 >= least) & (differ * (100 + percent) <= _most_apart("x.n", "y.n", percent))
    met = rest.filter("not linked").alias("x").join(rest.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.root") != F.col("y.root")) & (F.col("y.linked") | (F.col("x.key") < F.col("y.key"))) & may)
    met = met.groupBy(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).agg(F.count("*").alias("groups"), F.min(F.least("x.common", "y.common")).alias("common"))
    met = met.filter("groups >= common").select("a", "b", F.lit(False).alias("wide"))
    third = compared(written(_within_reach(met, kinds, percent), "met"), elements, percent).filter("linked").select("a", "b")
    return components(roots.union(third))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (key, ...) with the root of the key's component, the key itself where it has no link."""
    return rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _unsettled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """group, of those of rows (group, key, root) that have keys of two components; roots where rows have none."""
    rows = rows if roots is None else _rooted(rows.select("group", "key"), roots)
    return written(rows.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("group"), "unsettled")


def _stars(edges: DataFrame) -> bool:
    """Is each node of edges (u, v) either the centre of its neighbours or linked with one centre alone?"""
    ends = edges.select(F.col("u").alias("node"), "v").union(edges.select(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("v")))
    of_node = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.bool_or(F.col("v").isNull()).alias("centre"))
    return of_node.filter((F.col("low") < F.col("high")) | (F.col("centre") & F.col("low").isNotNull())).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of edges (two columns) but the roots.

    Rounds end when every component is a star, whose edges lead to its smallest node; so what an
    earlier call has returned, with few edges more, takes few rounds.
    """
    edges = written(edges.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, percent=90, width=3, id_col="doc_id", text_col="text", row_col=None) -> DataFrame:
    """row, id, n (set size), component_id, first (is this row the one of its component to stay?)."""
    if not row_col:
        row_col = fresh(docs, "row")
        docs = numbered(docs.select(id_col, text_col), row_col)
    docs = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = written(shingle_sets(docs, width), "sets")
    spark, before = docs.sparkSession, len(made(docs.sparkSession))
    roots = linked_sets(docs, cut.filter("n > 0"), percent, width)
    release(spark, made(spark, before), roots)
    ids = docs.select("row", "id")
    some = cut.filter("n > 0").select("row", "n", "key").join(roots, F.col("key") == F.col("node"), "left")
    some = written(some.select("row", "n", F.coalesce("root", "key").alias("root")).join(ids, "row"), "rooted")
    # nulls are the last: the first row has the least id, and of equal ids the least number
    top = some.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("top"))
    top = written(top.select("root", F.col("top.id").alias("component_id"), F.col("top.row").alias("stays")), "tops")
    some = some.join(top, "root").select("row", "id", "n", "component_id", (F.col("row") == F.col("stays")).alias("first"))
    none = cut.filter("n = 0").select("row", "n").join(ids, "row").select("row", "id", "n", F.col("id").alias("component_id"), F.lit(True).alias("first"))
    return some.union(none)


def drop_near_duplicates(docs: DataFrame, percent=80, width=5, id_col="doc_id", text_col="text") -> DataFrame:
    """docs with one row of each component; the smallest id stays."""
    row = fresh(docs, "row")
    docs = numbered(docs, row)
    stays = near_duplicates(docs, percent, width, id_col, text_col, row_col=row).filter("first").select(F.col("row").alias(row))
    return docs.join(stays.hint("merge"), row).drop(row)


def query(spark, sf_dir):
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
