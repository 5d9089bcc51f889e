"""Mixing sources to target weights, with DataFrame operations only.

The words of a source, document after document in a hashed order, are packed into blocks of a
fixed length. The mix is output shards of about `shard_slots` slots. Every shard draws how many of
its slots each source gets: the whole part of the source's expected number, and for the parts that
are left multinomial draws by those parts, so that a shard's counts keep near what the targets
want. The slots of a source are numbered over the shards. Slot j of a source takes the block to
which a keyed permutation of the source's block indexes maps j, with another key for each pass
over the source (a Feistel network over two digits, walking on from what lies beyond the last
block). Slots and blocks meet in an equi-join on (source, block index). A source gives no more
than `cap` passes: slots that a draw gives it beyond them stay empty.

Cases: a null source is a source of its own, ordered last. Null, empty and blank texts have
size 0 and are never taken. Repeated rows are mixed each by itself; of rows equal in id and text
the row number decides the order. Ties of ids are no matter. Texts are taken whole, of any length.
Without rows, or without words, nothing is taken. Other columns of the input are left alone,
whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.tables import SPACE, WORD, fresh, numbered, written

@dataclass
class Mixture:
    rows: DataFrame  # one per input row: row, id, source, source_no, size, source_size, target, taken
    slots: DataFrame  # one per slot of a shard: shard, source_no, slot_no, pass_no, block
    pieces: DataFrame  # words of a document in a block that is taken: row, first_word, words, times


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share=1.5, cap=2.0) -> DataFrame:
    """source, source_size, source_no, target from rows of (source, size).

    Weights repeat over the sources in code point order, null last. The targets share `share` of
    all words by weight; none is above cap times its source. Filling by the ratio of cap to
    weight: once the sources with the least room are full, the rest share what is left, so the
    level of the fill is the greatest of the levels after each of them.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = found.withColumn("source_no", F.row_number().over(by_name)).withColumn("weight", weight)
    found = found.withColumn("room", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("room") / F.col("weight"))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("room").over(by_room), F.lit(0.0))
    still = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0))
    found = found.withColumn("level", left / still)
    found = found.withColumn("target", F.least("room", F.col("weight") * F.max("level").over(every)))
    return found.select("source", "source_size", "source_no", "target")


def _uniform(*keys) -> Column:
    """A number in 0..1 from a hash of keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11) + 0.5) / float(1 << 53)


def permuted(index: Column, n: Column, *keys) -> Column:
    """Where a keyed permutation of 0..n-1 puts index.

    Four rounds over the digits of index = high * low_base + low, each digit moved by a hash of the
    other, are a permutation of 0..high_base*low_base-1. Fewer than the root of n of these numbers
    are n or more; from them the permutation is followed until it comes back below n, which 16
    steps do surely for n up to 256, and beyond but for one index in 10 ** 19.
    """
    low_base = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    high_base = F.floor((n + low_base - 1) / low_base)

    def once(x):
        high, low = F.floor(x / low_base), x % low_base
        for turn in (0, 2):
            high = (high + F.pmod(F.xxhash64(*keys, F.lit(turn), low), high_base)) % high_base
            low = (low + F.pmod(F.xxhash64(*keys, F.lit(turn + 1), high), low_base)) % low_base
        return high * low_base + low

    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), once(index), lambda at, _: F.when(at < n, at).otherwise(once(at)))


def _counts(sources: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """shard, source_no, slots: the draws of every shard. sources: source_no, wanted (slots of all shards)."""
    share = F.col("wanted") / F.lit(float(n_shards))
    whole = sources.select("source_no", F.floor(share).alias("slots"), (share - F.floor(share)).alias("part"))
    shards = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard")
    counts = whole.filter("slots > 0").select(shards, "source_no", "slots")
    # the parts side by side on 0..1, cut at cells of equal width, so that a draw meets its source by an equal cell
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    parts = whole.select("source_no", "part", F.coalesce(F.sum("part").over(before), F.lit(0.0)).alias("low"), F.sum("part").over(every).alias("all"), F.count("*").over(every).alias("cells"))
    parts = parts.filter("part > 0").withColumn("draws", F.round("all").cast("long")).select("source_no", "cells", "draws", (F.col("low") / F.col("all")).alias("low"), ((F.col("low") + F.col("part")) / F.col("all")).alias("high"))
    parts = written(parts, "parts")
    cell = lambda x: F.least(F.col("cells") - 1, F.floor(x * F.col("cells")))
    in_cells = parts.select("source_no", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    draws = parts.agg(F.max("draws").alias("draws"), F.max("cells").alias("cells")).filter("draws > 0").select("cells", "draws", shards)
    draws = draws.select("cells", "shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("draw"))
    draws = draws.withColumn("u", _uniform(F.lit(seed), F.col("shard"), F.col("draw"))).withColumn("cell", cell(F.col("u")))
    drawn = draws.join(in_cells.hint("merge"), "cell").filter("low <= u and u < high").groupBy("shard", "source_no").agg(F.count("*").alias("slots"))
    return counts.unionByName(drawn).groupBy("shard", "source_no").agg(F.sum("slots").alias("slots"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", row_col=None, weights=(5, 2, 1), share=1.5, cap=2.0, block_words=64, shard_slots=1 << 14, seed=17) -> Mixture:
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sizes = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text_col)).alias("content"))
    sizes = written(sizes, "sizes")
    total = sizes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    n_buckets = max(1, total["rows"] // 4096 + total["words"] // (1 << 20))
    n_shards = max(1, round(total["words"] * share / block_words / shard_slots))

    b = F.lit(block_words).cast("long")
    sources = source_targets(sizes, weights, share, cap).withColumn("n_blocks", F.floor((F.col("source_size") + b - 1) / b))
    # a slot takes a block, of which the last one of a source may be short
    sources = written(sources.withColumn("wanted", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)), "sources")
    # the number of a row decides among equal rows alone, so that the mix does not follow how the input is split
    order = F.xxhash64(F.lit(seed), F.col("id"), F.col("content"))
    rows = sizes.withColumn("source_key", F.coalesce("source", F.lit(""))).withColumn("null_source", F.col("source").isNull())
    keyed = sources.select(F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("null_source"), "source_no", "source_size", "target")
    rows = rows.join(keyed, ["source_key", "null_source"]).drop("source_key", "null_source")
    rows = rows.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(n_buckets)))

    # Offsets of words within a source in two levels, so that a large source isn't one task: rows of a bucket, then
    # buckets, of which there is one for thousands of rows.
    before = Window.partitionBy("source_no", "bucket").orderBy("order", "id", "content", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = written(rows.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))), "placed")
    until = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    buckets = written(buckets.select("source_no", "bucket", F.coalesce(F.sum("words").over(until), F.lit(0)).alias("start")), "buckets")
    rows = rows.join(buckets, ["source_no", "bucket"])
    rows = rows.withColumn("start", F.col("start") + F.col("before")).withColumn("end", F.col("start") + F.col("size"))

    # Slots of a source, numbered over the shards, and the blocks to which its permutations map them.
    so_far = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = _counts(sources.select("source_no", "wanted"), n_shards, seed + 1)
    slots = slots.withColumn("first", F.coalesce(F.sum("slots").over(so_far), F.lit(0))).join(sources.select("source_no", "n_blocks"), "source_no")
    # a shard's slots are made in one task, not those of all shards in the task of the small table before
    slots = slots.repartition(max(1, n_shards // 2), "shard")
    slots = slots.withColumn("slot_no", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1))).filter(F.col("slot_no") < F.floor(F.col("n_blocks") * F.lit(float(cap))))
    slots = slots.withColumn("pass_no", F.floor(F.col("slot_no") / F.col("n_blocks")))
    place = permuted(F.col("slot_no") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed + 2), F.col("source_no"), F.col("pass_no"))
    slots = slots.select("shard", "source_no", "slot_no", "pass_no", place.alias("block"))

    # Blocks by index: each document's words in a block against the slots of that block.
    pieces = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b))))
    low, high = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("end"), (F.col("block") + 1) * b)
    pieces = pieces.select("row", "source_no", "block", (low - F.col("start")).alias("first_word"), (high - low).alias("words"))
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # the planner takes exploded slots for as small as the counts they come from, and would broadcast them
    pieces = pieces.join(uses.hint("merge"), ["source_no", "block"]).select("row", "first_word", "words", "times")
    taken = pieces.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = rows.join(taken, "row", "left").select("row", "id", "source", "source_no", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mixture(rows, slots, pieces)


def mixed_documents(docs: DataFrame, text_col="text", **options) -> DataFrame:
    """The mix as rows of docs: for each pass over its source a row with the words of a document that the pass takes.

    White space between words that stand together stays as it is. A text that is taken whole is left
    alone. A column n_chars follows the text.
    """
    row, plan = fresh(docs, "row"), fresh(docs, "plan")
    docs = numbered(docs, row)
    got = mix(docs, row_col=row, text_col=text_col, **options)
    of_row = got.pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first_word", "words", "times"))).alias("parts"), F.max("times").alias("passes"))
    of_row = of_row.select("row", "parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))).alias("pass_no"))
    of_row = of_row.select("row", F.filter("parts", lambda p: p["times"] >= F.col("pass_no")).alias("parts"))
    plans = of_row.join(got.rows.select("row", "size"), "row").select(F.col("row").alias(row), F.struct("parts", (F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("size")).alias("whole")).alias(plan))
    out = docs.join(written(plans, "plans").hint("merge"), row)
    # each word with the white space after it
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"{WORD}{SPACE}*"), F.lit(0))
    taken = F.array_join(F.flatten(F.transform(F.col(plan)["parts"], lambda p: F.slice(words, (p["first_word"] + 1).cast("int"), p["words"].cast("int")))), "")
    text = F.when(F.col(plan)["whole"], F.col(text_col)).otherwise(taken)
    kept = [c for c in docs.columns if c != row]
    out = out.withColumn(text_col, text)
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.length(text_col).cast("long"))
    return out.select(*[f"`{c}`" for c in kept])


def query(spark, sf_dir):
    from attesta.llm.tables import read

    return mix(read(spark, sf_dir, "documents")).rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")
