"""Faces of photos: which one counts, pairs of the same and of different people, similarity statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.constants import REASONS
from attesta.sources.tables import scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def chosen_face(faces: DataFrame, allow_ghost: bool = False, least_score: float = 0.5, ghost_ratio: float = 1.8) -> DataFrame:
    """One row for each photo: its widest face, or why none counts. faces: photo, face_id, width, height, det_score."""
    order = Window.partitionBy("photo").orderBy(F.desc("width"), "face_id")
    ok = faces.filter(F.col("det_score") >= least_score)
    top = ok.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("width").over(order)).withColumn("found", F.count("*").over(Window.partitionBy("photo"))).filter("rank = 1")
    ghost = (F.col("width") >= ghost_ratio * F.col("second")) if allow_ghost else F.lit(False)
    alone = (F.col("found") == 1) | ghost
    top = top.select("photo", "face_id", "found", F.when(alone, F.least("width", "height")).alias("side"), F.when(~alone, "comparable_faces").alias("reason"))
    return faces.select("photo").distinct().join(top, "photo", "left").select("photo", F.when(F.col("side").isNotNull(), F.col("face_id")).alias("face_id"), F.coalesce("found", F.lit(0)).alias("found"), "side", F.when(F.col("found").isNull(), "no_face").otherwise(F.col("reason")).alias("reason"))


#: Photos of an identity that meet in one group.
TOGETHER = 500


def _in_blocks(photos: DataFrame, together: int | None, size: int | None = None) -> DataFrame:
    """photos with block, blocks and large: identities with more than `together` photos are large, and have them dealt into blocks of about `size` (else so many)."""
    most = together or TOGETHER
    large = photos.groupBy("identity").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    large = large.select(F.col("identity").alias("of"), F.ceil(F.col("n") / (size or most)).cast("int").alias("blocks"))
    df = photos.join(large, F.col("identity") == F.col("of"), "left").withColumn("large", F.col("of").isNotNull()).drop("of").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return df.withColumn("block", F.pmod(F.xxhash64("photo"), F.col("blocks")).cast("int"))


def genuine_pairs(photos: DataFrame, together: int | None = None) -> DataFrame:
    """identity, a, b, similarity for all a < b of one identity; null where a face is missing, not whole, or of another length. photos: photo, identity, embedding.

    Pairs of small identities are made by a join. A large one is a triangle of blocks: each photo goes to the pairs of its block with
    every other, so its pairs are spread over as many groups as it has pairs of blocks, and a task holds the pairs of two blocks.
    """
    at = _in_blocks(photos.select("identity", "photo", "embedding").filter("photo is not null"), together)
    kinds = {f.name: f.dataType.simpleString() for f in photos.schema}
    # a number of tasks that is said is kept: few bytes of photos make many pairs
    sides = _large(at).repartition(int(photos.sparkSession.conf.get("spark.sql.shuffle.partitions")), "identity", "i", "j")
    return _small(at).unionByName(sides.groupBy("identity", "i", "j").applyInArrow(_every_pair, PAIRS.format(**kinds)))


def _small(at: DataFrame) -> DataFrame:
    """genuine_pairs() of the identities that are not large."""
    one = at.filter("not large")
    met = one.select("identity", F.col("photo").alias("a"), F.col("embedding").alias("ea")).join(one.select("identity", F.col("photo").alias("b"), F.col("embedding").alias("eb")), "identity").filter("a < b")
    return met.select("identity", "a", "b", dot(F.col("ea"), F.col("eb")).alias("similarity"))


def ranked_photos(photos: DataFrame) -> DataFrame:
    """photos with rank: 0, 1, ... within an identity by photo. Ranges of (identity, photo) are numbered by themselves, so no task holds an identity."""
    spark, path = photos.sparkSession, scratch(photos.sparkSession, "ranked")
    order = ["identity", "photo"]
    photos.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    table = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1))
    # a row for each range, and for each identity within a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = table.join(F.broadcast(starts), "_part").withColumn("_place", F.col("_start") + F.col("_nth"))
    first = placed.groupBy("identity").agg(F.min("_place").alias("_first"))
    return placed.join(first, "identity").withColumn("rank", F.col("_place") - F.col("_first")).select(*photos.columns, "rank")


def document_pairs(documents: DataFrame, photos: DataFrame) -> DataFrame:
    """identity, b, similarity, times: a document's face against the later photos of its identity.

    The face was taken from the first photo, so that one does not count; a photo counts once for each photo before it.
    documents: identity, embedding; photos: identity, photo, embedding.
    """
    d = documents.select("identity", F.col("embedding").alias("ed"))
    later = ranked_photos(photos.select("identity", "photo", "embedding")).filter("rank > 0")
    return later.join(d, "identity").select("identity", F.col("photo").alias("b"), F.col("rank").alias("times"), dot(F.col("ed"), F.col("embedding")).alias("similarity"))


#: Vectors of a block, and rows of a block that are multiplied at once: a task's memory doesn't grow with the table.
BLOCK, SLICE = 2000, 250
PARTIAL = "variant string, genuine boolean, n bigint, least double, total double, most double"
PAIRS = "identity {identity}, a {photo}, b {photo}, similarity double"


def _matrix(table: pa.Table) -> np.ndarray:
    """The table's embeddings, a row each."""
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))


def _sides(left: DataFrame, right: DataFrame, rows: int, columns: int, same: bool) -> DataFrame:
    """Rows of both sides for each pair of blocks (i, j); same: both are the same photos, and only i <= j is there. Sides: variant, identity, photo, times, embedding."""
    i, j = F.pmod(F.xxhash64("photo"), F.lit(rows)).cast("int"), F.pmod(F.xxhash64("photo"), F.lit(columns)).cast("int")
    a = left.withColumn("i", i).withColumn("j", F.explode(F.sequence(F.col("i") if same else F.lit(0), F.lit(columns - 1)))).withColumn("side", F.lit(0))
    b = right.withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") if same else F.lit(rows - 1)))).withColumn("side", F.lit(1))
    cols = ["i", "j", "side", "variant", "identity", "photo", "times", "embedding"]
    return a.select(*cols).unionByName(b.select(*cols))


def _statistics(same: bool):
    """Of a pair of blocks: n, least, total and most of the similarities, by variant of the left side and whether the identities are equal. `times`: how often a genuine pair counts, by its right photo."""

    def multiply(key, table):
        side = table.column("side").to_numpy()
        vectors = _matrix(table)
        who, photo, times = (table.column(c).to_numpy() for c in ("identity", "photo", "times"))
        variant = np.array(table.column("variant").to_pylist(), object)
        triangle = same and key[0].as_py() == key[1].as_py()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        for at in range(0, len(left), SLICE):
            rows = left[at : at + SLICE]
            s = vectors[rows] @ vectors[right].T
            equal = who[rows, None] == who[None, right]
            meets = photo[rows, None] < photo[None, right] if triangle else np.ones(s.shape, bool)
            weight = np.broadcast_to(times[None, right], s.shape)
            for name in dict.fromkeys(variant[rows]):
                of = meets & (variant[rows] == name)[:, None]
                for genuine, on in ((True, of & equal & (weight > 0)), (False, of & ~equal)):
                    if on.any():
                        values, w = s[on], weight[on] if genuine else np.ones(on.sum(), np.int64)
                        found.append((name, genuine, int(w.sum()), float(values.min()), float((values * w).sum()), float(values.max())))
        columns = list(zip(*found)) if found else [[]] * 6
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table({c: pa.array(list(v), k) for c, v, k in zip(("variant", "genuine", "n", "least", "total", "most"), columns, kinds)})

    return multiply


def _merged(parts: DataFrame, *by: str) -> DataFrame:
    total = F.sum("n")
    return parts.groupBy(*by).agg(total.alias("n"), F.round(F.min("least"), 6).alias("least"), F.round(F.sum("total") / total, 6).alias("mean"), F.round(F.max("most"), 6).alias("most"))


def _blocks(df: DataFrame) -> int:
    return max(1, -(-df.count() // BLOCK))


def impostor_stats(photos: DataFrame, blocks: int | None = None, documents_only: bool = False) -> DataFrame:
    """n, least, mean, most of the similarities of photos of different people; no pair is written.

    Vectors are dealt into blocks of BLOCK on average, unless a number of blocks is given; each pair of blocks is one task's matrix product, with pairs of
    one identity masked. documents_only: ordered pairs of a document face and another's photo.
    """
    blocks = blocks or _blocks(photos)
    p = photos.withColumn("variant", F.lit("raw")).withColumn("times", F.lit(1).cast("long"))
    sides = _sides(p.filter("is_document") if documents_only else p, p, blocks, blocks, not documents_only)
    return _merged(sides.groupBy("i", "j").applyInArrow(_statistics(not documents_only), PARTIAL).filter("not genuine"))


def photo_stats(photos: DataFrame) -> DataFrame:
    """kind, variant (raw), n, least, mean, most of the similarities of all pairs of photos."""
    p = photos.withColumn("variant", F.lit("raw")).withColumn("times", F.lit(1).cast("long"))
    n = _blocks(p)
    parts = _sides(p, p, n, n, True).groupBy("i", "j").applyInArrow(_statistics(True), PARTIAL)
    return _merged(parts.withColumn("kind", F.when(F.col("genuine"), "genuine").otherwise("impostor")), "kind", "variant")


def similarity_stats(photos: DataFrame, documents: DataFrame) -> DataFrame:
    """kind (genuine, impostor), variant, n, least, mean, most of the similarities of all pairs.

    raw: two photos; the other variants: a document's face against a photo, where a genuine pair counts
    as document_pairs() says. photos: photo, identity, embedding; documents: identity, variant, embedding.
    Photos without an identity or a face take no part. One blocked product for the photos, one for all
    variants of the documents; tasks return statistics that merge.
    """
    whole = F.col("identity").isNotNull() & F.col("embedding").isNotNull()
    ranked = ranked_photos(photos.filter(whole).select("identity", "photo", "embedding")).withColumn("variant", F.lit("raw"))
    raw = ranked.withColumn("times", F.lit(1).cast("long"))
    n = _blocks(raw)
    faces = documents.filter(whole).select("identity", "variant", "embedding", F.lit(0).cast("long").alias("times"), F.col("identity").alias("photo"))
    right = ranked.withColumnRenamed("rank", "times")
    parts = _sides(raw, raw, n, n, True).groupBy("i", "j").applyInArrow(_statistics(True), PARTIAL)
    more = _sides(faces, right.withColumn("photo", F.col("photo").cast(faces.schema["photo"].dataType)), _blocks(faces), n, False).groupBy("i", "j").applyInArrow(_statistics(False), PARTIAL)
    kind = F.when(F.col("genuine"), "genuine").otherwise("impostor")
    return _merged(parts.unionByName(more).withColumn("kind", kind), "kind", "variant")


def separation(stats: DataFrame) -> DataFrame:
    """variant, least_genuine, most_impostor, gap, apart of similarity_stats(); variants that lack a kind are not there."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    gap = F.round(F.col("least_genuine") - F.col("most_impostor"), 6)
    out = stats.groupBy("variant").agg(of("genuine", "least").alias("least_genuine"), of("impostor", "most").alias("most_impostor")).withColumn("gap", gap)
    return out.filter("gap is not null").withColumn("apart", F.col("gap") > 0)


def _every_pair(key, table):
    """All pairs of a pair of blocks of one identity. Components are added one after the other, as dot() adds them, so that both give the same sums."""
    side, photo = table.column("side").to_numpy(), table.column("photo").to_numpy()
    lists = table.column("embedding").combine_chunks()
    length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
    flat, size = lists.flatten(), np.maximum(length, 0)
    of = np.repeat(np.arange(len(lists)), size)
    whole = length >= 0
    whole[of[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    parts = np.zeros((int(size.max(initial=0)), len(lists)))
    parts[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), of] = pc.fill_null(flat, 0).to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    triangle = key[1].as_py() == key[2].as_py()
    p, q, s, none = [photo[:0]], [photo[:0]], [np.zeros(0)], [np.zeros(0, bool)]
    for at in range(0, len(left), SLICE):
        rows = left[at : at + SLICE]
        sums = np.zeros((len(rows), len(right)))
        for part in parts:
            sums += part[rows, None] * part[None, right]
        meets = photo[rows, None] < photo[None, right] if triangle else np.ones(sums.shape, bool)
        x, y = np.nonzero(meets)
        x, y, found = rows[x], right[y], sums[meets]
        p.append(photo[x]), q.append(photo[y]), s.append(found), none.append(~whole[x] | ~whole[y] | (length[x] != length[y]))
    p, q, kind = np.concatenate(p), np.concatenate(q), table.schema.field("photo").type
    columns = {"a": pa.array(np.minimum(p, q), kind), "b": pa.array(np.maximum(p, q), kind), "similarity": pa.array(np.concatenate(s), pa.float64(), mask=np.concatenate(none))}
    return pa.table({"identity": pa.array([key[0].as_py()] * len(p), table.schema.field("identity").type), **columns})


def _found(least: float, links: bool):
    """Of a pair of blocks of one identity: the pairs above `least`, or, with links, for each photo of them how many it is in and the least other photo."""

    def multiply(key, table):
        side, photo = table.column("side").to_numpy(), table.column("photo").to_numpy()
        vectors = _matrix(table)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        triangle, kind = key[1].as_py() == key[2].as_py(), table.schema.field("photo").type
        p, q, s = [photo[:0]], [photo[:0]], [np.zeros(0)]
        n, first = np.zeros(len(side), np.int64), {}
        for at in range(0, len(left), SLICE):
            rows = left[at : at + SLICE]
            found = vectors[rows] @ vectors[right].T
            on = found > least
            if triangle:
                # a block meets itself: each photo sees all others when links are counted, each pair is there once otherwise
                on &= photo[rows, None] != photo[None, right] if links else photo[rows, None] < photo[None, right]
            if not links:
                x, y = np.nonzero(on)
                p.append(photo[rows[x]]), q.append(photo[right[y]]), s.append(found[x, y])
                continue
            for mine, theirs, met in ((rows, right, on), *(() if triangle else ((right, rows, on.T),))):
                n[mine] += met.sum(1)
                order = np.argsort(photo[theirs], kind="stable")
                for i in np.flatnonzero(met.any(1)):
                    low = photo[theirs[order[met[i, order].argmax()]]]
                    first[mine[i]] = min(low, first.get(mine[i], low))
        if links:
            at = np.array(sorted(first), np.int64)
            columns = {"photo": pa.array(photo[at], kind), "links": pa.array(n[at]), "first": pa.array([first[i] for i in at], kind)}
        else:
            p, q = np.concatenate(p), np.concatenate(q)
            columns = {"a": pa.array(np.minimum(p, q), kind), "b": pa.array(np.maximum(p, q), kind), "similarity": pa.array(np.concatenate(s), pa.float64())}
        size = len(next(iter(columns.values())))
        return pa.table({"identity": pa.array([key[0].as_py()] * size, table.schema.field("identity").type), **columns})

    return multiply


def _large(at: DataFrame) -> DataFrame:
    """Both sides of each pair of blocks of the large identities."""
    large = at.filter("large")
    a = large.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1))).withColumn("side", F.lit(0))
    b = large.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block")))).withColumn("side", F.lit(1))
    cols = ["identity", "i", "j", "side", "photo", "embedding"]
    return a.select(*cols).unionByName(b.select(*cols))


def near_identical(photos: DataFrame, least: float = 0.98, together: int | None = None) -> DataFrame:
    """identity, a, b, similarity of the pairs of one identity above `least`, all of them: of n equal photos half of n squared. near_links() has a row for each photo.

    Pairs of small identities are made by a join; those of large ones are products of blocks, of which only the pairs found are returned.
    """
    at = _in_blocks(photos.select("identity", "photo", "embedding"), together)
    few = _small(at).filter(F.col("similarity") > least)
    kinds = {f.name: f.dataType.simpleString() for f in photos.schema}
    return few.unionByName(_large(at).groupBy("identity", "i", "j").applyInArrow(_found(least, False), PAIRS.format(**kinds)))


def near_links(photos: DataFrame, least: float = 0.98, together: int = 64, size: int | None = None) -> DataFrame:
    """identity, photo, links, first: photos that have others of their identity above `least`, with their number and the least of them. No pair of a large identity is written."""
    at = _in_blocks(photos.select("identity", "photo", "embedding"), together, size or BLOCK)
    few = _small(at).filter(F.col("similarity") > least)
    ends = F.explode(F.array(F.struct(F.col("a").alias("photo"), F.col("b").alias("first")), F.struct(F.col("b").alias("photo"), F.col("a").alias("first"))))
    few = few.select("identity", ends.alias("e")).select("identity", "e.photo", F.lit(1).cast("long").alias("links"), "e.first")
    kinds = {f.name: f.dataType.simpleString() for f in photos.schema}
    many = _large(at).groupBy("identity", "i", "j").applyInArrow(_found(least, True), "identity {identity}, photo {photo}, links bigint, first {photo}".format(**kinds))
    return few.unionByName(many).groupBy("identity", "photo").agg(F.sum("links").alias("links"), F.min("first").alias("first"))


def pair_counts(photos: DataFrame) -> DataFrame:
    """Numbers of genuine and impostor pairs, from counts alone."""
    n = photos.groupBy("identity").agg(F.count("*").alias("n"))
    sums = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("q"))
    return sums.select(F.expr("(q - s) div 2").alias("genuine"), F.expr("(s * s - q) div 2").alias("impostor"))


def similarity_of(documents: DataFrame, selfies: DataFrame, key: str = "verification_id") -> DataFrame:
    """key, similarity (4 digits) or the side that has no face; no row without a selfie. Both: key, embedding, reason."""
    d = documents.select(key, F.col("embedding").alias("ed"), F.col("reason").alias("rd"))
    df = selfies.select(key, F.col("embedding").alias("es"), F.col("reason").alias("rs")).join(d, key, "left")
    reason = F.when(F.col("ed").isNull(), F.concat(F.lit(REASONS["face_document"]), F.coalesce("rd", F.lit(REASONS["face"])))).when(F.col("es").isNull(), F.concat(F.lit(REASONS["face_selfie"]), F.coalesce("rs", F.lit(REASONS["face"]))))
    return df.select(key, F.round(dot(F.col("ed"), F.col("es")), 4).alias("similarity"), reason.alias("reason"))


def usable(readings: DataFrame, least_side: int = 100, comfortable: int = 200) -> DataFrame:
    """By identity: usable and comfortable photos, and discarded ones."""
    n = F.count_if
    on = F.col("side").isNotNull() & (F.col("side") >= least_side)
    return readings.groupBy("identity").agg(n(on).alias("usable"), n(on & (F.col("side") >= comfortable)).alias("comfortable"), n(~on).alias("discarded"))


def same_files(files: DataFrame) -> DataFrame:
    """sha256, ids of contents seen more than once."""
    return files.groupBy(F.sha2(F.col("content"), 256).alias("sha256")).agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)


def same_file_rows(files: DataFrame) -> DataFrame:
    """sha256, id, copies: a row for each file whose content is there more than once; a content of any number of copies stays in rows."""
    digests = files.select("id", F.sha2(F.col("content"), 256).alias("sha256"))
    many = digests.groupBy("sha256").agg(F.count("*").alias("copies")).filter("copies > 1")
    return digests.join(many, "sha256").select("sha256", "id", "copies")


def facial_cases(photos: DataFrame, impostors: int = 3) -> DataFrame:
    """holder, identity, kind: the first identity with two photos holds the document; others by name try to pass as it."""
    many = photos.groupBy("identity").agg(F.count("*").alias("n"), F.min("photo").alias("first"), F.max("photo").alias("last"))
    legit = many.filter("n >= 2")
    holder = legit.orderBy("identity").limit(1).select(F.col("identity").alias("holder"))
    others = many.join(holder, F.col("identity") != F.col("holder")).orderBy("identity").limit(impostors)
    own = legit.select(F.col("identity").alias("holder"), "identity", F.lit("legit").alias("kind"), F.col("last").alias("selfie"))
    return own.unionByName(others.select("holder", "identity", F.lit("impersonation").alias("kind"), F.col("first").alias("selfie")))


def numbered_people(files: DataFrame, pair: bool = False) -> DataFrame:
    """person, role, name from loose file names like role_number.ext; the last file of a key and role stays."""
    role, number = F.lower(F.regexp_extract("name", r"^([A-Za-z]+)", 1)), F.regexp_extract("name", r"(\d+)", 1)
    df = files.withColumn("role", role).withColumn("key", number if pair else F.concat_ws("-", role, number)).filter("key <> ''")
    last = df.groupBy("key", "role").agg(F.max("name").alias("name"))
    # keys in ranges, written once: a key's place is its place in its range after the ranges before
    spark, path = files.sparkSession, scratch(files.sparkSession, "people")
    last.select("key").distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id()).write.parquet(path)
    keys = spark.read.schema("key string, part int").parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("key"))).cast("string")
    # a number of three digits or more stays whole
    n = keys.join(F.broadcast(starts), "part").select("key", F.concat(F.lit("persona-"), F.when(F.length(place) < 2, "0").otherwise(""), place).alias("person"))
    return last.join(n, "key").select("person", "role", "name")
