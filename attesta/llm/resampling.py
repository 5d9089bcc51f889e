"""Quality classifier by importance resampling: a ratio of hashed n-gram models of target and raw text.

A text is a set of hashed features: its words (A-Z in lower case) and its runs of three word shapes
(letters, case, digits, marks, and whether a word repeats the one before). The raw model has the
part of all documents that has a feature, for its rate. The target model is learned from labelled
target rows (good and not toxic): its rate is the raw one times a ratio whose prior is 1 with
probability `spike` and else a gamma distribution of mean 1 and shape `shape`. With n target rows in
a bucket where the raw rate lets E be expected, the ratio is its mean after these counts: 1 where
they are what chance gives, about (n + shape) / (E + shape) where they are not. So a feature that
labels hardly know says little, and one that target text should have had, but has not, speaks
against a text.

A text's weight is log p_target(x) - log p_raw(x) for a passage of PASSAGE features of its kind:
the mean of its features' log ratios times PASSAGE, so that long and short texts are comparable.
Weights perturbed by Gumbel noise, of which the k greatest are taken, are a sample without
replacement by importance. k is the number of documents whose weight reaches a cut, which the
labelled rows set: there the share of target rows at or above it exceeds that of the others by
most. Labelled rows fall into five folds, and each is weighed by the target model of the other
four, so that no weight comes from a row's own label. The k-th greatest value is found by counting in ever finer
bins, of ids and row numbers where values tie, so that the sort is of few rows.

The raw counts cover every document. The labelled rows are a bounded sample (`max_labelled`, by
hash of the id); their weights, a number for each at most, come to the driver.

Cases: null, empty and blank texts have no features and are rejected. Rows with null id are
unlabelled. Several labels of an id count as toxic if any is, as good if all are; labels with null
id, or with neither value, are left out. Without labelled target rows, or without others, everything with
words is kept. Noise is a hash of id and seed: reruns agree. Repeated rows get equal weights. Texts
are taken whole. An empty table gives an empty result. Other columns are left alone, whatever their
names are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from attesta.llm.tables import fresh, numbered, read, written
from attesta.llm.words import Hashes, mix

#: Buckets: half for words, half for runs of shapes.
BUCKETS = 1 << 18
#: Features of the passage that a weight is for, and folds of the labelled rows.
PASSAGE, FOLDS = 1000, 5


class Kinds(dict):
    """Code point -> kind of character: an upper-case letter A, another letter a, a digit 9, itself else."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        found = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isnumeric() else c
        return found


KINDS, RUN = Kinds(), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """Kinds of a word's characters, runs of one kind counting once."""
    return RUN.sub(r"\1", word.translate(KINDS))


class Words(Hashes):
    """word -> its lower-case hash in the upper 40 bits, its shape's in the lower 24."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = (xxhash.xxh3_64_intdigest(word.lower()) & ~0xFFFFFF) | (xxhash.xxh3_64_intdigest(shape(word.decode())) & 0xFFFFFF)
        return found


def features(text: str | None, known: Words) -> np.ndarray:
    """Distinct buckets of a text: words, and runs of three shapes (the first ones with none before them)."""
    words = text.encode().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    half = np.uint64(BUCKETS // 2)
    s = h & np.uint64(0xFFFFFF)
    s[1:] += np.where(h[1:] == h[:-1], np.uint64(1 << 30), np.uint64(0))
    s = np.concatenate([np.zeros(2, np.uint64), s])
    runs = mix(mix(mix(s[:-2]) + s[1:-1]) + s[2:])
    return np.unique(np.concatenate([mix(h >> np.uint64(24)) % half, runs % half + half])).astype(np.int64)


def _sums(docs: DataFrame) -> np.ndarray:
    """For all documents and for the target ones of each fold, documents by bucket and, last, documents with any feature.

    docs: text, fold (null for rows that are not labelled target ones). What comes to the driver is a row for each bucket.
    """
    names = ["raw", *[f"fold_{k}" for k in range(FOLDS)]]

    def run(batches):
        known, sums = Words(), np.zeros((1 + FOLDS, BUCKETS + 1), np.int64)
        for batch in batches:
            for text, fold in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                f = features(text.as_py(), known)
                if len(f):
                    f = np.append(f, BUCKETS)
                    sums[0][f] += 1
                    if fold is not None:
                        sums[1 + fold][f] += 1
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(s[some]) for s in sums]], ["bucket", *names])

    out = np.zeros((1 + FOLDS, BUCKETS + 1))
    got = docs.select("text", "fold").mapInArrow(run, ", ".join(f"{c} bigint" for c in ["bucket", *names]))
    got = got.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out[:, got["bucket"].to_numpy()] = [got[c].to_numpy() for c in names]
    return out


def labelled_sample(labels: DataFrame, max_labelled: int, seed=5) -> DataFrame:
    """doc_id, target (good and not toxic?) and fold, of about max_labelled ids at most, taken by hash."""
    labels = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    share = min(1.0, max_labelled / max(1, labels.count()))
    few = labels.filter(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) < int(share * (1 << 20)))
    toxic, good = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 1, F.lit(False))
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(FOLDS)).cast("int")
    return few.select("doc_id", (good & ~toxic).alias("target"), fold.alias("fold"))


def ratio(n: np.ndarray, expected: np.ndarray, spike: float, shape: float) -> np.ndarray:
    """log of the mean, after n were counted where `expected` were, of a ratio that is 1 with probability spike, else gamma."""
    rising = np.concatenate([[0.0], np.cumsum(np.log(shape + np.arange(int(n.max(initial=0)))))])
    # log likelihoods of n, without the terms that they share
    gamma = rising[n.astype(np.intp)] + shape * np.log(shape / (shape + expected)) - n * np.log(shape + expected)
    is_one = 1 / (1 + (1 - spike) / spike * np.exp(np.minimum(gamma + expected, 700)))
    return np.log(is_one + (1 - is_one) * (n + shape) / (expected + shape))


class Model:
    """Log ratios of target models' rates to the raw model's, by bucket: of all folds' rows, and of all but one fold's.

    raw, folds: documents by bucket, of the corpus and of the labelled target rows of each fold; n_raw, n_folds: their numbers.
    """

    def __init__(self, raw: np.ndarray, folds: np.ndarray, n_raw: float, n_folds: np.ndarray, spike: float = 0.9, shape: float = 1.0):
        rates = raw / max(1.0, n_raw)
        of = lambda n, rows: ratio(n, rates * rows, spike, shape).astype(np.float32)
        n, rows = folds.sum(axis=0), n_folds.sum()
        self.ratios, self.without = of(n, rows), [of(n - folds[k], rows - n_folds[k]) for k in range(len(folds))]

    def weight(self, f: np.ndarray, fold: int | None = None) -> float:
        """log p_target - log p_raw of a passage of a text with features f, which is not learned from if it is of a fold."""
        ratios = self.ratios if fold is None else self.without[fold]
        return float(ratios[f].mean(dtype=np.float64) * PASSAGE)


def cut_of(weights: np.ndarray, target: np.ndarray) -> float:
    """The weight at or above which the share of target rows exceeds that of others by most; minus infinity without either."""
    if not target.any() or target.all():
        return float("-inf")
    values, place = np.unique(weights, return_inverse=True)
    above = [np.bincount(place[rows], minlength=len(values))[::-1].cumsum()[::-1] / rows.sum() for rows in (target, ~target)]
    return float(values[np.argmax(above[0] - above[1])])


def _cut(scored: DataFrame, few: DataFrame) -> float:
    """cut_of the rows of few by their weights in scored (id, weight)."""
    # few has at most max_labelled ids; of rows with one id the least weight counts
    got = scored.filter("words").join(F.broadcast(few.withColumnRenamed("doc_id", "id")), "id").groupBy("id").agg(F.min("weight").alias("weight"), F.first("target").alias("target")).toPandas()
    return cut_of(got["weight"].to_numpy(float), got["target"].to_numpy(bool))


def fit(docs: DataFrame, few: DataFrame) -> Model:
    """docs: doc_id, text; few: doc_id, target, fold."""
    # at most max_labelled rows of an id and a number
    learned = few.filter("target").select("doc_id", "fold")
    sums = _sums(docs.select("doc_id", "text").join(F.broadcast(learned), "doc_id", "left").select("text", "fold"))
    return Model(sums[0, :-1], sums[1:, :-1], sums[0, -1], sums[1:, -1])


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """row, id, words (has it any?), weight of docs (row, id, text, fold)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FOLDS + 1 numbers for each bucket

    def run(batches):
        known = Words()
        for batch in batches:
            f = [features(t.as_py(), known) for t in batch.column(2)]
            weights = [sent.value.weight(x, fold) if len(x) else None for x, fold in zip(f, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) > 0 for x in f]), pa.array(weights, pa.float64())], ["row", "id", "words", "weight"])

    docs = docs.select("row", "id", "text", "fold")
    return docs.mapInArrow(run, f"row bigint, id {docs.schema['id'].dataType.simpleString()}, words boolean, weight double")


def top_k(scored: DataFrame, k: int, bins: int = 1024, few: int = 1000) -> DataFrame:
    """The k rows with the greatest value; ties go by id (where it is a number) and row. scored: a table with row, id, value."""
    ranks = [F.col("value")]
    if isinstance(scored.schema["id"].dataType, IntegralType):
        ranks.append(-F.coalesce(F.col("id"), F.lit((1 << 63) - 1)).cast("decimal(20,0)"))
    ranks.append(-F.col("row").cast("decimal(20,0)"))
    inside, found, need = scored, scored.limit(0), k
    for rank in ranks:
        while True:
            low, high, n = inside.agg(F.min(rank), F.max(rank), F.count("*")).first()
            if n <= few or need <= 0 or low == high:
                break
            place = ((rank - F.lit(low)).cast("double") / F.lit(float(high - low)) * bins).cast("int")
            counts = {r["b"]: r["count"] for r in inside.groupBy(place.alias("b")).count().collect()}  # bins + 1 at most
            for b in sorted(counts, reverse=True):
                if counts[b] >= need:
                    break
                need -= counts[b]
            if len(counts) == 1:
                break  # values that no double tells apart
            found = found.unionByName(inside.filter(place > b))
            inside = inside.filter(place == b)
        if n <= few or need <= 0:
            break
    return found.unionByName(inside.orderBy(*[r.desc() for r in ranks]).limit(max(0, min(need, n))))


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, seed=7, row_col=None) -> DataFrame:
    """row, id, weight, kept of docs (doc_id, text)."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    few = labelled_sample(labels, max_labelled)
    model = fit(docs, few)
    # at most max_labelled rows of an id and a number
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), "text").join(F.broadcast(few.select(F.col("doc_id").alias("id"), "fold")), "id", "left")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 12) + 0.5) / float(1 << 52)
    scored = written(weigh(rows, model).withColumn("value", F.col("weight") - F.log(-F.log(u))), "weights")
    some = scored.filter("words")
    k = some.filter(F.col("weight") >= F.lit(_cut(scored, few))).count()
    kept = top_k(some, k).select("row", F.lit(True).alias("kept"))
    return scored.join(kept, "row", "left").select("row", "id", "weight", F.coalesce("kept", F.lit(False)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, ...) without the rows that the classifier rejects."""
    row = fresh(docs, "row")
    docs = numbered(docs, row)
    kept = classify(docs, labels, row_col=row, **options).filter("kept").select(F.col("row").alias(row))
    return docs.join(kept.hint("merge"), row).drop(row)


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read(spark, sf_dir, "labels")).select(F.col("id").alias("doc_id"), "weight", "kept")
