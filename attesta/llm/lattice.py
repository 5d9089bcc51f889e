r"""Subword lattice likelihood: log10 probabilities of whole texts under a unigram model.

A text is its words (white space apart, A-Z in lower case) and one end. The probability of a word
sums over all its segmentations: into pieces of an existing vocabulary, whose scores are the
weights, and, where the corpus has the word, into the word as one arc. Arcs of the corpus are its
counts less an absolute discount d (Ney, Essen and Kneser); what the discounts free is the weight
of the pieces' lattice, so that probabilities sum to one:

    P(w) = max(c(w) - d, 0) / N + d * V / N * lattice(w),  d = n1 / (n1 + 2 * n2)

lattice(w) is the marginal over segmentations, by the forward recursion in log space over the
positions of the word with its leading blank mark. The vocabulary's scores rank its pieces (the
public one has merge ranks); weights follow Zipf's law in the rank. Bytes are pieces too, so any
text can be scored.

Counts are gathered from all training rows, by word; their table grows with the corpus and is
never collected. A bounded number of the most frequent words (`common`) is sent to the tasks, so
that no word is hot in a join; all other words meet their counts in an equi-join.

Cases: a null, empty or blank text is one end token. A null id is text '' to crc32. Without
training rows N and V are 0: base_score is null, and the score is of the lattice alone. Repeated
rows are scored each by itself and counted as often as they stand; other columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.tables import read, written
from attesta.llm.words import lower_words

BLANK = "▁"
#: The end of a text among the words; no word holds a line break.
END = "\n"
FLUSH = 150_000


@dataclass(frozen=True)
class Pieces:
    """Log weights of an existing vocabulary's pieces; they sum to one with the bytes and the end."""

    log: dict[str, float]
    byte: float
    end: float
    longest: int

    @classmethod
    def ranked(cls, scores: dict[str, float], zipf_shift: float = 30.0, byte_share: float = 1e-3, end_share: float = 1e-3) -> Pieces:
        order = sorted(scores, key=lambda p: (-scores[p], p))
        weight = {p: 1.0 / (i + zipf_shift) for i, p in enumerate(order)}
        total = math.log(sum(weight.values())) - math.log(1 - byte_share - end_share)
        return cls({p: math.log(w) - total for p, w in weight.items()}, math.log(byte_share / 256), math.log(end_share), max(map(len, scores), default=1))

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls.ranked({model.id_to_piece(i): model.get_score(i) for i in plain})

    def word(self, word: str) -> float:
        """Natural log of the marginal probability of a word, over all segmentations."""
        if word == END:
            return self.end
        text = BLANK + word
        n, log, longest = len(text), self.log, self.longest
        forward = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            arcs = [forward[j - 1] + len(text[j - 1].encode()) * self.byte]
            for i in range(max(0, j - longest), j):
                w = log.get(text[i:j])
                if w is not None:
                    arcs.append(forward[i] + w)
            if len(arcs) == 1:
                forward[j] = arcs[0]
            else:
                top = max(arcs)
                forward[j] = top + math.log(sum([math.exp(a - top) for a in arcs]))
        return forward[n]


def held_out(id_col):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def word_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """word, c (count in training rows), lattice (natural log) of every word of docs (held_out, text)."""

    def count(batches):
        train: Counter = Counter()
        seen: set = set()

        def flush():
            words = list(seen | train.keys())
            got = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([train[w] for w in words], pa.int64())], ["word", "c"])
            train.clear()
            seen.clear()
            return got

        for batch in batches:
            for out, text in zip(batch.column(0), batch.column(1)):
                words = lower_words(text.as_py())
                words.append(b"\n")
                if out.as_py():
                    seen.update(words)
                else:
                    train.update(words)
                if len(train) + len(seen) > FLUSH:
                    yield flush()
        if train or seen:
            yield flush()

    def weigh(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([pieces.word(w) for w in part.column(0).to_pylist()], pa.float64())], ["word", "c", "lattice"])

    counts = docs.select("held_out", "text").mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    return written(counts.mapInArrow(weigh, "word string, c bigint, lattice double"), "words")


def _common_count(words: DataFrame, common: int) -> int:
    """The least count of which words of that count or more are `common` at most, to a twelfth of an octave."""
    octave = F.floor(F.log2("c") * 12).cast("int")
    sizes = {r["o"]: r["count"] for r in words.filter("c > 0").groupBy(octave.alias("o")).count().collect()}
    held, least = 0, 1 << 62
    for o in sorted(sizes, reverse=True):
        held += sizes[o]
        if held > common:
            break
        least = math.ceil(2 ** (o / 12) - 1e-9)
    return least


def score(docs: DataFrame, pieces: Pieces, id_col="doc_id", text_col="text", common: int = 20_000) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    words = word_counts(rows, pieces)
    t = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    n, v = t["n"], t["v"]
    d = t["n1"] / (t["n1"] + 2 * t["n2"]) if t["n1"] else 0.5 if n else 0.0
    share = F.greatest(F.col("c") - d, F.lit(0.0)) / max(n, 1)
    prob = share + F.lit(d * v / n if n else 1.0) * F.exp("lattice")
    # a word that training lacks is spelled; in logs, as a long one would underflow
    one = F.when(share == 0, (F.col("lattice") + math.log(d * v / n if n else 1.0)) / math.log(10)).otherwise(F.log10(prob))
    base = F.log10((F.col("c") + 0.5) / (n + 0.5 * (v + 1))) if n else F.lit(None).cast("double")
    words = words.select("word", "c", base.alias("base"), one.alias("score"))
    top = words.filter(F.col("c") >= _common_count(words, common)).collect()  # at most `common` rows
    of_common = docs.sparkSession.sparkContext.broadcast({r["word"].encode(): (r["c"] > 0, r["base"] or 0.0, r["score"]) for r in top})

    def split(batches):
        known = of_common.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out_row, out_word, out_n, sums, places = [], [], [], [], []
                for place, (row, text) in enumerate(zip(part.column(0).to_pylist(), part.column(3))):
                    got = Counter(lower_words(text.as_py()))
                    got[b"\n"] += 1
                    total, n_known, base_sum, score_sum = 0, 0, 0.0, 0.0
                    for w, k in got.items():
                        total += k
                        hit = known.get(w)
                        if hit is None:
                            out_row.append(row)
                            out_word.append(w.decode())
                            out_n.append(k)
                            places.append(None)
                            sums.append((0, 0, 0.0, 0.0))
                        else:
                            n_known += k * hit[0]
                            base_sum += k * hit[1]
                            score_sum += k * hit[2]
                    # what the common words give: a row whose word no other row has
                    out_row.append(row)
                    out_word.append(f" {row}")
                    out_n.append(0)
                    places.append(place)
                    sums.append((total, n_known, base_sum, score_sum))
                cols, of_doc = list(zip(*sums)), pa.array(places, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_row, pa.int64()), part.column(1).take(of_doc), part.column(2).take(of_doc), pa.array(out_word, pa.string()), pa.array(out_n, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                    ["row", "id", "held_out", "word", "n", "total", "n_known", "base_sum", "score_sum"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    parts = rows.mapInArrow(split, f"row bigint, id {kind}, held_out boolean, word string, n bigint, total bigint, n_known bigint, base_sum double, score_sum double")
    parts = parts.join(words, "word", "left")
    times = lambda c: F.coalesce(F.col("n") * F.col(c), F.lit(0.0))
    out = parts.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("held_out").alias("held_out"),
        F.sum("total").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_sum") + times("base")).alias("base_score"),
        F.sum(F.col("score_sum") + times("score")).alias("score"),
    )
    base_score = F.col("base_score") if n else F.lit(None).cast("double")
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")


def query(spark, sf_dir):
    import public_tokenizers

    pieces = Pieces.from_model(public_tokenizers.path("piece_bpe_32k.model"))
    return score(read(spark, sf_dir, "documents"), pieces).withColumnRenamed("id", "doc_id")
