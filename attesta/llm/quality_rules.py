r"""Quality rules as a learned decision list, with DataFrame operations only.

Sequential covering on labelled statistics: a rule is grown literal by literal (a statistic above
or at most a threshold) by the gain of information on two thirds of the labelled rows, pruned to
the prefix that does best on the other third, and kept if it is precise there; what it covers
leaves the training rows, and the next rule is grown. The list becomes an ordered conditional
expression: the first rule that holds gives the verdict. Each step is one aggregation of counts by
statistic and bin, of a fixed size, so that the learner never sees a row.

The labelled rows are a bounded sample (`max_labelled`, by hash of the id). The rules then run
over every document.

Cases: a null or empty text has 0 words, and fails the base rule. Texts are taken whole. Null ids
meet no label, and are judged like all others. Unlabelled rows and null labels take no part in
learning; without labelled rows of both kinds the list is empty and the base rule alone decides.
Several labels of one id count as one low-quality label if any of them is. Of equal gains the first
statistic by name, the lower threshold and "above" win. Repeated rows give equal results. An empty
table gives an empty result. The table's other columns stay as they are; one whose name is that of
a count or a verdict, in any case of letters, gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.tables import SPACE, fresh, read, written

#: Statistics that rules may test, each of the columns that statistics() makes.
FEATURES = {
    "mean_word_chars": lambda: F.col("word_chars") / F.col("n_words"),
    "symbol_share": lambda: F.col("n_symbols") / F.col("word_chars"),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.col("n_words"),
    "upper_share": lambda: F.col("n_upper") / F.col("word_chars"),
    "mark_share": lambda: F.col("n_marks") / F.col("n_words"),
    "twice_share": lambda: F.col("n_twice") / F.col("n_words"),
    "distinct_share": lambda: F.col("n_distinct") / F.col("n_words"),
    "words": lambda: F.col("n_words").cast("double"),
}


#: Columns that statistics(), _features() and apply() make.
COUNTS = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_twice", "n_distinct", "base_failed", "rule", "kept", *FEATURES}


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]

    def column(self) -> Column:
        out = self.literals[0].column()
        for x in self.literals[1:]:
            out = out & x.column()
        return out


def statistics(docs: DataFrame, text_col="text") -> DataFrame:
    """docs without the text, with the counts of each text.

    Repeated windows: the hash of the three words of a window and the window's start are packed
    into one number; in sorted order equal windows are neighbours, and their words are compared.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the text alone beside the other columns, which are one struct: no name of theirs can clash
    others = [c for c in docs.columns if c != text_col and c.lower() not in COUNTS]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias(fresh(docs, "one"))).alias("_others"), text.alias("_text"))
    out = out.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # for n words and b bits for a start: the hash's upper bits, then the start
    out = out.withColumn("_bits", F.length(F.bin("n_words")))
    word = lambda i: F.get(F.col("_words"), i)
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    packed = F.transform(starts, lambda i: F.call_function("shiftleft", F.xxhash64(word(i), word(i + 1), word(i + 2)), F.col("_bits")).bitwiseOR(i.cast("long")))
    out = out.withColumn("_packed", F.sort_array(packed))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1

    def same(x, y):
        p, q = x.bitwiseAND(F.col("_mask")).cast("int"), y.bitwiseAND(F.col("_mask")).cast("int")
        close = F.call_function("shiftright", x, F.col("_bits")) == F.call_function("shiftright", y, F.col("_bits"))
        return F.coalesce(close & (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2)), F.lit(False))

    out = out.withColumn("_mask", mask)
    found = F.filter("_packed", lambda x, i: same(x, F.get(F.col("_packed"), i + 1)) | same(x, F.get(F.col("_packed"), i - 1)))
    out = out.withColumn("_found", F.sort_array(F.transform(found, lambda x: x.bitwiseAND(F.col("_mask")))))
    reach = F.transform(F.col("_found"), lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(F.col("_found"), i + 1) - p, F.lit(3).cast("long"))))
    count = lambda pattern: F.regexp_count(F.col("_text"), F.lit(pattern)).cast("long")
    out = out.select(
        *[F.col(f"_others.`{c}`").alias(c) for c in others],
        "n_words",
        (F.length("_text") - F.size(F.split("_text", SPACE)) + 1).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[!?]").alias("n_marks"),
        count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?=[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D]))").alias("n_twice"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[F.when(F.col("n_words") > 0, make()).otherwise(0.0).alias(name) for name, make in FEATURES.items()])


def learn(stats: DataFrame, bad_col="bad", bins=32, max_rules=8, max_literals=3, min_precision=0.9, min_share=0.005) -> list[Rule]:
    """A decision list of rules for bad rows. stats: a table with the columns FEATURES, bad_col and _fold (0, 1 grow; 2 prunes)."""
    names = list(FEATURES)
    # exact quantiles of up to 100,000 rows, so that the partitions have no say in the rules
    row = stats.agg(F.sum(F.col(bad_col).cast("int")).alias("bad"), F.count("*").alias("n"), *[F.percentile_approx(c, [i / bins for i in range(bins + 1)], 100_000).alias(c) for c in names]).first()
    if not row["bad"] or row["bad"] == row["n"]:
        return []
    # thresholds lie halfway between the values that stand at neighbouring quantiles
    values = {c: sorted(set(row[c])) for c in names}
    cuts = {c: [(a + b) / 2 for a, b in zip(v, v[1:])] for c, v in values.items()}
    binned = stats
    for c in names:  # bin i holds the values above i of the cuts
        value = F.col(c)
        binned = binned.withColumn(f"_bin_{c}", sum(((value > x).cast("int") for x in cuts[c]), F.lit(0)))
    binned = written(binned, "binned").coalesce(2)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_bin_{c}").alias("bin")) for c in names])).alias("p")
    left, rules = binned, []
    grow, prune = F.col("_fold") < 2, F.col("_fold") == 2
    for _ in range(max_rules):
        literals: list[Literal] = []
        covered = left.filter(grow)
        for _ in range(max_literals):
            counts = covered.select(pairs, F.col(bad_col)).groupBy("p.feature", "p.bin").agg(F.count_if(bad_col).alias("bad"), F.count_if(~F.col(bad_col)).alias("good")).collect()
            found = _best_literal(counts, cuts)
            if found is None:
                break
            literals.append(found[0])
            covered = covered.filter(found[0].column())
            if found[1] == 0:
                break
        if not literals:
            break
        prefixes = [Rule(tuple(literals[: i + 1])) for i in range(len(literals))]
        got = left.filter(prune).agg(*[F.count_if(r.column() & F.col(bad_col)).alias(f"p{i}") for i, r in enumerate(prefixes)], *[F.count_if(r.column() & ~F.col(bad_col)).alias(f"n{i}") for i, r in enumerate(prefixes)]).first()
        worth = [(got[f"p{i}"] - got[f"n{i}"]) / max(1, got[f"p{i}"] + got[f"n{i}"]) for i in range(len(prefixes))]
        best = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        p, n = got[f"p{best}"], got[f"n{best}"]
        if p < max(2, min_share * row["bad"] / 3) or p < min_precision * (p + n):
            break
        rules.append(prefixes[best])
        left = left.filter(~prefixes[best].column())
    return rules


def _best_literal(counts, cuts) -> tuple[Literal, int] | None:
    """The literal with the greatest gain p * (log2 p/(p+n) - log2 P/(P+N)), from counts by statistic and bin."""
    best = None
    for c in sorted(cuts):
        by = {r["bin"]: (r["bad"], r["good"]) for r in counts if r["feature"] == c}
        bad, good = sum(x for x, _ in by.values()), sum(x for _, x in by.values())
        if not bad or not good:
            return None
        low_p = low_n = 0
        for i, cut in enumerate(cuts[c]):
            low_p, low_n = low_p + by.get(i, (0, 0))[0], low_n + by.get(i, (0, 0))[1]
            for above, p, n in ((True, bad - low_p, good - low_n), (False, low_p, low_n)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Literal(c, above, cut), n)
    return best and best[1:]


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, else null: an ordered conditional expression."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        out = F.when(r.column(), i + 1).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int, seed=3) -> DataFrame:
    """id, bad, _fold of at most about max_labelled labelled ids, taken by hash."""
    n = labels.count()
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20))
    few = labels.filter(part < int(min(1.0, max_labelled / max(1, n)) * (1 << 20)))
    few = few.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return few.select("doc_id", (F.col("quality") == 0).alias("bad"), F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(3)).alias("_fold"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled=10_000) -> list[Rule]:
    few = labelled_sample(docs, labels, max_labelled)
    # at most max_labelled ids, so the sample is small whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # a filter on the statistics would be pushed below them and work them out anew for each use
    table = written(_features(statistics(rows)).select("bad", "_fold", "base_failed", *FEATURES), "labelled")
    return learn(table.filter(~F.col("base_failed")))


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics of every document, base_failed, rule (number of the rule that rejects it) and kept."""
    out = _features(statistics(docs)).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, read(spark, sf_dir, "labels"))
    return apply(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
