"""Card fronts read in a capture's own row: nothing is exchanged, and odd words are read as the rows of words were."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.operators import front
from attesta.plans import flows, queries_measures, queries_registry

WORDS = "capture_id string, word_id int, text string, conf double, left int, top int, width int, height int"


@pytest.mark.parametrize("name", ["jn10_ag9_front_scores", "ag9_condition_by_field"])
def test_scores_exchange_their_counts_alone(spark, sf, name):
    """Words and fields stay in their row; before, they were dealt out, sorted and joined by capture several times."""
    query = (queries_measures.ENTRIES | queries_registry.ENTRIES)[name][0]
    plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan


def test_words_out_of_order(spark):
    """A torn label is none, blank and doubtful words are left out, the nearest row below counts, gaps are filled by order."""
    words = [
        (9, " Apellidos ", 90.0, 330, 126, 72, 12), (1, "ROJAS", 80.0, 390, 152, 50, 16), (2, "OSSA", 90.0, 330, 150, 40, 16), (3, "TARDE", 90.0, 330, 175, 50, 16), (4, " ", 90.0, 300, 150, 10, 16), (5, "NO", -1.0, 300, 150, 10, 16),
        (6, "Fecha de", 90.0, 330, 336, 60, 12), (7, "nacimiento", 90.0, 396, 336, 80, 12), (8, "14", 90.0, 330, 360, 20, 16), (10, "ENE", 90.0, 356, 360, 30, 16), (11, "1998", 90.0, 392, 360, 40, 16), (12, "NUIP", 70.0, 614, 88, 32, 12), (13, "1.234.567.890", 70.0, 652, 88, 130, 16),
    ]
    df = spark.createDataFrame([("c", *w) for w in words] + [("d", 1, None, 90.0, 0, 0, 1, 1)], WORDS)
    got = {(r["field"], r["value"], r["confidence"], r["source"]) for r in front.read_front(df.orderBy(F.desc("word_id"))).collect()}
    # "Fecha de" is one word with a blank, so the label's three words are not there
    assert got == {("surnames", "OSSA ROJAS", 0.85, "label"), ("nuip", "1.234.567.890", 0.7, "label"), ("birth_date", "14 ENE 1998", 0.9, "order"), ("given_names", "TARDE", 0.9, "order")}


@pytest.mark.parametrize("name", ["jn10_ag9_front_scores", "ag9_condition_by_field", "wn1_wn4_jn9_front_fields", "ag10_confidence"])
def test_fronts_are_read_without_the_zone(spark, sf, name):
    """Before, every zone was built, read and stored for what stands on the front, and words were read by expressions interpreted word after word."""
    before = dict(flows._stages)
    flows._stages.clear()
    try:
        plan = (queries_measures.ENTRIES | queries_registry.ENTRIES)[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert [k[-1] for k in flows._stages] == ["fronts"] and "ArrowEvalPython" in plan
    finally:
        flows._stages.update(before)


def test_words_stand_after_one_another(spark, sf):
    sets = queries_measures.word_sets(spark, sf, "front_surnames", "k").filter("ok < 200").collect()
    for r in sets:
        of = lambda n: [w for w in r.words if w.word_id // 100 == n]
        at = 330
        for w, text in zip(of(1), r.front_surnames.split(" "), strict=True):
            assert (w.text, w.left, w.width, w.top) == (text, at, 10 * len(text), 150 + r.ok % 5)
            at += w.width + 6
        # Fecha de expiracion
        assert [w.left for w in of(18)] == ([] if r.k == 15 else [330, 330 + 46, 330 + 46 + 22])
        assert len({w.word_id for w in r.words}) == len(r.words)


def test_a_batch_with_gaps():
    """No array, no words, words of one place and id, half a mean's last place, a later row in the label's column."""
    word = lambda i, text, conf, left, top, width=40, height=12: dict(zip(front.WORD, (i, text, conf, left, top, width, height), strict=True))
    labels = [word(1, "Sexo", 90.0, 300, 100), word(2, "NUIP", 90.0, 600, 100), word(3, "Nombres", 90.0, 300, 200, 70)]
    values = [word(4, "M", 80.00005, 300, 125), word(4, "M", 80.0001, 300, 125), word(5, "far", 70.0, 900, 126), word(6, "1.234.567", 60.0, 650, 100), word(7, "ANA", 50.0, 300, 259), word(8, "EVA", 50.0, 300, 275)]
    kind = pa.list_(pa.struct([("word_id", pa.int32()), ("text", pa.string()), ("conf", pa.float64()), *[(c, pa.int32()) for c in front.WORD[3:]]]))
    got = front.read_batch(pa.array([None, labels + values, [], [word(1, "x", None, 1, 1)], values[::-1] + labels[::-1]], kind).slice(0), 1012).to_pylist()
    want = [
        {"field": "given_names", "value": "ANA", "confidence": 0.5, "source": "label"}, {"field": "sex", "value": "M M", "confidence": 0.800001, "source": "label"}, {"field": "nuip", "value": "1.234.567", "confidence": 0.6, "source": "label"},
        {"field": "surnames", "value": "ANA", "confidence": 0.5, "source": "order"},
    ]
    assert got == [None, want, [], [], want]
    assert front.read_batch(pa.array([None, labels + values], kind).slice(1), 1012).to_pylist() == [want]
