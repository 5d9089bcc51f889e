"""Typed citations, adverse signals, rule order, texts, budgets, faces."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.functions import answers, text
from attesta.operators import audit, budget, evaluation, faces, rules

SIGNALS = "verification_id string, signal_id string, tipo string, valor string, disponible boolean, motivo_indisponible string"


def signal_rows(spark, values, v="v"):
    kind = lambda s: "count" if "sharpness" in s or "missing" in s else "score" if "glare" in s else "flag" if s in ("mrz.readable", "mrz.checks_ok", "document.expired", "document.dates_coherent") else "text"
    return spark.createDataFrame([(v, s, kind(s), x, x is not None, None if x is not None else "no") for s, x in values.items()], SIGNALS)


@pytest.mark.parametrize(
    "kind,actual,cited,ok",
    [("score", "0.700", "0.689", True), ("score", "0.700", "0.688", False), ("count", "2", "2.0", True), ("count", "2", "nan", False), ("flag", "true", "True", True), ("text", "JUAN  Ossá", "juan ossa", True), ("text", "a", "b", False), ("score", "0.7", "x", False), ("score", "0.7", "1_000", False)],
)
def test_typed_match(spark, kind, actual, cited, ok):
    df = spark.createDataFrame([(kind, actual, cited)], "k string, a string, c string")
    assert df.select(audit.typed_match(F.col("k"), F.col("a"), F.col("c"))).first()[0] is ok


def test_audit_keeps_places(spark):
    s = signal_rows(spark, {"mrz.checks_ok": "true", "ocr.birth_date": None})
    g = spark.createDataFrame([("v", 0, "mrz.checks_ok", "true"), ("v", 1, "mrz.checks_ok", "false"), ("v", 2, "no", "1"), ("v", 3, "ocr.birth_date", "no disponible"), ("v", 4, "ocr.birth_date", "2029-04-12"), ("v", 5, "mrz.checks_ok", None), ("v", 6, "ocr.birth_date", None)], "verification_id string, orden int, signal_id string, cited_value string")
    got = [r.status for r in audit.audit_citations(g, s).orderBy("orden").collect()]
    assert got == ["valid", "value_mismatch", "unknown_signal", "valid", "unavailable_signal", "missing_cited_value", "unavailable_signal"]


CLEAN = {"mrz.readable": "true", "quality.front_sharpness": "1000", "quality.front_glare": "0.1", "ocr.fields_missing": "0", "mrz.checks_ok": "true", "document.expired": "false", "cross.nuip": "match"}


@pytest.mark.parametrize(
    "change,decision,rule",
    [({}, "approve", "approve"), ({"mrz.readable": "false", "mrz.checks_ok": None}, "request_resubmission", "mrz.readable"), ({"quality.front_sharpness": "299", "cross.nuip": "mismatch"}, "request_resubmission", "quality.front_sharpness"), ({"quality.front_glare": "0.81"}, "request_resubmission", "quality.front_glare"),
     ({"ocr.fields_missing": "1", "cross.nuip": "mismatch"}, "request_resubmission", "ocr.fields_missing"), ({"mrz.checks_ok": "false"}, "reject", "mrz.checks_ok"), ({"cross.nuip": "mismatch", "document.expired": "true"}, "reject", "cross"), ({"document.expired": "true"}, "reject", "document.expired"), ({"document.expired": None}, "approve", "approve")],
)
def test_rule_order(spark, change, decision, rule):
    r = rules.decided(rules.widened(signal_rows(spark, CLEAN | change))).first()
    assert (r.decision, r.rule) == (decision, rule)


def test_completeness(spark):
    s = signal_rows(spark, {"cross.nuip": "mismatch", "mrz.checks_ok": "false", "document.expired": "true", "document.dates_coherent": None, "cross.sex": "front_missing"})
    g = spark.createDataFrame([("v", "mrz.checks_ok")], "verification_id string, signal_id string")
    assert sorted(r.signal_id for r in audit.omitted(s, g).collect()) == ["cross.nuip", "document.expired"]


@pytest.mark.parametrize("raw,day,place", [("14 ENE 1998 O+", dt.date(1998, 1, 14), None), ("32 ENE 1998", None, None), ("14 XXX 1998", None, None), ("21 ENE 2016, BELLO", dt.date(2016, 1, 21), "BELLO"), (None, None, None)])
def test_spanish_dates(spark, raw, day, place):
    df = spark.createDataFrame([(raw,)], "r string")
    assert tuple(df.select(text.spanish_date(F.col("r")), text.place_after_comma(F.col("r"))).first()) == (day, place)


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("JOSÉ LUIS", "JOSE LU", ""), ("ANA", "EVA", "")], "a string, b string, c string")
    got = df.select(text.names_agree(F.col("a"), F.col("b")), text.names_agree(F.col("a"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False)]
    assert df.select(text.nuip_digits(F.lit("NUIP 1.234.567.890")), text.nuip_printed(F.lit("1234567890"))).first()[:] == ("1234567890", "1.234.567.890")


@pytest.mark.parametrize(
    "body,violation",
    [("no", "not_json"), ('{"decision": "maybe"}', "decision"), ('{"decision": "approve", "summary": "una razon larga", "groundings": []}', "groundings"),
     ('{"decision": "approve", "summary": "una razon larga", "groundings": [{"signal_id": "a", "cited_value": "1", "weight": "against", "text": "diez letras"}]}', "approve_without_favor"),
     ('{"decision": "reject", "summary": "una razon larga", "groundings": [{"signal_id": "a", "cited_value": "1", "weight": "in_favor", "text": "diez letras"}]}', "all_in_favor"),
     ('{"decision": "approve", "summary": "una razon larga", "groundings": [{"signal_id": "a", "cited_value": "1", "weight": "in_favor", "text": "diez letras"}]}', None)],
)
def test_contract(spark, body, violation):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(answers.decision_or_violation(F.col("b")).alias("d")).first().d.violation == violation


def test_quota_day_turns_at_pacific_midnight(spark):
    df = spark.sql("select timestamp_ntz'2026-09-15 00:00:29' a, timestamp_ntz'2026-09-15 07:00:01' b")
    assert tuple(df.select(answers.quota_day(F.col("a")), answers.quota_day(F.col("b"))).first()) == (dt.date(2026, 9, 14), dt.date(2026, 9, 15))


def test_balance_never_below_zero(spark):
    rows = [("d", "a", "m", i, i, x) for i, x in enumerate([-1, 1, 1, -1, -1, -1, 1])]
    got = budget.balances(spark.createDataFrame(rows, "day string, account string, model string, ts int, event_id int, delta int")).orderBy("ts").collect()
    assert [r.balance for r in got] == [0, 1, 2, 1, 0, 0, 1]


def test_holdout_needs_final_measurement():
    assert evaluation.check_access("calibration") == "calibration"
    with pytest.raises(PermissionError):
        evaluation.check_access("holdout")
    with pytest.raises(ValueError):
        evaluation.check_access("other", final_measurement=True)


def test_faces(spark):
    f = spark.createDataFrame([("p", 1, 180, 200, 0.9), ("p", 2, 100, 100, 0.9), ("q", 3, 100, 90, 0.9), ("q", 4, 90, 90, 0.9), ("r", 5, 50, 50, 0.1)], "photo string, face_id int, width int, height int, det_score double")
    got = {r.photo: (r.face_id, r.side, r.reason) for r in faces.chosen_face(f, allow_ghost=True).collect()}
    assert got == {"p": (1, 180, None), "q": (None, None, "comparable_faces"), "r": (None, None, "no_face")}
    assert {r.photo: r.reason for r in faces.chosen_face(f).collect()}["p"] == "comparable_faces"
    e = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [1.0, 0.0])], "photo long, identity int, embedding array<float>").withColumn("is_document", F.col("photo") != 2)
    assert [round(r.similarity, 6) for r in faces.genuine_pairs(e).collect()] == [0.0]
    r = faces.impostor_stats(e, 3).first()
    assert (r.n, r.least, r.most) == (2, 0.0, 1.0)
