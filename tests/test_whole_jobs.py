"""Whole tables and whole texts: what a prefix, a filter or a fixed table would leave out."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pytest

from attesta.operators import evaluation, faces
from attesta.plans import catalog


def plain(text):
    return re.sub(r"[̀-ͯ]", "", unicodedata.normalize("NFKD", text))


def test_texts_differ_after_a_prefix(spark, tmp_path):
    texts = ["Á b  " * 60 + "uno", "Á b  " * 60 + "dos", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.QUERIES["sc13_whole_texts"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts[:3]):
        want = re.sub(r"\s+", " ", plain(t).lower()).strip(" "), re.sub("[^a-z0-9 ]", "", plain(t).lower()).strip(" "), re.sub(" +", " ", re.sub("[^A-Za-z ]", " ", plain(t))).strip(" ").upper()
        assert got[i][1:] == tuple(hashlib.sha256(x.encode()).hexdigest() for x in want)
    assert all(got[0][c] != got[1][c] for c in ("loose", "label", "name")) and got[3].loose is None


def test_zone_names_of_every_verification(spark, sf):
    got = catalog.QUERIES["sc14_zone_names"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_people_beyond_ninety_nine(spark):
    names = [f"front_{n}-{i}.jpg" for n in range(250) for i in range(2)]
    got = faces.numbered_people(spark.createDataFrame([(x,) for x in names], "name string"), pair=True).collect()
    keys = sorted(str(n) for n in range(250))
    want = {(f"persona-{i + 1:02d}", f"front_{k}-1.jpg") for i, k in enumerate(keys)}
    assert len(got) == 250 and {(r.person, r.name) for r in got} == want


def test_every_reading_and_response(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    got = catalog.QUERIES["jn11_all_readings"](spark, sf)
    assert got.count() == orders.count() and got.filter("line is null and marks is null").count() == orders.filter("o_orderkey % 7 <> 0").count()
    assert catalog.QUERIES["io3_all_responses"](spark, sf).distinct().count() == orders.filter("o_orderkey % 16 % 4 <> 0").count()


@pytest.mark.parametrize("documents_only", [False, True])
def test_impostors_in_blocks_and_slices(spark, monkeypatch, documents_only):
    monkeypatch.setattr(faces, "BLOCK", 20)
    v, who = np.random.default_rng(1).normal(size=(300, 4)), [i % 7 for i in range(300)]
    photos = spark.createDataFrame([(i, w, [float(x) for x in v[i]], i < 7) for i, w in enumerate(who)], "photo long, identity int, embedding array<double>, is_document boolean")
    plan = faces.impostor_stats(photos, documents_only=documents_only)
    s = [v[i] @ v[j] for i in range(300) for j in range(300) if who[i] != who[j] and (i < 7 if documents_only else i < j)]
    for got in (plan.first(), faces.impostor_stats(photos, 1, documents_only).first()):
        assert got.n == len(s) and got[1:] == pytest.approx((min(s), sum(s) / len(s), max(s)), abs=2e-6)


def test_a_row_for_each_lost_run(spark):
    runs = spark.createDataFrame([("m1", "a", "unavailable"), ("m1", "b", "unavailable"), ("m2", "a", "decided")], "model string, verification_id string, outcome string")
    assert sorted(map(tuple, evaluation.lost_runs(runs).collect())) == [("m1", "a"), ("m1", "b")]
