"""Jobs that keep the registry: streams that restart, stored tables, reports."""

from __future__ import annotations

import collections
import datetime as dt
import hashlib
import itertools
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import budget, constraints, evaluation, faces, registry
from attesta.sources import captures
from attesta.streaming import jobs

LOG = "ts timestamp_ntz, event_id long, account string, model string"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def day(d, h=20):
    return dt.datetime(2024, 1, d, h)


def count(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run = jobs.start_counts_table(spark.readStream.schema(LOG).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/log")
    run.awaitTermination()
    return run, sorted(tuple(r) for r in jobs.counts_table(spark, f"{folder}/out").select("day", "account", "model", "spent").collect())


def test_counter_merges_restarts_and_forgets(spark, folder):
    d = {i: dt.date(2024, 1, i) for i in range(1, 32)}
    _, got = count(spark, folder, [(day(2), 1, "a", "m"), (day(2), 2, "a", "m"), (day(3), 3, "a", "m"), (day(3), 4, "b", "m"), (None, 5, "a", "m")])
    assert got == [(d[2], "a", "m", 2), (d[3], "a", "m", 1), (d[3], "b", "m", 1)]
    # goes on within the open day, adds a group to it, and opens another
    _, got = count(spark, folder, [(day(3), 6, "a", "m"), (day(3), 7, "c", "m"), (day(9), 8, "a", "m")])
    assert got == [(d[2], "a", "m", 2), (d[3], "a", "m", 2), (d[3], "b", "m", 1), (d[3], "c", "m", 1), (d[9], "a", "m", 1)]
    # nothing new
    _, again = count(spark, folder, [])
    assert again == got
    run, got = count(spark, folder, [(day(20), 9, "a", "m")])
    assert got[-1] == (d[20], "a", "m", 1) and len(got) == 6
    # closed days are in the table, and no longer in the state
    assert min(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 2


def test_a_batch_of_counts_that_runs_again(spark, folder):
    spark.createDataFrame([], jobs.MANIFEST).write.parquet(f"{folder}/manifest/number=-1")
    rows = lambda *r: spark.createDataFrame(r, "day date, account string, model string, spent long")
    d = dt.date(2024, 1, 2)
    jobs.merge_counts(rows((d, "a", "m", 2), (d, None, "m", 1)), folder, 0)
    for _ in range(2):
        jobs.merge_counts(rows((d, "a", "m", 5), (dt.date(2024, 1, 3), "a", "m", 1)), folder, 1)
    jobs.merge_counts(rows(), folder, 2)
    got = sorted((tuple(r) for r in jobs.counts_table(spark, folder).select("day", "account", "spent").collect()), key=str)
    assert got == sorted([(d, "a", 5), (d, None, 1), (dt.date(2024, 1, 3), "a", 1)], key=str)


REQUESTS = "verification_id string, body string, received timestamp"


def parts(rows):
    return {"head": rows.select("verification_id", "body", F.col("received").cast("date").alias("creado_dia")), "letters": rows.select("verification_id", F.explode(F.split("body", "")).alias("letter"))}


def send(spark, folder, rows):
    spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    jobs.start_registry_intake(spark.readStream.schema(REQUESTS).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/log", parts).awaitTermination()
    return sorted(r.verification_id for r in jobs.recorded(spark, f"{folder}/out", "head").collect()), jobs.recorded(spark, f"{folder}/out", "letters").count()


def test_intake_records_a_request_once(spark, folder):
    assert send(spark, folder, [("a", "xy", day(1)), ("b", "z", day(1)), ("b", "z", day(1)), (None, "q", day(1)), ("t", "q", None)]) == (["a", "b"], 3)
    # sent again after a restart, with new ones
    assert send(spark, folder, [("a", "xy", day(1, 22)), ("c", "", day(2, 1))]) == (["a", "b", "c"], 4)
    assert send(spark, folder, []) == (["a", "b", "c"], 4)


def test_intake_batch_that_runs_again_or_stops(spark, folder):
    rows = lambda *r: spark.createDataFrame(r, REQUESTS)
    for _ in range(2):
        jobs.intake_batch(rows(("a", "xy", day(1))), folder, 0, parts)
    assert jobs.recorded(spark, folder, "head").count() == 1 and jobs.recorded(spark, folder, "letters").count() == 2

    def stops(r):
        yield "head", parts(r)["head"]
        raise RuntimeError

    class Torn(dict):
        def items(self):
            return stops(self["r"])

    with pytest.raises(RuntimeError):
        jobs.intake_batch(rows(("b", "xy", day(2))), folder, 1, lambda r: Torn(r=r))
    # what was written without a commit is not seen, and the next run replaces it
    assert jobs.recorded(spark, folder, "head").count() == 1
    jobs.intake_batch(rows(("b", "xy", day(2))), folder, 1, parts)
    assert jobs.recorded(spark, folder, "head").count() == 2 and jobs.recorded(spark, folder, "letters").count() == 4


# Faces
def photos_of(spark, sizes, dims=4, seed=1):
    rng = np.random.default_rng(seed)
    who = [k for k, n in enumerate(sizes) for _ in range(n)]
    v = rng.normal(size=(len(who), dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return spark.createDataFrame([(i, w, [float(x) for x in v[i]]) for i, w in enumerate(who)], "photo long, identity long, embedding array<double>").repartition(3), who, v


@pytest.mark.parametrize("together", [20, 10_000])
def test_a_large_identity_is_spread(spark, together):
    photos, who, v = photos_of(spark, [300, 1, 2, 25])
    got = faces.genuine_pairs(photos, together)
    want = {(who[i], i, j): v[i] @ v[j] for i in range(len(who)) for j in range(i + 1, len(who)) if who[i] == who[j]}
    rows = got.collect()
    assert len(rows) == len(want) and all(r.similarity == pytest.approx(want[r.identity, r.a, r.b]) for r in rows)
    if together == 20:
        # 15 blocks make 120 groups of pairs: no partition has most of them
        by = [r["count"] for r in got.hint("shuffle_hash").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
        assert len(by) > 1 and max(by) < 0.6 * len(rows)
    links = collections.defaultdict(list)
    for (w, i, j), x in want.items():
        if x > 0.9:
            links[w, i].append(j), links[w, j].append(i)
    assert {(r.identity, r.photo): (r.links, r["first"]) for r in faces.near_links(photos, 0.9, together, 90).collect()} == {k: (len(v), min(v)) for k, v in links.items()}
    near = {(r.identity, r.a, r.b) for r in faces.near_identical(photos, 0.9, together).collect()}
    assert near == {k for k, s in want.items() if s > 0.9} and near


def test_statistics_by_kind_and_variant(spark, monkeypatch):
    monkeypatch.setattr(faces, "BLOCK", 30)
    photos, who, v = photos_of(spark, [40, 3, 1, 17, 60])
    first = {w: who.index(w) for w in set(who)}
    shown = {name: {w: v[i] * f for w, i in first.items()} for name, f in (("document", 0.9), ("degraded", 0.5))}
    documents = spark.createDataFrame([(w, name, [float(x) for x in e]) for name, by in shown.items() for w, e in by.items()] + [(None, "document", [1.0] * 4), (0, "document", None)], "identity long, variant string, embedding array<double>")
    some = photos.unionByName(spark.createDataFrame([(900, None, [1.0] * 4), (901, 1, None)], photos.schema))
    values = collections.defaultdict(list)
    for i, j in itertools.combinations(range(len(who)), 2):
        values["genuine" if who[i] == who[j] else "impostor", "raw"].append(v[i] @ v[j])
        if who[i] == who[j]:
            for name in shown:
                values["genuine", name].append(shown[name][who[i]] @ v[j])
    for name, by in shown.items():
        for w, e in by.items():
            values["impostor", name] += [e @ v[j] for j in range(len(who)) if who[j] != w]
    got = {(r.kind, r.variant): r for r in faces.similarity_stats(some, documents).collect()}
    assert got.keys() == values.keys()
    for k, s in values.items():
        assert got[k].n == len(s) and (got[k].least, got[k]["mean"], got[k].most) == pytest.approx((min(s), sum(s) / len(s), max(s)), abs=2e-6)
    assert faces.similarity_stats(photos.limit(0), documents.limit(0)).count() == 0


# Tables stored by verification
def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_registry_needs_no_exchange(spark, sf, folder):
    from attesta.operators import audit, registry
    from attesta.plans import queries_registry as Q

    name = f"t_{uuid.uuid4().hex}"
    made = Q.registry_of(spark, sf)
    registry.store(made, name, folder, 8)
    t = registry.stored(spark, name)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = t["verificacion_fundamentos"].select("verification_id", "orden", "signal_id", "cited_value")
        again, records = audit.audit_citations(g, t["verificacion_senales"]), registry.full_records(t)
        for df in (again, records):
            assert "Exchange" not in plan_of(df) and "SortMergeJoin" in plan_of(df)
        assert "Exchange" in plan_of(registry.full_records(made))
        kept = t["verificacion_fundamentos"].select("verification_id", "orden", "status")
        assert again.select("verification_id", "orden", "status").exceptAll(kept).count() == 0 and again.count() == kept.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for n in registry.TABLES:
            spark.sql(f"drop table {name}_{n}")


HEAD = "verification_id string, outcome string, decision string, faithful boolean, complete boolean, creado_dia date"


def test_summary_of_one_scan(spark, folder):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    rows = [("a", "decided", "approve", True, True, d1), ("b", "decided", "approve", False, True, d1), ("c", "malformed", None, False, False, d2), ("d", "decided", None, None, None, None)]
    spark.createDataFrame(rows, HEAD).write.parquet(f"{folder}/head")
    out = registry.summary_sets(spark.read.parquet(f"{folder}/head"))
    assert plan_of(out).count("FileScan") == 1
    got = {(r.level, r.value): tuple(r)[2:] for r in out.collect()}
    assert got["total", None] == (4, 1, 3, 1, 2) and got["decision", "approve"] == (2, 0, 2, 1, 2) and got["decision", None] == (2, 1, 1, 0, 0)
    assert got["outcome", "malformed"] == (1, 1, 0, 0, 0) and got["day", "2024-01-01"][0] == 2 and got["day", None][0] == 1
    for level in ("decision", "outcome", "day"):
        assert sum(v[0] for (name, _), v in got.items() if name == level) == 4


def test_constraints_are_counted_with_their_rows(spark):
    s = spark.createDataFrame(
        [("v", "a", "text", "1", True, None), ("v", "a", "text", "1", True, None), ("v", "b", "odd", None, False, None), ("w", "c", None, "1", True, "m"), (None, None, "flag", None, True, "m")],
        "verification_id string, signal_id string, tipo string, valor string, disponible boolean, motivo_indisponible string",
    )
    counts, rows = constraints.suite(spark, {"signals": (s, ("verification_id", "signal_id"), constraints.signal_rules()), "none": (s.limit(0), ("signal_id",), constraints.signal_rules())})
    got = {(r.table, r.rule): (r.rows, r.violations) for r in counts.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "signals"} == {"value_and_reason": (5, 1), "neither_value_nor_reason": (5, 1), "available_without_value": (5, 1), "unknown_kind": (5, 2), "one_signal": (5, 1)}
    assert all(v == (0, 0) for k, v in got.items() if k[0] == "none")
    want = [("available_without_value", "null/null", 1), ("neither_value_nor_reason", "v/b", 1), ("one_signal", "v/a", 2), ("unknown_kind", "v/b", 1), ("unknown_kind", "w/c", 1), ("value_and_reason", "w/c", 1)]
    assert sorted(tuple(r)[1:] for r in rows.collect()) == want
    c = spark.createDataFrame([("x", "reject", "r" * 200, False, False), ("y", "approve", "r" * 150, True, True), ("z", "approve", None, False, True)], "id string, expected_decision string, reason string, ambiguous boolean, detectable boolean")
    got = {r.rule: r.violations for r in constraints.suite(spark, {"cases": (c, ("id",), constraints.case_rules())})[0].collect()}
    assert got == {"undetectable_not_approved": 1, "reason_too_short": 1, "disputed_reason_too_short": 1, "one_case": 0}


# Reports
def test_facial_hits_of_both_definitions(spark):
    cases = spark.createDataFrame([("a", "legit", "approve", "approve"), ("b", "impersonation", "escalate_to_human", "approve"), ("c", "impersonation", "reject", "approve")], "case_id string, kind string, expected string, rule_decision string")
    readings = spark.createDataFrame([("a", 100, 0.7, None), ("a", 300, None, "no_face"), ("b", 50, None, "x"), ("b", 90, None, "y")], "case_id string, side int, similarity double, reason string")
    runs = spark.createDataFrame([("a", "m", "decided", "approve", True), ("b", "m", "malformed", None, False), ("c", "m", "unavailable", None, None)], "case_id string, model string, outcome string, decision string, faithful boolean")
    judged = evaluation.facial_cases_judged(cases, readings, runs)
    got = {r.case_id: r for r in judged.collect()}
    assert (got["a"].similarity, got["a"].reason, got["a"].strict_hit) == (0.7, None, True)
    assert (got["b"].similarity, got["b"].reason, got["b"].hit, got["b"].strict_hit) == (None, "y", True, False)
    assert (got["c"].got, got["c"].hit, got["c"].similarity) == (None, False, None)
    assert tuple(evaluation.facial_totals(judged).first()) == ("m", 1, 2, 2, 2, 1, 1, 1, 2)


def test_first_of_each_is_bounded_before_the_exchange(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o")).repartition(4)
    out = evaluation.first_of_each(rows, "g", "o", 2)
    assert plan_of(out).count("WindowGroupLimit") == 2
    assert sorted((r.g, r.o) for r in out.collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]


def test_models_and_rules_measured(spark):
    runs = spark.createDataFrame([("a", "m1", "decided", "approve", "approve"), ("a", "m2", "malformed", None, "approve"), ("b", "m1", "unavailable", None, "reject"), ("b", "m2", "decided", "reject", "reject")], "verification_id string, model string, outcome string, decision string, expected string")
    assert sorted(map(tuple, evaluation.model_hits(runs).collect())) == [("m1", 1, 1, 0), ("m2", 2, 1, 1)]
    assert [tuple(r) for r in evaluation.differing_cases(runs).collect()] == [("a", 2, 2)]
    cases = spark.createDataFrame([("a", "holdout", "approve", "approve", "approve", True), ("b", "holdout", "reject", "approve", "approve", False)], "verification_id string, split string, expected string, decision string, rule string, faithful boolean")
    assert sorted(map(tuple, evaluation.rules_measured(cases).collect())) == [("holdout", "TOTAL", 2, 1, 1), ("holdout", "approve", 1, 1, 1), ("holdout", "reject", 1, 0, 0)]
    assert [tuple(r) for r in evaluation.rule_failures(cases).collect()] == [("b", "holdout", "reject", "approve", "approve")]


def test_legacy_slot_counts_for_every_account(spark):
    d = dt.date(2024, 1, 1)
    a = spark.createDataFrame([(d, "x", "m")] * 3 + [(d, "y", "m")] * 2 + [(d, None, "m")] * 4 + [(d, None, "n")], "day date, account string, model string")
    got = {(r.account, r.model): (r.spent, r.legacy, r.remaining, r.by_others) for r in budget.spent_with_legacy(a, 6).collect()}
    assert got == {("x", "m"): (7, 4, 0, 2), ("y", "m"): (6, 4, 0, 3), (None, "n"): (1, 1, 5, 0)}
    assert {r.remaining for r in budget.spent_with_legacy(a).collect()} == {None}


# Files
def test_files_as_rows(spark, tmp_path):
    for name, content in (("a", b"x" * 10), ("b", b""), ("c", b"y" * 11), ("d", b"z" * 9)):
        (tmp_path / f"capture={name}").mkdir()
        (tmp_path / f"capture={name}" / "f.jpg").write_bytes(content)
    hashes = captures.capture_hashes(spark, str(tmp_path), 10)
    got = {r.capture: (r.length, r.sha256, r.reject_reason) for r in hashes.collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    # the lengths are looked at before the bytes; a file without bytes is not there
    assert plan_of(hashes).count("LessThanOrEqual(length,10)") + plan_of(hashes).count("GreaterThan(length,10)") == 2
    assert got == {"a": (10, sha(b"x" * 10), None), "c": (11, None, "too_large"), "d": (9, sha(b"z" * 9), None)}


def test_responses_by_key(spark, tmp_path):
    keys = {n: hashlib.sha256(n.encode()).hexdigest() for n in ("ok", "torn", "empty", "other")}
    for n, k in keys.items():
        at = tmp_path / f"prefix={k[:2]}" / f"key={k}"
        at.mkdir(parents=True)
        (at / "r.json").write_text({"torn": '{"model": "m", "respon', "empty": '{"model": "m"}'}.get(n, '{"model": "m",\n "response": "yes"}'))
    wanted = spark.createDataFrame([(keys[n],) for n in ("ok", "torn", "empty")] + [("0" * 64,), (None,)], "key string")
    assert [(r.key, r.response) for r in captures.responses_for(spark, str(tmp_path), wanted).collect()] == [(keys["ok"], "yes")]


def test_stages_follow_their_tables(spark, tmp_path):
    from attesta.plans import flows

    sf = str(tmp_path)
    spark.range(3).write.parquet(f"{sf}/orders.parquet")
    spark.range(1).write.parquet(f"{sf}/customer.parquet")
    make = lambda: spark.read.parquet(f"{sf}/orders.parquet")
    assert flows.staged(spark, sf, "n", make).count() == flows.staged(spark, sf, "n", lambda: 1 / 0).count() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{sf}/orders.parquet")
    assert flows.staged(spark, sf, "n", make).count() == 5


def test_pairs_of_blocks_equal_the_join(spark):
    """To the last bit, and for faces that are missing, not whole or short. Before, each pair of a large identity was an expression interpreted component after component."""
    photos, _, _ = photos_of(spark, [60, 5], dims=9)
    odd = spark.createDataFrame([(900, 0, None), (901, 0, [1.0, None]), (902, 0, [1.0] * 8), (903, 0, []), (904, 0, []), (None, 0, [1.0]), (905, None, [1.0])], photos.schema)
    photos = photos.unionByName(odd)
    blocks, join = faces.genuine_pairs(photos, 20), faces.genuine_pairs(photos, 10_000)
    assert "FlatMapGroupsInArrow" in blocks._jdf.queryExecution().executedPlan().toString()
    got, want = (sorted(map(repr, map(tuple, df.collect()))) for df in (blocks, join))
    assert got == want and len(want) == 65 * 64 // 2 + 10 and sum("None" in x for x in want) == 65 * 64 // 2 - 60 * 59 // 2 - 1
