"""Verification inputs derived from the given tables, by integer arithmetic only (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import mrz, text

SURNAMES = ("WALTEROS", "OSSA DORIA", "GOMEZ RUIZ", "PEREZ", "ZAPATA MEJIA", "QUINTERO", "BEDOYA SUAREZ", "ARANGO LOPEZ DE VILLAMIZAR")
GIVEN = ("LAURA", "JUAN DIEGO", "ANA MARIA", "SOFIA", "MARIA FERNANDA", "JOSE LUIS")


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _days(day, n):
    return F.date_add(day, n.cast("int") if hasattr(n, "cast") else n)


def applications(spark, sf_dir) -> DataFrame:
    """One verification for each order: true values, and k, what is wrong with it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    # what is derived from an order costs far more than to deal the orders out by their key
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    df = orders.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return df.select(
        ok.alias("ok"), ck.alias("ck"), (ok % 16).cast("int").alias("k"), F.concat(F.lit("case-"), ok).alias("verification_id"),
        (F.lit(1000000000) + ck * 7919).alias("base"), F.lpad(ok.cast("string"), 9, "0").alias("document_number"),
        _days(F.lit("1950-01-01").cast("date"), (ck * 37) % 20000).alias("birth_date"), F.col("day").alias("issue_date"), _days(F.col("day"), 3650).alias("expiry_date"),
        F.when(ck % 2 == 0, "F").otherwise("M").alias("sex"), _pick(SURNAMES, ck % 8).alias("surnames"), _pick(GIVEN, F.floor(ck / 8) % 6).alias("given_names"),
        F.when(ok % 16 == 9, 50 + ok % 100).otherwise(1000 + ok % 2000).cast("double").alias("front_sharpness"),
        F.when(ok % 16 == 10, (81 + ok % 19) / 100).otherwise((ok % 300) / 1000).alias("front_glare"), (1500 + ok % 500).cast("double").alias("back_sharpness"),
    )


def captures(apps: DataFrame) -> DataFrame:
    """Raw strings of the front and the text read from the zone."""
    k, n = F.col("k"), F.col("base") + F.when(F.col("k") == 5, 1).otherwise(0)
    lost = k == 15
    other = lambda c, when, value: F.when(when, value).otherwise(c)
    nuip = F.when(k == 13, F.regexp_replace(n.cast("string"), "^([^0]*)0", "$1O")).otherwise(n.cast("string"))
    expiry = other(F.col("expiry_date"), k == 3, _days(F.col("expiry_date"), 2192))
    df = mrz.with_built_lines(apps, F.col("document_number"), F.col("birth_date"), F.col("sex"), expiry, n.cast("string"), F.col("surnames"), F.col("given_names"))
    m = F.col("middle")
    composite = ((F.substring(m, 30, 1).cast("int") + 1) % 10).cast("string")
    m = F.when(k == 4, F.concat(F.substring(m, 1, 29), composite)).when(k == 12, F.concat(F.substring(m, 1, 15), F.lit("C0L"), F.substring(m, 19, 12))).when(k == 13, F.concat(F.substring(m, 1, 18), F.rpad(nuip, 11, "<"), F.substring(m, 30, 1))).otherwise(m)
    printed = text.spanish_date_printed
    return df.select(
        *apps.columns,
        text.nuip_printed((n + F.when(k == 0, 1).otherwise(0)).cast("string")).alias("front_nuip"),
        F.when(k != 8, printed(other(F.col("birth_date"), k == 1, _days(F.col("birth_date"), 2192)))).alias("front_birth_date"),
        printed(F.col("expiry_date")).alias("front_expiry_date"),
        F.concat(printed(other(F.col("issue_date"), k == 14, _days(F.col("expiry_date"), 30))), F.lit(", BELLO")).alias("front_issue"),
        other(F.col("surnames"), k == 2, F.concat(F.expr("substring(surnames, 1, length(surnames) - 1)"), F.lit("X"))).alias("front_surnames"),
        F.col("given_names").alias("front_given_names"),
        F.when(~lost, other(F.col("sex"), k == 6, F.when(F.col("sex") == "F", "M").otherwise("F"))).alias("front_sex"),
        ((80 + F.col("ok") % 20) / 100).alias("confidence"), F.when(lost, "order").otherwise("label").alias("source"),
        F.when(k != 7, F.concat_ws("\n", F.lit("REPUBLICA"), F.col("upper"), m, F.lower("lower"))).alias("mrz_text"),
    )


def with_expected(df: DataFrame, as_of) -> DataFrame:
    """expected_decision, is_fraud and detectable of applications."""
    k = F.col("k")
    decision = (
        F.when(k.isin(0, 1, 3, 4, 14), "reject").when(k.isin(2, 6), "escalate_to_human").when(k.between(7, 10), "request_resubmission").when(k == 5, "approve")
        .when(F.col("expiry_date") < F.lit(as_of), "reject").when(text.whole_years(F.col("birth_date"), as_of) < 18, "escalate_to_human").otherwise("approve")
    )
    return df.withColumn("expected_decision", decision).withColumn("is_fraud", k.isin(0, 1, 2, 3, 4, 5, 6)).withColumn("detectable", k != 5)


APPS = f"""
apps AS (
  SELECT o_orderkey AS ok, o_custkey AS ck, (o_orderkey % 16)::INT AS k, 'case-' || o_orderkey AS verification_id, 1000000000 + o_custkey * 7919 AS base,
    lpad(o_orderkey::VARCHAR, 9, '0') AS document_number, DATE '1950-01-01' + ((o_custkey * 37) % 20000)::INT AS birth_date,
    o_orderdate::DATE AS issue_date, o_orderdate::DATE + 3650 AS expiry_date, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    ({list(SURNAMES)})[(o_custkey % 8 + 1)::INT] AS surnames, ({list(GIVEN)})[((o_custkey // 8) % 6 + 1)::INT] AS given_names,
    (CASE WHEN o_orderkey % 16 = 9 THEN 50 + o_orderkey % 100 ELSE 1000 + o_orderkey % 2000 END)::DOUBLE AS front_sharpness,
    CASE WHEN o_orderkey % 16 = 10 THEN (81 + o_orderkey % 19) / 100 ELSE (o_orderkey % 300) / 1000 END AS front_glare, (1500 + o_orderkey % 500)::DOUBLE AS back_sharpness
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def answers(wide: DataFrame, *keep) -> DataFrame:
    """verification_id, ok, model, status, body: two models' raw responses, and the columns in keep. wide: captures with a read zone and expected_decision."""
    from attesta.constants import CROSS_FIELDS
    from attesta.operators.signals import prepared

    glare = F.floor(F.round("front_glare", 3) * 100 + 1e-9) / 100
    # what both models are told of a row is worked out once, before the row is doubled
    df = prepared(wide).withColumn("m", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("h", ((F.col("ok") * 31 + F.col("m") * 17) % 20).cast("int"))
    h = F.col("h")
    decision = F.when(h == 2, "approve").when(h.isin(3, 4), "escalate_to_human").otherwise(F.col("expected_decision"))
    said = F.lit("lo que dice la senal citada")

    def cite(signal, value, first=False):
        weight = F.when((decision == "approve") & (h != 2), "in_favor").otherwise("against") if first else F.lit("against")
        return F.struct(F.lit(signal).alias("signal_id"), value.cast("string").alias("cited_value"), weight.alias("weight"), said.alias("text"))

    statuses = {c: F.col(f"cross_{c}") for c in CROSS_FIELDS}
    items = [cite("mrz.checks_ok", F.coalesce(F.col("mrz_checks_ok").cast("string"), F.lit("NO DISPONIBLE")), True), cite("quality.front_glare", glare + F.when(h == 5, 0.05).otherwise(0.0))]
    items += [F.when((s == "mismatch") & (h != 9), cite(f"cross.{c}", F.lit("mismatch"))) for c, s in statuses.items()]
    items += [F.when(h == 6, cite("quality.no_existe", F.lit("1"))), F.when(h == 7, cite("ocr.birth_date", F.lit("2029-04-12"))), F.when(h == 8, cite("cross.nuip", F.lit(None)))]
    answer = F.to_json(F.struct(decision.alias("decision"), F.lit("un resumen de la decision").alias("summary"), F.array_compact(F.array(*items)).alias("groundings")))
    text_ = F.when(h == 1, F.lit("no es JSON")).otherwise(answer)
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text_.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    return df.select("verification_id", "ok", *keep, F.concat(F.lit("m"), "m").alias("model"), F.when(h == 0, 503).otherwise(200).alias("status"), F.when(h != 0, body).alias("body"))


ANSWERS = """
answered AS (
  SELECT b.*, 'm' || m AS model, h, CASE WHEN h = 0 THEN 'unavailable' WHEN h = 1 THEN 'malformed' WHEN h = 2 THEN 'contract_violation' ELSE 'decided' END AS outcome,
    CASE WHEN h IN (3, 4) THEN 'escalate_to_human' WHEN h > 4 THEN expected END AS answer
  FROM (SELECT *, ((ok * 31 + m * 17) % 20)::INT AS h FROM base, (SELECT unnest([1, 2]) AS m)) b
), cites AS (
  SELECT verification_id, ok, model, g.s AS signal_id, g.v AS cited_value, (i - 1)::INT AS orden
  FROM (SELECT *, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM (
    SELECT verification_id, ok, model, list_filter(
      [{'s': 'mrz.checks_ok', 'v': coalesce(checks_ok::VARCHAR, 'NO DISPONIBLE')}, {'s': 'quality.front_glare', 'v': (floor(round(front_glare, 3) * 100 + 1e-9) / 100 + CASE WHEN h = 5 THEN 0.05 ELSE 0.0 END::DOUBLE)::VARCHAR}]
      || list_transform(list_filter(['nuip', 'birth_date', 'expiry_date', 'surnames', 'given_names', 'sex'], lambda f: h <> 9 AND list_contains(bad, f)), lambda f: {'s': 'cross.' || f, 'v': 'mismatch'})
      || [CASE WHEN h = 6 THEN {'s': 'quality.no_existe', 'v': '1'} END, CASE WHEN h = 7 THEN {'s': 'ocr.birth_date', 'v': '2029-04-12'} END, CASE WHEN h = 8 THEN {'s': 'cross.nuip', 'v': NULL} END], lambda x: x IS NOT NULL) AS gs
    FROM answered WHERE outcome = 'decided'))
), audited AS (
  SELECT c.*, s.valor AS actual_value, CASE WHEN s.signal_id IS NULL THEN 'unknown_signal' WHEN NOT s.disponible THEN CASE WHEN cited_value = 'NO DISPONIBLE' THEN 'valid' ELSE 'unavailable_signal' END
    WHEN cited_value IS NULL THEN 'missing_cited_value' WHEN s.tipo IN ('score', 'confidence') THEN CASE WHEN abs(try_cast(cited_value AS DOUBLE) - try_cast(s.valor AS DOUBLE)) <= 0.011 + 1e-9 THEN 'valid' ELSE 'value_mismatch' END
    WHEN lower(cited_value) = lower(s.valor) THEN 'valid' ELSE 'value_mismatch' END AS status
  FROM cites c LEFT JOIN signals s USING (verification_id, signal_id)
), unsaid AS (
  SELECT a.verification_id, r.model, a.signal_id FROM adverse a JOIN answered r ON r.verification_id = a.verification_id AND r.outcome = 'decided'
  WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE c.verification_id = a.verification_id AND c.model = r.model AND c.signal_id = a.signal_id)
), runs AS (
  SELECT r.verification_id, r.ok, r.model, r.outcome, r.answer AS decision, r.expected, r.split, r.decision AS rule_decision, coalesce(v, 0) AS citations_valid, coalesce(t, 0) AS citations_total,
    r.answer IS NOT NULL AND coalesce(v, 0) = coalesce(t, 0) AS faithful, r.answer IS NOT NULL AND o IS NULL AS complete
  FROM answered r LEFT JOIN (SELECT verification_id, model, count(*) FILTER (WHERE status = 'valid') AS v, count(*) AS t FROM audited GROUP BY ALL) USING (verification_id, model)
  LEFT JOIN (SELECT verification_id, model, count(*) AS o FROM unsaid GROUP BY ALL) USING (verification_id, model)
)"""
