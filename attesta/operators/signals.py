"""Measured signals of a verification: cross checks of the two copies, document rules, the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.constants import COVERED_FIELDS, CROSS_FIELDS, FRONT_FIELDS, REASONS
from attesta.functions import text

KEY = "verification_id"


def prepared(df: DataFrame) -> DataFrame:
    """A wide row with what several signals are made of, worked out once: the front's dates as shown_*, and cross_<field>, the status of each pair."""
    if "shown_birth" in df.columns:
        return df
    names = {f"_{side}_{c}": text.name_key(F.col(f"{side}_{c}")) for side in ("front", "mrz") for c in ("surnames", "given_names")}
    out = df.withColumns({"shown_birth": text.spanish_date(F.col("front_birth_date")), "shown_expiry": text.spanish_date(F.col("front_expiry_date")), "shown_issue": text.spanish_date(F.col("front_issue")), **names})
    pairs = cross_pairs(F.col("shown_birth"), F.col("shown_expiry"))
    for c in ("surnames", "given_names"):
        pairs[c] = (*pairs[c][:2], text.keys_agree(F.col(f"_front_{c}"), F.col(f"_mrz_{c}")))
    return out.withColumns({f"cross_{c}": _status(*p) for c, p in pairs.items()}).drop(*names)


def cross_pairs(birth: Column | None = None, expiry: Column | None = None) -> dict[str, tuple[Column, Column, Column]]:
    """field -> (front as shown, zone as shown, are they equal?). Missing is null alone: an empty value is a value. birth, expiry: the front's dates, if they are columns already."""
    f, z = (lambda c: F.col(f"front_{c}")), (lambda c: F.col(f"mrz_{c}"))
    birth = text.spanish_date(f("birth_date")) if birth is None else birth
    expiry = text.spanish_date(f("expiry_date")) if expiry is None else expiry
    sex = F.nullif(F.substring(F.upper(F.trim(f("sex"))), 1, 1), F.lit(""))
    nuip, zone_sex = text.nuip_digits(f("nuip")), F.nullif(z("sex"), F.lit(""))
    return {
        "nuip": (nuip, z("nuip"), nuip == z("nuip")),
        "birth_date": (birth.cast("string"), z("birth_date").cast("string"), birth == z("birth_date")),
        "expiry_date": (expiry.cast("string"), z("expiry_date").cast("string"), expiry == z("expiry_date")),
        "surnames": (f("surnames"), z("surnames"), text.names_agree(f("surnames"), z("surnames"))),
        "given_names": (f("given_names"), z("given_names"), text.names_agree(f("given_names"), z("given_names"))),
        "sex": (sex, zone_sex, sex == zone_sex),
    }


def _status(front: Column, zone: Column, equal: Column) -> Column:
    return F.when(front.isNull() & zone.isNull(), "both_missing").when(front.isNull(), "front_missing").when(zone.isNull(), "mrz_missing").when(equal, "match").otherwise("mismatch")


def paired(front: DataFrame, zone: DataFrame, key: str = KEY) -> DataFrame:
    """Both copies side by side; a capture with one of them stays."""
    return front.join(zone, key, "full_outer")


def cross_checks(df: DataFrame, key: str = KEY) -> DataFrame:
    """key, field, status, front_value, mrz_value: six rows for each row of paired()."""
    items = [F.struct(F.lit(name).alias("field"), _status(a, b, eq).alias("status"), a.alias("front_value"), b.alias("mrz_value")) for name, (a, b, eq) in cross_pairs().items()]
    return df.select(key, F.inline(F.array(*items)))


def document_columns(as_of) -> dict[str, Column]:
    """Of a row of prepared()."""
    birth, expiry, issue = F.coalesce("mrz_birth_date", "shown_birth"), F.coalesce("mrz_expiry_date", "shown_expiry"), F.col("shown_issue")
    return {
        "age_years": text.whole_years(birth, as_of), "days_to_expiry": F.datediff(expiry, F.lit(as_of)),
        "dates_coherent": F.when(birth.isNotNull() & issue.isNotNull() & expiry.isNotNull(), (birth < issue) & (issue < expiry)), "expired": expiry < F.lit(as_of),
    }


def missing_fields() -> Column:
    """The published fields that the front lacks, in order."""
    return F.array_compact(F.array(*[F.when(F.col(f"front_{c}").isNull(), F.lit(c)) for c in FRONT_FIELDS]))


def build_signals(df: DataFrame, as_of, key: str = KEY, similarity: str | None = None) -> DataFrame:
    """key, signal_id, tipo, valor, disponible, motivo_indisponible from one wide row for each verification: signal_sets() as rows."""
    # outer, as no row is without signals: else Spark would make the array a second time, in a filter for empty ones
    return prepared(df).select(key, F.inline_outer(signal_sets(as_of, similarity)))


def signal_sets(as_of, similarity: str | None = None) -> Column:
    """All signals of a row of prepared() as an array of (signal_id, tipo, valor, disponible, motivo_indisponible).

    Wide: front_* raw strings, confidence and source; mrz_* of a parsed zone with repaired and mrz_error;
    sharpness and glare. One pass over the rows: all signals of a row are made at once.
    """
    no_field, zone = F.lit(REASONS["field"]), F.coalesce("mrz_error", F.lit(REASONS["zone"]))
    readable = F.col("mrz_checks_ok").isNotNull()

    def item(name, kind, value, reason=None, when=None):
        value = value.cast("string")
        row = F.struct(F.lit(name).alias("signal_id"), F.lit(kind).alias("tipo"), value.alias("valor"), value.isNotNull().alias("disponible"), F.when(value.isNull(), reason if reason is not None else F.lit("no se midio")).alias("motivo_indisponible"))
        return row if when is None else (row, when)

    doc = document_columns(as_of)
    failed = F.when(readable, F.when(F.size("mrz_failed") > 0, F.array_join("mrz_failed", ", ")).otherwise("ninguno"))
    items = [
        item("quality.front_sharpness", "count", F.round("front_sharpness").cast("long")), item("quality.back_sharpness", "count", F.round("back_sharpness").cast("long")), item("quality.front_glare", "score", F.round("front_glare", 3)),
        item("mrz.readable", "flag", readable), item("mrz.checks_ok", "flag", F.col("mrz_checks_ok"), zone), item("mrz.failed_checks", "text", failed, zone), item("mrz.repaired", "flag", F.col("repaired"), zone, readable),
    ]
    for c in FRONT_FIELDS:
        value = F.col(f"front_{c}")
        items += [item(f"ocr.{c}", "text", value, no_field), item(f"ocr.{c}_confidence", "confidence", F.when(value.isNotNull(), F.round("confidence", 2)), no_field)]
    items.append(item("ocr.fields_missing", "count", F.size(missing_fields())))
    items += [item(f"cross.{name}", "text", F.col(f"cross_{name}")) for name in CROSS_FIELDS]
    items += [
        item("document.age_years", "count", doc["age_years"], F.lit(REASONS["birth_date"])), item("document.days_to_expiry", "count", doc["days_to_expiry"], F.lit(REASONS["expiry_date"])),
        item("document.dates_coherent", "flag", doc["dates_coherent"], F.lit(REASONS["three_dates"])), item("document.expired", "flag", doc["expired"], F.lit(REASONS["expiry"])),
    ]
    if similarity:
        items.append(item("facial.similarity", "score", F.round(F.col(similarity), 4), F.col(f"{similarity}_reason"), F.col(similarity).isNotNull() | F.col(f"{similarity}_reason").isNotNull()))
    # arrays laid end to end, as array_compact() would leave generated code with all that stands in them
    parts, plain = [], []
    for x in items:
        if not isinstance(x, tuple):
            plain.append(x)
            continue
        row, when = x
        parts += [F.array(*plain), F.when(when, F.array(row)).otherwise(F.slice(F.array(row), 1, 0))]
        plain = []
    return F.concat(*parts, *([F.array(*plain)] if plain else []))


def available(signals: DataFrame) -> DataFrame:
    return signals.filter("disponible")


def malformed(signals: DataFrame) -> DataFrame:
    """Signals with both a value and a reason, or with neither."""
    return signals.filter(F.col("valor").isNull() == F.col("motivo_indisponible").isNull())


def contradictions(signals: DataFrame, key: str = KEY) -> DataFrame:
    """key, fields: contradicting fields of the verifications that have any, by name."""
    bad = signals.filter(F.col("signal_id").startswith("cross.") & F.col("disponible") & (F.col("valor") == "mismatch"))
    return bad.groupBy(key).agg(F.array_sort(F.collect_list(F.substring("signal_id", 7, 100))).alias("fields"))


def contradiction_sets(df: DataFrame, key: str = KEY) -> DataFrame:
    """contradictions() of rows of prepared(), each found in its own row."""
    fields = F.array_compact(F.array(*[F.when(F.col(f"cross_{c}") == "mismatch", F.lit(c)) for c in sorted(CROSS_FIELDS)]))
    return df.filter(" or ".join(f"cross_{c} = 'mismatch'" for c in CROSS_FIELDS)).select(key, fields.alias("fields"))


def hardness(checks: DataFrame) -> DataFrame:
    """Mismatches, and whether a check digit covers the field."""
    return checks.filter("status = 'mismatch'").withColumn("covered", F.col("field").isin(*COVERED_FIELDS))


def adverse(signal: Column | None = None) -> Column:
    """Does an available signal speak against the application? signal: a struct of signal_sets(); else the row's columns."""
    i, v, has = (F.col(c) if signal is None else signal[c] for c in ("signal_id", "valor", "disponible"))
    return has & ((i.startswith("cross.") & (v == "mismatch")) | (i.isin("mrz.checks_ok", "mrz.readable", "document.dates_coherent") & (v == "false")) | ((i == "document.expired") & (v == "true")))


def diagnosis(df: DataFrame, limits, key: str = KEY, similarity: str | None = None) -> DataFrame:
    """key, problem, value: what is wrong with a capture, by the thresholds of the rules. similarity: as for build_signals(); a selfie that gave none is a problem."""
    row = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("problem"), value.cast("string").alias("value")))
    missing = F.size(missing_fields())
    items = [
        row(F.round("front_sharpness") < limits.min_sharpness, "front_blurred", F.round("front_sharpness").cast("long")), row(F.round("back_sharpness") < limits.min_sharpness, "back_blurred", F.round("back_sharpness").cast("long")),
        row(F.round("front_glare", 3) > limits.max_glare, "glare", F.round("front_glare", 3)), row(missing > limits.max_missing, "fields_missing", missing), row(F.col("mrz_checks_ok").isNull(), "mrz_unreadable", F.col("mrz_error")),
    ]
    if similarity:
        reason = F.col(f"{similarity}_reason")
        items.append(row(F.col(similarity).isNull() & reason.isNotNull(), "no_facial_comparison", reason))
    return df.select(key, F.inline(F.array_compact(F.array(*items))))


def useful_capture(df: DataFrame, truth: DataFrame, key: str = KEY) -> DataFrame:
    """key, useful: read correctly, not just coherently. truth: key, nuip, birth_date."""
    t = truth.select(key, F.col("nuip").alias("true_nuip"), F.col("birth_date").alias("true_birth"))
    pairs = cross_pairs()
    ok = F.col("mrz_checks_ok") & (_status(*pairs["nuip"]) == "match") & (_status(*pairs["birth_date"]) == "match") & (pairs["nuip"][0] == F.col("true_nuip")) & F.col("front_birth_date").contains(text.spanish_date_printed(F.col("true_birth")))
    return df.join(t, key).select(key, F.coalesce(ok, F.lit(False)).alias("useful"))
