"""Stored model answers: texts of responses, decisions or what they violate, outcomes, quota errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.constants import DECISIONS, WEIGHTS

RESPONSE = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>,promptFeedback:struct<blockReason:string>>"
DECISION = "struct<decision:string,summary:string,groundings:array<struct<signal_id:string,cited_value:string,weight:string,text:string>>>"
QUOTA = "struct<error:struct<details:array<struct<violations:array<struct<quotaId:string>>,retryDelay:string>>>>"


def request_key(model: Column, request: Column) -> Column:
    """SHA-256 of the canonical (model, request)."""
    return F.sha2(F.to_json(F.struct(model.alias("model"), request.alias("request"))).cast("binary"), 256)


def response_text(body: Column) -> Column:
    """(text, reason): all parts of the first candidate, or why there is none."""
    return parsed_text(F.from_json(body, RESPONSE))


def parsed_text(r: Column) -> Column:
    """response_text() of a body that is parsed already: in a column of its own it is parsed once."""
    first = F.get(r["candidates"], F.lit(0))
    parts = F.filter(F.transform(first["content"]["parts"], lambda p: p["text"]), lambda t: t.isNotNull())
    text = F.nullif(F.array_join(parts, ""), F.lit(""))
    reason = F.when(text.isNull(), F.coalesce(r["promptFeedback"]["blockReason"], first["finishReason"], F.lit("empty")))
    return F.struct(text.alias("text"), reason.alias("reason"))


def decision_or_violation(text: Column) -> Column:
    """(decision, violation): a decision that keeps the contract, or the first rule that it breaks."""
    return parsed_decision(text, decision_json(text))


def decision_json(text: Column) -> Column:
    return F.from_json(text, DECISION, {"mode": "PERMISSIVE"})


def parsed_decision(text: Column, d: Column) -> Column:
    """decision_or_violation() of a text and its decision_json(): in a column of its own it is parsed once."""
    g = d["groundings"]
    short = lambda c, n: F.coalesce(F.length(c) < n, F.lit(True))
    json_like = F.coalesce(F.trim(text).startswith("{"), F.lit(False)) & F.call_function("try_parse_json", text).isNotNull()
    violation = (
        F.when(~json_like, "not_json").when(~F.coalesce(d["decision"].isin(*DECISIONS), F.lit(False)), "decision").when(short(d["summary"], 10), "summary").when(F.coalesce(F.size(g), F.lit(0)) < 1, "groundings")
        .when(F.exists(g, lambda x: short(x["signal_id"], 1)), "signal_id").when(F.exists(g, lambda x: ~F.coalesce(x["weight"].isin(*WEIGHTS), F.lit(False))), "weight").when(F.exists(g, lambda x: short(x["text"], 10)), "text")
        .when((d["decision"] == "approve") & ~F.exists(g, lambda x: x["weight"] == "in_favor"), "approve_without_favor").when((d["decision"] != "approve") & F.forall(g, lambda x: x["weight"] == "in_favor"), "all_in_favor")
    )
    return F.struct(F.when(violation.isNull(), d).alias("decision"), violation.alias("violation"))


def outcome_of_status(status: Column) -> Column:
    """How an attempt ended whose status tells; null where its text does."""
    return F.when(status.isin(401, 403), "bad_credential").when(status == 429, "out_of_quota").when(status != 200, "unavailable")


def outcome(status: Column, text: Column, violation: Column) -> Column:
    """How an attempt ended."""
    read = F.when(text.isNull() | F.coalesce(violation == "not_json", F.lit(False)), "malformed").when(violation.isNotNull(), "contract_violation").otherwise("decided")
    return F.coalesce(outcome_of_status(status), read)


def effective_decision(decision: Column) -> Column:
    return F.coalesce(decision, F.lit("escalate_to_human"))


def minute_quota(body: Column, most: float = 75.0, default: float = 60.0) -> Column:
    """(per_minute, delay, wait) of a 429 body: the minute's quota or the day's, and how long to wait."""
    details = F.from_json(body, QUOTA)["error"]["details"]
    minute = F.coalesce(F.exists(details, lambda d: F.coalesce(F.exists(d["violations"], lambda v: F.coalesce(F.lower(v["quotaId"]).contains("perminute"), F.lit(False))), F.lit(False))), F.lit(False))
    said = F.filter(F.transform(details, lambda d: d["retryDelay"]), lambda x: F.coalesce(x.endswith("s"), F.lit(False)))
    last = F.when(F.size(said) > 0, F.element_at(said, -1))
    delay = F.coalesce(F.regexp_replace(last, "s$", "").try_cast("double"), F.lit(0.0))
    return F.struct(minute.alias("per_minute"), delay.alias("delay"), F.least(F.when(delay > 0, delay).otherwise(default), F.lit(most)).alias("wait"))


def quota_day(ts: Column) -> Column:
    """Calendar day in the quota's zone, of a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), ts.cast("timestamp_ntz")).cast("date")


def signal_lines(signals, key: str = "verification_id"):
    """key, prompt: signals as lines `- id (kind) = value`, in the order of their ids."""
    line = F.concat(F.lit("- "), "signal_id", F.lit(" ("), "tipo", F.lit(") = "), F.coalesce("valor", F.concat(F.lit("NO DISPONIBLE: "), F.col("motivo_indisponible"))))
    lines = F.array_sort(F.collect_list(F.struct("signal_id", line.alias("line"))))
    return signals.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))
