"""The derived inputs and the chain of results in DuckDB SQL, independent of the Spark plans.

Expected values come from what was done to each application (k), not from parsing the lines again:
a wrong parse on the Spark side shows as a difference.
"""

from __future__ import annotations

from attesta.plans.fixtures import APPS

AS_OF = "DATE '2006-01-01'"
MONTHS = "(['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC'])"


def printed(day: str) -> str:
    return f"(strftime({day}, '%d') || ' ' || {MONTHS}[month({day})] || ' ' || strftime({day}, '%Y'))"


def thousands(n: str) -> str:
    return f"regexp_replace(reverse(regexp_replace(reverse(({n})::VARCHAR), '(\\d\\d\\d)', '\\1.', 'g')), '^\\.', '')"


def digit(payload: str) -> str:
    return f"(list_sum(list_transform(generate_series(1, length({payload})), lambda i: (CASE WHEN substr({payload}, i, 1) = '<' THEN 0 ELSE strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({payload}, i, 1)) - 1 END) * ([7, 3, 1])[(i - 1) % 3 + 1])) % 10)::INT"


FRONT = f"""
front AS (
  SELECT *, base + (k = 5)::INT AS n,
    {thousands("base + (k = 5)::INT + (k = 0)::INT")} AS front_nuip,
    birth_date + CASE WHEN k = 1 THEN 2192 ELSE 0 END AS f_birth, expiry_date + CASE WHEN k = 3 THEN 2192 ELSE 0 END AS m_expiry,
    CASE WHEN k = 14 THEN expiry_date + 30 ELSE issue_date END AS f_issue,
    CASE WHEN k = 2 THEN substr(surnames, 1, length(surnames) - 1) || 'X' ELSE surnames END AS front_surnames,
    CASE WHEN k = 15 THEN NULL WHEN k = 6 THEN CASE sex WHEN 'F' THEN 'M' ELSE 'F' END ELSE sex END AS front_sex,
    (80 + ok % 20) / 100 AS confidence, CASE WHEN k = 15 THEN 'order' ELSE 'label' END AS source,
    rpad(replace(surnames, ' ', '<') || '<<' || replace(given_names, ' ', '<'), 30, '<') AS low
  FROM apps
)"""

#: The zone as it was built, before what k does to it.
BUILT = f"""
built AS (
  SELECT *, bd || bc AS b7, ed || ec AS e7, rpad(n::VARCHAR, 11, '<') AS opt, 'ICCOL' || document_number || dc || repeat('<', 15) AS upper
  FROM (SELECT *, {digit("document_number")}::VARCHAR AS dc, {digit("bd")}::VARCHAR AS bc, {digit("ed")}::VARCHAR AS ec
        FROM (SELECT *, strftime(birth_date, '%y%m%d') AS bd, strftime(m_expiry, '%y%m%d') AS ed FROM front))
), zone AS (
  SELECT *, b7 || sex || e7 || 'COL' || opt || cc AS middle
  FROM (SELECT *, {digit("payload")}::VARCHAR AS cc FROM (SELECT *, substr(upper, 6, 25) || b7 || e7 || opt AS payload FROM built))
)"""

#: What the reader sees once letters and digits are put right by place, and the first single repair that closes all digits.
REPAIR = f"""
seen AS (
  SELECT *, CASE k WHEN 4 THEN substr(middle, 1, 29) || ((cc::INT + 1) % 10) WHEN 13 THEN substr(middle, 1, 18) || regexp_replace(opt, '0', 'O') || cc ELSE middle END AS m0 FROM zone
), tries AS (
  SELECT verification_id, line, pos, ord, CASE WHEN line = 0 THEN substr(upper, 1, pos - 1) || t || substr(upper, pos + 1) ELSE upper END AS u, CASE WHEN line = 1 THEN substr(m0, 1, pos - 1) || t || substr(m0, pos + 1) ELSE m0 END AS m
  FROM (SELECT *, substr(CASE WHEN line = 0 THEN upper ELSE m0 END, pos, 1) AS ch FROM seen, (SELECT unnest([0, 1]) AS line), (SELECT unnest(range(1, 31))::INT AS pos) WHERE k IN (4, 13)) x
  JOIN (SELECT unnest(['Q','0','O','D','I','1','L','S','5','B','8','Z','2','G','6']) AS f, unnest(['0','O','0','0','1','I','1','5','S','8','B','2','Z','6','G']) AS t, unnest(range(15)) AS ord) c ON c.f = x.ch
), repairs AS (
  SELECT verification_id, min_by(u, [line, pos, ord]) AS ru, min_by(m, [line, pos, ord]) AS rm
  FROM (SELECT *, substr(u, 6, 9) AS d1, substr(m, 1, 6) AS d2, substr(m, 9, 6) AS d3, substr(u, 6, 25) || substr(m, 1, 7) || substr(m, 9, 7) || substr(m, 19, 11) AS d4 FROM tries)
  WHERE substr(u, 15, 1) = {digit("d1")}::VARCHAR AND substr(m, 7, 1) = {digit("d2")}::VARCHAR AND substr(m, 15, 1) = {digit("d3")}::VARCHAR AND substr(m, 30, 1) = {digit("d4")}::VARCHAR
  GROUP BY 1
)"""

#: Fields of the zone as read; a repair only swaps a digit for a letter or back, so a date is the true one or none.
READ = """
read AS (
  SELECT *, CASE WHEN readable THEN replace(substr(rmiddle, 19, 11), '<', '') END AS mrz_nuip, CASE WHEN readable AND regexp_matches(substr(rmiddle, 1, 6), '^[0-9]{6}$') THEN birth_date END AS mrz_birth,
    CASE WHEN readable AND regexp_matches(substr(rmiddle, 9, 6), '^[0-9]{6}$') THEN m_expiry END AS mrz_expiry, CASE WHEN readable THEN replace(substr(rupper, 6, 9), '<', '') END AS mrz_number,
    CASE WHEN readable THEN sex END AS mrz_sex, CASE WHEN readable THEN trim(replace(split_part(low, '<<', 1), '<', ' ')) END AS mrz_surnames,
    CASE WHEN readable THEN trim(replace(substr(low, strpos(low, '<<') + 2), '<', ' ')) END AS mrz_given
  FROM (SELECT s.*, k <> 7 AS readable, coalesce(ru, upper) AS rupper, coalesce(rm, m0) AS rmiddle, CASE WHEN k <> 7 THEN ru IS NOT NULL END AS repaired, CASE WHEN k <> 7 THEN k NOT IN (4, 13) OR ru IS NOT NULL END AS checks_ok
        FROM seen s LEFT JOIN repairs USING (verification_id))
)"""

CROSS = """
crossed AS (
  SELECT ok, k, verification_id, field, fv, mv,
    CASE WHEN fv IS NULL AND mv IS NULL THEN 'both_missing' WHEN fv IS NULL THEN 'front_missing' WHEN mv IS NULL THEN 'mrz_missing'
         WHEN field IN ('surnames', 'given_names') THEN CASE WHEN fv <> '' AND mv <> '' AND (starts_with(fv, mv) OR starts_with(mv, fv)) THEN 'match' ELSE 'mismatch' END
         WHEN fv = mv THEN 'match' ELSE 'mismatch' END AS status
  FROM (
    SELECT ok, k, verification_id, unnest(['nuip', 'birth_date', 'expiry_date', 'surnames', 'given_names', 'sex']) AS field,
      unnest([replace(front_nuip, '.', ''), CASE WHEN k <> 8 THEN f_birth::VARCHAR END, expiry_date::VARCHAR, front_surnames, given_names, front_sex]) AS fv,
      unnest([mrz_nuip, mrz_birth::VARCHAR, mrz_expiry::VARCHAR, mrz_surnames, mrz_given, mrz_sex]) AS mv
    FROM read)
)"""

_S = lambda i, kind, value, reason="NULL": f"{{'signal_id': '{i}', 'tipo': '{kind}', 'valor': ({value})::VARCHAR, 'motivo': CASE WHEN ({value}) IS NULL THEN {reason} END}}"
_NO_FIELD, _NO_ZONE = "'el campo no se localizo en el anverso'", "'unreadable'"
_ITEMS = [
    _S("quality.front_sharpness", "count", "round(front_sharpness)::BIGINT"), _S("quality.back_sharpness", "count", "round(back_sharpness)::BIGINT"), _S("quality.front_glare", "score", "round(front_glare, 3)"),
    _S("mrz.readable", "flag", "readable"), _S("mrz.checks_ok", "flag", "checks_ok", _NO_ZONE),
    _S("mrz.failed_checks", "text", "CASE WHEN k = 7 THEN NULL WHEN NOT checks_ok THEN 'compuesto' ELSE 'ninguno' END", _NO_ZONE),
    *[x for name, value in (("nuip", "front_nuip"), ("surnames", "front_surnames"), ("given_names", "given_names"), ("birth_date", f"CASE WHEN k <> 8 THEN {printed('f_birth')} END"), ("expiry_date", printed("expiry_date")))
      for x in (_S(f"ocr.{name}", "text", value, _NO_FIELD), _S(f"ocr.{name}_confidence", "confidence", f"CASE WHEN ({value}) IS NOT NULL THEN round(confidence, 2) END", _NO_FIELD))],
    _S("ocr.fields_missing", "count", "(k = 8)::INT"),
    _S("document.age_years", "count", f"date_sub('year', coalesce(mrz_birth, CASE WHEN k <> 8 THEN f_birth END), {AS_OF})", "'no se pudo leer la fecha de nacimiento'"),
    _S("document.days_to_expiry", "count", f"coalesce(mrz_expiry, expiry_date) - {AS_OF}", "'no se pudo leer la fecha de expiracion'"),
    _S("document.dates_coherent", "flag", "coalesce(mrz_birth, CASE WHEN k <> 8 THEN f_birth END) < f_issue AND f_issue < coalesce(mrz_expiry, expiry_date)", "'falta alguna de las tres fechas'"),
    _S("document.expired", "flag", f"coalesce(mrz_expiry, expiry_date) < {AS_OF}", "'falta la fecha de expiracion'"),
]

SIGNALS = f"""
signals AS (
  SELECT verification_id, s.signal_id, s.tipo, s.valor, s.valor IS NOT NULL AS disponible, s.motivo AS motivo_indisponible
  FROM (SELECT verification_id, unnest([{", ".join(_ITEMS)}]) AS s FROM read)
  UNION ALL SELECT verification_id, 'mrz.repaired', 'flag', (repaired)::VARCHAR, true, NULL FROM read WHERE readable
  UNION ALL SELECT verification_id, 'cross.' || field, 'text', status, true, NULL FROM crossed
), adverse AS (
  SELECT verification_id, signal_id FROM signals WHERE disponible AND (
    (signal_id LIKE 'cross.%' AND valor = 'mismatch') OR (signal_id IN ('mrz.checks_ok', 'mrz.readable', 'document.dates_coherent') AND valor = 'false') OR (signal_id = 'document.expired' AND valor = 'true'))
)"""

BASE = """
base AS (
  SELECT r.*, x.fields AS bad, CASE WHEN NOT readable THEN 'request_resubmission' WHEN round(front_sharpness) < 300 THEN 'request_resubmission' WHEN round(front_glare, 3) > 0.8 THEN 'request_resubmission'
      WHEN k = 8 THEN 'request_resubmission' WHEN NOT checks_ok THEN 'reject' WHEN len(x.fields) > 0 THEN 'reject' WHEN coalesce(mrz_expiry, expiry_date) < DATE '2006-01-01' THEN 'reject' ELSE 'approve' END AS decision,
    CASE WHEN NOT readable THEN 'mrz.readable' WHEN round(front_sharpness) < 300 THEN 'quality.front_sharpness' WHEN round(front_glare, 3) > 0.8 THEN 'quality.front_glare'
      WHEN k = 8 THEN 'ocr.fields_missing' WHEN NOT checks_ok THEN 'mrz.checks_ok' WHEN len(x.fields) > 0 THEN 'cross' WHEN coalesce(mrz_expiry, expiry_date) < DATE '2006-01-01' THEN 'document.expired' ELSE 'approve' END AS rule,
    CASE WHEN ('0x' || substr(sha256(r.verification_id), 1, 2))::INT % 2 = 1 THEN 'holdout' ELSE 'calibration' END AS split,
    CASE WHEN k IN (0, 1, 3, 4, 14) THEN 'reject' WHEN k IN (2, 6) THEN 'escalate_to_human' WHEN k BETWEEN 7 AND 10 THEN 'request_resubmission' WHEN k = 5 THEN 'approve'
      WHEN expiry_date < DATE '2006-01-01' THEN 'reject' WHEN date_sub('year', birth_date, DATE '2006-01-01') < 18 THEN 'escalate_to_human' ELSE 'approve' END AS expected
  FROM read r JOIN (SELECT verification_id, coalesce(list(field ORDER BY field) FILTER (WHERE status = 'mismatch'), []) AS fields FROM crossed GROUP BY 1) x USING (verification_id)
)"""

CHAIN = [APPS, FRONT, BUILT, REPAIR, READ, CROSS, SIGNALS, BASE]


def over(select: str, *more: str) -> str:
    """select over the chain, and over further named queries."""
    return "WITH " + ",".join([*CHAIN, *more]) + "\n" + select
