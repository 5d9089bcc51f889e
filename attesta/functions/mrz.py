"""The machine-readable zone (TD1: three lines of 30) as Column expressions.

Lines are three string columns; every expression is a sum or a concatenation over fixed places,
so it stays in generated code. Only the search for a single confused character is a vectorized
helper, over a batch of rows at once.
"""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = (7, 3, 1)
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<"

# Characters that a reader confuses, in the order in which they are tried.
CONFUSIONS = (("Q", "0"), ("0", "O"), ("O", "0"), ("D", "0"), ("I", "1"), ("1", "I"), ("L", "1"), ("S", "5"), ("5", "S"), ("B", "8"), ("8", "B"), ("Z", "2"), ("2", "Z"), ("G", "6"), ("6", "G"))
TO_LETTER = ("015826", "OISBZG")
TO_DIGIT = ("OQDILSBZGT", "0001158267")

CHECKS = ("numero_documento", "fecha_nacimiento", "fecha_expiracion", "compuesto")


def character_value(c: Column) -> Column:
    """< is 0, a digit itself, A to Z 10 to 35; null for others."""
    code = F.ascii(c)
    return F.when(c == "<", 0).when(c.between("0", "9"), code - 48).when(c.between("A", "Z"), code - 55)


#: The last digit of each character's value: all that a sum modulo 10 needs.
_LAST = ("<" + DIGITS[10:], "0" + "".join(str(i % 10) for i in range(10, 36)))


def _values(line: Column) -> Column:
    return F.translate(line, *_LAST)


def digit_over(*spans) -> Column:
    """Weights 7, 3, 1 over the characters of spans (line of _values, start, end), or over a skipped length, modulo 10.

    The lines should be plain columns: each character is one small term, and the sum stays in generated code.
    """
    terms, at, zeros = [], 0, 0
    for span in spans:
        if isinstance(span, int):
            at += span
            continue
        line, start, end = span
        for i in range(start, end):
            terms.append(F.ascii(F.substring(line, i + 1, 1)) * WEIGHTS[at % 3])
            zeros += 48 * WEIGHTS[at % 3]
            at += 1
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return (out - zeros) % 10


#: Digits of a line that one number holds.
_CHUNK = 15


def with_numbers(df: DataFrame, **lines: tuple[Column, int]) -> DataFrame:
    """df with each line of _values (its length beside it) as a column, and its digits as numbers <name>_0, <name>_1, ...; null where a character is no digit."""
    df = df.withColumns({name: line for name, (line, _) in lines.items()})
    part = lambda name, i: F.substring(name, i * _CHUNK + 1, _CHUNK)
    return df.withColumns({f"{name}_{i}": F.when(~part(name, i).rlike("[^0-9]"), part(name, i).try_cast("long")) for name, (_, n) in lines.items() for i in range(-(-n // _CHUNK))})


def digit_of(*spans) -> Column:
    """digit_over() spans (name of a line of with_numbers(), its length, start, end), check digits as numbers, or a skipped length.

    A digit is a division and a remainder of a number, where a substring of its own costs a hundred times as much; lines with other characters go that way.
    """
    terms, plain, at = [], [], 0
    for span in spans:
        if isinstance(span, int):
            at += span
            plain.append(span)
        elif isinstance(span, Column):
            terms.append(span * WEIGHTS[at % 3])
            plain.append((span.cast("string"), 0, 1))
            at += 1
        else:
            name, length, start, end = span
            plain.append((F.col(name), start, end))
            for place in range(start, end):
                i, here = divmod(place, _CHUNK)
                shift = min(_CHUNK, length - i * _CHUNK) - 1 - here
                number = F.col(f"{name}_{i}")
                terms.append((F.call_function("div", number, F.lit(10**shift)) if shift else number) % 10 * WEIGHTS[at % 3])
                at += 1
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.coalesce((out % 10).cast("int"), digit_over(*plain))


def check_digit(payload: Column, length: int) -> Column:
    """Check digit of a payload of known length, of the zone's alphabet."""
    return digit_over((_values(payload), 0, length))


def shape_error(lines: Column) -> Column:
    """Why an array of lines is no zone: line_count, line_length or characters; null if it is one."""
    return F.when(F.size(lines) != 3, "line_count").when(~F.forall(lines, lambda x: F.length(x) == 30), "line_length").when(~F.forall(lines, lambda x: x.rlike("^[A-Z0-9<]*$")), "characters")


def block_lines(text: Column) -> Column:
    """Lines of a text block, trimmed, without the blank ones."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def candidate_lines(text: Column) -> Column:
    """The last three lines that look like a zone, padded or cut to 30; null if there are not three."""
    kept = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(F.upper(x), f"[^{ALPHABET}]", "")), lambda x: F.length(x) >= 24)
    return F.when(F.size(kept) >= 3, F.transform(F.slice(kept, -3, 3), lambda x: F.rpad(x, 30, "<")))


def _span(line: Column, start: int, end: int) -> Column:
    return F.substring(line, start + 1, end - start)


def _closest_country(code: Column) -> Column:
    same = sum(((F.substring(code, i + 1, 1) == c).cast("int") for i, c in enumerate("COL")), F.lit(0))
    return F.when(same == 2, "COL").otherwise(code)


def fixed_lines(upper: Column, middle: Column, lower: Column) -> tuple[Column, Column, Column]:
    """Letters where the format has letters, digits where it has digits; then the country; then the sex."""
    letters = lambda x: F.translate(x, *TO_LETTER)
    digits = lambda x: F.translate(x, *TO_DIGIT)
    upper = F.concat(_span(upper, 0, 2), _closest_country(letters(_span(upper, 2, 5))), digits(_span(upper, 5, 15)), _span(upper, 15, 30))
    sex = _span(middle, 7, 8)
    better = letters(sex)
    sex = F.when(~sex.isin("M", "F", "<") & better.isin("M", "F", "<"), better).otherwise(sex)
    middle = F.concat(digits(_span(middle, 0, 7)), sex, digits(_span(middle, 8, 15)), _closest_country(letters(_span(middle, 15, 18))), _span(middle, 18, 29), digits(_span(middle, 29, 30)))
    return upper, middle, letters(lower)


def date_of(raw: Column, as_of, past: bool) -> Column:
    """YYMMDD with the century by field: the latest past date, or the earliest that is to come; else the latest."""
    if isinstance(as_of, datetime.date) and 2000 <= as_of.year <= 2099:
        # a date of 19YY has passed, so the six digits tell the century, and one date is made; 29 February of 1900 was none
        on = lambda c: F.when(raw.rlike("^[0-9]{6}$"), F.concat(F.lit(c), F.substring(raw, 1, 2), F.lit("-"), F.substring(raw, 3, 2), F.lit("-"), F.substring(raw, 5, 2)).try_cast("date"))
        return F.when(raw > as_of.strftime("%y%m%d"), F.coalesce(on("19"), on("20"))).otherwise(on("20")) if past else on("20")
    a, b = (F.when(raw.rlike("^[0-9]{6}$"), F.concat(F.lit(c), F.substring(raw, 1, 2), F.lit("-"), F.substring(raw, 3, 2), F.lit("-"), F.substring(raw, 5, 2)).try_cast("date")) for c in ("19", "20"))
    at = F.lit(as_of)
    if past:
        fit = F.greatest(F.when(a <= at, a), F.when(b <= at, b))
    else:
        fit = F.least(F.when(a >= at, a), F.when(b >= at, b))
    return F.coalesce(fit, F.greatest(a, b))


def with_values(df: DataFrame, upper="upper", middle="middle") -> DataFrame:
    """df with _uv and _mv, the lines as checks() sums them, and their numbers: columns, so that no term works them out anew."""
    return with_numbers(df, _uv=(_values(F.col(upper)), 30), _mv=(_values(F.col(middle)), 30))


def _found(upper: Column, middle: Column) -> tuple[tuple[Column, Column], ...]:
    """(printed, computed) of each of CHECKS, of a row of with_values()."""
    u, m = (lambda *span: ("_uv", 30, *span)), (lambda *span: ("_mv", 30, *span))
    return ((_span(upper, 14, 15), digit_of(u(5, 14))), (_span(middle, 6, 7), digit_of(m(0, 6))), (_span(middle, 14, 15), digit_of(m(8, 14))), (_span(middle, 29, 30), digit_of(u(5, 30), m(0, 7), m(8, 15), m(18, 29))))


def _agree(printed: Column, digit: Column) -> Column:
    return F.coalesce(printed == digit.cast("string"), F.lit(False))


def _checked(found) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), printed.alias("printed"), digit.alias("computed"), _agree(printed, digit).alias("ok")) for name, (printed, digit) in zip(CHECKS, found, strict=True)])


def checks(upper: Column, middle: Column) -> Column:
    """Array of (name, printed, computed, ok) in the order of CHECKS, of a row of with_values()."""
    return _checked(_found(upper, middle))


def parsed(df: DataFrame, as_of, upper="upper", middle="middle", lower="lower") -> DataFrame:
    """df with the fields of its lines (null where the lines are null)."""
    u, m, low = F.col(upper), F.col(middle), F.col(lower)
    at = F.locate("<<", low)
    surnames = F.when(at > 0, F.substring(low, F.lit(1), at - 1)).otherwise(low)
    given = F.when(at > 0, F.substring(low, at + 2, F.lit(30))).when(low.isNotNull(), "")
    plain = lambda x: F.trim(F.replace(x, F.lit("<"), F.lit(" ")))
    bare = lambda x: F.replace(x, F.lit("<"), F.lit(""))
    # digits are columns: what is said of the checks is said without an array of them, which few ask for
    found = _found(u, m)
    df = with_values(df, upper, middle).withColumns({f"_digit_{i}": digit for i, (_, digit) in enumerate(found)}).drop("_uv", "_uv_0", "_uv_1", "_mv", "_mv_0", "_mv_1")
    found = [(printed, F.col(f"_digit_{i}")) for i, (printed, _) in enumerate(found)]
    good = [_agree(*pair) for pair in found]
    every, failed = good[0] & good[1] & good[2] & good[3], F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in zip(CHECKS, good, strict=True)]))
    return df.withColumns({
        "mrz_checks": F.when(u.isNotNull(), _checked(found)),
        "mrz_document_type": bare(_span(u, 0, 2)), "mrz_country": _span(u, 2, 5), "mrz_document_number": bare(_span(u, 5, 14)),
        "mrz_birth_date": date_of(_span(m, 0, 6), as_of, True), "mrz_sex": _span(m, 7, 8), "mrz_expiry_date": date_of(_span(m, 8, 14), as_of, False),
        "mrz_nationality": _span(m, 15, 18), "mrz_nuip": bare(_span(m, 18, 29)), "mrz_surnames": plain(surnames), "mrz_given_names": plain(given),
        "mrz_checks_ok": F.when(u.isNotNull(), every), "mrz_failed": F.when(u.isNotNull(), F.when(every, F.array().cast("array<string>")).otherwise(failed)),
    }).drop(*[f"_digit_{i}" for i in range(len(CHECKS))])


def _printed_day(day: Column) -> Column:
    return F.lpad((F.year(day) % 100 * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("string"), 6, "0")


def with_built_lines(df: DataFrame, document_number: Column, birth: Column, sex: Column, expiry: Column, nuip: Column, surnames: Column, given: Column, country="COL", nationality="COL", document_type="IC") -> DataFrame:
    """df with upper, middle, lower: lines with right check digits; fields are in upper case, cut or padded with <."""
    field = lambda x, n: F.rpad(F.upper(x if isinstance(x, Column) else F.lit(x)), n, "<")
    kept = df.columns
    df = df.withColumns({"_n": field(document_number, 9), "_b": _printed_day(birth), "_e": _printed_day(expiry), "_o": field(nuip, 11), "_sex": F.upper(sex), "_low": field(F.concat(F.replace(F.upper(surnames), F.lit(" "), F.lit("<")), F.lit("<<"), F.replace(F.upper(given), F.lit(" "), F.lit("<"))), 30)})
    df = with_numbers(df, _nv=(_values(F.col("_n")), 9), _ov=(_values(F.col("_o")), 11), _bv=(F.col("_b"), 6), _ev=(F.col("_e"), 6))
    n, b, e = ("_nv", 9, 0, 9), ("_bv", 6, 0, 6), ("_ev", 6, 0, 6)
    df = df.withColumns({"_nd": digit_of(n), "_bd": digit_of(b), "_ed": digit_of(e)})
    composite = digit_of(n, F.col("_nd"), 15, b, F.col("_bd"), e, F.col("_ed"), ("_ov", 11, 0, 11))
    upper = F.concat(field(document_type, 2), field(country, 3), "_n", "_nd", F.lit("<" * 15))
    middle = F.concat("_b", "_bd", "_sex", "_e", "_ed", field(nationality, 3), "_o", composite.cast("string"))
    return df.select(*kept, upper.alias("upper"), middle.alias("middle"), F.col("_low").alias("lower"))


#: For each check: where its digit is printed, and the weights of the places that it sums; a place counts through the first two lines, as the third has no digit.
_PRINTED = (14, 36, 44, 59)
_SUMMED = (((5, 14),), ((30, 36),), ((38, 44),), ((5, 30), (30, 37), (38, 45), (48, 59)))
_WEIGHT = np.zeros((60, 4), dtype=np.int64)
for _check, _spans in enumerate(_SUMMED):
    for _i, _place in enumerate(p for a, b in _spans for p in range(a, b)):
        _WEIGHT[_place, _check] = WEIGHTS[_i % 3]
_VALUE = np.zeros(128, dtype=np.int64)
for _i, _c in enumerate(DIGITS):
    _VALUE[ord(_c)] = _i


def single_repairs(lines: np.ndarray) -> np.ndarray:
    """Which rows of lines (codes of the characters of the first two lines, 60 a row) fail and are put right, here in place.

    Each by the first single confusable character, by place and CONFUSIONS, with which all four digits close.
    A change moves each sum by a known amount, so the sums are made once for a row.
    """
    sums, shown = _VALUE[lines] @ _WEIGHT, lines[:, _PRINTED].astype(np.int64) - 48
    failing = np.flatnonzero((sums % 10 != shown).any(axis=1))
    rows, sums, shown = lines[failing], sums[failing], shown[failing]
    left = np.ones(len(failing), dtype=bool)
    for place in range(60):
        for wrong, right in CONFUSIONS:
            at = np.flatnonzero(left & (rows[:, place] == ord(wrong)))
            if not len(at):
                continue
            printed = shown[at]
            if place in _PRINTED:
                printed[:, _PRINTED.index(place)] = ord(right) - 48
            good = at[((sums[at] + (_VALUE[ord(right)] - _VALUE[ord(wrong)]) * _WEIGHT[place]) % 10 == printed).all(axis=1)]
            lines[failing[good], place] = ord(right)
            left[good] = False
    changed = np.zeros(len(lines), dtype=bool)
    changed[failing[~left]] = True
    return changed


def _repaired(*lines: Column) -> Column:
    @F.pandas_udf("upper string, middle string")
    def run(upper: pd.Series, middle: pd.Series) -> pd.DataFrame:
        out = np.full((len(upper), 2), None, dtype=object)
        there = np.flatnonzero(upper.notna())
        codes = np.frombuffer("".join((upper + middle).iloc[there]).encode("ascii"), dtype=np.uint8).reshape(-1, 60).copy()
        for i in np.flatnonzero(single_repairs(codes)):
            text = codes[i].tobytes().decode("ascii")
            out[there[i]] = text[:30], text[30:]
        return pd.DataFrame(out, columns=["upper", "middle"])

    return run(*lines)


def read_zone(df: DataFrame, text="mrz_text", repair: bool = True) -> DataFrame:
    """df with upper, middle, lower, repaired and mrz_error of a text: cut, corrected by place, repaired if its digits fail.

    The helper sums a batch of rows at once and searches those that fail; the third line does not go there.
    """
    df = df.withColumn("_lines", candidate_lines(F.col(text)))
    u, m, low = fixed_lines(*[F.get("_lines", F.lit(i)) for i in range(3)])
    df = df.withColumn("upper", u).withColumn("middle", m).withColumn("lower", low)
    df = df.withColumn("mrz_error", F.when(F.col("_lines").isNull(), "unreadable"))
    if not repair:
        return df.withColumn("repaired", F.lit(False)).drop("_lines")
    df = df.withColumn("_new", _repaired(F.col("upper"), F.col("middle")))
    df = df.withColumn("repaired", F.col("_new.upper").isNotNull())
    for c in ("upper", "middle"):
        df = df.withColumn(c, F.coalesce(F.col(f"_new.{c}"), F.col(c)))
    return df.drop("_lines", "_new")
