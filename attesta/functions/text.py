"""Text and date scalars as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.constants import MONTHS

#: Latin letters with their marks, and the letters without them: a fast way for Latin text.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def _decomposed(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKD").str.replace(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]", "", regex=True)

    return run(text)


def strip_accents(text: Column, latin_only: bool = False) -> Column:
    """Text without combining marks. latin_only stays in the JVM, for columns known to hold Latin letters."""
    return F.translate(text, _MARKED, _PLAIN) if latin_only else _decomposed(text)


def loose(text: Column, latin_only: bool = True) -> Column:
    """No accents, lower case, single blanks: how cited texts compare."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text, latin_only)), r"\s+", " "))


def label_key(text: Column, latin_only: bool = True) -> Column:
    """No accents, lower case, letters, digits and blanks alone: how printed labels compare."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text, latin_only)), "[^a-z0-9 ]", ""))


_BARE = str.maketrans(_MARKED, _PLAIN)


def plain_label_key(text: str) -> str:
    """label_key() of a string."""
    return re.sub("[^a-z0-9 ]", "", text.translate(_BARE).lower()).strip(" ")


def name_key(text: Column, latin_only: bool = True) -> Column:
    """No accents, upper-case letters and single blanks: how names compare. Most are such a key already, which is told by one look at them."""
    key = F.upper(F.trim(F.regexp_replace(F.regexp_replace(strip_accents(text, latin_only), "[^A-Za-z ]", " "), " +", " ")))
    return F.when(text.rlike("[^A-Z ]|  |^ | $"), key).otherwise(text)


def names_agree(front: Column, mrz: Column, latin_only: bool = True) -> Column:
    """One is a prefix of the other, as the zone truncates names; an empty name agrees with none."""
    return keys_agree(name_key(front, latin_only), name_key(mrz, latin_only))


def keys_agree(a: Column, b: Column) -> Column:
    """names_agree() of two name_key()s."""
    return (a != "") & (b != "") & (a.startswith(b) | b.startswith(a))


def nuip_digits(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(raw, r"\D", ""), F.lit(""))


def nuip_printed(digits: Column) -> Column:
    """Thousands apart: 1.234.567.890."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", ".")


def spanish_date(raw: Column) -> Column:
    """14 ENE 1998 anywhere in the text, as a date; null for an unknown month or an impossible day."""
    # one search: the day is the digits that the match begins with, the year its last four characters, and the month the letters after the day
    found = F.regexp_extract(raw, r"\d{1,2}\s*[A-Za-z]{3}\w*\s*\d{4}", 0)
    long_day = F.substring(found, 2, 1).between("0", "9")
    day = F.when(long_day, F.substring(found, 1, 2)).otherwise(F.substring(found, 1, 1))
    letters = F.substring(F.translate(F.substring(found, F.when(long_day, 3).otherwise(2), F.length(found)), " \t\n\v\f\r", ""), 1, 3)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(letters))
    # without a match or a month this is no date
    return F.concat_ws("-", F.right(found, F.lit(4)), month.cast("string"), day).try_cast("date")


def spanish_date_printed(day: Column) -> Column:
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))
    return F.concat_ws(" ", F.lpad(F.dayofmonth(day).cast("string"), 2, "0"), month, F.lpad(F.year(day).cast("string"), 4, "0"))


def place_after_comma(raw: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(raw, r"(?s),(.*)", 1)), F.lit(""))


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A double where the text is a plain decimal number, else null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def whole_years(day: Column, as_of) -> Column:
    at = F.lit(as_of)
    before = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(day) * 100 + F.dayofmonth(day))
    return F.year(at) - F.year(day) - before.cast("int")


def holdout(case_id: Column) -> Column:
    """Stable split: the first byte of the id's SHA-256 is odd."""
    return F.conv(F.substring(F.sha2(case_id.cast("binary"), 256), 1, 2), 16, 10).cast("int") % 2 == 1


def split_name(case_id: Column) -> Column:
    return F.when(holdout(case_id), "holdout").otherwise("calibration")


def fingerprint(key: Column) -> Column:
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 12)
