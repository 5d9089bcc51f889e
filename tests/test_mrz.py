"""The zone: published sample, tampering, malformed lines, centuries, repair."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import mrz

SAMPLE = ("I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<")
AS_OF = dt.date(2026, 9, 14)


def parse(spark, lines, as_of=AS_OF):
    return mrz.parsed(spark.createDataFrame([lines], "upper string, middle string, lower string"), as_of).first()


def test_published_sample(spark):
    r = parse(spark, SAMPLE)
    assert r.mrz_checks_ok and [c.computed for c in r.mrz_checks] == [7, 2, 9, 6]
    assert (r.mrz_document_number, r.mrz_birth_date, r.mrz_expiry_date) == ("D23145890", dt.date(1974, 8, 12), dt.date(2012, 4, 15))
    assert (r.mrz_surnames, r.mrz_given_names, r.mrz_sex, r.mrz_document_type) == ("ERIKSSON", "ANNA MARIA", "F", "I")


@pytest.mark.parametrize("line,place,failed", [(0, 13, ["numero_documento", "compuesto"]), (1, 3, ["fecha_nacimiento", "compuesto"]), (1, 20, ["compuesto"])])
def test_tampering(spark, line, place, failed):
    lines = list(SAMPLE)
    lines[line] = lines[line][:place] + "9" + lines[line][place + 1 :]
    assert parse(spark, tuple(lines)).mrz_failed == failed


@pytest.mark.parametrize("payload,digit", [("D23145890", 7), ("740812", 2), ("120415", 9)])
def test_check_digits(spark, payload, digit):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(mrz.check_digit(F.col("p"), len(payload))).first()[0] == digit


@pytest.mark.parametrize("lines,error", [(["A"] * 3, "line_length"), (list(SAMPLE[:2]), "line_count"), ([SAMPLE[0], SAMPLE[1].lower(), SAMPLE[2]], "characters"), (list(SAMPLE), None)])
def test_shapes(spark, lines, error):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(mrz.shape_error(F.col("l"))).first()[0] == error


@pytest.mark.parametrize("raw,past,day", [("360108", True, dt.date(1936, 1, 8)), ("360108", False, dt.date(2036, 1, 8)), ("040415", True, dt.date(2004, 4, 15)), ("200415", False, dt.date(2020, 4, 15)), ("999999", True, None), ("12A415", False, None)])
def test_centuries(spark, raw, past, day):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(mrz.date_of(F.col("r"), AS_OF, past)).first()[0] == day


def read(spark, text):
    return mrz.read_zone(spark.createDataFrame([(text,)], "mrz_text string")).first()


def card(spark):
    df = spark.createDataFrame([("001234567", dt.date(1974, 8, 12), "F", dt.date(2030, 4, 15), "1020304050", "PEREZ", "ANA")], "n string, b date, s string, e date, i string, a string, g string")
    r = mrz.with_built_lines(df, *[F.col(c) for c in "nbseiag"]).first()
    return [r.upper, r.middle, r.lower]


def test_structure_and_repair(spark):
    u, m, low = card(spark)
    r = read(spark, "\n".join(["x", u, m, low]))
    assert (r.upper, r.middle, r.lower, r.repaired, r.mrz_error) == (u, m, low, False, None)
    r = read(spark, "\n".join([u.replace("COL", "C0L").replace("001234567", "OO1234S67"), m.replace("740812", "74O812").replace("COL", "C0I"), low]))
    assert (r.upper, r.repaired) == (u, False) and r.middle[15:18] != "C0I" and r.middle[:15] == m[:15]  # put right by place alone
    r = read(spark, "\n".join([u, m[:19] + "O" + m[20:], low]))  # the second digit of the identity number, a zero
    assert (r.middle, r.repaired) == (m, True)
    assert read(spark, "short\nlines").mrz_error == "unreadable"
    assert read(spark, None).upper is None


def test_two_broken_digits_are_left(spark):
    u, m, low = card(spark)
    lines = [u, m[:6] + str((int(m[6]) + 1) % 10) + m[7:29] + str((int(m[29]) + 3) % 10), low]
    r = read(spark, "\n".join(lines))
    assert not r.repaired and r.middle == lines[1]


def test_build_round_trip(spark):
    df = spark.createDataFrame([("12", dt.date(1990, 2, 3), "m", dt.date(2030, 1, 1), "1234567", "DE LA CRUZ", "ANA")], "n string, b date, s string, e date, i string, a string, g string")
    built = mrz.with_built_lines(df, *[F.col(c) for c in "nbseiag"])
    r = mrz.parsed(built, AS_OF).first()
    assert r.mrz_checks_ok and (r.mrz_nuip, r.mrz_surnames, r.mrz_given_names, r.mrz_birth_date) == ("1234567", "DE LA CRUZ", "ANA", dt.date(1990, 2, 3))


def plain_repair(lines):
    """The search as it is told: one character, by line, place and CONFUSIONS, until all four digits close."""
    value = {c: i for i, c in enumerate(mrz.DIGITS)} | {"<": 0}
    spans = (((0, 5, 14),), ((1, 0, 6),), ((1, 8, 14),), ((0, 5, 30), (1, 0, 7), (1, 8, 15), (1, 18, 29)))

    def closes(x):
        return all(str(sum(value[c] * mrz.WEIGHTS[i % 3] for i, c in enumerate("".join(x[k][a:b] for k, a, b in s))) % 10) == x[k][p] for s, (k, p) in zip(spans, ((0, 14), (1, 6), (1, 14), (1, 29)), strict=True))

    if closes(lines):
        return None
    for k in range(2):
        for i, c in enumerate(lines[k]):
            for wrong, right in mrz.CONFUSIONS:
                tried = list(lines)
                tried[k] = lines[k][:i] + right + lines[k][i + 1 :]
                if c == wrong and closes(tried):
                    return "".join(tried)
    return None


def test_repairs_of_a_batch():
    """All rows of a batch at once, as the plain search repairs each of them."""
    rng, rows = random.Random(5), []
    for _ in range(400):
        lines = list("I<UTOD231458907<<<<<<<<<<<<<<<" + "7408122F1204159UTO<<<<<<<<<<<6")
        for _ in range(rng.choice((0, 1, 1, 2))):
            lines[rng.randrange(60)] = rng.choice("OQDISBZG01582654<")
        rows.append("".join(lines))
    codes = np.array([list(r.encode()) for r in rows], dtype=np.uint8)
    changed = mrz.single_repairs(codes)
    got = [bytes(c).decode() if x else None for c, x in zip(codes, changed, strict=True)]
    want = [plain_repair([r[:30], r[30:]]) for r in rows]
    assert got == want and sum(w is not None for w in want) > 20


def test_empty_batches_and_unread_rows(spark):
    df = spark.createDataFrame([("short",), (None,)], "mrz_text string").repartition(4)
    assert [(r.upper, r.repaired) for r in mrz.read_zone(df).collect()] == [(None, False)] * 2


def test_digits_of_numbers_are_those_of_characters(spark):
    """Lines of digits are summed as numbers; signs, blanks and other characters as they were before."""
    lines = ["012345678901234567890123456789", "9" * 30, "+23456789012345-23456789012345", " 1" * 15, "12345678901234é678901234567890", None]
    df = mrz.with_numbers(spark.createDataFrame([(x,) for x in lines], "x string"), v=(F.col("x"), 30))
    got = df.select(mrz.digit_of(("v", 30, 0, 7), 2, ("v", 30, 3, 30)).alias("a"), mrz.digit_over((F.col("v"), 0, 7), 2, (F.col("v"), 3, 30)).alias("b"), (F.col("v_0").isNull() & F.col("x").isNotNull()).alias("odd")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and [r["odd"] for r in got] == [False, False, True, True, True, False]


def test_century_of_a_leap_day_and_shape(spark):
    """29 February of 1900 was none, of 2000 was; what is no six digits is no date, whatever it sorts by."""
    df = spark.createDataFrame([("000229",), ("040229",), ("500229",), ("520229",), ("060101",), ("060102",), ("99O101",), ("991301",), (" 60101",), (None,)], "r string")
    days = [dt.date(2000, 2, 29), dt.date(2004, 2, 29), None, dt.date(1952, 2, 29), dt.date(2006, 1, 1), dt.date(1906, 1, 2), None, None, None, None]
    assert [r[0] for r in df.select(mrz.date_of(F.col("r"), dt.date(2006, 1, 1), True)).collect()] == days
    future = [dt.date(2000, 2, 29), dt.date(2004, 2, 29), None, dt.date(2052, 2, 29), dt.date(2006, 1, 1), dt.date(2006, 1, 2), None, None, None, None]
    assert [r[0] for r in df.select(mrz.date_of(F.col("r"), dt.date(2006, 1, 1), False)).collect()] == future
