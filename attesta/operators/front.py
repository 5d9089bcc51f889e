"""Fields of a card's front from the words' boxes: rows, printed labels, values below them, rescue by order.

words: capture_id, word_id, text, conf, left, top, width, height. A capture has some hundred words at most;
they stand in its row as an array, and a vectorized helper reads a batch of such rows at once: no exchange, join
or window, and no expression that is interpreted word after word.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import ROUND_HALF_UP, Context, Decimal
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import label_key, plain_label_key

KEY = "capture_id"

# Fixed values, which decide what is read from a card and so must be these: how far words of a row and a
# label's value may lie apart (pixels), the forms of a printed date (14 ENE 1998) and of an identity number
# with its points (1.234.567.890; digits and blanks are ASCII), the printed labels in the order in which they are looked for, and the
# dates from top to bottom.
ROW_TOLERANCE = 14
VALUE_GAP = 60
DATED = re.compile(r"\b[0-9]{1,2}[ \t\n\v\f\r]+[A-Za-z]{3}[A-Za-z0-9_]*[ \t\n\v\f\r]+[0-9]{4}\b")
NUIP = re.compile(r"\b[0-9]{1,3}(?:[. \t\n\v\f\r][0-9]{3}){2,3}\b")
LABELS = (
    ("fecha y lugar de expedicion", "issue"), ("fecha de nacimiento", "birth_date"), ("lugar de nacimiento", "birth_place"), ("fecha de expiracion", "expiry_date"), ("nacionalidad", "nationality"), ("apellidos", "surnames"),
    ("estatura", "height"), ("nombres", "given_names"), ("sexo", "sex"), ("nuip", "nuip"), ("gs", "blood_group"),
)
DATES = ("birth_date", "issue", "expiry_date")


def clean_words(words: DataFrame) -> DataFrame:
    return words.withColumn("text", F.trim("text")).filter((F.col("text") != "") & (F.col("conf") >= 0)).withColumn("middle", (F.col("top") + F.floor(F.col("height") / 2)).cast("int")).withColumn("right", F.col("left") + F.col("width"))


WORD = ("word_id", "text", "conf", "left", "top", "width", "height")


FIELD = "array<struct<field:string,value:string,confidence:double,source:string>>"
#: Fields found by vertical order, where no label gave them: dates, the number, names.
RESCUED = (*DATES, "nuip", "surnames", "given_names")
ORDER = (*[name for _, name in LABELS], *RESCUED)


def _sorted_by(*keys: np.ndarray) -> np.ndarray:
    """Places in the order of keys, the first one first. As one number where they fit in it."""
    packed, room = np.zeros(len(keys[0]), dtype=np.int64), 1
    for k in keys:
        low, span = int(k.min()), int(k.max()) - int(k.min()) + 1
        if (room := room * span) >= 1 << 62:
            return np.lexsort(keys[::-1])
        packed = packed * span + (k - low)
    return np.argsort(packed, kind="stable")


def _words(captures: pa.Array) -> tuple[dict[str, np.ndarray], list[str]]:
    """Words of a batch of captures as columns, sorted by capture, middle and left, and the different texts in their order; text is a place among these. Words without a text, a box or a known confidence are left out."""
    flat = captures.flatten()
    flat = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    seen = flat["text"].dictionary_encode()
    plain = [t.strip(" ") for t in seen.dictionary.to_pylist()]
    texts = sorted(set(plain))
    rank = {t: i for i, t in enumerate(texts)}
    text = np.array([*[rank[t] for t in plain], -1], dtype=np.int64)[pc.fill_null(seen.indices.cast("int64"), len(plain)).to_numpy()]
    there = text >= 0
    if "" in rank:
        there &= text != rank[""]
    col = {}
    for c in WORD:
        if c != "text":
            there &= flat[c].is_valid().to_numpy(zero_copy_only=False)
            col[c] = pc.fill_null(flat[c], 0).to_numpy().astype(np.float64 if c == "conf" else np.int64)
    there &= (col["conf"] >= 0) | np.isnan(col["conf"])
    of = np.repeat(np.arange(len(captures)), pc.fill_null(pc.list_value_length(captures), 0).to_numpy())
    w = {"of": of, "text": text, "middle": col["top"] + col["height"] // 2, "left": col["left"], "id": col["word_id"], "conf": col["conf"], "right": col["left"] + col["width"], "bottom": col["top"] + col["height"]}
    w = {c: v[there] for c, v in w.items()}
    if len(w["of"]):
        w = _placed(w, "of", "middle", "left")
    return w, texts


def _placed(w: dict[str, np.ndarray], *keys: str) -> dict[str, np.ndarray]:
    """Words in the order of keys; those at one place by id, and then by all that they have."""
    at = _sorted_by(*[w[k] for k in keys], w["id"])
    same = np.ones(max(len(at) - 1, 0), dtype=bool)
    for k in (*keys, "id"):
        same &= w[k][at][1:] == w[k][at][:-1]
    if same.any():
        at = np.lexsort([w[k] for k in (*keys, "id", "text", "conf", "right", "bottom")][::-1])
    return {c: v[at] for c, v in w.items()}


def _rows(w: dict[str, np.ndarray]) -> np.ndarray:
    """Numbers the rows of all captures from the top, in w["row"], and puts their words in order; where each row begins, and the end.

    A word joins the row whose first word's middle is within the tolerance. Words are sorted by middle, so the next row
    begins at the first word beyond it: rows of all captures are found in step. row_middle is the upper median of the row's middles.
    """
    span = int(w["middle"].max()) - int(w["middle"].min()) + ROW_TOLERANCE + 2
    place = w["of"] * span + (w["middle"] - w["middle"].min())
    after = np.searchsorted(place, place + ROW_TOLERANCE, side="right")
    begins, at = np.zeros(len(place) + 1, dtype=bool), np.flatnonzero(np.r_[True, w["of"][1:] != w["of"][:-1]])
    while len(at):
        begins[at] = True
        ahead = after[at]
        inside = ahead < len(place)
        inside[inside] = w["of"][ahead[inside]] == w["of"][at[inside]]
        at = ahead[inside]
    begins[-1] = True
    edges = np.flatnonzero(begins)
    w["row"] = np.cumsum(begins[:-1]) - 1
    w["row_middle"] = w["middle"][edges[:-1] + np.diff(edges) // 2][w["row"]]
    w |= _placed(w, "row", "left")
    return edges


def _firsts(of: np.ndarray) -> np.ndarray:
    """Where each value of sorted ones stands first."""
    return np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)


def _labelled(w: dict[str, np.ndarray], keys: np.ndarray, codes: dict[str, int], n: int, page_width: int):
    """For each printed label, in order: the places of the words of its values. keys: codes of the words' label keys.

    A label counts at its first place. Its value stands beside it for the number, else in the nearest row below with a word in its column.
    """
    span = int(w["left"].max()) - int(w["left"].min()) + 2
    place = w["row"] * span + (w["left"] - w["left"].min()) + 1
    for label, name in LABELS:
        parts = [codes[x] for x in label.split()]
        k, m = len(parts), max(len(keys) - len(parts) + 1, 0)
        same = (w["row"][:m] == w["row"][k - 1 :]) if m else np.zeros(0, dtype=bool)
        for j, part in enumerate(parts):
            same &= keys[j : m + j] == part
        at = np.flatnonzero(same)
        at = at[_firsts(w["of"][at])]
        own = [at + j for j in range(k)]
        right, bottom = w["right"][own[-1]], np.max([w["bottom"][x] for x in own], axis=0)
        # the next words of the label's row
        beyond = np.searchsorted(place, w["row"][at] * span + np.clip(right + 20 - w["left"].min() + 1, 0, span - 1), side="right")
        near = np.minimum(beyond, len(place) - 1)
        limit = np.where((beyond < len(place)) & (w["row"][near] == w["row"][at]), w["left"][near] - 10, page_width)
        which = np.full(n, -1)
        which[w["of"][at]] = np.arange(len(at))
        words = np.flatnonzero(which[w["of"]] >= 0)
        x = which[w["of"][words]]
        if name == "nuip":
            yield words[(w["row"][words] == w["row"][at][x]) & (w["left"][words] > right[x])]
            continue
        low = w["row_middle"][words]
        value = (w["row"][words] != w["row"][at][x]) & (low > bottom[x]) & (low < bottom[x] + VALUE_GAP) & (w["left"][words] >= w["left"][at][x] - 15) & (w["right"][words] <= limit[x] + 15)
        for one in own:
            value &= w["id"][words] != w["id"][one][x]
        words = words[value]
        first = np.full(n, -1)
        heads = words[_firsts(w["of"][words])]
        first[w["of"][heads]] = w["row"][heads]
        yield words[w["row"][words] == first[w["of"][words]]]


def _capital(text: str) -> bool:
    """Upper-case letters alone; a line's end may follow."""
    letters = re.sub(r"(\r\n|[\n\r\x85\u2028\u2029])\Z", "", text)
    return letters != "" and all(unicodedata.category(c) == "Lu" for c in letters)


def _rescued(rows: list[tuple[int, list[str]]]) -> list[tuple[int, str, int]]:
    """(place in RESCUED, value, row) by vertical order, of the (row_middle, words) of one capture: the n-th dated row is the n-th date even if that was found by its label."""
    lines = [" ".join(words) for _, words in rows]
    found = [(i, lines[r], r) for i, r in enumerate([r for r, line in enumerate(lines) if DATED.search(line)][: len(DATES)])]
    number = next(((r, m) for r, line in enumerate(lines) if (m := NUIP.search(line))), None)
    if number is not None:
        r, m = number
        found.append((len(DATES), m[0], r))
        names = (i for i, (middle, words) in enumerate(rows) if middle > rows[r][0] and all(map(_capital, words)))
        found += [(len(DATES) + 1 + i, lines[at], at) for i, at in enumerate(islice(names, 2))]
    return found


def _rounded(values: np.ndarray) -> np.ndarray:
    """To six places, half up, of the number as it is printed."""
    some, back = np.unique(values, return_inverse=True)
    up = [float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP, Context(prec=400))) if np.isfinite(x) else x for x in some.tolist()]
    return np.array(up, dtype=np.float64)[back]


def _means(w: dict[str, np.ndarray], words: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    return _rounded(np.bincount(segment, w["conf"][words], n) / np.maximum(np.bincount(segment, minlength=n), 1) / 100)


def read_batch(captures: pa.Array, page_width: int) -> pa.Array:
    """FIELD of each array of WORD; null of a null one."""
    n = len(captures)
    w, texts = _words(captures)
    caps, places, values, conf = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [pa.array([], pa.string())], [np.zeros(0)]
    if len(w["of"]):
        edges = _rows(w)
        codes = {x: i for i, x in enumerate(dict.fromkeys(x for label, _ in LABELS for x in label.split()))}
        keys = np.array([codes.get(plain_label_key(t), -1) for t in texts])[w["text"]]
        printed, have = pa.array(texts, pa.string()), np.zeros((n, len(ORDER)), dtype=bool)
        for i, words in enumerate(_labelled(w, keys, codes, n, page_width)):
            heads = _firsts(w["of"][words])
            at = w["of"][words[heads]]
            have[at, i] = True
            caps.append(at)
            places.append(np.full(len(at), i))
            segment = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(words)]))
            values.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[heads, len(words)], pa.int32()), printed.take(pa.array(w["text"][words]))), " "))
            conf.append(_means(w, words, segment, len(heads)))
        # a field that its label gave is not looked for by order
        gaps = np.flatnonzero(~have[:, [ORDER.index(c) for c in RESCUED]].all(axis=1))
        of_row = w["of"][edges[:-1]]
        bounds = np.searchsorted(of_row, np.r_[gaps, gaps + 1]).reshape(2, -1)
        rest = []
        for c, a, b in zip(gaps.tolist(), *bounds.tolist(), strict=True):
            rows = [(int(w["row_middle"][edges[r]]), [texts[t] for t in w["text"][edges[r] : edges[r + 1]].tolist()]) for r in range(a, b)]
            rest += [(c, len(LABELS) + i, value, a + r) for i, value, r in _rescued(rows) if not have[c, ORDER.index(RESCUED[i])]]
        if rest:
            c, i, value, row = zip(*rest, strict=True)
            caps.append(np.array(c))
            places.append(np.array(i))
            values.append(pa.array(value, pa.string()))
            conf.append(_means(w, np.arange(len(w["of"])), w["row"], len(edges) - 1)[list(row)])
    caps, places = np.concatenate(caps), np.concatenate(places)
    at = np.argsort(caps * len(ORDER) * 2 + places, kind="stable")
    said = pa.array([*["label"] * len(LABELS), *["order"] * len(RESCUED)]).take(pa.array(places[at]))
    fields = pa.StructArray.from_arrays([pa.array(ORDER).take(pa.array(places[at])), pa.concat_arrays(values).take(pa.array(at)), pa.array(np.concatenate(conf)[at]), said], ["field", "value", "confidence", "source"])
    ends = np.cumsum(np.bincount(caps, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), fields, mask=captures.is_null() if captures.null_count else None)


def _read(words: Column, page_width: int) -> Column:
    @F.arrow_udf(FIELD)
    def run(words: pa.Array) -> pa.Array:
        return read_batch(words, page_width)

    return run(words)


def read_sets(captures: DataFrame, page_width: int = 1012) -> DataFrame:
    """captures (words: array of WORD; the other columns stay) with fields, an array of (field, value, confidence, source), instead of words."""
    return captures.withColumn("fields", _read(F.col("words"), page_width)).drop("words")


def read_front(words: DataFrame, page_width: int = 1012) -> DataFrame:
    """KEY, field, value, confidence, source of every capture."""
    return field_rows(read_sets(words.groupBy(KEY).agg(F.collect_list(F.struct(*WORD)).alias("words")), page_width))


def field_rows(sets: DataFrame) -> DataFrame:
    # outer, and empty ones left out afterwards: Spark would put a filter for them below the reading, and read twice
    return sets.select(KEY, F.inline_outer("fields")).filter("field is not null")


CHECKS = ("nuip", "surnames", "given_names", "birth_date", "issue", "expiry_date", "sex", "birth_place")


def _judged(df: DataFrame) -> DataFrame:
    # texts that are the same have the same key: most need none made
    same = F.when(F.col("value") == F.col("expected"), True).otherwise(label_key(F.col("value")) == label_key(F.col("expected")))
    return df.withColumn("found", F.col("value").isNotNull()).withColumn("correct", F.coalesce(same, F.lit(False)))


def against_truth(fields: DataFrame, truth: DataFrame) -> DataFrame:
    """truth (KEY, field, expected) with found and correct; names compare without accents, the rest as printed."""
    return _judged(truth.join(fields, [KEY, "field"], "left"))


def against_truth_sets(sets: DataFrame) -> DataFrame:
    """against_truth() of read_sets() with truth, an array of (field, expected): a row for each of these, made in the capture's own row."""
    got = lambda t: F.get(F.filter("fields", lambda f: f["field"] == t["field"]), F.lit(0))
    # both columns are read once for each entry of truth, so they stand in columns of their own
    met = sets.withColumn("_met", F.when(F.size("fields") >= 0, F.transform("truth", lambda t: F.struct(t["field"].alias("field"), t["expected"].alias("expected"), got(t).alias("f")))))
    df = met.select(KEY, F.inline_outer("_met")).filter("field is not null").select(KEY, "field", "expected", "f.value", "f.confidence", "f.source")
    return _judged(df)
