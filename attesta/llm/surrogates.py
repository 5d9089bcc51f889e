r"""Surrogates for personal data and secrets, with DataFrame operations only.

Entities are found by one pattern: mail addresses, network addresses (both versions), telephone, card,
bank account (IBAN) and social security numbers, passwords, tokens and keys, names behind a title, and
names that begin with a common given name. What looks like an account number but has wrong check
digits stays, as does an address of one group (::1), which is nobody's. Each entity becomes parts with a canonical form (the
digits of a number, the lower-case address, the mail domain, each word of a name), and each
distinct (kind, canonical form) gets one replacement, made from a keyed hash: digit for digit and
letter for letter in the same script; country code, first card digit, Luhn and IBAN validity, key prefix,
hexadecimal digits and top-level domain are kept; given names follow the gender of the title, or
their own where the title has none. A
mention then takes its replacement in its own separators and case. So two spellings of a number, an
address in upper case, or "Mr Smith" and "Mr John Smith", stay in agreement everywhere.

Replacements must be distinct, and no entity's own value: those that collide, save one, are made
anew from the next hash, until none collides. A mail's local part has to be distinct within its
domain, and a domain within its last label, as the whole address is then. After some rounds at the
entity's own length every further round makes the rest a letter or a syllable longer (numbers a
digit), so no space is too small. Network addresses of four numbers alone have a fixed space, of 3.6
billion; where entities fill it, the job ends with an error after MOST_ATTEMPTS rounds.
A part without any letter or digit stays. Mentions meet replacements in an equi-join on the
entity, of which Spark can split a hot side; a document's mentions are put together by document.

Cases: null text stays null with 0 entities; texts without entities are unchanged. Texts are
taken whole. Repeated rows get equal results. An empty table gives an empty result. Columns besides
the text are kept as they are, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.tables import fresh, numbered, read, written

# Titles by gender, given names by gender and script, syllables and alphabets by script.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
NEUTRAL_TITLES = ("Dr", "Doctor", "Prof", "Professor")
TITLES = MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES
NAMES = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Henry", "Ivan", "Jonas", "Louis", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"),
    ("f", "latin"): ("Alice", "Bertha", "Clara", "Diana", "Emma", "Flora", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Vera"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев", "Марк", "Олег", "Павел", "Роман"),
    ("f", "cyrillic"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Раиса"),
}
# Common given names, by which names without a title are found, and the country codes of two digits.
MALE_NAMES = ("Alexander", "Andrew", "Anthony", "Benjamin", "Charles", "Christopher", "Daniel", "Edward", "George", "Hans", "Jack", "James", "Jean", "John", "Joseph", "José", "Juan", "Kevin", "Michael", "Nicholas", "Patrick", "Peter", "Pierre", "Richard", "Steven", "Thomas", "William")
FEMALE_NAMES = ("Amanda", "Ana", "Anna", "Barbara", "Carmen", "Catherine", "Charlotte", "Christine", "Elizabeth", "Emily", "Hannah", "Jane", "Jennifer", "Jessica", "Karen", "Katherine", "Lisa", "Margaret", "Marie", "Mary", "Michelle", "Nancy", "Patricia", "Rachel", "Sarah", "Susan", "Ursula")
COUNTRIES = r"20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
SYLLABLES = {"latin": ("ba", "den", "fel", "gor", "han", "kel", "lin", "mar", "nor", "pel", "ros", "sten", "tal", "ver", "wil", "zan"), "cyrillic": ("ба", "ден", "вел", "гор", "лин", "мар", "нов", "пет", "рос", "сав", "тал", "зан")}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "hex": "abcdef", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "han": "安白成大方高国海和江金林明南平石天文新永", "digit": "0123456789"}

FEMALE_GIVEN = FEMALE_NAMES + NAMES["f", "latin"] + NAMES["f", "cyrillic"]
GIVEN = MALE_NAMES + NAMES["m", "latin"] + NAMES["m", "cyrillic"] + FEMALE_GIVEN
#: After so many rounds without a free address the job gives up.
MOST_ATTEMPTS = 200
HEX = "[0-9A-Fa-f]{1,4}"
CAPITAL = rf"(?!(?:{'|'.join(TITLES)})\b)\p{{Lu}}[\p{{L}}\-]+"

KINDS = {
    # a run begins where none goes on, or where the last mention ended, and is not given up: long runs without @ stay linear
    "mail": r"(?:(?<![\p{L}\p{N}._%+\-])|\G)[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "ip6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|(?:{HEX}:){{2,7}}:|:(?::{HEX}){{2,7}})(?![\w:])",
    "ssn": r"(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w.\-])(?:\+?\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.\-])(?:\+\d{1,3}[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\w)|(?<!\w)\+\d{8,15}(?!\w)|(?<!\w)\+\d(?:[ .\-/]?\(?\d\)?){7,14}(?!\w)",
    "card": r"(?<![\w.\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\w\-])",
    "key": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "secret": r"(?<=password=|passwd=|pwd=|secret=|api_key=|token=|token = \")[^\s\"']+",
    "name": rf"(?<!\w)(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? {CAPITAL}(?: {CAPITAL})?|(?:{'|'.join(GIVEN)}) {CAPITAL})(?!\w)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Texts without any of these have no entity; a search of this pattern is much cheaper.
HINT = rf"[@\d]|=|token|AKIA|(?<!\w)(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? |(?:{'|'.join(GIVEN)}) \p{{Lu}})"


def _kind(value: Column) -> Column:
    out = F.lit("secret")
    for kind, pattern in reversed([(k, p) for k, p in KINDS.items() if k != "secret"]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _part(kind, canon, original) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("kind"), lit(canon).cast("string").alias("canon"), lit(original).alias("original"))


def _mod_97(account: Column) -> Column:
    """The remainder of an account number that decides on its check digits: the first four characters last, A = 10, ..., Z = 35."""
    text = F.upper(F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4)))
    one = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(one(acc, c)).cast("int"))


def _parts(kind: Column, value: Column) -> Column:
    """The parts of a mention, in order; parts of kind 'keep' stay."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    words = F.split(value, " ")
    title, last = F.regexp_replace(F.element_at(words, 1), r"\.$", ""), F.element_at(words, -1)
    titled = title.isin(*TITLES)
    given = F.when(~titled, F.element_at(words, 1)).when(F.size(words) == 3, F.element_at(words, 2))
    female = F.when(title.isin(*FEMALE_TITLES), True).when(title.isin(*MALE_TITLES), False).otherwise(given.isin(*FEMALE_GIVEN))
    kept = lambda text: _part("keep", F.lit(None), text)
    before = F.when(titled, F.array(kept(F.concat(F.element_at(words, 1), F.lit(" "))))).otherwise(F.array().cast("array<struct<kind:string,canon:string,original:string>>"))
    middle = F.when(given.isNotNull(), F.array(_part(F.when(female, "given_f").otherwise("given_m"), given, given), kept(F.lit(" ")))).otherwise(F.array().cast("array<struct<kind:string,canon:string,original:string>>"))
    name = F.concat(before, middle, F.array(_part("surname", last, last)))
    digits, account = F.regexp_replace(value, r"\D", ""), F.regexp_replace(value, " ", "")
    # a short number behind a + begins with a country code, unlike one of ten digits without it
    phone = F.when(value.startswith("+") & (F.length(digits) <= 10), F.concat(F.lit("+"), digits)).otherwise(digits)
    return (
        F.when(kind == "mail", F.array(_part("mail", F.lower(value), local), kept(F.lit("@")), _part("domain", F.lower(domain), domain)))
        .when(kind == "name", name)
        .when(kind.isin("card", "ssn"), F.array(_part(kind, digits, value)))
        .when(kind == "phone", F.array(_part(kind, phone, value)))
        .when(kind == "iban", F.array(_part(F.when(_mod_97(account) == 1, "iban").otherwise("keep"), account, value)))
        .when(kind == "ip6", F.array(_part(kind, F.lower(value), value)))
        .otherwise(F.array(_part(kind, value, value)))
    )


def mentions(docs: DataFrame) -> DataFrame:
    """row, pos, sub, kind, canon, original of the entities of docs (row, text)."""
    found = docs.filter(F.col("text").rlike(HINT)).select("row", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "value"))
    found = found.withColumn("kind", _kind(F.col("value")))
    found = found.select("row", "pos", F.posexplode(_parts(F.col("kind"), F.col("value"))).alias("sub", "part")).select("row", "pos", "sub", "part.*")
    head = F.when(F.col("kind") == "domain", F.regexp_replace("original", r"\.[^.]*$", "")).otherwise(F.col("original"))
    return found.withColumn("kind", F.when(head.rlike(r"[\p{L}\p{N}]"), F.col("kind")).otherwise("keep"))


def _digest(seed: Column, n: Column) -> Column:
    """Hexadecimal digits of keyed hashes of an entity, eight for each of n places at least."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 8).cast("int")), lambda i: F.sha2(F.concat_ws("|", seed, i.cast("string")), 256)), "")


def _number(digest: Column, i: Column) -> Column:
    """A number below 2^32 for a place of an entity."""
    return F.conv(F.substring(digest, (i * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), (number % len(letters) + 1).cast("int"), F.lit(1)) if isinstance(letters, str) else F.element_at(F.array(*[F.lit(x) for x in letters]), (number % len(letters) + 1).cast("int"))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one undoubled."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, (i + 1).cast("int"), F.lit(1)).cast("int")
    worth = lambda i: F.when((n - i) % 2 == 1, value(i)).otherwise(F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2))
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + x)


def _seed(key: str) -> Column:
    return F.concat_ws("|", F.lit(key), F.col("kind"), F.col("canon"), F.col("attempt").cast("string"))


def _replacement(key: str, rounds: int) -> tuple[Column, Column]:
    """The replacement of an entity (kind, canon, body, attempt, _digest): as many letters and digits as its body has, and more from attempt `rounds` on."""
    seed, digest = _seed(key), F.col("_digest")
    body, kind = F.col("body"), F.col("kind")
    hexed = kind.isin("secret", "ip6") & body.rlike("^[0-9a-fA-F]+$")
    n = F.length(body)
    code = F.when(body.rlike("^[17]"), 1).when(body.rlike(f"^(?:{COUNTRIES})"), 2).otherwise(3)
    keep = F.when((kind == "phone") & ((n > 10) | F.col("canon").startswith("+")), F.greatest(n - 10, code)).when(kind == "card", 1).when(kind == "iban", 2).when(kind == "key", 4).otherwise(0)

    def one(c, i):
        x = _number(digest, i)
        letter = F.when(hexed, _pick(ALPHABETS["hex"], x)).when(c.rlike(r"\p{IsCyrillic}"), _pick(ALPHABETS["cyrillic"], x)).when(c.rlike(r"\p{IsGreek}"), _pick(ALPHABETS["greek"], x)).when(c.rlike(r"\p{IsHan}"), _pick(ALPHABETS["han"], x)).otherwise(_pick(ALPHABETS["latin"], x))
        return F.when(i < keep, c).when(c.rlike(r"\p{N}"), F.when((kind == "phone") & (i == keep), _pick("23456789", x)).otherwise(_pick(ALPHABETS["digit"], x))).otherwise(letter)

    # what attempts after the first rounds add, each one more
    cyrillic = F.col("canon").rlike(r"\p{IsCyrillic}")
    latin_or = lambda latin, other: F.when(cyrillic, other).otherwise(latin)
    added = F.when(F.col("attempt") >= rounds, F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("attempt") - rounds + 1))).otherwise(F.array().cast("array<int>"))
    pick_more = lambda made: F.array_join(F.transform(added, lambda i: made(_number(F.sha2(F.concat_ws("|", seed, F.concat(F.lit("+"), i.cast("string"))), 256), F.lit(0)))), "")
    more_syllables = pick_more(lambda x: latin_or(_pick(SYLLABLES["latin"], x), _pick(SYLLABLES["cyrillic"], x)))
    more_letters = pick_more(lambda x: F.when(body.rlike(r"^\p{N}+$"), _pick(ALPHABETS["digit"], x)).when(hexed, _pick(ALPHABETS["hex"], x)).otherwise(latin_or(_pick(ALPHABETS["latin"], x), _pick(ALPHABETS["cyrillic"], x))))
    same = F.concat(F.array_join(F.transform(F.split(body, ""), one), ""), more_letters)
    # the last digit of a card whose number is valid makes the new number valid
    zero = F.concat(F.substring(same, 1, 1), F.expr("substring(_same, 2, length(_same) - 2)"), F.lit("0"))
    numbers = lambda i: _number(digest, F.lit(i))
    # the check digits that make the new account number valid
    checked = F.lpad((98 - _mod_97(F.concat(F.substring("_same", 1, 2), F.lit("00"), F.expr("substring(_same, 5)")))).cast("string"), 2, "0")
    ip = F.concat_ws(".", (numbers(0) % 223 + 1).cast("string"), *[(numbers(i) % 254 + 1).cast("string") for i in (1, 2, 3)])

    def syllables(first, count, script):
        return F.concat(*[_pick(SYLLABLES[script], numbers(first + i)) for i in range(count)])

    surname = F.initcap(F.when(cyrillic, syllables(0, 4, "cyrillic")).otherwise(syllables(0, 4, "latin")))
    given = lambda g: F.when(cyrillic, _pick(NAMES[g, "cyrillic"], numbers(0))).otherwise(_pick(NAMES[g, "latin"], numbers(0)))
    surname = F.concat(surname, more_syllables)
    more = F.concat(F.when(F.col("attempt") == 0, "").when(cyrillic, syllables(1, 3, "cyrillic")).otherwise(syllables(1, 3, "latin")), more_syllables)
    return same, F.when(kind == "ip", ip).when(kind == "surname", surname).when(kind == "given_m", F.concat(given("m"), more)).when(kind == "given_f", F.concat(given("f"), more)).when(
        (kind == "card") & (_luhn(F.col("canon")) % 10 == 0), F.concat(F.expr("substring(_same, 1, length(_same) - 1)"), ((10 - _luhn(zero) % 10) % 10).cast("string"))
    ).when(kind == "iban", F.concat(F.substring("_same", 1, 2), checked, F.expr("substring(_same, 5)"))).otherwise(F.col("_same"))


def replacements(found: DataFrame, key: str, rounds: int = 4) -> DataFrame:
    """kind, canon, replacement of every entity of found; no two surrogates of a kind are equal, none is an entity's own value.

    rounds: attempts at the entity's own length, before replacements grow.
    """
    body = F.regexp_replace("original", r"[^\p{L}\p{N}]", "")
    # of a domain, the last label stays
    body = F.when(F.col("kind") == "domain", F.regexp_replace(F.regexp_replace("original", r"\.[^.]*$", ""), r"[^\p{L}\p{N}]", "")).otherwise(body)
    todo = found.filter("kind <> 'keep'").groupBy("kind", "canon").agg(F.min(F.when(F.col("kind").isin("secret", "key"), body).otherwise(F.lower(body))).alias("body"))
    # where replacements have to be distinct: what stands beside them in the whole surrogate
    within = F.when(F.col("kind") == "mail", F.substring_index("canon", "@", -1)).when(F.col("kind") == "domain", F.substring_index("canon", ".", -1)).otherwise("")
    todo = written(todo.withColumn("within", within).withColumn("attempt", F.lit(0)), "entities")
    own = todo.select("kind", "within", F.when(F.col("kind").isin("ip", "surname", "given_m", "given_f"), F.col("canon")).otherwise(F.lower("body")).alias("replacement"))
    done = None
    same, made = _replacement(key, rounds)
    for _ in range(MOST_ATTEMPTS):
        fresh = written(todo.withColumn("_digest", _digest(_seed(key), F.length("body"))).withColumn("_same", same).withColumn("replacement", made).drop("_same", "_digest").withColumn("old", F.lit(1)), "made")
        every = fresh if done is None else fresh.unionByName(done.withColumn("old", F.lit(0)))
        winners = every.groupBy("kind", "within", "replacement").agg(F.min(F.struct("old", "canon")).alias("winner"))
        winners = winners.join(own.distinct(), ["kind", "within", "replacement"], "left_anti").select("kind", F.col("winner.canon").alias("canon"), F.lit(True).alias("won"))
        judged = written(fresh.join(winners, ["kind", "canon"], "left"), "judged")
        won = judged.filter("won").drop("won", "old")
        done = won if done is None else done.unionByName(won)
        todo = judged.filter("won is null").drop("won", "old", "replacement").withColumn("attempt", F.col("attempt") + 1)
        if todo.isEmpty():
            return done.select("kind", "canon", "replacement")
    raise ValueError(f"entities without a free replacement after {MOST_ATTEMPTS} rounds")


def _dressed(original: Column, replacement: Column, kind: Column) -> Column:
    """The replacement in the separators and the case of the mention."""
    tail = F.when(kind == "domain", F.concat(F.lit("."), F.substring_index(original, ".", -1))).otherwise("")
    head = F.when(kind == "domain", F.regexp_replace(original, r"\.[^.]*$", "")).otherwise(original)
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))

    def step(acc, c):
        new = F.substring(replacement, acc["at"], F.lit(1))
        new = F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(new)).otherwise(new)
        on = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc["text"], F.when(on, new).otherwise(c)).alias("text"), (acc["at"] + on.cast("int")).alias("at"))

    # what a grown replacement has beyond the mention's own letters and digits comes after them
    loud = (F.upper(head) == head) & (F.lower(head) != head)
    filled = F.aggregate(F.split(head, ""), start, step, lambda acc: F.concat(acc["text"], F.when(loud, F.upper(F.substring(replacement, acc["at"], F.length(replacement)))).otherwise(F.substring(replacement, acc["at"], F.length(replacement)))))
    whole = F.when(F.upper(original) == original, F.upper(replacement)).otherwise(replacement)
    return F.when(kind == "keep", original).when(kind == "ip", replacement).when(kind.isin("surname", "given_m", "given_f"), whole).otherwise(F.concat(filled, tail))


def replace_entities(docs: DataFrame, key: str, text_col="text", n_entities_col="_n_entities") -> DataFrame:
    """docs with replaced entities, and their number."""
    row, new, between = fresh(docs, "row"), fresh(docs, "new_parts"), fresh(docs, "between")
    docs = numbered(docs, row)
    found = written(mentions(docs.select(F.col(row).alias("row"), F.col(text_col).alias("text"))), "mentions")
    by = written(replacements(found, key), "replacements")
    kept = found.filter("kind = 'keep'").withColumn("replacement", F.lit(None).cast("string"))
    parts = found.filter("kind <> 'keep'").join(by, ["kind", "canon"]).unionByName(kept)
    parts = parts.select("row", "pos", "sub", _dressed(F.col("original"), F.col("replacement"), F.col("kind")).alias("new"))
    whole = parts.groupBy("row", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "new"))), lambda p: p["new"]), "").alias("new"))
    per_doc = whole.groupBy(F.col("row").alias(row)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda p: p["new"]).alias(new))
    # texts without a hint of an entity pass by the join; the others meet their replacements by a shuffle at every size
    hinted = F.coalesce(F.col(text_col).rlike(HINT), F.lit(False))
    out = docs.filter(hinted).join(written(per_doc, "per_document").hint("merge"), row, "left")
    out = out.withColumn(between, F.when(F.col(new).isNotNull(), F.split(F.col(text_col), PATTERN, -1)))
    # text between mentions is null-safe: the last piece has no mention after it
    joined = F.array_join(F.transform(F.arrays_zip(F.col(between).alias("a"), F.col(new).alias("b")), lambda p: F.concat(p["a"], F.coalesce(p["b"], F.lit("")))), "")
    out = out.withColumn(text_col, F.when(F.col(new).isNotNull(), joined).otherwise(F.col(text_col)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != row]
    out = out.select(*kept, F.coalesce(F.size(new), F.lit(0)).cast("long").alias(n_entities_col))
    return out.unionByName(docs.filter(~hinted).select(*kept, F.lit(0).cast("long").alias(n_entities_col)))


def query(spark, sf_dir, key="a key of the owner's"):
    return replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), key).withColumnRenamed("_n_entities", "n_entities")
