"""Surrogates for personal data, in DataFrame expressions only.

Detected entities (e-mail addresses, IPv4 addresses, phone and card numbers, names with a title)
are replaced where they stand by surrogates of the same type and format. A surrogate is a keyed
function of the entity's canonical form (letter case, separators and blanks aside), so one
entity has one surrogate in all documents, whichever way it is written.

Numbers, addresses and words go through a keyed Feistel permutation of their digits and letters,
which moves each within its alphabet: digits; the plain vowels and consonants of a script; those
with the same accent. It is one-to-one among entities of a type and shape, so distinct entities
stay distinct, and changes every word of up to SHORT_WORD characters for sure, longer ones but
for a chance of one in the number of words of that shape. Card numbers keep their first digit and
whether their check digit is right; phone numbers their country code, told by its prefix, and
separators; e-mail addresses their separators and top-level domain, and equal domains stay equal;
IPv4 addresses stay valid. Names keep title, script and gender: given names come from a list of
that script and gender, family names (the last word), middle names and initials are permuted, so
that a family stays one; particles stay. Given names can collide, so all distinct names of the
corpus are checked: of those that share a surrogate all but the first take a double name, whose
further parts spell their number among them, and no two agree. Only these corrections are joined
back, to the documents that hold a title.

Defined cases: null and empty texts are returned as they are, with no entities; texts without
entities are untouched; equal rows, and rows with a null doc_id, are treated each for itself;
names in scripts without a list get permuted given names; letters that stand alone in their
script's alphabets (as ß and ς) stay; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import table, written

#: Set a secret one in production; surrogates cannot be undone without it.
KEY = "surrogate-key-1"
FEISTEL_ROUNDS = 4
#: Strings of up to so many characters go through one round, which leaves none as it is.
SHORT_WORD = 6

# Detection patterns, titles by gender, given names by script and gender.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.)++[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IPV4 = r"(?=\d)(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"
PHONE = r"(?=[+(\d])(?:(?<![\w+])\+[1-9]\d{7,14}(?![\w-])|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])|(?<![\w+(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w+.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))"
CARD = r"(?=[3-6])(?:(?<![\w.-])[3-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-]))"
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Señorita", "Signora", "г-жа", "госпожа", "κυρία"]
NEUTRAL = ["Dr", "Prof", "Mx"]
GIVEN = {
    "latin": {
        "m": "Adam Albert Anton Arthur Bruno Carl Daniel David Edgar Emil Eric Felix Frank George Henry Hugo Jacob John Leo Louis Lucas Martin Max Oliver Oscar Paul Peter Robert Simon Thomas Victor Walter".split(),
        "f": "Ada Alice Anna Bella Clara Diana Edith Ella Emma Eva Flora Grace Helen Ida Irene Jane Julia Laura Lena Lucy Marie Martha Nina Nora Olivia Paula Rosa Ruth Sara Sofia Tina Vera".split(),
        "n": "Alex Andrea Ariel Billie Casey Charlie Chris Dana Eden Ellis Frankie Harper Jamie Jean Jess Jordan Kai Kim Lee Logan Morgan Nicky Noa Parker Quinn Reese Riley Robin Sam Sidney Taylor Toni".split(),
    },
    "cyrillic": {
        "m": "Алексей Андрей Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Никита Олег Павел".split(),
        "f": "Алла Анна Вера Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Юлия".split(),
        "n": "Валя Женя Саша Слава Шура Тоня Паша Кира".split(),
    },
    "greek": {
        "m": "Αλέξης Γιάννης Δημήτρης Κώστας Λεωνίδας Νίκος Παύλος Στέφανος".split(),
        "f": "Άννα Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
        "n": "Αγάπη Άρης Ήλιος Θάλεια".split(),
    },
}
NAME_WORD = r"\p{Lu}[\p{L}\p{M}’-]{0,40}+"
PARTICLES = "von vom van de der den del della di da das do dos du la le zu zum zur af av ten ter te bin ibn".split()
_TITLE = f"(?=[{''.join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))}])(?:{'|'.join(MALE + FEMALE + NEUTRAL)})"
# Particles and a word; a further title begins another name.
_PART = rf"(?:(?:{'|'.join(PARTICLES)}) )*+(?!{_TITLE}(?![\p{{L}}\p{{M}}]))(?:\p{{Lu}}\.(?= \p{{Lu}})|{NAME_WORD}(?![\p{{L}}\p{{M}}]))"
NAME = rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.? {_PART}(?: {_PART})*+"
#: What a text with an entity other than a name has: at least five digits near each other, three numbers between dots, or an at sign.
NUMBERS = r"@|\d\.\d+\.\d|(?:\d[ .()-]{0,3}){5}"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, CARD, PHONE, NAME))

#: Country codes: those of one and of two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
VOWELS = set("aeiouyæœøıаеиоуыэюяєіїαεηιουω")
WIDTH = 32


def alphabets() -> list[str]:
    """Lower-case letters that have one capital, by script, vowel or consonant, and accent; those of few together; and the digits."""
    by: dict[tuple, list[str]] = {}
    for c in map(chr, (*range(0x61, 0x600), *range(0x10D0, 0x1100), *range(0x1E00, 0x2000))):
        if unicodedata.category(c) == "Ll" and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c:
            base, *marks = unicodedata.normalize("NFD", c)
            common = "a" <= c <= "z" or "α" <= c <= "ω" or "а" <= c <= "я"
            by.setdefault((unicodedata.name(c).split()[0], (c if common else base) in VOWELS, 0x180 <= ord(c) < 0x300, "common" if common else tuple(marks)), []).append(c)
    out = {k: v for k, v in by.items() if len(v) > 2}
    for k in by.keys() - out.keys():
        out.setdefault((*k[:3], "few"), []).extend(by[k])
    whole = ["0123456789", *sorted(("".join(sorted(v)) for v in out.values()), key=lambda x: (not x.isascii(), x))]
    parts = [x[i : i + WIDTH] for x in whole for i in range(0, len(x), WIDTH)]
    return [x for x in parts if len(x) > 1]


#: All alphabets, each in a place of WIDTH characters, and their sizes as characters from "@" on.
LETTERS = "".join(x.ljust(WIDTH, "\0") for x in alphabets())
SIZES = "".join(chr(64 + len(x)) for x in alphabets())


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once."""
    return F.get(F.transform(F.array(x), f), 0)


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def kind(e: Column) -> Column:
    full = lambda p: e.rlike(f"^(?:{p})$")
    # An entity stands without its surroundings here, so the first characters tell.
    return F.when(e.contains("@"), "email").when(e.rlike(r"^\p{L}"), "name").when(full(IPV4), "ip").when(e.rlike(r"^[+(]") | e.rlike(r"^\d{3}[-.]\d{3}[-.]\d{4}$"), "phone").otherwise("card")


def canonical(e: Column) -> Column:
    """The form in which ways of writing an entity agree."""
    return F.when(e.rlike(r"^\p{L}") & ~e.contains("@"), F.lower(F.regexp_replace(e, r"^(\S+?)\.? ", "$1 "))).when(e.contains("@") | e.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.lower(e)).otherwise(F.concat(F.when(e.startswith("+"), "+").otherwise(""), F.regexp_replace(e, r"\D", "")))


def _hex(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _shifted(s: Column, hexes: Column, moves: bool) -> Column:
    """Each letter and digit of s moved within its alphabet by the hash, the first by more than nothing if asked for; other characters stay."""

    def move(c: Column, i: Column, h: Column) -> Column:
        def within(p: Column) -> Column:
            block = F.shiftright(p, 5)
            size = F.ascii(F.substr(F.lit(SIZES), block + 1, F.lit(1))) - 64
            by = F.xxhash64(h, i)
            by = F.when(i == 0, F.pmod(by, size - 1) + 1).otherwise(F.pmod(by, size)) if moves else F.pmod(by, size)
            return F.when(p >= 0, F.substr(F.lit(LETTERS), (block * WIDTH + F.pmod(p % WIDTH + by, size) + 1).cast("int"), F.lit(1))).otherwise(c)

        return let(F.instr(F.lit(LETTERS), c) - 1, within)

    return let(hexes, lambda h: F.array_join(F.transform(chars(s), lambda c, i: move(c, i, h)), ""))


def permuted(key: str, tweak: str, s: Column) -> Column:
    """A keyed one-to-one map of strings (lower case) that keeps their shape: Feistel rounds over the halves."""

    def step(x: Column, i: Column, size: Column) -> Column:
        tag = F.concat_ws("|", F.lit(tweak), size.cast("string"), i.cast("string"))
        left = _shifted(x["l"], _hex(key, tag, F.lit("l"), x["r"]), True)
        return let(left, lambda l: F.struct(l.alias("l"), _shifted(x["r"], _hex(key, tag, F.lit("r"), l), False).alias("r")))

    def whole(s: Column) -> Column:
        half = F.ceil(F.length(s) / 2).cast("int")
        start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
        rounds = F.sequence(F.lit(1), F.when(F.length(s) <= SHORT_WORD, 1).otherwise(FEISTEL_ROUNDS))
        return F.aggregate(rounds, start, lambda x, i: step(x, i, F.length(s)), lambda x: F.concat(x["l"], x["r"]))

    return let(s, whole)


def _rendered(e: Column, s: Column) -> Column:
    """The letters and digits of s in the places of e's, with e's case and separators."""

    def step(x: Column, c: Column, new: Column) -> Column:
        one = F.coalesce(F.get(new, x["k"]), F.lit(""))
        put = F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(one)).otherwise(one)
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(x["out"], put).alias("out"), (x["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(x["out"], c).alias("out"), x["k"].alias("k")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return let(chars(s), lambda new: F.aggregate(chars(e), start, lambda x, c: step(x, c, new), lambda x: x["out"]))


def luhn(digits: Column) -> Column:
    """The check digit that belongs after digits."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(chars(F.reverse(digits)), value), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10))


def _email(key: str, e: Column) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    name = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    return F.concat(_cased(local, permuted(key, "local", F.lower(local))), F.lit("@"), _cased(name, permuted(key, "domain", F.lower(name))), top)


def _cased(e: Column, s: Column) -> Column:
    return F.when(e == F.lower(e), s).otherwise(F.array_join(F.zip_with(chars(e), chars(s), lambda a, b: F.when((a == F.upper(a)) & (a != F.lower(a)), F.upper(b)).otherwise(b)), ""))


def _ip(key: str, e: Column) -> Column:
    octets = lambda e: F.transform(F.split(e, r"\."), lambda x: x.cast("int"))

    def step(x: Column, i: Column) -> Column:
        by = F.conv(F.substr(_hex(key, F.lit("ip"), i.cast("string"), x["r"].cast("string")), F.lit(1), F.lit(4)), 16, 10).cast("int")
        return F.struct(x["r"].alias("l"), F.pmod(x["l"] + by, F.lit(65_536)).alias("r"))

    octet = lambda n: F.concat_ws(".", F.floor(n / 256).cast("string"), (n % 256).cast("string"))
    start = lambda o: F.struct((o[0] * 256 + o[1]).alias("l"), (o[2] * 256 + o[3]).alias("r"))
    return let(octets(e), lambda o: F.aggregate(F.sequence(F.lit(1), F.lit(FEISTEL_ROUNDS)), start(o), step, lambda x: F.concat_ws(".", octet(x["l"]), octet(x["r"]))))


def _card(key: str, e: Column) -> Column:
    def whole(d: Column) -> Column:
        body, last = F.substr(d, F.lit(2), F.length(d) - 2), F.substr(d, F.length(d), F.lit(1)).cast("int")
        new = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted(key, "card", body))
        check = lambda x: F.pmod(luhn(x) + last - luhn(F.substr(d, F.lit(1), F.length(d) - 1)), F.lit(10)).cast("string")
        return let(new, lambda x: F.concat(x, check(x)))

    return _rendered(e, let(F.regexp_replace(e, r"\D", ""), whole))


def _phone(key: str, e: Column) -> Column:
    def whole(code: Column) -> Column:
        rest = F.substr(e, F.length(code) + 1, F.length(e))
        return F.concat(code, _rendered(rest, permuted(key, "phone", F.regexp_replace(rest, r"\D", ""))))

    return let(F.regexp_extract(e, COUNTRY, 0), whole)


def gender(e: Column) -> Column:
    title = F.regexp_replace(F.substring_index(e, " ", 1), r"\.$", "")
    return F.when(title.isin(MALE), "m").when(title.isin(FEMALE), "f").otherwise("n")


def _only_letters(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), r"[^\p{L}]", "")


def _moved(key: str, tweak: str, w: Column) -> Column:
    return _rendered(w, permuted(key, tweak, _only_letters(w)))


def _named(e: Column) -> tuple[Column, Column, Column, Column]:
    """Title, the words after it, the given name (null if there is none) and the family name."""
    title = F.substring_index(e, " ", 1)
    rest = F.split(F.substr(e, F.length(title) + 2, F.length(e)), " ")
    named = F.filter(rest, lambda w: ~w.isin(PARTICLES))
    return title, rest, F.when(F.size(named) > 1, F.get(named, 0)), F.element_at(rest, -1)


def _list_of(given: Column, family: Column, of: Column) -> Column:
    """The list for a given name, as script and gender; null for an initial and a script without one."""
    script = F.when(family.rlike(r"\p{IsCyrillic}"), "cyrillic").when(family.rlike(r"\p{IsGreek}"), "greek").when(family.rlike(r"\p{IsLatin}"), "latin")
    return F.when(F.length(_only_letters(given)) > 1, F.concat(script, F.lit(":"), of))


def _names(listed: Column) -> Column:
    lists = ", ".join(f"'{script}:{g}', split('{' '.join(names)}', ' ')" for script, by in GIVEN.items() for g, names in by.items())
    return F.try_element_at(F.expr(f"map({lists})"), listed)


def _place(key: str, listed: Column, given: Column) -> Column:
    """The place in its list that a given name takes."""
    return F.pmod(F.xxhash64(_hex(key, F.lit("given"), listed, F.lower(given))), F.size(_names(listed))).cast("int")


def _from_list(names: Column, k: Column, number: Column) -> Column:
    """The k-th name; for the number-th bearer after the first, joined with names that spell the number."""

    def spelled(x: Column, _: Column) -> Column:
        left, n = x["left"] - 1, F.size(names)
        return F.when(x["left"] <= 0, x).otherwise(F.struct(F.concat(x["out"], F.lit("-"), F.get(names, (left % n).cast("int"))).alias("out"), F.floor(left / n).cast("int").alias("left")))

    # 2 ** 31 has at most 16 digits to a base of four names or more.
    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.struct(F.get(names, k).alias("out"), number.alias("left")), spelled, lambda x: x["out"])


def _name(key: str, e: Column, number: Column) -> Column:
    title, rest, given, family = _named(e)

    def whole(x: Column) -> Column:
        rest, given, listed = x["rest"], x["given"], x["listed"]
        listed_name = let(_names(listed), lambda names: _from_list(names, _place(key, listed, given), number))
        choice = F.when(listed.isNotNull(), listed_name).otherwise(_moved(key, "given", given))
        at = F.coalesce(F.array_position(rest, given), F.lit(0)) - 1
        before = F.transform(F.slice(rest, 1, F.size(rest) - 1), lambda w, i: F.when(w.isin(PARTICLES), w).when(i == at, choice).otherwise(_moved(key, "middle", w)))
        return F.concat_ws(" ", x["title"], before, _moved(key, "family", x["family"]))

    return let(F.struct(title.alias("title"), rest.alias("rest"), given.alias("given"), family.alias("family"), _list_of(given, family, gender(e)).alias("listed")), whole)


def surrogate(key: str, e: Column, number: Column) -> Column:
    return let(kind(e), lambda k: F.when(k == "email", _email(key, e)).when(k == "ip", _ip(key, e)).when(k == "phone", _phone(key, e)).when(k == "card", _card(key, e)).otherwise(_name(key, e, number)))


def corrections(found: DataFrame, key: str) -> DataFrame:
    """canonical, number of the names (e) that are not the first to take their surrogate.

    Names share one where they agree in all but the given name and their given names choose the
    same place of the same list; a double name tells them apart, as its parts spell the number.
    """
    names = found.where(kind(F.col("e")) == "name").select(canonical(F.col("e")).alias("canonical"), "e").groupBy("canonical").agg(F.min("e").alias("e"))
    title, rest, given, family = _named(F.col("e"))
    names = names.select("canonical", title.alias("title"), rest.alias("rest"), given.alias("given"), _list_of(given, family, gender(F.col("e"))).alias("listed")).where("listed is not null")
    others = F.concat_ws(" ", F.regexp_replace("title", r"\.$", ""), F.transform("rest", lambda w, i: F.when(i + 1 == F.array_position("rest", F.col("given")), "*").otherwise(F.lower(w))))
    names = names.select("canonical", "listed", others.alias("others"), _place(key, F.col("listed"), F.col("given")).alias("k"))
    number = F.row_number().over(Window.partitionBy("listed", "others", "k").orderBy("canonical")) - 1
    return names.select("canonical", number.alias("number")).where("number > 0")


def _hint() -> Column:
    return F.coalesce(F.col("text").rlike(rf"{_TITLE}\.? "), F.lit(False))


def _replaced(rows: DataFrame, key: str) -> DataFrame:
    """The result's columns, from doc_id, text, ents and fixes."""
    number = lambda e: F.when(F.col("fixes").isNull(), F.lit(0)).otherwise(F.coalesce(F.try_element_at(F.col("fixes"), canonical(e)), F.lit(0)))
    news = F.concat(F.transform("ents", lambda e: surrogate(key, e, number(e))), F.array(F.lit("")))
    text = F.when(F.size("ents") == 0, F.col("text")).otherwise(F.array_join(F.zip_with(F.split("text", ANY, -1), news, lambda a, b: F.concat(a, b)), ""))
    rows = rows.select("doc_id", text.alias("text"), F.size("ents").cast("long").alias("n_entities"), F.transform("ents", kind).alias("kinds"))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    return rows.select("doc_id", "text", "n_entities", *(count(k).alias(f"n_{k}") for k in ("email", "ip", "phone", "card", "name")))


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities and the number of each type, for each row of docs (doc_id, text)."""
    none = F.array().cast("array<string>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Only texts with such numbers, an at sign or a title can hold an entity, and only those with a title a name; the rest skip the pattern.
    ents = F.coalesce(F.when(F.col("text").rlike(NUMBERS) | _hint(), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))), none)
    fixes_type = "map<string,int>"
    titled = rows.where(_hint()).withColumn("ents", ents)
    names = F.filter("ents", lambda e: kind(e) == "name")
    held = written(titled.select("doc_id", F.xxhash64("text").alias("h"), names.alias("ents")).where(F.size("ents") > 0), "titled")
    fixes = written(corrections(held.select(F.explode("ents").alias("e")).distinct(), key), "corrections")
    # A document's corrections; those of equal texts are equal.
    per = held.select("doc_id", "h", F.explode(F.array_distinct(F.transform("ents", canonical))).alias("canonical")).distinct().join(fixes, "canonical")
    per = per.groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "number"))).alias("fixes")).withColumnRenamed("doc_id", "id")
    titled = titled.withColumn("own", F.xxhash64("text")).join(per, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("own")), "left").select("doc_id", "text", "ents", "fixes")
    others = rows.where(~_hint()).withColumn("ents", ents).withColumn("fixes", F.lit(None).cast(fixes_type))
    return _replaced(titled.unionByName(others), key)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents"))
