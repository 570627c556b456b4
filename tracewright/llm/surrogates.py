"""Keyed surrogates for personal data, in DataFrame functions only.

Detected entities are replaced by others of the same type and format: digits by digits and letters by letters of the same case
and script, with card and account numbers of the same checksum state, addresses of valid octets, and names of the same gender (by their
title) and script. A surrogate is derived from a secret key and the normalised entity, so that an entity has the same one in every
document and every way of writing it, and nobody without the key can go back.

Detected are e-mail addresses, account numbers (IBAN), keys that begin with AKIA, gh?_ or sk-, hexadecimal runs of 32 to 128 digits, IPv4 and IPv6 addresses,
numbers written as 123-45-6789, card numbers of 13 to 19 digits, phone numbers (with a plus, 7 to 15 digits with single separators; with an area code in
parentheses; of ten digits in groups of 3, 3 and 4, also after a 1), street addresses (a number, one to three capitalised words and an English word for a street), names
of one or two words after one of the titles below, and family names after one of the given names below. Other names without a title, dates of birth (too few for
distinct surrogates), other national phone and address layouts, digits of other alphabets and other secrets are not.

Distinct entities may draw the same surrogate, or one that is itself an entity of the corpus. All distinct entities are checked
for that; of those that clash all but the smallest draw again, until none does. Most documents then need no lookup at all: only
entities that drew again are joined to the documents that hold them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch

#: Rounds in a row of which no entity comes out with a surrogate of its own, after which a format counts as used up.
ROUNDS = 64

# Titles by gender, given names by gender and script, and syllables of family names by script.
MALE_TITLES = ["Mr", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"]
OTHER_TITLES = ["Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор"]
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Noel", "Oscar", "Paul", "Rafael", "Viktor"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Helena", "Ida", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Vera"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Фёдор"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"],
    ("m", "greek"): ["Άγγελος", "Βασίλης", "Γιώργος", "Δημήτρης", "Ερμής", "Ζήσης", "Ηλίας", "Θάνος", "Ιάσων", "Κώστας", "Λουκάς", "Μάριος", "Νίκος", "Πέτρος", "Στέφανος", "Φώτης"],
    ("f", "greek"): ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λένα", "Μαρία", "Νίκη", "Πηνελόπη", "Σοφία", "Φωτεινή"],
}
SYLLABLES = {
    "latin": ["ba", "del", "fer", "go", "han", "ka", "lin", "mo", "nar", "pel", "ri", "so", "tan", "ul", "ver", "zo"],
    "cyrillic": ["ба", "дел", "фер", "го", "хан", "ка", "лин", "мо", "нар", "пел", "ри", "со", "тан", "ул", "вер", "зо"],
    "greek": ["βα", "δελ", "φερ", "γο", "χαν", "κα", "λιν", "μο", "ναρ", "πελ", "ρι", "σο", "ταν", "ουλ", "βερ", "ζο"],
}
#: Ends of given names that are made of syllables.
ENDS = {("m", "latin"): "n", ("f", "latin"): "a", ("m", "cyrillic"): "н", ("f", "cyrillic"): "а", ("m", "greek"): "ς", ("f", "greek"): "α"}
STREETS = ["Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Square"]
LETTERS = {"latin": "bcdfghjklmnpqrst", "cyrillic": "бвгдежзиклмнопрс", "greek": "βγδζηθικλμνξοπρσ"}
HEX = "0123456789abcdef"

_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_TITLE = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLES})(?!\p{{L}})"
_GIVEN = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{'|'.join(sorted({name for names in GIVEN.values() for name in names}))})(?!\p{{L}})"
_HEX4 = "[0-9A-Fa-f]{1,4}"
#: Patterns by type; where several match at a place the first is taken.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "key": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![\p{L}\p{N}])",
    "hex": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    # All eight groups, or some on both sides of a gap and a digit among them.
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?=[A-Fa-f:]*+\d){_HEX4}(?::{_HEX4}){{0,5}}+::{_HEX4}(?::{_HEX4}){{0,5}}+)(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{N}-])"
    # With a plus, 7 to 15 digits; national ones with spaces or a leading 1, unless a card number of more digits goes on.
    + r"|(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?\(\d{1,4}\)(?:[ .-]?\d){4,12}(?!\d)|(?<![\p{L}\p{N}+])\+[1-9](?:[ .-]?\d){6,14}(?!\d)"
    + r"|(?<![\p{L}\p{N}.+-])1[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\p{N}-])(?!(?:[ -]?\d){2,8}(?!\d))|(?<![\p{L}\p{N}.+-])\d{3} \d{3}[ .-]\d{4}(?![\p{N}-])(?!(?:[ -]?\d){3,9}(?!\d))",
    "card": r"(?<![\p{N}])(?:\d[ -]?){12,18}\d(?!\d)",
    "address": rf"(?<![\p{{L}}\p{{N}}.,-])[1-9]\d{{0,4}} (?:\p{{Lu}}\p{{L}}+ ){{1,3}}(?:{'|'.join(STREETS)})(?!\p{{L}})",
    "person": _TITLE + r"\.?[ \x{A0}]\p{Lu}\p{L}+(?:[ -]\p{Lu}\p{L}+)?|" + _GIVEN + r"[ \x{A0}]\p{Lu}\p{L}+",
}
ANY = "|".join(PATTERNS.values())
#: Calling codes of one and two digits; all others have three.
_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: What every match holds, to pass over most texts at once: a digit, an at sign, the beginning of a key, a run of hexadecimal letters, or a title or given name before a capital letter.
HINTS = ["[0-9@]|AKIA|gh[pousr]_|sk-|[a-f]{32}|[A-F]{32}", rf"{_TITLE}\.?[ \x{{A0}}]\p{{Lu}}|{_GIVEN}[ \x{{A0}}]\p{{Lu}}"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one_of(mark: Column, values: list[str] | str) -> Column:
    """The value that a hexadecimal digit stands for."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.conv(mark, 16, 10).cast("int") + 1)


def _draw(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hexadecimal digits for an entity and a number of earlier draws."""
    inner = F.sha2(F.concat(F.lit(key), F.lit("\u0001"), kind, F.lit("\u0001"), attempt.cast("string"), F.lit("\u0001"), norm), 256)
    return F.sha2(F.concat(F.lit(key), inner), 512)


def _mark(draw: Column, i: Column) -> Column:
    return F.substring(draw, F.pmod(i, F.lit(128)).cast("int") + 1, F.lit(1))


def _number(draw: Column, i: int) -> Column:
    return F.conv(F.substring(draw, 4 * i + 1, 4), 16, 10).cast("int")


def _digits(draw: Column) -> Column:
    return F.translate(draw, "abcdef", "024685")


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _alike(text: Column, draw: Column) -> Column:
    """``text`` with every digit and letter drawn anew, of the same case and script."""

    def sign(c: Column, i: Column) -> Column:
        mark = _mark(draw, i)
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), F.translate(mark, HEX, LETTERS["cyrillic"])).when(c.rlike(r"\p{IsGreek}"), F.translate(mark, HEX, LETTERS["greek"])).otherwise(F.translate(mark, HEX, LETTERS["latin"]))
        return F.when(c.rlike(r"\p{N}"), _digits(mark)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), sign), "")


def _luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` and itself pass the card checksum."""
    n = F.length(body)
    values = F.transform(F.split(body, ""), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(c.try_cast("int") > 4, 2 * c.try_cast("int") - 9).otherwise(2 * c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(values, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


def _mod97(text: Column) -> Column:
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike(r"\d"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(signs, F.lit(0), lambda a, c: F.pmod(F.when(c.rlike(r"\d"), a * 10 + value(c)).otherwise(a * 100 + value(c)), F.lit(97)))


def _core(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The normalised surrogate of a normalised entity."""
    return _let(_draw(key, kind, norm, attempt), lambda draw: _drawn(key, kind, norm, attempt, draw))


def _drawn(key: str, kind: Column, norm: Column, attempt: Column, draw: Column) -> Column:
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    longer = F.when(attempt > 3, F.translate(F.substring(draw, 100, 4), HEX, LETTERS["latin"])).otherwise("")
    email = F.concat(_alike(local, draw), longer, F.lit("@"), _let(_draw(key, F.lit("host"), host, F.lit(0)), lambda d: _alike(host, d)), top)
    octet = lambda i: F.get(F.split(norm, r"\."), F.lit(i))
    part = lambda i: F.when((F.length(octet(i)) == 1) & (attempt < 4), F.pmod(_number(draw, i), F.lit(10))).when((F.length(octet(i)) == 2) & (attempt < 4), 10 + F.pmod(_number(draw, i), F.lit(90))).when(attempt < 4, 100 + F.pmod(_number(draw, i), F.lit(156))).otherwise(F.pmod(_number(draw, i), F.lit(256)))
    ip = F.concat_ws(".", *[part(i).cast("string") for i in range(4)])
    n = F.length(norm)
    body = F.concat(F.substring(norm, 1, 1), F.substring(_digits(draw), F.lit(1), F.greatest(n - 2, F.lit(0))))
    check = F.when(F.call_function("luhn_check", norm), _luhn_digit(body)).otherwise(F.pmod(_luhn_digit(body) + 1 + F.pmod(_number(draw, 30), F.lit(9)), F.lit(10)))
    card = F.concat(body, check.cast("string"))
    rest = _alike(F.substring(norm, F.lit(5), n), draw)
    land = F.substring(norm, 1, 2)
    valid = _mod97(F.concat(F.substring(norm, F.lit(5), n), F.substring(norm, 1, 4))) == 1
    control = F.lpad((F.lit(98) - _mod97(F.concat(rest, land, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(land, F.when(valid, control).otherwise(F.substring(_digits(draw), 100, 2)), rest)
    prefix = F.regexp_extract(norm, r"^(AKIA|gh._|sk-)", 1)
    secret = F.concat(prefix, _alike(F.substring(norm, F.length(prefix) + 1, n), draw))
    # A given name's kind holds gender and script, a family name's the script.
    script = F.substring_index(kind, ":", -1)
    given = F.coalesce(*[F.when(kind == f"given:{g}:{s}", _one_of(F.substring(draw, 1, 1), names)) for (g, s), names in GIVEN.items()])
    end = F.coalesce(*[F.when(kind == f"given:{g}:{s}", F.lit(x)) for (g, s), x in ENDS.items()], F.lit(""))
    given = F.when((attempt > 0) | given.isNull(), F.concat(F.initcap(_syllables(draw, script, 2 + F.floor(attempt / 4).cast("int"))), end)).otherwise(given)
    family = F.initcap(_syllables(draw, script, 3 + F.floor(attempt / 2).cast("int")))
    words = F.split(norm, " ")
    street = lambda w, i: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), 3 + F.floor(attempt / 4).cast("int")), lambda j: _one_of(_mark(draw, 8 * i + j), SYLLABLES["latin"])), ""))
    named = F.transform(F.slice(words, F.lit(2), F.size(words) - 2), street)
    house = F.concat((1 + F.pmod(_number(draw, 31), F.lit(9))).cast("string"), F.substring(_digits(draw), F.lit(120), F.length(F.get(words, F.lit(0))) - 1))
    address = F.concat_ws(" ", house, F.array_join(named, " "), F.get(words, F.size(words) - 1))
    v6 = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), _mark(draw, i)).otherwise(c)), "")
    return (
        F.when(kind == "email", email)
        .when(kind == "ipv6", v6)
        .when(kind == "address", address)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind == "key", secret)
        .when(kind == "hex", F.when(norm.rlike("[A-F]"), F.upper(F.substring(draw, F.lit(1), n))).otherwise(F.substring(draw, F.lit(1), n)))
        .when(kind.isin("phone", "ssn"), F.substring(_digits(draw), F.lit(1), n))
        .when(kind.startswith("given"), given)
        .otherwise(family)
    )


def _syllables(draw: Column, script: Column, n: Column) -> Column:
    one = lambda i: F.coalesce(*[F.when(script == s, _one_of(_mark(draw, i), syllables)) for s, syllables in SYLLABLES.items()])
    return F.array_join(F.transform(F.sequence(F.lit(2), n + 1), one), "")


def _kind(match: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(found)
    return found


#: Title, given and family name of a person.
_NAME = rf"^(?:({_TITLES})\.?[ \x{{A0}}])?(?:(\p{{L}}+)[ \x{{A0}}-])?(\p{{L}}+)$"


def _units(match: Column, kind: Column) -> Column:
    """The entities that a match names: one, or a given and a family name."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    norm = (
        F.when(kind.isin("email", "ipv6"), F.lower(match))
        .when((kind == "phone") & match.startswith("+"), F.regexp_replace(digits, _CODE, ""))
        .when(kind == "phone", F.when(F.length(digits) > 10, F.substring(digits, F.length(digits) - 9, F.lit(10))).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .otherwise(match)
    )
    title, given, family = (F.regexp_extract(match, _NAME, i) for i in (1, 2, 3))
    known = lambda g: F.lower(given).isin([n.lower() for (h, _), names in GIVEN.items() if h == g for n in names])
    gender = F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f").when(known("m"), "m").when(known("f"), "f").otherwise("n")
    unit = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    last = unit(F.concat(F.lit("family:"), _script(family)), F.lower(family))
    first = unit(F.concat(F.lit("given:"), gender, F.lit(":"), _script(given)), F.lower(given))
    return F.when((kind == "person") & (given != ""), F.array(first, last)).when(kind == "person", F.array(last)).otherwise(F.array(unit(kind, norm)))


def _named(match: Column) -> Column:
    return _let(_kind(match), lambda kind: _units(match, kind))


def _fit(match: Column, kind: Column, cores: Column) -> Column:
    """The surrogate in the format of the match."""
    return _let(cores, lambda c: _formatted(match, kind, c))


def _formatted(match: Column, kind: Column, cores: Column) -> Column:
    core = F.get(cores, F.lit(0))
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    # Digits of a country code in front of the normalised ones stay.
    ahead = n - F.length(core)
    at = lambda i: F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), "[^0-9]", "")) - ahead
    digits = F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(c.rlike("[0-9]") & (at(i) > 0), F.substring(core, at(i), F.lit(1))).otherwise(c)), "")
    sign = lambda i: F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), " ", ""))
    spaced = F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(c != " ", F.substring(core, sign(i), F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(match, rf"^((?:{_TITLES})\.?[ \x{{A0}}])", 1)
    between = F.regexp_extract(match, r"\p{L}([ \x{A0}-])\p{L}+$", 1)
    person = F.when(F.size(cores) > 1, F.concat(title, core, between, F.get(cores, F.lit(1)))).otherwise(F.concat(title, core))
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", spaced).when(kind == "person", person).otherwise(core)


def _hinted(text: Column) -> Column:
    return text.rlike(HINTS[0]) | text.rlike(HINTS[1])


def _matches(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(_hinted(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def _rewrite(text: Column, matches: Column, replace: Callable[[Column], Column]) -> Column:
    """``text`` with the replacement of every match between the pieces that the matches leave."""
    parts = F.zip_with(F.split(text, ANY, -1), F.transform(matches, replace), lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.when(F.size(matches) > 0, F.array_join(parts, "")).otherwise(text)


def _settle(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, norm, attempt) of the entities that had to draw again; only those that lost a round take part in the next."""
    drawn = lambda df: df.withColumn("core", F.lower(_core(key, F.col("kind"), F.col("norm"), F.col("attempt"))))
    names = scratch.cut(entities.select("kind", "norm"), "names")
    taken = names.select("kind", F.lower("norm").alias("core")).distinct()
    left = names.withColumn("attempt", F.lit(0))
    again, number, before, idle = None, 0, -1, 0
    while idle < ROUNDS:
        tried = scratch.cut(drawn(left), "drawn")
        owner = tried.groupBy("kind", "core").agg(F.min("norm").alias("owner"))
        free = scratch.cut(owner.join(taken, ["kind", "core"], "left_anti"), "free")
        lost = tried.join(free.withColumnRenamed("owner", "norm"), ["kind", "core", "norm"], "left_anti")
        left = scratch.cut(lost.select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "left")
        if number:
            won = tried.join(left.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", "attempt")
            again = won if again is None else again.union(won)
        open_ones = left.count()
        if not open_ones:
            return again if again is not None else left
        taken = taken.union(free.select("kind", "core"))
        number += 1
        if number % 16 == 0:
            taken = scratch.cut(taken, "taken")
        before, idle = open_ones, idle + 1 if open_ones == before else 0
    # More entities than their format has values: these have to share.
    return again.union(left)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case of letters."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with a surrogate for every entity of the text, and n_entities (bigint).

    A null text stays null with no entities. Distinct entities of a kind get distinct surrogates, none of which is an entity of the
    corpus; digits and letters keep their places, case and script, and country codes, top-level domains, titles and token prefixes
    stay. Entities draw until each has a value of its own; only where a format has fewer values than the corpus has entities, which ``ROUNDS`` rounds without any winner tell, those left share some. Rows are judged by their
    texts, so ids may be null or repeated. A column called n_entities is replaced; all others stay, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.withColumn(text_col, F.col(text_col).cast("string"))
    text = F.col(text_col)
    found, redrawn, hashed = (_free(docs, name) for name in ("matches", "again", "hash"))
    scratch = Scratch(spark)
    with scratch:
        named = F.array_distinct(F.flatten(F.transform(F.array_distinct(_matches(text)), _named)))
        # Rows without units go when the table is read: a filter before that would find all matches a second time.
        held = source.where(_hinted(text)).select(F.sha2(F.encode(text, "utf-8"), 256).alias(hashed), named.alias("units"))
        held = scratch.keep(held, "held").where(F.size("units") > 0)
        units = held.select(F.explode("units").alias("u")).select("u.kind", "u.norm").distinct()
        again = scratch.keep(_settle(units, key, scratch), "again")
    never = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    matches = source.withColumn(found, _matches(text))
    if again.isEmpty():
        matches = matches.withColumn(redrawn, never)
    else:
        hold = held.select(hashed, F.explode("units").alias("u")).select(hashed, "u.kind", "u.norm").distinct()
        looked = hold.join(again, ["kind", "norm"]).groupBy(hashed).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("\u0001"), "norm"), "attempt"))).alias(redrawn))
        # Only texts with a hint are looked up; their matches are found once, after the join.
        hint = F.coalesce(_hinted(text), F.lit(False))
        asked = source.where(hint).withColumn(hashed, F.sha2(F.encode(text, "utf-8"), 256)).join(looked, hashed, "left").drop(hashed)
        asked = asked.withColumn(found, _matches(text)).withColumn(redrawn, F.coalesce(redrawn, never))
        plain = source.where(~hint).withColumn(found, F.array().cast("array<string>")).withColumn(redrawn, never)
        matches = asked.select(*docs.columns, found, redrawn).unionByName(plain)

    def core(u: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(F.col(redrawn), F.concat(u["kind"], F.lit("\u0001"), u["norm"])), F.lit(0))
        return _let(attempt, lambda n: _core(key, u["kind"], u["norm"], n))

    def replace(match: Column) -> Column:
        return _let(_kind(match), lambda kind: _fit(match, kind, F.transform(_units(match, kind), core)))

    done = matches.withColumn(text_col, _rewrite(text, F.col(found), replace)).withColumn("n_entities", F.coalesce(F.size(found), F.lit(0)).cast("long"))
    return done.drop(found, redrawn)
