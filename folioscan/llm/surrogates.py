"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.rows import without, written

HEX = "0123456789abcdef"
# Country codes are one digit, the listed two, or three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

# Titles by gender, and given names by script and gender (m, f, either).
TITLES_M = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Mme", "Madame", "г-жа")
TITLES_ANY = ("Dr", "Prof")
INTRODUCTIONS = ("my name is", "My name is", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "ich heiße", "Ich heiße")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Marco", "Noah", "Oscar", "Paul"),
    ("latin", "f"): ("Alice", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("latin", "a"): ("Alex", "Billie", "Chris", "Dana", "Eden", "Finley", "Gale", "Hayden", "Indigo", "Jordan", "Kim", "Lee", "Morgan", "Noel", "Owen", "Quinn"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён"),
    ("cyrillic", "f"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"),
    ("cyrillic", "a"): ("Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Тоша", "Стася", "Никита", "Миша", "Вася", "Лёва", "Тёма", "Рита", "Лада", "Яна"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fel", "gor", "han", "jor", "kel", "lin", "mar", "nor", "per", "ros", "sten", "tal", "vin", "wer"),
    "cyrillic": ("ба", "ден", "фел", "гор", "хан", "жар", "кел", "лин", "мар", "нор", "пер", "рос", "стен", "тал", "вин", "зор"),
}
LETTERS = {"latin": "bcdfghjklmnpqrst", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}

_TITLE = "|".join(sorted((*TITLES_M, *TITLES_F, *TITLES_ANY), key=len, reverse=True))
# A part of a name: initials (J. or J.-P., also J.Smith), a word with hyphens and apostrophes (not the 's of a possessive), a bare initial.
_L = r"[\p{L}\p{M}]"
_WORD = rf"\p{{Lu}}(?:{_L}++|(?=['’-]\p{{L}}))(?:-{_L}++|['’](?!s(?!{_L})){_L}++)*+"
_PART = rf"(?:(?:\p{{Lu}}\.-?)++(?:{_WORD})?+|{_WORD}|\p{{Lu}}(?= \p{{Lu}}))"
_NAME = rf"{_PART}(?: {_PART})*+"
_TITLES = rf"(?:{_TITLE})\.?+(?: (?:{_TITLE})\.?+(?= ))*+"
_BEFORE = rf"(?:(?:{'|'.join(INTRODUCTIONS)})(?: {_TITLES}(?= ))?+|{_TITLES}) "
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# One pattern for all types; of two that start at one place the earlier alternative is taken.
PATTERNS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    r"(?<![\p{L}\p{N}_])(?:[Pp]assword|[Pp]asswd|[Tt]oken|[Ss]ecret|[Aa]pi_key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{8,}+",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    r"(?<![\d+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    r"(?<![\d+-])3\d{3}[ -]\d{6}[ -]\d{5}(?!\d)",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<!\d)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    r"(?<![\d+])\+\d{1,3}[ .-]?\(0\)(?:[ .-]?\d){6,12}(?!\d)",
    r"(?<![\d+])\+\d(?:[ .-]?\d){7,14}(?!\d)",
    r"(?<![\d.-])0[1-9](?:[ .-]\d{2}){4}(?!\d|[.-]\w)",
    r"(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)",
    rf"(?<![\p{{L}}\p{{N}}]){_BEFORE}{_NAME}",
)
ENTITY = "|".join(PATTERNS)
# Texts without any of these hold no entity; this spares them the long pattern.
HINT = rf"[@0-9]|[Pp]assw|[Tt]oken|[Ss]ecret|[Aa]pi_key|AKIA|(?:{_TITLE})[. ]|{'|'.join(INTRODUCTIONS)}"
KEPT = rf"^(?:(?:[Pp]ass\w+|[Tt]oken|[Ss]ecret|[Aa]pi_key)\s*[=:]\s*[\"']?|{_BEFORE}(?=\p{{Lu}}))"


def entities(text: Column) -> Column:
    """All entities of a text in order: kind, gender, the kept beginning, and the part to be replaced."""

    def parts(raw: Column) -> Column:
        head = F.regexp_extract(raw, KEPT, 0)
        core = F.substr(raw, F.length(head) + 1)
        digits = F.regexp_replace(raw, r"\(0\)|[^0-9]", "")  # +33 (0)6 is +33 6
        title = F.regexp_extract(head, rf"^(?:(?:{'|'.join(INTRODUCTIONS)}) )?([^ .]+)", 1)
        kind = (
            F.when(F.contains(raw, F.lit("@")), "email")
            .when(F.rlike(head, F.lit(r"[=:]")), "secret")
            .when(F.length(head) > 0, "name")
            .when(F.startswith(raw, F.lit("AKIA")), "access key")
            .when(F.rlike(raw, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")), "ip")
            .when(F.rlike(raw, F.lit(r"^\d{3}-\d{2}-\d{4}$")), "id number")
            .when(F.rlike(raw, F.lit(r"^\d")) & (F.length(digits) >= 13), "card")
            .otherwise("phone")
        )
        given = F.initcap(F.regexp_extract(core, r"^\S+", 0))
        male, female = ([x for (_, g), own in GIVEN.items() if g == w for x in own] for w in "mf")
        gender = (
            F.when(kind != "name", "a")
            .when(title.isin(*TITLES_M), "m").when(title.isin(*TITLES_F), "f")
            .when(given.isin(*male), "m").when(given.isin(*female), "f").otherwise("a")
        )
        norm = F.when(kind.isin("phone", "card", "id number"), digits).when(kind.isin("email", "name"), F.lower(core)).otherwise(core)
        return F.struct(kind.alias("kind"), gender.alias("gender"), head.alias("head"), core.alias("core"), norm.alias("norm"))

    return F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), parts)


def _pick(names: tuple[str, ...], nibble: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.conv(nibble, 16, 10).cast("int"))


def _shaped(value: Column, digest: Column) -> Column:
    """Each letter or digit becomes another one of its kind; everything else stays."""

    def other(c: Column, i: Column) -> Column:
        nibble = F.substr(digest, F.pmod(i, F.length(digest)) + 1, F.lit(1))
        low = F.lower(c)
        letter = (
            F.when(F.rlike(low, F.lit(r"\p{IsCyrillic}")), F.translate(nibble, HEX, LETTERS["cyrillic"]))
            .when(F.rlike(low, F.lit(r"\p{IsGreek}")), F.translate(nibble, HEX, LETTERS["greek"]))
            .otherwise(F.translate(nibble, HEX, LETTERS["latin"]))
        )
        return F.when(F.rlike(c, F.lit(r"\d")), F.translate(nibble, "abcdef", "135792")).when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(letter)).when(F.rlike(c, F.lit(r"\p{L}")), letter).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(c.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1)))
    return F.pmod(F.aggregate(F.transform(each, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x), F.lit(10))


def surrogate(kind: Column, gender: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The candidate for an entity: a keyed function of its type, gender and normal form, and of the number of the attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, gender, norm, attempt.cast("string"))
    digest = F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("+"), seed), 256))
    more = F.when(attempt > 2, F.substr(digest, F.lit(100), F.least(attempt, F.lit(24)))).otherwise("")
    numbers = F.translate(digest, "abcdef", "135792")
    size = F.length(norm)

    local = F.concat(_shaped(F.regexp_extract(norm, "^[^@]*", 0), digest), F.translate(more, HEX, LETTERS["latin"]))
    ending = F.regexp_extract(norm, r"\.([a-z]{2,})$", 1)
    email = F.concat(local, F.lit("@example."), F.when(ending.isin("com", "org", "net"), ending).otherwise("com"))

    # Kept: a country code where there are more than ten digits, and the first two digits behind a leading zero.
    country = F.when(F.rlike(norm, F.lit("^0")), 2).when(size > 10, F.length(F.regexp_extract(norm, COUNTRY, 0))).otherwise(0)
    phone = F.concat(F.substr(norm, F.lit(1), country), F.translate(F.substr(digest, F.lit(1), F.lit(1)), HEX, "2345678923456789"), F.substr(numbers, F.lit(2), size - country - 1))
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(numbers, F.lit(1), size - 2))
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    card = F.concat(body, F.when(_luhn(norm) == 0, check).otherwise(F.pmod(check + 1, F.lit(10))).cast("string"))
    octets = F.concat_ws(".", *[(F.pmod(F.conv(F.substr(digest, F.lit(1 + 4 * k), F.lit(4)), 16, 10).cast("int"), F.lit(253)) + 1).cast("string") for k in range(4)])
    secret = F.when(F.rlike(norm, F.lit("^[0-9a-f]+$")), F.substr(F.repeat(digest, 8), F.lit(1), size)).otherwise(_shaped(norm, digest))

    def named(script: str) -> Column:
        given = F.when(gender == "m", _pick(GIVEN[script, "m"], F.substr(digest, F.lit(1), F.lit(1)))).when(gender == "f", _pick(GIVEN[script, "f"], F.substr(digest, F.lit(1), F.lit(1)))).otherwise(_pick(GIVEN[script, "a"], F.substr(digest, F.lit(1), F.lit(1))))
        parts = [_pick(SYLLABLES[script], F.substr(digest, F.lit(2 + k), F.lit(1))) for k in range(4)]
        extra = F.array_join(F.transform(F.filter(F.split(more, ""), lambda c: c != ""), lambda c: _pick(SYLLABLES[script], c)), "")
        family = F.initcap(F.concat(*parts, extra))
        words = F.split(norm, " ")

        def short(word: Column, value: Column) -> Column:
            """An initial stays an initial."""
            return F.when(F.rlike(word, F.lit(r"^\p{L}\.?$")), F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(word, F.lit(2)))).otherwise(value)

        middle = F.transform(F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 2)), lambda w, i: short(w, _pick(GIVEN[script, "a"], F.substr(digest, F.pmod(i, F.lit(60)) + 6, F.lit(1)))))
        return F.when(F.contains(norm, F.lit(" ")), F.concat_ws(" ", short(F.get(words, F.lit(0)), given), middle, family)).otherwise(family)

    name = F.when(F.rlike(norm, F.lit(r"\p{IsCyrillic}")), named("cyrillic")).when(F.rlike(norm, F.lit(r"^[\p{IsLatin}\p{M} .'’-]+$")), named("latin")).otherwise(_shaped(norm, digest))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "id number", F.substr(numbers, F.lit(1), size))
        .when(kind == "ip", octets).when(kind == "access key", F.concat(F.lit("AKIA"), F.upper(_shaped(F.substr(norm, F.lit(5)), digest)))).when(kind == "name", name).otherwise(secret)
    )


def assign(found: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """One surrogate per (kind, gender, norm): distinct within a kind, and equal to no entity that occurs.

    Each round proposes a candidate for every open entity. A candidate that occurs in the texts or is taken is refused; of several
    entities with one candidate the smallest gets it, and the others try again. All of it are aggregates with small keys.
    """
    open_ = written(found.select("kind", "gender", "norm").distinct().withColumn("attempt", F.lit(0)), "entities")
    everything = open_.select("kind", F.col("norm").alias("value"))
    given = None
    for _ in range(rounds):
        named = open_.withColumn("value", surrogate(F.col("kind"), F.col("gender"), F.col("norm"), F.col("attempt"), key))
        form = F.when(F.col("kind") == "name", F.lower("value")).otherwise(F.col("value"))
        offers = named.select("kind", form.alias("form"), F.struct("norm", "gender", "value").alias("who"))
        taken = everything.select("kind", F.col("value").alias("form"))
        if given is not None:
            taken = taken.union(given.select("kind", F.when(F.col("kind") == "name", F.lower("value")).otherwise(F.col("value"))))
        offers = offers.unionByName(taken.withColumn("who", F.lit(None)), allowMissingColumns=True)
        best = offers.groupBy("kind", "form").agg(F.min("who").alias("who"), F.max(F.col("who").isNull()).alias("used")).where("not used")
        won = written(best.select("kind", F.col("who.gender").alias("gender"), F.col("who.norm").alias("norm"), F.col("who.value").alias("value")), "surrogates")
        given = won if given is None else given.unionByName(won)
        open_ = written(open_.join(won, ["kind", "gender", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "open")
        if open_.isEmpty():
            return given
    raise ValueError(f"no distinct surrogates after {rounds} rounds")


def _filled(entity: Column, value: Column) -> Column:
    """The surrogate in the format of one occurrence: digits in their places, letters in its case."""
    core = F.replace(entity["core"], F.lit("(0)"), F.lit("(\x01)"))
    digits = F.array_join(
        F.transform(F.split(core, ""), lambda c, i: F.when(F.rlike(c, F.lit(r"\d")), F.substr(value, F.length(F.regexp_replace(F.substr(core, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), ""
    )
    loud = (core == F.upper(core)) & (core != F.lower(core))
    worded = F.when(loud, F.upper(value)).otherwise(value)
    return F.concat(entity["head"], F.when(entity["kind"].isin("phone", "card", "id number"), F.translate(digits, "\x01", "0")).when(entity["kind"].isin("email", "name"), worded).otherwise(value))


def replace_entities(docs: DataFrame, *, text: str = "text", key: str = "surrogates", keep_rows: bool = True) -> DataFrame:
    """Replace every entity of ``text`` and add ``n_entities``; rows without one stay untouched.

    Types: e-mail, phone, payment card, id number, IP address, access key, secret (value of a password or token), and a name
    behind titles or an introduction: all capitalised words and initials that follow, with their hyphens and apostrophes. Phones
    are those of 8 to 15 digits behind a plus sign, and the national forms 602-555-0954, (602) 555-0954 and 06 12 34 56 78. One entity gets one surrogate in all texts, different entities of a type get different ones,
    and no surrogate is an entity that occurs. Kept are the title and gender, the script, the number of digits and their
    separators, the number of words of a name and its initials' dots, the country code of a phone of more than ten digits, the first digit of a card and whether its check digit is right, letter case, and
    what stands around. ``key`` makes the surrogates; another key gives others.

    Only texts with entities are shuffled, by a hash of the text, so copies of a text are worked on once. A null text stays null
    with 0 entities; an empty one stays empty; repeated rows stay repeated; other columns are kept, ``n_entities`` is replaced.
    """
    t = F.col(f"`{text}`")
    base = without(docs, ["n_entities", "_found", "_a", "_b", "_values"])
    filled = F.coalesce(t, F.lit(""))
    marked = base.withColumn("_found", F.when(F.rlike(filled, F.lit(HINT)), entities(filled)).otherwise(F.array()))
    hit = marked.where(F.size("_found") > 0).withColumns({"_a": F.xxhash64(t), "_b": F.xxhash64(F.reverse(t), F.lit(3))})
    each = hit.groupBy("_a", "_b").agg(F.first("_found").alias("_found")).select("_a", "_b", F.posexplode("_found").alias("pos", "e")).select("_a", "_b", "pos", "e.kind", "e.gender", "e.norm")
    each = written(each, "occurrences")
    named = each.join(assign(each, key), ["kind", "gender", "norm"]).groupBy("_a", "_b").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_values"))
    joined = hit.join(named, ["_a", "_b"])
    pieces = F.split(t, ENTITY, -1)
    middle = F.transform("_values", lambda v, i: F.concat(_filled(F.get("_found", i), v["value"]), F.get(pieces, i + 1)))
    new = F.concat(F.get(pieces, F.lit(0)), F.array_join(middle, ""))
    order = [F.col(f"`{c}`") for c in base.columns]
    changed = joined.withColumn("n_entities", F.size("_found").cast("long")).withColumn(text, new).select(*order, "n_entities")
    same = marked.where(F.size("_found") == 0).select(*order, F.lit(0).cast("long").alias("n_entities"))
    return same.unionByName(changed)
