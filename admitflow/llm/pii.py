"""Surrogates for personal data, in DataFrame expressions alone.

Emails, phone numbers (national of ten digits, and international), IPv4 and IPv6
addresses, bank accounts (IBAN with right check digits), payment cards (with a
right check digit), social security numbers and names of persons are found in
the whole text. A person is found after a form of address in any case, after a
phrase that names someone ("my name is"), or by a known given name; a family
name found so is then found everywhere in that text, where it stands alone with
a capital. A name that none of these gives away stays. Each entity gets a surrogate from a keyed hash of
its type and canonical form: the same entity gets the same surrogate in every
document and format (coreference), digits take the place of digits, letters of
letters of their script, cards keep their check digit and letter case is kept.
Given names end as their gender's do: it chooses the ending alone, and is one for a
name in the whole corpus (what its titles and the known names say of it, neutral
where they disagree), so "Dr. Oksana" and "Mrs Oksana" stay one person. IPv6
addresses are one in all their abbreviations. "Family, Given" is read as the name
it is, and a name that stands with capitals once is found in small letters too.

Collision checks over all distinct entities keep them distinct: a surrogate
that two entities share stays with the first in order, and one that is itself an entity of the corpus goes;
those affected get the next attempt, from the fifth on with longer words (and 192.168 addresses from the wider 10 range), until no collision is left.
Attempts above 0 are rare: up to ``MAX_LATER`` travel with the expressions, more
are joined back by document. Number spaces can't grow, so over ``MAX_ROUNDS`` rounds are an error.

Defined results: null text stays null with no entities; of overlapping
entities the first counts, then by order of type; repeated rows are rewritten each on
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.llm.spans import clean, let, matches, replace_spans
from admitflow.session import checkpoint_dir, cut

MAX_ROUNDS, LONGER_FROM = 40, 4
#: Entities with a later attempt that travel with the expressions; more are joined to the documents that have them.
MAX_LATER = 4000
ENTITIES = "array<struct<start:bigint,rank:int,end:bigint,kind:string,canon:string,value:string>>"

#: Forms of address by gender, phrases that name someone, and common given names by gender.
ADDRESS = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Signora", "Госпожа", "Κυρία"),
    "m": ("Mr", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"),
    "": ("Dr", "Doctor", "Prof", "Professor", "Docteur", "Doktor", "Dra"),
}
PHRASES = ("my name is", "his name is", "her name is", "i am called", "signed by", "attention of", "je m'appelle", "mon nom est", "ich heiße", "mein name ist", "me llamo", "mi nombre es", "mi chiamo", "меня зовут")
GIVEN = {
    "f": (
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily", "Emma", "Olivia", "Sophia", "Anna", "Maria", "Laura", "Julia", "Sophie", "Claire", "Camille", "Marie", "Isabelle",
        "Ursula", "Sabine", "Monika", "Petra", "Heike", "Carmen", "Lucía", "Isabel", "Ana", "Sofia", "Elena", "Olga", "Natalia", "Svetlana", "Irina", "Tatiana", "Priya", "Anjali", "Lakshmi", "Aisha", "Fatima", "Zainab", "Leila", "Yasmin",
        "Mei", "Xiu", "Yuki", "Sakura", "Keiko", "Ingrid", "Astrid", "Chiara", "Giulia", "Francesca", "Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина", "Μαρία", "Ελένη",
    ),
    "m": (
        "James", "Robert", "John", "Michael", "David", "William", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Andrew", "George", "Henry", "Peter", "Paul", "Hans", "Jürgen", "Klaus", "Wolfgang", "Stefan", "Dieter",
        "Pierre", "Jean", "Jacques", "François", "Michel", "Carlos", "José", "Antonio", "Juan", "Miguel", "Pablo", "Diego", "Ivan", "Sergei", "Dmitri", "Vladimir", "Alexei", "Raj", "Rahul", "Amit", "Arjun", "Sanjay", "Ahmed", "Mohammed",
        "Muhammad", "Ali", "Omar", "Hassan", "Wei", "Jun", "Hiroshi", "Kenji", "Takashi", "Lars", "Sven", "Erik", "Marco", "Giuseppe", "Giovanni", "Иван", "Пётр", "Сергей", "Дмитрий", "Владимир", "Γιώργος", "Νίκος",
    ),
}
ONE_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
EVERYONE = "|".join(title for titles in ADDRESS.values() for title in titles)
BEFORE = rf"(?iu:{EVERYONE})\.? +|(?iu:{'|'.join(PHRASES)})[,:]? +"
PERSON = rf"(?<![\p{{L}}])(?:(?:{BEFORE}){ONE_NAME}(?: +{ONE_NAME}){{0,2}}|(?:{'|'.join((*GIVEN['f'], *GIVEN['m']))}) +{ONE_NAME}|{ONE_NAME}, +(?:{'|'.join((*GIVEN['f'], *GIVEN['m']))}))(?![\p{{L}}])"
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.+-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\d)|0\d{2,4}[ /-]\d{5,8}(?![\d-]))",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![\p{L}\p{N}])",
}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: country codes of phone numbers with one or two digits; the others have three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Scripts: class of its letters, letters for even places, letters for odd places, endings of a feminine and a masculine given name.
SCRIPTS = (
    (r"\p{IsCyrillic}", "бвгдзклмнпрст", "аеиоу", "а", "н"),
    (r"\p{IsGreek}", "βγδκλμνπρστ", "αειο", "α", "ς"),
    (r"\p{IsHebrew}", "בגדחטכלמנפקרשת", "אהוי", "ה", "ן"),
    (r"\p{IsArabic}", "بتدرسعفقكلمن", "اوي", "ا", "د"),
    (r"\p{IsHan}", "明華文安平和光春林江", "山田石木川原村井上野", "美", "雄"),
    (r"\p{IsHiragana}", "かさたなはまら", "あいうえお", "こ", "お"),
    (r"\p{IsKatakana}", "カサタナハマラ", "アイウエオ", "コ", "オ"),
    (r"\p{IsHangul}", "가나다라마바사아자하", "고노도로모보소오조호", "희", "준"),
    (r"\p{L}", "bcdfghjklmnprstvwz", "aeiou", "a", "n"),
)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def check_sum(numbers: Column, weight_from: int) -> Column:
    """The card check sum of an array of digits, from the right; ``weight_from`` 1 doubles every second, 0 from the first on."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.reverse(numbers), lambda d, i: F.when((i + weight_from) % 2 == 0, doubled(d)).otherwise(d))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10


def numbers(value: Column) -> Column:
    return F.transform(F.split(digits(value), ""), lambda c: c.cast("int"))


def rest_97(account: Column) -> Column:
    """The remainder by 97 of an account number whose country and check digits stand last, with letters as numbers from 10."""

    def step(acc: Column, c: Column) -> Column:
        letter = F.position(c, F.lit(LETTERS))
        return F.when(letter > 0, (acc * 100 + letter + 9) % 97).otherwise((acc * 10 + c.cast("int")) % 97)

    return F.aggregate(F.split(account, ""), F.lit(0), step)


def account_holds(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (rest_97(F.concat(F.substring(plain, F.lit(5), F.lit(40)), F.substring(plain, F.lit(1), F.lit(4)))) == 1)


def phone_canon(value: Column) -> Column:
    """A number of ten digits, also after +1, is one; other numbers keep their country code."""
    number = digits(value)
    foreign = value.startswith("+") & ~(number.startswith("1") & (F.length(number) == 11))
    return F.when(foreign, F.concat(F.lit("+"), number)).when(number.startswith("0"), number).otherwise(F.right(number, F.lit(10)))


def ip6_canon(value: Column) -> Column:
    """All eight groups, in small letters, without leading zeros."""
    groups = lambda t: F.filter(F.split(F.lower(t), ":"), lambda g: g != "")
    left, right = groups(F.substring_index(value, "::", 1)), groups(F.when(F.contains(value, F.lit("::")), F.substring_index(value, "::", -1)).otherwise(""))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
    return F.array_join(F.transform(filled, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def entities(text: Column) -> Column:
    """Non-overlapping entities of a :func:`clean` text, by start."""

    def plain(kind: str, rank: int, keep=None) -> Column:
        def entity(m: Column) -> Column:
            value = m["value"]
            canon = F.lower(value) if kind in ("email", "ip") else ip6_canon(value) if kind == "ip6" else phone_canon(value) if kind == "phone" else F.replace(value, F.lit(" "), F.lit("")) if kind == "iban" else digits(value)
            return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), canon.alias("canon"), m["value"].alias("value"))

        return F.transform(matches(text, PATTERNS[kind], keep), entity).cast(ENTITIES)

    def part(kind: Column, value: Column, start: Column, rank: int = 9) -> Column:
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(value)).alias("end"), kind.alias("kind"), F.lower(value).alias("canon"), value.alias("value"))

    def person(m: Column) -> Column:
        rest = F.regexp_replace(m["value"], f"^(?:{BEFORE})", "")
        turned = F.contains(m["value"], F.lit(","))
        title = F.regexp_replace(F.lower(F.substring_index(m["value"], " ", 1)), r"\.$", "")
        names = F.split(rest, " +")
        first = F.get(names, F.lit(0))
        told = F.when(title.isin(*(t.lower() for t in ADDRESS["f"])), "given_f").when(title.isin(*(t.lower() for t in ADDRESS["m"])), "given_m")
        kind = F.coalesce(told, F.when(first.isin(*GIVEN["f"]), "given_f").when(first.isin(*GIVEN["m"]), "given_m").otherwise("given"))
        start = m["end"] - F.length(rest)
        behind = F.regexp_replace(rest, "^[^ ]+ +", "")
        places = F.array(
            F.when(F.size(names) > 1, part(kind, first, start)),
            F.when(F.size(names) > 2, part(F.lit("given"), F.get(names, F.lit(1)), m["end"] - F.length(behind))),
            part(F.lit("family"), F.element_at(names, -1), m["end"] - F.length(F.element_at(names, -1))),
        ).cast(ENTITIES)
        given = F.substring_index(rest, " ", -1)
        told_by = F.when(given.isin(*GIVEN["f"]), "given_f").otherwise("given_m")
        reverse = F.array(part(F.lit("family"), F.substring_index(rest, ",", 1), start), part(told_by, given, m["end"] - F.length(given))).cast(ENTITIES)
        whole = turned & F.lit(True) & F.substring_index(rest, ",", -1).rlike(f"^ +{ONE_NAME}$") & ~m["value"].rlike(f"^(?:{BEFORE})")
        return F.when(whole, reverse).otherwise(F.filter(places, lambda p: p.isNotNull()))

    none = F.array().cast(ENTITIES)
    card = lambda v: check_sum(numbers(v), 1) == 0
    dialled = lambda v: F.length(digits(v)).between(8, 15)
    hexes = lambda v: v.rlike("[0-9]") & (F.length(v) - F.length(F.replace(v, F.lit(":"), F.lit(""))) > 2)
    numeric = F.concat(
        F.when(text.rlike(r"[0-9]\.[0-9]"), plain("ip", 1)).otherwise(none), F.when(text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]"), plain("ip6", 1, hexes)).otherwise(none), plain("ssn", 2), plain("phone", 3, dialled),
        plain("card", 4, card), F.when(text.rlike("[A-Z]{2}[0-9]{2}"), plain("iban", 0, account_holds)).otherwise(none),
    )

    def with_bare_families(persons: Column) -> Column:
        """The family names of a text's persons, wherever they stand alone with a capital."""
        families = F.array_distinct(F.transform(F.filter(persons, lambda p: (p["kind"] == "family") & (F.length(p["value"]) > 2)), lambda p: p["value"]))
        pattern = F.concat(F.lit(r"(?<![\p{L}'’-])(?iu:"), F.array_join(families, "|"), F.lit(r")(?![\p{L}])"))
        bare = F.transform(matches(text, pattern, lambda v: v.rlike(r"^\p{Lu}")), lambda m: part(F.lit("family"), m["value"], m["start"], 10))
        # whole names in small letters: a given name and the family name behind it
        follows = lambda p, i: F.coalesce(p["kind"].startswith("given") & (F.get(persons, i + 1)["kind"] == "family") & (F.get(persons, i + 1)["start"] == p["end"] + 1), F.lit(False))
        pairs = F.filter(F.transform(persons, lambda p, i: F.struct(follows(p, i).alias("ok"), F.concat(p["canon"], F.lit(" "), F.get(persons, i + 1)["canon"]).alias("name"), p["kind"].alias("kind"))), lambda x: x["ok"])
        names = F.concat(F.lit(r"(?<![\p{L}'’-])(?:"), F.array_join(F.array_distinct(pairs["name"]), "|"), F.lit(r")(?![\p{L}])"))

        def small(m: Column) -> Column:
            given = F.substring_index(m["value"], " ", 1)
            kind = F.get(F.filter(pairs, lambda x: x["name"] == m["value"]), F.lit(0))["kind"]
            return F.array(part(kind, given, m["start"]), part(F.lit("family"), F.substring_index(m["value"], " ", -1), m["start"] + F.length(given) + 1)).cast(ENTITIES)

        lower = F.when(F.size(pairs) > 0, F.flatten(F.transform(matches(text, names), small))).otherwise(none)
        return F.when(F.size(families) > 0, F.concat(persons, bare.cast(ENTITIES), lower)).otherwise(persons)

    found = F.concat(
        F.when(text.contains("@"), plain("email", 0)).otherwise(none),
        F.when(text.rlike("[0-9]{2}"), numeric).otherwise(none),
        let(F.flatten(F.transform(matches(text, PERSON), person)), with_bare_families),
    )

    def first_only(ordered: Column) -> Column:
        state = f"struct<at:bigint,kept:{ENTITIES}>"

        def step(acc: Column, e: Column) -> Column:
            kept = F.when(e["start"] >= acc["at"], F.concat(acc["kept"], F.array(e).cast(ENTITIES))).otherwise(acc["kept"])
            return F.struct(F.greatest(acc["at"], F.when(e["start"] >= acc["at"], e["end"]).otherwise(acc["at"])).alias("at"), kept.alias("kept")).cast(state)

        return F.aggregate(ordered, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("kept")).cast(state), step, lambda acc: acc["kept"])

    return let(F.array_sort(found), lambda o: F.when(F.size(o) == 0, none).otherwise(first_only(o)))


def number_at(stream: Column, i: Column) -> Column:
    """0..255 from a hexadecimal stream of 64 bytes."""
    return F.conv(F.substring(stream, (2 * (i % 64) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def pick(letters: str, stream: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), (number_at(stream, i) % len(letters) + 1).cast("int"), F.lit(1))


def like_letters(value: Column, stream: Column) -> Column:
    """Letters become letters of their script, digits digits; the rest stays."""

    def char(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"^[0-9]$"), (number_at(stream, i) % 10).cast("string"))
        for script, even, odd, _, _ in SCRIPTS:
            out = out.when(c.rlike(f"^{script}$"), F.when(i % 2 == 0, pick(even, stream, i)).otherwise(pick(odd, stream, i)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), char), "")


def space(kind: Column) -> Column:
    """Kinds that share their surrogates: given names of any gender are one."""
    return F.when(kind.startswith("given"), "given").otherwise(kind)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of an entity."""
    longer = F.greatest(attempt - (LONGER_FROM - 1), F.lit(0))

    def made(h: Column) -> Column:
        at = lambda n, least=0: (least + number_at(h, F.lit(n)) % (10 - least)).cast("string")
        random = lambda first, size: F.array_join(F.transform(F.sequence(F.lit(first), first + size - 1), lambda i: (number_at(h, i) % 10).cast("string")), "")
        country = F.regexp_extract(canon, COUNTRY, 1)
        abroad = F.concat(country, at(0, 2), random(1, F.length(canon) - F.length(country) - 2))
        phone = F.when(canon.startswith("+"), abroad).otherwise(F.concat(*(at(n, 2 if n in (0, 3) else 0) for n in range(10))))
        hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.hex(4096 * (1 + number_at(h, 2 * i) % 15) + 16 * number_at(h, 2 * i + 1) + number_at(h, i + 20) % 16))), ":")
        like = F.transform(F.split(F.substring(canon, F.lit(5), F.lit(40)), ""), lambda c, i: F.when(c.rlike("[0-9]"), (number_at(h, i) % 10).cast("string")).otherwise(pick(LETTERS, h, i)))
        land = F.substring(canon, F.lit(1), F.lit(2))
        account = let(F.array_join(like, ""), lambda body: F.concat(land, F.lpad((98 - rest_97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0"), body))
        social = F.concat(F.lit("9"), *(at(n) for n in range(8)))
        octet = lambda n: number_at(h, F.lit(n)).cast("string")
        private = F.regexp_extract(canon, r"^(?:10\.|192\.168\.)", 0)
        ip = F.when(private == "10.", F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))).when(private != "", F.concat_ws(".", F.when(longer > 0, F.concat(F.lit("10."), octet(1))).otherwise("192.168"), octet(2), octet(3)))
        ip = ip.otherwise(F.concat_ws(".", (11 + number_at(h, F.lit(0)) % 116).cast("string"), octet(1), octet(2), octet(3)))
        body = F.concat(F.substring(canon, 1, 1), F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon) - 2), lambda i: (number_at(h, i) % 10).cast("string")), ""))
        card = let(body, lambda b: F.concat(b, ((10 - check_sum(numbers(b), 0)) % 10).cast("string")))
        more = F.when(longer > 0, F.concat((number_at(h, F.lit(60)) % 10).cast("string"), longer.cast("string"))).otherwise("")
        domain = F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1)
        email = F.concat(
            like_letters(F.regexp_extract(canon, "^[^@]*", 0), h), more, F.lit("@"),
            let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 512), lambda d: like_letters(domain, d)), F.regexp_extract(canon, r"\.[^.]*$", 0),
        )
        ending = F.lit(None).cast("string")
        for script, _, _, female, male in reversed(SCRIPTS):
            last = F.when(kind == "given_f", F.lit(female)).when(kind == "given_m", F.lit(male))
            ending = F.when(F.right(canon, F.lit(1)).rlike(f"^{script}$"), last).otherwise(ending)
        base = like_letters(F.concat(canon, F.when(longer > 0, F.repeat(F.right(canon, F.lit(1)), longer.cast("int"))).otherwise("")), h)
        name = F.when(ending.isNull() | (F.length(base) < 3), base).otherwise(F.concat(F.substring(base, F.lit(1), F.length(base) - 1), ending))
        return F.when(kind == "phone", phone).when(kind == "ssn", social).when(kind == "ip", ip).when(kind == "ip6", hexed).when(kind == "iban", account).when(kind == "card", card).when(kind == "email", email).otherwise(name)

    return let(F.sha2(F.concat_ws("|", F.lit(key), space(kind), canon, attempt.cast("string")), 512), made)


def in_format(kind: Column, value: Column, core: Column) -> Column:
    """A canonical surrogate in the given value's format."""
    own = digits(value)

    def char(c: Column, i: Column) -> Column:
        from_end = F.length(digits(F.substring(value, (i + 1).cast("int"), F.lit(1000))))
        replaced = F.substring(core, (F.length(core) - from_end + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("^[0-9]$") & (from_end <= F.length(core)), replaced).otherwise(c)

    def alike(c: Column, i: Column) -> Column:
        place = F.length(F.replace(F.substring(value, F.lit(1), (i + 1).cast("int")), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substring(core, place, F.lit(1)))

    number = F.array_join(F.transform(F.split(value, ""), char), "")
    account = F.array_join(F.transform(F.split(value, ""), alike), "")
    upper = (value == F.upper(value)) & (value != F.lower(value))
    cased = F.when(upper & (F.length(value) > 1), F.upper(core)).when(kind == "email", core).otherwise(F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, 2, 1000)))
    return F.when(kind.isin("phone", "ssn", "card") & (own != ""), number).when(kind.isin("ip", "ip6"), core).when(kind == "iban", account).otherwise(cased)


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, as_kind, attempt) of the entities whose first surrogate collides, or that the corpus gives another gender than their kind. found: a column ``entities``."""
    every = cut(found.select(F.explode("entities").alias("e")).select("e.kind", "e.canon").distinct())
    said = lambda g: F.max((F.col("kind") == g).cast("int"))
    genders = every.where(F.col("kind").startswith("given")).groupBy("canon").agg((said("given_f") - said("given_m")).alias("gender")).withColumn("space", F.lit("given"))
    one = F.when(F.col("gender") > 0, "given_f").when(F.col("gender") < 0, "given_m").when(F.col("gender") == 0, "given").otherwise(F.col("kind"))
    every = cut(every.withColumn("space", space(F.col("kind"))).join(genders, ["space", "canon"], "left").select("kind", "canon", one.alias("as_kind"), "space"))
    known = every.select("space", F.col("canon").alias("core")).distinct()
    table = every.select(F.col("as_kind").alias("kind"), "canon").distinct().withColumn("attempt", F.lit(0))
    for _ in range(MAX_ROUNDS):
        table = cut(table.withColumns({"core": surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key), "space": space(F.col("kind"))}))
        shared = table.groupBy("space", "core").agg(F.min(F.struct("attempt", "kind", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        losers = table.join(shared, ["space", "core"]).where("first.kind != kind or first.canon != canon").select("kind", "canon")
        taken = table.join(known, ["space", "core"], "left_semi").select("kind", "canon")
        bad = cut(losers.union(taken).distinct().withColumn("again", F.lit(1)))
        if bad.isEmpty():
            tried = table.where("attempt > 0").select(F.col("kind").alias("as_kind"), "canon", "attempt")
            return every.join(tried, ["as_kind", "canon"], "left").where("attempt > 0 or kind != as_kind").select("kind", "canon", "as_kind", F.coalesce("attempt", F.lit(0)).alias("attempt"))
        table = table.join(bad, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds: a kind has more entities than its format allows")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", max_later: int = MAX_LATER) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds (in order of the text, comma-joined) of every document."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("original"))
    # found once: texts and their entities are written, and read for the collisions (entities alone) and for the rewriting
    path = f"{checkpoint_dir(docs.sparkSession)}/entities-{uuid.uuid4().hex}"
    given.withColumn("entities", entities(clean(F.col("original")))).write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.parquet(path)
    later = cut(attempts(found, key))
    few = later.limit(max_later + 1).collect()
    if len(few) <= max_later:
        pairs = [x for r in few for x in (F.lit(f"{r['kind']}|{r['canon']}"), F.struct(F.lit(r["as_kind"]).alias("as_kind"), F.lit(r["attempt"]).alias("attempt")))]
        attempt_of = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,struct<as_kind:string,attempt:int>>")
    else:
        each = found.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.kind", "e.canon").distinct()
        pair = F.struct(F.concat_ws("|", "kind", "canon"), F.struct("as_kind", "attempt"))
        by_doc = each.join(later, ["kind", "canon"]).groupBy(F.col("doc_id").alias("__id")).agg(F.map_from_entries(F.collect_set(pair)).alias("later"))
        found = found.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
        attempt_of = F.col("later")

    def value(e: Column) -> Column:
        def with_later(later: Column) -> Column:
            kind, attempt = F.coalesce(later["as_kind"], e["kind"]), F.coalesce(later["attempt"], F.lit(0))
            return let(surrogate(kind, e["canon"], attempt, key), lambda core: in_format(e["kind"], e["value"], core))

        return let(F.try_element_at(attempt_of, F.concat_ws("|", e["kind"], e["canon"])), with_later)

    return found.select(
        "doc_id",
        F.when(F.size("entities") == 0, F.col("original")).otherwise(replace_spans(F.col("original"), F.col("entities"), value)).alias("text"),
        F.size("entities").cast("long").alias("n_entities"),
        F.array_join(F.col("entities.kind"), ",").alias("kinds"),
    )
