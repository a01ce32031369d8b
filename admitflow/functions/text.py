"""Text and scalar expressions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM = " \n\t-:"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def collapse(text: Column) -> Column:
    """White space runs to one space, trimmed (index side)."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


#: Character references by name, with and without a semicolon, as HTML has them.
NAMED = "\x01".join(f"{name}\x02{value}" for name, value in html5.items())
BARE = {name: value for name, value in html5.items() if not name.endswith(";")}
#: References that most texts hold; they are looked for before the table.
OFTEN = {n: html5[n] for n in ("amp;", "nbsp;", "quot;")}
#: Numbers that stand for another character: those of Windows-1252.
OTHER_CHARACTER = {0: "\ufffd", 0x0D: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def numbered(digits: Column, base: int) -> Column:
    """The character of a number in text."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(F.length(plain) <= 8, F.conv(plain, base, 10).cast("long")).otherwise(1 << 40)

    def of(n: Column) -> Column:
        other = F.str_to_map(F.lit("\x02".join(f"{k}\x03{v}" for k, v in OTHER_CHARACTER.items())), F.lit("\x02"), F.lit("\x03"))
        out = F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when((n < 160) & F.map_contains_key(other, n.cast("string")), F.try_element_at(other, n.cast("string")))
        none = n.between(1, 31) & ~n.isin(9, 10, 12, 13) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return out.when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    return let(number, of)


def unescape(text: Column) -> Column:
    """All character references decoded, once: named ones (also the old ones without a semicolon, the longest that fits) and numbers."""
    table = F.str_to_map(F.lit(NAMED), F.lit("\x01"), F.lit("\x02"))
    bare = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in BARE.items())), F.lit("\x01"), F.lit("\x02"))

    def name(m: Column) -> Column:
        out = F.when(m == "amp;", OFTEN["amp;"]).when(m == "nbsp;", OFTEN["nbsp;"]).when(m == "quot;", OFTEN["quot;"])
        longest = F.get(F.filter(F.transform(F.sequence(F.least(F.length(m) - 1, F.lit(max(map(len, BARE)))), F.lit(2), F.lit(-1)), lambda n: F.substring(m, F.lit(1), n)), lambda x: F.map_contains_key(bare, x)), F.lit(0))
        begun = let(longest, lambda x: F.when(x.isNotNull(), F.concat(F.element_at(bare, x), F.substring(m, F.length(x) + 1, F.length(m)))))
        tail = F.coalesce(F.try_element_at(table, m), F.when(F.length(m) > 2, begun), F.concat(F.lit("&"), m))
        return out.otherwise(tail)

    def piece(p: Column) -> Column:
        found = F.regexp_extract(p, "^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)", 1)

        def decoded(m: Column) -> Column:
            char = F.when(m.startswith("#x") | m.startswith("#X"), numbered(F.regexp_extract(m, "[0-9a-fA-F]+", 0), 16)).when(m.startswith("#"), numbered(F.regexp_extract(m, "[0-9]+", 0), 10)).otherwise(name(m))
            return F.when(m == "", F.concat(F.lit("&"), p)).otherwise(F.concat(char, F.substring(p, F.length(m) + 1, F.length(p))))

        return let(found, decoded)

    def of(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), piece), ""))

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), of)).otherwise(text)


def normal_text(text: Column) -> Column:
    """Page text: references decoded, white space collapsed, trimmed of spaces, dashes and colons."""
    return F.btrim(F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "), F.lit(TRIM))


#: The references that SQL decodes, each with its semicolon, in this order; ``&amp;`` is last, so that nothing is decoded twice.
COMMON = {"&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&#39;": "'", "&amp;": "&"}


def common_text(text: Column) -> Column:
    """:func:`normal_text` as SQL has it: the references of ``COMMON`` alone, and white space of ASCII."""
    for reference, char in COMMON.items():
        text = F.replace(text, F.lit(reference), F.lit(char))
    return F.btrim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), F.lit(TRIM))


def without_markup(html: Column) -> Column:
    """Breaks to spaces, ends of blocks to line feeds, other tags to spaces."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>", " ")
    text = F.regexp_replace(text, r"(?i)</(?:p|div|li|h[1-6]|tr)>", "\n")
    return F.regexp_replace(text, "<[^>]+>", " ")


def strip_html(html: Column) -> Column:
    """:func:`without_markup`, then :func:`normal_text`."""
    return normal_text(without_markup(html))


def canonical_url(url: Column) -> Column:
    """Without parameters, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), ";[^/]*$", "")


def canonical_number(text: Column) -> Column:
    """``2.0`` to ``2``, ``6.50`` to ``6.5``; what isn't a number stays."""
    decimal = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), decimal).otherwise(text)


def parse_duration(raw: Column) -> Column:
    """struct<min, max, error>: one number, or two in order; anything else is an error."""

    def of(found: Column) -> Column:
        ok = F.size(found).isin(1, 2)
        return F.struct(F.when(ok, F.array_min(found)).alias("min"), F.when(ok, F.array_max(found)).alias("max"), F.when(~ok, "unsupported_duration").alias("error"))

    numbers = F.transform(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?)")), lambda x: x.cast("double"))
    return let(numbers, of)


#: Names of the months with an intake, and their order.
MONTHS = {
    "JAN": "JAN", "JANUARY": "JAN", "FEB": "FEB", "FEBRUARY": "FEB", "MAR": "MAR", "MARCH": "MAR",
    "JUL": "JUL", "JULY": "JUL", "AUG": "AUG", "AUGUST": "AUG", "OCT": "OCT", "OCTOBER": "OCT",
}
MONTH_ORDER = ("JAN", "FEB", "MAR", "JUL", "AUG", "OCT")


def mapped(names: dict[str, str], token: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), token)


def parse_intakes(raw: Column) -> Column:
    """struct<months, error>: distinct months in calendar order; an unknown or missing name is an error."""
    tokens = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[,/]"), lambda t: F.upper(F.trim(t))), lambda t: t != "")

    def of(months: Column) -> Column:
        bad = (F.size(months) == 0) | F.exists(months, lambda m: m.isNull())
        ordered = F.filter(F.array(*map(F.lit, MONTH_ORDER)), lambda m: F.array_contains(months, m))
        return F.struct(F.when(~bad, ordered).alias("months"), F.when(bad, "unsupported_intake").alias("error"))

    return let(F.transform(tokens, lambda t: mapped(MONTHS, t)), of)


def parse_score_text(raw: Column) -> Column:
    """struct<overall, min_band, listening, reading, speaking, writing, unparsed> of ``7.5 (7.0 R/W; 8.0 L/S)``."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    number = r"([0-9](?:\.[0-9])?)"
    overall = blank_to_null(F.regexp_extract(text, rf"^\s*{number}", 1)).cast("double")

    def of(inside: Column) -> Column:
        single = blank_to_null(F.regexp_extract(inside, rf"^{number}$", 1)).cast("double")
        pieces = F.transform(F.split(inside, ";"), lambda p: F.trim(p))
        good = F.filter(pieces, lambda p: p.rlike(rf"^{number}\s+[A-Z/]+$"))

        def part(letter: str) -> Column:
            own = F.filter(good, lambda p: F.array_contains(F.split(F.regexp_extract(p, r"\s([A-Z/]+)$", 1), "/"), letter))
            return F.coalesce(single, F.try_element_at(F.transform(own, lambda p: F.regexp_extract(p, f"^{number}", 1).cast("double")), F.lit(-1)))

        parts = {name: part(name[0].upper()) for name in ("listening", "reading", "speaking", "writing")}
        none = F.coalesce(*parts.values()).isNull()
        first = blank_to_null(F.regexp_extract(inside, number, 1)).cast("double")
        return F.struct(
            overall.alias("overall"), F.when(none, first).otherwise(F.least(*parts.values())).alias("min_band"),
            *(c.alias(n) for n, c in parts.items()), F.when(none, blank_to_null(inside)).alias("unparsed"),
        )

    return let(F.trim(F.regexp_extract(text, r"\(([^)]*)\)", 1)), of)


def first_place(text: Column, markers: Sequence[str], after: Column | None = None) -> Column:
    """1-based place of the earliest marker (behind ``after``), or null."""
    places = [F.nullif(F.locate(m, text) if after is None else F.call_function("locate", F.lit(m), text, after + 1), F.lit(0)) for m in markers]
    return F.least(*places) if len(places) > 1 else places[0]


def section_window(text: Column, starts: Sequence[str], ends: Sequence[str], length: int = 2400) -> Column:
    """From the earliest start marker to the earliest end marker behind it, else ``length`` characters."""
    low = F.lower(text)

    def of(start: Column) -> Column:
        end = F.coalesce(first_place(low, ends, start), start + length)
        return F.when(start.isNull(), "").otherwise(F.trim(F.substring(text, start, end - start)))

    return let(first_place(low, starts), of)


def sentence_around(text: Column, marker: str) -> Column:
    """The sentence of the first marker, with its full stop; empty without a marker. By places, as a pattern would rescan each sentence from every character."""
    place = F.locate(marker, F.lower(text))

    def of(at: Column) -> Column:
        head = F.substring_index(F.substring(text, F.lit(1), at - 1), ".", -1)
        rest = F.substring(text, at, F.length(text))
        return F.when(at == 0, "").otherwise(F.trim(F.concat(head, F.substring_index(rest, ".", 1), F.when(rest.contains("."), ".").otherwise(""))))

    return let(place, of)


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """The first match of the first pattern in order that matches."""
    return F.coalesce(*(blank_to_null(F.regexp_extract(text, f"(?i){p}", 0)) for p in patterns))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | text.contains(n)
    return found


def trimmed(text: Column, limit: int = 240, mark: str = "...") -> Column:
    """At most ``limit`` characters; a longer text is cut one short and marked (so it can be longer than the limit)."""
    return let(collapse(text), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit(mark))))


def snippet(text: Column, keywords: Column, limit: int = 240, before: int = 80) -> Column:
    """Around the earliest keyword: ``before`` characters ahead of it, ``limit`` long."""

    def of(t: Column) -> Column:
        places = F.filter(F.transform(keywords, lambda k: F.instr(F.lower(t), F.lower(k))), lambda p: p > 0)
        start = F.greatest(F.array_min(places) - before, F.lit(1))
        return F.when(F.size(places) == 0, trimmed(t, limit)).otherwise(trimmed(F.substring(t, start, F.lit(limit)), limit))

    return let(collapse(text), of)


#: Degree types in the order of their test.
DEGREES = ("master", "graduate diploma", "graduate certificate", "doctor", "juris doctor", "phd")


def degree_type(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for d in reversed(DEGREES):
        out = F.when(F.lower(name).contains(d), F.initcap(F.lit(d))).otherwise(out)
    return out


def match_key(name: Column) -> Column:
    """Lower case, ``&`` to ``and``, no brackets, slashes, colons and commas, no ``the``."""
    text = F.replace(F.lower(collapse(name)), F.lit("&"), F.lit(" and "))
    return collapse(F.regexp_replace(F.regexp_replace(text, "[()/:,]", " "), r"\bthe\b", " "))


def is_research(name: Column) -> Column:
    return contains_any(F.lower(name), ("doctor of philosophy", "master of philosophy", "research"))


def dedupe_folded(values: Column, limit: int | None = None) -> Column:
    """Distinct without regard to case, the first spelling kept, in order."""
    start = F.array().cast("array<string>")
    kept = F.aggregate(values, start, lambda acc, x: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))
    return kept if limit is None else F.slice(kept, 1, limit)


#: Test names with their patterns; the score is group 1, a band group 2.
TESTS = {
    "IELTS Academic": r"ielts(?:\s+academic)?[^0-9]{0,20}([4-9](?:\.[05])?)(?:[^0-9]{0,40}(?:no\s+(?:band|component)\s+below|min(?:imum)?\s+band(?:\s+of)?|each(?:\s+band)?\s+at)\s*([4-9](?:\.[05])?))?",
    "TOEFL iBT": r"toefl(?:\s+ibt)?[^0-9]{0,20}([0-9]{2,3})()",
    "PTE Academic": r"pte(?:\s+academic)?[^0-9]{0,20}([0-9]{2,3})()",
    "LanguageCert Academic": r"languagecert(?:\s+academic(?:\s+\(in-person\))?)?[^0-9]{0,20}([0-9]{2,3})()",
}
CAMBRIDGE = r"(?i)cambridge\s+(c1\s+advanced|c2\s+proficiency)[^0-9]{0,20}([0-9]{2,3})"


def language_tests(text: Column) -> Column:
    """array<struct<test_name, overall, band>>: the first match of each test, all of the Cambridge ones."""

    def one(name: str, pattern: str) -> Column:
        score, band = (F.regexp_extract(text, f"(?i){pattern}", g) for g in (1, 2))
        return F.struct(F.lit(name).alias("test_name"), score.alias("overall"), blank_to_null(band).alias("band"))

    found = F.filter(F.array(*(one(*x) for x in TESTS.items())), lambda t: t["overall"] != "")
    cambridge = F.transform(
        F.regexp_extract_all(text, F.lit(CAMBRIDGE), F.lit(0)),
        lambda m: F.struct(
            F.concat(F.lit("Cambridge "), F.initcap(collapse(F.regexp_extract(m, CAMBRIDGE, 1)))).alias("test_name"), F.regexp_extract(m, CAMBRIDGE, 2).alias("overall"), F.lit(None).cast("string").alias("band")
        ),
    )
    return F.concat(found, cambridge)


#: Flags of an application with the words that raise them, document labels, and notes.
FLAGS = {
    "requires_portfolio": ("portfolio",),
    "requires_personal_statement": ("personal statement", "statement of intent"),
    "requires_supplementary_form": ("supplementary form",),
    "requires_cv_or_resume": ("cv", "resume"),
    "requires_references": ("references", "referees"),
    "requires_work_experience": ("work experience",),
    "limited_places": ("limited places",),
    "quota_applies": ("quota applies",),
}
DOCUMENTS = {
    "portfolio": "Portfolio", "personal statement": "Personal statement", "statement of intent": "Personal statement", "supplementary form": "Supplementary form",
    "cv": "CV", "resume": "Resume", "references": "References", "referees": "References", "work experience": "Work experience evidence",
}
NOTES = ("limited places", "quota applies", "rolling basis", "approval and availability")


def application_details(text: Column) -> Column:
    """struct of the flags, required_documents, selection_notes and raw_text, of the text as :func:`normal_text` gives it."""

    def of(clean: Column) -> Column:
        low = F.lower(clean)
        documents = F.array_compact(F.array(*(F.when(low.contains(word), label) for word, label in DOCUMENTS.items())))
        notes = F.array_compact(F.array(*(F.when(low.contains(m), sentence_around(clean, m)) for m in NOTES)))
        flags = (contains_any(low, words).alias(flag) for flag, words in FLAGS.items())
        return F.struct(*flags, dedupe_folded(documents).alias("required_documents"), notes.alias("selection_notes"), clean.alias("raw_text"))

    return let(normal_text(text), of)


#: Words of a sentence on admission, and the patterns of its signals in order.
PATHWAY_WORDS = (
    "bachelor", "degree", "honours", "master", "thesis", "law degree", "common law", "qualification", "equivalent qualification", "experience", "admissions test", "credit average", "pass average",
    "graduate certificate", "graduate diploma", "undergraduate program", "cognate discipline", "related field", "80%", "65 percent", "concurrently enrolled", "legal reasoning",
)
SIGNALS = {
    "qualification": (r"bachelor(?:'s)? degree", r"postgraduate degree", r"master(?:'s)? degree", r"honours(?: degree)?", r"graduate certificate", r"graduate diploma", r"undergraduate program", r"qualification", r"higher degree", r"thesis"),
    "discipline": (r"business", r"commerce", r"law", r"common law", r"related discipline", r"cognate discipline", r"non-business", r"architecture", r"design", r"engineering", r"computer science", r"health", r"policy", r"project management", r"related field", r"any discipline"),
    "grade_requirement": (r"credit average(?:\s*\(\d+\s*percent\))?", r"pass average", r"distinction", r"standard acceptable", r"first class honours", r"second class honours", r"outstanding results", r"at least \d+\s*%", r"\d+\s*percent", r"average mark of at least \d+"),
    "work_experience": (r"\b\d+\s+year[s]?\s+relevant work experience", r"\b\d+\s+year[s]?\s+of\s+work experience", r"\b\d+\s+year[s]?\s+of\s+relevant professional experience", r"professional experience", r"work experience"),
    "admissions_test": (r"admissions test", r"legal reasoning", r"statement of intent", r"research proposal"),
}


def academic_pathways(text: Column) -> Column:
    """array<struct<summary, five signals and logic>>: sentences (alternatives split at "or") on admission with a signal."""
    marked = F.regexp_replace(normal_text(text), r"(?i)\s+or\s+", ". OR ")
    sentences = F.transform(F.split(marked, r"(?<=[.;])\s+"), lambda s: F.btrim(s, F.lit(TRIM)))
    on_topic = lambda s: (F.length(s) >= 24) & ~F.lower(s).contains("requirements for award") & ~F.lower(s).contains("credit points") & contains_any(F.lower(s), PATHWAY_WORDS)
    found = F.transform(F.filter(sentences, on_topic), lambda s: F.struct(s.alias("summary"), *(first_match(s, p).alias(n) for n, p in SIGNALS.items()), F.lit("OR").alias("logic")))
    return F.filter(found, lambda p: F.coalesce(*(p[n] for n in SIGNALS)).isNotNull())
