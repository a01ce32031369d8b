"""Free-form JSON documents as VARIANT columns: what a requirement's detail documents say, whatever their shape.

A document may be missing, no JSON, of another kind than expected, or nested; each reader says what it gives then.
:func:`document` reads the text once a row; the readers take its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions.pages import LISTING_FLAGS
from admitflow.functions.text import blank_to_null, collapse, contains_any, let, sentence_around, trimmed
from admitflow.operators.rules import DEADLINE_WORDS, PARTS, PATHWAYS, deadline_phrase, strictest_band

#: Fields of the application details that name a deadline, in order.
DEADLINE_FIELDS = ("deadline", "application_deadline", "closing_date", "close_date")


def document(text: Column) -> Column:
    """A JSON text as VARIANT; null where there is none or it can't be read."""
    return F.try_parse_json(text)


def kind_of(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BOOLEAN``, ``VOID`` (JSON null), or a number's type; null without a value."""
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def field(value: Column, name: str) -> Column:
    """A field of an object; null if the value is no object or hasn't got it."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def items(value: Column) -> Column:
    """Items of an array; empty if the value is none."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def spoken(value: Column) -> Column:
    """A value as text: strings as they are, ``True``, ``False`` and ``None``, numbers, and nested values as JSON."""
    kind = kind_of(value)
    said = F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string"))).when(kind == "VOID", "None").when(kind.isin("OBJECT", "ARRAY"), F.to_json(value))
    return said.otherwise(F.try_variant_get(value, "$", "string"))


def truthy(value: Column) -> Column:
    """False for null, false, zero, and empty texts, arrays and objects."""
    kind, text = kind_of(value), F.try_variant_get(value, "$", "string")
    empty = F.when(kind.isin("OBJECT", "ARRAY"), F.to_json(value).isin("{}", "[]")).when(kind == "BOOLEAN", text == "false").when(kind == "STRING", text == "").when(kind == "VOID", F.lit(True)).otherwise(F.try_variant_get(value, "$", "double") == 0)
    return value.isNotNull() & ~F.coalesce(empty, F.lit(False))


def metadata_text(value: Column, name: str) -> Column:
    """A field of the metadata: a text collapsed, a list's items joined by ", ", else the value as text; null if there is none or nothing in it."""
    own = field(value, name)
    parts = F.filter(F.transform(items(own), lambda x: collapse(spoken(x))), lambda x: x != "")
    kind = kind_of(own)
    return F.when(kind == "STRING", blank_to_null(collapse(spoken(own)))).when(kind == "ARRAY", blank_to_null(F.array_join(parts, ", "))).when(kind != "VOID", spoken(own))


def json_text(value: Column) -> Column:
    """A document as text; empty without one, and for an empty one."""
    return F.when(truthy(value), F.to_json(value)).otherwise("")


def academic_text(*parts: Column) -> Column:
    """Texts and documents' texts that are filled, in one."""
    return F.trim(F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: x != ""), " "))


def deadline_text(details: Column, other: Column) -> Column:
    """What is said on a deadline: a field of the application details, else a phrase of their raw text and notes, else one of ``other``; else empty."""
    fields = [F.when(truthy(field(details, f)), trimmed(spoken(field(details, f)))) for f in DEADLINE_FIELDS]
    notes = F.concat_ws("", F.transform(items(field(details, "selection_notes")), lambda n: F.concat(F.lit(" "), spoken(n))))
    raw = F.concat(F.coalesce(spoken(field(details, "raw_text")), F.lit("")), notes)
    phrase = lambda t: let(t, lambda x: F.when(contains_any(F.lower(x), DEADLINE_WORDS), blank_to_null(deadline_phrase(x))))
    return F.coalesce(*fields, F.when(kind_of(details) == "OBJECT", phrase(raw)), phrase(other), F.lit(""))


def pathway_open(text: Column, academic: Column) -> Column:
    """struct<available, evidence>: whether the text, or the summary of one of the document's pathways, names another way in; null where there is no text."""
    marker = F.get(F.filter(F.array(*map(F.lit, PATHWAYS)), lambda m: F.contains(F.lower(text), m)), F.lit(0))
    # one pattern with all markers would take the first in the text; the first in their order counts
    sentence = F.coalesce(*(F.when(marker == m, trimmed(sentence_around(text, m))) for m in PATHWAYS))
    summaries = F.transform(F.filter(items(field(academic, "pathways")), lambda p: kind_of(p) == "OBJECT"), lambda p: F.coalesce(spoken(field(p, "summary")), F.lit("")))
    found = F.get(F.filter(summaries, lambda s: contains_any(F.lower(s), PATHWAYS)), F.lit(0))
    available = F.when(marker.isNotNull() | found.isNotNull(), True).when(text != "", False)
    evidence = F.coalesce(sentence, F.when(found.isNotNull(), trimmed(found)), F.when(text != "", "No explicit pathway evidence found."), F.lit(""))
    return F.struct(available.alias("available"), evidence.alias("evidence"))


def sub_scores(details: Column) -> Column:
    """struct of the four parts from the sub-scores of the detail document; what is no number is null."""
    own = field(details, "ielts_subscores")
    number = lambda p: F.when(kind_of(own) == "OBJECT", F.coalesce(F.try_variant_get(own, f"$.{p}", "double"), F.try_variant_get(own, f"$.{p}", "string").try_cast("double")))
    return F.struct(*(F.when(kind_of(field(own, p)) == "BOOLEAN", F.try_variant_get(own, f"$.{p}", "boolean").cast("double")).otherwise(number(p)).alias(p) for p in PARTS))


def thresholds(stored: dict[str, Column], details: Column, parsed: Column) -> Column:
    """struct<overall, band, listening, ...>: stored values before those of the document before parsed ones; the band is the largest of all eleven.

    stored: overall, min_band and the parts; parsed: as text.parse_score_text gives it. A part without any value is the minimum band's.
    """

    def of(inner: Column) -> Column:
        scores, found = inner["scores"], inner["parsed"]
        overall = F.coalesce(stored["overall"], found["overall"])
        band = strictest_band(stored["min_band"], *(stored[p] for p in PARTS), *(scores[p] for p in PARTS), found["min_band"], *(found[p] for p in PARTS))
        parts = (F.coalesce(stored[p], scores[p], found[p], stored["min_band"], band).alias(p) for p in PARTS)
        return F.struct(overall.alias("overall"), band.alias("band"), *parts)

    return let(F.struct(sub_scores(details).alias("scores"), parsed.alias("parsed")), of)


def listing_texts(details: Column, application: Column, metadata: Column) -> dict[str, Column]:
    """Short texts of a listing: tests joined by " | ", documents and flags by ", "."""
    tests = F.filter(items(field(details, "language_tests")), lambda t: truthy(field(t, "test_name")))
    shown = F.transform(tests, lambda t: F.concat_ws(" ", spoken(field(t, "test_name")), F.when(truthy(field(t, "overall")), spoken(field(t, "overall")))))
    papers = F.transform(F.filter(items(field(application, "required_documents")), truthy), spoken)
    flags = [F.when(truthy(field(application, f)), label) for f, label in LISTING_FLAGS.items()] + [F.when(truthy(field(metadata, "rpl_detected")), "RPL / Credit")]
    return {"language_tests_display": F.array_join(shown, " | "), "required_documents_display": F.array_join(papers, ", "), "application_flags_display": F.array_join(F.array_compact(F.array(*flags)), ", ")}


def exploded(rows: DataFrame, value: str, outer: bool = False) -> DataFrame:
    """``rows`` beside pos, key and value of each entry of the VARIANT column ``value`` (objects by key, arrays by place); a scalar has none."""
    tvf = rows.sparkSession.tvf
    entries = (tvf.variant_explode_outer if outer else tvf.variant_explode)(F.col(value).outer())
    return rows.lateralJoin(entries.toDF("pos", "key", "entry"))


def test_rows(rows: DataFrame, key: str, details: str) -> DataFrame:
    """A row for each test of the detail document: key, place, test_name, overall, the four parts and source_type, empty where it says nothing."""
    tests = exploded(rows.select(key, field(F.col(details), "language_tests").alias("tests")), "tests").where(F.col("key").isNull()).where(kind_of(F.col("entry")) == "OBJECT")
    said = lambda v: F.coalesce(spoken(v), F.lit(""))
    entry, parts = F.col("entry"), F.when(kind_of(field(F.col("entry"), "component_scores")) == "OBJECT", field(F.col("entry"), "component_scores"))
    return tests.select(key, F.col("pos").alias("place"), *(said(field(entry, f)).alias(f) for f in ("test_name", "overall")), *(said(field(parts, p)).alias(p) for p in PARTS), said(field(entry, "source_type")).alias("source_type"))


def source_rows(rows: DataFrame, key: str, sources: str) -> DataFrame:
    """A row for each field of the source map: key, field and url."""
    entries = exploded(rows.select(key, F.col(sources).alias("sources")), "sources").where(kind_of(F.col("sources")) == "OBJECT")
    return entries.select(key, F.col("key").alias("field"), spoken(F.col("entry")).alias("url"))


def check_evidence(evidence: Column, text: Column, url: Column) -> Column:
    """Snippets of a check: the candidate's own, else the start of its text with its address; none without text."""
    kind = "array<struct<text:string,source_url:string,source:string>>"
    own = F.array(F.struct(trimmed(text).alias("text"), url.alias("source_url"), F.lit("eligibility").alias("source"))).cast(kind)
    return F.when(F.size(F.coalesce(evidence, F.array().cast(kind))) > 0, evidence).when(F.coalesce(text, F.lit("")) != "", own).otherwise(F.array().cast(kind))


def evidence_rows(checks: DataFrame, *key: str) -> DataFrame:
    """A row for each snippet of the checks that are not passed (status fail, warning or unknown): key, name, status, text, source_url and source.

    checks: key, name, status, evidence (as :func:`check_evidence` gives it), check_url and check_type, which stand in where a snippet has no
    address or kind. A check without snippets has one row if it has an address, else none.
    """
    kind = "array<struct<text:string,source_url:string,source:string>>"
    none = F.array(F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("source"))).cast(kind)
    shown = F.when(F.size(F.coalesce("evidence", F.array().cast(kind))) > 0, F.col("evidence")).when(F.col("check_url") != "", none)
    rows = checks.where(F.col("status").isin("fail", "warning", "unknown")).select(*key, "name", "status", "check_url", "check_type", F.explode(shown).alias("s"))
    either = lambda a, b: F.coalesce(blank_to_null(F.col(a)), F.col(b), F.lit(""))
    return rows.select(*key, "name", "status", F.coalesce("s.text", F.lit("")).alias("text"), either("s.source_url", "check_url").alias("source_url"), either("s.source", "check_type").alias("source"))
