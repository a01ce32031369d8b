"""Validation and content fingerprint of admission payloads (one row a course).

Columns: course_name, cricos, source_url, canonical_url, academic_requirement_text,
academic_pathways, raw_english_requirement, language_tests, application_details
(flags, required_documents, selection_notes, raw_text) and supplementary_metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from admitflow.functions.text import contains_any

#: Names of tests, kinds of sources, words that back a flag, and signals of an academic text.
TEST_NAMES = ("IELTS Academic", "TOEFL iBT", "PTE Academic", "LanguageCert Academic", "Cambridge C1 Advanced", "Cambridge C2 Proficiency")
SOURCE_TYPES = ("explicit_course_page", "derived_concordance", "global_standard_reference")
EVIDENCE = {
    "requires_portfolio": ("portfolio",), "requires_personal_statement": ("personal statement", "statement of intent"), "requires_supplementary_form": ("supplementary form",),
    "requires_cv_or_resume": ("cv", "resume"), "requires_references": ("reference", "referee"), "requires_work_experience": ("work experience",),
    "limited_places": ("limited places",), "quota_applies": ("quota applies",),
}
ACADEMIC_SIGNALS = (
    "bachelor", "qualification", "equivalent qualification", "honours", "master", "thesis", "experience", "admissions test", "average", "gpa", "degree", "graduate certificate", "graduate diploma",
    "undergraduate program", "cognate discipline", "related field", "law degree", "common law", "concurrently enrolled", "legal reasoning", "80%", "65 percent",
)
SIGNALS = ("qualification", "discipline", "grade_requirement", "work_experience", "admissions_test")
LEAST_TEXT = 12


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def payload_rules(domain: str) -> dict[str, Column]:
    """code -> what must hold, for ``maintain.check_rows``. ``domain``: the start of every address."""
    c = F.col
    low = F.lower(collapsed(c("academic_requirement_text")))
    details = c("application_details")
    raw = F.lower(F.coalesce(details["raw_text"], F.lit("")))
    backed = reduce(lambda a, b: a & b, (~F.coalesce(details[flag], F.lit(False)) | contains_any(raw, words) for flag, words in EVIDENCE.items()))
    long_enough = {f"short_{name}": F.length(collapsed(c(name))) >= LEAST_TEXT for name in ("course_name", "academic_requirement_text", "raw_english_requirement")}
    on_domain = {f"foreign_{name}": F.startswith(F.trim(F.coalesce(c(name), F.lit(""))), F.lit(domain)) for name in ("source_url", "canonical_url")}
    any_signal = lambda p: F.coalesce(*(F.nullif(p[s], F.lit("")) for s in SIGNALS)).isNotNull()
    return {
        "bad_code": F.upper(F.trim(c("cricos"))).rlike(r"^[0-9]{6}[\p{L}\p{N}]$"),
        **long_enough,
        **on_domain,
        "unknown_test": F.forall("language_tests", lambda t: t["test_name"].isin(*TEST_NAMES)),
        "unknown_source_type": F.forall("language_tests", lambda t: t["source_type"].isin(*SOURCE_TYPES)),
        "pathway_without_signal": F.forall("academic_pathways", any_signal),
        "flag_without_evidence": backed,
        "no_language_signal": (F.size("language_tests") > 0) | F.lower(c("raw_english_requirement")).contains("standard english"),
        "award_rules_only": ~(low.contains("requirements for award") & ~low.contains("admission")),
        "no_academic_signal": (F.size("academic_pathways") > 0) | contains_any(low, ACADEMIC_SIGNALS),
    }


FINGERPRINTED = ("academic_requirement_text", "application_details", "canonical_url", "language_tests", "raw_english_requirement", "supplementary_metadata")


def fingerprint(columns: tuple[str, ...] = FINGERPRINTED) -> Column:
    """sha-256 over the content that makes a new version: not over pathways, source map and notes."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)
