"""Requirement normalisation, the explainable gate and the decision.

Each check is ``struct<name, status, effect, user_value, required_value, reason, missing>``: the status
is shown, the effect decides (``B`` blocking, ``P`` pathway required, ``U`` unknown, ``W`` warning, ``-`` none).

Texts are searched once a course (:func:`course_facts`) and once an applicant
(:func:`applicant_facts`), before the two meet; a pair compares short facts only.

applicant: target, gpa, overall, min_band, listening, reading, speaking, writing (user_*),
background, keywords, subjects_text, want_intakes, budget_min/max, want_min/max
(years), want_degree, want_faculty, want_school, want_campus, want_mode (the last two comma-separated), accepts_pathway.
candidate: course_name, academic_text, english_text, reason, gpa_min, need_overall, need_band, listening,
reading, speaking, writing, intakes, fee, duration_min/max, degree, faculty, school, campus, study_mode.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions.text import blank_to_null, contains_any, sentence_around, trimmed
from admitflow.operators.browse import range_contains, ranges_overlap

#: Markers of prerequisites, aliases of subjects, markers of pathways, course groups.
PREREQUISITES = (
    "prerequisite", "pre-requisite", "assumed knowledge", "background in", "prior study in", "bachelor in relevant discipline", "bachelor's degree in a relevant discipline",
    "bachelor degree in a relevant discipline", "bachelor's degree in a related discipline", "bachelor degree in a related discipline", "relevant discipline", "cognate discipline",
    "related discipline", "mathematics", "statistics", "computer science", "programming", "economics",
)
SUBJECTS = {
    "mathematics": ("mathematics", "math", "maths", "calculus", "linear algebra", "数学", "高数", "微积分"),
    "statistics": ("statistics", "statistical", "stats", "probability", "统计", "概率"),
    "computer science": ("computer science", "computing", "software", "information technology", "programming", "data science", "计算机", "软件", "编程", "信息技术"),
    "programming": ("programming", "python", "java", "c++", "software", "编程", "程序"),
    "economics": ("economics", "economic", "econometrics", "finance", "business", "经济", "金融", "计量"),
}
PATHWAYS = ("pathway", "graduate certificate", "graduate diploma", "pre-master", "premaster", "qualifying program", "bridging", "alternative entry")
BUSINESS_CORE = ("master of commerce", "professional accounting", "professional accounting and business performance")
BUSINESS_MARKS = {"c9": 65.0, "tier1": 65.0, "985": 75.0, "211": 75.0, "non_211": 87.0}
PARTS = ("listening", "reading", "speaking", "writing")


def background_category(background: Column) -> Column:
    """The first marker in order decides; none is a background outside of 211."""
    low = F.lower(F.coalesce(background, F.lit("")))
    return (
        F.when(contains_any(low, ("双非", "非211", "non-211", "non 211", "double non")), "non_211")
        .when(low.contains("c9"), "c9")
        .when(contains_any(low, ("tier1", "tier 1", "tier-1")), "tier1")
        .when(low.contains("985"), "985")
        .when(low.contains("211"), "211")
        .otherwise("non_211")
    )


def minimum_average(category: Column, business_core: Column) -> Column:
    """By background category, and whether the course is of the business core."""
    business = F.lit(None).cast("double")
    for name, mark in BUSINESS_MARKS.items():
        business = F.when(category == name, F.lit(mark)).otherwise(business)
    others = F.when(category == "non_211", 80.0).otherwise(75.0)
    return F.when(business_core, business).otherwise(others)


def strictest_band(*bands: Column) -> Column:
    """The largest of the bands that are there."""
    return F.greatest(*bands)


def requirement_summary(text: Column, gpa_min: Column, overall: Column, band: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    short = F.when(F.length(clean) > 220, F.concat(F.rtrim(F.substring(clean, 1, 219)), F.lit("..."))).otherwise(clean)
    language = F.when(overall.isNull() | band.isNull(), "IELTS requirement unavailable in structured or parseable evidence.").otherwise(
        F.concat(F.lit("IELTS "), overall.cast("string"), F.lit(" overall, minimum band "), band.cast("string"), F.lit("."))
    )
    return F.trim(F.concat_ws(" ", short, F.concat(F.lit("Minimum average "), gpa_min.cast("int").cast("string"), F.lit("%.")), language))


#: How a text names a deadline.
DEADLINES = (r"[^.]{0,80}(?:deadline|closing date|applications close|apply by)[^.]{0,100}", r"[^.]{0,80}(?:rolling basis)[^.]{0,80}")


DEADLINE_WORDS = ("deadline", "closing date", "applications close", "apply by", "rolling basis")


def deadline_text(text: Column) -> Column:
    """The first phrase on a deadline; empty without one."""
    return F.when(~contains_any(F.lower(text), DEADLINE_WORDS), "").otherwise(deadline_phrase(text))


def deadline_phrase(text: Column) -> Column:
    return F.coalesce(*(blank_to_null(trimmed(F.regexp_extract(text, f"(?i){p}", 0))) for p in DEADLINES), F.lit(""))


def pathway_available(text: Column) -> Column:
    """True, False, or null where there is no text."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", contains_any(F.lower(text), PATHWAYS))


def pathway_evidence(text: Column) -> Column:
    """The sentence of the first marker in order; empty without one."""
    out = F.lit("")
    for marker in reversed(PATHWAYS):
        out = F.when(F.lower(text).contains(marker), trimmed(sentence_around(text, marker))).otherwise(out)
    return out


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def course_facts(columns: Sequence[str] = ()) -> dict[str, Column]:
    """What the checks ask of a course's texts, and of its documents (JSON texts) where ``columns`` has them: academic_requirements_json and application_details_json."""
    from admitflow.operators import documents as D

    academic, details = (D.document(F.col(c)) if c in columns else None for c in ("academic_requirements_json", "application_details_json"))
    text = filled(F.col("academic_text"))
    if academic is not None:
        text = D.academic_text(text, D.json_text(academic))
    low = F.lower(text)
    spoken = F.concat_ws(" ", F.col("course_name"), text, F.col("english_text"))
    way = D.pathway_open(text, academic) if academic is not None else F.struct(pathway_available(text).alias("available"), pathway_evidence(text).alias("evidence"))
    return {
        "has_text": F.trim(text) != "",
        "asks_prerequisites": contains_any(low, PREREQUISITES),
        "named_subjects": F.filter(F.array(*map(F.lit, SUBJECTS)), lambda s: F.contains(low, s)),
        "pathway_open": way["available"],
        "pathway_sentence": way["evidence"],
        "deadline_found": deadline_text(spoken) if details is None else D.deadline_text(details, spoken),
        "business_core": contains_any(F.lower(F.col("course_name")), BUSINESS_CORE),
        "evidence_text": trimmed(F.coalesce(blank_to_null(text), filled(F.col("english_text")))),
    }


def applicant_facts() -> dict[str, Column]:
    """What the checks ask of an applicant's texts."""
    own = F.lower(filled(F.col("subjects_text")))
    return {
        "category": background_category(F.col("background")),
        "has_subjects": F.trim(own) != "",
        "own_subjects": F.array_compact(F.array(*(F.when(contains_any(own, aliases), s) for s, aliases in SUBJECTS.items()))),
        "by_direction": F.exists("keywords", lambda k: F.contains(own, F.lower(k))),
    }


def major_words(include_reason: bool = True) -> Column:
    """The keywords found in a candidate's texts; with the retrieval reason, which lists them, every keyword hit passes."""
    text = F.lower(F.concat_ws(" ", "course_name", "academic_text", "english_text", *(["reason"] if include_reason else [])))
    return F.filter("keywords", lambda k: F.contains(text, F.lower(k)))


def with_facts(rows: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """``rows`` with those of ``facts`` that they lack."""
    return rows.withColumns({k: v for k, v in facts.items() if k not in rows.columns})


CHECK = "struct<name:string,status:string,effect:string,user_value:string,required_value:string,reason:string,missing:string>"


@dataclass(frozen=True)
class Check:
    """A check by its cases, of which the first that holds counts: (condition, status, effect, missing field, reason as text or column). The last has the condition None; a null condition doesn't hold."""

    name: str
    user: Column
    required: Column
    cases: tuple

    def _first(self, made: Callable[..., Column]) -> Column:
        return reduce(lambda out, c: F.when(c[0], made(*c[1:])).otherwise(out), reversed(self.cases[:-1]), made(*self.cases[-1][1:]))

    def effect(self) -> Column:
        return self._first(lambda status, effect, missing, reason: F.lit(effect))

    def told(self) -> Column:
        def made(status: str, effect: str, missing: str | None, reason: str | Column) -> Column:
            text = F.lit(reason) if isinstance(reason, str) else reason
            return F.struct(
                F.lit(self.name).alias("name"), F.lit(status).alias("status"), F.lit(effect).alias("effect"), self.user.cast("string").alias("user_value"),
                self.required.cast("string").alias("required_value"), text.alias("reason"), F.lit(missing).cast("string").alias("missing"),
            ).cast(CHECK)

        return self._first(made)


def check(name: str, user: Column, required: Column, *cases: tuple) -> Check:
    return Check(name, user, required, cases)


def short(number: Column) -> Column:
    """7.0 as 7, 6.5 as 6.5."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def number_range(low: Column, high: Column, unit: str = "") -> Column:
    text = F.when(low == high, short(low)).when(low.isNull(), F.concat(F.lit("<= "), short(high))).when(high.isNull(), F.concat(F.lit(">= "), short(low))).otherwise(F.concat(short(low), F.lit("-"), short(high)))
    return F.when(low.isNull() & high.isNull(), "").otherwise(F.concat(text, F.lit(unit)))


def preference(name: str, wanted: str, value: str) -> Check:
    """A wish is met if the value contains one of its comma-separated parts."""
    wishes = F.filter(F.transform(F.split(F.lower(filled(F.col(wanted))), ","), lambda w: F.trim(w)), lambda w: w != "")
    have = F.lower(filled(F.col(value)))
    label = name.replace("_", " ")
    return check(
        name, F.col(wanted), F.col(value),
        ((F.size(wishes) == 0) & (have == ""), "unknown", "-", name, f"The {label} is not in the course data."), (F.size(wishes) == 0, "pass", "-", None, f"No {label} was asked for."),
        (have == "", "unknown", "U", name, f"A {label} was asked for, but the course data has none."), (F.exists(wishes, lambda w: F.contains(have, w)), "pass", "-", None, f"The {label} is as asked for."),
        (None, "fail", "B", None, f"The {label} is not as asked for."),
    )


def language_failures() -> Column:
    """The overall score and the parts that miss their requirement, as text; a part without its own score counts with the minimum band."""

    def failed(label: str, have: Column, need: Column) -> Column:
        return F.when(have < need, F.concat(F.lit(f"{label} "), short(have), F.lit(" < "), short(need)))

    c = F.col
    parts = (failed(p, F.coalesce(c(f"user_{p}"), c("min_band")), F.coalesce(c(p), c("need_band"))) for p in PARTS)
    return F.array_compact(F.array(failed("overall", c("overall"), c("need_overall")), *parts))


def gate() -> tuple[Check, ...]:
    """The 14 checks in their fixed order; rows need :func:`course_facts`, :func:`applicant_facts` and ``major_words``."""
    c, none = F.col, F.lit(None).cast("string")
    listed = lambda a: F.array_join(F.coalesce(a, F.array().cast("array<string>")), ", ")
    empty = lambda a: F.size(F.coalesce(c(a), F.array().cast("array<string>"))) == 0
    no_budget, no_years, no_duration = (c(f"{x}_min").isNull() & c(f"{x}_max").isNull() for x in ("budget", "want", "duration"))
    way, accepts, unmatched = c("pathway_open"), c("accepts_pathway"), F.array_except("named_subjects", "own_subjects")
    failures = language_failures()
    bands = lambda overall, band: F.concat(short(c(overall)), F.lit(" overall, "), short(c(band)), F.lit(" in each part"))
    return (
        check(
            "major_area", c("target"), c("course_name"),
            (F.size("major_words") > 0, "pass", "-", None, F.concat(F.lit("The direction is found by: "), listed(c("major_words")), F.lit("."))),
            (filled(c("reason")) != "", "warning", "W", None, "Found by a broad search, but the direction is not in the course's own text."), (None, "unknown", "U", "major_area", "The direction can't be confirmed."),
        ),
        preference("degree_type", "want_degree", "degree"),
        preference("faculty", "want_faculty", "faculty"),
        preference("school", "want_school", "school"),
        check(
            "average", short(c("gpa")), short(c("gpa_min")),
            (c("gpa_min").isNull(), "unknown", "U", "gpa_requirement", "The required average is not known."), (c("gpa").isNull(), "unknown", "U", "user_gpa", "The GPA was not given."),
            (c("gpa") >= c("gpa_min"), "pass", "-", None, "The GPA meets the threshold."),
            (accepts & way, "warning", "P", None, F.concat(F.lit("The GPA is below direct entry, but there is a pathway: "), c("pathway_sentence"))),
            (accepts & way.isNull(), "unknown", "U", "pathway_availability", "The GPA is below direct entry, and a pathway can't be confirmed."), (None, "fail", "B", None, "The GPA is below the threshold."),
        ),
        check(
            "language", bands("overall", "min_band"), bands("need_overall", "need_band"),
            (c("need_overall").isNull() | c("need_band").isNull(), "unknown", "U", "ielts_requirement", "The IELTS requirement is not known."),
            (c("overall").isNull() | c("min_band").isNull(), "unknown", "U", "user_ielts", "The IELTS scores were not given."),
            (F.size(failures) > 0, "fail", "B", None, F.concat(F.lit("IELTS is below: "), F.array_join(failures, "; "), F.lit("."))), (None, "pass", "-", None, "IELTS meets the requirement in all parts."),
        ),
        check(
            "prerequisites", c("subjects_text"), listed(c("named_subjects")),
            (~c("has_text"), "unknown", "U", "academic_requirement_text", "There is no academic text to judge prerequisites by."), (~c("asks_prerequisites"), "pass", "-", None, "The text names no prerequisite."),
            (~c("has_subjects"), "unknown", "U", "prior_major_or_courses", "A prerequisite is named, but no earlier major or course was given."),
            ((F.size("named_subjects") == 0) & c("by_direction"), "pass", "-", None, "Earlier studies fit the relevant discipline."),
            (F.size("named_subjects") == 0, "warning", "W", None, "A relevant discipline is asked for as a prerequisite and can't be matched with certainty."),
            (F.size(unmatched) > 0, "warning", "W", None, F.concat(F.lit("The prerequisite can't be confirmed for: "), listed(unmatched), F.lit("."))), (None, "pass", "-", None, "Earlier studies cover the prerequisite subjects."),
        ),
        check(
            "intake", listed(c("want_intakes")), listed(c("intakes")),
            (empty("want_intakes") & empty("intakes"), "unknown", "-", "intakes", "The intakes are not in the course data."), (empty("want_intakes"), "pass", "-", None, "No intake was asked for."),
            (empty("intakes"), "unknown", "U", "intakes", "An intake was asked for, but the course data has none."),
            (F.arrays_overlap("want_intakes", "intakes"), "pass", "-", None, F.concat(F.lit("The intake matches: "), listed(F.array_intersect("want_intakes", "intakes")), F.lit("."))), (None, "fail", "B", None, "The intake does not match."),
        ),
        check("deadline", none, c("deadline_found"), (c("deadline_found") != "", "warning", "-", None, "A deadline is named; dates are not compared."), (None, "unknown", "-", "application_deadline", "No deadline was found.")),
        check(
            "tuition", number_range(c("budget_min"), c("budget_max")), short(c("fee")),
            (no_budget & c("fee").isNull(), "unknown", "-", "tuition_fee_aud", "The fee is not in the course data."), (no_budget, "pass", "-", None, "No budget was given."),
            (c("fee").isNull(), "unknown", "U", "tuition_fee_aud", "A budget was given, but the course data has no fee."),
            (range_contains(c("budget_min"), c("budget_max"), c("fee")), "pass", "-", None, "The fee is within the budget."), (None, "warning", "W", None, "The fee is outside the budget."),
        ),
        check(
            "duration", number_range(c("want_min"), c("want_max"), " years"), number_range(c("duration_min"), c("duration_max"), " years"),
            (no_years & no_duration, "unknown", "-", "duration", "The duration is not in the course data."), (no_years, "pass", "-", None, "No duration was asked for."),
            (no_duration, "unknown", "U", "duration", "A duration was asked for, but the course data has none."),
            (ranges_overlap(c("want_min"), c("want_max"), c("duration_min"), c("duration_max")), "pass", "-", None, "The duration is as asked for."), (None, "fail", "B", None, "The duration is not as asked for."),
        ),
        preference("campus", "want_campus", "campus"),
        preference("study_mode", "want_mode", "study_mode"),
        check(
            "pathway", accepts, c("pathway_sentence"),
            (way.isNull(), "unknown", "-", "pathway_availability", "A pathway can't be confirmed."), (way & ~accepts, "warning", "-", None, "There is a pathway, which the applicant does not accept."),
            (way, "pass", "-", None, "There is a pathway, which the applicant accepts."), (None, "pass", "-", None, "The text names no pathway."),
        ),
    )


def gate_checks() -> Column:
    """array of the checks with their values and reasons."""
    return F.array(*(c.told() for c in gate()))


def gate_effects() -> Column:
    """The effects alone, in the same order: all that a decision needs."""
    return F.array(*(c.effect() for c in gate()))


#: What :func:`decide` gives.
STATUSES = ("ELIGIBLE", "HIGH_RISK", "UNKNOWN", "PATHWAY_REQUIRED", "INELIGIBLE")


def decide(effects: Column) -> Column:
    """The effects decide in this order: blocking, pathway, unknown, warning."""
    has = lambda e: F.array_contains(effects, e)
    return F.when(has("B"), "INELIGIBLE").when(has("P"), "PATHWAY_REQUIRED").when(has("U"), "UNKNOWN").when(has("W"), "HIGH_RISK").otherwise("ELIGIBLE")


def reasons(checks: Column, *effects: str) -> Column:
    """The reasons of the checks with one of ``effects``, in order."""
    return F.transform(F.filter(checks, lambda c: c["effect"].isin(*effects)), lambda c: c["reason"])


def missing_fields(checks: Column) -> Column:
    return F.array_compact(F.transform(checks, lambda c: c["missing"]))


def summary(status: Column, checks: Column) -> Column:
    """One line on a decision."""
    said = lambda *effects: F.array_join(reasons(checks, *effects), " ")
    return (
        F.when(status == "ELIGIBLE", "Meets the checked requirements.")
        .when(status == "INELIGIBLE", F.concat(F.lit("Does not meet requirements: "), said("B")))
        .when(status == "PATHWAY_REQUIRED", "Direct entry is not met; a pathway comes first.")
        .when(status == "UNKNOWN", F.concat(F.lit("Too little is known; to be reviewed: "), said("U")))
        .otherwise(F.concat(F.lit("High risk; to be reviewed: "), said("W", "P")))
    )


def checklist(decided: DataFrame, *key: str) -> DataFrame:
    """The checks as rows: key, place (from 1) and the fields of a check, with the course's evidence."""
    rows = decided.select(*key, "evidence_text", F.posexplode("checks").alias("place", "c"))
    return rows.select(*key, (F.col("place") + 1).alias("place"), "c.*", "evidence_text")
