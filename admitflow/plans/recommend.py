"""Scores, bands, per-band plans and the whole recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from admitflow.functions.text import mapped, trimmed
from admitflow.operators.browse import range_contains, ranges_overlap
from admitflow.operators.retrieve import EVIDENCE, cosine_top, dedupe_evidence, keyword_evidence, keyword_top, match_reason, merge_hits
from admitflow.operators.rules import PARTS, STATUSES, applicant_facts, course_facts, decide, gate_checks, gate_effects, major_words, minimum_average, missing_fields, reasons, requirement_summary, short, strictest_band, summary, with_facts
from admitflow.session import cut

#: Weights, band limits and what a plan takes.
AVERAGE_WEIGHT, LANGUAGE_WEIGHT, REACH_BELOW, MATCH_TO, LEAST_RELEVANCE, PER_BAND = 0.7, 0.3, 0.95, 1.1, 0.05, 5
BANDS = ("REACH", "MATCH", "SAFETY")

#: Names of intakes in a request.
INTAKES = {
    "JAN": "JAN", "JANUARY": "JAN", "FEB": "FEB", "FEBRUARY": "FEB", "MAR": "MAR", "MARCH": "MAR", "JUL": "JUL", "JULY": "JUL", "AUG": "AUG", "AUGUST": "AUG", "OCT": "OCT", "OCTOBER": "OCT",
    "S1": "FEB", "SEM1": "FEB", "SEMESTER 1": "FEB", "S2": "JUL", "SEM2": "JUL", "SEMESTER 2": "JUL",
}

#: Directions in the order of their test, with keywords and what a semantic search asks for.
DIRECTIONS = (
    ("计算机", ("computer science", "information technology", "computing", "software engineering", "artificial intelligence", "data systems"), "computer science, IT, software engineering, AI and data systems"),
    ("computer", ("computer science", "information technology", "computing", "software engineering", "artificial intelligence"), "computer science, IT, software engineering and AI"),
    ("数据分析", ("data science", "data analytics", "business analytics", "analytics", "statistics", "data systems"), "data science, data analytics, business analytics and statistics"),
    ("data", ("data science", "data analytics", "business analytics", "analytics", "statistics"), "data science, analytics and statistics"),
    ("商科", ("commerce", "business", "management", "finance", "accounting", "marketing"), "commerce, business, management, finance, accounting and marketing"),
    ("business", ("commerce", "business", "management", "finance", "accounting", "marketing"), "commerce, business, management, finance, accounting and marketing"),
)


def split_list(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,\n]"), lambda t: F.trim(t)), lambda t: t != "")
    start = F.array().cast("array<string>")
    return F.aggregate(parts, start, lambda acc, x: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def wanted_intakes(text: Column) -> Column:
    """Months of a request; what has no alias stays in upper case."""
    names = F.transform(split_list(text), lambda t: F.upper(t))
    return F.array_distinct(F.transform(names, lambda t: F.coalesce(mapped(INTAKES, t), t)))


def on_hundred(gpa: Column, scale: Column) -> Column:
    return F.bround(gpa / scale * 100, 4)


def request_errors() -> Column:
    """Codes of what is wrong with a request: target, gpa, overall, budget_min/max, want_min/max."""
    bad = {
        "missing_target": F.trim(F.coalesce(F.col("target"), F.lit(""))) == "",
        "bad_gpa": ~F.coalesce(F.col("gpa") > 0, F.lit(False)),
        "bad_ielts": ~F.coalesce((F.col("overall") > 0) & (F.col("overall") <= 9), F.col("overall").isNull()),
        "bad_budget": F.coalesce(F.col("budget_max") < F.col("budget_min"), F.lit(False)),
        "bad_duration": F.coalesce(F.col("want_max") < F.col("want_min"), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(c, code) for code, c in bad.items())))


def expand(target: Column) -> Column:
    """struct<keywords, semantic_query>: of the first direction that the target contains, else the target itself."""
    clean = F.trim(F.regexp_replace(F.coalesce(target, F.lit("")), r"\s+", " "))
    made = lambda words, ask: F.struct(words.alias("keywords"), F.concat(F.lit("Master programs related to "), ask).alias("semantic_query"))
    out = made(F.array(clean), clean)
    for name, words, ask in reversed(DIRECTIONS):
        out = F.when(F.contains(F.lower(clean), F.lit(name)), made(F.array(*map(F.lit, words)), F.lit(ask))).otherwise(out)
    return out


def score_parts(gpa: Column, gpa_min: Column, overall: Column, need: Column) -> Column:
    """struct<average, language, score>; null where an input is missing or a threshold is not above 0."""
    average, language = F.try_divide(gpa, F.nullif(gpa_min, F.lit(0.0))), F.try_divide(overall, F.nullif(need, F.lit(0.0)))
    return F.struct(average.alias("average"), language.alias("language"), (AVERAGE_WEIGHT * average + LANGUAGE_WEIGHT * language).alias("score"))


def told_score(score: Column) -> Column:
    """To four places, ties of the scaled double to even (as the SQL's round_even); Spark's bround rounds the shortest decimal text instead, which may be a tie where the double isn't."""
    return F.rint(score * 10_000) / 10_000


def band_of(score: Column) -> Column:
    return F.when(score < REACH_BELOW, "REACH").when(score <= MATCH_TO, "MATCH").when(score.isNotNull(), "SAFETY")


def reason_tags() -> Column:
    met = lambda have, need, name: F.when(F.col(have).isNull() | F.col(need).isNull(), f"{name}_missing").when(F.col(have) >= F.col(need), f"{name}_met").otherwise(f"{name}_below")
    return F.array(met("gpa", "gpa_min", "gpa"), met("overall", "need_overall", "ielts"), met("min_band", "need_band", "band"))


def plan_exclusion() -> Column:
    """Why a scored candidate is out of the plan, in order, or null."""
    c = F.col
    return (
        F.when(c("relevance") < LEAST_RELEVANCE, "low_relevance")
        .when(c("min_band") < c("need_band"), "ielts_band_below_requirement")
        .when(~ranges_overlap(c("want_min"), c("want_max"), c("duration_min"), c("duration_max")), "duration_outside_preference")
        .when(~range_contains(c("budget_min"), c("budget_max"), c("fee")), "tuition_outside_budget")
    )


def plan_order() -> list[Column]:
    """Keys of a plan's order: closeness to what the band aims at, relevance, language margin, then whether budget, duration and intake fit."""
    c = F.col
    aim = F.when(c("band") == "REACH", REACH_BELOW).when(c("band") == "MATCH", (REACH_BELOW + MATCH_TO) / 2).otherwise(MATCH_TO)
    wish = F.coalesce(F.size("want_intakes"), F.lit(0))
    intake = (wish <= 0) | F.coalesce(F.arrays_overlap("want_intakes", "intakes"), F.lit(False))
    fits = [range_contains(c("budget_min"), c("budget_max"), c("fee")), ranges_overlap(c("want_min"), c("want_max"), c("duration_min"), c("duration_max")), intake]
    return [F.round(F.abs(c("score") - aim), 12), F.desc("relevance"), F.desc_nulls_last(c("overall") - c("need_overall")), *(F.desc(f.cast("int")) for f in fits)]


def plan(scored: DataFrame, applicant: str, course: str, n: int = PER_BAND) -> DataFrame:
    """The first ``n`` of each applicant's band in :func:`plan_order`, then by id."""
    rank = F.row_number().over(Window.partitionBy(applicant, "band").orderBy(*plan_order(), F.col(course)))
    return scored.where("exclusion is null and band is not null").withColumn("rank", rank).where(F.col("rank") <= n)


FIELDS = {"course_name": "course_name", "course_name_raw": "course_name_raw", "cricos": "cricos", "academic_requirement_text": "academic_text", "raw_english_requirement": "english_text"}
#: Fields that a keyword hit shows snippets of.
SHOWN = ("course_name", "academic_requirement_text", "raw_english_requirement")
#: Hits of all queries that are broadcast to the applicants at most; more are joined by shuffling.
MAX_BROADCAST_ROWS = 100_000
#: Course columns that a pair is judged by; texts stay behind.
JUDGED = ("course_id", "course_name", "fee", "intakes", "degree", "faculty", "school", "campus", "study_mode", "duration_min", "duration_max", "need_overall", "need_band", *PARTS)


def candidates(applicants: DataFrame, courses: DataFrame, k: int = 30, vectors: DataFrame | None = None, queries: DataFrame | None = None, n: int = 50) -> DataFrame:
    """Applicants with their courses: each distinct query is retrieved once, and joined back by its text.

    Only ids, names and scores are ranked; the facts on texts (of courses and of
    applicants) are worked out before the two meet, and the pairs hold no texts but short ones.
    vectors (vec_id, embedding, and where the vectors are of chunks course_id, content, kind and source_url; without course_id the vec_id is the
    course's) and queries (spec_id, query_id, embedding, perhaps semantic_query) add the vector arm: its hits are merged
    with the keyword hits, ``n`` a query, with the reasons and snippets of both.
    """
    asked = with_facts(applicants, applicant_facts()).withColumn("spec_id", F.array_join("keywords", "|"))
    specs = asked.groupBy("spec_id").agg(F.first("keywords").alias("spec_words"))
    hits = keyword_top(courses, specs.withColumnRenamed("spec_words", "keywords"), FIELDS, "course_name", "course_id", k).join(specs, "spec_id")
    reason = match_reason(F.col("hit_fields"), F.col("spec_words"))
    none = F.array().cast(EVIDENCE)
    if vectors is None:
        found = hits.select("spec_id", "course_id", F.col("keyword_score").alias("relevance"), reason.alias("reason"), F.lit(True).alias("by_keyword"), none.alias("evidence"), F.lit(True).alias("degraded"))
    else:
        own = {"course_id": F.col("vec_id"), "content": F.lit(None).cast("string"), "kind": F.lit("chunk"), "source_url": F.lit(None).cast("string")}
        chunks = vectors.select("vec_id", *((F.col(c) if c in vectors.columns else v).alias(c) for c, v in own.items()))
        words = queries.select("query_id", "spec_id", *(["semantic_query"] if "semantic_query" in queries.columns else [])).join(specs, "spec_id")
        meant = F.col("semantic_query") if "semantic_query" in queries.columns else F.array_join("spec_words", ", ")
        near = cosine_top(vectors.select("vec_id", "embedding"), queries.select("query_id", "embedding"), k).join(words, "query_id").join(chunks, "vec_id")
        near = near.join(courses.select("course_id"), "course_id", "left_semi")
        shown = F.filter(F.array(F.struct(trimmed(F.coalesce("content", F.lit(""))).alias("text"), F.col("source_url"), F.col("kind").alias("source"))).cast(EVIDENCE), lambda e: e["text"] != "")
        near = near.select("spec_id", "course_id", F.col("similarity").alias("vector_score"), F.col("rank").alias("place"), F.concat(F.lit("Semantic admissions chunk matched query: "), meant).alias("reason"), shown.alias("evidence"))
        known = hits.select("spec_id", "course_id", "keyword_score", "place", reason.alias("reason"), none.alias("evidence"))
        merged = merge_hits(known, near, ["spec_id", "course_id"], n)
        found = merged.select("spec_id", "course_id", F.col("combined_score").alias("relevance"), "reason", (F.col("keyword_score") > 0).alias("by_keyword"), "evidence", "degraded")
    found = cut(found)  # a bounded number of rows a query; the search behind it is the dear part and is used twice below
    few = F.broadcast if specs.count() * max(k, n) <= MAX_BROADCAST_ROWS else lambda x: x
    wanted = courses.join(few(found.select("course_id").distinct()), "course_id", "left_semi")  # texts are searched for facts only where a query has found them
    known = with_facts(wanted, course_facts(wanted.columns)).select(*JUDGED, *course_facts(), "academic_text", "english_text")
    rows = known.join(few(found), "course_id").join(specs, "spec_id").withColumnRenamed("spec_words", "keywords")
    own = F.when(F.col("by_keyword"), keyword_evidence(F.col("keywords"), {k: FIELDS[k] for k in SHOWN})).otherwise(none)
    rows = rows.withColumns({"major_words": major_words(), "evidence": dedupe_evidence(F.concat(own, "evidence"))}).drop("keywords", "academic_text", "english_text", "by_keyword")
    # every applicant becomes k pairs: dealt by applicant first, the pairs are judged and ranked where they arise, without a shuffle of their own
    dealt = asked.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "applicant_id")
    return dealt.join(few(rows), "spec_id").drop("spec_id")


def judged(pairs: DataFrame, tell: bool = True) -> DataFrame:
    """Pairs with thresholds, status, score, band and exclusion, and with ``tell`` the checks with their values and reasons."""
    if "has_text" not in pairs.columns:  # pairs made elsewhere, with their texts
        pairs = with_facts(pairs, course_facts(pairs.columns) | applicant_facts() | {"major_words": major_words()})
    out = pairs.withColumns({"gpa_min": minimum_average(F.col("category"), F.col("business_core")), "need_band": strictest_band(F.col("need_band"), *map(F.col, PARTS))})
    parts = score_parts(F.col("gpa"), F.col("gpa_min"), F.col("overall"), F.col("need_overall"))
    out = out.withColumns({"effects": gate_effects(), "parts": parts} | ({"checks": gate_checks()} if tell else {}))
    score = F.col("parts.score")
    exclusion = F.when(score.isNull(), "scoring_failed").otherwise(plan_exclusion())
    return out.withColumns({"status": decide(F.col("effects")), "score": score, "band": band_of(score), "exclusion": exclusion})


def decisions(decided: DataFrame) -> DataFrame:
    """One row a pair: status, stage, reasons, warnings, missing fields and a summary."""
    checks = F.col("checks")
    stage = F.when(F.col("status") == "INELIGIBLE", "gate").when(F.col("status") != "ELIGIBLE", "risk").when(F.col("exclusion").isNotNull(), "plan").otherwise("candidate")
    return decided.select(
        "applicant_id", "course_id", "status", stage.alias("stage"), "exclusion", reasons(checks, "B").alias("blocking_reasons"), reasons(checks, "W", "P").alias("warnings"),
        missing_fields(checks).alias("missing_fields"), summary(F.col("status"), checks).alias("summary"), "checks", "evidence_text",
    )


def program_rows(planned: DataFrame) -> DataFrame:
    """The plan as it is given out: texts, score to four places, and evidence (the requirement's summary where there is none)."""
    c = F.col
    years = F.when(c("duration_min") == c("duration_max"), F.concat(short(c("duration_min")), F.lit(" years"))).otherwise(F.concat(short(c("duration_min")), F.lit("-"), short(c("duration_max")), F.lit(" years")))
    needs = F.concat(F.lit("IELTS "), short(c("need_overall")), F.lit(" overall, minimum band "), short(c("need_band")))
    told = requirement_summary(c("evidence_text"), c("gpa_min"), c("need_overall"), c("need_band"))
    own = F.array(F.struct(told.alias("text"), F.lit(None).cast("string").alias("source_url"), F.lit("requirement_summary").alias("source")))
    evidence = F.when(F.size("evidence") > 0, c("evidence")).otherwise(own)
    why = F.concat(
        F.lit("GPA: user "), short(c("gpa")), F.lit(" vs required "), short(c("gpa_min")), F.lit(". IELTS: user "), short(c("overall")), F.lit("/"), short(c("min_band")), F.lit(" vs required "),
        short(c("need_overall")), F.lit("/"), short(c("need_band")), F.lit(". Relevance: "), c("reason"), F.lit(". Evidence: "), F.get(evidence, F.lit(0))["text"], F.lit("."),
    )
    return planned.select(
        "applicant_id", "course_id", "course_name", "band", "rank", F.coalesce(years, F.lit("")).alias("duration"), "intakes", "fee", needs.alias("ielts_requirement"), told.alias("academic_summary"),
        told_score(F.col("score")).alias("score"), why.alias("recommendation_reason"), evidence.alias("evidence"),
    )


def recommend(applicants: DataFrame, courses: DataFrame, n: int = PER_BAND, k: int = 30, vectors: DataFrame | None = None, queries: DataFrame | None = None, tell: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(plan of the eligible, all decisions with stage and reasons, if asked to tell them)."""
    pairs = candidates(applicants, courses, k, vectors, queries)
    return plan(judged(pairs, tell=False).where("status = 'ELIGIBLE'"), "applicant_id", "course_id", n), decisions(judged(pairs)) if tell else None


def observed_counts() -> list[Column]:
    """What a run tells of its pairs: how many, how many planned, of each status and each band."""
    c = F.col
    of = lambda name, values: [F.count_if(F.coalesce(c(name) == v, F.lit(False))).alias(v.lower()) for v in values]
    planned = F.count_if(F.coalesce((c("status") == "ELIGIBLE") & c("exclusion").isNull(), F.lit(False)))
    return [F.count("*").alias("candidates"), planned.alias("planned"), *of("status", STATUSES), *of("band", BANDS)]


def recommend_to(folder: str, applicants: DataFrame, courses: DataFrame, n: int = PER_BAND, k: int = 30, vectors: DataFrame | None = None, queries: DataFrame | None = None) -> dict[str, int]:
    """The plan and all decisions as Parquet under ``folder``, from pairs that are judged once, and the run's counts.

    The counts are observed while the judged pairs are written, and the plan's rows while the plan is: no job of their own.
    Written tables are read again, so a lost executor costs no judgement twice. Without a pair, all counts are 0.
    """
    spark = applicants.sparkSession
    pairs, rows = Observation(), Observation()
    judged(candidates(applicants, courses, k, vectors, queries)).observe(pairs, *observed_counts()).write.parquet(f"{folder}/judged")
    known = spark.read.parquet(f"{folder}/judged")
    plan(known.where("status = 'ELIGIBLE'"), "applicant_id", "course_id", n).observe(rows, F.count("*").alias("plan_rows")).write.parquet(f"{folder}/plan")
    decisions(known).write.parquet(f"{folder}/decisions")
    return pairs.get | rows.get
