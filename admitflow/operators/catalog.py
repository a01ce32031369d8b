"""Reading the catalogue: snapshots, listings, records to index, seeds to crawl, and nested columns as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions.text import collapse, degree_type, parse_duration, parse_intakes, parse_score_text

PARTS = ("listening", "reading", "speaking", "writing")


def snapshot(parents: DataFrame, versions: DataFrame, on: Column, current: Column, order: Sequence[str | Column] = ()) -> DataFrame:
    """All parents with their current version, null without one: the test of ``current`` belongs to the join, not behind it."""
    rows = parents.join(versions, on & current, "left")
    return rows.orderBy(*order) if order else rows


def listing(children: DataFrame, parents: DataFrame, on: Column, columns: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Children with columns of their parent, in order; children without a parent drop out."""
    return children.join(parents, on).select(*columns).orderBy(*order)


def index_records(records: DataFrame, texts: Sequence[str], source: tuple[str, str] | None = None, order: Sequence[str | Column] = (), limit: int | None = None) -> DataFrame:
    """Records with any text that isn't blank, of one source (column, value) if asked for, in order, the first ``limit``."""
    some = F.lit(False)
    for t in texts:
        some = some | (collapse(F.col(t)) != "")
    rows = records.where(some) if source is None else records.where(some & (F.col(source[0]) == source[1]))
    rows = rows.orderBy(*order) if order else rows
    return rows if limit is None else rows.limit(limit)


def seed_rows(courses: DataFrame, requirements: DataFrame, letters: DataFrame, key: str, url: str, letter_url: str, current: Column, open_flag: Column, failed: Column) -> DataFrame:
    """One row a course: key, url (the current requirement's, else its last dead letter's), has_open and failed."""
    r = requirements.groupBy(key).agg(F.max(F.when(current, F.col(url))).alias("__url"), F.bool_or(open_flag).alias("__open"))
    d = letters.groupBy(key).agg(F.max(letter_url).alias("__letter"), F.bool_or(failed).alias("__failed"))
    rows = courses.select(key).join(r, key, "left").join(d, key, "left")
    return rows.select(key, F.coalesce("__url", "__letter").alias("url"), F.coalesce("__open", F.lit(False)).alias("has_open"), F.coalesce("__failed", F.lit(False)).alias("failed"))


#: Which seeds a crawl takes.
MODES = {"all": "true", "missing": "not has_open", "retry": "failed", "missing_or_retry": "not has_open or failed"}


def choose_seeds(seeds: DataFrame, mode: str, key: str, limit: int | None = None) -> DataFrame:
    rows = seeds.where(MODES[mode]).orderBy(key)
    return rows if limit is None else rows.limit(limit)


def distinct_lists(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key, the sorted list of its different values, and its rows."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name), F.count("*").alias("n"))


def course_records(raw: DataFrame) -> DataFrame:
    """Courses with parsed durations, intakes, scores and degree. raw: duration_text, intake_text, english_text, course_name and more."""
    rows = raw.withColumns({"d": parse_duration(F.col("duration_text")), "s": parse_score_text(F.col("english_text")), "intakes": parse_intakes(F.col("intake_text"))["months"], "degree": degree_type(F.col("course_name"))})
    parsed = [F.col("d.min").alias("duration_min"), F.col("d.max").alias("duration_max"), F.col("s.overall").alias("need_overall"), F.col("s.min_band").alias("need_band"), *(F.col(f"s.{p}").alias(p) for p in PARTS)]
    return rows.select(*raw.columns, "intakes", "degree", *parsed)


def open_in(courses: DataFrame, key: str, month: str, intakes: str = "intakes") -> DataFrame:
    return courses.where(F.array_contains(intakes, month)).orderBy("course_name", key)


def map_rows(rows: DataFrame, key: str, pairs: Column) -> DataFrame:
    """key, key and value of a map column, a row each."""
    return rows.select(key, F.explode(pairs))
