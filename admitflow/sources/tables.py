"""Sources and sinks, and the admissions tables derived from the star schema.

The derived columns are plain SQL that Spark and other engines read alike; each
row of ``part`` becomes a course and each of ``customer`` an applicant, so the
work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.functions.text import canonical_number, canonical_url, collapse, normal_text, without_markup
from admitflow.session import read


def choice(on: str, *values: str) -> str:
    """SQL: one of ``values`` by the remainder of ``on``."""
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values[:-1]))
    return f"CASE {on} % {len(values)} {cases} ELSE {values[-1]} END"


NAME = "concat(" + choice("p_partkey", "'Master of Computer Science'", "'Master of Commerce'", "'Graduate Diploma in Data Science'", "'Master of Professional Accounting'", "'Juris Doctor'", "'Graduate Certificate in Architecture'", "'Doctor of Philosophy'", "'Master of Business Analytics'") + ", ' ', p_name)"
COURSE = {
    "course_id": "p_partkey",
    "course_name": NAME,
    "course_name_raw": f"concat(' ', {NAME}, '  ')",
    "cricos": "concat(lpad(CAST(p_partkey % 90000 AS STRING), 6, '0'), 'A')",
    "duration_text": choice("p_partkey", "'2'", "'3 4'", "'1.5'", "concat(CAST(p_size % 4 + 1 AS STRING), ' years, ', p_name)", "concat(CAST(p_size % 3 + 1 AS STRING), '-', CAST(p_size % 5 + 1 AS STRING))", "''", "'1 2 3'"),
    "intake_text": choice("p_size", "'Feb/Aug'", "'Mar/July'", "'Jan, Mar'", "'S9'", "''", "'October / Feb'"),
    "english_text": choice("p_partkey", "concat(CAST(p_size % 3 + 5 AS STRING), '.5 (', CAST(p_size % 2 + 5 AS STRING), '.0)')", "'7.5 (7.0 R/W; 8.0 L/S)'", "'7.0'", "''", "'6.0 (see notes 5.5)'", "'IELTS not listed'"),
    "academic_text": choice(
        "p_partkey",
        "concat('A bachelor''s degree in ', p_name, ' or a related discipline with a credit average (', CAST(p_size + 40 AS STRING), ' percent). Prerequisite mathematics.')",
        "'A graduate certificate pathway is available. Limited places apply.'",
        "''",
        "'Any bachelor degree or 2 years of work experience with an honours degree. A portfolio and CV are needed.'",
        "concat('Background in statistics and programming required.  Applications close on ', CAST(p_size % 28 + 1 AS STRING), ' May. Requirements for award: ', CAST(p_size AS STRING), ' credit points.')",
    ),
    "tests_text": choice("p_size", "'IELTS Academic overall 6.5 with no band below 6.0. PTE Academic 61.'", "'TOEFL iBT 90 or IELTS 7'", "'Cambridge C1 Advanced 185, Cambridge C2 Proficiency 190'", "'No test.'"),
    "campus": choice("p_size", "'Camperdown'", "'Mixed campus'", "''"),
    "faculty": choice("(p_size + p_partkey)", "'Faculty of Engineering'", "'Business School'", "''", "'Faculty of Science'"),
    "school": choice("(p_size + 2 * p_partkey)", "'School of Computer Science'", "''", "'Law School'"),
    "study_mode": choice("(p_size + 1)", "'On campus'", "'Online, part time'", "'On campus or online'", "''"),
    "fee": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice * 40 END",
}
APPLICANT = {
    "applicant_id": "c_custkey",
    "target": choice("c_custkey", "'计算机'", "'Computer Engineering'", "' 数据分析 '", "'Business  admin'", "'architecture'", "''"),
    "gpa": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(60 + c_custkey % 35 AS DOUBLE) END",
    "overall": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(5.5 AS DOUBLE) + CAST(c_custkey % 7 AS DOUBLE) / 2 END",
    "min_band": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(5 AS DOUBLE) + CAST(c_custkey % 6 AS DOUBLE) / 2 END",
    "background": choice("c_custkey", "'C9'", "'985'", "'211'", "'双非'", "'Tier 1'", "'other'"),
    "intake_wish": choice("c_nationkey", "'S1'", "'July, semester 2'", "''", "'Mar,mar, Oct'", "'Feb'"),
    "subjects_text": choice("c_custkey", "'Computer Science, Calculus'", "'History'", "''", "'Statistics and Python'"),
    "budget_min": "CAST(0 AS DOUBLE)",
    "budget_max": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 20000 + abs(c_acctbal) * 6 END",
    "want_min": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) END",
    "want_max": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(2 AS DOUBLE) END",
    "want_degree": choice("c_custkey", "''", "'master'", "'graduate'"),
    "want_campus": choice("c_nationkey", "''", "'camperdown'", "''", "'city, mixed'"),
    "want_faculty": choice("c_custkey", "''", "'engineering'", "''", "''", "'science'", "''", "''"),
    "want_school": choice("c_nationkey", "''", "''", "''", "'law'", "''"),
    "want_mode": choice("(c_custkey + c_nationkey)", "''", "''", "'evening, On Campus'", "''", "'online'"),
    "accepts_pathway": "c_custkey % 2 = 0",
}


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def raw_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*(f"{v} AS {k}" for k, v in COURSE.items()))


def raw_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(*(f"{v} AS {k}" for k, v in APPLICANT.items()))


def load_seeds(rows: DataFrame, required: dict[str, str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Seed rows under their table names: a missing column is an error, rows without name or code go, numbers are written canonically.

    required: column of the file to column of the table; the first two are name and code.
    """
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")

    def cell(old: str, new: str) -> Column:
        text = F.trim(F.coalesce(F.col(old).cast("string"), F.lit("")))
        return (canonical_number(text) if new in numbers else text).alias(new)

    name, code, *_ = required.values()
    rest = [c for c in rows.columns if c not in required]
    return rows.select(*rest, *(cell(*x) for x in required.items())).where((F.col(name) != "") & (F.col(code) != ""))


def clean_course_name(raw: Column) -> Column:
    """struct<name, raw, error>: the trimmed name beside the given one; an empty name is an error."""
    name = F.trim(F.coalesce(raw, F.lit("")))
    return F.struct(name.alias("name"), raw.alias("raw"), F.when(name == "", "empty_course_name").alias("error"))


def page_texts(pages: DataFrame, normal: Callable[[Column], Column] = normal_text) -> DataFrame:
    """Pages' addresses and texts; ``normal`` decodes and collapses a text freed of markup."""
    return pages.select("page_id", canonical_url(F.col("url")).alias("url"), normal(without_markup(F.col("html"))).alias("text"))


def by_position(rows: DataFrame, names: dict[str, str], within: int = 7) -> DataFrame:
    """Columns whose header (trimmed, any case) is a key of ``names`` among the first ``within``, renamed; a missing one is an error."""
    place = {c.strip().lower(): c for c in reversed(rows.columns[:within])}
    if missing := [h for h in names if h.lower() not in place]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows.select(*(F.col(f"`{place[h.lower()]}`").alias(n) for h, n in names.items()), *(F.col(c) for c in rows.columns[within:]))


def with_lineage(rows: DataFrame, sheet: str = "") -> DataFrame:
    """Rows read from files, with source_file_name, source_sheet_name and source_row_number (from 0, within the file; Parquet only)."""
    return rows.select("*", F.col("_metadata.file_name").alias("source_file_name"), F.lit(sheet).alias("source_sheet_name"), F.col("_metadata.row_index").alias("source_row_number"))


def append_dead_letters(letters: DataFrame, path: str, kind: str = "json", created_at: Column | None = None) -> None:
    """Appends to a folder of JSON lines or Parquet; ``created_at`` stamps the rows."""
    letters = letters if created_at is None else letters.withColumn("created_at", created_at)
    letters.write.mode("append").format(kind).save(path)


__all__ = ["APPLICANT", "COURSE", "append_dead_letters", "by_position", "choice", "clean_course_name", "collapse", "load_seeds", "page_texts", "raw_applicants", "raw_courses", "select_list", "with_lineage"]
