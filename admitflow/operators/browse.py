"""Faceted browsing: filters, sorting, summaries and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_keyword(keywords: Sequence[str], columns: Sequence[str]) -> Column:
    """A column contains a keyword, without regard to case; ``%`` and ``_`` are ordinary characters."""
    found = F.lit(False)
    for c in columns:
        for k in keywords:
            found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(k.lower())), F.lit(False))
    return found


def range_contains(low: Column, high: Column, value: Column) -> Column:
    """Null passes, be it a bound or the value."""
    return F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))


def ranges_overlap(low: Column, high: Column, a: Column, b: Column) -> Column:
    """Of the interval a..b one null bound mirrors the other; two nulls pass, as do null bounds of the range."""
    left, right = F.coalesce(a, b), F.coalesce(b, a)
    return left.isNull() | (F.coalesce(right >= low, F.lit(True)) & F.coalesce(left <= high, F.lit(True)))


def facets(
    rows: DataFrame, fee: tuple[float, float] | None = None, duration: tuple[float, float] | None = None, scores: Sequence[float] | None = None, floors: dict[str, float] | None = None, flags: Sequence[str] = ()
) -> DataFrame:
    """Fee between; duration contained; overall score in a set; score floors, which null fails; all flags set."""
    good = F.lit(True)
    if fee:
        good = good & F.col("fee").between(*fee)
    if duration:
        good = good & (F.col("duration_min") >= duration[0]) & (F.col("duration_max") <= duration[1])
    if scores:
        good = good & F.col("overall").isin(*scores)
    for c, least in (floors or {}).items():
        good = good & (F.coalesce(F.col(c), F.lit(-1.0)) >= least)
    for f in flags:
        good = good & F.coalesce(F.col(f), F.lit(False))
    return rows.where(good)


def with_intake(rows: DataFrame, intakes: DataFrame, key: str, months: Sequence[str]) -> DataFrame:
    return rows.join(intakes.where(F.col("month").isin(*months)), key, "left_semi")


def irregular(parts: Sequence[str], least: str) -> Column:
    """A part differs from the minimum band; null counts as different."""
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(F.col(p) != F.col(least), F.lit(True))
    return out


def shared_codes(rows: DataFrame, code: str) -> DataFrame:
    """The rows whose code occurs more than once among ``rows``."""
    many = rows.groupBy(code).agg(F.count("*").alias("__n")).where("__n > 1").select(code)
    return rows.join(many, code, "left_semi")


#: Sort options: column and whether it goes down; nulls come last in all.
SORTS = {
    "name": ("course_name", False), "name_desc": ("course_name", True), "fee": ("fee", False), "fee_desc": ("fee", True),
    "duration": ("duration_min", False), "duration_desc": ("duration_max", True), "score": ("overall", False), "score_desc": ("overall", True),
}


def sort_keys(option: str, key: str) -> list[Column]:
    column, down = SORTS[option]
    return [F.desc_nulls_last(column) if down else F.asc_nulls_last(column), F.col(key).asc()]


def browse(rows: DataFrame, option: str, key: str) -> DataFrame:
    return rows.orderBy(*sort_keys(option, key))


def top_by(rows: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` of each group with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def export_csv(rows: DataFrame, names: dict[str, str], path: str, mark: bool = True) -> None:
    """The renamed columns as CSV in UTF-8 with a header; with ``mark`` the first header starts with the byte-order mark that spreadsheets look for."""
    first = next(iter(names))
    rows.select(*(F.col(c).alias(("\ufeff" if mark and c == first else "") + n) for c, n in names.items())).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")
