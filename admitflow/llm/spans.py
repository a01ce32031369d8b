"""Places of regular expression matches, as DataFrame expressions.

Spark's regular expression functions give no positions, so matches are put
between marks and the text is split at the marks: every second piece is then a
match, and the lengths of the pieces before it are its place (in code points).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A code point that Unicode keeps out of texts, and what it becomes where it occurs all the same.
MARK, MARK_AS = "﷐", "﷑"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(text: Column) -> Column:
    """Text without null and without the mark; every place stays as it is."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(MARK), F.lit(MARK_AS))


def pieces(text: Column, pattern: str | Column) -> Column:
    """Other text and matches of ``pattern`` in turn, beginning with other text (maybe empty)."""
    found = F.concat(F.lit("(?:"), pattern, F.lit(")")) if isinstance(pattern, Column) else F.lit(f"(?:{pattern})")
    return F.split(F.regexp_replace(text, found, F.lit(f"{MARK}$0{MARK}")), MARK)


def matches(text: Column, pattern: str | Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, value>> of the non-overlapping matches that ``keep`` accepts, by start.

    ``text`` must be :func:`clean`, and ``pattern`` (a column where each row has its own) without numbered back references.
    """
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    state = f"struct<at:bigint,odd:boolean,found:{kind}>"

    def step(acc: Column, x: Column) -> Column:
        ends = acc["at"] + F.length(x)
        one = F.array(F.struct(acc["at"].alias("start"), ends.alias("end"), x.alias("value"))).cast(kind)
        good = acc["odd"] & (keep(x) if keep else F.lit(True))
        return F.struct(ends.alias("at"), (~acc["odd"]).alias("odd"), F.when(good, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found")).cast(state)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("odd"), F.array().cast(kind).alias("found")).cast(state)
    found = F.aggregate(pieces(text, pattern), start, step, lambda acc: acc["found"])
    return F.when(F.rlike(text, pattern if isinstance(pattern, Column) else F.lit(pattern)), found).otherwise(F.array().cast(kind))


def replace_spans(text: Column, spans: Column, value: Callable[[Column], Column]) -> Column:
    """``text`` with each of ``spans`` (structs with start and end, by start) replaced; of overlapping spans the first counts and the rest goes."""
    state = "struct<at:bigint,out:string>"

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), value(s))
        out = F.when(s["start"] >= acc["at"], new).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out")).cast(state)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")).cast(state)
    changed = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(spans) == 0, text).otherwise(changed)
