"""Table maintenance as rewrites: upsert, child replacement, versions, validation and routing.

Parquet tables have no row-level writes, so each operator returns the next
snapshot of a table, to be written beside the old one and then published.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """sha-256 of the columns as compact JSON with sorted keys; null is written as null, so it differs from the empty string."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def upsert(base: DataFrame, delta: DataFrame, key: str, keep: Sequence[str] = (), stamp: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``delta`` replace those of equal key or are added; the columns ``keep`` stay as in ``base`` where it has the row.

    ``stamp``: what the columns of a replaced or added row are set to, as an updated_at.
    """
    b, d = base.select(F.struct(*base.columns).alias("b"), F.col(key).alias("kb")), delta.select(F.struct(*base.columns).alias("d"), F.col(key).alias("kd"))
    joined = b.join(d, F.col("kb") == F.col("kd"), "full_outer")
    value = lambda c: F.when(F.col("kd").isNull() | (F.col("kb").isNotNull() & F.lit(c in keep)), F.col(f"b.{c}")).otherwise(F.col(f"d.{c}"))
    touched = {c: F.when(F.col("kd").isNotNull(), new).otherwise(value(c)) for c, new in (stamp or {}).items()}
    return joined.select(*(touched.get(c, value(c)).alias(c) for c in base.columns))


def replace_requirements(base: DataFrame, delta: DataFrame, parent: str, source: str, only_source: bool = False) -> DataFrame:
    """All versions of the parents in ``delta`` go (with ``only_source`` those of ``source`` alone), and its rows come as current version 1 of ``source``.

    base: parent, requirement_version, requirement_source, is_current and content; delta: parent and content.
    """
    gone = base.join(delta.select(parent).distinct().withColumn("__new", F.lit(True)), parent, "left")
    kept = gone.where(F.col("__new").isNull() | (F.lit(only_source) & (F.col("requirement_source") != source)))
    kept = kept.withColumn("is_current", F.col("is_current") & F.col("__new").isNull()).drop("__new")
    new = delta.withColumns({"requirement_version": F.lit(1), "requirement_source": F.lit(source), "is_current": F.lit(True)})
    return kept.select(*base.columns).unionByName(new.select(*base.columns))


def replace_children(base: DataFrame, delta: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in ``delta`` go, the rows of ``delta`` come."""
    return base.join(delta.select(parent).distinct(), parent, "left_anti").unionByName(delta)


def version_rows(base: DataFrame, delta: DataFrame, key: str, content: Sequence[str], as_of: Column, order: Sequence[str] = (), renew: Sequence[str] = ()) -> DataFrame:
    """Next snapshot of a versioned table (key, content, renewed columns, fingerprint, version, is_current, verified_at).

    The delta's rows of a key are replayed in ``order`` (one row a key needs none): a row equal to the version before it
    only renews verified_at (``as_of``, an expression on the delta's row) and the columns ``renew``, as notes or an address, another one closes that version and becomes
    the next. So a run of equal rows is one version, known by a running count of the changes, and no row is replayed on its own.
    """
    own, more = [key, *content], list(renew)
    new = delta.select(*own, *more, *(c for c in order if c not in own + more), row_hash(content).alias("__print"), as_of.alias("__at"))
    last = base.groupBy(key).agg(F.max("version").alias("__last"), F.max(F.when(F.col("is_current"), F.col("fingerprint"))).alias("__now"))
    turn = Window.partitionBy(key).orderBy(*(order or [F.lit(1)]))
    before = F.when(F.row_number().over(turn) == 1, F.col("__now")).otherwise(F.lag("__print").over(turn))
    judged = new.join(last, key, "left").withColumns({"__turn": F.row_number().over(turn), "__new": (~before.eqNullSafe(F.col("__print"))).cast("int")})
    judged = judged.withColumn("__run", F.sum("__new").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    late = F.max_by(F.struct(*own, *more, "__print", "__at", "__last"), "__turn").alias("r")
    runs = judged.groupBy(key, "__run").agg(late).withColumn("__top", F.max("__run").over(Window.partitionBy(key)))
    # the run that goes on with the current version, and whether another follows
    on = runs.groupBy(key).agg(F.max("__top").alias("__top"), F.max(F.when(F.col("__run") == 0, F.struct("r"))).alias("__on"))
    touched = base.join(on, key, "left")
    goes_on = F.col("is_current") & F.col("__on").isNotNull()
    renewed = [F.when(goes_on, F.col(f"__on.r.{c}")).otherwise(F.col(c)).alias(c) for c in more]
    kept = touched.select(*own, *renewed, "fingerprint", "version", (F.col("is_current") & (F.coalesce("__top", F.lit(0)) == 0)).alias("is_current"), F.when(goes_on, F.col("__on.r.__at")).otherwise(F.col("verified_at")).alias("verified_at"))
    added = runs.where("__run > 0").select(
        *(F.col(f"r.{c}").alias(c) for c in own + more), F.col("r.__print").alias("fingerprint"), (F.coalesce("r.__last", F.lit(0)) + F.col("__run")).cast("int").alias("version"), (F.col("__run") == F.col("__top")).alias("is_current"),
        F.col("r.__at").alias("verified_at"),
    )
    return kept.unionByName(added)


def check_rows(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``errors``: the codes of the rules they break (a rule that gives null is broken)."""
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items()))))


#: Errors that no retry can mend.
TERMINAL = ("validation_error", "unsupported_course")


def route(checked: DataFrame, stage: str, payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, dead letters: stage, error_code, message, payload as JSON, retryable)."""
    ok = checked.where(F.size("errors") == 0).drop("errors")
    bad = checked.where(F.size("errors") > 0)
    code = F.get("errors", F.lit(0))
    return ok, bad.select(F.lit(stage).alias("stage"), code.alias("error_code"), F.array_join("errors", ", ").alias("message"), F.to_json(F.struct(*payload)).alias("payload"), (~code.isin(*TERMINAL)).alias("retryable"))


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def latest(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row a key: the first by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
