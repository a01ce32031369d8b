"""Tables laid out by their key, so that maintenance shuffles nothing or rewrites only what a delta touches.

Two layouts, for two needs: bucketed tables of the session's catalog, whose joins and
groupings on the key need no exchange, and folders of slots (a partition column made of
the key's hash), of which a replacement reads and overwrites the touched slots alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.operators.maintain import replace_children
from admitflow.session import cut

SLOT = "slot"


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """``rows`` as a table of ``buckets`` files sorted by ``key`` (under ``path``, else in the warehouse), read back. An existing table is replaced.

    The rows are dealt by the same hash as the buckets, so that a bucket is one file however many tasks there were.
    Tables are joined without an exchange if they have the same number of buckets; a key of very many rows makes its bucket as long.
    """
    out = rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (out.option("path", path) if path else out).saveAsTable(table)
    return rows.sparkSession.table(table)


def slot(key: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def save_slots(rows: DataFrame, path: str, key: str, slots: int) -> None:
    """``rows`` in ``slots`` folders under ``path``. Rows of a slot are spread over up to as many files as there are tasks, so no key is one task's."""
    rows.withColumn(SLOT, slot(key, slots)).write.mode("overwrite").partitionBy(SLOT).parquet(path)


def replace_in_slots(path: str, new: DataFrame, key: str, slots: int) -> list[int]:
    """Children of the keys in ``new`` are replaced in the folder; the touched slots, which alone are read and overwritten.

    The delta is written first (it is used three times); each slot is swapped when the job commits, so a lost executor costs
    its tasks and a failed job leaves the old slots. A delta without rows touches nothing. At most ``slots`` numbers reach the driver.
    """
    delta = cut(new.withColumn(SLOT, slot(key, slots)))
    touched = sorted(r[0] for r in delta.select(SLOT).distinct().collect())
    if touched:
        old = new.sparkSession.read.schema(delta.schema).parquet(path).where(F.col(SLOT).isin(touched))
        replace_children(old, delta, key).select(*delta.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(path)
    return touched
