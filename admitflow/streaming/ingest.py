"""Rows that keep arriving: validated and routed by micro-batch, with the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from admitflow.operators.maintain import check_rows, route


def ingest(rows: DataFrame, rules: dict[str, Column], payload: list[str], good: str, dead: str, checkpoint: str, stage: str = "ingest") -> StreamingQuery:
    """Writes what passes ``rules`` below ``good`` and dead letters below ``dead``, and ends when all that is there has been read.

    Every micro-batch has its own folder (``batch=<n>``) that a repeated batch
    overwrites, so a batch that is run again after a failure adds no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = check_rows(batch, rules).persist()
        try:
            for part, path in zip(route(checked, stage, payload), (good, dead), strict=True):
                part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            checked.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
