"""Results as CSV or JSON records, as a stream of batches, as one Parquet file, or to a sink per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_records(df: DataFrame, field: str = ",") -> DataFrame:
    return df.select(F.to_csv(F.struct("*"), {"sep": field}).alias("record"))


def json_records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("record"))


def events(df: DataFrame, size: int = 1000) -> Iterator[tuple[str, list[str]]]:
    """("Records", rows) as they arrive, then ("End", [])."""
    part: list[str] = []
    for r in json_records(df).toLocalIterator():
        part.append(r["record"])
        if len(part) == size:
            yield "Records", part
            part = []
    if part:
        yield "Records", part
    yield "End", []


def deliver(stream: DataFrame, write, checkpoint: str):
    """Starts a query that gives each micro-batch to write(df, batch_id); replayed batches keep their id."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
