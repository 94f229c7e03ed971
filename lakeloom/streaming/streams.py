"""Structured Streaming over event files: windows, sessions, late data, keyed state. Each has the batch result as its check."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from lakeloom.session import shared_dir


def events(spark: SparkSession, sf_dir: str, most_bytes: int = 1 << 30) -> DataFrame:
    """The events table as a stream of files, with an instant as its time. A batch takes files of about most_bytes in all."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    t = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxBytesPerTrigger", most_bytes).parquet(sf_dir)
    return t.withColumn("at", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str, key: str = "stream", by: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there now, to Parquet in the shared folder.

    Complete results are those of the last batch, update results the last row of each `by`. A batch that is run again
    takes the place of its first run.
    """
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/streams/{key}-{uuid.uuid4().hex}"
    out = f"{home}/out"
    if mode == "append":
        sink = stream.writeStream.format("parquet").option("path", out)
    else:
        sink = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch_no={i}"))
    sink.option("checkpointLocation", f"{home}/check").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch_no", LongType())])).parquet(out)
    return rows.groupBy(*by).agg(F.max_by(F.struct(*stream.columns), "batch_no").alias("x")).select("x.*")


def tumbling(t: DataFrame, width: str, late: str) -> DataFrame:
    return t.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))


def sliding(t: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    return t.withWatermark("at", late).groupBy(F.window("at", width, slide), "event_type").agg(F.count("*").alias("n"))


def sessions(t: DataFrame, gap: str, late: str) -> DataFrame:
    return t.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))


def once(t: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Repeats of a key within the time that late rows are waited for go."""
    return t.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def keyed_ema(t: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """The exponentially weighted mean of each key, kept as state from batch to batch; rows of a batch are put in time order.

    Only the first sample is taken whole, whatever it is.

    A task holds a key's (value, at, event_id) of one batch, which the source's bound on a batch bounds too.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for x in rows[value]:
            average = x if n == 0 else alpha * x + (1 - alpha) * average
            n += 1
        state.update((float(average), int(n)))
        yield pd.DataFrame({key: [k[0]], "ema": [average], "n": [n]})

    return t.select(key, value, "at", "event_id").groupBy(key).applyInPandasWithState(step, f"{key} long, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)
