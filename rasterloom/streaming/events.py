"""Job events as streams: resumable tails, latest states, terminal drains, and windowed counts of late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED", "INTERRUPTED")


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 100, only: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as they come, ``files`` at a time; ``only`` is a pattern of their names."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", only).parquet(path)


def tail(events: DataFrame, job: str | None = None, after: int = -1) -> DataFrame:
    """Events after a sequence (of one job), as a client resumes from the last one it saw."""
    if after < -1:
        raise ValueError("a sequence is 0 or more")
    found = events.where(F.col("sequence") > after)
    return found if job is None else found.where(F.col("job_id") == job)


def frames(events: DataFrame) -> DataFrame:
    """Server-sent event frames: id, event and data lines."""
    return events.select("job_id", "sequence", F.concat(F.lit("id: "), F.col("sequence"), F.lit("\nevent: "), F.col("event_type"), F.lit("\ndata: "), F.col("payload"), F.lit("\n\n")).alias("frame"))


def windowed_counts(events: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` behind the watermark are left out (an extension)."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def open_jobs(events: DataFrame) -> DataFrame:
    """(job_id, events, last, state, gap): each job's running summary, updated with every batch.

    State is one small row a job: the next sequence expected, the number of events, the last type. A terminal event
    closes the job and drops its state; ``gap`` tells that a sequence was missing.
    """

    def update(key, batches, state):
        import pandas as pd

        expected, n, last, gap = state.get if state.exists else (0, 0, "", False)
        for b in batches:
            for sequence, kind in sorted(zip(b["sequence"].tolist(), b["event_type"].tolist())):
                gap = gap or sequence != expected
                expected, n, last = sequence + 1, n + 1, kind
        done = last in TERMINAL
        if done:
            state.remove()
        else:
            state.update((expected, n, last, gap))
        yield pd.DataFrame([(key[0], n, last, "CLOSED" if done else "OPEN", gap)], columns=["job_id", "events", "last", "state", "gap"])

    kind = events.schema["job_id"].dataType.simpleString()
    return events.groupBy("job_id").applyInPandasWithState(update, f"job_id {kind}, events long, last string, state string, gap boolean", "expected long, n long, last string, gap boolean", "update", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs once over all that is there, writes each batch as Parquet under ``path`` and reads it back: all batches, or
    in the complete mode the last one. A batch that is run again replaces what it wrote; nothing passes the driver."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")
