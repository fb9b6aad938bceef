"""Event streams: sources, the state of tasks, windows, exactly-once rows, a bus of subscribers, token buckets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERMINAL = ["completed", "failed", "cancelled"]


def stream_table(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, with the schema that the files have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(where):
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key: what a late subscriber gets first. State holds one row a key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("e")).select(key, "e.*")


def open_tasks(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Tasks whose last event doesn't end them."""
    return latest(events, key, order, [status]).where(~F.col(status).isin(TERMINAL))


def windowed(events: DataFrame, time: str, width: str, keys: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates, by name, of each tumbling window; with `late`, windows that old are closed and their state goes."""
    rows = events.withWatermark(time, late) if late else events
    found = rows.groupBy(F.window(time, width).alias("w"), *keys).agg(*[a.alias(name) for name, a in aggregates.items()])
    return found.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def once(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """Each request key once, however often it is delivered within `late`."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream's source has now, as a table: each batch is written to the folder that the machines share.

    In complete mode the last batch is the result; a batch that is run again after a failure overwrites its own rows.
    """
    spark = stream.sparkSession
    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='tessera-')).rstrip('/')}/stream-{uuid.uuid4().hex}"
    written = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        written.append(batch)

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows/batch={max(written)}")
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/rows/batch={b}" for b in written])


class Bus:
    """Subscribers by type of event, "*" for all. A batch goes to each; those that fail don't keep it from the others."""

    def __init__(self, kind: str = "event_type"):
        self.kind, self.subscribers, self.failures = kind, [], []

    def subscribe(self, kind: str, take: Callable[[DataFrame], None]) -> None:
        self.subscribers.append((kind, take))

    def publish(self, rows: DataFrame, batch: int = 0) -> None:
        """For `foreachBatch`. The rows are computed once for all subscribers."""
        rows.persist()
        for kind, take in self.subscribers:
            try:
                take(rows if kind == "*" else rows.where(F.col(self.kind) == kind))
            except Exception as e:  # a subscriber is foreign code; its failure is kept
                self.failures.append((batch, kind, f"{type(e).__name__}: {e}"))
        rows.unpersist()
