"""Structured Streaming counterparts of the batch queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def occurrence_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def slot_counts(events: DataFrame, minutes: int = 5, late: str = "30 minutes") -> DataFrame:
    """Occurrences by tumbling slot and kind; rows later than `late` behind the newest are out of reach of state."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", f"{minutes} minutes").alias("slot"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("slot.start").alias("start"), "event_type", "n")


def first_sightings(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """The first row of each event key within the watermark: idempotent outbox appends."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


class KeyedTable:
    """A table of the latest row by key, kept as versioned Parquet; a batch is applied once, whatever is replayed.

    Versions stand in `path`/v=<batch>; a reader takes the highest finished one. Every write goes through Spark, so any
    store that Spark opens will do.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]) -> None:
        self.spark, self.path, self.keys, self.order = spark, path, keys, order

    def _versions(self) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        found = self._versions()
        return self.spark.read.parquet(f"{self.path}/v={version if version is not None else found[-1]}") if found else None

    def apply(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: union with the version before, then the latest row of each key."""
        before = [v for v in self._versions() if v < number]
        rows = batch if not before else self.read(before[-1]).unionByName(batch)
        others = [c for c in rows.columns if c not in self.keys]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.struct(*self.order)).alias("row"))
        latest.select(*self.keys, "row.*").write.mode("overwrite").parquet(f"{self.path}/v={number}")


class SummedTable(KeyedTable):
    """Counts by key without a watermark: a row that comes late still counts, however late. Same versions, same replay."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], counts: list[str]) -> None:
        super().__init__(spark, path, keys, keys)
        self.counts = counts

    def apply(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: `batch` has the keys and the counts to add."""
        before = [v for v in self._versions() if v < number]
        rows = batch.select(*self.keys, *self.counts)
        rows = rows if not before else self.read(before[-1]).unionByName(rows)
        rows.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.counts)).write.mode("overwrite").parquet(f"{self.path}/v={number}")


def slot_rows(events: DataFrame, minutes: int = 5) -> DataFrame:
    """(start, event_type, n) of each event, for SummedTable: slot_counts that keeps late rows."""
    width = minutes * 60
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / width) * width
    return events.select(start.alias("start"), "event_type", F.lit(1).cast("long").alias("n"))


def run_once(stream: DataFrame, apply, checkpoint: str) -> None:
    """Process all that is there, in bounded micro-batches, and stop."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_to_memory(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """For tests: the whole output of a stream as a table."""
    name = "t" + uuid.uuid4().hex
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
