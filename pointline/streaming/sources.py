"""Reading ledgers as streams and running them to the end of what is there."""

from __future__ import annotations

import datetime as dt
import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..session import STATE_STORE, shared_folder
from ..sources import repair, tables
from ..sources.store import Store

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_table(spark: SparkSession, folder: str, name: str, bytes_per_trigger: int = 256 << 20) -> DataFrame:
    """A table, one file or a folder of them, as a stream; the limit per trigger bounds what a micro-batch holds of any player.

    The path is a pattern that only the table's own name fits, since a stream takes a pattern for either layout.
    """
    pattern = f"{folder}/{name}.parque[t]"
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
        raise FileNotFoundError(f"no table {name} in {folder}")
    return spark.readStream.schema(tables.SCHEMAS[name]).option("maxBytesPerTrigger", bytes_per_trigger).parquet(pattern)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger entries from events, with ``ts`` as TIMESTAMP."""
    return stream_table(spark, folder, "events").select(
        F.col("event_id").alias("id"), cal.as_instant(F.col("ts")).alias("ts"), F.col("user_id").alias("player_id"),
        F.col("event_type").alias("action"), tables.event_points().alias("points"))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State in RocksDB, which spills to disk, for queries started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Clock:
    """Tells a stream that time has passed when no entry does: a folder of moments, each a row without player.

    In production whatever triggers the hourly checks strikes it; over a finite ledger it is struck once at the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark, "clock")
        spark.createDataFrame([], "ts timestamp").write.parquet(self.folder)

    def with_entries(self, entries: DataFrame) -> DataFrame:
        ticks = self.spark.readStream.schema("ts timestamp").parquet(self.folder)
        return entries.unionByName(ticks, allowMissingColumns=True)

    def strike(self, moment: dt.datetime) -> None:
        now = self.spark.range(1).select(cal.as_instant(cal.ntz(moment)).alias("ts"))
        now.write.mode("append").parquet(self.folder)


def run_appending(stream: DataFrame, purpose: str, clock: Clock | None = None, until: dt.datetime | None = None) -> DataFrame:
    """Run over all available input into Parquet files (exactly once) and return them.

    With a clock, the query then goes on from its checkpoint with the moment ``until``, which closes what lies before it.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, purpose)

    def run() -> None:
        stream.writeStream.outputMode("append").format("parquet").option("path", os.path.join(folder, "rows")).option(
            "checkpointLocation", os.path.join(folder, "checkpoint")
        ).trigger(availableNow=True).start().awaitTermination()
    with rocksdb_state(spark):
        run()
        if clock is not None:
            clock.strike(until)
            run()
    return spark.read.schema(stream.schema).parquet(os.path.join(folder, "rows"))


def run_updating(stream: DataFrame, keys: list[str], purpose: str, part: str) -> DataFrame:
    """The same for update mode, into a kept table with the last row of each key: every micro-batch is merged into the partitions
    that it touches, ``part`` being one of the keys. The table is readable, and as of the last micro-batch, at any time; a
    repeated micro-batch changes nothing.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, purpose)
    held = Store(spark, os.path.join(folder, "table"))
    held.create("rows", spark.createDataFrame([], stream.schema), part, keys)

    def merge(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, held.folder).upsert("rows", batch)

    with rocksdb_state(spark):
        stream.writeStream.outputMode("update").foreachBatch(merge).option(
            "checkpointLocation", os.path.join(folder, "checkpoint")
        ).trigger(availableNow=True).start().awaitTermination()
    held.clean()
    return held.read("rows")


def run_into_ledger(stream: DataFrame, purpose: str) -> Store:
    """Runs ledger entries over all available input into a kept ledger with its roll-ups (``repair.apply_changes`` for each micro-batch) and
    returns both. There is no watermark: an entry may come however late, and one that comes again under its day replaces the earlier version. A
    repeated micro-batch changes nothing.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, purpose)
    held = Store(spark, os.path.join(folder, "tables"))
    repair.create(held, spark.createDataFrame([], stream.schema))

    def take_up(batch: DataFrame, number: int) -> None:
        repair.apply_changes(Store(batch.sparkSession, held.folder), batch)

    stream.writeStream.foreachBatch(take_up).option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(
        availableNow=True).start().awaitTermination()
    held.clean()
    return held
