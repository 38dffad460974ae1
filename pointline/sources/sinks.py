"""Writers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: How sheets are written and read: quotes inside values doubled, nothing between separators for a missing value.
CSV = {"sep": ";", "header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "encoding": "UTF-8"}


def write_sheets(sheets: Mapping[str, DataFrame], folder: str) -> None:
    """One ``;``-separated CSV folder with header per sheet. All sheets are written beside ``folder``, which is then replaced by
    renaming: a reader finds the sheets of one export. A repeated export replaces the last one."""
    if not sheets:
        return
    spark = next(iter(sheets.values())).sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    staged, final = hadoop.Path(f"{folder.rstrip('/')}.{uuid.uuid4().hex}"), hadoop.Path(folder)
    for name, sheet in sheets.items():
        sheet.write.options(**CSV).csv(f"{staged}/{name}")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(final, True)
    if not files.rename(staged, final):
        raise OSError(f"could not publish {staged} as {final}")


def read_sheet(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A sheet with its types. Values may hold separators, quotes and line ends; a row that does not fit the schema is an error.

    CSV does not tell an empty text from a missing one: both come back as missing."""
    return spark.read.schema(schema).options(**CSV, multiLine=True, mode="FAILFAST").csv(os.path.join(folder, name))


def reload_table(table: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace a stored table as a whole and read it back; running it twice changes nothing."""
    table.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def replace_partitions(table: DataFrame, folder: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that occur in ``table``."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(folder)


def write_ledger(ledger: DataFrame, folder: str) -> None:
    """Store a ledger by day, so that time filters prune whole folders.

    Range partitioning by day and id gives few files per day, yet spreads a heavy day over several tasks.
    """
    daily = ledger.withColumn("day", F.to_date("ts")).repartitionByRange("day", "id")
    daily.write.mode("overwrite").partitionBy("day").parquet(folder)
