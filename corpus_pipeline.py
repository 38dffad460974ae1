"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, BPE round trip.

``STAGES`` lists (name, function); a function takes (spark, docs, folder) and returns a frame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents`` (and any others the table has).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointline.llm import bpe, decontaminate, near, pii, quality_rules
from pointline.llm.common import removed, stored, table
from pointline.llm.queries import pii_key, vocabulary


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that the quality rules keep."""
    model = quality_rules.trained(docs, table(spark, folder, "labels"))
    verdict = free_name(docs, "verdict")
    return docs.withColumn(verdict, quality_rules.judge(model)).where(F.col(verdict).kept).drop(verdict)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, the one of smallest id, of each class of near-duplicates; rows without id stay."""
    gone = near.classes(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def hide_personal(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts with pseudonyms; the number of characters follows."""
    hidden = free_name(docs, "hidden")
    out = docs.withColumn(hidden, pii.pseudonymised(pii_key())).withColumn("text", F.col(f"{hidden}.text")).drop(hidden)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def to_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each text and how many; ``round_trip`` tells whether decoding them gives the text again."""
    both = docs.select("doc_id", "text", bpe.round_trip(vocabulary()).alias("_both"))
    return both.select("doc_id", F.col("_both.ids").alias("ids"), F.size("_both.ids").cast("long").alias("n_tokens"),
                       F.col("_both.text").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", one_of_each),
    ("decontamination", without_leaks),
    ("personal data", hide_personal),
    ("tokens", to_tokens),
]

#: The models of the first stages cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, folder), name.replace(" ", "-"))
        if k:
            removed(spark, before)
    return STAGES[-1][1](spark, docs, folder)
