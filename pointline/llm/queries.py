"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import functools
import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, links, merkle, near, pii, quality_net, quality_rules, repeats, search, secrets, sentence_pieces, sharding
from .oracle import ORACLE  # noqa: F401
from .common import learnable, stored, table

TEST_KEY = "a published key, for tests alone"

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@functools.cache
def vocabulary() -> str:
    """The file of the byte-level vocabulary, at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def model() -> str:
    """The file of the SentencePiece model, at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pii_key() -> str:
    """The key that PII_KEY names; without it the published one, which protects nothing."""
    key = os.environ.get("PII_KEY")
    if not key:
        warnings.warn("PII_KEY is not set: pseudonyms are made with a published key and can be turned back by anyone", RuntimeWarning, stacklevel=2)
    return key or TEST_KEY


@query
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its text with pseudonyms, how many values were replaced, and where (kind:start:end)."""
    docs = table(spark, folder, "documents").select("doc_id", pii.pseudonymised(pii_key()).alias("_v"))
    return docs.select("doc_id", F.size("_v.spans").cast("long").alias("n_spans"), listed("_v.spans").alias("spans"),
                       F.col("_v.text").alias("text"))


def listed(spans: str, only: str = "true") -> Column:
    return F.expr(f"array_join(transform(filter({spans}, x -> {only}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


@query
def op2_near(spark: SparkSession, folder: str) -> DataFrame:
    return near.classes(table(spark, folder, "documents"))


@query
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = secrets.trained(docs, table(spark, folder, "labels"))
    found = docs.select("doc_id", secrets.found(model).alias("_v"))
    counts = [F.expr(f"cast(size(filter(_v, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("_v", "x.kind <> 'model'"), 256).alias("base_sha256"), listed("_v").alias("spans"))


@query
def op4_links(spark: SparkSession, folder: str) -> DataFrame:
    return links.judged(table(spark, folder, "pages").select("page_id", "url", "html"))


@query
def op5_quality_net(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_net.trained(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", (~learnable()).alias("held_out"), quality_net.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without a repeat keep all words; their digests don't wait for the search."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = repeats.repeats(docs)
    found = stored(found.select("doc_id", repeats.kept_words(F.col("repeats")).alias("_v")).select("doc_id", *digests()), "repeats")
    whole = docs.select("doc_id", repeats.kept_words().alias("_v")).select("doc_id", *digests())
    return found.union(whole.join(found.select("doc_id"), "doc_id", "left_anti"))


def digests() -> list[Column]:
    return [F.col("_v.n_words").alias("n_words"), F.col("_v.n_removed").alias("n_removed"), F.sha2(F.col("_v.text"), 256).alias("kept_sha256")]


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document and benchmark item of which it holds a passage."""
    return decontaminate.contaminations(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


@query
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "documents").select("doc_id", bpe.round_trip(vocabulary()).alias("_v"))
    return both.select("doc_id", F.size("_v.ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("_v.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("_v.text"), 256).alias("decoded_sha256"))


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_rules.trained(docs, table(spark, folder, "labels"))
    return docs.select("doc_id", quality_rules.judge(model).alias("_v")).select("doc_id", "_v.*")


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))


@query
def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "documents").select("doc_id", sentence_pieces.round_trip(model()).alias("_v"))
    return both.select("doc_id", F.size("_v.ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("_v.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("_v.text"), 256).alias("decoded_sha256"))


@query
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """The claimed text of a third of the documents has its A-Z lower-cased: only what had none of these verifies."""
    docs = table(spark, folder, "documents").select(*merkle.FIELDS)
    lower = F.translate("text", merkle.UPPER, merkle.LOWER)
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).otherwise(F.col("text"))
    out = merkle.manifest(docs, claimed={"text": claimed})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
