"""The thin registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, bpe, imatch, jaccard_join, jpeg, langid, pii
from .common import table
from .mixing import mix
from .sharding import place
from .urlgraph import Rule, judge

RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]
WEIGHTS = [3, 1, 2]
SHARDS = [f"shard-{i:03d}" for i in range(64)]


RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_neighbours(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, stable=True, ids=False, digests=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).drop("redacted")


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.texts_as_pictures(table(spark, sf_dir, "documents"))


def op5_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return attribution.section_tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ["doc_id"])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    said = langid.predict(docs.select("doc_id", "text"), model)
    return said.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard", "shard_without_last")


QUERIES = {f.__name__: f for f in (op1_imatch, op2_byte_bpe, op3_pii, op4_jpeg, op5_token_attribution, op6_jaccard_join, op7_language_id, op8_mixing, op9_url_filters, op10_sharding)}
