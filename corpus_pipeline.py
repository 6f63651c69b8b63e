"""The corpus pipeline: language ID, near-duplicate removal, PII, mixing, and byte-level BPE, over ``documents``.

Each stage works on all that the one before it kept, and is written before the next one reads it. Stages keep a table's other
columns, except the last one. Very long texts are handled whole; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.llm import bpe, jaccard_join, langid, mixing, pii
from sparkprep.llm.common import cut, table
from sparkprep.llm.queries import RANKS, WEIGHTS

#: Below this score the language is as good as unknown.
LEAST_SCORE = 0.3
#: Bytes of rows that go to a Python worker at a time, at most, or a single row.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow's batches by ``BATCH`` for the rest of the session, unless the bound is less already.

    The JVM and the worker hold a batch each, more while it grows, and don't give all of it back; by default it may have 64 MB.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go (no letters, null or empty text, a score near chance); a null lang is filled in.

    Repeated rows, ties and rows with a null doc_id are judged alike, by their texts; an empty table stays empty.
    """
    small_batches(spark)
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    said = langid.predict(docs, model)
    kept = said.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def row_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with _file and _row, which name a row's file and its place there; a number for each _file).

    What is not read from files is written first.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        placed = docs.select("*", *place)
    except AnalysisException:
        placed = cut(docs, "rows").select("*", *place)
    files = placed.select("_file").distinct()
    number = F.row_number().over(Window.orderBy("_file"))  # a row for each file
    return placed, cut(files.withColumn("_number", number.cast("long")), "files")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, a similarity of 0.8 or more) stays: that of the
    smallest doc_id, of equal ones the first by file and place in it.

    Rows are told apart by file and place, so rows with a null doc_id take part (the last to stay), and different texts under
    one doc_id both stay. Empty texts and texts without words all stay, and so does an empty table.
    """
    small_batches(spark)
    placed, files = row_keys(docs)
    key = (F.col("_number") * (1 << 40) + F.col("_row")).alias("_key")
    keyed = placed.join(files, "_file")
    groups = jaccard_join.join(keyed.select(key.alias("doc_id"), "text"), k=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("component"))
    named = groups.join(keyed.select(key, "doc_id", "_file", "_row"), "_key")
    first = named.groupBy("component").agg(F.min_by(F.struct("_file", "_row"), F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("k"))
    first = cut(first.select("k._file", "k._row"), "first-of-group")
    return placed.join(first, ["_file", "_row"], "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets. Null and empty texts, repeated rows and ties stay as they are."""
    small_batches(spark)
    found = pii.find(docs, redact=True)
    return found.withColumns({"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. Null and empty texts are never taken; a null source is one of its own."""
    return mixing.take(docs, WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (little-endian 32-bit integers), ids_sha256, decoded_sha256; a row for each row."""
    small_batches(spark)
    path = public_tokenizers.path(RANKS)
    return bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], stable=True, digests=True)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: Trained models and learned patterns are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
