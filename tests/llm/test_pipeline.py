"""The pipeline's stages against brute-force versions, each on what the one before it kept."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from sparkprep.llm import bpe, langid, pii
from sparkprep.llm.queries import WEIGHTS

from .test_numeric import plain_spans
from .test_operators import PATH, SCHEMA, corpus, plain_components, plain_mix


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(corpus() + [(None, "no id here", "en", "s1", 10), (5, corpus()[5][1], "de", "s1", 1)], SCHEMA)
    docs.write.parquet(f"{root}/documents.parquet")
    kept = [[tuple(r) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.read.parquet(f"{root}/documents.parquet" if len(kept) == 1 else f"{root}/{len(kept) - 1}"), str(root))
        docs.write.parquet(f"{root}/{len(kept)}")
        docs = spark.read.parquet(f"{root}/{len(kept)}")
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append([tuple(r) for r in docs.collect()] if name != "byte_bpe" else [r.asDict() for r in docs.collect()])
    return root, kept


def test_language_stage(stages):
    _, kept = stages
    lettered = [r for r in kept[0] if r[1] and langid.LETTER.search(r[1])]
    assert Counter(r[0] for r in kept[1]) == Counter(r[0] for r in lettered)
    assert all(r[2] for r in kept[1])


def test_duplicates_stage(stages):
    _, kept = stages
    known = [r for r in kept[1] if r[0] is not None]
    first = {i for i, (_, c) in plain_components(known, 5, 80).items() if i == c}
    assert Counter(r[0] for r in kept[2]) == Counter([*first, None])


def test_personal_data_stage(stages):
    _, kept = stages
    before = {r[0]: r[1] for r in kept[2]}
    for r in kept[3]:
        want = pii.redacted(before[r[0]], plain_spans(before[r[0]]))
        assert r[1] == want and r[4] == len(want)
    assert any("[CARD]" in r[1] for r in kept[3])


def test_mixing_stage(stages):
    _, kept = stages
    size, of, target = plain_mix(kept[3])
    source = {r[0]: r[3] for r in kept[3]}
    often, taken, largest = Counter(r[0] for r in kept[4]), defaultdict(int), defaultdict(int)
    for i, s in source.items():
        assert often[i] <= 2
        taken[s] += often[i] * size[i]
        largest[s] = max(largest[s], size[i])
    assert len(WEIGHTS) == 3 and all(abs(taken[s] - target[s]) <= largest[s] for s in of)
    assert {r[1] for r in kept[4]} <= {r[1] for r in kept[3]}


def test_tokens_stage(stages):
    _, kept = stages
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    text = {r[0]: r[1] for r in kept[4]}
    assert Counter(r["doc_id"] for r in kept[5]) == Counter(r[0] for r in kept[4])
    for r in kept[5]:
        ids = enc.encode_ordinary(text[r["doc_id"]])
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r["token_ids"]) == raw and r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    root, kept = stages
    got = Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(root)).collect())
    assert got == Counter((r["doc_id"], r["ids_sha256"]) for r in kept[5])
    assert re.fullmatch(r"[0-9a-f]{64}", next(iter(got))[1])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["language_id", "jaccard_join", "pii", "byte_bpe"])
def test_batches_are_bounded_in_bytes(spark, stages, name):
    root, _ = stages
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{root}/documents.parquet"), str(root))
    long = spark.range(4_000, numPartitions=1).selectExpr("repeat('word ', 2000) AS text")
    sizes = [r["n"] for r in long.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    assert len(sizes) > 1 and max(sizes) <= corpus_pipeline.BATCH + 20_000
    spark.conf.set(key, "1m")
    corpus_pipeline.small_batches(spark)
    assert spark.conf.get(key) in ("1m", "1048576b")
    spark.conf.unset(key)
