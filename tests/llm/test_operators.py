"""The operators on small frames, with nulls, ties, repeated rows, clashing columns and no rows, against brute force."""

import hashlib
import os
import random
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sparkprep.llm import attribution, bpe, common, imatch, jaccard_join, jpeg, langid, mixing, pii, sharding, urlgraph
from sparkprep.llm.common import importable
from sparkprep.llm.components import components
from sparkprep.llm.queries import RULES, SHARDS, WEIGHTS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ", part int, id string, n int, token string, hash int, size int, copies int, bucket int, label int, lang_pred string, score string, n_tokens string, spans string, shard string, slot string, feature int, a int, b int, of int, target int"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def words(r, n, vocabulary):
    return " ".join(r.choice(vocabulary) for _ in range(n))


def corpus():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows = []
    for i in range(60):
        rows.append([i, words(r, r.randint(5, 120), vocabulary)])
    base = words(r, 200, vocabulary).split()
    for i in range(60, 110):  # near copies of one text, one word off
        w = list(base)
        w[r.randrange(200)] = f"x{i}"
        rows.append([i, " ".join(w)])
    rows += [[i, rows[3][1]] for i in range(110, 125)] + [[125, rows[3][1].upper()]]
    rows += [[126, None], [127, ""], [128, " \n\t"], [129, "one"], [130, "one"], [131, "one two"], [132, "x" * 50_000], [133, "ab " * 40_000]]
    rows += [[134, "mail a.b@c.example.com, +1 (017) 555-7713, 10.0.0.1, 4111 1111 1111 1111"], [135, "\u00a0'\u2003é😀"]]
    langs = ["en", "de", None]
    return [(i, t, langs[i % 3], [None, "s1", "s2", "s10"][min(i % 5, 3)], len(t) if t is not None else None) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    importable(spark)
    extra = tuple(None for _ in CLASHES.split(", ")[1:])
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + CLASHES).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_scratch_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    assert common.cut(spark.range(3), "x").count() == 3 and (tmp_path / "tables").exists()
    common.clear(spark)
    assert not (tmp_path / "tables").exists()


def test_scratch_folder_without_a_setting(tmp_path):
    """A session of its own, as this one's setting can't be changed."""
    code = f"""
import sys; sys.path.insert(0, {str(Path(common.__file__).parents[2])!r})
from pyspark.sql import SparkSession
from sparkprep.llm import common, queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert common.shared_dir(spark) == common.shared_dir(spark)
print("rows", queries.op8_mixing(spark, "/root/testdata/sf0.001").count(), queries.op7_language_id(spark, "/root/testdata/sf0.001").count())
"""
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=600)
    assert "rows 200 200" in got.stdout, got.stderr[-2000:]


def test_imatch(docs, rows, empty):
    got = {r["doc_id"]: r for r in imatch.edited_neighbours(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    prints = defaultdict(set)
    for k, r in enumerate(order):
        t, other = r[1] or "", order[(k + 1) % len(order)][1] or ""
        edited = imatch.edited(t, other)
        g = got[r[0]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        prints[t].add(g["fingerprint"])
        prints[edited].add(g["edited_fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert np.mean([g["near_edited"] > g["near_next"] for i, g in got.items() if i < 60]) > 0.8
    assert imatch.edited_neighbours(empty).count() == 0
    marked = imatch.fingerprints(docs).select("doc_id", "fingerprint").collect()
    assert {r["doc_id"]: r["fingerprint"] for r in marked} == {i: g["fingerprint"] for i, g in got.items()}
    one = imatch.edited_neighbours(docs.filter("doc_id = 5").drop("lang")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_imatch_ties(spark):
    same = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (7, "d"), (7, "d")], "doc_id long, text string")
    assert imatch.edited_neighbours(same).count() == 5


def test_bpe(docs, rows, empty):
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    got = bpe.decode(bpe.encode(docs, PATH, P.PATTERN, digests=True), PATH).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for g in got:
        ids = enc.encode_ordinary(text[g["doc_id"]])
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(g["token_ids"]) == raw and g["n_tokens"] == len(ids)
        assert bytes(g["decoded"]) == text[g["doc_id"]].encode()
        assert g["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(text[g["doc_id"]].encode()).hexdigest()
    assert bpe.encode(empty, PATH, P.PATTERN, ids=False, digests=True).count() == 0


def test_pii(spark, docs, rows, empty):
    from .test_numeric import plain_spans

    got = {r["doc_id"]: r for r in pii.find(docs, redact=True).collect()}
    assert len(got) == len(rows)
    for r in rows:
        base = plain_spans(r[1] or "")
        g = got[r[0]]
        assert g["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [g[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
        assert g["spans"] == pii.written(base)
        if not base:
            assert g["redacted"] == r[1]
    assert got[134]["redacted"].count("[") == 4
    assert pii.find(empty).count() == 0


def test_pii_learns_contexts(spark):
    r = random.Random(4)
    seeds = [(i, f"hello there my card number is 4{r.randint(10**9, 10**10 - 1)}{r.randint(0, 99999):05d} thanks {i}") for i in range(300)]
    decoys = [(1000 + i, f"the value {r.randint(10**15, 10**16 - 1)} is big") for i in range(50)]
    plain = [(2000 + i, "the value of the card is a nice number") for i in range(100)]
    got = pii.find(spark.createDataFrame(seeds + decoys + plain, "doc_id long, text string")).collect()
    base = lambda lo, hi: sum(g["n_card"] for g in got if lo <= g["doc_id"] < hi)
    found = lambda lo, hi: sum(g["spans"] != "" for g in got if lo <= g["doc_id"] < hi)
    assert base(0, 1000) < 60 and found(0, 1000) == 300
    assert found(1000, 3000) == base(1000, 3000)


def test_jpeg(docs, rows, empty):
    got = {r["doc_id"]: r for r in jpeg.texts_as_pictures(docs).collect()}
    by_text = defaultdict(set)
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        g = got[r[0]]
        assert (g["n_bytes"], g["payload_bytes"]) == (len(raw), len(payload))
        assert g["payload_sha256"] == hashlib.sha256(payload).hexdigest() and g["tail_crc32"] == zlib.crc32(payload[-32:])
        by_text[r[1] or ""].add((g["media_bytes"], g["media_sha256"], g["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert jpeg.texts_as_pictures(empty).count() == 0


def test_jpeg_features(spark):
    media = jpeg.store(np.arange(576, dtype=np.int64).astype(np.uint8), np.array([576]))[0]
    df = spark.createDataFrame([(1, media, 5), (2, b"junk", 5), (3, None, 5), (4, media, 5)], "id int, media binary, feature int")
    got = {r["id"]: r["feature"] for r in jpeg.features(df, "media").collect()}
    assert got[1] == got[4] and got[1].startswith("24x24:") and got[2] is None and got[3] is None


def test_attribution(docs, rows, empty):
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    got = attribution.section_tokens(docs, PATH, P.PATTERN, ["doc_id", "part"]).collect()
    total, size = Counter(), Counter()
    for g in got:
        total[g["doc_id"]] += g["n_tokens"]
        size[g["doc_id"]] += g["n_bytes"]
    for r in rows:
        assert total[r[0]] == len(enc.encode_ordinary(r[1] or "")) and size[r[0]] == len((r[1] or "").encode())
    assert attribution.section_tokens(empty, PATH, P.PATTERN, ["doc_id"]).count() == 0
    fields = attribution.field_tokens(docs, ["text", "lang", "source"], PATH, P.PATTERN, ["doc_id"]).collect()
    assert len(fields) == 3 * len(rows)
    whole = Counter()
    for g in fields:
        whole[g["doc_id"]] += g["n_tokens"]
    assert all(whole[r[0]] == len(enc.encode_ordinary("\n".join(x or "" for x in (r[1], r[2], r[3])))) for r in rows)


def plain_components(rows, k=3, percent=90):
    sets = {}
    for r in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[:at]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join(docs, rows, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, 3, 90).collect()}
    assert got == plain_components(rows)
    assert len({c for i, (_, c) in got.items() if 60 <= i < 110}) == 1
    assert jaccard_join.join(empty, 3, 90).count() == 0


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 5, 80)])
def test_jaccard_join_near_the_threshold(spark, seed, k, percent):
    """Chains and stars of copies with edits, and passages that many share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = words(r, 60, vocabulary)
    rows = []
    for _ in range(12):
        base = words(r, r.randint(20, 200), vocabulary).split()
        for _ in range(r.randint(1, 25)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 2)] = [r.choice(vocabulary)] * r.randint(0, 2)
            base = w if r.random() < 0.3 else base
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, words(r, r.randint(1, 30), vocabulary) + " " + passage) for i in range(60)]
    r.shuffle(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == plain_components(rows, k, percent)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 50), (70, 70)] + [(100, 200 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and got[60] == 50 and got[239] == 100 and 70 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id(spark, docs, rows, empty):
    r = random.Random(2)
    kinds = {"xx": ["the", "and", "ing"], "yy": ["der", "und", "sch"]}
    texts = [(i, " ".join("".join(r.choice(kinds[k]) for _ in range(3)) for _ in range(9)), k) for i in range(300) for k in [("xx", "yy")[i % 2]]]
    labelled = spark.createDataFrame([*texts, (900, None, "xx"), (901, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(labelled.filter("doc_id % 3 <> 1"))
    said = {x["doc_id"]: x for x in langid.predict(labelled, model).collect()}
    held = [i for i, _, _ in texts if i % 3 == 1]
    assert np.mean([said[i]["lang_pred"] == said[i]["lang"] for i in held]) > 0.95
    assert said[900]["lang_pred"] == "und" and 0 <= said[901]["score"] <= 1
    assert langid.predict(docs, model).count() == len(rows)
    nothing = langid.fit(empty)
    assert langid.predict(docs, nothing).filter("lang_pred <> 'und'").count() == 0


def plain_mix(rows):
    size = {r[0]: len(re.findall(r"[^ \t-\r]+", r[1] or "")) for r in rows}
    of = defaultdict(int)
    for r in rows:
        of[r[3]] += size[r[0]]
    names = sorted([s for s in of if s is not None]) + ([None] if None in of else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    budget, open_, target = 1.5 * sum(of.values()), set(names), {}
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > 2 * of[s]]
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * of[s] for s in above}
        open_ -= set(above)
    return size, dict(of), target


def test_mixing(spark, docs, rows, empty):
    size, of, target = plain_mix(rows)
    got = {r["doc_id"]: r for r in mixing.mix(docs, WEIGHTS).collect()}
    taken, largest = Counter(), Counter()
    for r in rows:
        g = got[r[0]]
        assert g["size"] == size[r[0]] and g["source_size"] == of[r[3]] and g["target"] == pytest.approx(target[r[3]])
        assert 0 <= g["taken"] <= 2 * size[r[0]]
        taken[r[3]] += g["taken"]
        largest[r[3]] = max(largest[r[3]], size[r[0]])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in of)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(2), WEIGHTS).collect()}
    assert again == {i: g["taken"] for i, g in got.items()}
    out = mixing.take(docs, WEIGHTS)
    assert out.columns == docs.columns
    often = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert all(often[i] * g["size"] == g["taken"] for i, g in got.items())
    assert mixing.mix(empty, WEIGHTS).count() == 0 and mixing.take(empty, WEIGHTS).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank, WEIGHTS).collect()] == [0, 0]


def test_url_filters(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "https://A.example.com/en/1", link("b.example.org", "c.example.org"), "x"),
        (2, "https://a.example.com/en/77?q#f", link("b.example.org"), "x"),
        (3, "http://n.example.net/de/1", link("t.example.org"), "x"),
        (4, "http://n.example.net/de/81", "", "x"),
        (5, "https://b.example.org/fr/2#top", link("a.example.com", "a.example.com"), "x"),
        (6, "https://t.example.org/fr/2", None, "x"),
        (7, None, None, None),
        (8, "no scheme", "", "x"),
        (9, "https://b.example.org/fr/2#top", link("a.example.com"), "x"),
        (10, "https://xcom/en/1", "", "x"),
        (11, "x://h?://other/en/", "", "x"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urlgraph.judge(df, RULES).collect()}
    assert len(got) == 11
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/1", "com/en/", "block")
    assert (got[2]["rule"], got[2]["verdict"], got[2]["path"]) == ("example.com/en/7", "allow", "/en/77")
    assert got[3]["verdict"] == "allow" and got[4]["verdict"] == "block" and got[4]["rule"] == "example.net/de/8"
    assert got[5]["rule"] is None and got[5]["verdict"] == "block"  # it links to a host with blocked pages
    assert got[6]["verdict"] == "allow" and got[6]["trust"] > 0
    assert (got[7]["host"], got[8]["host"], got[7]["verdict"]) == ("", "", "allow")
    assert got[10]["rule"] is None and (got[11]["host"], got[11]["path"]) == ("h", "")
    assert urlgraph.judge(df.limit(0), RULES).count() == 0


def test_sharding(docs, rows, empty):
    got = {r["doc_id"]: r for r in sharding.place(docs, "doc_id", SHARDS).collect()}
    owner = sharding.fill(SHARDS)
    assert len(got) == len(rows)
    assert all(g["shard"] == SHARDS[owner[g["slot"]]] for g in got.values())
    assert all(g["shard_without_last"] != SHARDS[-1] for g in got.values())
    assert sharding.place(empty, "doc_id", SHARDS).count() == 0
    assert sharding.place(docs, "source", SHARDS).filter("source IS NULL AND slot <> 0").count() == 0
