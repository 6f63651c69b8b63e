"""Operators against plain versions of their methods, and against inputs that are made to break them."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from sparkprep.llm import attribution, bpe, imatch, jaccard_join, jpeg, langid, pii, sharding, textnum
from sparkprep.llm.common import importable

from .test_operators import PATH, plain_components, words

ENC = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def twins(n):
    """Words whose polynomial hashes modulo 2**64 are equal from 2048 letters on, whatever the base."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in odd), "".join("ba"[b] for b in odd)


@pytest.fixture(scope="module")
def twin_docs(spark):
    importable(spark)
    rows = [(10 * n + i, f"x {w} y {w} z") for n in (512, 1024, 2048, 4096) for i, w in enumerate(twins(n))]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_long_words_that_a_polynomial_confuses(spark, twin_docs):
    text = {r["doc_id"]: r["text"] for r in twin_docs.collect()}
    for r in bpe.encode(twin_docs, PATH, P.PATTERN, digests=True).collect():
        ids = ENC.encode_ordinary(text[r["doc_id"]])
        assert bytes(r["token_ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    prints = {r["fingerprint"] for r in imatch.fingerprints(twin_docs, common=1.0).collect()}
    assert len(prints) == len(text)
    assert {r["component_id"] for r in jaccard_join.join(twin_docs).collect()} == set(text)
    hashed = {int(pii._hash_word(w)) for n in (512, 1024, 2048, 4096) for w in twins(n)}
    assert len(hashed) == 8


def test_words_that_share_a_hash_are_told_apart():
    data = np.frombuffer(b"abcabdabcxyabd", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 11]), np.array([3, 6, 9, 11, 14])
    _, where, which = textnum.distinct_spans(data, starts, ends, np.full(5, 7, np.uint64))
    assert len(where) == 3 and which[0] == which[2] and which[1] == which[4] and len({*which.tolist()}) == 3


def test_bpe_takes_any_pattern_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "ab12 cd", "x"), (2, None, "y")], "doc_id long, text string, N_TOKENS string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, r"[a-z]+|[0-9]").select("doc_id", "n_tokens", "token_ids").collect()}
    ids = [i for m in re.findall("[a-z]+|[0-9]", "ab12 cd") for i in ENC.encode_ordinary(m)]
    assert bytes(got[1]["token_ids"]) == struct.pack(f"<{len(ids)}I", *ids) and got[2]["n_tokens"] == 0


def plain_fingerprints(texts, rare, common):
    """By integers and loops."""
    mask = 2**64 - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def hashed(word):
        return int(textnum.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])

    low = lambda t: re.sub(b"[A-Z]", lambda m: m.group().lower(), (t or "").encode())
    own = [{hashed(w) for w in re.findall(rb"[^ \t-\r]+", low(t))} for t in texts]
    df = Counter(w for s in own for w in s)
    lexicon = {w for w, n in df.items() if max(1, math.ceil(len(texts) * rare)) <= n <= len(texts) * common}
    base = int(textnum._BASE)
    out = []
    for s in own:
        kept = sorted((s & lexicon) | set(sorted(s - lexicon)[: imatch.OTHERS]))
        marks = []
        for k, (level, _) in enumerate((lev, i) for lev, n in enumerate(imatch.SUBSETS, 1) for i in range(n)):
            seed, total, place = mix(k + 1), 0, 0
            for w in kept:
                draw = mix(w ^ seed)
                if draw < 1 << 64 - level:
                    total = (total + draw * pow(base, place, 2**64)) & mask
                    place += 1
            marks.append(max(1, mix(total) >> 48) if place else 0)
        out.append("".join(f"{m:04x}" for m in marks))
    return out


def test_fingerprints(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [words(r, r.randint(1, 60), vocabulary) for _ in range(40)] + [None, "", "Solo", "solo " * 3, words(r, 5000, [f"v{i}" for i in range(6000)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["fingerprint"] for x in imatch.fingerprints(docs, 0.05, 0.3).collect()}
    assert [got[i] for i in range(len(texts))] == plain_fingerprints(texts, 0.05, 0.3)


def plain_bootstrap(texts, support=3, rounds=4, accept=0.8):
    """Confidences by (kind, words), with dicts."""
    lower = lambda w: re.sub("[A-Z]", lambda m: m.group().lower(), w)

    def around(text, start, end):
        spots = [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text)]
        at = [i for i, (s, _) in enumerate(spots) if s == start]
        if not at or not at[0]:
            return []
        word = lambda i: lower(text[slice(*spots[i])])
        i = at[0]
        last = [j for j, (_, e) in enumerate(spots) if e == end]
        return [("l", word(i - 1))] + ([("ll", word(i - 2), word(i - 1))] if i > 1 else []) + ([("lr", word(i - 1), word(last[0] + 1))] if last and last[0] + 1 < len(spots) else [])

    sure, other, seen = Counter(), Counter(), Counter()
    for t in texts:
        w = [lower(x) for x in re.findall(r"[^ \t-\r]+", t)]
        seen.update(("l", x) for x in w)
        seen.update(("ll", *x) for x in zip(w, w[1:]))
        seen.update(("lr", *x) for x in zip(w, w[2:]))
        base = pii.base_spans(t)
        spans = [(s, e, k, sure) for s, e, k in base] + [(s, e, k, other) for s, e, kinds in pii.candidates(t, base) for k in kinds]
        for s, e, k, count in spans:
            value = t[s:e].lower() if k == 0 else re.sub("[^0-9]", "", t[s:e])
            for p in around(t, s, e):
                count[k, p, value] += 1
    edges = {*sure, *other}
    reliable, confidence = defaultdict(float), {}
    for _ in range(rounds):
        confidence = {}
        by = defaultdict(set)
        for k, p, v in edges:
            by[k, p].add(v)
        for (k, p), values in by.items():
            if len(values) < support or sum(1 for v in values if sure[k, p, v] or reliable[k, v] >= accept) < support:
                continue
            right = sum(sure[k, p, v] + other[k, p, v] * reliable[k, v] for v in values)
            confidence[k, p] = right / max(right, seen.get(p, right), 1)
        doubt = defaultdict(lambda: 1.0)
        for k, p, v in edges:
            if (k, p) in confidence:
                doubt[k, v] *= 1 - min(confidence[k, p], 0.999999)
        reliable = defaultdict(float, {key: 1 - d for key, d in doubt.items()})
    return around, {key: c for key, c in confidence.items() if c > 0.01}


def bootstrap_corpus():
    r = random.Random(7)
    plus = lambda: f"+49{r.randint(10**8, 10**9)}"
    rows = [f"well then my phone is {plus()} call me" for _ in range(20)]
    local = [f"{r.randint(10**8, 10**9 - 1)}" for _ in range(12)]
    rows += [f"well then my phone is {x} call me" for x in local]  # found by the seeds' contexts
    rows += [f"please ring number {x} tonight" for x in local]  # which gives this context
    rows += [f"please ring number {r.randint(10**8, 10**9 - 1)} tonight" for _ in range(4)]  # so these are found
    rows += [f"the invoice {r.randint(10**8, 10**9 - 1)} is due" for _ in range(10)]
    rows += ["what is the number of my phone", "the phone is good", None, "", "Name <x@y>, a@b.example and 0044 20 7946 0958"]
    return rows


def test_bootstrap(spark):
    rows = bootstrap_corpus()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    around, want = plain_bootstrap([t or "" for t in rows])
    got = sorted(round(x["confidence"], 9) for x in pii.learn(docs).collect())
    assert got == sorted(round(c, 9) for c in want.values())
    spans = {}
    for i, t in enumerate(rows):
        t = t or ""
        base = pii.base_spans(t)
        more = []
        for s, e, kinds in pii.candidates(t, base):
            score = {k: 1 - math.prod(1 - want.get((k, p), 0.0) for p in around(t, s, e)) for k in kinds}
            k = min(score, key=lambda k: (-score[k], k))
            more += [(s, e, k)] * (score[k] >= 0.8)
        spans[i] = pii.written(base + more)
    assert {x["doc_id"]: x["spans"] for x in pii.find(docs).collect()} == spans
    assert {x["doc_id"]: x["spans"] for x in pii.find(docs, few=0).collect()} == spans  # by the join
    assert all(spans[i] for i in range(48)) and not any(spans[i] for i in range(48, 58))


def test_candidates_of_odd_forms():
    found = lambda t: [(t[s:e], k) for s, e, k in pii.candidates(t, pii.base_spans(t))]
    assert [x for x, _ in found("555 123 4567 555 123 4568 555 123 4569")] == ["555 123 4567", "555 123 4568", "555 123 4569"]
    assert found("x 0044 20 7946 0958") == [("0044 20 7946 0958", [2, 3])]
    long = "a" * 500 + "@" + "b" * 500
    assert found(long) == [(long, [0])]
    assert found("1" * 100_000) == [] and found("@" * 10_000) == []


def test_malformed_pictures(spark):
    media = jpeg.store(np.arange(1152, dtype=np.int64).astype(np.uint8), np.array([1152]))[0]
    r = random.Random(1)
    cut = [media[:n] for n in range(0, len(media), 11)]
    noise = []
    for _ in range(200):
        b = bytearray(media)
        for _ in range(4):
            b[r.randrange(len(b))] = r.randrange(256)
        noise.append(bytes(b))
    at = media.index(b"\xff\xc0")
    size = lambda h, w: media[: at + 5] + struct.pack(">HH", h, w) + media[at + 9 :]
    dri = media.index(b"\xff\xdd")
    whole = lambda m: m[:dri] + m[dri + 6 :]
    odd = [size(65535, 65535), size(0, 0), whole(size(16000, 1600)), b"\xff\xd8\xff\xdb\x00\x03\x00", b"\xff\xd8\xff\xdb\x00\x13\x10" + bytes(16), b"\xff\xd8\xff\xc4\x00\x03\x00", b"\xff\xd8" * 50, b""]
    got = jpeg.thumbnails([*cut, *noise, *odd, media])
    assert got[-1] is not None and [x for x in got[: len(cut)] if x] == []
    assert [x for x in got[len(cut) + len(noise) : -1] if x] == []
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*odd, media, None])], "id int, media binary")
    assert [x["id"] for x in jpeg.features(df, "media").filter("feature IS NOT NULL").collect()] == [len(odd)]


def plain_parts(whole, bounds):
    """(tokens, crossing) of each part; bounds are in bytes."""
    n, over, at = [0] * (len(bounds) - 1), [0] * (len(bounds) - 1), 0
    for i in ENC.encode_ordinary(whole):
        end = at + len(ENC.decode_single_token_bytes(i))
        shared = [max(0, min(end, b) - max(at, a)) for a, b in zip(bounds, bounds[1:])]
        to = shared.index(max(shared))
        n[to] += 1
        over[to] += sum(s > 0 for s in shared) > 1
        at = end
    return list(zip(n, over))


def test_counts_of_parts(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "é", " ", "\n", "\n\n", "word", "😀", "1"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, "W") for i, t in enumerate(texts)], "doc_id long, text string, none string, whole_text string")
    got = defaultdict(dict)
    for x in attribution.section_tokens(docs, PATH, P.PATTERN, ["doc_id"]).collect():
        got[x["doc_id"]][x["part"]] = (x["n_tokens"], x["n_crossing"])
    for i, t in enumerate(texts):
        raw = t.encode()
        bounds = [0, *(m.end() for m in re.finditer(b"\n", raw) if m.end() < len(raw)), len(raw)]
        assert [got[i][k] for k in sorted(got[i])] == (plain_parts(t, bounds) if raw else [(0, 0)])
    fields = attribution.field_tokens(docs, ["text", "none", "whole_text"], PATH, P.PATTERN, ["doc_id", "whole_text", "none"]).collect()
    by = defaultdict(dict)
    for x in fields:
        assert x["whole_text"] == "W"
        by[x["doc_id"]][x["part"]] = (x["n_tokens"], x["n_crossing"])
    for i, t in enumerate(texts):
        n = len(t.encode())
        assert [by[i][k] for k in range(3)] == plain_parts(f"{t}\n\nW", [0, n + 1, n + 2, n + 3])


def plain_ftrl(rows, labels, langs, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
    """One weight at a time."""
    seen = [i for i in range(len(rows)) if i % 5]
    df = Counter(s for i in seen for s in rows[i])
    idf = defaultdict(lambda: math.log(1 + len(seen)) + 1, {s: math.log((1 + len(seen)) / (1 + n)) + 1 for s, n in df.items()})
    z, n2 = defaultdict(float), defaultdict(float)

    def weight(s, c):
        x = z[s, c]
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n2[s, c])) / alpha + l2)

    def inputs(i):
        total = sum(rows[i].values())
        return {s: n / total * idf[s] * langid.SCALE for s, n in rows[i].items()} | {"bias": 1.0}

    for epoch in range(3):
        for i in np.random.default_rng(epoch).permutation(seen).tolist():
            x = inputs(i)
            w = {(s, c): weight(s, c) for s in x for c in langs}
            raw = {c: sum(v * w[s, c] for s, v in x.items()) for c in langs}
            top = max(raw.values())
            part = sum(math.exp(v - top) for v in raw.values())
            for c in langs:
                miss = math.exp(raw[c] - top) / part - (labels[i] == c)
                for s, v in x.items():
                    g = v * miss
                    step = (math.sqrt(n2[s, c] + g * g) - math.sqrt(n2[s, c])) / alpha
                    z[s, c] += g - step * w[s, c]
                    n2[s, c] += g * g
    raw = [[sum(v * weight(s, c) for s, v in inputs(i).items()) for c in langs] for i in range(0, len(rows), 5)]

    def loss(t):
        total = 0.0
        for i, row in zip(range(0, len(rows), 5), raw):
            top = max(row)
            total += math.log(sum(math.exp((v - top) / t) for v in row)) - (row[langs.index(labels[i])] - top) / t
        return total / len(raw)

    return weight, idf, min(np.geomspace(0.25, 8, 41), key=loss)


def test_training():
    r = random.Random(8)
    texts = ["".join(r.choice(a) for _ in range(12)) for _ in range(20) for a in ("abc d", "cde f", "xyz a")]
    labels = ["p", "q", "r"] * 20
    model = langid.train(texts, labels)
    rows = [Counter(int(x) for g in langid.grams(t) for x in g) for t in texts]
    weight, idf, temperature = plain_ftrl(rows, labels, ["p", "q", "r"])
    for k, c in enumerate("pqr"):
        assert model.bias[k] == pytest.approx(weight("bias", c))
        for s in {s for row in rows for s in row}:
            assert model.weights[s, k] == pytest.approx(weight(s, c) * idf[s], rel=1e-5, abs=1e-9)
    assert model.temperature == pytest.approx(temperature)


def test_grams_of_long_texts_and_letters(monkeypatch):
    text = "Straße Łódź 12 " * 50
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (np.sort(np.concatenate(list(langid.grams(text)))) == whole).all()
    model = langid.train(["abc", "abd", "xyz", "xyw"], ["p", "p", "q", "q"])
    assert all(model.predict(t) == (langid.UND, 0.0) for t in ("½ ²", "①", "Ⅷ", "12 !", "", None))
    assert model.predict("ª")[0] != langid.UND and model.predict("字")[0] != langid.UND


def test_copies_do_not_fill_the_sample(spark):
    rows = [("copy of one text", "xx")] * 500 + [(f"own text {i}", "xx") for i in range(50)] + [(f"andere worte {i}", "yy") for i in range(50)]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    one, two = (langid.fit(labelled.repartition(n), 40).to_json() for n in (2, 5))
    assert one == two
    assert langid.fit(labelled, 40).predict("andere worte 7")[0] == "yy"


def near_rows(r, n):
    sets = [set(r.sample(range(60), r.randint(8, 30))) for _ in range(n)]
    for i in range(0, n, 3):
        sets[i] = set(list(sets[0])[: r.randint(6, 30)]) | {100 + i}
    return [np.sort(textnum.mix(np.array(sorted(s), np.uint64))) for s in sets]


@pytest.mark.parametrize(("long", "seed"), [(1000, 1), (1000, 2), (3, 3), (3, 4)])
def test_walk_through_lists(monkeypatch, long, seed):
    """Every pair of different labels that links and passes size and position comes out, whichever way a list is walked."""
    monkeypatch.setattr(jaccard_join, "LONG", long)
    r = random.Random(seed)
    sets = near_rows(r, 60)
    lists = [r.sample(range(60), r.randint(2, 40)) for _ in range(12)]
    label = [r.randrange(6) if r.random() < 0.5 else 100 + i for i in range(60)]
    rows = [(t, 0, 0, 0, i, len(sets[i]), 0, label[i], i, 0) for t, ids in enumerate(lists) for i in ids]
    cols = {c: np.array([x[k] for x in rows], np.int64) for k, c in enumerate(("token", "one", "two", "own", "id", "n", "pos", "label", "ref", "d"))}
    maps = {i: jaccard_join.parity(s, max(8, 1 << len(s).bit_length())) for i, s in enumerate(sets)}
    got = set(jaccard_join._Near(cols, maps, 80).pairs())
    for ids in lists:
        for a in ids:
            for b in ids:
                both = len(np.intersect1d(sets[a], sets[b]))
                if a < b and label[a] != label[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    assert (a, b) in got
    assert all(label[a] != label[b] for a, b in got)


def test_join_with_lists_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST", 4)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)]
    base = words(r, 80, vocabulary).split()
    rows = []
    for i in range(50):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(80)] = r.choice(vocabulary)
        rows.append((i, " ".join(w[: r.randint(60, 80)])))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == plain_components(rows, 3, 80)


def test_join_with_several_texts_of_one_id(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    a, b, c = (words(r, 80, vocabulary) for _ in range(3))
    near = lambda t, x: " ".join([*t.split()[:-1], x])
    rows = [(5, a), (5, b), (9, near(b, "x")), (8, near(a, "y")), (7, c), (6, near(c, "z")), (3, c + " " + words(r, 40, vocabulary))]
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == {5: 5, 9: 5, 8: 5, 7: 6, 6: 6, 3: 3}


def test_near_duplicates_stage_tells_rows_apart(spark, tmp_path):
    """Rows without an id take part; different texts under one id both stay; of equal rows one does."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    a, b, c = (words(r, 60, vocabulary) for _ in range(3))
    near = " ".join(a.split()[:-1] + ["zzz"])
    rows = [(7, a, 1), (7, b, 2), (None, near, 3), (None, c, 4), (None, c, 5), (3, near, 6), (9, None, 7), (10, "", 8), (11, "one", 9), (11, "one", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, a int").repartition(4).write.parquet(f"{tmp_path}/d")
    for docs in (spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame(rows, "doc_id long, text string, a int")):
        kept = Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
        assert kept == Counter([(3, near), (7, b), (None, c), (9, None), (10, ""), (11, "one")])


def test_slots_are_of_md5(spark):
    got = sharding.place(spark.range(50).toDF("k"), "k", ["a", "b", "c"], 101).collect()
    assert all(x["slot"] == int(hashlib.md5(str(x["k"]).encode()).hexdigest()[:15], 16) % 101 for x in got)
    assert pa.array([x["slot"] for x in got]).null_count == 0
