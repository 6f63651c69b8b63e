"""Parts that need no Spark, against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkprep.llm import attribution, bpe, imatch, jpeg, langid, pii, sharding, textnum

SIGNS = ["a", "B", "é", "1", "²", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'", "'s", "'re", "'ll", "!", "...", "😀", "'S", "漢", "ve", "\u200b", "\x1c", "\x85", "_"]


def random_texts(n, length, signs=SIGNS, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(signs) for _ in range(r.randint(0, length))) for _ in range(n)]


def test_pre_tokens_match_the_pattern():
    texts = [*random_texts(3000, 25), "", None, "' s", "it's", "'s", "'", "'lll", "don't"]
    data, offsets = textnum.view(pa.array(texts, pa.string()))
    starts = bpe.pre_tokens(data, offsets)
    ends, raw = np.append(starts[1:], len(data)), data.tobytes()
    bound = np.searchsorted(starts, offsets)
    pattern = regex.compile(P.PATTERN)
    for i, t in enumerate(texts):
        assert [raw[starts[k] : ends[k]].decode() for k in range(bound[i], bound[i + 1])] == pattern.findall(t or "")


def test_words_and_shingles():
    texts = [*random_texts(500, 30, ["a", "B", "b", " ", "\n", "c d e"]), None, ""]
    data, offsets = textnum.view(pa.array(texts, pa.string()))
    got = textnum.shingles(data, offsets, 3)
    seen = {}
    for t, s in zip(texts, got, strict=True):
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
        assert len(s) == len(want)
        assert seen.setdefault(frozenset(want), tuple(s)) == tuple(s)
    assert len(set(seen.values())) == len(seen)


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 50, 1, 1, 0)])], ["text"])
    parts = list(textnum.slices([batch], limit=10))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) == 3


# -- pictures


@pytest.mark.parametrize("sizes", [[576], [576, 1152, 2880], [24 * 8184 + 576 * 4]])
def test_stored_bytes_come_back(sizes):
    payload = np.random.default_rng(2).integers(0, 256, sum(sizes)).astype(np.uint8)
    media = jpeg.store(payload, np.array(sizes))
    assert all(m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9" for m in media)
    assert b"".join(x.tobytes() for found in jpeg.thumbnails(media) for x in found) == payload.tobytes()
    assert jpeg.feature(jpeg.thumbnails(media)[0]) == jpeg.feature(jpeg.thumbnails(media[:1])[0])


def _encode(planes, sampling, interval):
    """A plain encoder of given quantised blocks: {(component, block row, block column): 64 numbers in zigzag order}."""
    dc, ac = [0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12))
    symbols = sorted({0x00, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)})
    counts = [0] * 16
    counts[8] = 162
    dc_code = {s: (c, n) for c, n, s in jpeg.codes_of(dc, ac)}
    ac_code = {s: (c, n) for c, n, s in jpeg.codes_of(counts, symbols)}
    bits, last, out, units = [], [0] * len(sampling), [], 0

    def put(v, n):
        bits.extend((v >> (n - 1 - i)) & 1 for i in range(n))

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        raw = np.packbits(np.array(bits, np.uint8)).tobytes()
        bits.clear()
        return raw.replace(b"\xff", b"\xff\x00")

    def number(v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    h, w, hmax, vmax = planes["size"]
    for my in range(-(-h // (8 * vmax))):
        for mx in range(-(-w // (8 * hmax))):
            if interval and units and units % interval == 0:
                out += [flush(), bytes([0xFF, 0xD0 + (units // interval - 1) % 8])]
                last = [0] * len(sampling)
            units += 1
            for c, (sh, sv) in enumerate(sampling):
                for by in range(sv):
                    for bx in range(sh):
                        block = planes[c, my * sv + by, mx * sh + bx]
                        n, v = number(block[0] - last[c])
                        last[c] = block[0]
                        put(*dc_code[n])
                        put(v, n)
                        run = 0
                        for x in block[1:]:
                            if x == 0:
                                run += 1
                                continue
                            while run > 15:
                                put(*ac_code[0xF0])
                                run -= 16
                            n, v = number(x)
                            put(*ac_code[run << 4 | n])
                            put(v, n)
                            run = 0
                        if run:
                            put(*ac_code[0])
    out.append(flush())
    seg = jpeg._segment
    frame = b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([c + 1, sh << 4 | sv, 0]) for c, (sh, sv) in enumerate(sampling))
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(jpeg.DQT, b"\0" + bytes([4] * 64)) + seg(jpeg.SOF0, frame)
    head += seg(jpeg.DHT, b"\0" + bytes(dc) + bytes(ac)) + seg(jpeg.DHT, b"\x10" + bytes(counts) + bytes(symbols))
    head += seg(jpeg.DRI, interval.to_bytes(2, "big")) if interval else b""
    scan = bytes([len(sampling)]) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + b"\0\x3f\0"
    return head + seg(jpeg.SOS, scan) + b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize(("sampling", "interval"), [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 2), ([(2, 1), (1, 1), (1, 1)], 0)])
def test_coefficients_of_any_baseline_picture(sampling, interval):
    rng = np.random.default_rng(7)
    hmax, vmax = sampling[0] if len(sampling) > 1 else (1, 1)
    h, w = 50, 75
    planes = {"size": (h, w, hmax, vmax)}
    down, across = -(-h // (8 * vmax)), -(-w // (8 * hmax))
    for c, (sh, sv) in enumerate(sampling):
        for y in range(down * sv):
            for x in range(across * sh):
                block = np.where(rng.random(64) < 0.15, rng.integers(-60, 60, 64), 0).tolist()
                block[0] = int(rng.integers(-120, 120))
                planes[c, y, x] = block
    found = jpeg.thumbnails([_encode(planes, sampling, interval), b"no picture", b""])
    want = [[min(255, max(0, (planes[0, y, x][0] * 4 + 4 >> 3) + 128)) for x in range(-(-w // 8))] for y in range(-(-h // 8))]
    assert found[0][0].tolist() == want and found[1] is None and found[2] == []


# -- personal data


def plain_spans(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-+ 0123456789()%\n,é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_texts():
    for text in ("1" * 100_000, "1." * 50_000, "+" * 50_000, "a@" * 50_000, "1-" * 30_000):
        assert pii.base_spans(text) == [] or text.startswith("1.")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_redaction_merges_overlaps():
    assert pii.redacted("x 1.2.3.4 y", [(2, 9, 1)]) == "x [IP] y"
    assert pii.redacted("abcdef", [(1, 4, 0), (2, 5, 2)]) == "a[EMAIL]f"
    assert pii.redacted("", []) == ""


# -- the rest


def test_fingerprints_grade_likeness():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    a = [r.choice(vocabulary) for _ in range(300)]
    b = a[:150] + [r.choice(vocabulary) for _ in range(150)]
    c = [r.choice(vocabulary) for _ in range(300)]
    own = imatch.terms(pa.array([" ".join(x) for x in (a, a[:299] + ["new"], b, c)] + ["", None], pa.string()))
    lexicon = np.unique(np.concatenate(own))
    code = [imatch.codes(x, lexicon) for x in own]
    likes = [imatch.likeness(code[0], x) for x in code]
    assert likes[0] == 1 and likes[0] > likes[1] > likes[2] > likes[3]
    assert imatch.likeness(code[4], code[5]) == 1 and imatch.likeness(code[0], code[4]) == 0
    assert imatch.text_of(code[4]) == "0" * 4 * sum(imatch.SUBSETS)


def test_edited_text():
    assert imatch.edited("abcde", "XYZ") == "abcXY" and imatch.edited("abcdef", "X") == "abcX" and imatch.edited("", "X") == ""


def test_tokens_add_up():
    ends, bounds = np.array([3, 5, 9, 10]), np.array([0, 4, 10])
    n, over = attribution.allocate(ends, bounds)
    assert n.tolist() == [2, 2] and over.tolist() == [1, 0]  # the token 3-5 is shared equally
    n, over = attribution.allocate(np.array([6]), np.array([0, 1, 5, 6]))
    assert n.tolist() == [0, 1, 0] and over.tolist() == [0, 1, 0]
    assert attribution.section_bounds(b"a\nb\n", b"\n").tolist() == [0, 2, 4]


def test_language_model_learns_and_calibrates():
    r = random.Random(1)
    texts, labels = [], []
    for lang, parts in (("xx", ["the", "and", "ing"]), ("yy", ["der", "und", "sch"]), ("zz", ["que", "los", "ñar"])):
        for _ in range(80):
            texts.append(" ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(12)))
            labels.append(lang)
    model = langid.train(texts, labels)
    assert sum(model.predict(t)[0] == x for t, x in zip(texts, labels, strict=True)) >= 235
    again = langid.Model.from_json(model.to_json())
    assert again.predict(texts[0])[0] == model.predict(texts[0])[0]
    assert model.predict(None) == model.predict("12 34 !!") == model.predict("") == ("und", 0.0)
    assert langid.train([], []).predict("abc") == ("und", 0.0)
    assert 0 <= model.predict("the " * 200_000)[1] <= 1


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(13)]
    owner = sharding.fill(names, 1009)
    assert np.ptp(np.bincount(owner)) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = (owner != fewer) & (owner != 12)
    assert moved.mean() < 0.25
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


@pytest.mark.parametrize(("n", "slots"), [(1, 2), (3, 7), (5, 13), (7, 101)])
def test_lookup_table_against_whole_permutations(n, slots):
    names = [f"node {i}" for i in range(n)]
    number = lambda s: int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big")
    wishes = [[(number(f"{s}/offset") % slots + j * (number(f"{s}/skip") % (slots - 1) + 1)) % slots for j in range(slots)] for s in names]
    assert all(sorted(w) == list(range(slots)) for w in wishes)
    owner = {}
    for turn in range(slots):
        owner[next(s for s in wishes[turn % n] if s not in owner)] = turn % n
    assert sharding.fill(names, slots).tolist() == [owner[i] for i in range(slots)]


def test_ranks_are_read():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        first = f.readline().split()
    assert bpe.read_ranks(path)[base64.b64decode(first[0])] == int(first[1])
    assert zlib.crc32(b"1") % 3 in (0, 1, 2)
