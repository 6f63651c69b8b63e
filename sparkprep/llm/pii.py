"""Personal data: fixed forms, and more of it found by the contexts those stand in.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers of a strict form. They are the seeds of a
bootstrap. Each span induces lexical patterns: the word on its left, the two words there, or the one and the word on its
right. A candidate is a string of identifier-like form that isn't a base span: a number that fails its check, a phone
number without a plus; it may be of several kinds. Spark builds the graph of patterns and instances (whole corpus, summed by
task first), and counts how often each pattern occurs at all. Then, in turns:

* a pattern that ``support`` different trusted instances stand in has a confidence: the reliability of the instances it goes
  with over all its occurrences;
* an instance's reliability is that one of its patterns at least is right; from ``accept`` on it is trusted like a seed, so
  that in the next turn it makes patterns of its own.

In the end the candidates whose own contexts reach ``accept`` become spans of the kind that fits best. Words such as "the"
precede many seeds, and far more other words, so their confidence is nearly nought.

All patterns of enough instances are scored, however many the corpus has: the graph stays in Spark. What goes to all tasks is a
bitmap of 2**23 bits that tells which contexts to count (the join after it is exact), and the patterns' confidences if there
are at most ``FEW`` of them; beyond that, candidates are joined with the patterns in Spark.

Null text is empty and has no spans. Offsets are in code points. Very long texts are read whole. Repeated rows and equal texts
have equal spans; repeated instances count once for support; of kinds that score the same, the first one listed wins. Empty
tables give empty results; other columns pass.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, without
from .textnum import LOWER, U64, mix, slices, span_hashes, view, words

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the fixed forms. None of their parts can give back characters, so possessive ones match the same.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
REGION = re.compile(r"[0-9][0-9 .-]*")
#: The form of candidates: runs of digits and what may stand between them.
NUMBER = re.compile(r"[0-9(][0-9 ().-]*[0-9]")
RUN = re.compile(r"[^ \t-\r]+")
#: Bits of the map of contexts, and how many patterns are sent to all tasks.
BITS, FEW = 1 << 23, 1 << 17

Span = tuple[int, int, int]  # start, end, index of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _part(text: str) -> bool:
    text = text.lstrip("0")
    return len(text) < 4 and (not text or int(text) <= 255)


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done, 0))
        at = text.find("@", max(at + 1, done))
    for region in REGION.finditer(text):
        if region.end() - region.start() < 7:
            continue
        for m in IP.finditer(text, *region.span()):
            if all(map(_part, m.group().split("."))):
                out.append((*m.span(), 1))
        for m in CARD.finditer(text, *region.span()):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def kinds_of(text: str) -> list[int]:
    """Those that a candidate may be of, by its form."""
    if "@" in text:
        return [0]
    n = len(_digits(text))
    form = {
        1: re.fullmatch(r"[0-9]{1,4}(?:\.[0-9]{1,4}){3}", text),
        2: 12 <= n <= 19 and not re.search(r"[().]", text),
        3: 7 <= n <= 15,
    }
    return [k for k, fits in form.items() if fits]


def _gaps(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The ranges that no span covers; spans come by start."""
    at = 0
    for s, e in taken:
        if s > at:
            yield at, s
        at = max(at, e)
    if at < len(text):
        yield at, len(text)


def _divided(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A run of digit groups, as numbers: itself if it has at most 19 digits; else, as its groups repeat, by the longest such
    repetition of at most 19 digits; else by its groups.
    """
    if sum(c.isdigit() for c in text[start:end]) <= 19:
        yield start, end
        return
    groups = [(m.start(), m.end()) for m in re.finditer("[^ ]*[0-9]", text[start:end])]
    size = [len(_digits(text[start + a : start + b])) for a, b in groups]
    period = 1
    for p in range(2, min(20, len(groups))):
        if len(groups) % p == 0 and sum(size[:p]) <= 19 and size[p:] == size[:-p]:
            period = p
    for i in range(0, len(groups), period):
        yield start + groups[i][0], start + groups[i + period - 1][1]


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, list[int]]]:
    """(start, end, kinds) of strings of an identifier's form that overlap no base span and not each other, by start."""
    out: list[tuple[int, int, list[int]]] = []
    taken = sorted((s, e) for s, e, _ in base)
    if "@" in text:
        for a, b in _gaps(text, taken):
            for run in re.finditer(r"\S+", text[a:b]):
                at = a + run.start()
                parts = run.group().split("@")
                i = 0
                while i + 1 < len(parts):
                    if parts[i] and parts[i + 1]:
                        e = at + len(parts[i]) + 1 + len(parts[i + 1])
                        out.append((at, e, [0]))
                        at, i = e + 1, i + 2
                    else:
                        at, i = at + len(parts[i]) + 1, i + 1
        taken = sorted([*taken, *((s, e) for s, e, _ in out)])
    for a, b in _gaps(text, taken):
        for m in NUMBER.finditer(text, a, b):
            for s, e in _divided(text, *m.span()):
                if (kinds := kinds_of(text[s:e])) and not (s and text[s - 1].isalnum() or e < len(text) and text[e].isalnum()):
                    out.append((s, e, kinds))
    return sorted(out)


def _hash_word(word: str) -> U64:
    data = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0]


def _combine(shape: int, *parts: np.ndarray) -> np.ndarray:
    total = np.full(len(parts[0]), shape, U64)
    for p in parts:
        total = mix(total * U64(31) + p)
    return total


class Words:
    """Where the words of a text are."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = [], []
        for m in RUN.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def hashed(self, i: int) -> np.ndarray:
        return np.array([_hash_word(self.text[self.starts[i] : self.ends[i]])])

    def contexts(self, start: int, end: int) -> list[int]:
        """The patterns around a span that stands for one word; it must start where a word starts."""
        before = bisect.bisect_left(self.starts, start)
        if not before or before == len(self.starts) or self.starts[before] != start:
            return []
        left = self.hashed(before - 1)
        out = [_combine(1, left)]
        if before > 1:
            out.append(_combine(2, self.hashed(before - 2), left))
        after = bisect.bisect_left(self.starts, end)
        if after < len(self.starts) and self.ends[after - 1] == end:
            out.append(_combine(3, left, self.hashed(after)))
        return [int(x.view(np.int64)[0]) for x in out]


def _bit(patterns: np.ndarray) -> np.ndarray:
    return patterns & np.int64(BITS - 1)


def occurrences(batch: pa.RecordBatch, wanted: np.ndarray) -> np.ndarray:
    """The patterns that the words stand in, whatever is between them or follows, as far as their bit is ``wanted``."""
    data, offsets = view(batch.column("text"))
    low = LOWER[data]
    starts, ends, bound = words(low, offsets)
    one = span_hashes(low, starts, ends)
    text = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    found = [_combine(1, one)]
    if len(one) > 1:
        found.append(_combine(2, one[:-1], one[1:])[text[:-1] == text[1:]])
    if len(one) > 2:
        found.append(_combine(3, one[:-2], one[2:])[text[:-2] == text[2:]])
    every = np.concatenate(found).view(np.int64)
    return every[wanted[_bit(every)]]


def _occurrences(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value.view(np.uint8), bitorder="little").astype(bool)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pattern, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n.astype(np.int64))], ["pattern", "n"])

        for batch in slices(batches):
            held.append(occurrences(batch, bits))
            size += len(held[-1])
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


EDGES = "kind int, pattern long, instance long, seed boolean, n long"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in count.items()]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "pattern", "instance", "seed", "n"])

    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            base = base_spans(text)
            spans = [(s, e, k, True) for s, e, k in base] + [(s, e, k, False) for s, e, kinds in candidates(text, base) for k in kinds]
            if not spans:
                continue
            own = Words(text)
            for s, e, kind, seed in spans:
                value = text[s:e].lower() if kind == 0 else _digits(text[s:e])
                instance = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)
                for p in own.contexts(s, e):
                    count[kind, p, instance, seed] += 1
        if len(count) > 100_000:
            yield flush()
            count.clear()
    if count:
        yield flush()


def learn(docs: DataFrame, support: int = 3, rounds: int = 4, accept: float = 0.8) -> DataFrame:
    """(kind, pattern, confidence) of every pattern that enough trusted instances stand in."""
    edges = docs.select("text").mapInArrow(_edges, EDGES)
    sure, other = (F.sum(F.when(F.col("seed") == v, F.col("n")).otherwise(0)).alias(c) for v, c in ((True, "sure"), (False, "other")))
    edges = cut(edges.groupBy("kind", "pattern", "instance").agg(sure, other), "pii-edges")
    many = edges.groupBy("kind", "pattern").agg(F.count("*").alias("m")).filter(F.col("m") >= support).select("kind", "pattern")
    many = cut(many, "pii-patterns")
    # What else the words of those patterns stand before.
    bit = F.col("pattern").bitwiseAND(BITS - 1)
    bits = many.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pattern & {BITS - 1} & 63 as int))")).alias("bits"))
    wanted = np.zeros(BITS // 64, np.int64)
    for r in bits.toArrow().to_pylist():  # a row for each 64 bits of the map
        wanted[r["at"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    seen = docs.select("text").mapInArrow(_occurrences(shared), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("seen"))
    seen = cut(seen.join(many.select("pattern").distinct(), "pattern", "left_semi"), "pii-seen")
    shared.destroy()
    graph = cut(edges.join(many, ["kind", "pattern"]).join(seen, "pattern", "left"), "pii-graph")
    # Seeds are trusted; of the rest nothing is known yet.
    scored = graph.withColumn("reliable", F.lit(0.0))
    for i in range(rounds):
        trusted = (F.col("sure") > 0) | (F.col("reliable") >= accept)
        right = F.sum(F.col("sure") + F.col("other") * F.col("reliable"))
        patterns = scored.groupBy("kind", "pattern").agg(F.count(F.when(trusted, 1)).alias("m"), right.alias("right"), F.max("seen").alias("seen"))
        # A span of several words counts for its context as well.
        confidence = F.col("right") / F.greatest("right", F.coalesce("seen", "right"), F.lit(1))
        patterns = cut(patterns.filter(F.col("m") >= support).select("kind", "pattern", confidence.alias("confidence")), "pii-confidence")
        if i < rounds - 1:
            doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999999))))
            reliable = graph.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(doubt)).alias("reliable"))
            scored = graph.join(reliable, ["kind", "instance"], "left").withColumn("reliable", F.coalesce("reliable", F.lit(0.0)))
    return patterns.filter("confidence > 0.01")


def asked(text: str, base: list[Span]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(start, end, kind, patterns) of the candidates, for each kind that one may be of."""
    if found := candidates(text, base):
        own = Words(text)
        for s, e, kinds in found:
            patterns = own.contexts(s, e)
            yield from ((s, e, k, patterns) for k in kinds)


def best(scores: dict[tuple[int, int], tuple[float, int]], span: tuple[int, int], score: float, kind: int) -> None:
    """Keeps the kind that scores best, of equal ones the first."""
    scores[span] = max(scores.get(span, (0.0, 0)), (score, -kind))


def more_spans(text: str, base: list[Span], confidence: dict[tuple[int, int], float], accept: float) -> list[Span]:
    scores: dict[tuple[int, int], tuple[float, int]] = {}
    for s, e, kind, patterns in asked(text, base) if confidence else ():
        best(scores, (s, e), 1 - math.prod(1 - confidence.get((kind, p), 0.0) for p in patterns), kind)
    return [(s, e, -k) for (s, e), (score, k) in scores.items() if score >= accept]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [
            (row, s, e, kind, p)
            for row, text in zip(batch.column("__pii_row").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for s, e, kind, patterns in asked(text or "", base_spans(text or ""))
            for p in patterns
        ]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["__pii_row", "start", "end", "kind", "pattern"])


def _joined(docs: DataFrame, patterns: DataFrame, accept: float) -> DataFrame:
    """``docs`` with __pii_more: the spans that ``more_spans`` would find, by a join of the candidates' contexts with the patterns."""
    rows = cut(docs.withColumn("__pii_row", F.monotonically_increasing_id()), "pii-rows")
    ask = rows.select("__pii_row", "text").mapInArrow(_asked, "__pii_row long, start long, end long, kind int, pattern long")
    doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-15)))))
    scored = ask.join(patterns, ["kind", "pattern"]).groupBy("__pii_row", "start", "end", "kind").agg((1 - doubt).alias("score"))
    kind = F.max_by(F.col("kind"), F.struct("score", -F.col("kind"))).alias("kind")
    found = scored.filter(F.col("score") >= accept).groupBy("__pii_row", "start", "end").agg(kind)
    found = found.groupBy("__pii_row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("__pii_more"))
    return rows.join(found, "__pii_row", "left").drop("__pii_row")


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2])))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find(docs: DataFrame, accept: float = 0.8, redact: bool = False, keep: list[str] | None = None, few: int = FEW) -> DataFrame:
    """``keep`` (all columns unless given) with the counts of base spans, base_sha256, spans (all), and redacted.

    The new columns replace any of their names. redacted is the text with each span replaced by its kind in brackets, null unless ``redact``.
    few: so many patterns at most are sent to all tasks.
    """
    new = [c.split()[0] for c in FOUND.split(", ")]
    keep = without(docs.columns if keep is None else keep, [*new, "__pii_row", "__pii_more"])
    patterns = learn(docs, accept=accept)
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    known = patterns.limit(few + 1).collect()
    if joined := len(known) > few:
        docs, known = _joined(docs, patterns, accept), []
    confidence = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["pattern"]): r["confidence"] for r in known})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            more = batch.column("__pii_more").to_pylist() if joined else itertools.repeat(None, batch.num_rows)
            for text, found in zip(batch.column("text").to_pylist(), more, strict=True):
                base = base_spans(text or "")
                found = [(x["start"], x["end"], x["kind"]) for x in found or ()] if joined else more_spans(text or "", base, confidence.value, accept)
                spans = base + found
                counts = [sum(s[2] == k for s in base) for k in range(4)]
                clean = redacted(text, spans) if redact and text is not None else None
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), clean))
            kinds = (*(pa.int64(),) * 4, *(pa.string(),) * 3)
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, *new])

    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(FOUND).fields])
    return docs.mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """Spans that overlap become one, of the first one's kind."""
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda s: (s[0], s[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text
