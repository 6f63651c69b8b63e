"""I-Match fingerprints with randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band: those in at least ``rare`` and at most
``common`` of all texts. A text keeps its distinct terms that the lexicon has and, so that texts of rare or common words alone
have a fingerprint too, the ``OTHERS`` further ones of the least hashes; sorted, they give the hashes of several random subsets: ``SUBSETS`` has how many at the rates 1/2, 1/4, 1/8 and so on. Large subsets tell near copies apart; small
ones, which are more, still match between half-rewritten texts, whatever their length. A fingerprint is a string of four hexadecimal digits for each subset;
0000 is a subset without terms of the text. The likeness of two fingerprints is the share of equal hashes among the
subsets that either of them has terms in.

A lexicon has at most (mean distinct terms of a text) / ``rare`` terms, 8 bytes each, however many texts there are; that
bounds what is broadcast. Document frequencies are counted over all texts: each task sums its own terms first, so a hot
term is a few rows of the shuffle.

A text without words, or null, has a fingerprint of zeros, and is like another one without words (1.0), and unlike any other
(0.0). Very long texts are hashed whole, a part of their terms at a time.
Repeated rows and equal texts have equal fingerprints. Empty tables give empty results; ``fingerprints`` keeps other columns
(a fingerprint is replaced), ``edited_neighbours`` ignores them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions
from .textnum import LOWER, U64, mix, powers, slices, span_hashes, view, words

SUBSETS, OTHERS = (2, 2, 4, 8, 16, 16, 24, 24), 12
_SEEDS = mix(np.arange(1, sum(SUBSETS) + 1, dtype=U64))
#: A term belongs to a subset if its own draw is below this: the top bits are zero, as many as the subset's level.
_BELOW = U64(1) << (U64(64) - np.repeat(np.arange(1, len(SUBSETS) + 1, dtype=U64), SUBSETS))


def terms(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct terms, as hashes; A-Z are lower-cased."""
    data, offsets = view(texts)
    low = LOWER[data]
    starts, ends, bound = words(low, offsets)
    all_terms = span_hashes(low, starts, ends)
    return [np.unique(all_terms[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def codes(own: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """16 bits for each subset: a polynomial over its terms in their order. own is sorted and distinct, as is the lexicon."""
    total, used = np.zeros(len(_SEEDS), U64), np.zeros(len(_SEEDS), np.int64)
    kept = np.zeros(len(own), bool)
    if len(lexicon):
        kept = lexicon[np.minimum(np.searchsorted(lexicon, own), len(lexicon) - 1)] == own
    kept[np.flatnonzero(~kept)[:OTHERS]] = True
    kept = own[kept]
    power = powers(len(kept))[0]
    for part in np.array_split(kept, len(kept) // 4096 + 1):  # bounded memory for very long texts
        draw = mix(part[None, :] ^ _SEEDS[:, None])
        at = np.flatnonzero(draw < _BELOW[:, None])  # by subset, then in the order of the terms
        n = np.bincount(at // len(part), minlength=len(_SEEDS)) if len(part) else np.zeros(len(_SEEDS), np.int64)
        end = np.cumsum(n)
        place = np.arange(len(at)) - np.repeat(end - n - used, n)
        sums = np.append(U64(0), np.cumsum(draw.ravel()[at] * power[place], dtype=U64))
        total += sums[end] - sums[end - n]
        used += n
    short = (mix(total) >> U64(48)).astype(np.uint16)
    return np.where(used > 0, np.maximum(short, np.uint16(1)), np.uint16(0))


def text_of(code: np.ndarray) -> str:
    return code.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a > 0) | (b > 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of this task's texts."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        term, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    for batch in slices(batches):
        own = terms(batch.column("text"))
        held += own
        size += sum(map(len, own))
        if size > 4_000_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def lexicon(docs: DataFrame, rare: float, common: float) -> np.ndarray:
    """The sorted terms of the band, at most (mean distinct terms) / rare of them."""
    counts = docs.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = docs.count()
    low, high = max(1, -(-total * rare // 1)), total * common
    chosen = counts.filter(F.col("n").between(low, high)).select("term").toArrow()
    return np.sort(chosen.column("term").to_numpy().view(U64)) if chosen.num_rows else np.zeros(0, U64)


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _chained(lex: np.ndarray):
    """Rows come by (part, doc_id descending); only_next rows end a part."""
    opened = zstandard.ZstdDecompressor

    def unpacked(t: bytes) -> str:
        return opened().decompress(t).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # of the row that waits for its next one: (part, id, text, code)
        for batch in slices(batches, "packed", 1 << 18):
            part, ids, only = (batch.column(c).to_pylist() for c in ("part", "doc_id", "only_next"))
            texts = [unpacked(t) for t in batch.column("packed").to_pylist()]
            code = [codes(t, lex) for t in terms(pa.array(texts, pa.string()))]
            waiting, rows, new = before, [], []
            for p, i, o, t, c in zip(part, ids, only, texts, code, strict=True):
                if waiting is not None and waiting[0] == p:
                    new.append(edited(waiting[2], t))
                    rows.append((waiting, c))
                waiting = None if o else (p, i, t, c)
            before = waiting
            if rows:
                after = [codes(t, lex) for t in terms(pa.array(new, pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0][1] for r in rows], pa.int64()),
                        pa.array([len(r[0][2]) for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                        pa.array([text_of(r[0][3]) for r in rows]),
                        pa.array([text_of(c) for c in after]),
                        pa.array([likeness(r[0][3], c) for r, c in zip(rows, after, strict=True)], pa.float64()),
                        pa.array([likeness(r[0][3], r[1]) for r in rows], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return run


DEALT = "doc_id long, packed binary, tie long, part int, only_next boolean"
CHAINED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, rare: float = 0.0005, common: float = 0.05) -> DataFrame:
    """``docs`` (text and any columns) with the column fingerprint."""
    lex = docs.sparkSession.sparkContext.broadcast(lexicon(docs, rare, common))

    docs = docs.drop("fingerprint")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [text_of(codes(own, lex.value)) for own in terms(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], [*names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def edited_neighbours(docs: DataFrame, rare: float = 0.0005, common: float = 0.05) -> DataFrame:
    """Fingerprints of every text, its edited text and their likenesses (``CHAINED``); ``docs`` has doc_id and text.

    The next text is that of the next lower doc_id; after the last comes the first. Texts are dealt once, compressed, by ranges of
    doc_id whose bounds are ids that occur; the row of a bound goes to the range below it as well, as the text next to that
    range's last. Rows with equal ids stay together, in the order of their texts; null ids are the lowest.
    """
    spark = docs.sparkSession
    lex = lexicon(docs, rare, common)
    parts = shuffle_partitions(spark)
    lowest = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    got = docs.select(
        F.percentile_approx(key, [i / parts for i in range(1, parts)] if parts > 1 else [0.5], F.lit(100 * parts)).alias("b"),
        F.max(key).alias("top"),
    ).first()
    bounds, top = sorted(set(got["b"] or [])), got["top"]
    bounds = [b for b in bounds if b != top]
    edges = np.array(bounds, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            ids = batch.column("doc_id").fill_null(lowest).to_numpy()
            part = np.searchsorted(edges, ids, "left")
            # A bound's row serves the range above it as next; the first row of all serves the lowest range.
            bound = edges[np.minimum(part, len(edges) - 1)] == ids if len(edges) else np.zeros(len(ids), bool)
            extra = np.flatnonzero(bound | (ids == top))
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            tie = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big", signed=True) for t in raw]
            rows = np.append(np.arange(len(ids)), extra)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array([press.compress(t) for t in raw], pa.binary()).take(pa.array(rows)),
                    pa.array(tie, pa.int64()).take(pa.array(rows)),
                    pa.array(np.append(part, np.where(bound[extra], part[extra] + 1, 0)), pa.int32()),
                    pa.array(np.arange(len(rows)) >= len(ids)),
                ],
                [c.split()[0] for c in DEALT.split(", ")],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, DEALT)
    dealt = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "only_next", F.col("doc_id").desc_nulls_last(), "tie")
    return dealt.mapInArrow(_chained(lex), CHAINED)
