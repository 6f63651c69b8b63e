"""Byte-level BPE: encoding by a global shuffle of distinct words, and decoding.

A task splits its texts into pre-tokens, block by block, and sends each distinct one of a block to the bucket of its hash.
A bucket's task encodes each distinct word of the corpus once, and sends the ids back to the blocks that asked. There the
texts are split again, and the ids are put in place by position. So what is shuffled is a block's distinct words and their
ids, packed, and the texts once, compressed; never a row for each token. A word occurs once at most in a block's rows, so
no word is a hot key. A bucket is a share of one in (``BUCKETS`` x shuffle partitions) of the distinct words.

Decoding looks up each id in the table of token bytes, which has the vocabulary's fixed size and is broadcast.

Both scans of the input must give the same rows in the same order, as scans of files do (lost tasks read the same split
again); for any other input leave ``stable`` False, and the input is written to the shared folder first. A block that
differs between the scans is noticed, as its ids are missing, and raises an error.

Null or empty text has no ids. Repeated rows and ties are rows of their own. A very long text is a block of its own, handled
whole. Other columns are kept. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import cut, shuffle_partitions, without
from .textnum import U64, distinct_spans, ranges, release, slices, span_hashes, view

BLOCK, PART, BUCKETS = 4 << 20, 1 << 19, 4
_ENCODINGS: dict[int, tiktoken.Encoding] = {}
_CLASSES: list[np.ndarray] = []
#: The endings that the pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, WHITE = range(4)
#: A word that the pattern has matched is encoded as it is.
WHOLE = r"[\s\S]+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    if id(ranks) not in _ENCODINGS:
        _ENCODINGS[id(ranks)] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[id(ranks)]


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _CLASSES:
        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        every, index = "".join(map(chr, points)), np.array(points)
        out = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                out[index[m.start() : m.end()]] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The starts, in bytes, of the pre-tokens of texts that lie one after another; a token ends where the next starts.

    Runs of letters, of numbers and of other signs take a space before them along; white space before anything else leaves
    its last sign to it; an apostrophe that starts a token takes one of ``ENDINGS`` along and nothing more.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each code point
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(at, offsets)] = True
    run = np.ones(n + 1, bool)
    run[1:n] = kind[1:] != kind[:-1]
    run |= first
    start = run.copy()
    begins = np.flatnonzero(run[:n])
    ends = np.append(begins[1:], n)
    white = (kind[begins] == WHITE) & ~first[ends]  # followed by something else in its text
    last = ends[white] - 1
    start[last] = True
    start[ends[white][points[last] == 32]] = False
    alone = (kind[begins] == OTHER) & (ends - begins == 1) & (points[begins] == 39) & start[begins] & ~first[ends]
    for a in begins[alone].tolist():
        b = a + 1
        if kind[b] == LETTER:
            rest = "".join(map(chr, points[b : b + 2].tolist()))
            if ending := next((e for e in ENDINGS if rest.startswith(e) and not first[b + 1 : b + len(e)].any()), ""):
                start[b] = False
                if b + len(ending) < n:
                    start[b + len(ending)] = True
    return at[np.flatnonzero(start[:n])]


def matches(data: np.ndarray, offsets: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends), in bytes, of the matches of ``pattern`` in each text; what lies between them has no ids.

    ``public_tokenizers.PATTERN`` is split by arrays, any other pattern by the regex module.
    """
    if pattern == PATTERN:
        starts = pre_tokens(data, offsets)
        return starts, np.append(starts[1:], len(data))[: len(starts)]
    found = []
    for a, b in itertools.pairwise(offsets.tolist()):
        text = data[a:b].tobytes().decode()
        upto = np.append(0, np.cumsum([len(c.encode()) for c in text])) + a  # bytes before each code point
        found += [(upto[m.start()], upto[m.end()]) for m in regex.finditer(pattern, text) if m.end() > m.start()]
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``PART`` bytes, or of one text."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, "right")) - 1)
        yield at, to
        at = to


def _split(batch: pa.RecordBatch, column: str, pattern: str):
    """(bytes, offsets, starts, ends, distinct hashes, first token of each, distinct word of each token).

    Bytes are handled ``PART`` at a time, as that takes many times their memory.
    """
    data, offsets = view(batch.column(column))
    starts, ends, hashes = [], [], []
    for at, to in _parts(offsets):
        part = data[offsets[at] : offsets[to]]
        a, b = matches(part, offsets[at : to + 1] - offsets[at], pattern)
        starts.append(a + offsets[at])
        ends.append(b + offsets[at])
        hashes.append(span_hashes(part, a, b))
    starts, ends = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends))
    return data, offsets, starts, ends, *distinct_spans(data, starts, ends, np.concatenate([np.zeros(0, U64), *hashes]))


def _block_id(batch: pa.RecordBatch, column: str, seq: int) -> int:
    data, offsets = view(batch.column(column))
    place = f"{TaskContext.get().partitionId()}/{seq}/{len(offsets)}/".encode()
    digest = hashlib.blake2b(place, digest_size=8)
    digest.update(data)
    return int.from_bytes(digest.digest(), "big", signed=True)


def _narrow(x: np.ndarray) -> bytes:
    """As unsigned bytes, shorts or ints, whichever suffice; the reader knows how many there are."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _widen(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // n]).astype(np.int64) if n else np.zeros(0, np.int64)


def _bucketed(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the words by bucket and hash, the buckets that occur, start and end of each in that order)."""
    of = (distinct >> U64(20)) % U64(buckets)
    order = np.argsort(of, kind="stable")
    names, begin = np.unique(of[order], return_index=True)
    return order, names.astype(np.int64), begin, np.append(begin[1:], len(order))[: len(begin)]  # none without words


WORDS = "bucket int, block long, n int, lengths binary, words binary"
ANSWERS = "block long, bucket int, n int, lengths binary, words binary"


def _ask(column: str, pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, batch in enumerate(slices(batches, column, BLOCK)):
            block = _block_id(batch, column, seq)
            press = zstandard.ZstdCompressor(level=3)
            data, _, starts, ends, distinct, where, _ = _split(batch, column, pattern)
            order, names, begin, end = _bucketed(distinct, buckets)
            where = where[order]
            lengths = ends[where] - starts[where]
            packed = data[ranges(starts[where], lengths)].tobytes()
            upto = np.append(0, np.cumsum(lengths))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.int32()),
                    pa.array(np.full(len(names), block), pa.int64()),
                    pa.array(end - begin, pa.int32()),
                    pa.array([_narrow(lengths[a:b]) for a, b in zip(begin, end, strict=True)], pa.binary()),
                    pa.array([press.compress(packed[upto[a] : upto[b]]) for a, b in zip(begin, end, strict=True)], pa.binary()),
                ],
                ["bucket", "block", "n", "lengths", "words"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each key; they come one after another."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
    release()


def _answer(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, WHOLE)
        for rows in _groups(batches, "bucket"):
            n = np.array([r["n"] for r in rows])
            lengths = np.concatenate([_widen(r["lengths"], r["n"]) for r in rows])
            open_ = zstandard.ZstdDecompressor()
            packed = b"".join(open_.decompress(r["words"]) for r in rows)
            ends = np.cumsum(lengths)
            raw = np.frombuffer(packed, np.uint8)
            _, where, which = distinct_spans(raw, ends - lengths, ends, span_hashes(raw, ends - lengths, ends))
            # Each distinct word is encoded once.
            ids = [enc.encode_ordinary(packed[ends[i] - lengths[i] : ends[i]].decode()) for i in where.tolist()]
            size = np.array([len(x) for x in ids], np.int64)
            flat, at = np.array([i for x in ids for i in x], np.int64), np.append(0, np.cumsum(size))
            upto = np.append(0, np.cumsum(n))
            for k in range(0, len(rows), 256):
                out = []
                for r, a, b in zip(rows[k : k + 256], upto[k:], upto[k + 1 :], strict=False):
                    own = which[a:b]
                    out.append((r["block"], r["bucket"], r["n"], _narrow(size[own]), _narrow(flat[ranges(at[own], size[own])])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                    ["block", "bucket", "n", "lengths", "words"],
                )

    return run


def _carry(column: str):
    """A block's rows, compressed, as bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        for seq, batch in enumerate(slices(batches, column, BLOCK)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_block_id(batch, column, seq)], pa.int64()),
                    pa.array([-1], pa.int32()),
                    pa.array([0], pa.int32()),
                    pa.array([b""], pa.binary()),
                    pa.array([press.compress(sink.getvalue())], pa.binary()),
                ],
                ["block", "bucket", "n", "lengths", "words"],
            )

    return run


def _place(column: str, pattern: str, keep: list[str], buckets: int, ids_too: bool, table=None):
    """table: of the tokens' bytes, if the digests of the ids and of what they decode to are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "block"):
            if rows[0]["bucket"] != -1:
                raise ValueError("the input changed between two scans: ids came for a block that is not there")
            batch = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows[0]["words"])).read_next_batch()
            data, offsets, starts, _, distinct, _, which = _split(batch, column, pattern)
            if sum(r["n"] for r in rows) != len(distinct):
                raise ValueError("the input changed between two scans: a block's ids are missing")
            order, _, _, _ = _bucketed(distinct, buckets)
            sizes = [_widen(r["lengths"], r["n"]) for r in rows[1:]]
            flat = [_widen(r["words"], int(s.sum())) for r, s in zip(rows[1:], sizes, strict=True)]
            size, flat = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (sizes, flat))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = np.cumsum(size) - size
            own = place[which]
            first = np.searchsorted(starts, offsets)  # token of each text
            for a, b in _parts(offsets):
                some = own[first[a] : first[b]]
                ids = flat[ranges(at[some], size[some])].astype("<u4")
                bound = np.append(0, np.cumsum(size[some]))[first[a : b + 1] - first[a]]
                stored = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * bound).astype(np.int32)), pa.py_buffer(ids)])
                rest = batch.slice(a, b - a)
                new = {"n_tokens": pa.array(np.diff(bound), pa.int64())}
                if ids_too:
                    new["token_ids"] = stored
                if table:
                    raw, upto = _bytes_of(ids, bound, *table.value)
                    new["ids_sha256"] = pa.array([hashlib.sha256(ids[i:j]).hexdigest() for i, j in itertools.pairwise(bound.tolist())], pa.string())
                    new["decoded_sha256"] = pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in itertools.pairwise(upto.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in keep), *new.values()], [*keep, *new])

    return run


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", keep: list[str] | None = None, stable: bool = False, ids: bool = True, digests: bool = False) -> DataFrame:
    """The columns ``keep`` (all but the text unless given) with n_tokens and token_ids, little-endian 32-bit integers.

    ids: whether token_ids are wanted. digests: adds ids_sha256 and, of the ids decoded again, decoded_sha256.

    The new columns replace any of their names.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != column] if keep is None else keep
    keep = without(keep, NEW)
    docs = docs.select(*dict.fromkeys([*keep, column]))
    docs = docs if stable else cut(docs, "to-encode")
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    parts = shuffle_partitions(spark)
    buckets = parts * BUCKETS
    asked = docs.mapInArrow(_ask(column, pattern, buckets), WORDS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    answered = asked.mapInArrow(_answer(ranks), ANSWERS)
    carried = docs.mapInArrow(_carry(column), ANSWERS)
    placed = carried.unionAll(answered).repartition(parts, "block").sortWithinPartitions("block", "bucket")
    fields = [docs.schema[c] for c in keep]
    wanted = {"n_tokens": True, "token_ids": ids, "ids_sha256": digests, "decoded_sha256": digests}
    schema = T.StructType([*fields, *(T.StructField(c, t) for c, t in NEW.items() if wanted[c])])
    table = spark.sparkContext.broadcast(_token_table(path)) if digests else None
    return placed.mapInArrow(_place(column, pattern, keep, buckets, ids, table), schema)


NEW = {"n_tokens": T.LongType(), "token_ids": T.BinaryType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def _token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, starts, bytes) of the tokens by id."""
    ranks = read_ranks(path)
    known = {i: token for token, i in ranks.items()}
    each = [known.get(i, b"") for i in range(max(known) + 1)]
    size = np.array([len(x) for x in each], np.int64)
    return size, np.cumsum(size) - size, np.frombuffer(b"".join(each), np.uint8)


def _bytes_of(ids: np.ndarray, bound: np.ndarray, size: np.ndarray, at: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids, where each text's start, then the end); bound: where each text's ids start, then the end."""
    wide = ids.astype(np.int64)
    return packed[ranges(at[wide], size[wide])], np.append(0, np.cumsum(size[wide]))[bound]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column decoded (binary); null ids have no bytes."""
    table = encoded.sparkSession.sparkContext.broadcast(_token_table(path))
    encoded = encoded.drop("decoded")
    keep = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "token_ids"):
            data, offsets = view(batch.column("token_ids"))
            out, bound = _bytes_of(np.frombuffer(data.tobytes(), "<u4"), offsets // 4, *table.value)
            stored = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*batch.columns, stored], [*keep, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
