"""Baseline JPEG: parsing, Huffman decoding, and thumbnails from the DC coefficients alone, in numpy.

``thumbnails`` parses any sequential 8-bit Huffman stream (grey or colour, any sampling, with or without restarts), walks
through all its coefficients and keeps the DC ones of the luminance: a picture of an eighth of the size. All restart
intervals of all the images in a batch are decoded side by side, a symbol of each at a time, so Python's work doesn't grow
with the number of symbols.

``store`` writes bytes as such a picture without loss: one block for each byte, whose DC coefficient, quantised by 8, is
the byte less 128; so the thumbnail is the payload. A picture is 24 blocks wide and has a restart interval for each
row, up to ``ROWS`` rows; more bytes make more pictures, one after another.

Null media or text: no bytes, or an empty text. Media that is no baseline JPEG, is cut off, or claims more blocks than its
bits can hold gets null features, so a decoder's work is bounded by the bytes it reads. Very long texts become several
pictures, held in memory whole. Repeated rows, ties and equal texts have equal values. Empty tables give empty results;
``features`` keeps other columns, ``texts_as_pictures`` ignores them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textnum import ranges, slices, view

WIDTH, UNIT, ROWS, PAD = 24, 576, 8184, 255
SOI, EOI, SOS, DQT, DHT, SOF0, DRI = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC0, 0xDD
#: Code lengths of the DC sizes 0 to 8 in what ``store`` writes, the longest less one; the only AC symbol is the end of block.
DC_COUNTS, DC_SYMBOLS = [0, 0, 6, 3] + [0] * 12, [5, 6, 4, 3, 2, 7, 1, 0, 8]


# -- parsing ---------------------------------------------------------------------------------------------------------


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    interval: int
    scan: tuple[int, int]  # where the entropy-coded bytes start and end
    end: int


class NotBaseline(ValueError):
    pass


def codes_of(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(code, length, symbol) in the canonical order."""
    out, code, k = [], 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out.append((code, length, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, code length) for each 16 bits that may follow; length 0 where no code fits."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for code, n, s in codes_of(counts, symbols):
        symbol[code << 16 - n : code + 1 << 16 - n] = s
        length[code << 16 - n : code + 1 << 16 - n] = n
    return symbol, length


_LOOKUPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def parse(data: bytes, at: int = 0) -> Picture:
    """The markers of the picture that starts at ``at``; only one scan with all components is baseline as written here."""
    if data[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    at += 2
    quants: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    parts: list[Component] = []
    width = height = interval = 0
    while True:
        while data[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise NotBaseline("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                raw = body[1 : 1 + (64 << wide)]
                if wide > 1 or len(raw) != 64 << wide:
                    raise NotBaseline("a quantisation table is cut off")
                quants[body[0] & 15], body = np.frombuffer(raw, ">u2" if wide else np.uint8).astype(np.int64), body[1 + (64 << wide) :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                key = body[1 : 17 + n]
                if len(key) != 16 + n:
                    raise NotBaseline("a Huffman table is cut off")
                if key not in _LOOKUPS:
                    if len(_LOOKUPS) > 64:
                        _LOOKUPS.clear()
                    _LOOKUPS[key] = lookup(list(body[1:17]), list(body[17 : 17 + n]))
                tables[body[0] >> 4, body[0] & 15], body = _LOOKUPS[key], body[17 + n :]
        elif marker == SOF0:
            if body[0] != 8:
                raise NotBaseline("samples are not of 8 bits")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            if not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in parts):
                raise NotBaseline("no such sampling")
        elif marker == DRI:
            interval = int.from_bytes(body[:2], "big")
        elif marker == SOS:
            if not parts or body[0] != len(parts) or not width or not height:
                raise NotBaseline("not a single scan after a frame header")
            for i, c in enumerate(parts):
                c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            start = at
            while True:  # up to a marker that is neither a stuffed byte nor a restart
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise NotBaseline("the scan has no end")
                if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                at += 2
            scan = (start, at)
            if data[at + 1] != EOI:
                raise NotBaseline("more than one scan")
            return Picture(width, height, parts, quants, tables, interval, scan, at + 2)
        elif marker == EOI or 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise NotBaseline("no baseline frame")


def pictures(data: bytes) -> list[Picture]:
    out, at = [], 0
    while at < len(data):
        out.append(parse(data, at))
        at = out[-1].end
    return out


# -- decoding --------------------------------------------------------------------------------------------------------


def intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A scan's bytes without stuffing and restart markers, and the start of each interval, then the end."""
    mark = np.flatnonzero(data[:-1] == 0xFF) if len(data) else np.zeros(0, np.int64)
    after = data[mark + 1]
    stuffed, restart = mark[after == 0] + 1, mark[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[stuffed] = keep[restart] = keep[restart + 1] = False
    before = np.append(0, np.cumsum(keep))
    return data[keep], np.concatenate([[0], before[restart], [before[-1]]])


def walk(data: np.ndarray, begin: np.ndarray, end: np.ndarray, blocks: np.ndarray, order: list[tuple[int, tuple, tuple]]) -> np.ndarray:
    """The DC differences, added up, of all blocks of the intervals from ``begin`` to ``end``, one interval after another.

    order: (component, DC table, AC table) of each block of a unit, which repeats. blocks: of each interval.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]  # 32 bits from each byte on
    top = len(window) - 1
    bit = begin.astype(np.int64) * 8
    limit = end.astype(np.int64) * 8
    place = np.cumsum(blocks) - blocks
    out = np.zeros(int(blocks.sum()), np.int32)
    last = np.zeros((1 + max(c for c, _, _ in order), len(begin)), np.int32)

    def peek(at: np.ndarray) -> np.ndarray:
        return window[np.minimum(at >> 3, top)] << (at & 7).astype(np.uint32)

    def value(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The signed number in ``size`` bits, up to 16."""
        got = (peek(at) >> np.uint32(1) >> (np.uint32(31) - size)).astype(np.int32)
        return np.where(got < (1 << size.astype(np.int32)) >> 1, got - (1 << size.astype(np.int32)) + 1, got)

    lane = np.arange(len(begin))
    for i in range(int(blocks.max(initial=0))):
        part, (dc_symbol, dc_length), (ac_symbol, ac_length) = order[i % len(order)]
        lane = lane[blocks[lane] > i]
        at = bit[lane]
        code = peek(at) >> np.uint32(16)
        size, used = dc_symbol[code].astype(np.uint32), dc_length[code]
        if not used.all():
            raise NotBaseline("a code that no table has")
        at = at + used
        last[part, lane] += value(at, size)
        out[place[lane] + i] = last[part, lane]
        at = at + size
        done = np.zeros(len(lane), np.int64)  # AC coefficients passed
        live = np.arange(len(lane))
        while len(live):
            code = peek(at[live]) >> np.uint32(16)
            symbol, used = ac_symbol[code], ac_length[code]
            if not used.all():
                raise NotBaseline("a code that no table has")
            at[live] += used + (symbol & 15)
            if not symbol.any():
                break
            done[live] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
            live = live[done[live] < 63]
        if (at > limit[lane]).any():
            raise NotBaseline("the bits run out")
        bit[lane] = at
    return out


def _same(p: Picture) -> tuple:
    """Pictures that can be walked through together."""
    return tuple((c.h, c.v, id(p.tables.get((0, c.dc), 0)), id(p.tables.get((1, c.ac), 0))) for c in p.components)


def thumbnails(data: list[bytes]) -> list[list[np.ndarray] | None]:
    """The luminance thumbnails (uint8) of the pictures in each element; None if it holds anything but baseline JPEG."""
    found: list[list[Picture] | None] = []
    for x in data:
        try:
            found.append(pictures(x))
        except (ValueError, IndexError):  # NotBaseline is a ValueError
            found.append(None)
    out: list[list[np.ndarray] | None] = [None if x is None else [None] * len(x) for x in found]
    alike: dict[tuple, list[tuple[int, int]]] = {}
    for i, x in enumerate(found):
        for k, p in enumerate(x or []):
            alike.setdefault(_same(p), []).append((i, k))
    for where in alike.values():
        for i, k, picture in _decode([(i, k, found[i][k], data[i]) for i, k in where]):
            if out[i] is not None:
                out[i] = None if picture is None else out[i][:k] + [picture] + out[i][k + 1 :]
    return out


def _decode(group: list[tuple[int, int, Picture, bytes]]) -> list[tuple[int, int, np.ndarray | None]]:
    first = group[0][2]
    single = len(first.components) == 1
    try:
        order = []
        for c, part in enumerate(first.components):
            order += [(c, first.tables[0, part.dc], first.tables[1, part.ac])] * (1 if single else part.h * part.v)
    except KeyError:
        return [(i, k, None) for i, k, _, _ in group]
    units = len(order)
    grown, begins, stops, counts, shapes = [], [], [], [], []
    base = 0
    for _, _, p, data in group:
        plain, begin = intervals(np.frombuffer(data, np.uint8)[p.scan[0] : p.scan[1]])
        hmax, vmax = (1, 1) if single else (max(c.h for c in p.components), max(c.v for c in p.components))
        across, down = -(-p.width // (8 * hmax)), -(-p.height // (8 * vmax))
        all_units = across * down
        step = p.interval or all_units
        # A block takes two bits at least, one for each of its codes.
        fits = 2 * units * all_units <= 8 * len(plain) and len(begin) - 1 == -(-all_units // step) and p.components[0].quant in p.quants
        if not fits:
            shapes.append(None)
            continue
        counts.append(np.minimum(step, all_units - np.arange(0, all_units, step)) * units)
        shapes.append((across, down, int(counts[-1].sum())))
        grown.append(plain)
        begins.append(begin[:-1] + base)
        stops.append(begin[1:] + base)
        base += len(plain)
    try:
        levels = walk(*(np.concatenate([np.zeros(0, x), *y]) for x, y in ((np.uint8, grown), (np.int64, begins), (np.int64, stops), (np.int64, counts))), order)
    except NotBaseline:
        return [(i, k, None) for i, k, _, _ in group] if len(group) == 1 else [x for g in group for x in _decode([g])]
    out, at = [], 0
    for (i, k, p, _), shape in zip(group, shapes, strict=True):
        if shape is None:
            out.append((i, k, None))
            continue
        across, down, n = shape
        flat = levels[at : at + n]
        at += n
        luma = p.components[0]
        h, v = (1, 1) if single else (luma.h, luma.v)
        grid = flat.reshape(down, across, units)[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        pixel = np.clip((grid * int(p.quants[luma.quant][0]) + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        scale = (1, 1) if single else (max(c.h for c in p.components), max(c.v for c in p.components))
        out.append((i, k, pixel[: -(-p.height * v // (8 * scale[1])), : -(-p.width * h // (8 * scale[0]))]))
    return out


# -- storing bytes ---------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


_HEAD = b"\xff\xd8" + _segment(DQT, b"\0" + bytes([8] * 64))
_TABLES = (
    _segment(DHT, b"\0" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS))
    + _segment(DHT, b"\x10" + bytes([1] + [0] * 15) + b"\0")
    + _segment(DRI, WIDTH.to_bytes(2, "big"))
    + _segment(SOS, b"\1\1\0\0\x3f\0")
)


def _header(rows: int) -> bytes:
    frame = b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * WIDTH).to_bytes(2, "big") + b"\1\1\x11\0"
    return _HEAD + _segment(SOF0, frame) + _TABLES


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """(bits, number of bits) of a block by its DC difference + 255: size code, value, end of block."""
    by_size = {s: (c, n) for c, n, s in codes_of(DC_COUNTS, DC_SYMBOLS)}
    bits, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = by_size[size]
        value = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = (code << size | value) << 1  # the end of block is the bit 0
        length[d + 255] = n + size + 1
    return bits, length


_BITS, _LENGTH = _code_table()


def store(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A JPEG (or several, one after another) for each payload; ``sizes`` are multiples of ``WIDTH``, in ``payload``."""
    rows = payload.reshape(-1, WIDTH).astype(np.int16)
    before = np.concatenate([np.full((len(rows), 1), 128, np.int16), rows[:, :-1]], axis=1)
    step = (rows - before + 255).astype(np.int64)  # the prediction starts again in each interval
    bits, length = _BITS[step], _LENGTH[step]
    # Four blocks make a word of at most 4 * 14 bits.
    word, used = bits[:, 0::4].copy(), length[:, 0::4].copy()
    for k in range(1, 4):
        word = word << length[:, k::4].astype(np.uint64) | bits[:, k::4]
        used += length[:, k::4]
    total = used.sum(1)
    size = -(-total // 8)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) + 16 if len(end) else 16, np.uint8)
    at = (end - size) * 8
    for k in range(word.shape[1]):
        byte, rest = at >> 3, at & 7
        aligned = word[:, k] << (64 - used[:, k] - rest).astype(np.uint64)  # rest + used is at most 63
        for j in range(8):
            out[byte + j] |= (aligned >> np.uint64(56 - 8 * j)).astype(np.uint8)
        at = at + used[:, k]
    out = out[: int(end[-1])] if len(end) else out[:0]
    fill = (size * 8 - total).astype(np.uint8)
    out[end - 1] |= (np.uint8(1) << fill) - np.uint8(1)  # ones up to the byte's end
    # A zero byte after each 255, and a restart marker after each row but a picture's last.
    full = np.append(0, np.cumsum(out == 0xFF))
    row_of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(out)) + full[:-1] + 2 * row_of
    wide = np.zeros(len(out) + int(full[-1]) + 2 * len(size), np.uint8)
    wide[place] = out
    row_end = end + full[end] + 2 * np.arange(len(size))
    wide[row_end] = 0xFF
    result, row = [], 0
    for n in (sizes // WIDTH).tolist():
        media = []
        for a in range(row, row + n, ROWS):
            b = min(a + ROWS, row + n)
            wide[row_end[a:b] + 1] = 0xD0 + np.arange(b - a) % 8
            start = row_end[a - 1] + 2 if a else 0
            media += [_header(b - a), wide[start : row_end[b - 1]].tobytes(), b"\xff\xd9"]
        result.append(b"".join(media))
        row += n
    return result


# -- features --------------------------------------------------------------------------------------------------------


def shrink(picture: np.ndarray, down: int, across: int) -> np.ndarray:
    """Means over a grid of ``down`` x ``across`` cells of nearly equal size."""
    sums = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1))
    np.cumsum(np.cumsum(picture, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
    y = np.arange(down + 1) * picture.shape[0] / down
    x = np.arange(across + 1) * picture.shape[1] / across
    top, left = np.floor(y[:-1]).astype(int), np.floor(x[:-1]).astype(int)
    low, right = np.maximum(np.ceil(y[1:]).astype(int), top + 1), np.maximum(np.ceil(x[1:]).astype(int), left + 1)
    area = (low - top)[:, None] * (right - left)[None, :]
    return (sums[low][:, right] - sums[top][:, right] - sums[low][:, left] + sums[top][:, left]) / area


def hashes(picture: np.ndarray) -> tuple[str, str]:
    """64 bits each: cells above the mean, and cells brighter than the one on their left."""
    mean, steps = shrink(picture, 8, 8), shrink(picture, 8, 9)
    pack = lambda b: np.packbits(b).tobytes().hex()
    return pack(mean > mean.mean()), pack(steps[:, 1:] > steps[:, :-1])


def feature(found: list[np.ndarray] | None) -> str | None:
    """``<width>x<height>:<mean hash>:<step hash>`` of each thumbnail."""
    if found is None:
        return None
    return ",".join("{1}x{0}:{2}:{3}".format(*p.shape, *hashes(p)) for p in found)


def features(media: DataFrame, column: str) -> DataFrame:
    """``media`` with pictures int and feature string for its binary column of JPEGs; null where it has none.

    They replace any of their names.
    """

    media = media.drop("pictures", "feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 4 << 20):
            found = thumbnails([x or b"" for x in batch.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(x) if x else None for x in found], pa.int32()), pa.array([feature(x or None) for x in found], pa.string())],
                [*batch.schema.names, "pictures", "feature"],
            )

    return media.mapInArrow(run, T.StructType([*media.schema.fields, T.StructField("pictures", T.IntegerType()), T.StructField("feature", T.StringType())]))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def texts_as_pictures(docs: DataFrame) -> DataFrame:
    """Stores each text as JPEG, reads it back, and describes both (``STORED``); ``docs`` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = view(batch.column("text"))
            n = np.diff(offsets)
            size = np.maximum(-(-n // UNIT), 1) * UNIT
            payload = np.full(int(size.sum()), PAD, np.uint8)
            payload[ranges(np.cumsum(size) - size, n)] = data
            media = store(payload, size)
            found = thumbnails(media)
            back = [b"".join(p.tobytes() for p in x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([len(x) for x in back], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([zlib.crc32(x[-32:]) for x in back], pa.int64()),
                    pa.array([len(x) for x in media], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                    pa.array([feature(x) for x in found]),
                ],
                [c.split()[0] for c in STORED.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, STORED)
