"""Token counts of a document's parts, from one encoding of the whole document.

A document is encoded once; each token has a span of bytes, and so has each part. The two lists of spans, both in order,
are joined by interval with two binary searches. A token that crosses a boundary goes to the part with most of its bytes;
of equal parts, to the first. So the counts of a document's parts add up to its tokens, which counting the parts one by one
would not give. Documents don't meet, so nothing is shuffled, and a task holds a slice of whole documents.

Parts are given as fields, which lie one after another with a separator that belongs to the field before it, or found as
sections: a section ends after each ``separator``. Null fields are empty. A document without text has one section of
nothing. Repeated rows and ties are rows of their own. Very long texts are encoded whole. The new columns replace any of
their names, in upper or lower case. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoding, read_ranks
from .common import without
from .textnum import slices


def allocate(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each part. ends: of the tokens, in bytes; bounds: starts of the parts, then the end.

    A token counts as crossing for the part that gets it.
    """
    starts = np.append(0, ends[:-1])
    parts = len(bounds) - 1
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    first, last = np.clip(first, 0, parts - 1), np.clip(last, 0, parts - 1)
    to = first.copy()
    crossing = np.flatnonzero(last > first)
    for t in crossing.tolist():  # few: a boundary is crossed by one token
        own = np.arange(first[t], last[t] + 1)
        shared = np.minimum(bounds[own + 1], ends[t]) - np.maximum(bounds[own], starts[t])
        to[t] = own[int(shared.argmax())]
    return np.bincount(to, minlength=parts), np.bincount(to[crossing], minlength=parts)


def section_bounds(text: bytes, separator: bytes) -> np.ndarray:
    """Starts of the sections, then the end; a section ends after its separator."""
    out, at = [0], text.find(separator)
    while at >= 0 and at + len(separator) < len(text):
        out.append(at + len(separator))
        at = text.find(separator, out[-1])
    return np.array([*out, len(text)])


NEW = ("part", "n_bytes", "n_tokens", "n_crossing")


def _count(ranks, pattern: str, text: str, keep: list[str], bounds_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        size = np.zeros(max(ranks.value.values()) + 1, np.int64)
        for token, i in ranks.value.items():
            size[i] = len(token)
        for batch in slices(batches, text, 1 << 20):
            row, part, tokens, crossing, width = [], [], [], [], []
            for i, (whole, bounds) in enumerate(bounds_of(batch)):
                ids = enc.encode_ordinary(whole)
                ends = np.cumsum(size[np.array(ids, np.int64)])
                n, over = allocate(ends, bounds) if ids else (np.zeros(len(bounds) - 1, np.int64),) * 2
                row.append(np.full(len(n), i))
                part.append(np.arange(len(n)))
                tokens.append(n)
                crossing.append(over)
                width.append(np.diff(bounds))
            taken = batch.select(keep).take(pa.array(np.concatenate(row)))
            new = [pa.array(np.concatenate(x).astype(np.int64)) for x in (part, width, tokens, crossing)]
            yield pa.RecordBatch.from_arrays([*taken.columns, *new], [*keep, *NEW])

    return run


def _schema(df: DataFrame, keep: list[str]) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in NEW)])


def section_tokens(docs: DataFrame, path: str, pattern: str, keep: list[str], separator: str = "\n") -> DataFrame:
    """A row for each section of each text: ``keep``, part (from 0), n_bytes, n_tokens, n_crossing."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    keep = without(keep, NEW)
    mark = separator.encode()

    def bounds_of(batch: pa.RecordBatch):
        for t in batch.column("text").to_pylist():
            yield t or "", section_bounds((t or "").encode(), mark)

    run = _count(ranks, pattern, "text", keep, bounds_of)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, _schema(docs, keep))


def field_tokens(docs: DataFrame, fields: list[str], path: str, pattern: str, keep: list[str], separator: str = "\n") -> DataFrame:
    """A row for each of the string columns ``fields`` of each row, which are encoded as one text; columns as above."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    keep = without(keep, NEW)
    mark = separator.encode()
    # Columns go by place, so that their names can't clash.
    named = [f"f{i}" for i in range(len(fields))]

    def bounds_of(batch: pa.RecordBatch):
        for values in zip(*(batch.column(f).to_pylist() for f in named), strict=True):
            raw = [(v or "").encode() for v in values]
            whole = mark.join(raw)
            ends = np.cumsum([len(r) + len(mark) for r in raw])
            ends[-1] -= len(mark)
            yield whole.decode(), np.append(0, ends)

    kept = [f"k{i}" for i in range(len(keep))]
    run = _count(ranks, pattern, "whole", kept, bounds_of)
    columns = [*(docs[c].alias(k) for c, k in zip(keep, kept, strict=True)), *(docs[f].alias(n) for f, n in zip(fields, named, strict=True))]
    # The joined length only sizes the slices.
    whole = docs.select(*columns, F.concat_ws(separator, *(docs[f] for f in fields)).alias("whole"))
    schema = T.StructType([*(T.StructField(k, docs.schema[c].dataType) for c, k in zip(keep, kept, strict=True)), *(T.StructField(c, T.LongType()) for c in NEW)])
    return whole.mapInArrow(run, schema).toDF(*keep, *NEW)
