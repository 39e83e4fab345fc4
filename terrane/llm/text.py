"""Word and shingle hashing of whole texts with numpy, and the Arrow plumbing that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, _STEP + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, np.uint64(x)), dtype=np.uint64)]) for x in (_BASE, inverse))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends


def word_blocks(data: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """A text's bytes a megabyte at a time, cut at spaces, each block with its words' hashes, starts and ends."""
    at = 0
    while at < len(data):
        to = len(data)
        if at + _STEP < to:
            end = at + _STEP
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut <= at:  # one long word
                cut = min((x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0), default=to)
            to = cut
        block = data[at:to]
        yield block, *_hash_block(block)
        at = to


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, in order; none for null."""
    found = [h for _, h, _, _ in word_blocks((text or "").encode("utf-8", "replace").lower())]
    return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.uint64), *found])


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; the whole sequence as one run if it is shorter."""
    if not len(words):
        return words
    k = min(size, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h + words[i : len(words) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(h)


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo: the split that held-out rows are dealt by (null: 0)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0).cast("long"))


def map_batches(df: DataFrame, kernel: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType | str) -> DataFrame:
    """Applies ``kernel()`` (made once a task) to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for batch in batches:
            out = f(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of a column one at a time, null as empty."""
    for x in column:
        yield x.as_py() or ""


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
