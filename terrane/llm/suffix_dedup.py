"""Removal of long byte strings that occur more than once in a corpus, by blockwise suffix sorting with difference-cover samples.

Which suffixes can tie at all is found first. Each window of ``length`` bytes is named by its anchor, the k-gram in it with the least
hash; equal windows have the same anchor at the same place, so that only windows whose anchor occurs twice in the corpus go on. They are
the suffixes to sort, dealt by anchor into blocks of bounded size; a context that a block holds twice is sorted once.

The suffixes of a block are sorted one bucket at a time, a bucket being those that begin with a range of two-byte prefixes. Before, the
difference-cover sample of the block is ranked: places that are 0, 1 or 3 modulo 7, by prefix doubling from 7 bytes to the depth that
windows need. In a bucket suffixes are sorted by 7 bytes; those that tie are ordered by the sample: any two of them have places at the
same distance, 6 bytes at most, that both are in it, so that each class modulo 7 is merged with each other one by ranks alone, however
long the tie. Neighbours in the order are compared over ``length`` bytes; those that agree occur more than once.

Texts are packed into chunks. A chunk asks the anchor tables how often each anchor occurs, sends the contexts of repeated ones to the
blocks, and gets back a bit for each window. An anchor that occurs more than HOT times, whose contexts one block shouldn't hold, is split
further by its windows: their 64-bit hashes are counted in tables as the anchors were, and are what such windows are compared by.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.katz import _slices, pack, pack_sorted, unpack, unpack_sorted
from terrane.llm.store import Scratch
from terrane.llm.text import _power_tables, map_batches, mix

LENGTH, GRAM = 200, 40
#: A difference cover: of any two residues modulo PERIOD some equal shift brings both into COVER.
PERIOD, COVER = 7, (0, 1, 3)
#: Text bytes of a chunk, hashes of a part of a table, context bytes of a block and windows of a bucket, about; contexts of one anchor.
CHUNK_BYTES, TABLE_HASHES, BLOCK_BYTES, BUCKET_WINDOWS, HOT = 4 << 20, 1_000_000, 1 << 20, 100_000, 4_000
_STRIDE = 1 << 19
UNIQUE, REPEATED, OFTEN = 0, 1, 2
ANCHOR, WINDOW = 0, 1


def _gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    up, down = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(b) - k + 1])


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = a
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, and first and last window start of each anchor of a text."""
    out = []
    for at in range(0, len(data) - length + 1, _STRIDE):
        b = np.frombuffer(data, np.uint8, min(_STRIDE + length - 1, len(data) - at), at)
        g = _gram_hashes(b, k)
        low = np.uint64((1 << 20) - 1)
        m = _sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), length - k + 1)
        first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
        last = np.append(first[1:], len(m)) - 1
        place = (m[first] & low).astype(np.int64)
        out.append((g[place], place + at, first + at, last + at))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Texts:
    """A chunk: whole texts as one buffer, their anchors with places in it."""

    def __init__(self, row: dict, length: int, k: int, with_anchors: bool = True):
        self.sizes = unpack(row["sizes"])
        self.data = zstandard.decompress(row["data"])
        self.starts = np.cumsum(self.sizes) - self.sizes
        if with_anchors:
            found = [(h, p + s, a + s, b + s) for s, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True) if n >= length for h, p, a, b in [anchors(self.data[s : s + n], length, k)]]
            found = found or [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
            self.hash, self.place, self.first, self.last = (np.concatenate(x) for x in zip(*found, strict=True))
            self.distinct, self.of = np.unique(self.hash, return_inverse=True)

    def windows(self, chosen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of some anchors, and their hashes."""
        n = self.last[chosen] - self.first[chosen] + 1
        starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[chosen], n)
        out = np.zeros(len(starts), np.uint64)
        b = np.frombuffer(self.data, np.uint8)
        for at in range(0, len(b), _STRIDE):
            here = np.flatnonzero((starts >= at) & (starts < at + _STRIDE))
            if len(here):
                out[here] = _gram_hashes(b[at : at + _STRIDE + length - 1], length)[starts[here] - at]
        return starts, mix(out ^ np.uint64(0x5D1D0B5C7A3F2E11))


def chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("n", pa.int64())])

    def run(batches):
        ids, data, n, made = [], [], 0, 0
        task = TaskContext.get()
        part = task.partitionId() if task else 0

        def flush():
            row = [part << 32 | made, pack(np.array([i or 0 for i in ids], np.int64)), pack(np.array([i is None for i in ids], np.uint8)), pack(np.array([len(x) for x in data], np.int64)), zstandard.compress(b"".join(data), 6), n]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                data.append((text.as_py() or "").encode("utf-8", "replace"))
                n += len(data[-1])
                if n >= chunk_bytes:
                    yield flush()
                    ids, data, n, made = [], [], 0, made + 1
        if ids:
            yield flush()

    return docs.mapInArrow(run, "chunk long, ids binary, nulls binary, sizes binary, data binary, n long")


_ASKED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ASKED_SQL = "kind int, part int, chunk long, hashes binary, counts binary"


def _asking(kind: int, chunk: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    at = _slices(hashes, bits)
    return [(kind, p, chunk, pack_sorted(hashes[a:b]), pack(counts[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]


def _table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


_TOLD = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("marks", pa.binary()), ("repeated", pa.int64())])
_TOLD_SQL = "chunk long, kind int, part int, marks binary, repeated long"


def _counted(hot: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A part of an anchor or window table: for each hash asked for, whether it occurs once, again, or too often for a block."""
        kind, part = key[0].as_py(), key[1].as_py()
        rows = sorted(zip(table["chunk"].to_pylist(), table["hashes"].to_pylist(), table["counts"].to_pylist(), strict=True))
        asked = [unpack_sorted(r[1]) for r in rows]
        sizes = np.cumsum([0, *map(len, asked)])
        given = np.concatenate([unpack(r[2]) for r in rows])
        _, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(place, weights=given)
        mark = np.where(total < 2, UNIQUE, np.where(total > hot, OFTEN, REPEATED)).astype(np.uint8)
        back = mark[place]
        out = [(r[0], kind, part, pack(back[a:b]), int(given[a:b][back[a:b] == REPEATED].sum())) for r, a, b in zip(rows, sizes[:-1], sizes[1:], strict=True)]
        return _table_of(out, _TOLD)

    return run


def _marks(told: pa.Table, kind: int, n: int) -> np.ndarray:
    rows = sorted((r["part"], r["marks"]) for r in told.select(["kind", "part", "marks"]).to_pylist() if r["kind"] == kind)
    return np.concatenate([unpack(m) for _, m in rows]) if rows else np.zeros(n, np.uint8)


_SENT = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("starts", pa.binary()), ("data", pa.binary()), ("asked", pa.binary()), ("asked_counts", pa.binary())])
_SENT_SQL = "chunk long, part int, counts binary, starts binary, data binary, asked binary, asked_counts binary"


def _contexts(length: int, k: int, bits: int, table_bits: int):
    """Of a chunk and its marks: contexts of repeated anchors by block (part >= 0), window hashes of too frequent ones (part < 0)."""

    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return _SENT.empty_table()
        row = table.to_pylist()[0]
        c = Texts(row, length, k)
        mark = _marks(told, ANCHOR, len(c.distinct))[c.of]
        rows = []
        chosen = np.flatnonzero(mark == REPEATED)
        chosen = chosen[np.argsort(c.hash[chosen], kind="stable")]
        at = _slices(c.hash[chosen], bits)
        for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a < b:
                here = chosen[a:b]
                first, last = c.first[here], c.last[here]
                data = b"".join([c.data[x:y] for x, y in zip(first.tolist(), (last + length).tolist(), strict=True)])
                rows.append((row["chunk"], p, pack((last - first + 1).astype(np.uint32)), pack(first.astype(np.uint32)), zstandard.compress(data, 3), None, None))
        if (mark == OFTEN).any():
            hashes, counts = np.unique(c.windows(np.flatnonzero(mark == OFTEN), length)[1], return_counts=True)
            rows += [(chunk, -1 - p, None, None, None, h, n) for _, p, chunk, h, n in _asking(WINDOW, row["chunk"], hashes, counts, table_bits)]
        return _table_of(rows, _SENT)

    return run


def _shift(r: int, q: int) -> int:
    """The least distance at which places with these residues are both in the cover."""
    return next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (q + d) % PERIOD in COVER)


def _ranked(a: np.ndarray) -> np.ndarray:
    """The place of each number among the distinct ones."""
    flat = a.reshape(-1)
    order = np.argsort(flat)
    new = np.ones(len(flat), bool)
    np.not_equal(flat[order[1:]], flat[order[:-1]], out=new[1:])
    out = np.empty(len(flat), np.uint32)
    out[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return out.reshape(a.shape)


class Suffixes:
    """A block's text with its first PERIOD bytes at each place as a number, and the ranks of the difference-cover sample."""

    def __init__(self, text: np.ndarray, length: int):
        n = -(-(len(text) + length + 2 * PERIOD) // PERIOD) * PERIOD
        padded = np.zeros(n + PERIOD, np.uint8)
        padded[: len(text)] = text
        self.length, self.word = length, np.zeros(n, np.uint64)
        for i in range(PERIOD):
            self.word <<= np.uint64(8)
            self.word |= padded[i : i + n]
        # Sample places by period and place in the cover: a step of whole periods is a step along the first axis.
        sample = self.word.reshape(-1, PERIOD)[:, list(COVER)]
        self.rank = _ranked(sample)
        depth = PERIOD
        while depth < length and self.rank.max() + 1 < self.rank.size:
            step = depth // PERIOD
            pair = self.rank.astype(np.uint64) << np.uint64(32)
            pair[:-step] |= self.rank[step:] + np.uint32(1)
            self.rank = _ranked(pair)
            depth *= 2
        self.column = np.full(PERIOD, -1)
        self.column[list(COVER)] = range(len(COVER))

    def rank_at(self, place: np.ndarray) -> np.ndarray:
        return self.rank[place // PERIOD, self.column[place % PERIOD]].astype(np.int64)

    def buckets(self, starts: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Suffixes by ranges of two-byte prefixes, ``most`` at a time if one prefix doesn't have more."""
        prefix = (self.word[starts] >> np.uint64(8 * PERIOD - 16)).astype(np.int64)
        ends = np.cumsum(np.bincount(prefix, minlength=1 << 16))
        at = 0
        while at < 1 << 16:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            here = np.flatnonzero((prefix >= at) & (prefix < to))
            if len(here):
                yield here
            at = to

    def ordered(self, starts: np.ndarray) -> np.ndarray:
        """The order of the suffixes that begin at some places, as far as ``length`` bytes decide it."""
        key = self.word[starts]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        tie = np.empty(len(starts), np.int64)
        tie[order] = np.cumsum(new) - 1
        size = np.bincount(tie)
        open_ = np.flatnonzero(size[tie] > 1)
        if not len(open_):
            return order
        # How many suffixes of the same tie are smaller: class by class, by the ranks at the shift that takes both classes to the cover.
        group = np.unique(tie[open_], return_inverse=True)[1].astype(np.int64) << 32
        place, smaller = starts[open_], np.zeros(len(open_), np.int64)
        classes = [np.flatnonzero(place % PERIOD == r) for r in range(PERIOD)]
        keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def sorted_keys(r: int, d: int) -> tuple[np.ndarray, np.ndarray]:
            """The suffixes of a class by tie and rank at a shift, and the order they are in there."""
            if (r, d) not in keys:
                key = group[classes[r]] | self.rank_at(place[classes[r]] + d)
                turn = np.argsort(key)
                keys[r, d] = key[turn], classes[r][turn]
            return keys[r, d]

        for r in range(PERIOD):
            for q in range(PERIOD):
                if len(classes[r]) and len(classes[q]):
                    (mine, at), (theirs, _) = (sorted_keys(c, _shift(r, q)) for c in (r, q))
                    smaller[at] += np.searchsorted(theirs, mine) - np.searchsorted(theirs, mine >> 32 << 32)
        within = np.zeros(len(starts), np.int64)
        within[open_] = smaller
        return np.lexsort((within, tie))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of suffixes agree in ``length`` bytes."""
        same = np.arange(len(a))
        for at in [*range(0, self.length - PERIOD, PERIOD), self.length - PERIOD]:
            same = same[self.word[a[same] + at] == self.word[b[same] + at]]
        out = np.zeros(len(a), bool)
        out[same] = True
        return out


def repeated_windows(data: bytes, count: np.ndarray, length: int, bucket_windows: int) -> np.ndarray:
    """For contexts one after the other in ``data`` (each of its number of windows and the rest of the last one): which windows occur twice."""
    size = count + length - 1
    begin = np.cumsum(size) - size
    # A context that is there twice repeats all its windows; the first one stands for it in the sort.
    first: dict[bytes, int] = {}
    stands = np.array([first.setdefault(data[a : a + n], i) for i, (a, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True))], np.int64)
    times = np.bincount(stands, minlength=len(count))
    kept = np.flatnonzero(times)
    suffixes = Suffixes(np.frombuffer(b"".join(first), np.uint8), length)
    base, n = np.cumsum(size[kept]) - size[kept], count[kept]
    starts = np.repeat(base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flags = np.repeat(times[kept] > 1, n)
    for here in suffixes.buckets(starts, bucket_windows):
        order = here[suffixes.ordered(starts[here])]
        same = suffixes.equal(starts[order[:-1]], starts[order[1:]])
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
    # Back to every context: those that another one stands for take its flags.
    at = np.zeros(len(count), np.int64)
    at[kept] = np.cumsum(n) - n
    place = np.repeat(at[stands], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return flags[place]


_FOUND = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("starts", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary())])
_FOUND_SQL = "chunk long, part int, starts binary, counts binary, bits binary"


def _sorted_block(length: int, bucket_windows: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A block: its contexts' windows that occur twice, for each chunk."""
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        count = [unpack(r["counts"]).astype(np.int64) for r in rows]
        flags = repeated_windows(b"".join(zstandard.decompress(r["data"]) for r in rows), np.concatenate(count), length, bucket_windows)
        out, k = [], 0
        for r, own in zip(rows, count, strict=True):
            m = int(own.sum())
            out.append((r["chunk"], key[0].as_py(), r["starts"], r["counts"], zstandard.compress(np.packbits(flags[k : k + m]).tobytes())))
            k += m
        return _table_of(out, _FOUND)

    return run


OUTPUTS = {"n_bytes": (pa.int64(), "long"), "n_removed": (pa.int64(), "long"), "n_spans": (pa.int64(), "long"), "spans": (pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "array<struct<start:bigint,end:bigint>>"), "kept": (pa.binary(), "binary"), "kept_sha256": (pa.string(), "string")}


def _cut(length: int, k: int, outputs: list[str]):
    schema = pa.schema([("doc_id", pa.int64()), *((name, OUTPUTS[name][0]) for name in outputs)])

    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        """Of a chunk and what was found of its windows: each text without the bytes that repeated windows cover."""
        if not table.num_rows:
            return schema.empty_table()
        row = table.to_pylist()[0]
        often = any(r is not None for r in found["marks"].to_pylist()) if found.num_rows else False
        c = Texts(row, length, k, with_anchors=often)
        hit = np.zeros(len(c.data) + 1, np.int8)
        for r in found.to_pylist():
            if r["starts"] is not None:
                n = unpack(r["counts"]).astype(np.int64)
                place = np.repeat(unpack(r["starts"]).astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit[place[np.unpackbits(np.frombuffer(zstandard.decompress(r["bits"]), np.uint8))[: len(place)].astype(bool)]] = 1
        if often:
            anchor_marks = _marks(found, ANCHOR, len(c.distinct))[c.of]
            starts, hashes = c.windows(np.flatnonzero(anchor_marks == OFTEN), length)
            distinct, of = np.unique(hashes, return_inverse=True)
            hit[starts[_marks(found, WINDOW, len(distinct))[of] != UNIQUE]] = 1
        total = np.cumsum(hit, dtype=np.int64)
        covered = np.zeros(len(c.data) + 2, np.int8)
        covered[1:-1] = (total[:-1] - np.concatenate([np.zeros(min(length, len(c.data)), np.int64), total[: max(0, len(c.data) - length)]])) > 0
        cells: dict[str, list] = {name: [] for name in schema.names}
        ids, nulls = unpack(row["ids"]), unpack(row["nulls"]).astype(bool)
        for s, n in zip(c.starts.tolist(), c.sizes.tolist(), strict=True):
            text = c.data[s : s + n]
            own = np.zeros(n + 2, np.int8)
            own[1:-1] = covered[s + 1 : s + n + 1]
            edges = np.flatnonzero(np.diff(own))
            spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
            kept = text
            if spans:
                kept = np.frombuffer(text, np.uint8)[own[1:-1] == 0].tobytes()
            for name, v in (("n_bytes", n), ("n_removed", n - len(kept)), ("n_spans", len(spans)), ("spans", [{"start": a, "end": b} for a, b in spans] if "spans" in cells else None), ("kept", kept), ("kept_sha256", hashlib.sha256(kept).hexdigest() if "kept_sha256" in cells else None)):
                if name in cells:
                    cells[name].append(v)
        return pa.Table.from_arrays([pa.array(ids, pa.int64(), mask=nulls), *(pa.array(cells[name], OUTPUTS[name][0]) for name in outputs)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, outputs: tuple[str, ...] = ("n_removed", "spans", "kept"), length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS, hot: int = HOT) -> DataFrame:
    """doc_id and ``outputs`` of each row of ``docs``: the text's UTF-8 bytes without those covered by a string of ``length`` bytes
    that also starts anywhere else in the corpus, the same text included.

    Matches don't cross texts and are judged on the input. Null texts count as empty ones; texts shorter than ``length`` stay whole.
    Repeated rows are each a text, so that copies of ``length`` bytes or more lose all. Very long texts are taken whole. Null ids stay
    null; an empty table gives an empty one; there are no ties to break. Other columns, whatever their names, are not read. spans and
    kept are in bytes; kept may cut a character.
    """
    if length < gram + PERIOD:
        raise ValueError("length must exceed the gram by a period")
    scratch = Scratch(docs.sparkSession, "suffixes")
    names = [o for o in OUTPUTS if o in outputs]
    table = scratch.save(chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chunk_bytes), "chunks")
    total = table.agg(F.sum("n")).first()[0] or 0
    table_bits = max(2, math.ceil(math.log2(2 * total / (length - gram) / TABLE_HASHES + 1)))

    def asking():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for row in batch.to_pylist():
                c = Texts(row, length, gram)
                rows += _asking(ANCHOR, row["chunk"], c.distinct, np.bincount(c.of, minlength=len(c.distinct)), table_bits)
            return pa.RecordBatch.from_arrays([x.combine_chunks() for x in _table_of(rows, _ASKED).columns], schema=_ASKED)

        return run

    body = table.select("chunk", "sizes", "data")
    asked = map_batches(body, asking, _ASKED_SQL)
    told = scratch.save(asked.groupBy("kind", "part").applyInArrow(_counted(hot), _TOLD_SQL), "anchors")
    repeated = told.agg(F.sum("repeated")).first()[0] or 0
    bits = max(2, math.ceil(math.log2(repeated * (length + (length - gram) // 2) / block_bytes + 1)))
    sent = scratch.save(body.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_contexts(length, gram, bits, table_bits), _SENT_SQL), "contexts")
    blocks = sent.where("part >= 0").drop("asked", "asked_counts").groupBy("part").applyInArrow(_sorted_block(length, bucket_windows), _FOUND_SQL)
    frequent = sent.where("part < 0").select(F.lit(WINDOW).alias("kind"), (-1 - F.col("part")).alias("part"), "chunk", F.col("asked").alias("hashes"), F.col("asked_counts").alias("counts"))
    windows = scratch.save(frequent.groupBy("kind", "part").applyInArrow(_counted(1 << 62), _TOLD_SQL), "windows")
    void = F.lit(None)
    found = blocks.select("chunk", "part", "starts", "counts", "bits", void.cast("int").alias("kind"), void.cast("binary").alias("marks"))
    having = windows.select("chunk").distinct()
    marks = windows.unionByName(told.join(having, "chunk", "left_semi").select(*windows.columns)).select("chunk", "part", void.cast("binary").alias("starts"), void.cast("binary").alias("counts"), void.cast("binary").alias("bits"), "kind", "marks")
    found = scratch.save(found.unionByName(marks), "found")
    scratch.drop(sent)
    done = table.select("chunk", "ids", "nulls", "sizes", "data").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_cut(length, gram, names), "doc_id long, " + ", ".join(f"{n} {OUTPUTS[n][1]}" for n in names))
    return done
