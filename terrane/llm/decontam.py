"""Benchmark items in documents, verbatim or paraphrased, by latent semantic retrieval.

Items are cut into passages of PASSAGE words at most, so that none is lost by its length. Passages of items and of documents are TF-IDF
vectors; word weights come from all documents, counted in a sketch of fixed size. A distributed randomised SVD of such passages gives a
space of RANK dimensions, far fewer than there are passages: each task multiplies its rows with a narrow matrix and back, sums are added
up piece by piece, and the driver orthogonalises what has the width of the sketch (a Gaussian start, power steps, the last of which also
gives the small eigenproblem). The rows it is fitted on are the passages of all items and of all documents, each cut from end to end.

Every document is searched whole: passages of several lengths, overlapping, are projected and compared with those of all items by cosine.
Passages most of whose weight lies on words of no item can't be one and are left out first. Candidates are confirmed on the words
themselves: the longest common subsequence with the whole item must hold VERBATIM of its words, or PARAPHRASE of them and the item's
answer, its last words. Items under SHORT words, too little for a cosine, are looked up as exact runs of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.katz import pack, unpack
from terrane.llm.store import Scratch
from terrane.llm.sums import SUMS, in_pieces, summed, total_of
from terrane.llm.text import batch_of, map_batches, mix, word_hashes

#: Cells of the document-frequency sketch, and features of the space; words that share a feature are told apart by the exact check.
CELLS, FEATURES = 1 << 18, 1 << 14
#: Dimensions of the space, width of the sketch beyond them, power steps; words of items a scan looks for.
RANK, MORE, POWER, SCAN_WORDS = 128, 16, 2, 500_000
#: Words of an item's passage; of a document's, with a quarter of it as stride, and of the items' passages that it is compared with, whose
#: shorter ones have passages of just their own length at every word; words that make an item short.
PASSAGE, LENGTHS, SHORT = 32, ((20, 15, 28), (32, 24, 1 << 30)), 8
COSINE, MASS, VERBATIM, PARAPHRASE, ANSWER_WORDS, ANSWER = 0.5, 0.25, 0.8, 0.6, 5, 0.8
_BLOCK, _GROUP, _DENSE = 1 << 13, 1 << 16, 6000


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def idf_of(n: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequency by cell, from the number of documents and of those that hold a word of the cell."""
    return np.log((n + 1) / ((df if n else np.zeros(CELLS)) + 0.5)).clip(0.01).astype(np.float32)


def passages_of(n: int) -> list[tuple[int, int]]:
    """Where an item of n words is cut: passages of PASSAGE words, the last one up to its end; one alone if it isn't much longer."""
    if n <= PASSAGE * 3 // 2:
        return [(0, n)]
    return [(a, a + PASSAGE) for a in range(0, n - PASSAGE, PASSAGE)] + [(n - PASSAGE, n)]


class Items:
    """The items of a scan: the words of those that go by cosine, their passages and vocabulary; hashed runs of short ones by length."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], idf: np.ndarray):
        self.ids = [i for i, h in rows if len(h) >= SHORT]
        self.words = [h for _, h in rows if len(h) >= SHORT]
        self.passages = [(i, a, b) for i, h in enumerate(self.words) for a, b in passages_of(len(h))]
        self.vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.weigh(idf)
        v = len(self.vocab)
        self.feature = np.arange(v) if v <= FEATURES else (mix(self.vocab + np.uint64(77)) >> np.uint64(50)).astype(np.int64)
        self.features = min(v, FEATURES)
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, h in rows:
            if 0 < len(h) < SHORT:
                self.short.setdefault(len(h), {}).setdefault(int(_runs(h, len(h))[0]), []).append(i)

    def weigh(self, idf: np.ndarray) -> None:
        self.weight = idf[_cell(self.vocab)]

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words in the vocabulary, and whether they are there."""
        slot = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return slot, self.vocab[slot] == h


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = mix(out + h[i : i + len(out)] + np.uint64(i + 1))
    return out


def rows_of(items: Items, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages (words) as a sparse matrix of rows of length 1 over the features: starts of rows, features, values."""
    sizes, at, values = [], [], []
    for h in passages:
        slot, known = items.places(h)
        slot = slot[known]
        v = items.weight[slot]
        norm = np.sqrt((np.bincount(np.unique(slot, return_inverse=True)[1], weights=v) ** 2).sum()) if len(slot) else 0.0
        sizes.append(len(slot) if norm else 0)
        if norm:
            at.append(items.feature[slot])
            values.append(v / norm)
    return np.cumsum([0, *sizes]), np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.float32), *values])


def lot_of(items: Items, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts (words) in rows of PASSAGE words, the last of a text with what is left: starts of rows, places in the vocabulary, counts."""
    n = np.array([len(h) for h in texts], np.int64)
    parts = np.maximum(n // PASSAGE, 1)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.cumsum(parts) - parts, n) + np.minimum(at // PASSAGE, np.repeat(parts - 1, n))
    if not len(items.vocab):
        return np.zeros(parts.sum() + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot, known = items.places(np.concatenate([np.zeros(0, np.uint64), *texts]))
    code, count = np.unique(row[known] * np.int64(len(items.vocab)) + slot[known], return_counts=True)
    row, slot = np.divmod(code, len(items.vocab))
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=parts.sum()))]), slot, count


def weighed(items: Items, start: np.ndarray, slot: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A lot's rows as ``rows_of`` gives them, but for the order in a row and that a word stands once in it."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    v = items.weight[slot] * count
    return start, items.feature[slot], (v / np.sqrt(np.bincount(row, v.astype(np.float64) ** 2, len(start) - 1)[row])).astype(np.float32)


def cut(docs: DataFrame, items: Items, scratch: Scratch) -> DataFrame:
    """All documents' passages in lots, and pieces of the numbers of documents by cell, from one look at each text."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([("piece", pa.int32()), ("n", pa.int64()), ("sums", pa.binary()), ("start", pa.binary()), ("slot", pa.binary()), ("count", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, n, texts, words = np.zeros(CELLS, np.uint32), np.zeros(CELLS, np.int64), 0, [], 0

        def lot() -> pa.RecordBatch:
            start, slot, count = lot_of(shared.value, texts)
            return batch_of(schema, [[None], [None], [None], [pack(start)], [pack(slot.astype(np.uint32))], [pack(count.astype(np.uint8))]])

        for batch in batches:
            for text in batch.column(0):
                h = word_hashes(text.as_py())
                cell, place = _cell(h), np.arange(len(h))
                last[cell] = place
                total[cell[last[cell] == place]] += 1  # each cell where it stands last
                texts.append(h)
                n, words = n + 1, words + len(h)
                if words >= _GROUP:
                    yield lot()
                    texts, words = [], 0
        if n:
            yield lot()
            pieces = in_pieces(total, n)
            yield batch_of(schema, [*pieces.columns, *[pa.nulls(pieces.num_rows, pa.binary())] * 3])

    return scratch.save(docs.select("text").mapInArrow(run, "piece int, n long, sums binary, start binary, slot binary, count binary"), "passages")


def there_and_back(start: np.ndarray, at: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'(A x) for the rows given."""
    out = np.zeros(x.shape)
    size = np.diff(start)
    full = np.flatnonzero(size)
    if len(full):
        y = np.add.reduceat(values[:, None] * x[at], start[full])
        order = np.argsort(at, kind="stable")
        by, row = at[order], np.repeat(np.arange(len(full)), size[full])[order]
        first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        out[by[first]] = np.add.reduceat(values[order, None] * y[row], first)
    return out


def products(rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """A'(A x) for several lots of rows; up to _DENSE features A'A is added up first, as rows hold far fewer pairs than x has numbers."""
    if len(x) > _DENSE:
        return sum(there_and_back(*r, x) for r in rows)
    square = np.zeros(len(x) ** 2, np.float32)
    for start, at, values in rows:
        at = at.astype(np.int64)
        end = np.repeat(start[1:], np.diff(start))
        here, values = np.arange(len(at)), values.astype(np.float32)
        for d in range(int(np.diff(start).max(initial=0))):
            here = here[here + d < end[here]]
            np.add.at(square, at[here] * len(x) + at[here + d], values[here] * values[here + d] * np.float32(1 if d else 0.5))
    square = square.reshape(len(x), len(x))
    return (square @ x + square.T @ x).astype(np.float64)


class Space:
    """A basis by feature, and the items' passages in it, of length 1."""

    def __init__(self, items: Items, basis: np.ndarray):
        self.basis = basis.astype(np.float32)
        start, at, values = rows_of(items, [items.words[i][a:b] for i, a, b in items.passages])
        z = np.stack([values[a:b] @ self.basis[at[a:b]] for a, b in zip(start[:-1], start[1:], strict=True)])
        self.passages = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit(items: Items, docs: DataFrame, n_docs: int, scratch: Scratch, rank: int = RANK, seed: int = 11, found: DataFrame | None = None) -> Space:
    """The space of a scan's items, from their passages and those of all documents (n_docs), by a distributed randomised SVD.

    A power step multiplies the sketch q by A'A; of the last one, t, the eigenvectors of t (q't)^-1 t' are taken. ``found`` is what
    ``cut`` makes of the documents for these items, if there already.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    if n_docs:
        found = (cut(docs, items, scratch) if found is None else found).where("piece IS NULL").select("start", "slot", "count")
    of_items = rows_of(items, [items.words[i][a:b] for i, a, b in items.passages])
    width = min(rank + MORE, items.features)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((items.features, width)))[0]
    for step in range(POWER):
        if step:
            q = np.linalg.qr(product)[0]
        product = products([of_items], q)
        if n_docs:
            x = spark.sparkContext.broadcast(q.astype(np.float32))

            def multiply(lots: Iterator[dict], x=x) -> np.ndarray:
                return products((weighed(shared.value, *(unpack(r[k]) for k in ("start", "slot", "count"))) for r in lots), x.value)

            product += summed(found, multiply)[1].reshape(q.shape)
            x.unpersist()
    small, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
    kept = small > 1e-9 * max(small[-1], 1e-30)
    basis, size, _ = np.linalg.svd(product @ (turn[:, kept] / np.sqrt(small[kept])), full_matrices=False)
    basis = basis[:, :rank][:, size[:rank] ** 2 > 1e-9 * max(size[0] ** 2, 1e-30)]
    return Space(items, basis)


def common_subsequence(mask: dict[int, int], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence with a sequence of m words given by the places of each; bit-parallel."""
    full = (1 << m) - 1
    v = full
    for w in words:
        if u := v & mask.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


class Item:
    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.mask: dict[int, int] = {}
        self.answer: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            self.mask[w] = self.mask.get(w, 0) | 1 << i
        self.count = {w: m.bit_count() for w, m in self.mask.items()}
        last = words.tolist()[-ANSWER_WORDS:]
        self.answer_n = len(last)
        for i, w in enumerate(last):
            self.answer[w] = self.answer.get(w, 0) | 1 << i

    def found_in(self, words: list[int]) -> float:
        """The share of the item that stretches of half as much again hold in order, if it is enough; else 0."""
        if sum(map(self.count.__getitem__, self.count.keys() & set(words))) < PARAPHRASE * self.n:
            return 0.0  # too few of its words are there in any order
        width, step, best = self.n * 3 // 2 + 2, max(1, self.n // 4), 0.0
        for at in range(0, max(1, len(words) - width + step), step):
            here = words[at : at + width]
            share = common_subsequence(self.mask, self.n, here) / self.n
            if share >= VERBATIM or share >= PARAPHRASE and common_subsequence(self.answer, self.answer_n, here) >= ANSWER * self.answer_n:
                best = max(best, share)
        return best


class Finder:
    def __init__(self, items: Items, space: Space | None, idf: np.ndarray):
        self.items, self.space, self.squares = items, space, idf.astype(np.float64) ** 2
        self.item = lru_cache(4096)(lambda i: Item(items.words[i]))
        self.sizes = np.array([len(w) for w in items.words], np.int64)
        if space:
            self.basis = space.basis
            sizes = np.array([b - a for _, a, b in items.passages])
            self.item_of = np.array([i for i, _, _ in items.passages])
            self.lengths = []
            for length, stride, least, most in [(n, 1, n, n) for n in np.unique(sizes[sizes < LENGTHS[0][1]]).tolist()] + [(n, n // 4, a, b) for n, a, b in LENGTHS]:
                own = np.flatnonzero((sizes >= least) & (sizes <= most))
                if len(own):
                    self.lengths.append((length, stride, own, np.ascontiguousarray(space.passages[own].T)))
            self.reach = max((n for n, _, _, _ in self.lengths), default=0)

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """(item, start, end) by rows for the document's passages that come near one of the item's, in blocks of some thousand words."""
        out = [np.zeros((0, 3), np.int64)]
        for at in range(0, max(1, len(h)), _BLOCK):
            block = h[at : at + _BLOCK + self.reach]
            slot, known = self.items.places(block)
            square = self.squares[_cell(block)]
            mass = np.concatenate([[0], np.cumsum(square)])
            own = np.concatenate([[0], np.cumsum(np.where(known, square, 0))])
            n = len(block)
            windows, covered = [], np.zeros(n + 1, np.int64)
            for length, stride, columns, passages in self.lengths:
                start = np.arange(0, _BLOCK if n > _BLOCK else max(1, n - length + stride), stride)
                end = np.minimum(start + length, n)
                good = own[end] - own[start] >= MASS * np.maximum(mass[end] - mass[start], 1e-30)
                start, end = start[good], end[good]
                if len(start):
                    windows.append((start, end, columns, passages))
                    covered += np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
            if not windows:
                continue
            # Vectors are added up over the known words of these passages alone.
            wanted = known & (np.cumsum(covered[:n]) > 0)
            slot = slot[wanted]
            before = np.concatenate([[0], np.cumsum(wanted)])
            run = np.zeros((len(slot) + 1, self.basis.shape[1]), np.float32)
            np.cumsum(self.basis[self.items.feature[slot]] * self.items.weight[slot][:, None], axis=0, out=run[1:])
            for start, end, columns, passages in windows:
                z = run[before[end]] - run[before[start]]
                size = np.sqrt(np.einsum("ij,ij->i", z, z))
                window, column = np.nonzero(z @ passages >= COSINE * np.maximum(size, 1e-9)[:, None])
                if len(window):
                    out.append(np.stack([self.item_of[columns[column]], start[window] + at, end[window] + at], 1))
        return np.concatenate(out)

    def stretches(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """The parts of a document to look through for an item: its candidates and as many words as the item has on either side."""
        near = self.candidates(h)
        if not len(near):
            return []
        size = self.sizes[near[:, 0]]
        start, end = np.maximum(near[:, 1] - size, 0), np.minimum(near[:, 2] + size, len(h))
        order = np.lexsort((start, near[:, 0]))
        item, start, end = near[order, 0], start[order], end[order]
        # Stretches of an item that touch become one: ends so far, item by item.
        base = item * np.int64(1 << 40)
        far = np.maximum.accumulate(base + end) - base
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] > far[:-1])])
        first = np.flatnonzero(new)
        return list(zip(item[first].tolist(), start[first].tolist(), np.append(far[first[1:] - 1], far[-1]).tolist(), strict=True))

    def find(self, text: str | None) -> list[tuple[int, float]]:
        """Items in a whole text with the share that is there."""
        h = word_hashes(text)
        hits: dict[int, float] = {}
        for n, runs in self.items.short.items():
            if len(h) >= n:
                for r in np.unique(_runs(h, n)).tolist():
                    for i in runs.get(r, ()):
                        hits[i] = 1.0
        if self.space and len(h):
            words: list[int] = []
            for i, start, end in self.stretches(h):
                words = words or h.tolist()
                if share := self.item(i).found_in(words[start:end]):
                    hits[self.items.ids[i]] = max(hits.get(self.items.ids[i], 0.0), share)
        return sorted(hits.items())


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` with contaminated, item_ids (sorted) and best_share added; columns of these names are replaced.

    Null and empty texts hold nothing; very long ones are searched whole. Items with a null id or without words are never found; of items
    that repeat an id each counts, and an id is named once. Items under SHORT words count as found where they stand as they are, word by
    word (an item of one word wherever that word is); longer ones of any length by VERBATIM, or PARAPHRASE and the answer. There are no
    ties to break: all items that are found are named. Repeated rows each give a row; other columns pass through, whatever their names.
    Empty tables give empty results, and an empty benchmark leaves all documents clean.
    """
    scratch = Scratch(docs.sparkSession, "items")
    benchmark = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows = docs.select(*[c for c in docs.columns if c not in ("contaminated", "item_ids", "best_share")])
    found_in, share_of = (_unused(n, rows.columns) for n in ("items_found", "shares_found"))
    added = [T.StructField(found_in, T.ArrayType(T.LongType())), T.StructField(share_of, T.ArrayType(T.DoubleType()))]
    n_docs, idf = 0, None
    scans = max(1, -(-int(benchmark.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0) // SCAN_WORDS))
    out = rows.withColumns({found_in: F.array().cast("array<bigint>"), share_of: F.array().cast("array<double>")})
    at = rows.columns.index("text")
    for scan in range(scans):
        here = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(scans)) == scan).collect()  # SCAN_WORDS words, about
        items = Items(sorted(((r["item_id"], word_hashes(r["text"])) for r in here), key=lambda r: r[0]), np.zeros(CELLS, np.float32))
        if not items.ids and not items.short:
            continue
        passages = cut(rows, items, scratch)
        if idf is None:
            n_docs, df = total_of(passages.where("piece IS NOT NULL").select("piece", "n", "sums"))
            idf = idf_of(n_docs, df)
        items.weigh(idf)
        space = fit(items, rows, n_docs, scratch, found=passages) if items.ids else None
        scratch.drop(passages)
        shared = docs.sparkSession.sparkContext.broadcast((items, space, idf))

        def kernel(shared=shared):
            finder = Finder(*shared.value)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [finder.find(t.as_py()) for t in batch.column(at)]
                kept = batch.num_columns - 2
                names = [a + [k for k, _ in f] for a, f in zip(batch.column(kept).to_pylist(), found, strict=True)]
                shares = [a + [v for _, v in f] for a, f in zip(batch.column(kept + 1).to_pylist(), found, strict=True)]
                return batch_of(pa.schema([*list(batch.schema)[:kept], (found_in, pa.list_(pa.int64())), (share_of, pa.list_(pa.float64()))]), [*batch.columns[:kept], names, shares])

            return run

        out = map_batches(out, kernel, T.StructType([*rows.schema.fields, *added]))
        if scan + 1 < scans:
            out = scratch.save(out, "scan")
    return out.select(*rows.columns, (F.size(found_in) > 0).alias("contaminated"), F.array_sort(F.array_distinct(found_in)).alias("item_ids"), F.coalesce(F.array_max(share_of), F.lit(0.0)).alias("best_share"))


def _unused(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name
