"""Katz backoff language model over words, trained and evaluated on whole corpora.

P(w | h) = d(c) c(h, w) / (c(h) + 1) if the pair was seen, else alpha(h) P(w), and P(w) = d(c) c(w) / (N + 1) if the word was, else the
mass that is left, for all unknown words together. d is the Good-Turing discount of counts up to GT_MAX. The added 1 keeps some mass in
each context even if none of its counts is discounted; alpha(h) is what the seen words leave over what the lower order gives the unseen
ones, so that each distribution sums to 1.

Tokens never travel one by one. Texts are packed into chunks of distinct words, distinct pairs and token places. Chunks ask for counts:
their distinct hashes go, sorted and delta-coded, to the count tables, which are partitioned by hash, so that a word or pair is sent once
a chunk however often it occurs, and no word is hot. The replies hold a count for each hash in the order asked. From them each chunk sums,
by context, the seen mass of those pairs that the table gave it to own; context tables, partitioned alike, add these up, and the chunks
score each token by recursion from pair to word to unknown word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.store import Scratch
from terrane.llm.text import map_batches, mix, word_hashes

#: Counts above this are not discounted.
GT_MAX = 5
#: Tokens that fill a chunk, and hashes that a part of a count table holds, about.
CHUNK_TOKENS, TABLE_HASHES = 1_500_000, 1_500_000
_END, _BEGIN = np.uint64(0x9F3C6A5B1D2E4F71), np.uint64(0x3B1F8C27D6E5A409)
WORD, PAIR = 0, 1


def pack(a: np.ndarray) -> bytes:
    """An array of numbers by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return a.dtype.char.encode() + zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 3)


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    planes = np.frombuffer(zstandard.decompress(b[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    d = unpack(b)
    return np.cumsum(d, dtype=d.dtype)


def pack_values(a: np.ndarray) -> bytes:
    """Numbers of which many are alike: by the distinct ones and their places among them, commonest first, where that is shorter."""
    values, code = np.unique(a, return_inverse=True)
    order = np.argsort(-np.bincount(code, minlength=len(values)), kind="stable")
    rank = np.empty(len(values), np.uint32)
    rank[order] = np.arange(len(values))
    head = pack(values[order])
    return min(pack(a), b"#" + len(head).to_bytes(4, "little") + head + pack(rank[code]), key=len)


def unpack_values(b: bytes) -> np.ndarray:
    if b[:1] != b"#":
        return unpack(b)
    end = 5 + int.from_bytes(b[1:5], "little")
    return unpack(b[5:end])[unpack(b[end:])]


@dataclass
class Chunk:
    """Whole texts: vocab holds their distinct word hashes, sorted; tokens their places in it, each text closed by the end."""

    train: np.ndarray
    lengths: np.ndarray
    vocab: np.ndarray
    tokens: np.ndarray

    def __post_init__(self):
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.in_train = np.repeat(self.train.astype(bool), self.lengths)
        self.begin = len(self.vocab)  # the place of the context that opens a text
        context = np.concatenate([[0], self.tokens[:-1]]).astype(np.int64)
        context[self.starts] = self.begin
        code, self.pair_of = np.unique(context * (self.begin + 1) + self.tokens, return_inverse=True)
        self.context, self.target = code // (self.begin + 1), code % (self.begin + 1)
        hashes = np.append(self.vocab, _BEGIN)
        self.pair_hash = mix(mix(hashes[self.context] + np.uint64(1)) + hashes[self.target])
        self.order = np.argsort(self.pair_hash)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.in_train], minlength=len(self.vocab))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.in_train], minlength=len(self.context))


_CHUNKS = "chunk long, ids binary, nulls binary, train binary, lengths binary, vocab binary, tokens binary, n long"


def chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """docs: doc_id, text, train. Chunk names hold the partition and are fixed once the table is written."""
    schema = pa.schema([("chunk", pa.int64()), *((k, pa.binary()) for k in ("ids", "nulls", "train", "lengths", "vocab", "tokens")), ("n", pa.int64())])

    def run(batches):
        ids, train, hashes, n, made = [], [], [], 0, 0
        task = TaskContext.get()
        part = task.partitionId() if task else 0

        def flush():
            all_hashes = np.concatenate(hashes)
            vocab, tokens = np.unique(all_hashes, return_inverse=True)
            row = [part << 32 | made, pack(np.array([i or 0 for i in ids], np.int64)), pack(np.array([i is None for i in ids], np.uint8)), pack(np.array(train, np.uint8)), pack(np.array([len(h) for h in hashes], np.int64)), pack_sorted(vocab), pack(tokens.astype(np.uint32)), len(all_hashes)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, text, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                train.append(bool(t))
                hashes.append(np.append(word_hashes(text.as_py()), _END))
                n += len(hashes[-1])
                if n >= chunk_tokens:
                    yield flush()
                    ids, train, hashes, n, made = [], [], [], 0, made + 1
        if ids:
            yield flush()

    return docs.mapInArrow(run, _CHUNKS)


def _chunk_of(row: dict) -> Chunk:
    return Chunk(unpack(row["train"]), unpack(row["lengths"]), unpack_sorted(row["vocab"]), unpack(row["tokens"]).astype(np.int64))


def _slices(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits parts begins in sorted hashes."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


_ASKED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _requests(table: DataFrame, bits: int) -> DataFrame:
    def kernel():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for row in batch.to_pylist():
                c = _chunk_of(row)
                for kind, hashes, counts in ((WORD, c.vocab, c.word_counts()), (PAIR, c.pair_hash[c.order], c.pair_counts()[c.order])):
                    at = _slices(hashes, bits)
                    rows += [(kind, p, row["chunk"], pack_sorted(hashes[a:b]), pack(counts[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _ASKED, strict=True)], schema=_ASKED)

        return run

    return map_batches(table.select("chunk", "train", "lengths", "vocab", "tokens"), kernel, "kind int, part int, chunk long, hashes binary, counts binary")


_REPLIES = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("owned", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _counted(key: tuple, table: pa.Table) -> pa.Table:
    """A part of a count table: its counts for each chunk that asked, and its numbers of hashes by count."""
    kind, part = key[0].as_py(), key[1].as_py()
    rows = sorted(zip(table["chunk"].to_pylist(), table["hashes"].to_pylist(), table["counts"].to_pylist(), strict=True))
    asked = [unpack_sorted(r[1]) for r in rows]
    sizes = np.cumsum([0, *map(len, asked)])
    hashes, place = np.unique(np.concatenate(asked), return_inverse=True)
    given = np.concatenate([unpack(r[2]) for r in rows])
    total = np.bincount(place, weights=given, minlength=len(hashes)).astype(np.int64)
    owned = np.zeros(len(given), bool)
    with_any = np.flatnonzero(given)
    _, first = np.unique(place[with_any], return_index=True)
    owned[with_any[first]] = True
    replies, flags = total[place].astype(np.uint64), np.packbits(owned)
    del place, given
    seen = total[total > 0]
    stats = [int(seen.sum()), len(seen), *(int((seen == r).sum()) for r in range(1, GT_MAX + 2))]
    out = [(r[0], kind, part, pack(replies[a:b].astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.uint64)), zstandard.compress(np.packbits(np.unpackbits(flags)[a:b]).tobytes()), None) for r, a, b in zip(rows, sizes[:-1], sizes[1:], strict=True)]
    out.append((-1, kind, part, None, None, stats))
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _REPLIES, strict=True)], schema=_REPLIES)


@dataclass
class Constants:
    """What all tokens share: numbers of training tokens and words, and discounts by count."""

    tokens: int
    words: int
    word_discount: np.ndarray
    pair_discount: np.ndarray
    unknown: float  # probability of all unknown words together

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        p = self.word_discount[np.minimum(count, GT_MAX + 1)] * count / (self.tokens + 1)
        return np.where(count > 0, p, self.unknown)


def discounts(by_count: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 0 to GT_MAX, then 1; by_count: how many have count 1 to GT_MAX + 1.

    Where the table is too small for them (a discount not between 0 and 1), a constant part of 1 is taken off each count instead.
    """
    n = [0, *by_count]
    out = np.ones(GT_MAX + 2)
    common = (GT_MAX + 1) * n[GT_MAX + 1] / n[1] if n[1] else 1.0
    good = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else -1.0 for r in range(1, GT_MAX + 1)]
    if all(0 < d <= 1 for d in good):
        out[1 : GT_MAX + 1] = good
    elif n[1]:
        off = n[1] / (n[1] + 2 * n[2])
        r = np.arange(1, GT_MAX + 1)
        out[1 : GT_MAX + 1] = (r - min(off, 0.9)) / r
    return out


def _constants(replies: DataFrame) -> Constants:
    sums = {k: [0] * (GT_MAX + 3) for k in (WORD, PAIR)}
    parts = replies.where("chunk = -1").select("kind", F.posexplode("stats").alias("at", "v")).groupBy("kind", "at").agg(F.sum("v").alias("v"))
    for kind, at, v in parts.collect():
        sums[kind][at] = v
    tokens, words, *by_count = sums[WORD]
    d = discounts(by_count)
    unknown = (1 + sum(n * r * (1 - d[r]) for r, n in enumerate(by_count[:GT_MAX], 1))) / (tokens + 1)
    return Constants(tokens, words, d, discounts(sums[PAIR][2:]), unknown)


_SCORED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("hashes", pa.binary()), ("seen", pa.binary()), ("lower", pa.binary()), ("asks", pa.binary()), ("docs", pa.binary()), ("base", pa.binary()), ("score", pa.binary()), ("known", pa.binary()), ("open_doc", pa.binary()), ("open_context", pa.binary()), ("context_count", pa.binary())])
_SCORED_SQL = "chunk long, part int, hashes binary, seen binary, lower binary, asks binary, docs binary, base binary, score binary, known binary, open_doc binary, open_context binary, context_count binary"


def _by_kind(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r["part"], r["counts"], r["owned"]) for r in table.select(["kind", "part", "counts", "owned"]).to_pylist() if r["kind"] == kind)
    counts = [unpack(r[1]).astype(np.int64) for r in rows]
    owned = [np.unpackbits(np.frombuffer(zstandard.decompress(r[2]), np.uint8))[: len(c)].astype(bool) for r, c in zip(rows, counts, strict=True)]
    return np.concatenate(counts), np.concatenate(owned)


def _scored(constants: Constants, bits: int):
    """Of a chunk and its replies: per text what needs no alpha, the tokens that do, and each context's owned mass."""

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SCORED.empty_table()
        row = table.to_pylist()[0]
        c = _chunk_of(row)
        count, _ = _by_kind(replies, WORD)
        by_hash, owned_by_hash = _by_kind(replies, PAIR)
        pair, owned = np.empty_like(by_hash), np.empty_like(owned_by_hash)
        pair[c.order], owned[c.order] = by_hash, owned_by_hash
        context_count = np.append(count, replies["texts"][0].as_py())
        p1 = constants.word_probability(count)
        mass = constants.pair_discount[np.minimum(pair, GT_MAX + 1)] * pair
        seen = pair > 0
        with np.errstate(divide="ignore"):
            log_pair = np.where(seen, np.log10(mass) - np.log10(context_count[c.context] + 1.0), np.log10(p1)[c.target])
        # A context that was never seen leaves all to the lower order.
        open_pair = ~seen & (context_count[c.context] > 0)
        score = np.add.reduceat(log_pair[c.pair_of], c.starts)
        base = np.add.reduceat(np.log10((count + 1.0) / (constants.tokens + constants.words + 1.0))[c.tokens], c.starts)
        known = np.add.reduceat((count > 0).astype(np.int64)[c.tokens], c.starts)
        open_token = np.flatnonzero(open_pair[c.pair_of])
        open_doc = np.searchsorted(c.starts, open_token, "right") - 1
        open_context = c.context[c.pair_of[open_token]]
        lower = np.bincount(c.context[owned], weights=p1[c.target[owned]], minlength=c.begin + 1)
        held = np.bincount(c.context[owned], weights=mass[owned], minlength=c.begin + 1)
        asks = np.zeros(c.begin + 1, np.uint8)
        asks[open_context] = 1
        hashes = np.append(c.vocab, _BEGIN)
        order = np.argsort(hashes)
        order = order[(held[order] > 0) | (asks[order] > 0)]
        at = _slices(hashes[order], bits)
        place = np.full(c.begin + 1, -1)
        asked = order[asks[order] > 0]
        place[asked] = np.arange(len(asked))
        rows = [{"chunk": row["chunk"], "part": p, "hashes": pack_sorted(hashes[order[a:b]]), "seen": pack_values(held[order[a:b]]), "lower": pack_values(lower[order[a:b]]), "asks": pack(asks[order[a:b]])} for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
        rows.append({"chunk": row["chunk"], "part": -1, "docs": pack(c.lengths), "base": pack(base), "score": pack(score), "known": pack(known), "open_doc": pack(open_doc.astype(np.uint32)), "open_context": pack(place[open_context].astype(np.uint32)), "context_count": pack(context_count[asked].astype(np.uint64))})
        return pa.Table.from_pylist(rows, schema=_SCORED)

    return run


_ALPHA = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("seen", pa.binary()), ("lower", pa.binary())])


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    """A part of the context table: each context's seen mass and that of the lower order, for the chunks that ask."""
    rows = sorted(table.select(["chunk", "hashes", "seen", "lower", "asks"]).to_pylist(), key=lambda r: r["chunk"])
    asked = [unpack_sorted(r["hashes"]) for r in rows]
    sizes = np.cumsum([0, *map(len, asked)])
    hashes, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = [np.bincount(place, weights=np.concatenate([unpack_values(r[k]) for r in rows]), minlength=len(hashes)) for k in ("seen", "lower")]
    out = []
    for r, a, b in zip(rows, sizes[:-1], sizes[1:], strict=True):
        at = place[a:b][unpack(r["asks"]) > 0]
        if len(at):
            out.append((r["chunk"], key[0].as_py(), pack_values(total[0][at]), pack_values(total[1][at])))
    return pa.Table.from_pylist([dict(zip(_ALPHA.names, x, strict=True)) for x in out], schema=_ALPHA)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finished(key: tuple, table: pa.Table, alphas: pa.Table) -> pa.Table:
    if not table.num_rows:
        return _OUT.empty_table()
    r = table.to_pylist()[0]
    score = unpack(r["score"]).copy()
    if alphas.num_rows:
        parts = sorted((a["part"], a["seen"], a["lower"]) for a in alphas.to_pylist())
        seen, lower = (np.concatenate([unpack_values(p[k]) for p in parts]) for k in (1, 2))
        alpha = np.log10(1 - seen / (unpack(r["context_count"]) + 1.0)) - np.log10(1 - lower)
        open_doc = unpack(r["open_doc"])
        score += np.bincount(open_doc, weights=alpha[unpack(r["open_context"])], minlength=len(score))
    ids, nulls = unpack(r["ids"]), unpack(r["nulls"]).astype(bool)
    return pa.Table.from_arrays([pa.array(ids, pa.int64(), mask=nulls), pa.array(unpack(r["train"]) == 0), pa.array(unpack(r["docs"])), pa.array(unpack(r["known"])), pa.array(unpack(r["base"])), pa.array(score)], schema=_OUT)


def score(docs: DataFrame, train: Column, chunk_tokens: int = CHUNK_TOKENS, table_hashes: int = TABLE_HASHES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``, learned from the rows of ``train``.

    Tokens are the text's words with A-Z lower-cased, then one end. score is the model's log10 probability of the text, base_score that
    of add-one unigrams, n_known the number of tokens seen in training. Null and empty texts have the end alone. Rows that repeat count
    as often as they occur; null ids stay null; other columns are not read. Without training rows every word is unknown.
    """
    scratch = Scratch(docs.sparkSession, "katz")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    table = scratch.save(chunks(rows, chunk_tokens), "chunks")
    n = table.agg(F.sum("n")).first()[0] or 0
    texts = rows.where("train").count()
    bits = max(2, math.ceil(math.log2(max(1, n) / table_hashes + 1)))
    spread = max(4, 1 << bits)
    asked = _requests(table, bits).repartition(2 * spread, "kind", "part")
    replies = scratch.save(asked.groupBy("kind", "part").applyInArrow(_counted, "chunk long, kind int, part int, counts binary, owned binary, stats array<long>"), "counts")
    constants = _constants(replies)
    told = replies.where("chunk >= 0").select("chunk", "kind", "part", "counts", "owned", F.lit(texts).cast("long").alias("texts"))
    scored = table.select("chunk", "ids", "train", "lengths", "vocab", "tokens").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scored(constants, bits), _SCORED_SQL)
    scored = scratch.save(scored, "scored")
    scratch.drop(replies)
    alphas = scratch.save(scored.where("part >= 0").select("chunk", "part", "hashes", "seen", "lower", "asks").groupBy("part").applyInArrow(_summed, "chunk long, part int, seen binary, lower binary"), "contexts")
    ends = scored.where("part = -1").join(table.select("chunk", "ids", "nulls", "train"), "chunk")
    done = ends.groupBy("chunk").cogroup(alphas.groupBy("chunk")).applyInArrow(_finished, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(constants.tokens).cast("long").alias("train_tokens"), "base_score", "score")
