"""Exact top-k search by BM25 over a sharded inverted index with block-max WAND pruning.

Each shard of documents has its own inverted index, in blocks of documents that are alike in frequent words and length. A query is the
set of distinct words of a text. Block-max WAND passes over documents whose terms' block maxima can't add up to the k-th best score so
far. Here the pivot test is made for a block and all queries at once: the maxima of all of a query's terms in the block are added up,
and only of queries whose sum reaches their threshold are postings scored, those of rare terms first. What the many postings of frequent
terms add is worked out as a matrix product for queries that still reach it. Document frequencies and the mean length are those of all
shards, so that the shards' best k merge into the exact answer. Queries go through the index in turns of bounded size, whatever their
number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.katz import pack, pack_sorted, unpack, unpack_sorted
from terrane.llm.store import Scratch
from terrane.llm.text import batch_of, map_batches, word_hashes

K1, B = 1.2, 0.75
#: Words and documents of a shard, documents and queries of a block, and query terms that go through the index in a turn (24 MB).
SHARD_WORDS, SHARD_DOCS, BLOCK_DOCS, BLOCK_QUERIES, QUERY_TERMS = 6_000_000, 16384, 128, 2048, 2_000_000
#: A term is frequent in a shard from this share of its documents on; there are few such terms, as a document has few words.
FREQUENT = 1 / 24
#: Cells of a shard's matrix of frequent terms (32 MB), and pairs of a posting and a query that are worked out at once.
MATRIX_CELLS, PAIRS = 4_000_000, 8_000_000
#: Scores count as equal, and go by id, when they agree in this many decimals.
DECIMALS = 6
#: Words by which a shard's documents are put in order: frequent ones of its first documents. Only speed depends on them.
_ALIKE, _FIRST = 8, 512
_SLICE = 256


def shards(docs: DataFrame, shard_words: int) -> DataFrame:
    """doc_id and text to inverted indexes; a shard's name holds its partition and is fixed once the table is written."""
    columns = ("ids", "lengths", "vocab", "starts", "docs", "counts")
    schema = pa.schema([("shard", pa.int64()), *((k, pa.binary()) for k in columns), ("n", pa.int64()), ("words", pa.int64()), ("postings", pa.int64())])

    def run(batches):
        ids, lengths, terms, counts, made, size = [], [], [], [], 0, 0
        task = TaskContext.get()
        part = task.partitionId() if task else 0

        def flush():
            seen, times = np.unique(np.concatenate(terms[:_FIRST]), return_counts=True)
            common = seen[np.argsort(-times, kind="stable")[:_ALIKE]]
            has = [common == np.append(t, np.uint64(0))[np.searchsorted(t, common)] for t in terms]
            alike = sorted(range(len(ids)), key=lambda i: (has[i].tolist(), lengths[i], ids[i]))
            for x in (ids, lengths, terms, counts):
                x[:] = [x[i] for i in alike]
            all_terms = np.concatenate(terms)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(t) for t in terms])
            order = np.argsort(all_terms, kind="stable")
            vocab, start = np.unique(all_terms[order], return_index=True)
            cells = [pack(np.array(ids, np.int64)), pack(np.array(lengths, np.uint32)), pack_sorted(vocab), pack_sorted(start.astype(np.uint32)), pack(owner[order]), pack(np.concatenate(counts)[order].astype(np.uint32))]
            row = [part << 32 | made, *cells, len(ids), sum(lengths), len(order)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = word_hashes(text.as_py())
                t, c = np.unique(h, return_counts=True)
                ids.append(i)
                lengths.append(len(h))
                terms.append(t)
                counts.append(c)
                size += len(h)
                if size >= shard_words or len(ids) >= SHARD_DOCS:
                    yield flush()
                    ids, lengths, terms, counts, made, size = [], [], [], [], made + 1, 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, "shard long, " + ", ".join(f"{k} binary" for k in columns) + ", n long, words long, postings long")


class Plan:
    """The queries of a turn: ids, distinct terms with their inverse document frequency, and the queries of each term."""

    def __init__(self, asked: list[tuple[int, np.ndarray]]):
        self.ids = np.array([q for q, _ in asked], np.int64)
        self.terms, of = np.unique(np.concatenate([t for _, t in asked]), return_inverse=True)
        query = np.repeat(np.arange(len(asked), dtype=np.int32), [len(t) for _, t in asked])
        order = np.argsort(of, kind="stable")
        self.queries = query[order]
        self.start = np.searchsorted(of[order], np.arange(len(self.terms) + 1))
        self.idf = np.zeros(len(self.terms))

    def ask(self, terms: np.ndarray, q0: int, q1: int) -> tuple[np.ndarray, np.ndarray]:
        """How many of the queries q0 to q1 have each of ``terms``, and these queries, term by term."""
        start, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        query = self.queries[_expand(start, n)]
        if q0 or q1 < len(self.ids):
            here = (query >= q0) & (query < q1)
            n, query = np.bincount(np.repeat(np.arange(len(terms)), n)[here], minlength=len(terms)), query[here]
        return n, query


class Top:
    """The k best documents of each query so far, by score and then by id; a score of 0 is a free place."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.best, self.docs = np.zeros((queries, k)), np.zeros((queries, k), np.int64)
        self.least = np.zeros(queries)  # the k-th score, 0 while there are fewer
        self.tested = self.passed = 0  # pairs of a block and a query, and those whose postings were scored

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        changed = np.unique(query)
        own = np.repeat(changed, self.k)
        query, ids, scores = np.concatenate([own, query]), np.concatenate([self.docs[changed].ravel(), ids]), np.concatenate([self.best[changed].ravel(), scores])
        order = np.lexsort((ids, -scores, query))
        order = order[scores[order] > 0]
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.best[changed] = 0
        self.best[query[keep], rank[keep]], self.docs[query[keep], rank[keep]] = scores[keep], ids[keep]
        self.least[changed] = self.best[changed, -1]

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, documents and scores, in order of query and rank."""
        query, rank = np.nonzero(self.best)
        return query, self.docs[query, rank], self.best[query, rank]


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of ranges that begin at ``start`` and have ``n`` each."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


class Shard:
    """The postings of a turn's terms in one shard, rare ones by document, frequent ones as a matrix with the maxima of each block."""

    def __init__(self, row: dict, mean_length: float, plan: Plan):
        self.ids = unpack(row["ids"])
        vocab, start = unpack_sorted(row["vocab"]), np.append(unpack_sorted(row["starts"]).astype(np.int64), row["postings"])
        norm = K1 * (1 - B + B * unpack(row["lengths"]).astype(np.float64) / max(mean_length, 1e-9))
        place = np.minimum(np.searchsorted(vocab, plan.terms), max(0, len(vocab) - 1))
        terms = np.flatnonzero(vocab[place] == plan.terms) if len(vocab) else np.zeros(0, np.int64)
        at = place[terms]
        n = start[at + 1] - start[at]
        post = _expand(start[at], n)
        doc, count = unpack(row["docs"])[post].astype(np.int64), unpack(row["counts"])[post].astype(np.float64)
        weight = count * (K1 + 1) / (count + norm[doc]) * np.repeat(plan.idf[terms], n)
        most = max(1, MATRIX_CELLS // max(1, len(self.ids)))
        often = n > max(8, FREQUENT * len(self.ids), np.sort(n)[-most - 1] if len(n) > most else 0)
        self.frequent = terms[often]
        self.matrix = np.zeros((len(self.ids), len(self.frequent)))
        column = np.repeat(np.where(often, np.cumsum(often) - 1, -1), n)
        dense = column >= 0
        self.matrix[doc[dense], column[dense]] = weight[dense]
        rare = ~dense
        term, block = np.repeat(terms, n)[rare], doc[rare] // BLOCK_DOCS
        order = np.argsort(block * len(plan.terms) + term, kind="stable")
        self.doc, self.weight = doc[rare][order], weight[rare][order]
        run = block[order] * len(plan.terms) + term[order]  # a run: the postings of a rare term in a block
        self.run = np.flatnonzero(np.diff(run, prepend=-1))
        self.run_term, self.run_size = run[self.run] % len(plan.terms), np.diff(self.run, append=len(run))
        self.run_most = np.maximum.reduceat(self.weight, self.run) if len(run) else np.zeros(0)
        self.blocks = range(0, len(self.ids), BLOCK_DOCS)
        self.runs = np.searchsorted(run[self.run], np.arange(len(self.blocks) + 1) * len(plan.terms))
        self.most = np.array([self.matrix[i : i + BLOCK_DOCS].max(axis=0) for i in self.blocks]).reshape(len(self.blocks), len(self.frequent))

    def search(self, plan: Plan, top: Top) -> None:
        for q0 in range(0, len(plan.ids), BLOCK_QUERIES):
            q1 = min(q0 + BLOCK_QUERIES, len(plan.ids))
            asks = np.zeros((len(self.frequent), q1 - q0))
            n, query = plan.ask(self.frequent, q0, q1)
            asks[np.repeat(np.arange(len(self.frequent)), n), query - q0] = 1
            could = self.most @ asks
            for block in range(len(self.blocks)):
                self._score(plan, top, q0, q1, asks, could[block], block)

    def _score(self, plan: Plan, top: Top, q0: int, q1: int, asks: np.ndarray, could: np.ndarray, block: int) -> None:
        """A block's documents for the queries q0 to q1, of which ``could`` has the sums of frequent terms' maxima."""
        runs = slice(self.runs[block], self.runs[block + 1])
        n, query = plan.ask(self.run_term[runs], q0, q1)
        if q1 - q0 > 1 and (n * self.run_size[runs]).sum() > PAIRS:
            half = (q1 - q0) // 2
            self._score(plan, top, q0, q0 + half, asks[:, :half], could[:half], block)
            self._score(plan, top, q0 + half, q1, asks[:, half:], could[half:], block)
            return
        query = query - q0
        run = np.repeat(np.arange(runs.start, runs.stop), n)
        least, slack = top.least[q0:q1], 10.0**-DECIMALS
        bar = np.maximum(least - slack, slack / 4)
        pivot = could + np.bincount(query, weights=self.run_most[run], minlength=q1 - q0) >= bar
        alive = np.flatnonzero(pivot)
        top.tested += q1 - q0
        top.passed += len(alive)
        if not len(alive):
            return
        here = pivot[query]
        query, run = (np.cumsum(pivot) - 1)[query[here]], run[here]
        d0, d1 = block * BLOCK_DOCS, min((block + 1) * BLOCK_DOCS, len(self.ids))
        post, query = _expand(self.run[run], self.run_size[run]), np.repeat(query, self.run_size[run])
        score = np.bincount((self.doc[post] - d0) * len(alive) + query, weights=self.weight[post], minlength=(d1 - d0) * len(alive)).reshape(d1 - d0, len(alive))
        near = score.max(axis=0) + could[alive] >= bar[alive]
        alive = alive[near]
        if not len(alive):
            return
        score = np.round(score[:, near] + self.matrix[d0:d1] @ asks[:, alive], DECIMALS)
        floor = np.maximum(least[alive], slack / 2)
        if d1 - d0 > top.k:
            floor = np.maximum(floor, np.partition(score, d1 - d0 - top.k, axis=0)[d1 - d0 - top.k])
        found, which = np.nonzero(score >= floor)
        if len(found):
            top.add(alive[which] + q0, self.ids[d0 + found], score[found, which])


def _queries(docs: DataFrame, chosen: Column) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("terms", pa.binary()), ("n", pa.int64())])

    def kernel():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            terms = [np.unique(word_hashes(t.as_py())) for t in batch.column(1)]
            return batch_of(schema, [batch.column(0), [pack_sorted(t) for t in terms], [len(t) for t in terms]])

        return run

    return map_batches(docs.where(chosen).select("doc_id", "text"), kernel, "query_id long, terms binary, n long")


def _frequencies(table: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents of all shards each term occurs; tasks' counts are added up by slices of the terms."""
    pieces = max(1, -(-len(terms) // 65536))

    def count(batches):
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                vocab = unpack_sorted(row["vocab"])
                size = np.diff(np.append(unpack_sorted(row["starts"]).astype(np.int64), row["postings"]))
                at = np.minimum(np.searchsorted(vocab, terms), max(0, len(vocab) - 1))
                if len(vocab):
                    total = (0 if total is None else total) + np.where(vocab[at] == terms, size[at], 0)
        if total is not None:
            cut = np.array_split(total.astype(np.uint32), pieces)
            yield pa.record_batch({"piece": pa.array(range(pieces), pa.int32()), "counts": pa.array([pack(c) for c in cut], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([pack(sum(unpack(c).astype(np.uint64) for c in table["counts"].to_pylist()))], pa.binary())})

    rows = table.select("vocab", "starts", "postings").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    return np.concatenate([unpack(r["counts"]).astype(np.float64) for r in sorted(rows)]) if rows else np.zeros(len(terms))


def _scan(plan, mean: float, k: int):
    """The best k of a task's shards for each query of the plan."""

    def run(batches):
        top = Top(len(plan.value.ids), k)
        for batch in batches:
            for row in batch.to_pylist():
                Shard(row, mean, plan.value).search(plan.value, top)
        found = top.flat()
        cut = np.searchsorted(found[0], np.arange(0, len(plan.value.ids) + _SLICE, _SLICE))
        cells = [[pack(x[a:b]) for x in found] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.record_batch({"slice": pa.array(range(len(cells)), pa.int32()), **{name: pa.array([c[i] for c in cells], pa.binary()) for i, name in enumerate(("query", "doc", "score"))}})

    return run


def _merge(plan, k: int):
    """The best k of all tasks for a slice of the queries."""

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        top = Top(len(plan.value.ids), k)
        top.add(*(np.concatenate([unpack(x) for x in parts[name].to_pylist()]) for name in ("query", "doc", "score")))
        query, ids, scores = top.flat()
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        return pa.table([pa.array(plan.value.ids[query], pa.int64()), pa.array(rank, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "rank", "doc_id", "score"])

    return merge


def search(docs: DataFrame, chosen: Column, k: int = 10, shard_words: int = SHARD_WORDS, query_terms: int = QUERY_TERMS) -> DataFrame:
    """query_id, rank, doc_id and score: the k best documents of ``docs`` for each row that ``chosen`` makes a query, itself among them.

    Ties, to DECIMALS decimals, go to the smaller id. Texts are read whole, however long. An empty table gives an empty one. Rows with a null id are left out; null and empty texts count as documents without
    words, which nothing finds and which find nothing. Rows that repeat an id each are documents. Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "index")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = scratch.save(shards(rows, shard_words), "shards")
    n, words = table.agg(F.sum("n"), F.sum("words")).first()
    n, mean = n or 0, (words or 0) / max(1, n or 0)
    queries = scratch.save(_queries(rows, chosen), "queries")
    turns = max(1, -(-(queries.agg(F.sum("n")).first()[0] or 0) // query_terms))
    out = None
    for turn in range(turns):
        asked = sorted((r["query_id"], unpack_sorted(r["terms"])) for r in queries.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).where("n > 0").collect())  # query_terms terms or so
        if not asked:
            continue
        turn_plan = Plan(asked)
        df = _frequencies(table, turn_plan.terms)
        turn_plan.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        plan = spark.sparkContext.broadcast(turn_plan)
        run, merge = _scan(plan, mean, k), _merge(plan, k)
        part = table.mapInArrow(run, "slice int, query binary, doc binary, score binary").groupBy("slice").applyInArrow(merge, "query_id long, rank int, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")


#: The same in DuckDB, for texts whose id is divisible by 100 as queries.
ORACLE = f"""
WITH tokens AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS term FROM documents WHERE doc_id IS NOT NULL),
post AS (SELECT doc_id, term, count(*) AS c FROM tokens GROUP BY doc_id, term),
size AS (SELECT doc_id, sum(c) AS n FROM post GROUP BY doc_id),
total AS (SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS n, (SELECT sum(n) FROM size) / (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS mean),
freq AS (SELECT term, ln(1 + (any_value(t.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, total t GROUP BY term),
scored AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(f.idf * p.c * ({K1} + 1) / (p.c + {K1} * (1 - {B} + {B} * s.n / t.mean))), {DECIMALS}) AS score
  FROM post q JOIN post p ON q.term = p.term JOIN freq f ON f.term = p.term JOIN size s ON s.doc_id = p.doc_id, total t WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, p.doc_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
