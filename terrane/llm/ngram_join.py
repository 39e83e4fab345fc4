"""Similarity join of documents on sets of word shingles, and its components.

Blocks first. Sets that link differ in few shingles, d at most for a set of n. Shingles are dealt by hash to m > d parts, so that linked
sets have at least m - d parts in common, whole. A part with all it holds is a token, tokens have an order that all sets go by, and two
sets with m - d tokens in common share one of the first d + 1 of each. The order puts parts with many uncommon shingles first; common ones
are those in crowded cells of a count of fixed size. A token of several uncommon shingles is hardly ever shared by chance, so that sets
which share one (families, found without making pairs) are near copies but for few. m depends on the class of the larger set's size;
classes are as wide as links reach, so that each set has tokens of its own class and of the next. Families of classes are apart.

Then T-occurrence search in each family: an inverted index of shingles over a block of sets is searched for the sets of another, or the
same, block that reach the overlap T. DivideSkip sets the longest lists aside, merges the short ones with a heap, keeps documents that
occur T - L times there, and looks these up in the L long lists by binary search. Large families are cut into blocks whose pairs are
searched apart, so that a task holds two blocks. A block pair returns a forest of the links, as many rows as nodes at most.

Equal sets are one node throughout. There is one plan for all sizes: what is broadcast are two bitmaps of fixed size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.graph import components
from terrane.llm.katz import _slices as slices
from terrane.llm.katz import pack, pack_sorted, unpack, unpack_sorted
from terrane.llm.store import Scratch
from terrane.llm.text import batch_of, map_batches, mix, shingle_set, word_hashes

#: Shingles in a block of a family, and tokens that a task brings together, about.
BLOCK_SHINGLES, TABLE_HASHES = 1 << 17, 1_500_000
#: Cells of the count of shingles; a cell with CROWDED times the mean is common. Bits of the map of ids whose sets are searched.
CELLS, CROWDED, ID_BITS = 1 << 20, 4, 1 << 26
_PIECES, _RUN = 64, 1 << 14
#: Weight of looking up against merging when the number of long lists is chosen; lookups are made for all candidates at once.
_MU = 0.001


@dataclass(frozen=True)
class Threshold:
    """Sets link when 100 * intersection >= percent * union."""

    percent: int

    def overlap(self, size: int) -> int:
        """The least intersection of a set with any that it links to."""
        return -(-self.percent * size // 100)

    def links(self, a: int, b: int, shared: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)

    def differences(self, sizes: int) -> int:
        """The most shingles that linked sets, whose sizes have this sum, don't share."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def ceiling(self, size: int) -> int:
        """The largest size of the class of this size: each class reaches as far as its smallest size links."""
        hi = 100 // self.percent
        while hi < size:
            hi = (hi + 1) * 100 // self.percent
        return hi


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name for a set."""
    h = mix(shingles + np.uint64(0x51ED270B))
    both = np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(h)], np.uint64)
    return int(mix(both[:1] ^ (both[1:] * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)[0])


def cell_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def tokens_of(shingles: np.ndarray, t: Threshold, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a set must share one of with whatever it links to: those of its own class and those of the next."""
    n, out = len(shingles), []
    weight = ~common[cell_of(shingles)]
    mixed = mix(shingles + np.uint64(0x51ED270B))
    high = t.ceiling(n)
    for top in (high, t.ceiling(high + 1)):
        # Parts hold about 0.62 / (1 - share) shingles: more, and too few are left to choose from; less, and they say too little.
        most = t.differences(2 * top)
        parts = max(most + 1, top * (100 - t.percent) // 62)
        part = ((mix(shingles ^ np.uint64(top * 7919 + 13)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        held = np.zeros(parts, np.uint64)
        np.add.at(held, part, mixed)
        uncommon = np.minimum(np.bincount(part, weights=weight, minlength=parts), 255).astype(np.uint64)
        name = mix(held + mix(np.arange(parts, dtype=np.uint64) + np.uint64(top << 24)))
        ranked = ((np.uint64(255) - uncommon) << np.uint64(56)) | (name >> np.uint64(8))
        first = t.differences(n + min(top, 100 * n // t.percent))
        out.append(np.partition(ranked, first)[: first + 1] if first + 1 < parts else ranked)
    return tuple(mix(x + np.uint64(0x2545F491)) & ~np.uint64(0xFFFF) for x in out)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


class Index:
    """Inverted lists of shingles over a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        all_tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(all_tokens, kind="stable")
        self.tokens, start = np.unique(all_tokens[order], return_index=True)
        self.start = np.append(start, len(order))
        self.owner = owner[order]
        self.sizes = [len(s) for s in sets]

    def search(self, query: np.ndarray, t: Threshold, root: Callable[[int], int] = lambda doc: doc, own: Callable[[], int] = lambda: -1) -> Iterator[tuple[int, int]]:
        """Sets of the block that link to the query, with their overlaps. DivideSkip.

        root names the component of a set and own that of the query as it is by then: the likeliest set of each component is looked
        up first, and the others only if their component is still another one.
        """
        need = t.overlap(len(query))
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if len(at) < need:
            return
        size = self.start[at + 1] - self.start[at]
        order = np.argsort(size, kind="stable")
        at, size = at[order], size[order]
        longest = min(need - 1, int(need / (_MU * math.log2(int(size[-1]) + 1) + 1)))
        cut = len(at) - longest
        short = [self.owner[self.start[i] : self.start[i + 1]].tolist() for i in at[:cut]]
        found = sorted(((n, doc) for doc, run in groupby(heapq.merge(*short)) if (n := sum(1 for _ in run)) >= need - longest), key=lambda x: (-x[0], x[1]))
        first = {}
        for n, doc in found:
            first.setdefault(root(doc), (n, doc))
        first.pop(own(), None)
        chosen = set(first.values())
        for part in (lambda: list(first.values()), lambda: [x for x in found if x not in chosen and root(x[1]) != own()]):
            if candidates := part():
                docs, count = self._looked_up(at[cut:], np.array([d for _, d in candidates]), np.array([n for n, _ in candidates]), need)
                for i in np.argsort(-count, kind="stable"):
                    if t.links(len(query), self.sizes[docs[i]], int(count[i])):
                        yield int(docs[i]), int(count[i])

    def _looked_up(self, lists: np.ndarray, docs: np.ndarray, count: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds to counts whether documents are in the long lists, by binary search; those that can't reach ``need`` any more go."""
        for k, i in enumerate(lists):
            ids = self.owner[self.start[i] : self.start[i + 1]]
            place = np.minimum(np.searchsorted(ids, docs), len(ids) - 1)
            count = count + (ids[place] == docs)
            if k & 15 == 0:
                alive = count + (len(lists) - k - 1) >= need
                if not alive.all():
                    docs, count = docs[alive], count[alive]
                    if not len(docs):
                        break
        return docs, count


def links_within(left: list[np.ndarray], right: list[np.ndarray] | None, t: Threshold) -> list[tuple[int, int]]:
    """A forest of the links between two blocks, or within one: pairs of places, those of ``right`` counted after ``left``."""
    index, forest, out = Index(left), Forest(len(left) + len(right or [])), []
    for i, query in enumerate(left if right is None else right):
        me = i if right is None else len(left) + i
        for other, _ in index.search(query, t, forest.root, lambda me=me: forest.root(me)):
            a, b = forest.root(me), forest.root(other)
            if a != b:
                forest.up[a] = b
                out.append((me, other))
    return out


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _shingled(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles and node (null without words) of each row; then, with a piece, each task's counts of its distinct sets by cell."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(CELLS, np.uint32), set()
        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(1):
                s = shingle_set(word_hashes(text.as_py()), size)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                if len(s) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    np.add.at(total, cell_of(s), 1)
            yield batch_of(schema, [batch.column(0), sizes, nodes, [None] * len(sizes), [None] * len(sizes)])
        if seen:
            none = [None] * _PIECES
            yield batch_of(schema, [none, none, none, list(range(_PIECES)), [pack(x) for x in total.reshape(_PIECES, -1)]])

    return _columns(docs).mapInArrow(run, "doc_id long, n_shingles long, node long, piece int, counts binary")


def _common(sets: DataFrame, total: int) -> np.ndarray:
    """Whether a cell is crowded: a bitmap of fixed size, its pieces added up apart."""
    least = max(4, CROWDED * total // CELLS)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        n = sum(unpack(x).astype(np.int64) for x in table["counts"].to_pylist())
        return pa.table({"piece": table["piece"][:1], "flags": pa.array([np.packbits(n > least).tobytes()], pa.binary())})

    out = np.zeros((_PIECES, CELLS // _PIECES), bool)
    for r in sets.where("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(add, "piece int, flags binary").collect():
        out[r["piece"]] = np.unpackbits(np.frombuffer(r["flags"], np.uint8)).astype(bool)
    return out.reshape(-1)


_PARTS = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
_PARTS_SQL = "part int, run long, tokens binary, owners binary, nodes binary, sizes binary"
NODES, EDGES = -1, -2


def _met(tokens: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges from the least owner of each token to the others."""
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    first = owners[np.maximum.accumulate(np.where(new, np.arange(len(owners)), 0))]
    pairs = np.unique(np.stack([first[~new], owners[~new]], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def _tokens(docs: DataFrame, size: int, t: Threshold, common: np.ndarray, bits: int) -> DataFrame:
    """By part of the hash space, runs of sorted tokens with their owners; with part NODES the sets of a run, with EDGES what met in it.

    A run is some thousand rows. Its sets are numbered; an owner is a set's number twice, plus 1 for the next class. What a run's sets
    share is settled there, and a token goes on once a run, so that no token is hot however many sets have it.
    """
    flags = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), 0
        base = (task.partitionId() if task else 0) << 20
        for batch in batches:
            for at in range(0, batch.num_rows, _RUN):
                found: dict[int, np.ndarray] = {}
                tokens, owners, sizes = [], [], []
                for text in batch.column(1).slice(at, _RUN):
                    s = shingle_set(word_hashes(text.as_py()), size)
                    if not len(s) or (node := node_of(s)) in found:
                        continue
                    found[node] = None
                    sizes.append(len(s))
                    for k, x in enumerate(tokens_of(s, t, flags.value)):
                        tokens.append(x)
                        owners.append(np.full(len(x), 2 * (len(found) - 1) + k, np.uint16))
                name, made = base | made, made + 1
                if not found:
                    continue
                tokens, owners = np.concatenate(tokens), np.concatenate(owners)
                a, b = _met(tokens, owners)
                rows = [(NODES, name, None, None, pack(np.array(list(found), np.int64)), pack(np.array(sizes, np.int64)))]
                if len(a):
                    rows.append((EDGES, name, pack(a), pack(b), None, None))
                order = np.lexsort((owners, tokens))
                tokens, owners = tokens[order], owners[order]
                once = np.concatenate([[True], tokens[1:] != tokens[:-1]])
                tokens, owners = tokens[once], owners[once]
                edges = slices(tokens, bits)
                rows += [(p, name, pack_sorted(tokens[x:y] >> np.uint64(16)), pack(owners[x:y]), None, None) for p, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y]
                yield batch_of(_PARTS, list(zip(*rows, strict=True)))

    return _columns(docs.where("doc_id IS NOT NULL")).mapInArrow(run, _PARTS_SQL)


def _families(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """family and node, of families of two nodes or more, not all of the next class's smaller neighbours, which meet in their own class."""
    edge_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        tokens = np.concatenate([unpack_sorted(x) for x in table["tokens"].to_pylist()])
        owners = np.concatenate([(np.int64(r) << 15) | unpack(x).astype(np.int64) for r, x in zip(table["run"].to_pylist(), table["owners"].to_pylist(), strict=True)])
        a, b = _met(tokens, owners)
        return pa.table({"a": a, "b": b}, schema=edge_schema)

    def inside():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ends = [np.concatenate([(np.int64(r) << 15) | unpack(x).astype(np.int64) for r, x in zip(b.column(0).to_pylist(), b.column(c).to_pylist(), strict=True)]) for c in (1, 2)]
            return batch_of(edge_schema, ends)

        return run

    def named():
        kind = pa.schema([("number", pa.int64()), ("node", pa.int64())])

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            lists = [unpack(x) for x in b.column(1).to_pylist()]
            return batch_of(kind, [np.concatenate([(r << 14) + np.arange(len(x)) for r, x in zip(b.column(0).to_pylist(), lists, strict=True)]), np.concatenate(lists)])

        return run

    apart = parts.where("part >= 0").select("part", "run", "tokens", "owners").groupBy("part").applyInArrow(meet, "a long, b long")
    near = map_batches(parts.where(F.col("part") == EDGES).select("run", "tokens", "owners"), inside, "a long, b long")
    met = components(apart.unionByName(near), scratch)
    met = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct()).select(F.col("root").alias("family"), F.shiftright("node", 1).alias("number"), F.col("node").bitwiseAND(1).alias("smaller"))
    names = map_batches(parts.where(F.col("part") == NODES).select("run", "nodes"), named, "number long, node long")
    family = scratch.save(met.join(names, "number").groupBy("family", "node").agg(F.min("smaller").alias("smaller")), "families")
    several = family.groupBy("family").agg(F.count(F.lit(1)).alias("_n"), F.min("smaller").alias("_all")).where("_n > 1 AND _all = 0").select("family")
    return family.select("family", "node").join(several, "family")


def _id_map(plan: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids: rows whose bit isn't set needn't be looked at. Each task gives the bytes that it sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_id_bit(batch.column(0).to_numpy()))
            yield pa.record_batch({"piece": pa.array([0], pa.int32()), "bits": pa.array([pack_sorted(bits)], pa.binary())})

    out = np.zeros(ID_BITS, bool)
    for r in plan.select("doc_id").distinct().mapInArrow(run, "piece int, bits binary").toLocalIterator():
        out[unpack_sorted(r["bits"]).astype(np.int64)] = True
    return np.packbits(out)


def _id_bit(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(ID_BITS - 1)


def _links(docs: DataFrame, plan: DataFrame, size: int, t: Threshold) -> DataFrame:
    """Links (a, b) between nodes; plan: doc_id, node, family and blocks of one document for each node."""
    out = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary())])
    wanted = docs.sparkSession.sparkContext.broadcast(_id_map(plan))

    def sets():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0).to_numpy()
            at = _id_bit(ids).astype(np.int64)
            picked = np.flatnonzero((wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            cells = [(int(ids[i]), shingle_set(word_hashes(batch.column(1)[int(i)].as_py()), size)) for i in picked]
            cells = [(i, node_of(s), pack_sorted(s)) for i, s in cells if len(s)]
            return batch_of(out, list(zip(*cells, strict=True)) if cells else [[], [], []])

        return run

    found = map_batches(_columns(docs.where("doc_id IS NOT NULL")), sets, "doc_id long, node long, shingles binary").dropDuplicates(["doc_id", "node"]).join(plan, ["doc_id", "node"])
    own = F.pmod("node", "blocks")
    dealt = found.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "shingles")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        by_node = {n: (o, unpack_sorted(s)) for n, o, s in zip(table["node"].to_pylist(), table["own"].to_pylist(), table["shingles"].to_pylist(), strict=True)}
        left = sorted(n for n, (o, _) in by_node.items() if o == i)
        right = None if i == j else sorted(n for n, (o, _) in by_node.items() if o == j)
        names = [*left, *(right or [])]
        pairs = links_within([by_node[n][1] for n in left], None if right is None else [by_node[n][1] for n in right], t) if left and right != [] else []
        return pa.table({"a": pa.array([names[x] for x, _ in pairs], pa.int64()), "b": pa.array([names[y] for _, y in pairs], pa.int64())})

    return dealt.groupBy("family", "i", "j").applyInArrow(search, "a long, b long")


def join(docs: DataFrame, size: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES, table_hashes: int = TABLE_HASHES) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``.

    A document's set: the distinct runs of ``size`` words, or its whole words as one run if there are fewer. Documents link when
    100 * intersection >= percent * union; component_id is the smallest id that links reach, the document's own included. Null and
    empty texts, and such of blanks alone, have no shingles and link with nothing. Very long texts are taken whole. Rows that repeat an
    id each give a row and are one document as to links. Rows with a null id link with nothing and have a null component_id. An empty
    table gives an empty one. There are no ties to break. Other columns of ``docs``, whatever their names, are not read.
    """
    t, scratch = Threshold(percent), Scratch(docs.sparkSession, "ngrams")
    made = scratch.save(_shingled(docs, size), "sets")
    sets = made.where("piece IS NULL").select("doc_id", "n_shingles", "node")
    known = sets.where("doc_id IS NOT NULL AND node IS NOT NULL")
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(2, math.ceil(math.log2(5 * total * (100 - percent) / 200 / table_hashes + 1)))
    parts = scratch.save(_tokens(docs, size, t, _common(made, total), bits), "tokens")
    family = scratch.save(_families(parts, scratch), "near")
    scratch.drop(parts)
    one = known.join(family, "node").groupBy("family", "node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    one = scratch.save(one, "nodes")
    blocks = one.groupBy("family").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks"))
    plan = scratch.save(one.join(blocks, "family").select("doc_id", "node", "family", "blocks"), "plan")
    links = scratch.save(_links(docs, plan, size, t), "links")
    linked = components(links, scratch)
    scratch.drop(family, one, plan, links)
    rooted = sets.join(linked, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    least = rooted.where("root IS NOT NULL AND doc_id IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("_least"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id")).alias("component_id"))
