"""Search and decontamination against brute force, and the pipeline."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import bm25, decontam
from terrane.llm.store import Scratch
from terrane.llm.text import word_hashes

TESTDATA = "/root/testdata"


def ranked(rows, chosen, k):
    docs = [(i, collections.Counter((t or "").encode().lower().split())) for i, t in rows if i is not None]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = collections.Counter(w for _, c in docs for w in c)
    out = []
    for q, terms in docs:
        if chosen(q):
            score = lambda c: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in terms if w in c)  # noqa: E731,B023
            best = sorted(((-round(s, 6), i) for i, c in docs if (s := score(c)) > 0))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("more", [{}, {"shard_words": 3000, "query_terms": 800}])
def test_search(edge_docs, some_docs, more):
    docs = edge_docs.select("doc_id", "text").union(some_docs.select(F.col("doc_id") + 100, "text")).cache()
    rows = sorted(tuple(r) for r in bm25.search(docs, F.col("doc_id") % 20 == 1, 5, **more).collect())
    expected = ranked([tuple(r) for r in docs.collect()], lambda i: i % 20 == 1, 5)
    assert [r[:2] for r in rows] == [r[:2] for r in expected]
    assert [r[3] for r in rows] == pytest.approx([r[3] for r in expected], abs=2e-6)
    # Scores that differ by the last decimal may change places.
    assert sum(a[2] != b[2] for a, b in zip(rows, expected, strict=True)) <= len(rows) * 0.01


def test_ties_go_by_id(spark):
    texts = ["red fox", "red fox", "blue fox", "green hen", "red fox hen"]
    docs = spark.createDataFrame([(i * 37 % 400, texts[i % 5]) for i in range(400)], "doc_id long, text string").repartition(4)
    rows = sorted(tuple(r) for r in bm25.search(docs, F.col("doc_id") % 7 == 0, 12, shard_words=90).collect())
    expected = ranked([tuple(r) for r in docs.collect()], lambda i: i % 7 == 0, 12)
    assert [r[:3] for r in rows] == [r[:3] for r in expected]
    assert [r[3] for r in rows] == pytest.approx([r[3] for r in expected], abs=2e-6)


def test_blocks_are_passed_over(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(w)}" for w in rng.zipf(1.4, 40) if w < 5000)) for i in range(4000)]
    found = bm25.shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), bm25.SHARD_WORDS).collect()
    plan = bm25.Plan([(i, np.unique(word_hashes(t))) for i, t in rows[::100]])
    held = [set(t.split()) for _, t in rows]
    hashes = {int(word_hashes(w)[0]): w for t in held for w in t}
    df = np.array([sum(hashes[int(h)] in t for t in held) for h in plan.terms])
    plan.idf = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
    top = bm25.Top(len(plan.ids), 10)
    for r in found:
        bm25.Shard(r.asDict(), sum(r.words for r in found) / len(rows), plan).search(plan, top)
    assert 0 < top.passed < top.tested * 0.6
    query, docs, scores = top.flat()
    expected = ranked(rows, lambda i: i % 100 == 0, 10)
    assert scores.tolist() == pytest.approx([r[3] for r in expected], abs=2e-6) and (docs == [r[2] for r in expected]).mean() > 0.99


def test_search_of_nothing(no_docs, edge_docs):
    assert bm25.search(no_docs, F.lit(True)).count() == 0
    assert bm25.search(edge_docs, F.lit(False)).count() == 0


def test_decontaminate(spark, some_docs, edge_docs, no_docs):
    bench = spark.read.parquet(f"{TESTDATA}/sf0.001/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    word = {i: t.split() for i, t in items.items()}
    pick = [i for i in sorted(items) if len(word[i]) >= 25][:6]
    filler = some_docs.where("lang = 'en'").orderBy("doc_id").first().text.split()
    planted = []
    for n, i in enumerate(pick):
        w = word[i]
        planted.append((1000 + n, " ".join([*filler[:100], *w, *filler[100:200]])))
        planted.append((2000 + n, " ".join([*filler[:30], *(x for j, x in enumerate(w) if j % 9 or j > len(w) - 6), *filler[30:]])))  # a ninth left out, the answer kept
        planted.append((3000 + n, " ".join([*filler[:50], *w[: len(w) // 3], *filler[50:]])))  # a third alone
    docs = spark.createDataFrame(planted, "doc_id long, text string").union(edge_docs.select("doc_id", "text")).union(some_docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10_000))
    found = {r.doc_id: r for r in decontam.find(docs, bench).collect()}
    for n, i in enumerate(pick):
        assert i in found[1000 + n].item_ids and found[1000 + n].best_share == 1.0
        assert i in found[2000 + n].item_ids
        assert i not in found[3000 + n].item_ids
    assert not any(found[i].contaminated for i in (1, 3, 4, 5, 9, 10))
    # Recall of exact passages, and no item in documents that share no run of words with it.
    whole = lambda t: " " + " ".join((t or "").lower().split()) + " "
    for r in some_docs.collect():
        exact = {i for i, t in items.items() if whole(t) in whole(r.text)}
        assert exact <= set(found[r.doc_id + 10_000].item_ids)
    assert decontam.find(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontam.find(edge_docs, bench.where("false")).collect())


def fitted(rows, texts, rank=decontam.RANK):
    """A space of items and of passages of texts by a plain SVD: the basis that the randomised one must come near."""
    import numpy as np

    items = decontam.Items(rows, IDF)
    cut = [h[a : a + decontam.PASSAGE] for h in texts for a in range(0, max(1, len(h) - decontam.PASSAGE), decontam.PASSAGE)]
    start, at, values = decontam.rows_of(items, cut + [items.words[i][a:b] for i, a, b in items.passages])
    dense = np.zeros((len(start) - 1, items.features))
    np.add.at(dense, (np.repeat(np.arange(len(start) - 1), np.diff(start)), at), values)
    return items, dense, np.linalg.svd(dense, full_matrices=False)[2][:rank].T


IDF = np.random.default_rng(5).uniform(0.5, 9, decontam.CELLS).astype(np.float32)
SIZES = (1, 2, 3, 4, 6, 8, 11, 14, 15, 19, 28, 33, 48, 59, 90, 150, 320, 400, 600, 800, 2000)


def test_items_of_any_length_are_found():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    sizes = [n for n in SIZES for _ in range(6)]
    texts = [[str(w) for w in rng.choice(vocabulary, n)] for n in sizes]
    items, dense, basis = fitted([(i, word_hashes(" ".join(w))) for i, w in enumerate(texts)], [])
    assert basis.shape[1] < len(dense)
    finder = decontam.Finder(items, decontam.Space(items, basis), IDF)
    hits, changed = collections.defaultdict(list), collections.defaultdict(list)
    for i, w in enumerate(texts):
        filler = [f"x{j}" for j in rng.integers(0, 4000, 2000)]
        at = int(rng.integers(0, 2000))
        hits[sizes[i]].append(dict(finder.find(" ".join(filler[:at] + w + filler[at:]))).get(i) == 1.0)
        if len(w) >= 15:
            kept = [x for j, x in enumerate(w) if j % 4 or j >= len(w) - 5]  # a quarter left out, the answer kept
            changed[sizes[i]].append(i in dict(finder.find(" ".join(filler[:at] + kept + filler[at:]))))
    assert all(np.mean(v) >= 0.9 for v in hits.values()) and sum(map(sum, changed.values())) >= 0.9 * sum(map(len, changed.values()))
    assert finder.find(" ".join(f"x{j}" for j in range(3000))) == []


def test_space_is_that_of_a_plain_svd(spark, some_docs, tmp_path):
    from terrane.llm.store import Scratch

    bench = spark.read.parquet(f"{TESTDATA}/sf0.001/benchmark.parquet")
    rows = [(r.item_id, word_hashes(r.text)) for r in bench.collect()]
    items, dense, exact = fitted(rows, [], 12)
    space = decontam.fit(items, some_docs.where("false"), 0, Scratch(spark, "space"), rank=12)
    assert np.linalg.norm(space.basis.T @ space.basis - np.eye(12)) < 1e-3
    # Singular values that are close may change places; what counts is how much of the rows the space holds.
    assert np.linalg.norm(dense @ space.basis) ** 2 >= 0.98 * np.linalg.norm(dense @ exact) ** 2
    z = dense @ space.basis
    assert np.allclose(z / np.linalg.norm(z, axis=1, keepdims=True), space.passages, atol=1e-4)
    # With documents the space is another one, which holds less of the items alone.
    n = some_docs.count()
    wide = decontam.fit(items, some_docs, n, Scratch(spark, "space"), rank=12)
    assert np.linalg.norm(wide.basis.T @ wide.basis - np.eye(12)) < 1e-3
    assert np.linalg.norm(dense @ wide.basis) < np.linalg.norm(dense @ space.basis)


def test_space_is_fitted_on_all_passages(spark):
    rng = random.Random(8)
    rows = [(i, np.array([rng.randint(1, 300) for _ in range(rng.randint(8, 50))], np.uint64)) for i in range(30)]
    items = decontam.Items(rows, IDF)
    texts = [np.array([rng.randint(1, 400) for _ in range(n)], np.uint64) for n in (0, 1, 5, 31, 32, 33, 63, 64, 100, 700)]
    cut = [h[32 * k : 32 * k + 32 if k < max(1, len(h) // 32) - 1 else None] for h in texts for k in range(max(1, len(h) // 32))]
    dense = []
    for start, at, values in (decontam.weighed(items, *decontam.lot_of(items, texts)), decontam.rows_of(items, cut)):
        d = np.zeros((len(start) - 1, items.features))
        np.add.at(d, (np.repeat(np.arange(len(start) - 1), np.diff(start)), at), values)
        dense.append(d)
        x = np.random.default_rng(2).standard_normal((items.features, 5))
        assert np.allclose(decontam.there_and_back(start, at, values, x), d.T @ (d @ x), atol=1e-5)
    assert np.allclose(decontam.products([decontam.weighed(items, *decontam.lot_of(items, [t])) for t in texts], x), d.T @ (d @ x), atol=1e-4)
    assert dense[0].shape == dense[1].shape and np.allclose(*dense, atol=1e-6)
    # All passages of many long documents count: the space is that of a plain SVD of the items' and all of theirs.
    words = [f"w{i}" for i in range(300)]
    bench = [(i, word_hashes(" ".join(rng.choice(words) for _ in range(rng.randint(8, 50))))) for i in range(30)]
    items = decontam.Items(bench, IDF)
    documents = [" ".join(rng.choice(words[k * 7 : k * 7 + 90] if at % 64 < 32 else words[-90 + k :]) for at in range(3000)) for k in range(30)]
    docs = spark.createDataFrame([(t,) for t in documents], "text string")
    space = decontam.fit(items, docs, 30, Scratch(spark, "space"), rank=12)
    start, at, values = decontam.weighed(items, *decontam.lot_of(items, [word_hashes(t) for t in documents] + [items.words[i][a:b] for i, a, b in items.passages]))
    d = np.zeros((len(start) - 1, items.features))
    np.add.at(d, (np.repeat(np.arange(len(start) - 1), np.diff(start)), at), values)
    best = np.linalg.svd(d, full_matrices=False)[1][:12]
    assert np.linalg.norm(d @ space.basis) ** 2 >= 0.98 * (best**2).sum()


def test_latent_candidates_are_those_of_brute_force(spark, some_docs):
    bench = spark.read.parquet(f"{TESTDATA}/sf0.001/benchmark.parquet")
    items, dense, basis = fitted([(r.item_id, word_hashes(r.text)) for r in bench.collect()], [], 20)
    space = decontam.Space(items, basis)
    finder = decontam.Finder(items, space, IDF)
    for r in some_docs.limit(40).collect():
        h = word_hashes(r.text)
        got = {tuple(x) for x in finder.candidates(h).tolist()}
        expected = set()
        for length, least, most in decontam.LENGTHS:
            for s in range(0, max(1, len(h) - length + length // 4), length // 4):
                w = h[s : s + length]
                slot, known = items.places(w)
                square = IDF[decontam._cell(w)].astype(float) ** 2
                if not len(w) or square[known].sum() < decontam.MASS * square.sum():
                    continue
                z = sum((basis[items.feature[k]] * items.weight[k] for k in slot[known]), np.zeros(basis.shape[1]))
                for p, (i, a, b) in enumerate(items.passages):
                    if least <= b - a <= most and z @ space.passages[p] >= decontam.COSINE * max(np.linalg.norm(z), 1e-9):
                        expected.add((i, s, s + len(w)))
        assert len(got ^ expected) <= 0.02 * len(expected) + 1  # cosines that differ in the last digits


def test_odd_items(spark, edge_docs):
    rows = [(None, "The cat sat on the mat and looked at the moon tonight"), (1, None), (2, ""), (3, "looked at the moon"), (3, "sat on the mat"), (4, "12345 67890 !!! ???"), (5, "moon sun")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = edge_docs.withColumns({"items_found": F.lit(1), "shares_found": F.lit("x"), "item_ids": F.lit("y")})
    found = decontam.find(docs, bench)
    assert [c for c in found.columns if c not in ("contaminated", "item_ids", "best_share")] == [c for c in docs.columns if c != "item_ids"]
    got = {(r.doc_id, tuple(r.item_ids)) for r in found.collect()}
    assert {(1, (3,)), (2, (3,)), (6, (4,)), (4, ()), (None, ())} <= got


def test_subsequence():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b):
                old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    import random

    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 80))] for _ in range(2))
        mask = {}
        for i, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << i
        assert decontam.common_subsequence(mask, len(a), b) == lcs(a, b)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, f"{TESTDATA}/sf0.001")
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    assert 0 < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_copies", "decontaminate", "tokenize"]


def test_language_stage_without_labels(spark, edge_docs):
    import corpus_pipeline

    for docs in (edge_docs.withColumn("lang", F.lit(None).cast("string")), edge_docs.withColumn("lang", F.when(F.col("doc_id") == 6, "fr"))):
        kept = corpus_pipeline.language_id(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in docs.collect() if any(map(str.isalpha, r.text or "")))


def test_pipeline_stages_take_edge_rows(spark, edge_docs, no_docs):
    import corpus_pipeline

    for docs in (edge_docs, no_docs):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, f"{TESTDATA}/sf0.001")
            if name != "tokenize":
                assert out.columns == docs.columns, name
            rows = out.cache() if name != "tokenize" else out
        rows.count()


def test_near_copies_of_one_id(spark):
    import corpus_pipeline

    long, other = "one two three four five six seven eight nine ten", "a text that is about something else than numbers are"
    rows = [(1, long, "x"), (1, long, "y"), (1, other, "x"), (2, long, "x"), (3, other + " too", "x"), (None, long, "x"), (None, long, "x"), (4, None, None), (4, "", None)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, component_id string"), "")
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, long), (1, other), (0, long), (0, long), (4, ""), (4, "")])


def test_pipeline_against_plain_python(spark):
    """Kept ids and token digests of run() on the small table, by plain loops over the stages' definitions."""
    import hashlib

    import corpus_pipeline
    import public_tokenizers
    import tiktoken.load

    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    model = corpus_pipeline.langid.train(docs)
    assert model.languages
    rows = {r.doc_id: r.text for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    # Lines by the operator's SQL, which DuckDB runs on the rows that are left.
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(rows), "text": list(rows.values())}))
    expected = {i: h for i, n, k, h in con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({corpus_pipeline.line_dedup.ORACLE})").fetchall()}
    cut = corpus_pipeline.line_dedup_stage(spark, docs.where(F.col("doc_id").isin(list(rows))), "").collect()
    assert all(expected[r.doc_id] == hashlib.sha256((r.text or "").encode()).hexdigest() for r in cut)
    rows = {r.doc_id: r.text for r in cut}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in rows.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    rows = {i: t for i, t in rows.items() if root(i) == i}
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{TESTDATA}/sf0.001/benchmark.parquet").collect()]
    verbatim = {i for i, t in rows.items() if any(f" {' '.join(w)} " in f" {' '.join(t.lower().split())} " for w in bench)}
    encoding = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, f"{TESTDATA}/sf0.001").collect()}
    assert set(out) <= set(rows) - verbatim
    # What else went holds most of an item's words.
    for i in set(rows) - verbatim - set(out):
        words = set(rows[i].lower().split())
        assert any(len(set(w) & words) >= 0.6 * len(set(w)) for w in bench)
    for i, digest in out.items():
        assert digest == hashlib.sha256(" ".join(map(str, encoding.encode_ordinary(rows[i]))).encode()).hexdigest()
