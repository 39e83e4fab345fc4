"""The n-gram join, suffix dedup and line dedup against brute force."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import line_dedup, ngram_join, suffix_dedup


def words(t):
    return (t or "").encode().lower().split()


def joined(rows, k, percent):
    sets = [(i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words(t)) else set()) for i, t in rows]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    lists = collections.defaultdict(list)
    for a, (i, x) in enumerate(sets):
        if i is None:
            continue
        for b, n in collections.Counter(b for g in x for b in lists[g]).items():
            if 100 * n >= percent * (len(x) + len(sets[b][1]) - n):
                p, q = root(i), root(sets[b][0])
                up[max(p, q)] = min(p, q)
        for g in x:
            lists[g].append(a)
    return sorted((-1 if i is None else i, len(x), -1 if i is None else root(i)) for i, x in sets)


@pytest.mark.parametrize(("k", "percent", "more"), [(5, 80, {}), (3, 90, {"table_hashes": 20_000}), (5, 80, {"block_shingles": 1500}), (1, 50, {})])
def test_join(spark, edge_docs, some_docs, k, percent, more):
    docs = edge_docs.select("doc_id", "text").union(some_docs.select(F.col("doc_id") + 100, "text")).cache()
    got = sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in ngram_join.join(docs, k, percent, **more).collect())
    assert got == joined([tuple(r) for r in docs.collect()], k, percent)


def test_join_of_nothing(no_docs):
    assert ngram_join.join(no_docs).count() == 0


def test_divide_skip_finds_all():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(2**60, 300, replace=False).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(300) < keep], rng.choice(2**60, 20).astype(np.uint64)])) for keep in rng.uniform(0.6, 1.0, 60)]
    for percent in (50, 80, 90):
        t = ngram_join.Threshold(percent)
        index = ngram_join.Index(sets)
        for s in sets:
            expected = {j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= percent * len(np.union1d(s, o))}
            assert {j for j, _ in index.search(s, t)} == expected
        half = ngram_join.Index(sets[:30])
        for s in sets[30:]:
            assert {j for j, _ in half.search(s, t)} == {j for j, o in enumerate(sets[:30]) if 100 * len(np.intersect1d(s, o)) >= percent * len(np.union1d(s, o))}


def cut(rows, length):
    count = collections.Counter(b[j : j + length] for _, b in rows for j in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        cover = np.zeros(len(b) + 2, np.int8)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                cover[j + 1 : j + 1 + length] = 1
        kept = np.frombuffer(b, np.uint8)[cover[1:-1] == 0].tobytes()
        out.append((-1 if i is None else i, len(b), len(b) - len(kept), int((np.diff(cover) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "more"), [(200, {}), (200, {"hot": 3, "chunk_bytes": 30_000, "bucket_windows": 500, "block_bytes": 20_000}), (57, {"gram": 24, "chunk_bytes": 60_000})])
def test_suffixes(spark, edge_docs, some_docs, length, more):
    short = edge_docs.where("doc_id IS NULL OR doc_id NOT IN (9, 10)").select("doc_id", "text")
    odd = spark.createDataFrame([(50, "ab" * 300), (51, "a" * 700), (52, "b" * 199), (53, "b" * 200), (54, "é" * 150)], "doc_id long, text string")
    docs = short.union(odd).union(some_docs.select(F.col("doc_id") + 100, "text")).cache()
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in suffix_dedup.remove_repeats(docs, names, length=length, **more).collect())
    assert got == cut([(i, (t or "").encode()) for i, t in docs.collect()], length)


@pytest.mark.parametrize(("length", "bucket"), [(20, 7), (33, 50), (64, 10_000)])
def test_suffix_order_is_that_of_plain_sorting(length, bucket):
    rng = np.random.default_rng(length)
    part = rng.integers(97, 100, 300).astype(np.uint8)
    text = np.concatenate([part, rng.integers(97, 99, 150).astype(np.uint8), part[:120], np.full(90, 97, np.uint8), part[37:250]])
    s = suffix_dedup.Suffixes(text, length)
    data, starts = text.tobytes(), np.arange(len(text) - length + 1)
    done = []
    for here in s.buckets(starts, bucket):
        order = here[s.ordered(starts[here])]
        done += [data[i : i + length] for i in starts[order]]
        same = s.equal(starts[order[:-1]], starts[order[1:]])
        assert [x == y for x, y in zip(done[len(done) - len(order) :], done[len(done) - len(order) + 1 :], strict=False)] == same.tolist()
    assert done == sorted(data[i : i + length] for i in starts)
    assert all((r + suffix_dedup._shift(r, q)) % 7 in suffix_dedup.COVER and (q + suffix_dedup._shift(r, q)) % 7 in suffix_dedup.COVER for r in range(7) for q in range(7))


def test_suffix_outputs(edge_docs, no_docs):
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(edge_docs.where("doc_id IN (9, 10, 3)"), ("n_bytes", "n_removed", "spans", "kept")).collect()}
    assert rows[10].n_removed == 250_000 and [tuple(s) for s in rows[10].spans] == [(0, 250_000)] and bytes(rows[10].kept) == b""
    assert rows[9].n_removed == 300_000 and rows[3].n_bytes == 0
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_lines(spark):
    rows = [(1, "Page 1 of 9\nonly here\n"), (2, "Page 2 of 9\nonly there"), (3, "Page 33 of 9\n\nwords"), (4, None), (5, ""), (None, "Page 4 of 9"), (6, "Posted by Anna in the general section today\nq"), (7, "Posted by Berta in the general section today\nr"), (8, "Posted by Carla in the general section today\ns")]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, n_lines string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(docs).collect()}
    assert got[1] == ("Page 1 of 9\nonly here\n", 3, 0)
    assert got[2] == ("only there", 2, 1) and got[3] == ("\nwords", 3, 1)
    assert got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[None] == ("Page 4 of 9", 1, 0)
    # DEPTH leading tokens hold the name, so that these lines are in leaves of their own and stay.
    assert got[7] == ("Posted by Berta in the general section today\nr", 2, 0)


def test_line_template_with_word_fields(spark):
    rows = [(i, f"Please report errors on page to {name} at once, thank you kindly") for i, name in enumerate(("Anna", "Berta", "Carla"))]
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_dropped) for r in got.collect()) == [(0, 0), (1, 1), (2, 1)]


def test_lines_of_fields_alone_must_be_the_same(spark):
    differ = [(i, f"{i}\n{i * 3} {i * 7} {i * 11}\n2019-01-0{i}\n日本語の文{i}です。\nSum {i} {i + 1} {i + 2}\nPage {i} of 9") for i in (1, 2, 3, 4)]
    same = [(i, "12 34 56\n2019") for i in (5, 6, 7)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_lines(spark.createDataFrame(differ + same, "doc_id long, text string")).collect()}
    assert got[1] == (differ[0][1], 0)
    for i, text in differ[1:]:
        assert got[i] == (text.rsplit("\n", 1)[0], 1)
    assert got[5] == ("12 34 56\n2019", 0) and got[6] == got[7] == ("", 2)


def test_lines_match_sql(spark, some_docs, no_docs):
    con = duckdb.connect()
    con.register("documents", some_docs.toPandas())
    theirs = sorted(con.execute(line_dedup.ORACLE).fetchall())
    kept = line_dedup.drop_lines(some_docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert sorted(map(tuple, kept.collect())) == theirs
    assert line_dedup.drop_lines(no_docs).count() == 0


def test_lines_run_no_python(some_docs):
    plan = line_dedup.drop_lines(some_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_edge_rows_survive(edge_docs):
    out = line_dedup.drop_lines(edge_docs)
    assert out.count() == edge_docs.count() and set(out.columns) == {*edge_docs.columns, "n_dropped"}


def test_lines_with_clashing_columns(spark):
    rows = [(i, f"a line that is in all of them\nand one of its own {chr(97 + i) * 5} here", i, "x", "y", i) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _doc string, _tid string, _text_id int")
    got = line_dedup.drop_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    plain = {r.doc_id: r.text for r in line_dedup.drop_lines(docs.select("doc_id", "text")).collect()}
    assert {r.doc_id: (r.text, r["_gone"], r["_text_id"]) for r in got.collect()} == {i: (t, i, i) for i, t in plain.items()}
