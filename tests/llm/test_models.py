"""Language model, classifiers, personal data and tokens: brute force, held-out accuracy and round trips."""

import collections
import math
import pathlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from terrane.llm import bpe, katz, langid, pii, quality, sample, sums
from terrane.llm.text import bucket_of, word_hashes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

TESTDATA = "/root/testdata"


def model_scores(rows):
    """doc rows (text, train) scored by the definition."""
    tokens = [((t or "").encode().lower().split() + ["END"], train) for t, train in rows]
    one, two, texts = collections.Counter(), collections.Counter(), 0
    for t, train in tokens:
        if train:
            one.update(t)
            two.update(zip(["BEGIN", *t[:-1]], t, strict=True))
            texts += 1
    n, v = sum(one.values()), len(one)
    by = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, katz.GT_MAX + 2)]
    d1, d2 = katz.discounts(by(one)), katz.discounts(by(two))
    p1 = {w: d1[min(c, katz.GT_MAX + 1)] * c / (n + 1) for w, c in one.items()}
    unknown = 1 - sum(p1.values())
    count = {**one, "BEGIN": texts}
    seen = collections.defaultdict(list)
    for (h, w), c in two.items():
        seen[h].append((w, d2[min(c, katz.GT_MAX + 1)] * c / (count[h] + 1)))
    alpha = {h: (1 - sum(p for _, p in s)) / (1 - sum(p1[w] for w, _ in s)) for h, s in seen.items()}
    for h, s in seen.items():  # each distribution sums to 1
        rest = 1 - sum(p1[w] for w, _ in s)
        assert sum(p for _, p in s) + alpha[h] * rest == pytest.approx(1)
    out = []
    for t, _ in tokens:
        score = base = 0.0
        for h, w in zip(["BEGIN", *t[:-1]], t, strict=True):
            c = two.get((h, w), 0)
            score += math.log10(d2[min(c, katz.GT_MAX + 1)] * c / (count[h] + 1)) if c else math.log10(alpha.get(h, 1.0)) + math.log10(p1.get(w, unknown))
            base += math.log10((one.get(w, 0) + 1) / (n + v + 1))
        out.append((len(t), sum(w in one for w in t), n, base, score))
    return out


@pytest.mark.parametrize("more", [{}, {"chunk_tokens": 3000, "table_hashes": 2000}])
def test_katz(edge_docs, some_docs, more):
    docs = edge_docs.select("doc_id", "text").union(some_docs.select(F.col("doc_id") + 100, "text")).withColumn("k", F.monotonically_increasing_id()).cache()
    train = bucket_of(F.col("doc_id"), 7) != 2
    rows = docs.select("doc_id", "text", train.alias("t")).collect()
    expected = sorted((-1 if r.doc_id is None else r.doc_id, not r.t, *s) for r, s in zip(rows, model_scores([(r.text, r.t) for r in rows]), strict=True))
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in katz.score(docs, train, **more).collect())
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_katz_tables_are_small(spark, some_docs):
    rng = np.random.default_rng(4)
    for a in (rng.choice(rng.standard_normal(50), 4000), rng.standard_normal(4000), np.zeros(0), np.ones(1)):
        assert (katz.unpack_values(katz.pack_values(a)) == a).all() and len(katz.pack_values(a)) <= len(katz.pack(a))
    assert len(katz.pack_values(rng.choice(rng.standard_normal(50), 4000))) < 0.5 * len(katz.pack(rng.choice(rng.standard_normal(50), 4000)))
    katz.score(some_docs, F.lit(True)).count()
    left = {p.name.split("-")[1] for run in pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("katz-*") for p in run.iterdir()}
    assert "counts" not in left and "scored" in left


def test_katz_of_little(no_docs, edge_docs):
    assert katz.score(no_docs, F.lit(True)).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in katz.score(edge_docs, F.lit(False)).collect())


def test_word_hashes():
    t = "One two\tTHREE  two\n" * 200_000
    h = word_hashes(t)
    assert len(h) == 800_000 and len(set(h.tolist())) == 3 and (h[:4] == h[-4:]).all()
    assert len(word_hashes("x" * 3_000_000 + " y")) == 2 and len(word_hashes(None)) == 0
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aB \t\n\x0b\x1c\x85é") for _ in range(rng.randint(0, 60)))
        w = t.encode().lower().split()
        h = word_hashes(t).tolist()
        assert len(h) == len(w) and len(set(h)) == len(set(w))


def test_languages(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    model = langid.train(docs.where(bucket_of(F.col("doc_id"), 5) != 0))
    held = langid.predict(docs.where(bucket_of(F.col("doc_id"), 5) == 0), model).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    rows = langid.predict(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and set(rows[0].asDict()) == {*edge_docs.columns, "lang_pred"}
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 6)) and by[7].lang_pred in model.languages and by[11].lang_pred != "und"
    assert langid.predict(no_docs, model).count() == 0
    assert all(r.lang_pred == "und" for r in langid.predict(edge_docs, langid.train(no_docs)).collect())


def test_languages_by_explicit_kernels():
    rng = random.Random(4)
    words = {"a": ["lo", "ran", "mi", "sol"], "b": ["ker", "un", "sti", "ran"], "c": ["zhu", "lo", "qi", "un"]}
    texts = [(x, " ".join(rng.choice(words[x]) for _ in range(rng.randint(2, 9)))) for x in "abc" for _ in range(12)]
    new = [" ".join(rng.choice(sum(words.values(), [])) for _ in range(6)) for _ in range(20)]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    kernel = lambda s, t: len(grams(s) & grams(t)) / math.sqrt(len(grams(s)) * len(grams(t)))
    k = np.array([[kernel(s, t) for _, t in texts] for _, s in texts])
    target = np.array([[1.0 if x == name else -1.0 for name in "abc"] for x, _ in texts])
    # All texts are landmarks, so that the Nyström map is exact; ridge regression in the dual form, languages of one size.
    dual = np.linalg.solve(k + langid.RIDGE * len(texts) / 100 * np.eye(len(texts)), target)
    model = langid.fit([langid.present(t) for _, t in texts], [x for x, _ in texts])
    got = model.scores([langid.present(t) for t in new])
    assert np.allclose(got, np.array([[kernel(s, t) for _, t in texts] for s in new]) @ dual, atol=2e-3)


def test_languages_are_learned_from_all_rows(spark, monkeypatch):
    rng = random.Random(6)
    words = {"a": ["lo", "ran", "mi", "sol"], "b": ["ker", "un", "sti", "ran"]}
    texts = [(x, " ".join(rng.choice(words[x]) for _ in range(rng.randint(2, 6)))) for x in "aaab" for _ in range(450)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)] + [(9, None, "a"), (10, "123", "b"), (11, "lo", None)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "LANDMARKS", 4000)  # all texts are landmarks, as in the plain fit
    got, expected = langid.train(docs), langid.fit([langid.present(t) for _, t in texts], [x for x, _ in texts])
    new = [langid.present(" ".join(rng.choice(sum(words.values(), [])) for _ in range(6))) for _ in range(20)]
    assert got.languages == expected.languages and np.allclose(got.scores(new), expected.scores(new), atol=2e-3)


def test_samples_are_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "de").when(F.col("id") < 30, "fr").otherwise("en").alias("lang"))
    more = docs.union(docs.where("doc_id = 9").crossJoin(spark.range(500)).select("doc_id", "lang")).union(spark.createDataFrame([(None, "en"), (5000, None)], "doc_id long, lang string"))
    got = collections.Counter(r.lang for r in sample.of_each(more, "lang", [("de", 1000), ("fr", 20), ("en", 1980)], 50).collect())
    assert got == {"de": 50, "fr": 20, "en": 50}
    again = {tuple(r) for r in sample.of_each(docs, "lang", [("de", 1000), ("en", 1980)], 50).collect()}
    assert again <= {tuple(r) for r in sample.of_each(more, "lang", [("de", 1100), ("fr", 20), ("en", 1980)], 60).collect()}


def test_models_of_rows_that_repeat_ids(spark):
    docs = spark.createDataFrame([(i % 4, f"{'der Hund' if i % 2 else 'the cat'} {i % 4}", "de" if i % 2 else "en") for i in range(400)] + [(None, "le chat", "fr"), (7, "le chat", "fr")], "doc_id long, text string, lang string")
    assert langid.train(docs).languages == ["de", "en", "fr"]
    assert quality.train(docs, spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1)], "doc_id long, quality int")).weights.any()
    assert not quality.train(docs, spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, quality int")).weights.any()  # one label: no pair


def test_quality(spark, edge_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = bucket_of(F.col("doc_id"), 4) == 2
    model = quality.train(docs.where(~held), labels.where(~held))
    rows = quality.score(docs.where(held), model).join(labels, "doc_id").select("quality", "predicted", "score").collect()
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.97
    edge = quality.score(edge_docs, model).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in edge)
    assert quality.score(no_docs, quality.train(no_docs, labels)).count() == 0


def test_quality_learns_from_all_pairs_of_all_labelled_rows(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["Sun.", "moon", "rain,", "42", "Sea", "ab", "!!"], 6 + i % 5)) + (" good" if i % 9 and i % 7 else "") for i in range(2600)]
    good = np.array([i % 9 > 0 for i in range(2600)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int"))
    x = np.array([quality.features(t) for t in texts]).astype(float)
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-6)
    strength = model.strengths(x)
    assert abs((strength > model.cut).sum() - good.sum()) <= (strength == model.cut).sum()
    # The derivative of the loss over all pairs is nought at the weights.
    z = np.clip((x - model.mean) / model.scale, -quality._CLIP, quality._CLIP)
    wrong = 1 / (1 + np.exp(strength[good][:, None] - strength[~good][None, :]))
    pull = (wrong.sum(axis=1) @ z[good] - wrong.sum(axis=0) @ z[~good]) / wrong.size
    assert np.abs(pull).max() > 1e-5 and np.allclose(pull, quality._L2 * model.weights, atol=2e-4)


def test_at_rank(spark):
    v = [0.5, 0.5, 0.5, -3.0, 1e-12, 2e-12, 7.25, 7.25, 1e9]
    table = spark.createDataFrame([(x,) for x in v], "v double")
    s = sorted(v)
    assert [sums.at_rank(table, k) for k in range(8)] == list(zip(s[:-1], s[1:], strict=True))


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("a@.-_ 1234567890.+()@@..4111é") for _ in range(rng.randint(0, 60)))
        base, spans = pii.find_in(t)
        assert base == base_spans(t) and set(base) <= set(spans)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to bob [at] mail (dot) example dot com now", "email", "bob [at] mail (dot) example dot com"), ("john dot doe at mail dot com", "email", "john dot doe at mail dot com"), ("see ｂｏｂ＠mail．com", "email", "ｂｏｂ＠mail．com"), ("bоb@mаil.com!", "email", "bоb@mаil.com"),
        ("at one nine two dot one six eight dot one dot two ok", "ip", "one nine two dot one six eight dot one dot two"), ("call plus one five five five one two three four five six", "phone", "plus one five five five one two three four five six"),
        ("no 4111 1111​ 1111 1111.", "card", "4111 1111​ 1111 1111"), ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("mail bob at gmail.com now", "email", "bob at gmail.com"), ("john.doe at mail.example works", "email", "john.doe at mail.example"), ("john＠example。com", "email", "john＠example。com"),
        ("write b o b @ g m a i l . c o m today", "email", "b o b @ g m a i l . c o m"), ("call +1 five five five 123 4567", "phone", "+1 five five five 123 4567"),
    ],
)
def test_disguises(text, kind, part):
    base, spans = pii.find_in(text)
    assert not base and (kind, text.index(part), text.index(part) + len(part)) in spans


@pytest.mark.parametrize("text", ["look at the example. comma dot next", "one two three", "we met at noon, dot by dot", "de un six neuf amis", "eins plus eins", "look at example.com", "plus one or two", "a b @ c d"])
def test_plain_prose_is_left(text):
    assert pii.find_in(text) == ([], [])


def disguised(rng):
    """An identifier of a kind, and the same disguised in one of several ways."""
    kind = rng.choice(["email", "email", "ip", "card", "phone"])
    name = lambda n: "".join(rng.choice("abcdeghknoprstuw") for _ in range(n))
    spoken = lambda s: " ".join("zero one two three four five six seven eight nine".split()[int(c)] for c in s)
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) for c in s)
    if kind == "email":
        user, host, top = name(rng.randint(3, 9)), name(rng.randint(3, 9)), rng.choice(["com", "org", "net"])
        doubles = str.maketrans("aeop", "аеор")
        ways = [f"{user} [at] {host} [dot] {top}", f"{user} (at) {host} dot {top}", f"{user} at {host} dot {top}", f"{user}@{host} . {top}".replace(" . ", " (.) "), wide(f"{user}@{host}.{top}"), f"{user}@{host}a.{top}".translate(doubles), f"{user}​@{host}.{top}", " ".join(f"{user}@{host}.{top}")]
        return kind, rng.choice(ways)
    if kind == "ip":
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return kind, rng.choice([" dot ".join(parts), "[.]".join(parts), "(dot)".join(parts), wide(".".join(parts)), "​.".join(parts), " dot ".join(spoken(p) for p in parts)])
    if kind == "card":
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        number = next(body + c for c in "0123456789" if pii.luhn(body + c))
        return kind, rng.choice([wide(number), spoken(number), "​".join(number[i : i + 4] for i in (0, 4, 8, 12)), "\u00a0".join(number[i : i + 4] for i in (0, 4, 8, 12))])
    number = "1" + "".join(rng.choice("0123456789") for _ in range(10))
    return kind, rng.choice([f"plus {spoken(number)}", wide("+" + number), f"+1 {spoken(number[1:4])} {number[4:7]} {number[7:]}", "+1​" + number[1:]])


def test_recall_of_generated_disguises():
    rng, found, exact = random.Random(9), 0, 0
    for _ in range(3000):
        kind, text = disguised(rng)
        before = " ".join(rng.choice(["we", "saw", "report", "then"]) for _ in range(rng.randint(1, 5))) + ": "
        spans = [(s, e) for k, s, e in pii.find_in(before + text + " ; and so on")[1] if k == kind]
        found += any(s < len(before + text) and e > len(before) for s, e in spans)
        exact += (len(before), len(before + text)) in spans
    assert found / 3000 > 0.97 and exact / 3000 > 0.95


def test_find(edge_docs, no_docs):
    assert pii.find(edge_docs).count() == edge_docs.count() and pii.find(no_docs).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe(name):
    ranks = bpe.read_ranks(public_tokenizers.path(name))
    ours, theirs = bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    alphabets = ["aab", "ab c", "the inhg", "éèà l", "0123 ", "日本語の ", "!?#.$ ", "\n\t \r\x0b\x1c\x85 ", "aA'sStT", "🎉👍🏽", "abcdefghijklmnopqrstuvwxyz"]
    for _ in range(5000):
        a = rng.choice(alphabets) + rng.choice(alphabets)
        t = "".join(rng.choice(a) for _ in range(rng.randint(0, 40)))
        assert ours.encode(t) == theirs.encode_ordinary(t)
        assert ours.decode(ours.encode(t)).decode() == t
    for t in ("a" * 50_000, "".join(rng.choice("abcdefgh") for _ in range(100_000)), "ab 12 " * 300_000):
        assert ours.encode(t) == theirs.encode_ordinary(t)


def test_encode(edge_docs, no_docs):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN, ("n_tokens", "token_ids", "decoded")).collect()
    texts = sorted((r.text or "") for r in edge_docs.collect())
    assert sorted(bytes(r.decoded).decode() for r in rows) == texts
    assert all(list(r.token_ids) == theirs.encode_ordinary(bytes(r.decoded).decode()) and r.n_tokens == len(r.token_ids) for r in rows)
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
