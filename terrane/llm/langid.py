"""Language identification by string kernels.

The kernel of two texts is the number of distinct character n-grams (lengths 1 to 3 blended, lower-cased) that both hold, over the
geometric mean of their numbers. Landmark texts give a Nyström map; one-versus-rest kernel ridge regression is solved on all mapped
texts that have a language, by the sums of its normal equations, which tasks add up. As kernel and regression are linear in the presence vectors, landmarks and weights fold into one matrix of n-grams by languages,
and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.sample import of_each
from terrane.llm.sums import summed_by_task
from terrane.llm.text import batch_of, map_batches

#: n-grams are hashed to this many cells; presence in a cell is a feature.
CELLS = 1 << 18
ORDERS = (1, 2, 3)
#: Bounds of the number of languages and of that of landmarks, which is at least one of each language.
LANGUAGES, LANDMARKS = 4000, 512
RIDGE = 1e-2
UNKNOWN = "und"
_CHUNK = 1 << 20


def present(text: str | None) -> np.ndarray:
    """Sorted cells of the n-grams of a whole text; none if it has no letter. Long texts are read a million characters at a time."""
    text = (text or "").lower()
    if not any(map(str.isalpha, text)):
        return np.zeros(0, np.int64)
    seen = np.zeros(CELLS, bool)
    for at in range(0, len(text), _CHUNK):
        c = np.frombuffer(text[max(0, at - max(ORDERS) + 1) : at + _CHUNK].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if n > len(c):
                break
            h = (h[: len(c) - n + 1] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] * np.uint64(0xD6E8FEB86659FD93)
            if n in ORDERS:
                seen[(h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - CELLS.bit_length() + 1)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    languages: list[str]
    slot: np.ndarray  # of each cell: its row in weights, or -1
    weights: np.ndarray  # n-grams of landmarks by languages, float32

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Ridge outputs of texts given by their cells, by languages."""
        x = np.zeros((len(sets), len(self.weights)), np.float32)
        for i, cells in enumerate(sets):
            if len(cells):
                rows = self.slot[cells]
                x[i, rows[rows >= 0]] = 1 / np.sqrt(len(cells))
        return x @ self.weights


class Landmarks:
    """Texts (cells) that the others are compared with."""

    def __init__(self, sets: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]))
        self.slot = np.full(CELLS, -1)
        self.slot[self.vocabulary] = np.arange(len(self.vocabulary))
        self.matrix = self.presence(sets)
        self.n = np.array([max(1, len(x)) for x in sets])

    def presence(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for i, cells in enumerate(sets):
            at = self.slot[cells]
            x[i, at[at >= 0]] = 1
        return x

    def sums(self, sets: list[np.ndarray], codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Kernels k of texts with the landmarks as they enter the equations: the sum of weighted k'k, then of k by language."""
        n = np.array([max(1, len(x)) for x in sets], np.float64)
        k = (self.presence(sets) @ self.matrix.T).astype(np.float64) / np.sqrt(n[:, None] * self.n)
        of = np.zeros((len(weights), len(sets)))
        of[codes, np.arange(len(sets))] = 1
        return np.concatenate([k.T @ (weights[codes][:, None] * k), of @ k])

    def solved(self, names: list[str], weights: np.ndarray, n: int, sums: np.ndarray) -> Model:
        """One-versus-rest kernel ridge regression on the Nyström map, from the sums over n texts."""
        square, by = sums[: len(self.n)], sums[len(self.n) :] * weights[:, None]
        values, vectors = np.linalg.eigh((self.matrix @ self.matrix.T).astype(np.float64) / np.sqrt(self.n[:, None] * self.n))
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])  # the pseudo-inverse's square root
        target = 2 * by - by.sum(axis=0)
        beta = np.linalg.solve(root.T @ square @ root + RIDGE * n / 100 * np.eye(root.shape[1]), root.T @ target.T)
        return Model(names, self.slot, (self.matrix.T @ (root @ beta / np.sqrt(self.n)[:, None])).astype(np.float32))


def _nothing() -> Model:
    return Model([], np.full(CELLS, -1), np.zeros((0, 0), np.float32))


def _weights(counts: list[int]) -> np.ndarray:
    return sum(counts) / (len(counts) * np.array(counts, np.float64))  # languages count alike


def fit(sets: list[np.ndarray], languages: list[str]) -> Model:
    """A model from texts at hand, the first ones of each language being landmarks."""
    names, counts = sorted(set(languages)), Counter(languages)
    if not names:
        return _nothing()
    each = max(1, LANDMARKS // len(names))
    marks = Landmarks([sets[i] for name in names for i in [i for i, x in enumerate(languages) if x == name][:each]])
    weights = _weights([counts[x] for x in names])
    return marks.solved(names, weights, len(sets), marks.sums(sets, np.array([names.index(x) for x in languages]), weights))


def train(docs: DataFrame) -> Model:
    """A model from the doc_id, text and lang of ``docs``, learned from every row that has both an id and a language and holds a letter.

    Of more than LANGUAGES languages the commonest are learned. Rows that repeat an id count each. Landmarks are chosen by hash of id, as
    many of each language, and meet on the driver; of the others it gets sums.
    """
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(F.col("text").rlike("\\p{L}")).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return _nothing()
    picked = of_each(known, "lang", [(r["lang"], r["ids"]) for r in sizes], max(1, LANDMARKS // len(sizes)))
    rows = known.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    schema = pa.schema([("doc_id", pa.string()), ("lang", pa.string()), ("cells", pa.binary())])

    def kernel():
        return lambda b: batch_of(schema, [b.column(0), b.column(1), [present(x.as_py()).astype(np.int32).tobytes() for x in b.column(2)]])

    cells = map_batches(rows, kernel, "doc_id string, lang string, cells binary").where(F.length("cells") > 0)
    marks = [np.frombuffer(r[2], np.int32) for r in sorted(tuple(r) for r in cells.groupBy("lang", "doc_id").agg(F.min("cells")).collect())]
    counts = {r["lang"]: r["n"] for r in sizes}
    names = sorted(counts)
    weights, code = _weights([counts[x] for x in names]), {x: i for i, x in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        landmarks, total, sets, codes = Landmarks(shared.value), 0, [], []
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                if (at := code.get(lang.as_py())) is not None:
                    sets.append(present(text.as_py()))
                    codes.append(at)
                if len(sets) == 256:
                    total = total + landmarks.sums(sets, np.array(codes), weights)
                    sets, codes = [], []
        return total + landmarks.sums(sets, np.array(codes, np.int64), weights)

    landmarks = Landmarks(marks)
    _, found = summed_by_task(known.select("text", "lang"), sums)
    return landmarks.solved(names, weights, sum(counts.values()), found.reshape(len(marks) + len(names), len(marks)))


def confidence(scores: np.ndarray) -> np.ndarray:
    """Ridge outputs (about -1 or 1) as shares that sum to 1."""
    e = np.exp(3 * (scores - scores.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score added (columns of these names are replaced).

    ``und`` with score 0 where the text is null or has no letter, or where the model knows no language. Ties go to the first
    language by name. Repeated rows each give a row; other columns pass through.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*kept)
    at = kept.index("text")

    def kernel():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, shares = [], []
            for i in range(0, batch.num_rows, 64):
                sets = [present(x.as_py()) for x in batch.column(at)[i : i + 64]]
                if not model.languages:
                    names += [UNKNOWN] * len(sets)
                    shares += [0.0] * len(sets)
                    continue
                c = confidence(model.scores(sets))
                best = c.argmax(axis=1)
                names += [model.languages[b] if len(s) else UNKNOWN for b, s in zip(best, sets, strict=True)]
                shares += [float(row[b]) if len(s) else 0.0 for row, b, s in zip(c, best, sets, strict=True)]
            schema = pa.schema([*batch.schema, ("lang_pred", pa.string()), ("score", pa.float64())])
            return batch_of(schema, [*batch.columns, names, shares])

        return run

    from pyspark.sql import types as T

    return map_batches(rows, kernel, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
