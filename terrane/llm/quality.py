"""Quality scores learned from preferences.

Each pair of a document labelled 1 and one labelled 0 is a preference. The Bradley-Terry model gives a document the strength w.x and the
pair the likelihood sigmoid(w.(x1 - x0)); w is fitted by logistic loss on the feature differences of all pairs. As a pair's likelihood
depends on two strengths alone, pairs are not made one by one: documents are added up in fine cells of strength, cells are paired, and
the likelihood between their edges is interpolated. The strength at the quantile that leaves the labelled share of good documents above
it, among all labelled ones, becomes the score CUT, so that score >= CUT is the threshold by quantile.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.store import Scratch
from terrane.llm.sums import at_rank, summed_by_batch
from terrane.llm.text import batch_of, map_batches, word_blocks

CUT = 0.7
#: Edges of the cells of strength; those beyond count as the outermost.
_EDGES = np.linspace(-32, 32, 1025)
_L2 = 1e-3
_CLIP = 6.0
_ASCII = 128


def features(text: str | None) -> np.ndarray:
    """Shares and ratios of a whole text's bytes, words and lines; all zero for an empty one. Read a block at a time."""
    out = np.zeros(_ASCII + 1 + 16, np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    out[:_ASCII] = np.sqrt(count[:_ASCII] / len(data))
    out[_ASCII] = np.sqrt(count[_ASCII:].sum() / len(data))
    n = total = square = capital = marked = digits = repeated = 0
    longest, kinds = 0, []
    for block, h, starts, ends in word_blocks(data):
        if not len(h):
            continue
        b, size = np.frombuffer(block, np.uint8), ends - starts
        first, last = b[starts], b[ends - 1]
        n += len(h)
        total += int(size.sum())
        square += float((size.astype(np.float64) ** 2).sum())
        longest = max(longest, int(size.max()))
        capital += int(((first >= 65) & (first <= 90)).sum())
        marked += int(((last >= 33) & (last <= 64) & (last != 44) & (last != 46) | (last >= 91) & (last <= 96)).sum())
        digits += int(((first >= 48) & (first <= 57)).sum())
        repeated += int((h[1:] == h[:-1]).sum())
        kinds.append(np.unique(h))
    lines = data.split(b"\n")
    letters = count[65:91].sum() + count[97:123].sum() + count[_ASCII:].sum()
    extra = [np.log1p(len(data)) / 10, len(set(lines)) / len(lines), min(1.0, len(lines) / max(1, n)), letters / len(data), count[65:91].sum() / max(1.0, letters)]
    if n:
        distinct = len(kinds[0]) if len(kinds) == 1 else len(np.unique(np.concatenate(kinds)))
        mean = total / n
        extra += [distinct / n, distinct / np.sqrt(n) / 20, np.log1p(n) / 10, mean / 10, np.sqrt(max(0.0, square / n - mean * mean)) / 10, np.log1p(longest) / 5, capital / n, marked / n, digits / n, repeated / n]
    out[_ASCII + 1 : _ASCII + 1 + len(extra)] = extra
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # the strength that gets the score CUT

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -_CLIP, _CLIP) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = self.strengths(x) - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(strength, -30, 30)))


def _placed(strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edge below each strength, and how far it is on the way to the next."""
    at = np.clip((strength - _EDGES[0]) / (_EDGES[1] - _EDGES[0]), 0, len(_EDGES) - 1 - 1e-9)
    low = at.astype(np.int64)
    return low, at - low


def _by_edge(z: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Numbers and sums of rows by edge, each row shared between the two edges beside its strength."""
    low, part = _placed(strength)
    at, n = np.concatenate([low, low + 1]), len(_EDGES)
    return np.stack([np.bincount(at, np.concatenate([(1 - part) * c, part * c]), n) for c in (np.ones(len(z)), *z.T)], axis=1)


#: Adds up what a function of features and marks (good or not) makes of all rows.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def fit(total: Total, width: int) -> tuple[Model, int]:
    """Logistic loss on the feature differences of all pairs, by Newton steps; the model without its cut, and the number of bad ones."""
    s = total(lambda x, good: np.concatenate([[good.sum()], [(~good).sum()], x.sum(axis=0), (x**2).sum(axis=0)]))
    up, down = (int(s[0]), int(s[1])) if len(s) else (0, 0)
    if not up or not down:  # no pair: nothing sets documents apart
        return Model(np.zeros(width), np.ones(width), np.zeros(width), -1.0 if up else 1.0), down
    mean = s[2 : 2 + width] / (up + down)
    scale = np.sqrt(np.maximum(s[2 + width :] / (up + down) - mean**2, 0)) + 1e-3
    wrong = 1 / (1 + np.exp(np.clip(_EDGES[:, None] - _EDGES[None, :], -30, 30)))  # of a good edge and a bad one
    slope = wrong * (1 - wrong)
    w = np.zeros(width)

    def z_of(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / scale, -_CLIP, _CLIP)

    for _ in range(25):
        # What tasks run holds the weights of this step.
        def edges(x: np.ndarray, good: np.ndarray, w=w) -> np.ndarray:
            z = z_of(x)
            return np.stack([_by_edge(z[g], z[g] @ w) for g in (good, ~good)])

        good, bad = total(edges).reshape(2, len(_EDGES), width + 1)
        curve = np.stack([slope @ bad[:, 0], slope.T @ good[:, 0]]) / (up * down)

        def squares(x: np.ndarray, good: np.ndarray, w=w, curve=curve) -> np.ndarray:
            z = z_of(x)
            low, part = _placed(z @ w)
            side = np.where(good, 0, 1)
            return (z * ((1 - part) * curve[side, low] + part * curve[side, low + 1])[:, None]).T @ z

        cross = good[:, 1:].T @ slope @ bad[:, 1:] / (up * down)
        bend = total(squares).reshape(width, width) - cross - cross.T
        pull = ((wrong @ bad[:, 0]) @ good[:, 1:] - (wrong.T @ good[:, 0]) @ bad[:, 1:]) / (up * down)
        step = np.linalg.solve(bend + (_L2 + 1e-9) * np.eye(width), pull - _L2 * w)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, 0.0), down


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the doc_id and text of ``docs`` and the quality of ``labels``, learned from every labelled document with a text.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the highest counts, and of rows that repeat an id
    one. Features are made before documents meet labels, so that no text is shuffled; the driver gets sums alone.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    width = len(features(""))
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg((F.max("quality") == 1).alias("good"))
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.string()), ("x", pa.binary())])

    def kernel():
        return lambda b: batch_of(schema, [b.column(0), [features(x.as_py()).tobytes() for x in b.column(1)]])

    each = map_batches(rows, kernel, "doc_id string, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).join(marked, "doc_id").select("good", "x")
    table = scratch.save(each, "features")

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, width).astype(np.float64), np.array(batch.column(0).to_pylist(), bool)

    def total(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        return summed_by_batch(table, lambda batch: f(*rows_of(batch)))[1]

    model, down = fit(total, width)
    if model.weights.any():
        strength = pa.schema([("v", pa.float64())])
        found = scratch.save(map_batches(table, lambda: lambda b: batch_of(strength, [model.strengths(rows_of(b)[0])]), "v double"), "strengths")
        model.cut = sum(at_rank(found, down - 1)) / 2
        scratch.drop(found)
    scratch.drop(table)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with score (0 to 1) and predicted (1 from CUT on) added; columns of these names are replaced.

    Null texts count as empty ones. Repeated rows each give a row; other columns pass through.
    """
    from pyspark.sql import types as T

    rows = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    at = rows.columns.index("text")

    def kernel():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t.as_py()) for t in batch.column(at)])
            s = model.scores(x)
            return batch_of(pa.schema([*batch.schema, ("score", pa.float64()), ("predicted", pa.int32())]), [*batch.columns, s, (s >= CUT).astype(np.int32)])

        return run

    return map_batches(rows, kernel, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
