"""Arrays that tasks make of their rows, added up piece by piece, so that neither a task nor the driver meets all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.katz import pack, unpack

_PIECES = 64
SUMS = "piece int, n long, sums binary"


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """Arrays of one piece, and their numbers of rows, added up."""
    total = sum(unpack(x).astype(np.float64) for x in table["sums"].to_pylist())
    return pa.table({"piece": table["piece"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "sums": pa.array([pack(total)], pa.binary())})


def in_pieces(a: np.ndarray, n: int) -> pa.RecordBatch:
    parts = np.array_split(a.reshape(-1), _PIECES)
    return pa.record_batch({"piece": pa.array(range(_PIECES), pa.int32()), "n": pa.array([n] * _PIECES, pa.int64()), "sums": pa.array([pack(x) for x in parts], pa.binary())})


def summed_by_task(rows: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> tuple[int, np.ndarray]:
    """The number of ``rows``, and the sum of the arrays that ``kernel`` makes of the batches of a task, flat; empty without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def each() -> Iterator[pa.RecordBatch]:
            nonlocal n
            for batch in batches:
                n += batch.num_rows
                if batch.num_rows:
                    yield batch

        first = next(here := each(), None)
        if first is not None:
            total = kernel(chain([first], here))
            yield in_pieces(total, n)

    return total_of(rows.mapInArrow(run, SUMS))


def summed(rows: DataFrame, kernel: Callable[[Iterator[dict]], np.ndarray]) -> tuple[int, np.ndarray]:
    """The same of what ``kernel`` makes of rows one by one."""
    return summed_by_task(rows, lambda batches: kernel({k: c[i].as_py() for k, c in zip(b.schema.names, b.columns, strict=True)} for b in batches for i in range(b.num_rows)))


def summed_by_batch(rows: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[int, np.ndarray]:
    """The same of what ``kernel`` makes of each batch."""
    return summed_by_task(rows, lambda batches: reduce(np.add, map(kernel, batches)))


def total_of(sums: DataFrame) -> tuple[int, np.ndarray]:
    rows = sorted(sums.groupBy("piece").applyInArrow(_added, SUMS).collect(), key=lambda r: r["piece"])
    return (rows[0]["n"], np.concatenate([unpack(r["sums"]) for r in rows])) if rows else (0, np.zeros(0))


def at_rank(values: DataFrame, k: int) -> tuple[float, float]:
    """The k-th and the next smallest number, from 0, of the column v; by counts in ever finer cells, of which the last holds one number."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    first = k
    while low < high:
        cell = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / 4096)), F.lit(4095))
        for _, n, low, high in sorted(tuple(r) for r in values.where(F.col("v").between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)), F.min("v"), F.max("v")).collect()):  # noqa: B007
            if k < n:
                break
            k -= n
    upto, after = values.agg(F.count(F.when(F.col("v") <= low, 1)), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    return low, low if first + 1 < upto or after is None else after
