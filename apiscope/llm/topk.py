"""Exact top-k by inner product: columnar branch and bound.

Vectors become integers, floor(1024 * x) of every component x.  Candidates of a
task are laid out dimension by dimension.  For each query, scores accumulate
over blocks of dimensions; after a block, a candidate survives only if its
partial score plus the greatest share that the remaining dimensions can add
(the product of both remaining lengths) reaches the query's k-th best score so
far, and the survivors are compacted.  Queries go to the tasks in blocks of
bounded size; each task keeps k rows a query, and a window over those merges.

Defined results: vectors that are null or hold a null or non-finite component
take no part, and neither do rows with a null id; an empty vector scores 0;
shorter vectors count as filled up with zeros; components and scores are exact
integers of any size, ranks follow the exact score, and a score beyond a long is
shown as the nearest long; rows that repeat an id are each a
candidate for other queries, and none for queries of that id; queries of equal
id and vector are one; ties go to the smaller id.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components of one block of queries: 8 bytes each in a broadcast.
QUERY_COMPONENTS = 1 << 20
#: Candidates laid out at a time, and dimensions accumulated between two bounds.
CANDIDATES, DIMENSIONS = 8192, 8

_SCALABLE = 2.0**1000
_LONG = 1 << 63


def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, floor(1024 * x) of theirs as a zero-filled matrix)."""
    if len(vectors) == 0:
        return np.empty(0, np.int64), np.empty((0, 0))
    usable = vectors.is_valid().to_numpy(zero_copy_only=False)
    vectors = vectors.cast(pa.list_(pa.float64()))
    ends = vectors.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    inner = vectors.values
    given = inner.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.zeros(len(given) + 1, np.int64)
    np.cumsum(~np.isfinite(given), out=bad[1:])
    finite = np.where(np.isfinite(given), given, 0)
    if np.abs(finite).max(initial=0) < _SCALABLE:
        value = np.floor(1024.0 * finite)
    else:  # 1024 times that is no double, but an integer all the same
        value = np.array([int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x)
                          for x in finite.tolist()], dtype=object)
    sizes = np.diff(ends)
    usable &= bad[ends[1:]] == bad[ends[:-1]]
    rows = np.flatnonzero(usable)
    width = int(sizes[rows].max()) if len(rows) else 0
    out = np.zeros((len(rows), width), value.dtype)
    if len(rows):
        row = np.repeat(np.arange(len(rows)), sizes[rows])
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
        out[row, at] = value[np.repeat(ends[rows], sizes[rows]) + at]
    return rows, out


def _as_float(x) -> float:
    """A bound that doubles can be compared with."""
    return float(x) if abs(x) < _SCALABLE else math.copysign(math.inf, x)


class Best:
    """The k best (score, smaller id first) candidates of each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.vectors = vectors
        self.found: list[tuple[np.ndarray, np.ndarray]] = [
            (np.empty(0), np.empty(0, np.int64)) for _ in ids]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Bring in candidates: a matrix of one row each."""
        width = self.vectors.shape[1]
        columns = np.zeros((width, len(ids)), rows.dtype)
        shared = min(width, rows.shape[1])
        columns[:shared] = rows[:, :shared].T
        exact = (int(np.abs(columns).max(initial=0)) * int(np.abs(self.vectors).max(initial=0)) * width
                 < 2**52)
        cuts = list(range(0, width, DIMENSIONS)) or [0]
        order = np.arange(width)
        if exact:
            # dimensions of most mass first, so that little of it remains early
            columns, query_type = columns.astype(float), float
            order = np.argsort(-np.square(columns).sum(axis=1), kind="stable")
            columns = columns[order]
            rest = np.sqrt(np.cumsum(np.square(columns)[::-1], axis=0)[::-1])  # mass from a dimension on
        else:  # beyond what doubles add exactly
            columns = np.array([[int(x) for x in row] for row in columns], dtype=object).reshape(
                width, len(ids))
            query_type = object
        for i, own in enumerate(self.ids):
            score, best = self.found[i]
            least = score[-1] if len(score) == self.k else -np.inf
            alive = np.flatnonzero(ids != own)
            query = self.vectors[i][order]
            if exact:
                query, least = query.astype(query_type), _as_float(least)
                mass = np.sqrt(np.cumsum(np.square(query)[::-1])[::-1])
                total = np.zeros(len(alive))
            else:
                total = np.array([0] * len(alive), dtype=object)
            for c in cuts:
                block = columns[c:c + DIMENSIONS]
                if exact:
                    total += query[c:c + DIMENSIONS] @ (block if len(alive) == len(ids)
                                                        else block[:, alive])
                else:
                    for q, row in zip(query[c:c + DIMENSIONS], block, strict=True):
                        total = total + int(q) * row[alive]
                nxt = c + DIMENSIONS
                if exact and nxt < width and least > -np.inf:
                    reach = total + mass[nxt] * rest[nxt][alive] * (1 + 1e-9) + 1e-6
                    keep = reach >= least
                    alive, total = alive[keep], total[keep]
                    if not len(alive):
                        break
            if len(alive):
                keep = np.array(total >= least, bool)
                all_scores = np.concatenate([score, total[keep]])
                all_ids = np.concatenate([best, ids[alive[keep]]])
                if all_scores.dtype == object:  # whole doubles among them are exact
                    top = sorted(range(len(all_ids)), key=lambda j: (-int(all_scores[j]), all_ids[j]))
                else:
                    top = np.lexsort((all_ids, -all_scores))
                self.found[i] = all_scores[top[:self.k]], all_ids[top[:self.k]]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.found]
        score = [int(x) for s, _ in self.found for x in s]
        best = np.concatenate([b for _, b in self.found]) if self.found else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, sizes), pa.int64()), pa.array(best, pa.int64()),
             pa.array([max(-_LONG, min(_LONG - 1, x)) for x in score], pa.int64()),
             pa.array([_beyond(x) for x in score], pa.string())],
            ["query_id", "vec_id", "score", "beyond"])


def _beyond(score: int) -> str | None:
    """Text that sorts as scores beyond a long do, None for others."""
    if -_LONG <= score < _LONG:
        return None
    text = f"{len(str(abs(score))):06d}{abs(score)}"
    return text if score > 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def _searched(queries, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = queries.value
        best = Best(ids, vectors, k)
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(at, CANDIDATES)
                rows, matrix = quantised(part.column("embedding"))
                own = part.column("vec_id").to_numpy(zero_copy_only=False)[rows]
                if len(rows):
                    best.add(own.astype(np.int64), matrix)
        yield best.rows()

    return search


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best other rows.

    ``vectors`` has ``vec_id`` and ``embedding``.  Query blocks are read by the
    driver one at a time and sent to all tasks; their size has a fixed bound.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull())
    asked = vectors.where(is_query & F.col("embedding").isNotNull()).distinct()
    size = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // (QUERY_COMPONENTS // 2)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    tables = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = block.orderBy("vec_id").toArrow().combine_chunks()
        column = rows.column("embedding")
        usable, matrix = quantised(column.combine_chunks() if column.num_chunks != 1
                                   else column.chunk(0))
        ids = rows.column("vec_id").to_numpy().astype(np.int64)[usable]
        sent = spark.sparkContext.broadcast((ids, matrix))
        best = vectors.mapInArrow(
            _searched(sent, k), "query_id long, vec_id long, score long, beyond string").withColumn(
            "rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")
        # a block is done before the next is sent
        tables.append(written(best, "top"))
        sent.destroy()
    # all blocks have one schema: one read of their folders
    return spark.read.schema(tables[0].schema).parquet(*[f for t in tables for f in t.inputFiles()]) \
        if len(tables) > 1 else tables[0]
