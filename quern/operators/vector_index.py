"""Exact top-k by inner product over a coarse partition of vectors: cells with a centre and a radius.

Centres are fitted by some rounds of k-means on a bounded sample in hash order; every vector is dealt to its nearest
centre, and a cell's radius is the distance of its farthest vector. No vector of a cell has an inner product with q
above q . centre + |q| radius. A search asks the cell whose centre suits the query best first, which gives a k-th
score, and then only cells whose bound reaches it. Vectors are written once by cell; what is sent for a search are the
queries, once for each cell they visit, so nothing grows with the square of the table.

Large cells are cut into parts by a hash, and a task takes a query's rows as they come against one part's vectors: it
holds that part and the batch.

Defined cases: null vectors take no part; equal scores (at six digits) go to the smaller vec_id; a query does not find
itself; with fewer than k vectors all are returned; an empty table gives no rows. All vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.storage import stable

#: Vectors of a cell aimed at, cells and sampled vectors at most, rounds of fitting, and vectors of a part.
PER_CELL, CELLS, SAMPLE, ROUNDS, PART = 256, 256, 8192, 8, 16_384
#: Scores are rounded to six digits; bounds are compared with more slack than that.
SLACK = 2e-6
ROWS = "cell int, part int, q boolean, id long, embedding array<double>"


class VectorIndex(NamedTuple):
    rows: DataFrame  #: cell, part, q (false), id, embedding
    centres: np.ndarray
    radius: np.ndarray
    parts: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of k-means from the sample's first vectors; a centre that loses all its vectors stays where it is."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def build(vectors: DataFrame, cells: int | None = None) -> VectorIndex | None:
    """The index of vectors (vec_id, embedding); None of an empty table."""
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    if not n:
        return None
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    centres = fit(np.stack(sample["embedding"]), min(cells or max(1, n // PER_CELL), CELLS, len(sample)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            if len(x):
                nearest = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
                far = np.sqrt(((x - centres[nearest]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(far), batch.column("id"), batch.column("embedding")], ["cell", "far", "id", "embedding"])

    placed = stable(rows.mapInArrow(dealt, "cell int, far double, id long, embedding array<double>"))
    found = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row a cell
    size, radius = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
    for r in found:
        size[r["cell"]], radius[r["cell"]] = r["n"], r["far"] * (1 + 1e-12) + 1e-12
    parts = np.maximum(1, -(-size // PART))
    of_cell = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("cell") + 1)
    base = placed.select("cell", F.pmod(F.xxhash64("id"), of_cell).cast("int").alias("part"), F.lit(False).alias("q"), "id", "embedding")
    return VectorIndex(base, centres, radius, parts)


def _bounds(index: VectorIndex, q: np.ndarray) -> np.ndarray:
    return q @ index.centres.T + np.sqrt((q**2).sum(1))[:, None] * index.radius


def _routed(centres: np.ndarray, radius: np.ndarray, parts: np.ndarray, first: bool):
    """Queries by the cells they visit: the one that suits best, or the others whose bound reaches `least`."""
    index = VectorIndex(None, centres, radius, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("embedding"))
            if not len(q):
                continue
            best = np.argmax(np.where(np.isfinite(radius), q @ centres.T, -np.inf), axis=1)
            if first:
                row, cell = np.arange(len(q)), best
            else:
                reach = _bounds(index, q) >= batch.column("least").to_numpy(zero_copy_only=False)[:, None]
                reach[np.arange(len(q)), best] = False
                row, cell = np.nonzero(reach & np.isfinite(radius))
            n = parts[cell]
            row, cell, part = np.repeat(row, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            some = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array([True] * len(row), pa.bool_()), some.column("id"), some.column("embedding")], ["cell", "part", "q", "id", "embedding"])

    return run


def _matched(k: int):
    """Of sorted rows, each part's vectors before its queries: the k best of the part for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, np.zeros(0, np.int64), []
        for batch in batches:
            cell, part, is_q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "q"))
            change = np.concatenate([[True], (np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(is_q.astype(np.int8)) != 0), [True]])
            edges = np.flatnonzero(change)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key, some = (cell[a], part[a]), batch.slice(a, b - a)
                if key != now:
                    now, held, ids = key, [], []
                if not is_q[a]:
                    held.append(_matrix(some.column("embedding")))
                    ids.append(some.column("id").to_numpy())
                elif held:
                    own, x = np.concatenate(ids), np.concatenate(held)
                    ids, held = [own], [x]
                    for at in range(0, len(some), 256):
                        asked = some.slice(at, 256)
                        name = asked.column("id").to_numpy()
                        scores = np.round(_matrix(asked.column("embedding")) @ x.T, 6) + 0.0
                        scores[name[:, None] == own[None, :]] = -np.inf
                        order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
                        best = np.take_along_axis(scores, order, axis=1)
                        good = np.isfinite(best)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, good.sum(axis=1))), pa.array(own[order][good]), pa.array(best[good])], ["query_id", "vec_id", "score"])

    return run


def _match(index: VectorIndex, routed: DataFrame, k: int) -> DataFrame:
    met = index.rows.union(routed).repartition("cell", "part").sortWithinPartitions("cell", "part", "q")
    return met.mapInArrow(_matched(k), "query_id long, vec_id long, score double")


def search(index: VectorIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """query_id, vec_id, score, rank of the k best for each query (id, embedding); and the visits of the second round (cell, id)."""
    from quern.operators.retrieval import top

    shape = (index.centres, index.radius, index.parts)
    order = [F.desc("score"), F.col("vec_id")]
    begun = stable(top(_match(index, queries.mapInArrow(_routed(*shape, True), ROWS), k), k, "query_id", *order))
    kth = begun.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (F.col("score") - SLACK).alias("least"))
    asked = queries.join(kth, "id", "left").select("id", "embedding", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    routed = stable(asked.mapInArrow(_routed(*shape, False), ROWS))
    both = begun.drop("rank").union(_match(index, routed, k))
    return top(both, k, "query_id", *order), routed.select("cell", "id").distinct()


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, vec_id, score, rank among all other vectors for those that `is_query` marks."""
    index = build(vectors)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank long")
    asked = vectors.where(F.col("embedding").isNotNull() & is_query).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return search(index, asked, k)[0]


def visited(vectors: DataFrame, is_query: Column, k: int, cells: int | None = None) -> float:
    """The share of all pairs of query and cell, by the cells' vectors, that a search reads."""
    index = build(vectors, cells)
    asked = vectors.where(F.col("embedding").isNotNull() & is_query).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    second = search(index, asked, k)[1]
    sizes = index.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    first = asked.mapInArrow(_routed(index.centres, index.radius, index.parts, True), ROWS).select("cell", "id").distinct()
    read = second.union(first).join(sizes, "cell").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return read / max(1, asked.count() * index.rows.count())
