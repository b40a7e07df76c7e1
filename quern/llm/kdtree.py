"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt into shards of bounded size and queries into blocks; each (shard, block) cell builds a KD-tree of
its vectors - median splits of the widest dimension, a tight bounding box at each node - and walks it best first for
each query: the greatest inner product a box allows bounds all that lies in it, and a node whose bound is below the
kth score so far is left out with all that follows. The kth score starts from a pilot: at most PILOT vectors, picked
by a hash, which every query sees first; whatever it finds is a true lower bound, so the result stays exact.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, neither does a null id;
equal scores go to the smaller id; rows that share the query's id are its own and no candidates; other repeated rows
are candidates each; only vectors of the query's length are compared; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import partitions

TOP, SCALE, SHARD, BLOCK, LEAF, PILOT = 5, 256, 8192, 512, 256, 1024
_LEAST = -(1 << 62)


class KDTree:
    """Nodes in arrays: children, row ranges, and boxes."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(vectors))
        self.left, self.right, self.begin, self.end, low, high = [], [], [], [], [], []
        todo = [(0, len(vectors), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            node, own = len(self.left), vectors[order[a:b]]
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            for column, value in zip((self.left, self.right, self.begin, self.end, low, high), (-1, -1, a, b, own.min(axis=0), own.max(axis=0)), strict=True):
                column.append(value)
            if b - a > leaf and (high[-1] > low[-1]).any():
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(np.argmax(high[-1] - low[-1]))], middle)]
                todo += [(a + middle, b, node, True), (a, a + middle, node, False)]
        self.vectors, self.ids = vectors[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries by nodes: the greatest inner product that the node's box allows."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def top(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, kth: float) -> list[tuple[int, int]]:
        """(score, id) of the k best at or above `kth`, without id `own`."""
        heap, best = [(-bounds[0], 0)], []
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if self.left[node] < 0:
                a, b = self.begin[node], self.end[node]
                scores = self.vectors[a:b] @ query
                good = np.flatnonzero((scores >= kth) & (self.ids[a:b] != own))
                if len(good):
                    if len(good) > 4 * k:  # only those that can still be among the k best, ties included
                        good = good[scores[good] >= np.partition(scores[good], -k)[-k]]
                    best += zip((-scores[good]).tolist(), self.ids[a:b][good].tolist(), strict=True)
                    best = heapq.nsmallest(k, best)
                    if len(best) == k:
                        kth = max(kth, -best[-1][0])
            else:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
        return [(int(-s), i) for s, i in best]


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and q: floor(scale * x) of each component, as whole numbers."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("q"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    made = flat.reshape(-1, dim)
    # Whole numbers below 2^53 are exact as doubles, and doubles multiply faster.
    return made.astype(np.float64) if len(made) and dim * float(np.abs(made).max()) ** 2 < 2.0**53 else made


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each row where `is_query` holds, over vec_id."""
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vec_col, scale)
    asked = rows.where(is_query).distinct()
    n, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_asked // BLOCK))
    pilot = [(r[0], list(r[1])) for r in rows.orderBy(F.xxhash64("vec_id", F.lit("pilot")), "vec_id").limit(PILOT).collect()]
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(v) for _, v in pilot}:
        same = [(i, v) for i, v in pilot if len(v) == dim]
        by_dim[dim] = np.array([i for i, _ in same], np.int64), np.array([v for _, v in same], np.int64).reshape(len(same), dim)

    def first_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, q in zip(batch.column("vec_id").to_pylist(), batch.column("q").to_pylist(), strict=True):
                ids, made = by_dim.get(len(q), (np.zeros(0, np.int64), np.zeros((0, len(q)), np.int64)))
                scores = (made @ np.array(q, np.int64))[ids != i]
                found.append(int(np.partition(scores, -k)[-k]) if len(scores) >= k else _LEAST)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(found, pa.int64())], ["vec_id", "q", "kth"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "block")), strict=True))
            begin = 0
            for i in range(1, len(cells) + 1):
                if i == len(cells) or cells[i] != cells[begin]:
                    if cells[begin] != key:
                        yield from _cell(key, parts, k)
                        key, parts = cells[begin], []
                    parts.append(batch.slice(begin, i - begin))
                    begin = i
        yield from _cell(key, parts, k)

    base = rows.select("vec_id", "q", F.size("q").alias("dim"), F.lit(None).cast("long").alias("kth"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    ask = asked.mapInArrow(first_bound, "vec_id long, q array<bigint>, kth long")
    ask = ask.select("vec_id", "q", F.size("q").alias("dim"), "kth", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))
    cells = base.union(ask).repartition(max(1, min(partitions(spark), shards * blocks)), "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block")
    found = cells.mapInArrow(search, "query_id long, asked long, vec_id long, score long")
    best = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cell(key, parts: list[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of one shard for each query of one block."""
    import xxhash

    if key is None or not key[0]:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    asked = table.filter(pa.compute.is_valid(table["kth"]))
    base = table.filter(pa.compute.is_null(table["kth"]))
    if not asked.num_rows or not base.num_rows:
        return
    dim = key[0]
    both = _matrix(pa.concat_arrays([asked["q"].combine_chunks(), base["q"].combine_chunks()]), dim)
    queries, vectors = both[: asked.num_rows], both[asked.num_rows :]
    tree = KDTree(vectors, base["vec_id"].to_numpy())
    rows: list[list[int]] = [[], [], [], []]
    ids, kth = asked["vec_id"].to_pylist(), asked["kth"].to_pylist()
    for at in range(0, len(ids), 256):
        bounds = tree.bounds(queries[at : at + 256])
        for i in range(at, min(at + 256, len(ids))):
            mark = xxhash.xxh3_64_intdigest(queries[i].astype(np.int64).tobytes()) >> 1
            for score, vec in tree.top(queries[i], ids[i], bounds[i - at], k, kth[i]):
                for column, value in zip(rows, (ids[i], mark, vec, score), strict=True):
                    column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["query_id", "asked", "vec_id", "score"])


def oracle() -> str:
    return f"""
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {TOP}"""
