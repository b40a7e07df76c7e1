"""Retrieval: chunking, lexical, dense, sparse and late-interaction search, fusion and retrieval metrics.

Every top-k is a rank window with an explicit tie-break; row_number() <= k filters become WindowGroupLimit, so only k
rows a query and task are shuffled. Chunks are keyed by (doc_id, chunk_idx) in one long, which needs no global sort.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.arrays import windows
from quern.functions.text import tokens
from quern.operators import scan
from quern.operators.storage import stable

K1, B, EPSILON = 1.5, 0.75, 0.25
CHUNKS = scan.CHUNKS
#: Query postings that may go to every task: about 40 MB with their words.
POSTINGS = 500_000


def chunk_table(docs: DataFrame, size: int = 480, overlap: int = 80, cap: int | None = None) -> DataFrame:
    """pid, doc_id, chunk_idx and tok: overlapping windows of whole texts, or of the first `cap` tokens."""
    made = docs.select("doc_id", F.posexplode(windows(tokens(F.col("text")), size, overlap, cap)).alias("chunk_idx", "tok"))
    return made.select((F.col("doc_id") * CHUNKS + F.col("chunk_idx")).alias("pid"), "doc_id", "chunk_idx", "tok")


def top(df: DataFrame, k: int, by: str | list[str], *order: Column | str) -> DataFrame:
    """The first k rows of each group, with their rank."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def bm25(chunks: DataFrame | scan.Texts, queries: DataFrame, k: int = 30, k1: float = K1, b: float = B, epsilon: float = EPSILON, most: int = POSTINGS, lowered: bool = False) -> DataFrame:
    """item_id, pid, score, rank: BM25 of `queries` (item_id, tok) over `chunks` (pid, tok), lower-cased, or over those of texts.

    Chunk and term statistics cover the whole corpus, each term counted once a chunk in the task that reads it; a term in more than
    half of the chunks gets epsilon times the mean idf. Where the queries have at most `most` terms they go to every
    task: the pass that counts leaves each chunk's asked terms in the shared folder, and the next adds up their products
    and keeps the k best of each query, without the texts. Beyond that postings are joined. `lowered` says that tokens or
    texts are lower-cased already.
    """
    texts = isinstance(chunks, scan.Texts)
    spark = (chunks.docs if texts else chunks).sparkSession
    if not lowered:
        chunks = chunks._replace(docs=chunks.docs.withColumn("text", F.lower("text"))) if texts else chunks.select("pid", F.transform("tok", F.lower).alias("tok"))
    asked = queries.select("item_id", F.explode(F.transform("tok", F.lower)).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    found = asked.limit(most + 1).toPandas()
    if len(found) > most:
        counts = stable(scan.frequencies(chunks))
        stats = counts.where(F.col("term").isNull()).select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))  # one row
        idf = counts.where(F.col("term").isNotNull()).crossJoin(F.broadcast(stats)).select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        mean = idf.agg(F.avg("idf").alias("mean"))  # one row
        terms = asked.join(idf, "term").crossJoin(F.broadcast(mean)).withColumn("w", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")))
        terms = terms.select("item_id", "term", "avgdl", (F.col("w") * F.col("qtf")).alias("w"))
        rows = chunk_table(*chunks) if texts else chunks
        postings = rows.select("pid", F.size("tok").alias("dl"), F.explode("tok").alias("term")).groupBy("term", "pid").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
        hit = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        scored = terms.join(postings, "term").groupBy("item_id", "pid").agg(F.round(F.sum(hit), 6).alias("score"))
        return top(scored, k, "item_id", F.desc("score"), "pid")
    vocabulary = pa.array(sorted(set(found["term"])), pa.string())
    index = stable(scan.index(chunks, vocabulary))
    n, avgdl = index.where("share IS NULL").agg(F.count(F.lit(1)), F.avg("size")).first()
    counts = scan.chunk_counts(index, vocabulary).toPandas()  # a row for each asked term, and one for each df that any term has
    rarity, known = np.log((n - counts["df"] + 0.5) / (counts["df"] + 0.5)), counts["term"].notna()
    if not known.any():
        return spark.createDataFrame([], "item_id long, pid long, score double, rank long")
    mean = np.average(rarity[~known], weights=counts["n"][~known])
    idf = dict(zip(counts["term"][known], np.where(rarity < 0, epsilon * mean, rarity)[known], strict=True))
    items, slot = np.unique(found["item_id"].to_numpy(), return_inverse=True)
    # A term that no chunk has weighs nothing, as nothing asks for its weight.
    weights = np.array([idf.get(x, 0.0) for x in found["term"]]) * found["qtf"].to_numpy()

    def hits(row: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / avgdl))

    held = scan.search(index, scan.postings(slot, found["term"].tolist(), weights, len(items)), k, hits)
    names = spark.createDataFrame(pa.table({"slot": np.arange(len(items)), "item_id": items}))  # one row a query
    return scan.best(held, k).join(F.broadcast(names), "slot").select("item_id", "pid", "score", "rank")


def dense_top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, vec_id, score, rank by inner product, without the query itself."""
    from quern.operators.vector_index import top_k

    return top_k(vectors, is_query, k)


def sparse_scores(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, pid, score: dot products of sparse vectors (key, term, weight), joined on the term."""
    return queries.join(passages.withColumnRenamed("weight", "pw"), "term").groupBy("item_id", "pid").agg(F.round(F.sum(F.col("weight") * F.col("pw")), 6).alias("score"))


def min_max(scores: DataFrame, n_passages: int | Column, by: str = "item_id") -> DataFrame:
    """Scores to 0 .. 1 per query over all passages: those that are absent count as 0."""
    n = F.lit(n_passages) if isinstance(n_passages, int) else n_passages
    g = scores.groupBy(by).agg(F.max("score").alias("_hi"), F.min("score").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    lo = F.when(F.col("_n") < n, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo"))
    hi = F.when(F.col("_n") < n, F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi"))
    joined = scores.join(g, by)
    return joined.withColumn("norm", F.when(hi <= lo, 0.0).otherwise((F.col("score") - lo) / (hi - lo))).drop("_hi", "_lo", "_n")


def rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, key, score: sum of 1 / (k + rank) over result lists (query_id, list_no, key, rank from 1)."""
    return lists.groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def candidate_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """query_id, key, pos: the first list's order, then what only the second has."""
    both = first.select("query_id", "key", F.lit(0).alias("l"), "rank").union(second.select("query_id", "key", F.lit(1).alias("l"), "rank"))
    least = both.groupBy("query_id", "key").agg(F.min(F.struct("l", "rank")).alias("p"))
    return least.select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy("p", "key")).cast("long").alias("pos"))


def retrieval_metrics(hits: DataFrame, ks: tuple[int, ...], all_queries: DataFrame, key: str = "item_id") -> DataFrame:
    """k, recall, mrr over all queries from (key, rank, rel): a query without a relevant hit counts 0."""
    first = hits.where("rel").groupBy(key).agg(F.min("rank").alias("first"))
    every = all_queries.select(key).join(first, key, "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    inside = F.col("first") <= F.col("k")
    return every.groupBy("k").agg(
        F.round(F.avg(F.when(inside, 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.when(inside, 1.0 / F.col("first")).otherwise(0.0)), 6).alias("mrr"), F.count(F.lit(1)).alias("n")
    )


def rerank(pairs: DataFrame, scorer: Callable[[Column, Column], Column], k: int, by: str = "item_id") -> DataFrame:
    """Candidates (query id, pid, first_rank, query, passage) scored by any Column function of query and passage, the k best of each query.

    A model goes in as a pandas UDF. Only candidates are scored; ties keep the first stage's order.
    """
    return top(pairs.withColumn("score", F.round(scorer(F.col("query"), F.col("passage")), 6)), k, by, F.desc("score"), "first_rank")
