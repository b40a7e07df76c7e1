"""Top-k search of sparse vectors through an inverted index in blocks, which reads a small part of the postings.

The index is two tables in the shared folder, both in ranges of terms, so that a read by term skips other files:
lists (term, block, most, pids, weights), where a block is a range of passage numbers and `most` its greatest weight,
and terms (term, df, most). A search bounds scores from above and reads only what can matter:

1. Pilot: of each query the lists with the greatest bounds, up to a twentieth of its postings. The passages that come
   out best are scored exactly, and the k-th of them is a lower bound of the query's k-th score.
2. Essential lists: those lists whose bounds together stay below it cannot bring a passage in by themselves; only the
   others are read. A passage whose sum so far and the bounds of the rest stay below is out.
3. Blocks: for the others the rest's bounds are those of the passage's own block.
4. Look-up: exact scores of what is left, from the blocks it lies in.

All weights are positive. Ties beyond the rounding of scores are settled by passage, as a full join would.

Defined cases: a query term that no passage has adds nothing; queries and passages without terms have no rows; rows of
one (key, term) are summed by the caller beforehand; empty tables give no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.storage import stable

#: Bits of a passage number below its block's, and the share of a query's postings that the pilot reads.
BITS, PILOT = 26, 0.05
#: Scores are rounded to six digits; bounds are compared with more slack than that and the sums' own error.
SLACK = 1e-5


class SparseIndex(NamedTuple):
    lists: DataFrame
    terms: DataFrame
    n_passages: int
    #: The passages with the fewest terms, of which one without any of a query's terms is sought first.
    small: DataFrame


def _block(pid: Column, bits: int) -> Column:
    return F.shiftright(pid, bits)


def build(vectors: DataFrame, passages: DataFrame, bits: int = BITS) -> SparseIndex:
    """The index of vectors (pid, term, weight), weights above 0; `passages` (pid) are all passages, those without terms too."""
    flat = vectors.where(F.col("weight") > 0).select("pid", "term", "weight", _block(F.col("pid"), bits).alias("block"))
    posting = F.sort_array(F.collect_list(F.struct("pid", "weight")))  # as many as a block has passages
    lists = flat.groupBy("term", "block").agg(F.max("weight").alias("most"), posting.alias("p"))
    lists = stable(lists.select("term", "block", "most", F.col("p.pid").alias("pids"), F.col("p.weight").alias("weights")).repartitionByRange("term", "block").sortWithinPartitions("term", "block"))
    terms = stable(lists.groupBy("term").agg(F.sum(F.size("pids")).alias("df"), F.max("most").alias("most")))
    sizes = lists.select(F.explode("pids").alias("pid")).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    least = stable(passages.select("pid").join(sizes, "pid", "left").orderBy(F.coalesce("n", F.lit(0)), "pid").limit(64).select("pid", _block(F.col("pid"), bits).alias("block")))
    return SparseIndex(lists, terms, passages.count(), least)


def _asked(index: SparseIndex, queries: DataFrame) -> DataFrame:
    """query, term, w, df, bound: what a list can add to a score at most."""
    q = queries.where(F.col("weight") > 0).select("query", "term", F.col("weight").alias("w"))
    return stable(q.join(index.terms, "term").select("query", "term", "w", "df", (F.col("w") * F.col("most")).alias("bound")))


def _read(index: SparseIndex, asked: DataFrame) -> DataFrame:
    """query, pid, part, n: sums over the lists of `asked` alone; each list is read once, whatever the number of queries."""
    lists = index.lists.join(asked.select("term").distinct(), "term", "left_semi")
    postings = lists.select("term", F.explode(F.arrays_zip("pids", "weights")).alias("p")).select("term", "p.pids", "p.weights").toDF("term", "pid", "weight")
    return postings.join(asked.select("query", "term", "w"), "term").groupBy("query", "pid").agg(F.sum(F.col("w") * F.col("weight")).alias("part"))


def lookup(index: SparseIndex, asked: DataFrame, pairs: DataFrame, bits: int = BITS) -> DataFrame:
    """query, pid, score, rounded, of the pairs (query, pid) that share a term; blocks are asked for once a query and term."""
    near = pairs.select("query", "pid", _block(F.col("pid"), bits).alias("block"))
    wanted = near.groupBy("query", "block").agg(F.collect_set("pid").alias("wanted"))  # within a block
    asked_blocks = wanted.join(asked.select("query", "term", "w"), "query")
    met = asked_blocks.join(index.lists, ["term", "block"]).where(F.arrays_overlap("wanted", "pids"))
    postings = met.select("query", "w", "wanted", F.explode(F.arrays_zip("pids", "weights")).alias("p")).where(F.array_contains("wanted", F.col("p.pids")))
    return postings.groupBy("query", F.col("p.pids").alias("pid")).agg(F.round(F.sum(F.col("w") * F.col("p.weights")), 6).alias("score"))


def _top(df: DataFrame, k: int, order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def search(index: SparseIndex, queries: DataFrame, k: int, bits: int = BITS, pilot: float = PILOT) -> DataFrame:
    """query, pid, score, rank: the k passages with the highest dot products of each query (query, term, weight)."""
    return _search(index, _asked(index, queries), k, bits, pilot)[0]


def _search(index: SparseIndex, asked: DataFrame, k: int, bits: int = BITS, pilot: float = PILOT) -> tuple[DataFrame, dict[str, DataFrame]]:
    # What a query has read before a list, greatest bounds first; a query's terms are one small group.
    down = Window.partitionBy("query").orderBy(F.desc("bound"), "term").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("query")
    first = asked.withColumn("before", F.coalesce(F.sum("df").over(down), F.lit(0))).withColumn("all", F.sum("df").over(whole)).where(F.col("before") <= F.col("all") * pilot)
    first = stable(first.select("query", "term", "w"))
    best = stable(_top(_read(index, first), 2 * k, [F.desc("part"), "pid"]).select("query", "pid"))
    kth = _top(lookup(index, asked, best, bits), k, [F.desc("score")]).where(F.col("rank") == k).select("query", (F.col("score") - SLACK).alias("least"))

    up = Window.partitionBy("query").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = asked.join(kth, "query", "left").withColumn("least", F.coalesce("least", F.lit(-1.0))).withColumn("upto", F.sum("bound").over(up))
    ranked = stable(ranked.withColumn("essential", F.col("upto") >= F.col("least")))
    rest = ranked.groupBy("query").agg(F.first("least").alias("least"), F.sum(F.when(~F.col("essential"), F.col("bound")).otherwise(0.0)).alias("rest"))
    part = _read(index, ranked.where("essential")).join(rest, "query").where(F.col("part") + F.col("rest") >= F.col("least"))
    part = stable(part.select("query", "pid", "part", "least", _block(F.col("pid"), bits).alias("block")))

    # Bounds by block: the maxima of the lists that weren't read, in blocks where something is left.
    blocks = part.select("query", "block").distinct().join(ranked.where(~F.col("essential")).select("query", "term", "w"), "query")
    bounds = blocks.join(index.lists.select("term", "block", "most"), ["term", "block"]).groupBy("query", "block").agg(F.sum(F.col("w") * F.col("most")).alias("more"))
    left = part.join(bounds, ["query", "block"], "left").where(F.col("part") + F.coalesce("more", F.lit(0.0)) >= F.col("least"))
    left = stable(left.select("query", "pid"))
    found = _top(lookup(index, asked, left, bits), k, [F.desc("score"), "pid"])
    return found.select("query", "pid", "score", "rank"), {"first": first, "ranked": ranked, "left": left}


def reading(index: SparseIndex, queries: DataFrame, k: int, bits: int = BITS, pilot: float = PILOT) -> DataFrame:
    """One row: postings of all lists that the queries ask for (once for each query), those read whole, and pairs looked up."""
    asked = _asked(index, queries)
    _, steps = _search(index, asked, k, bits, pilot)
    df = asked.select("query", "term", "df")
    read = steps["first"].select("query", "term").union(steps["ranked"].where("essential").select("query", "term")).distinct().join(df, ["query", "term"])
    return df.agg(F.sum("df").alias("postings")).crossJoin(read.agg(F.sum("df").alias("read_whole"))).crossJoin(steps["left"].agg(F.count(F.lit(1)).alias("looked_up")))


def ends(index: SparseIndex, asked: DataFrame, bits: int = BITS) -> DataFrame:
    """query, lo, hi: least and greatest score over all passages, where passages that share no term count as 0.

    hi is the best hit. lo is 0 as soon as one passage shares no term: first one is sought among the passages with the
    fewest terms; only queries for which none is found there have all their lists read.
    """
    hi = _search(index, asked, 1, bits)[0].select("query", F.col("score").alias("hi"))
    every = asked.select("query").distinct()
    pairs = stable(every.crossJoin(F.broadcast(index.small)).select("query", "pid"))  # 64 passages at most
    shared = lookup(index, asked, pairs, bits).groupBy("query").agg(F.count(F.lit(1)).alias("shared"))
    few = index.small.count()
    unsure = stable(every.join(shared, "query", "left").where((F.coalesce("shared", F.lit(0)) >= few) & (F.lit(few) < index.n_passages) | (F.lit(few) >= index.n_passages)).select("query"))
    whole = _read(index, asked.join(unsure, "query", "left_semi")).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min(F.round("part", 6)).alias("least"))
    lo = whole.where(F.col("n") >= index.n_passages).select("query", F.col("least").alias("lo"))
    return hi.join(lo, "query", "left").select("query", F.coalesce("lo", F.lit(0.0)).alias("lo"), "hi")


def scaled(score: Column, lo: Column, hi: Column) -> Column:
    """Scores to 0 .. 1 between the ends; all-equal scores become 0."""
    return F.when(hi <= lo, 0.0).otherwise((score - lo) / (hi - lo))


def normalised(index: SparseIndex, queries: DataFrame, k: int, bits: int = BITS) -> DataFrame:
    """query, pid, score, norm, rank of the k best, scaled over all passages."""
    asked = _asked(index, queries)
    found = stable(_search(index, asked, k, bits)[0])
    return found.join(ends(index, asked, bits), "query").select("query", "pid", "score", scaled(F.col("score"), F.col("lo"), F.col("hi")).alias("norm"), "rank")


def fused(index: SparseIndex, base: DataFrame, bridges: DataFrame, k: int, weight: float = 0.7, first: int = 64, bits: int = BITS) -> DataFrame:
    """query, pid, score, rank: base norm plus `weight` times the greatest norm of a query's bridges, the k best.

    `base` are queries; `bridges` have a seed beside (query, seed, term, weight). The best of every list are scored
    exactly in all lists. What is in none of them is bounded by the lists' last scores; where that could still reach
    the k-th, the query is asked again for more of each list.
    """
    base_asked = _asked(index, base)
    bridge_asked = _asked(index, bridges.select(F.struct("query", "seed").alias("query"), "term", "weight"))
    base_ends, bridge_ends = stable(ends(index, base_asked, bits)), stable(ends(index, bridge_asked, bits))
    out, open_, most = None, stable(base_asked.select("query").union(bridge_asked.select("query.query")).distinct()), first
    while True:
        mine = base_asked.join(open_, "query", "left_semi")
        theirs = bridge_asked.join(open_.select(F.col("query").alias("q")), F.col("query.query") == F.col("q"), "left_semi")
        lists = stable(_search(index, mine, most, bits)[0])
        more = stable(_search(index, theirs, most, bits)[0])
        pairs = stable(lists.select("query", "pid").union(more.select("query.query", "pid")).distinct())
        norm = lookup(index, mine, pairs, bits).join(base_ends, "query").select("query", "pid", scaled(F.col("score"), F.col("lo"), F.col("hi")).alias("norm"))
        seeds = theirs.select("query").distinct()
        seed_pairs = pairs.join(seeds.select(F.col("query.query").alias("query"), F.col("query").alias("s")), "query").select(F.col("s").alias("query"), "pid")
        bridge = lookup(index, theirs, seed_pairs, bits).join(bridge_ends, "query").select(F.col("query.query").alias("query"), "pid", scaled(F.col("score"), F.col("lo"), F.col("hi")).alias("b"))
        bridge = bridge.groupBy("query", "pid").agg(F.max("b").alias("bridge"))
        scored = pairs.join(norm, ["query", "pid"], "left").join(bridge, ["query", "pid"], "left")
        scored = stable(_top(scored.select("query", "pid", F.round(F.coalesce("norm", F.lit(0.0)) + weight * F.coalesce("bridge", F.lit(0.0)), 9).alias("score")), k, [F.desc("score"), "pid"]))
        # A list shorter than asked for is whole: nothing is beyond it.
        last = lists.where(F.col("rank") == most).join(base_ends, "query").select("query", scaled(F.col("score"), F.col("lo"), F.col("hi")).alias("a"))
        last_b = more.where(F.col("rank") == most).join(bridge_ends, "query").select(F.col("query.query").alias("query"), scaled(F.col("score"), F.col("lo"), F.col("hi")).alias("b")).groupBy("query").agg(F.max("b").alias("b"))
        beyond = open_.join(last, "query", "left").join(last_b, "query", "left").where(F.col("a").isNotNull() | F.col("b").isNotNull())
        beyond = beyond.select("query", (F.coalesce("a", F.lit(0.0)) + weight * F.coalesce("b", F.lit(0.0)) + SLACK).alias("beyond"))
        kth = scored.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
        again = stable(beyond.join(kth, "query", "left").where(F.col("kth").isNull() | (F.col("beyond") >= F.col("kth"))).select("query"))
        done = scored.join(again, "query", "left_anti")
        out = done if out is None else out.union(done)
        if again.isEmpty():
            return out
        open_, most = again, most * 4
