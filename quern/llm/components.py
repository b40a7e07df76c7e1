"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """From links (u, v): node and root, the least node it reaches; nodes without links don't occur.

    Each step groups by node with map-side minima and joins the minima back, so a node with very many links is split
    by the skew-join rule; each step is written to the shared folder, so lost executors cost one step at most.
    """
    now = materialize(_star(edges.where(F.col("u") != F.col("v")), large=True), "star")
    while True:
        small = materialize(_star(now, large=False), "star")
        release(now)
        now = materialize(_star(small, large=True), "star")
        same = _mark(small) == _mark(now)
        release(small)
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours on the least of them: the greater ones (large) or the lesser ones and the node itself (small)."""
    if large:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.distinct()
