"""Summaries of runs: statistics, length bins, pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Overlapping token-length bins, both ends included; the last has no upper end.
LENGTH_BINS = (
    (0, 127),
    (128, 255),
    (256, 511),
    (0, 511),
    (512, 1023),
    (1024, 2047),
    (2048, 4095),
    (4096, 8191),
    (0, 8191),
    (8192, 16383),
    (16384, 32767),
    (32768, 2**62),
)


def nine_stats(df: DataFrame, value: str, order: list[str] | None, *by: Column) -> DataFrame:
    """count, total, mean, median, min, max, p95, last (with an order) and the sample deviation, 0 for a single value.

    Places of sorted values are exact for groups of any size, also a null one: values are counted first, map-side, and
    dealt by group and value into ranges; a range's running counts and the sizes of the ranges before it say where each
    value stands. So no group is gathered, and the whole table may be one group.
    """
    from quern.operators.storage import stable

    keys = [c.alias(f"_k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_k0")]
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select(*keys, value, *(order or []))
    last = [F.max_by(value, F.struct(*order)).alias("last")] if order else []
    stats = keyed.groupBy(*names).agg(
        F.count(F.lit(1)).alias("count"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *last,
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"),
    )
    counted = keyed.where(F.col(value).isNotNull()).groupBy(*names, value).agg(F.count(F.lit(1)).alias("_c"))
    ranges = stable(counted.repartitionByRange(*names, value).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*names)
    sizes = ranges.groupBy("_part", *names).agg(F.sum("_c").alias("_size"))  # a row for each group and range it is in
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_size").over(group))
    inside = Window.partitionBy("_part", *names).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    same = lambda a, b, cs: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in cs))
    placed = ranges.withColumn("_end", F.sum("_c").over(inside))
    placed = placed.join(sizes, same(placed, sizes, ["_part", *names])).select(*(placed[c] for c in names), value, "_n", (F.col("_end") + F.col("_before")).alias("_end"), "_c")
    at = lambda place: F.max(F.when((F.col("_end") > place) & (F.col("_end") - F.col("_c") <= place), F.col(value)))
    n = F.col("_n")
    places = placed.groupBy(*names).agg(at(F.floor(0.95 * (n - 1))).alias("p95"), F.round((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, 6).alias("median"))
    out = stats.join(places, same(stats, places, names), "left")
    labels = [stats[c].alias(n) for c, n in zip(names, df.select(*by).columns, strict=True)] if by else []
    return out.select(*labels, "count", "total", "mean", "median", "min", "max", "p95", *(["last"] if order else []), "std")


def by_length_bin(df: DataFrame, length: str, *metrics: Column) -> DataFrame:
    """Metrics per bin and overall; a row counts in every bin it falls in, found by expression, without a join."""
    inside = F.filter(F.array(*(F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in LENGTH_BINS)), lambda b: (F.col(length) >= b["lo"]) & (F.col(length) <= b["hi"]))
    bins = F.concat(F.transform(inside, lambda b: F.concat_ws("-", b["lo"].cast("string"), b["hi"].cast("string"))), F.array(F.lit("overall")))
    return df.withColumn("bin", F.explode(bins)).groupBy("bin").agg(*metrics)


def pivot_metrics(long: DataFrame, metrics: list[str]) -> DataFrame:
    """From (key, v) to task, group_len and a text column per metric ('N/A' where absent), with `pos`, the report's order."""
    from quern.operators.grouping import numbered

    pattern = f"^(.+?)_({'|'.join(metrics)})(?:_len_([0-9]+)-([0-9]+))?$"
    part = lambda k: F.regexp_extract("key", pattern, k)
    rows = long.select(part(1).alias("task"), part(2).alias("metric"), F.when(part(3) != "", F.concat(part(3), F.lit("-"), part(4))).otherwise("overall").alias("group_len"), "v")
    wide = rows.groupBy("task", "group_len").pivot("metric", metrics).agg(F.max("v"))
    text = [F.coalesce(F.round(m, 4).cast("string"), F.lit("N/A")).alias(m) for m in metrics]
    keyed = wide.select("task", "group_len", *text, (F.col("group_len") == "overall").cast("int").alias("_last"), F.when(F.col("group_len") != "overall", F.element_at(F.split("group_len", "-"), 1).cast("long")).otherwise(0).alias("_lo"))
    return numbered(keyed, ["task", "_last", "_lo"], "pos").drop("_last", "_lo")
