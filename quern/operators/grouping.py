"""Group-bys that keep order, unions, samples and splits. Randomness is a hash of the key, so every engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import hash_order


def compact(qa: DataFrame, by: list[str], order: list[str], gold: str | None = None) -> DataFrame:
    """One row per context with its prompts and responses in order; with `gold`, its last value by order."""
    item = F.struct(*order, "prompt", "response")
    last = [F.max_by(gold, F.struct(*order)).alias("gold_context")] if gold else []
    g = qa.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("l"), *last)
    return g.select(*by, F.col("l.prompt").alias("prompts"), F.col("l.response").alias("responses"), *(["gold_context"] if gold else []))


def numbered(df: DataFrame, by: list[Column | str], name: str = "rn", within: list[str] | None = None) -> DataFrame:
    """Row numbers from 1 in the given order. Without `within` the numbers are global: two passes of range partitions.

    Rows are range-partitioned by the order, sizes per partition are summed (one row each) and added to the numbers
    inside: no task holds more than its range.
    """
    if within:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)).cast("long"))
    from quern.operators.storage import stable

    parts = stable(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return parts.join(F.broadcast(before), "_part").withColumn(name, (inside + F.col("_before")).cast("long")).drop("_part", "_before")


def hash_numbered(df: DataFrame, key: str, salt: str, name: str = "rn") -> DataFrame:
    """Row numbers in a reproducible random order."""
    return numbered(df.withColumn("_h", hash_order(F.col(key), salt)), ["_h", key], name).drop("_h")


def sample_fraction(df: DataFrame, key: str, fraction: float, salt: str) -> DataFrame:
    """max(1, floor(n * fraction)) rows without replacement."""
    n = df.count()
    return hash_numbered(df, key, salt).where(F.col("rn") <= max(1, int(n * fraction))).drop("rn")


def split_ratio(df: DataFrame, key: str, ratio: float, salt: str) -> DataFrame:
    """Adds `part`: train for the first floor(n * ratio) rows of a random order, else test."""
    n = df.count()
    return hash_numbered(df, key, salt).withColumn("part", F.when(F.col("rn") <= int(n * ratio), "train").otherwise("test")).drop("rn")


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group; the rest of the row rides along in one map-side minimum."""
    others = [c for c in df.columns if c not in by]
    g = df.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return g.select(*by, "_r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not in `new`, then all of `new`; missing columns are null."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    others = [c for c in df.columns if c not in by]
    g = df.groupBy(*by).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return g.select(*by, "_r.*")


def split_three(df: DataFrame, key: str, train: float, validation: float, salt: str) -> DataFrame:
    """Adds `part` after a random order: rounded shares for train and validation, clamped to what is there, the rest test."""
    rows = hash_numbered(df, key, salt)
    total = rows.agg(F.count(F.lit(1)).alias("_n"))  # one row
    n_train = F.least(F.rint(F.col("_n") * train), F.col("_n"))
    n_val = F.least(F.rint(F.col("_n") * validation), F.greatest(F.lit(0.0), F.col("_n") - n_train))
    part = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "validation").otherwise("test")
    return rows.crossJoin(F.broadcast(total)).withColumn("part", part).drop("rn", "_n")
