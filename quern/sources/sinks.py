"""Sinks: parquet, shards, JSON lines and documents, CSV and vector upserts, content-addressed caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.grouping import last_wins, upsert
from quern.operators.storage import stable


def write_parquet(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def write_shards(df: DataFrame, path: str, rows: int = 1000, by: tuple[str, ...] = ()) -> None:
    """Files of at most `rows` rows; `by` become folders."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(*by).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(summary: DataFrame, records: DataFrame, path: str) -> None:
    """One line for the summary, then one for each record, as tagged JSON: no task gathers all records."""
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*df.columns).alias("value"))).alias("value"))
    line(summary, "summary").union(line(records, "record")).write.mode("overwrite").text(path)


#: How text is kept whole in CSV: quotes are doubled, line ends stay inside quotes, nulls differ from empty strings.
CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "\\N", "emptyValue": "", "multiLine": True, "lineSep": "\n"}


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV from which any string comes back as it was, but for carriage returns before line ends."""
    options = {k: v for k, v in CSV.items() if k != "multiLine"}
    df.write.mode("overwrite").options(**options, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What write_csv() wrote: strings, or columns of a schema."""
    reader = spark.read.options(**{k: v for k, v in CSV.items() if k != "lineSep"}, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return (reader.schema(schema) if schema else reader).csv(path)


def upsert_csv(new: DataFrame, path: str, key: str = "tasks") -> None:
    """Replaces rows of equal keys, appends the rest, ordered by key. The merge is written elsewhere before it replaces the old."""
    spark = new.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        new = upsert(spark.read.option("header", True).csv(path), new.select(*(F.col(c).cast("string") for c in new.columns)), key)
    stable(new).orderBy(key).write.mode("overwrite").option("header", True).csv(path)


def write_stats_csv(stats: DataFrame, path: str) -> None:
    """One row per timer or counter: a single small file."""
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def upsert_vectors(new: DataFrame, path: str, version: str) -> None:
    """A vector table keyed by (namespace, pid): the greatest version of each key stays."""
    spark = new.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        new = spark.read.parquet(path).unionByName(new, allowMissingColumns=True)
    stable(last_wins(new, ["namespace", "pid"], [version])).write.mode("overwrite").partitionBy("namespace").parquet(path)


def cached(spark, root: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table built with `settings`, from the folder named by their hash if it is there."""
    name = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_evaluation(predictions: DataFrame, gold: DataFrame, samples: DataFrame, summary: DataFrame, root: str) -> None:
    """An evaluator's files below `root`, each as JSON lines: predictions, gold, samples and summary."""
    for name, df in (("predictions", predictions), ("gold", gold), ("samples", samples), ("summary", summary)):
        write_jsonl(df, f"{root}/{name}")
