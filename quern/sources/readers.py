"""Readers: by extension, by glob, by registry name and row range, needles, retrieval records."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT = "context string, prompts array<string>, responses array<string>"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet unless the path ends in .json, .jsonl or .csv; globs are the reader's own; a path without files raises."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith((".json", ".jsonl")):
        return reader.json(path)
    return reader.option("header", True).csv(path) if path.endswith(".csv") else reader.parquet(path)


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON lines; one that was never written has no rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def parse_slice(split: str) -> tuple[str, int, int | None]:
    """`train[100:600]` to (train, 100, 600); either bound may be absent."""
    m = re.fullmatch(r"(\w+)(?:\[(\d*):(\d*)\])?", split)
    if not m:
        raise ValueError(f"not a split: {split}")
    return m[1], int(m[2] or 0), int(m[3]) if m[3] else None


@dataclass
class Registry:
    """Logical data set names: name -> split -> (path, row range)."""

    entries: dict[str, dict[str, tuple[str, str]]] = field(default_factory=dict)

    def add(self, name: str, split: str, path: str, rows: str = "") -> None:
        self.entries.setdefault(name, {})[split] = (path, rows)

    def add_generated(self, names: list[str], bins: list[tuple[int, int]], template: str) -> None:
        """One entry per name and token-length bin, with train, validation and test files."""
        for name in names:
            for lo, hi in bins:
                for split in ("train", "validation", "test"):
                    self.add(f"{name}_{lo}_{hi}", split, template.format(name=name, lo=lo, hi=hi, split=split))

    def read(self, spark: SparkSession, name: str, split: str, order: str) -> DataFrame:
        from quern.operators.grouping import numbered

        path, rows = self.entries[name][split]
        df = read_any(spark, path)
        if not rows:
            return df
        _, a, b = parse_slice(f"{split}{rows}")
        kept = numbered(df, [order], "_rn").where(F.col("_rn") > a)
        return (kept if b is None else kept.where(F.col("_rn") <= b)).drop("_rn")


def shard_glob(root: str, org: str, model: str, name: str, split: str) -> str:
    return f"{root}/self_gen/{org}/{model}/{name}/{split}/*.parquet"


def route_by_path(df: DataFrame) -> DataFrame:
    """Adds `split` from the file's path: train if it says so, else test if that."""
    path = F.lower(F.col("_metadata.file_path"))
    return df.withColumn("split", F.when(path.contains("train"), "train").when(path.contains("test"), "test"))


def read_needles(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of needles, bare or under `data`."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("data").alias("n")).select("n.*") if "data" in df.columns else df


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval records: a JSON array, bare or under `records`."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("records").alias("r")).select("r.*") if "records" in df.columns else df


def layout_of(df: DataFrame) -> str:
    return "compact" if {"context", "prompts", "responses"} <= set(df.columns) else "raw"


def gold_column(df: DataFrame) -> str:
    return next(c for c in ("gold_context", "needle_text", "context") if c in df.columns)


def as_text(df: DataFrame, name: str, joiner: str = "\n") -> Column:
    """A column that may be a string or a list of strings, as a string."""
    return F.array_join(name, joiner) if df.schema[name].dataType.typeName() == "array" else F.col(name)


def first_of(df: DataFrame, name: str) -> Column:
    return F.try_element_at(name, F.lit(1)) if df.schema[name].dataType.typeName() == "array" else F.col(name)
