"""A vector table by key, in buckets of its keys' hashes, with a manifest for each version.

An upsert reads and rewrites only the buckets that its rows fall into, in a folder of its own, and then publishes a
manifest that names every bucket's folder. Folders are never changed once written: a reader that has read a manifest
sees one version, whatever happens meanwhile, and an upsert that fails leaves the table as it was. Two upserts at once
can't both publish the same version: the second one fails.

Defined cases: of rows with one key the greatest version stays, among the new rows and against the old; a null key is a
key; missing columns become null; an upsert without rows publishes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.grouping import last_wins
from quern.operators.storage import stable

BUCKETS = 64


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest: version, buckets, keys and, by bucket, its folder."""
    path, fs = _files(spark, root)
    if not fs.exists(path(root)):
        return None
    names = [str(f.getPath()) for f in fs.listStatus(path(root)) if f.getPath().getName().startswith("manifest-")]
    return json.loads(spark.read.text(max(names), wholetext=True).first()[0]) if names else None


def _publish(spark: SparkSession, root: str, made: dict) -> None:
    path, fs = _files(spark, root)
    name, draft = f"manifest-{made['version']:012d}.json", f"{root}/.draft-{uuid.uuid4().hex}"
    out = fs.create(path(draft), False)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    if fs.exists(path(f"{root}/{name}")) or not fs.rename(path(draft), path(f"{root}/{name}")):
        raise RuntimeError(f"version {made['version']} was published by another upsert")


def upsert(new: DataFrame, root: str, version: str, keys: tuple[str, ...] = ("namespace", "pid"), buckets: int = BUCKETS) -> list[int]:
    """Merges `new` into the table and returns the buckets it rewrote; `buckets` holds for a table's first upsert."""
    spark, old = new.sparkSession, manifest(new.sparkSession, root)
    held = old or {"version": 0, "buckets": buckets, "keys": list(keys), "folders": {}}
    keys = held["keys"]
    place = F.pmod(F.xxhash64(*keys), F.lit(held["buckets"])).cast("int")
    placed = stable(last_wins(new, keys, [version]).withColumn("_bucket", place))
    touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())  # as many as there are buckets at most
    if not touched:
        return []
    before = [held["folders"][str(b)] for b in touched if str(b) in held["folders"]]
    if before:
        rows = spark.read.option("mergeSchema", True).parquet(*before).withColumn("_bucket", place)
        placed = last_wins(rows.unionByName(placed, allowMissingColumns=True), [*keys, "_bucket"], [version])
    folder = f"{root.rstrip('/')}/data-{held['version'] + 1:012d}-{uuid.uuid4().hex}"
    placed.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    folders = held["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
    _publish(spark, root, held | {"version": held["version"] + 1, "folders": folders})
    return touched


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table as its newest manifest has it."""
    return spark.read.option("mergeSchema", True).parquet(*manifest(spark, root)["folders"].values())
