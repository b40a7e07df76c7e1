"""Shared pieces of the training-data operators: reading, shared storage, row identity and batching."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The temporary folder, if one was made.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor can reach.

    Where the session names none, a temporary folder is made, but only if all runs in this process (tests): on a
    cluster each machine would have its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own[0] if _own else f"file://{tempfile.mkdtemp(prefix='quern-')}"
        _own[:] = [found]
    return found.rstrip("/")


#: Tables of materialize() that the run at hand has not released yet. Every thread and every finished() has its own list.
_made: ContextVar[list[DataFrame] | None] = ContextVar("quern_tables", default=None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quern_path = path
    if (mine := _made.get()) is not None:
        mine.append(back)
    spark._jvm.System.gc()  # shuffle files of plans that are done go once the driver finds nobody holds them
    return back


def release(df: DataFrame) -> None:
    """Delete a table of materialize() that no later plan reads."""
    path = getattr(df, "_quern_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        if (mine := _made.get()) is not None:
            mine[:] = [t for t in mine if t is not df]


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, as a table of the shared folder; all other tables it left there are deleted, also if it fails."""
    mine: list[DataFrame] = []
    token, out = _made.set(mine), None
    try:
        out = materialize(make(), name)
    finally:
        _made.reset(token)
        for t in mine:
            if t is not out:
                release(t)
    if (outer := _made.get()) is not None:
        outer.append(out)
    return out


def with_uid(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds `__q_uid`, one number per row: the id itself where ids are whole numbers, unique and not null.

    Otherwise (repeated rows, null ids, ids of another type) the table is written once with a number that rises with the
    id, and among rows of one id with a hash of the row, so that every later read of it sees the same numbers and runs
    agree. Rows equal in all columns are told apart by where they stand, so that they needn't meet in one task.
    """
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        odd = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
        if odd.isEmpty():
            return docs.withColumn("__q_uid", F.col(id_col).cast("long"))
    hashed = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) if docs.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in docs.columns))
    sorted_ = docs.withColumn("__q_h", hashed).withColumn("__q_at", F.monotonically_increasing_id()).orderBy(id_col, "__q_h", "__q_at")
    return materialize(sorted_.drop("__q_h", "__q_at").withColumn("__q_uid", F.monotonically_increasing_id()), "rows")


def numbered(df: DataFrame, by: list[Column], name: str = "__q_rank") -> DataFrame:
    """Adds numbers from 1 in the order `by`: rows are dealt to ranges of it, whose sizes, one row each, are summed."""
    parts = materialize(df.repartitionByRange(partitions(df.sparkSession), *by).withColumn("__q_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__q_part").agg(F.count(F.lit(1)).alias("__q_size"))
    before = Window.orderBy("__q_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__q_part", F.coalesce(F.sum("__q_size").over(before), F.lit(0)).alias("__q_before"))
    inside = F.row_number().over(Window.partitionBy("__q_part").orderBy(*by))
    return parts.join(F.broadcast(offsets), "__q_part").withColumn(name, inside + F.col("__q_before")).drop("__q_part", "__q_before")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the filter that with_ids() and without_ids() send to every task: 512 rows of 4 KB at most, whatever there is.
FILTER_BITS = 1 << 24


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """`rows` with __q_hit: false only where __q_uid is surely none of `ids`, by a bit for each hash of an id.

    The filter's size is fixed, so it may be broadcast; the more ids there are, the more rows are hit by chance.
    """
    place = F.pmod(F.xxhash64("__q_uid"), F.lit(FILTER_BITS))
    slot, bit = F.shiftright(place, 15).cast("int"), place.bitwiseAND(F.lit((1 << 15) - 1))
    set_ = ids.select(slot.alias("__q_slot"), bit.alias("__q_bit")).repartition(partitions(rows.sparkSession), "__q_slot")
    bits = set_.groupBy("__q_slot").agg(F.bitmap_construct_agg("__q_bit").alias("__q_bits"))
    byte = F.conv(F.hex(F.substring("__q_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return rows.withColumn("__q_slot", slot).join(F.broadcast(bits), "__q_slot", "left").withColumn("__q_hit", hit).drop("__q_slot", "__q_bits")


def with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose __q_uid is in `ids` (a column __q_uid, each once); of the others few are shuffled.

    An inner join, since Catalyst would move a semi-join below the filter, to all rows.
    """
    return _marked(rows, ids).where("__q_hit").drop("__q_hit").join(ids, "__q_uid")


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose __q_uid is not in `ids` (each once): most never meet them, the rest are joined exactly."""
    marked = _marked(rows, ids)
    met = marked.where("__q_hit").drop("__q_hit").join(ids.withColumn("__q_in", F.lit(True)), "__q_uid", "left").where(F.col("__q_in").isNull())
    return marked.where(~F.col("__q_hit")).drop("__q_hit").unionByName(met.drop("__q_in"))


def joined_ids(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with the columns of `found` (each __q_uid once), null where there is none; most rows without any never meet it.

    A sorted join at every size, as `found` grows with the rows.
    """
    marked = _marked(rows, found.select("__q_uid"))
    met = marked.where("__q_hit").drop("__q_hit").join(found.hint("merge"), "__q_uid", "left")
    return marked.where(~F.col("__q_hit")).drop("__q_hit").unionByName(met, allowMissingColumns=True)


#: What kept() holds in this Python worker, by owner.
_kept: dict[str, dict[Any, Any]] = {}


def kept(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """What `make` returns, once for all tasks of a Python worker, until another owner keeps something there.

    Workers go from one operator's tasks to the next one's; the tables of all of them would add up.
    """
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    mine = _kept[owner]
    if key not in mine:
        mine[key] = make()
    return mine[key]


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, if they have more: a batch of texts is held beside the heap of
    an executor while it is filled and sent, and again in its Python worker."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; what a task has freed goes back to the system at its end, as idle workers stay beside the JVM."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return ran


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that `column` holds about `most` bytes or one row, which bounds a Python worker's memory."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows < 2 or col.nbytes <= most:
            if batch.num_rows:
                yield batch
            continue
        begin = held = 0
        sizes = pa.compute.multiply(pa.compute.list_value_length(col), 8) if pa.types.is_list(col.type) else pa.compute.binary_length(col)
        for i, n in enumerate(sizes.to_pylist()):
            if held and held + (n or 0) > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n or 0
        yield batch.slice(begin)
