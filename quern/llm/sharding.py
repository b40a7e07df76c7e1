"""Sharding by a k-d tree over metadata: shards of near equal bytes, each a box of similar documents.

A node of the tree that stands for k shards is split at a weighted quantile of its widest metadata dimension: the lower
part takes k div 2 of the k shards and so many of the bytes. It ends at nodes of one shard, whose bytes are the target.
A node is a number on the narrow rows of the tree's cells, so no text moves while the tree is built.

Quantiles are found by sums alone. A row's key in a dimension is its coordinate (10 bits) followed by a hash (50 bits).
Every task sums sizes by the key's leading ten bits, for all nodes of a depth together; the bin in which a quantile lies
is split by its next ten bits, until a bin holds a fiftieth of a shard at most, and the nearer edge is taken. Sums of
1024 bins a node at most reach the driver.

Units of the tree are cells: rows of equal texts, which stay together unless they hold more than a fiftieth of a shard;
the rows of those are dealt by a hash of their ids into cells of about that size, so that no cell is hot. A cell's
metadata are those of its row with the least id. An end of the scale is where a dimension's least or greatest value of
the table lies; strings stand at a hash, the size on a scale of its logarithm.

Defined cases: a null text counts as an empty one (size 16 bytes); null and NaN metadata stand at 0; a text of any
length is one row and is never cut, so where single texts are larger than a shard shards differ by as much, and some
may be empty; rows that share an id, or have none, are rows of their own; equal rows may change places; extra columns
are kept by shard_documents(), and only names that begin with __q_ are taken; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import materialize, release

SHARDS, OVERHEAD, METADATA = 40, 16, ("lang", "source", "doc_id")
#: Bits of a coordinate and of each step of the search, bits of the hash behind it, and cells that a shard has at least.
BITS, TIE, CELLS = 10, 50, 50
#: Rows of a shard that are numbered in one task, and such tasks to a shard at most.
NUMBERED, MOST_BUCKETS = 20_000, 4096


@dataclass
class Node:
    """A leaf has one shard; an inner node has a dimension and the least key of its upper part."""

    first: int
    shards: int
    dim: int = -1
    split: int = 0
    lower: Node | None = None
    upper: Node | None = None


def _scale(kind: T.DataType, c: Column) -> Column:
    """A number to place values by; strings and other types at a hash."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return c.cast("timestamp").cast("double")
    return F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << 20)).cast("double")


def narrow(docs: DataFrame, id_col: str, text_col: str, metadata: list[str]) -> DataFrame:
    """A row's id, size, checksum and hash of its text, its place in the table, and a number for each dimension."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    dims = [F.log2(size.cast("double")), *(_scale(docs.schema[c].dataType, F.col(f"`{c}`")) for c in metadata)]
    numbers = [F.when(F.col(f"`{c}`").isNotNull(), F.nanvl(d, F.lit(0.0))) if c else d for c, d in zip(["", *metadata], dims, strict=True)]
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("text"),
        F.monotonically_increasing_id().alias("at"), *(F.coalesce(n, F.lit(0.0)).alias(f"d{i}") for i, n in enumerate(numbers)),
    )


def celled(rows: DataFrame, dims: int, limit: float) -> DataFrame:
    """Adds `part`, which with the text names a row's cell: 0 for texts whose rows weigh up to `limit` together."""
    # Fewer than all bytes / limit texts, shards * CELLS, can be that heavy; so can pairs of text and id.
    hot = materialize(rows.groupBy("text", "crc").agg(F.sum("size").alias("held")).where(F.col("held") > limit), "hot")
    many = rows.join(F.broadcast(hot), ["text", "crc"], "left_semi").groupBy("text", "crc", "doc_id").agg(F.sum("size").alias("same")).where(F.col("same") > limit)
    many = materialize(many.withColumn("repeated", F.lit(True)).drop("same"), "repeated")
    of_row = (F.col("text") == F.col("m.text")) & (F.col("crc") == F.col("m.crc")) & F.col("doc_id").eqNullSafe(F.col("m.doc_id"))
    m = many.select(F.struct("text", "crc", "doc_id").alias("m"), "repeated")
    joined = rows.join(F.broadcast(hot), ["text", "crc"], "left").join(F.broadcast(m), of_row, "left")
    # Rows of one id, which no hash of the id can tell apart, are dealt by their places.
    spread = F.xxhash64("doc_id", F.when(F.col("repeated"), F.col("at")))
    part = F.when(F.col("held").isNotNull(), F.pmod(spread, F.ceil(F.col("held") / F.lit(limit))) + 1).otherwise(F.lit(0))
    return joined.select("doc_id", "size", "crc", "text", *(f"d{i}" for i in range(dims)), part.cast("long").alias("part"))


def keys(cells: DataFrame, dims: int) -> DataFrame:
    """text, part, crc, weight, k0, k1, ...: each cell's key in every dimension."""
    ends = cells.agg(*(f(f"d{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max)))).first()
    tie = F.shiftrightunsigned(F.xxhash64("text", "part", "crc"), 64 - TIE)
    out = []
    for i in range(dims):
        a, b = ends[f"a{i}"] or 0.0, ends[f"b{i}"] or 0.0
        place = F.floor((F.col(f"d{i}") - F.lit(a)) / F.lit(b - a) * F.lit(float((1 << BITS) - 1))) if b > a else F.lit(0)
        out.append((F.shiftleft(place.cast("long"), TIE) + tie).alias(f"k{i}"))
    return cells.select("text", "part", "crc", "weight", *out)


def _widest(open_: DataFrame, dims: int) -> dict[int, tuple[int, int]]:
    """By open node, its widest dimension (the first of equals) and its weight: one row a node."""
    spread = [((F.shiftright(F.max(f"k{i}"), TIE)) - F.shiftright(F.min(f"k{i}"), TIE)).alias(f"s{i}") for i in range(dims)]
    rows = open_.groupBy("node").agg(F.sum("weight").alias("w"), *spread).collect()
    return {r["node"]: (max(range(dims), key=lambda i: (r[f"s{i}"], -i)), r["w"]) for r in rows}


def _split(open_: DataFrame, nodes: dict[int, Node], dims: int, limit: float) -> None:
    """Finds dimension and split of all nodes of one depth that have cells, ten bits of their keys at a time."""
    widest = _widest(open_, dims)
    if not widest:
        return
    key = F.coalesce(*(F.when(F.col("node") == n, F.col(f"k{dim}")) for n, (dim, _) in widest.items()))
    keyed = open_.select("node", key.alias("key"), "weight")
    wanted, below, low = {}, {}, {}
    for n, (nodes[n].dim, weight) in widest.items():
        wanted[n], below[n], low[n] = weight * (nodes[n].shards // 2) / nodes[n].shards, 0, 0
    shift = TIE
    while wanted:
        begin = F.coalesce(*(F.when(F.col("node") == n, F.lit(low[n])) for n in wanted))
        ahead = keyed.where(F.col("node").isin(list(wanted))).withColumn("bin", F.shiftright(F.col("key") - begin, shift))
        found: dict[int, dict[int, int]] = {n: {} for n in wanted}
        for n, b, w in ahead.where(F.col("bin").between(0, (1 << BITS) - 1)).groupBy("node", "bin").agg(F.sum("weight")).collect():
            found[n][b] = w
        for n, bins in found.items():
            for b in sorted(bins):
                if below[n] + bins[b] >= wanted[n] or b == max(bins):
                    break
                below[n] += bins[b]
            low[n] += b << shift
            if shift == 0 or bins[b] <= limit:
                nearer = wanted[n] - below[n] > below[n] + bins[b] - wanted[n]
                nodes[n].split = low[n] + (1 << shift if nearer else 0)
                del wanted[n]
        shift -= BITS


def grow(cells: DataFrame, dims: int, shards: int, limit: float) -> tuple[DataFrame, Node]:
    """The cells of keys() with their shard in `node`, and the tree; the loop runs once a depth.

    A node's number is the first of its shards. Depth after depth is written, so that no expression grows with the tree.
    """
    root = Node(0, shards)
    cells = materialize(cells.withColumn("node", F.lit(0)), "depth")
    level = [root] if shards > 1 else []
    while level:
        _split(cells.where(F.col("node").isin([n.first for n in level])), {n.first: n for n in level}, dims, limit)
        below, moved = [], F.lit(None).cast("int")
        for n in level:
            if n.dim < 0:
                continue  # no cell came into it
            half = n.shards // 2
            n.lower, n.upper = Node(n.first, half), Node(n.first + half, n.shards - half)
            moved = F.coalesce(moved, F.when((F.col("node") == n.first) & (F.col(f"k{n.dim}") >= n.split), F.lit(n.upper.first)))
            below += [m for m in (n.lower, n.upper) if m.shards > 1]
        old, cells, level = cells, materialize(cells.withColumn("node", F.coalesce(moved, "node")), "depth"), below
        release(old)
    return cells, root


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, metadata: list[str] | tuple[str, ...] = METADATA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, crc, shard and slot (gapless from 0 in its shard) of every row.

    The number of shards is given, or follows from the bytes that one is to hold.
    """
    metadata = [c for c in metadata if c in docs.columns]
    dims = 1 + len(metadata)
    rows = materialize(narrow(docs, id_col, text_col, metadata), "narrow")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = shards or max(1, -(-total // (target_bytes or total or 1)))
    limit = max(1.0, total / shards / CELLS)
    parted = materialize(celled(rows, dims, limit), "parted")
    release(rows)
    least = F.min_by(F.struct(*(f"d{i}" for i in range(dims))), F.struct("doc_id", *(f"d{i}" for i in range(dims)))).alias("d")
    cells = parted.groupBy("text", "crc", "part").agg(F.sum("size").alias("weight"), least).select("text", "crc", "part", "weight", "d.*")
    cells = materialize(cells, "cells")
    grown, _ = grow(keys(cells, dims), dims, shards, limit)
    release(cells)
    placed = parted.join(grown.select("text", "part", "crc", F.col("node").alias("shard")), ["text", "part", "crc"])
    # Numbered in buckets of a hash, whose sizes are summed first: no task holds a shard.
    buckets = max(1, min(MOST_BUCKETS, -(-n_rows // (shards * NUMBERED))))
    order = F.xxhash64("doc_id", "text")
    placed = materialize(placed.select("doc_id", "size", "crc", "shard", order.alias("h"), F.pmod(F.xxhash64("text", "doc_id"), F.lit(buckets)).alias("bucket")), "placed")
    sizes = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # shards * MOST_BUCKETS rows at most
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "crc")) - 1
    return placed.join(F.broadcast(offsets), ["shard", "bucket"]).select("doc_id", "size", "crc", "shard", (inside + F.col("before")).cast("long").alias("slot"))


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the law is near equal bytes, which says nothing of one more shard."""
    out = assign(docs, shards)
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, path: str, **settings) -> DataFrame:
    """Writes docs with all their columns, __q_shard and __q_slot to a Parquet folder for each shard; ids must be unique and not null.

    A shard is written by as many tasks as its slots divide into runs of NUMBERED rows.
    """
    id_col = settings.get("id_col", "doc_id")
    at = assign(docs, **settings).select(F.col("doc_id").alias("__q_id"), F.col("shard").alias("__q_shard"), F.col("slot").alias("__q_slot"))
    joined = docs.join(at, F.col(f"`{id_col}`") == F.col("__q_id")).drop("__q_id").withColumn("__q_run", F.floor(F.col("__q_slot") / NUMBERED))
    joined.repartition("__q_shard", "__q_run").sortWithinPartitions("__q_shard", "__q_slot").drop("__q_run").write.partitionBy("__q_shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
