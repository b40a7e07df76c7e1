"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has a bit set where more than half of its word shingles' hashes have it. To link all
fingerprints that differ in at most `threshold` bits, the 64 bits are dealt into m blocks and the anchors are the
words that are constant in every block: a product of repetition codes, whose covering radius is the sum of half the
block lengths. Every fingerprint lies at its nearest anchor (its home, the majority of each block) and is replicated
to every anchor that can be the home of a fingerprint within `threshold` bits; all of these are within the covering
radius plus the threshold. Per anchor, homes are compared with replicas, and links leave as a spanning forest.
m grows with the number of distinct fingerprints, so that an anchor's share stays about even.

Defined cases: a text that is null or has no word has fingerprint zero and links like any other; equal texts, and
all of a group of copies, share a fingerprint, which takes part once; a null id never becomes a component's id unless
all are null; a text of any length counts whole; repeated rows get equal rows; an empty table gives no rows; other
columns are ignored, so their names may clash with the result's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, partitions, slices
from quern.llm.components import components

SHINGLE, THRESHOLD, SEED = 3, 2, 42
#: Fingerprints of one anchor that meet in one cell; beyond it an anchor is split into a grid of cells.
CELL = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, as an unsigned number."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z and only ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The number whose bits are set in over half of `hashes`."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.asarray(hashes[at : at + 65536], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [fingerprint(t, shingle) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long")


def blocks_for(n: int) -> int:
    """The number of blocks, so that about 16 fingerprints are at home at an anchor."""
    return min(64, max(4, round(math.log2(max(1, n) / 16))))


def replicas(fps: np.ndarray, m: int, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, indices into fps, and whether it is at home there. Of two anchors that a pair could meet at, one is kept."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.stack([bits[:, k::m].sum(axis=1, dtype=np.int16) for k in range(m)], axis=1)
    half = np.array([(len(range(k, 64, m)) + 1) // 2 for k in range(m)], np.int16)
    major = ones >= half
    flips = np.where(major, ones - half + 1, half - ones)  # so many flipped bits move the majority
    place = np.uint64(1) << np.arange(m, dtype=np.uint64)
    home = (major * place).sum(axis=1, dtype=np.uint64)
    # Subsets of blocks whose flips stay within the threshold, grown block by block.
    at = [(np.arange(len(fps)), home, np.zeros(len(fps), np.int16), np.full(len(fps), -1))]
    for found in at:
        index, anchor, spent, last = found
        rows, blocks = np.nonzero((flips[index] + spent[:, None] <= threshold) & (np.arange(m)[None, :] > last[:, None]))
        if len(rows):
            at.append((index[rows], anchor[rows] ^ place[blocks], spent[rows] + flips[index[rows], blocks], blocks))
    index = np.concatenate([x[0] for x in at])
    anchor = np.concatenate([x[1] for x in at])
    own = anchor == home[index]
    keep = own | (_mix(anchor) > _mix(home[index]))
    return anchor[keep], index[keep], own[keep]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def forest(homes: np.ndarray, others: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and others (and among homes, if others hold them)."""
    values, place = np.unique(np.concatenate((homes, others)), return_inverse=True)
    label = np.arange(len(values))
    h, o = place[: len(homes)], place[len(homes) :]
    step = max(1, (1 << 21) // max(1, len(others)))
    for at in range(0, len(homes), step):
        i, j = np.nonzero(np.bitwise_count(homes[at : at + step, None] ^ others[None, :]) <= threshold)
        a, b = h[at : at + step][i], o[j]
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:  # halve paths
                up = label[label]
                if (up == label).all():
                    break
                label = up
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def links(classes: DataFrame, n: int, threshold: int = THRESHOLD) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` that connect all that are within the threshold."""
    m = blocks_for(n)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column("fp").slice(at, 4096).to_numpy().view(np.uint64)
                anchor, index, own = replicas(fps, m, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fps[index].view(np.int64)), pa.array(own)], ["anchor", "fp", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, others = None, [], []

        def flush():
            h = np.concatenate(homes) if homes else np.zeros(0, np.uint64)
            if len(h):
                u, v = forest(h, np.concatenate([*others, h]), threshold)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy() for c in ("anchor", "i", "j")], axis=1)
            fps, own = batch.column("fp").to_numpy().view(np.uint64), batch.column("own").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), len(cells)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                now = tuple(cells[a].tolist())
                if now != key:
                    yield from flush()
                    key, homes, others = now, [], []
                homes.append(fps[a:b][own[a:b]])
                others.append(fps[a:b][~own[a:b]])
        yield from flush()

    spread = classes.select("fp").mapInArrow(replicate, "anchor long, fp long, own boolean")
    hot = spread.groupBy("anchor").agg(F.count_if("own").alias("h"), F.count(F.lit(1)).alias("r"))
    hot = materialize(hot.where(F.col("r") > CELL).select("anchor", F.ceil(F.col("h") / CELL).cast("int").alias("hs"), F.ceil(F.col("r") / CELL).cast("int").alias("rs")), "hot")
    if hot.isEmpty():
        cells = spread.select("anchor", "fp", "own", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        # A hot anchor becomes hs x rs cells: a home goes to one row of cells, anything (homes too) to one column.
        one = F.sequence(F.lit(0), F.lit(0))
        wide = spread.join(hot, "anchor", "left")
        row, col = F.pmod(F.xxhash64("fp"), F.coalesce("hs", F.lit(1))).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("rs", F.lit(1))).cast("int")
        rows, cols = F.sequence(F.lit(0), F.coalesce("hs", F.lit(1)) - 1), F.sequence(F.lit(0), F.coalesce("rs", F.lit(1)) - 1)
        as_home = wide.where("own").select("anchor", "fp", F.lit(True).alias("own"), row.alias("i"), F.explode(F.when(F.col("rs").isNull(), one).otherwise(cols)).alias("j"))
        as_other = wide.where(~F.col("own") | F.col("rs").isNotNull()).select("anchor", "fp", F.lit(False).alias("own"), F.explode(F.when(F.col("hs").isNull(), one).otherwise(rows)).alias("i"), col.alias("j"))
        cells = as_home.union(as_other)
    parts = cells.repartition(partitions(classes.sparkSession), "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return parts.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least id reachable over links)."""
    made = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = materialize(links(classes, classes.count(), threshold), "links")
    member = classes
    if not edges.isEmpty():
        groups = components(edges)
        tree = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
        least = tree.join(classes.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("least").alias("group_least"))
        grouped = tree.join(least, "root").select(F.col("node").alias("fp"), "group_least")
        # Written before it is joined to all documents, so that the join can split a fingerprint of very many copies.
        member = materialize(classes.join(grouped, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("least")), "members")
    out = made.join(member, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))
