"""Near-duplicates by the Jaccard similarity of five-word shingles, for the pipeline.

Two documents are linked if their sets of shingles have a similarity of at least 4/5; a group is what links connect.
Equal sets collapse to one class first. Candidates come from these, one after the other; each is judged by 200
min-hashes, and on the sets themselves (of 64-bit shingle hashes) unless those leave no doubt:

1. SimHash fingerprints of the sets, linked at up to `threshold` bits by anchor covering, as in simhash.py;
2. min-hashes, since 64 bits can't show the rest (at 0.8 they differ in about 10): 25 keys of five min-hashes each, so
   that a pair at 0.8 shares no key with probability (1 - 0.8^5)^25 = 5e-5, and fewer still above it. Of those that
   share a key and aren't in one group yet, each meets that least member with which it shares most keys;
3. the same with pairs of keys, within which documents are more alike;
4. what shares a key and still is in several groups is compared in blocks: by all 200 min-hashes, which leaves the
   members that are like some other one, and those then on their sets, in one task, and only links leave it.

A large group of mutual copies costs a comparison
a member and key, as the first steps connect it; no step writes all pairs of a key.

Defined cases: words are as in SimHash (A-Z lower-cased, split at ASCII white space); fewer than five words are one
shingle; texts that are null or have no word are copies of each other; texts of any length count whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import materialize, partitions, release, slices, trimmed, with_ids
from quern.llm.components import components

SHINGLE, BANDS, ROWS, HASHES, SEED = 5, 25, 5, 200, 42
#: Of 200 min-hashes 160 are expected to be equal at 0.8. With fewer than the first number a pair is below 0.8, with the
#: second or more it is above, but for a chance of about 1e-7 each; what lies between is verified on the sets.
LEAST_EQUAL, SURE = 130, 190
#: Members of a key that are compared in one cell; beyond it a key is split into a grid of cells.
CELL = 2048
_BLOCK = 2048
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingle hashes, sorted."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z and only ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    ids = np.array([known[w] for w in words], np.uint64)
    n = len(ids) - shingle + 1
    made = np.zeros(n, np.uint64)
    for k in range(shingle):
        made = _mix(made * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return np.unique(made)


def keys(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One key for each band of min-hashes, none for an empty set; and a byte of each min-hash."""
    if not len(found):
        return found, b""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        part = found[None, at : at + _BLOCK] * _FACTORS[:, None] + _TERMS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    made = np.arange(BANDS, dtype=np.uint64)
    for row in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        made = _mix(made * np.uint64(0x9E3779B97F4A7C15) + row)
    return made, _mix(least).astype(np.uint8).tobytes()


def _sketches(rows: DataFrame) -> DataFrame:
    """uid, the set's 128-bit hash (a, b), its size n, its SimHash fingerprint, its keys, and a byte of each min-hash."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            a, b, n, prints, held, marks = [], [], [], [], [], []
            for text in batch.column("_text").to_pylist():
                found = shingles(text)
                one, two = np.frombuffer(xxhash.xxh128_digest(found.tobytes()), np.int64)
                a.append(one)
                b.append(two)
                n.append(len(found))
                prints.append(simhash.majority(found))
                made, mark = keys(found)
                held.append(made.view(np.int64))
                marks.append(mark)
            columns = (batch.column("uid"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(held, pa.list_(pa.int64())), pa.array(marks, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(columns), ["uid", "a", "b", "n", "fp", "keys", "mark"])

    return rows.mapInArrow(trimmed(run), "uid long, a long, b long, n int, fp long, keys array<bigint>, mark binary")


def _sets(rows: DataFrame) -> DataFrame:
    """uid and its set of shingle hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            found = [shingles(t).view(np.int64) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(found, pa.list_(pa.int64()))], ["uid", "h"])

    return rows.select("uid", "_text").mapInArrow(trimmed(run), "uid long, h array<bigint>")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return with_ids(rows.withColumnRenamed("uid", "__q_uid"), ids).withColumnRenamed("__q_uid", "uid")


def _verified(pairs: DataFrame, rows: DataFrame, marks: DataFrame, best: bool = False) -> DataFrame:
    """Of pairs (u, v, size of both sets together) those (u, v) with a similarity of at least 4/5.

    With `best` each u is judged with one v only, with which it shares most keys, as others follow later. Sets are made
    anew for the documents of doubtful pairs only, and a pair's two are intersected as arrays: a row is as wide as two
    documents, and there is one for each pair.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("x", "y"))
            same = (x == y).sum(axis=1).astype(np.int32)
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "v", "size")), pa.array(same)], ["u", "v", "size", "same"])
            yield made.filter(pa.array(same >= LEAST_EQUAL))

    pairs = pairs.groupBy("u", "v", "size").agg(F.count(F.lit(1)).alias("keys"))
    if best:
        pairs = pairs.groupBy("u").agg(F.max_by(F.struct("v", "size"), F.struct("keys", -F.col("v"))).alias("p")).select("u", "p.v", "p.size")
    both = pairs.join(marks.toDF("u", "x"), "u").join(marks.toDF("v", "y"), "v")
    judged = materialize(both.select("u", "v", "size", "x", "y").mapInArrow(trimmed(close), "u long, v long, size int, same int"), "pairs")
    sure, pairs = judged.where(F.col("same") >= SURE).select("u", "v"), judged.where(F.col("same") < SURE)
    nodes = materialize(pairs.select(F.col("u").alias("__q_uid")).union(pairs.select("v")).distinct(), "nodes")
    sets = materialize(_sets(_only(rows, nodes)), "sets")
    release(nodes)
    wide = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    out = materialize(sure.union(wide.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * F.col("size")).select("u", "v")), "links")
    release(judged)
    release(sets)
    return out


def _fits(m, n):
    """Whether sets of these sizes can have a similarity of 4/5."""
    return 5 * F.least(m, n) >= 4 * F.greatest(m, n)


def _rooted(sets: DataFrame, links: DataFrame) -> DataFrame:
    """u, n, keys and `root`, the group that the links so far put each document in."""
    rows = sets.select("u", "n", "keys")
    if links.isEmpty():
        return rows.withColumn("root", F.col("u"))
    return materialize(rows.join(components(links).withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u")), "rooted")


def _open(rooted: DataFrame, keys: Column | str) -> tuple[DataFrame, DataFrame]:
    """A row (key, u, n, root) for each key; and of the keys whose members are in several groups the least member.

    The latter is counted map-side and written, so that a hot key is one row there and the join with it can be split.
    """
    keyed = rooted.select("u", "n", "root", F.explode(keys).alias("key"))
    least = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("u", "n", "root")).alias("least")).where("low < high")
    return keyed, materialize(least.select("key", "least"), "least")


def _meet_least(rooted: DataFrame, keys: Column | str) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v, size): each member of a key with its least, where they aren't in one group; and the members of such keys."""
    keyed, least = _open(rooted, keys)
    members = materialize(keyed.join(least, "key").select("u", "n", "root", "least"), "members")
    pairs = members.where((F.col("root") != F.col("least.root")) & _fits(F.col("n"), F.col("least.n")))
    return pairs.select("u", F.col("least.u").alias("v"), (F.col("n") + F.col("least.n")).alias("size")), members.select("u").distinct()


def _in_blocks(rooted: DataFrame, marks: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (u, v) between what shares a key and is in different groups: by min-hashes, then by the sets, in the same task."""
    keyed, least = _open(rooted, "keys")
    spark = rooted.sparkSession
    members = materialize(keyed.join(least.select("key"), "key", "left_semi"), "members")
    sizes = materialize(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")), "cells")
    own = F.pmod(F.xxhash64("u"), F.col("cells")).cast("int")
    # A member's row of cells from its own block on, and its column up to there: two blocks meet in one cell.
    others = F.sequence(F.lit(0), F.col("cells") - 1)
    narrow = ["key", "i", "j", "own", "u", "n", "root"]
    cells = members.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(others)).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "u", "n", "root")

    def alike(t: pa.Table, cell: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a cell whose min-hashes allow 4/5, of fitting sizes and different groups."""
        n, root, block = (t[c].to_numpy() for c in ("n", "root", "own"))
        mark = np.frombuffer(b"".join(t["mark"].to_pylist()), np.uint8).reshape(-1, HASHES)
        # Within a cell the most frequent group's members needn't meet each other.
        names, counts = np.unique(root, return_counts=True)
        asking = np.flatnonzero(root != names[np.argmax(counts)])
        for at in range(0, len(asking), 32):
            x = asking[at : at + 32]
            fits = (root[x][:, None] != root[None, :]) & (5 * np.minimum(n[x][:, None], n[None, :]) >= 4 * np.maximum(n[x][:, None], n[None, :]))
            if cell[1] != cell[2]:
                fits &= block[x][:, None] != block[None, :]
            a, b = np.nonzero(fits)
            for part in range(0, len(a), 1 << 16):
                p, q = x[a[part : part + (1 << 16)]], b[part : part + (1 << 16)]
                good = (mark[p] == mark[q]).sum(axis=1) >= LEAST_EQUAL
                yield p[good], q[good]

    def surviving(t: pa.Table, cell: tuple) -> Iterator[pa.RecordBatch]:
        """The members that are in some pair: at most as many rows as come in."""
        some = np.zeros(t.num_rows, bool)
        for p, q in alike(t, cell):
            some[p] = some[q] = True
        yield from t.select(narrow).filter(pa.array(some)).combine_chunks().to_batches()

    def linked(t: pa.Table, cell: tuple) -> Iterator[pa.RecordBatch]:
        u, n, root = (t[c].to_numpy() for c in ("u", "n", "root"))
        sets, made = t["h"].combine_chunks(), {}
        label = {x: x for x in root.tolist()}  # groups, as links of this cell join them

        def group(x: int) -> int:
            while label[x] != x:
                x = label[x] = label[label[x]]
            return x

        def set_of(k: int) -> frozenset:
            if k not in made:
                made[k] = frozenset(sets[k].values.to_numpy().tolist())
            return made[k]

        found: list[tuple[int, int]] = []
        for p, q in alike(t, cell):
            for one, two in zip(p.tolist(), q.tolist(), strict=True):
                g, h = group(int(root[one])), group(int(root[two]))
                if g != h and 9 * len(set_of(one) & set_of(two)) >= 4 * int(n[one] + n[two]):
                    label[max(g, h)] = min(g, h)
                    found.append((int(max(u[one], u[two])), int(min(u[one], u[two]))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    def by_cell(work):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held = None, []
            for batch in batches:
                at = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
                edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a < b:
                        if (now := tuple(at[a].tolist())) != cell:
                            if held:
                                yield from work(pa.Table.from_batches(held), cell)
                            cell, held = now, []
                        held.append(batch.slice(a, b - a))
            if held:
                yield from work(pa.Table.from_batches(held), cell)

        return run

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    kept = dealt(cells.join(marks, "u").select(*narrow, "mark")).mapInArrow(trimmed(by_cell(surviving)), "key long, i int, j int, own int, u long, n int, root long")
    kept = materialize(kept, "alike")
    alive = materialize(kept.select(F.col("u").alias("__q_uid")).distinct(), "alive")
    held = materialize(marks.join(_sets(_only(rows, alive)).withColumnRenamed("uid", "u"), "u"), "held")
    out = dealt(kept.join(held, "u").select(*narrow, "mark", "h")).mapInArrow(trimmed(by_cell(linked)), "u long, v long")
    return materialize(out.distinct(), "links")


def later_of_groups(docs: DataFrame, id_col: str = "__q_uid", text_col: str = "text", threshold: int = simhash.THRESHOLD) -> DataFrame:
    """`id_col` of the documents that are not the least of their group, each once; ids are unique numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("uid"), F.col(text_col).alias("_text"))
    made = materialize(_sketches(rows), "sketches")
    classes = materialize(made.groupBy("a", "b", "n").agg(F.min("uid").alias("uid")).select("uid"), "classes")
    later = materialize(made.select("uid").join(classes, "uid", "left_anti"), "later")
    sets = materialize(made.join(classes, "uid", "left_semi").where("n > 0").select(F.col("uid").alias("u"), "n", "fp", "keys", "mark"), "distinct")
    release(made)
    marks = sets.select("u", "mark")

    prints = materialize(sets.groupBy("fp").agg(F.min(F.struct("u", "n")).alias("least")), "prints")
    same = sets.join(prints, "fp").where(F.col("u") != F.col("least.u")).select("u", "n", "least")
    near = simhash.links(prints.select("fp"), prints.count(), threshold).toDF("x", "y")
    near = near.join(prints.toDF("x", "own"), "x").join(prints.toDF("y", "least"), "y").select("own.u", "own.n", "least")
    pairs = same.union(near).where(_fits(F.col("n"), F.col("least.n"))).select("u", F.col("least.u").alias("v"), (F.col("n") + F.col("least.n")).alias("size"))
    links = _verified(pairs, rows, marks)

    pairs, members = _meet_least(_rooted(sets, links), "keys")
    links = materialize(links.union(_verified(pairs, rows, marks, best=True)), "links")
    # All others share no key with another group, and groups only grow.
    open_ = materialize(sets.join(members, "u", "left_semi"), "open-sets")
    release(sets)
    marks = open_.select("u", "mark")
    double = F.transform("keys", lambda k, i: F.xxhash64(k, F.element_at("keys", F.pmod(i + 1, F.size("keys")) + 1)))
    pairs, _ = _meet_least(_rooted(open_, links), double)
    links = materialize(links.union(_verified(pairs, rows, marks, best=True)), "links")
    links = materialize(links.union(_in_blocks(_rooted(open_, links), marks, rows)), "links")
    if not links.isEmpty():
        later = later.union(components(links).where("node != root").select("node"))
    return later.withColumnRenamed("uid", id_col)
