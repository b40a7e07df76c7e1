"""Suffix-array dedup of byte strings: a `width`-byte string that starts in two places is removed where it is a copy.

Suffixes are dealt out before they are sorted. Every window of `width` bytes has an anchor, the least hash of a
GRAM-byte string in it (the leftmost of equals), so equal windows have equal anchors at equal places. Runs of windows
with one anchor are one occurrence, with a fingerprint of the anchor and a digest of all bytes the run covers:

1. anchors that occur once are dropped: none of their windows repeats;
2. occurrences of equal bytes are one class; a class of two or more repeats as a whole;
3. where an anchor has several classes, one text of each class is fetched and the suffixes of these texts are sorted
   (prefix doubling over 8, 16, ... bytes, whose ranks also give the longest common prefix of neighbours). For each
   suffix the previous and the next one in suffix order with a smaller place are looked up: the longer of the two
   common prefixes is its longest previous factor. It is a later copy if that reaches `width`.

An anchor with more than CLASSES classes is split before it is sorted. Two classes share the window whose anchor lies
d bytes from its start only if they agree on d bytes before the anchor and width - GRAM - d after it. So the possible d
are halved: classes that agree on what all of the lower half need go to one part, and likewise for the upper half. Each
class goes to at most two parts, each window of it to one, and parts are halved again until they are small; where one d
is left, a part's windows are equal and are counted. So no group, however large, meets in one task.

keep_first=True keeps the first copy in the order of ids and places (its longest previous factor is short) and
removes later ones; keep_first=False removes all. Matches never cross documents; what is repeated is judged on the
input. All that meets in one task is bounded: anchors are joined, never gathered.

Defined cases: null and empty texts and those below `width` bytes stay whole; texts of any length are cut into
blocks of windows, which changes nothing in the result; rows that share an id are compared like any others, and among
them the one whose row has the least hash comes first; an empty table gives no rows; extra columns are kept, and only
names that begin with __q_ are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, partitions, release, slices, trimmed, with_uid

WIDTH, GRAM, BLOCK = 200, 32, 1 << 19
#: Classes that one task sorts together, about 1.5 MB of texts and 100 MB of sorting; a greater group is halved.
CLASSES = 4096
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes (a power of two) from each place on, by doubling."""
    h = _mix((data.astype(np.uint64) + np.uint64(1)) * _PRIME)
    step = 1
    while step < gram:
        h = _mix(h[:-step] * _PRIME + h[step:])
        step *= 2
    return h


def window_runs(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For the windows of one or more texts laid end to end: anchor place and hash of the window from each start on."""
    h = gram_hashes(data, gram)
    reach = width - gram + 1
    low = np.uint64((1 << 24) - 1)
    keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
    n = len(h) - reach + 1
    pad = -len(keyed) % reach
    grid = np.concatenate((keyed, np.full(pad, ~np.uint64(0)))).reshape(-1, reach)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[reach - 1 : reach - 1 + n]) & low).astype(np.int64), h


def _segments(batch: pa.RecordBatch, width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about BLOCK bytes; long texts in blocks that overlap by width - 1."""
    held, size = [], 0
    for row, text in enumerate(batch.column("__q_text").to_pylist()):
        raw = (text or "").encode()
        for at in range(0, max(0, len(raw) - width + 1), BLOCK):
            held.append((row, at, raw[at : at + BLOCK + width - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """uid, off (first window's start), fp, sig (the anchor's place in the run and its number of windows), full (digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "__q_text", BLOCK):
            uids = batch.column("__q_uid").to_numpy()
            for held in _segments(batch, width):
                raw = b"".join(s[2] for s in held)
                sizes = np.array([len(s[2]) for s in held])
                base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                place, h = window_runs(np.frombuffer(raw, np.uint8), width, gram)
                owner = np.repeat(np.arange(len(held)), sizes)[: len(place)]
                start = np.arange(len(place))
                place[start + width > (base + sizes)[owner]] = -1  # windows across texts
                first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                last = np.concatenate((first[1:], [len(place)]))
                good = place[first] >= 0
                first, last = first[good], last[good]
                at = place[first]
                full = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (last + width - 1).tolist(), strict=True)], np.uint64)
                seg = owner[first]
                offset = np.array([s[1] for s in held])[seg] + first - base[seg]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[np.array([s[0] for s in held])[seg]]), pa.array(offset), pa.array(h[at].view(np.int64)), pa.array(((at - first) * 256 + (last - first)).astype(np.int32)), pa.array(full.view(np.int64))],
                    ["uid", "off", "fp", "sig", "full"],
                )

    return docs.select("__q_uid", "__q_text").where(F.col("__q_text").isNotNull()).mapInArrow(trimmed(run), "uid long, off long, fp long, sig int, full long")


def suffix_order(texts: list[bytes], width: int, wanted: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """The suffixes of `texts` that start in the wanted ranges and have `width` bytes, in suffix order (ties by place):
    each one's place in the joined texts, its text, its start there, and the longest common prefix with the one before."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(4 * width), np.uint8)
    first = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | data[k : k + len(first)]
    levels, h = [(8, np.unique(first, return_inverse=True)[1].astype(np.uint32))], 8
    while h < width:
        rank = levels[-1][1].astype(np.uint64)
        levels.append((2 * h, np.unique(rank[:-h] << np.uint64(32) | rank[h:], return_inverse=True)[1].astype(np.uint32)))
        h *= 2
    base = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(owner)) - base[owner]
    low, high = np.array([w[0] for w in wanted]), np.array([w[1] for w in wanted])
    place = np.flatnonzero((start + width <= sizes[owner]) & (start >= low[owner]) & (start <= high[owner]))
    place = place[np.argsort(levels[-1][1][place], kind="stable")]
    # Neighbours' common prefix: from the greatest step down, then byte by byte.
    a, b = place[:-1], place[1:]
    common = np.zeros(len(a), np.int64)
    for step, rank in reversed(levels):
        last = len(rank) - 1
        common += step * (rank[np.minimum(a + common, last)] == rank[np.minimum(b + common, last)])
    last = len(first) - 1
    differ = first[np.minimum(a + common, last)] ^ first[np.minimum(b + common, last)]
    common += sum((differ >> np.uint64(56 - 8 * k) == 0).astype(np.int64) for k in range(8))
    rest = base[owner[place] + 1] - place
    common = np.concatenate(([0], np.minimum(common, np.minimum(rest[:-1], rest[1:]))))[: len(place)]
    return place, owner[place], start[place], common.astype(np.int64)


def _nearest_smaller(place: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each entry the common prefix with the nearest one before it that has a smaller place; 0 if it is below `least`.

    Steps of powers of two skip entries with greater places, with the least place and common prefix of each step at hand.
    """
    lows, commons, step = [place], [common], 1
    while 2 * step <= len(place) and (commons[-1] >= least).any():
        low, both = lows[-1].copy(), commons[-1].copy()
        np.minimum(low[step:], lows[-1][:-step], out=low[step:])
        np.minimum(both[step:], commons[-1][:-step], out=both[step:])
        both[:step] = 0
        lows.append(low)
        commons.append(both)
        step *= 2
    at, reach = np.arange(len(place)), np.full(len(place), np.iinfo(np.int64).max)
    for low, both, step in zip(reversed(lows), reversed(commons), (1 << k for k in range(len(lows) - 1, -1, -1)), strict=True):
        on = np.minimum(reach, both[at])
        skip = (at >= step) & (on >= least) & (low[at - 1] > place)
        reach[skip] = on[skip]
        at[skip] -= step
    on = np.minimum(reach, common[at])
    return np.where((at > 0) & (on >= least) & (place[at - 1] < place), on, 0)


def longest_previous_factors(place: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The longest previous factor of each entry of a suffix order where it is at least `least`, else 0: the longer of the
    common prefixes with its previous and its next smaller place."""
    back = np.concatenate(([0], common[:0:-1]))
    return np.maximum(_nearest_smaller(place, common, least), _nearest_smaller(place[::-1].copy(), back, least)[::-1])


def shared_starts(classes: list[tuple[bytes, tuple, tuple[int, int]]], width: int, keep_first: bool) -> list[list[tuple[int, int]]]:
    """For classes (bytes, place of the first, range of starts) of whole groups: runs of starts of the first occurrence that are removed.

    Windows are equal only within one group, so groups need no separating here: equal bytes are copies anyway.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in classes]
    order = sorted(range(len(classes)), key=lambda i: classes[i][1])  # the joined texts are in the order of places
    place, text, start, common = suffix_order([classes[i][0] for i in order], width, [classes[i][2] for i in order])
    gone = longest_previous_factors(place, common, width) >= width
    if not keep_first:  # with places counted from the other end the same arrays say what is repeated later
        gone |= longest_previous_factors(place.max(initial=0) - place, common, width) >= width
    place, text, start = (x[gone] for x in (place, text, start))
    if not len(place):
        return out
    by = np.argsort(place)
    text, start = text[by], start[by]
    breaks = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1))))
    for a, b in zip(breaks, [*breaks[1:], len(text)], strict=True):
        out[order[text[a]]].append((int(start[a]), int(start[b - 1])))
    return out


def _fetch(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The classes with their first occurrence's bytes; each text is sent once."""
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("fp", "sig", "full", "n", "off")).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__q_text", BLOCK):
            cols: list[list] = [[] for _ in range(7)]
            for text, uid, cut in zip(batch.column("__q_text").to_pylist(), batch.column("uid").to_pylist(), batch.column("cut").to_pylist(), strict=True):
                raw = text.encode()
                for c in cut:
                    row = (c["fp"], c["sig"], c["full"], c["n"], uid, c["off"], raw[c["off"] : c["off"] + c["sig"] % 256 + width - 1])
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _CLASS)

    joined = rows.select(F.col("__q_uid").alias("uid"), "__q_text").join(lists, "uid").select("uid", "__q_text", "cut")
    return joined.mapInArrow(trimmed(run), "fp long, sig int, full long, n long, uid long, off long, bytes binary")


_CLASS = ["fp", "sig", "full", "n", "uid", "off", "bytes"]
_NAMES = [*_CLASS, "lo", "hi", "part"]
_RUNS = "fp long, sig int, full long, runs array<struct<a:int,b:int>>"


_ROW = "fp long, sig int, full long, n long, uid long, off long, bytes binary, lo int, hi int, part long"


def _sorted_groups(contexts: DataFrame, width: int, keep_first: bool) -> DataFrame:
    """Runs of removed starts of each class, from the suffix orders of whole groups `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None

        def flush():
            # A window's start is the anchor's place less d.
            runs = shared_starts([(r["bytes"], (r["uid"], r["off"]), (r["sig"] // 256 - r["hi"], r["sig"] // 256 - r["lo"])) for r in held], width, keep_first)
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            cols = [pa.array([r[c] for r in held], t) for c, t in (("fp", pa.int64()), ("sig", pa.int32()), ("full", pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([[{"a": a, "b": b} for a, b in x] for x in runs], kind)], ["fp", "sig", "full", "runs"])

        for batch in batches:
            for r in batch.to_pylist():
                if size >= BLOCK and r["part"] != key:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
                key = r["part"]
        if held:
            yield flush()

    parts = contexts.repartition(partitions(contexts.sparkSession), "part").sortWithinPartitions("part", "uid", "off")
    return parts.mapInArrow(trimmed(run), _RUNS)


def _halved(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """Each class in the two parts of its group: what those windows need whose anchor is near their start, or near their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                out = []
                for r in batch.slice(at, 2048).to_pylist():
                    anchor, middle = r["sig"] // 256, (r["lo"] + r["hi"]) // 2
                    nearest = anchor - r["sig"] % 256 + 1  # the least d of the class's windows; `anchor` is the greatest
                    for lo, hi in ((r["lo"], middle), (middle + 1, r["hi"])):
                        if max(lo, nearest) <= min(hi, anchor):
                            need = r["bytes"][anchor - lo : anchor + width - hi]
                            part = xxhash.xxh3_64_intdigest(struct.pack("<qhh", r["fp"], lo, hi) + need) - (1 << 63)
                            out.append({**r, "lo": lo, "hi": hi, "part": part})
                if out:
                    yield pa.RecordBatch.from_pylist(out, batch.schema)

    return contexts.mapInArrow(trimmed(run), _ROW)


def _equal_parts(contexts: DataFrame, width: int, keep_first: bool) -> DataFrame:
    """The runs where a single d is left: each class has one window there, which is counted by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            starts = [r["sig"] // 256 - r["lo"] for r in batch.select(["sig", "lo"]).to_pylist()]
            sums = [xxhash.xxh3_128_intdigest(b[s : s + width]) for b, s in zip(batch.column("bytes").to_pylist(), starts, strict=True)]
            d, e = [(x >> 64) - (1 << 63) for x in sums], [(x & ((1 << 64) - 1)) - (1 << 63) for x in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _CLASS[:6]), pa.array(starts, pa.int32()), pa.array(d, pa.int64()), pa.array(e, pa.int64())], [*_CLASS[:6], "s", "d", "e"])

    windows = materialize(contexts.mapInArrow(trimmed(run), "fp long, sig int, full long, n long, uid long, off long, s int, d long, e long"), "windows")
    found = materialize(windows.groupBy("d", "e").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("uid", "off")).alias("first")).where(F.col("k") > 1), "equal")
    joined = windows.join(found, ["d", "e"])
    gone = joined.where(F.struct("uid", "off") > F.col("first")) if keep_first else joined
    return gone.select("fp", "sig", "full", F.array(F.struct(F.col("s").alias("a"), F.col("s").alias("b"))).alias("runs"))


def _group_runs(contexts: DataFrame, sizes: DataFrame, width: int, gram: int, keep_first: bool) -> DataFrame:
    """Runs of removed starts of each class; `sizes` has the groups `part` of more than one class and their number k."""

    def small() -> DataFrame:
        return _sorted_groups(contexts.join(sizes.where(F.col("k") <= CLASSES).select("part"), "part", "left_semi").select(*_NAMES), width, keep_first)

    out, split = small(), []
    while not (hot := sizes.where(F.col("k") > CLASSES).select("part")).isEmpty():
        contexts = contexts.join(hot, "part", "left_semi").select(*_NAMES)
        if contexts.where("lo < hi").isEmpty():
            split.append(_equal_parts(contexts, width, keep_first))
            break
        contexts = materialize(_halved(contexts, width, gram), "parts")
        sizes = materialize(contexts.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1), "sizes")
        split.append(small())
    if split:
        out = out.union(reduce(DataFrame.union, split).groupBy("fp", "sig", "full").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    return out


def removed_ranges(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_first: bool = True) -> DataFrame:
    """uid and its removed byte ranges, __q_ranges of (a, b), which may overlap; for rows with columns __q_uid and __q_text.

    What is counted by a key is written before it is joined back on that key, so that the join can split a hot one.
    """
    every = materialize(anchors(rows, width, gram), "anchors")
    twice = materialize(every.groupBy("fp").agg(F.count(F.lit(1)).alias("tot")).where(F.col("tot") > 1).select("fp"), "twice")
    found = materialize(every.join(twice, "fp"), "occurrences")
    release(every)
    release(twice)
    classes = found.groupBy("fp", "sig", "full").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "off")).alias("first"))
    classes = materialize(classes.select("fp", "sig", "full", "n", F.col("first.uid").alias("uid"), F.col("first.off").alias("off")), "classes")
    mixed = materialize(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1), "mixed")
    contexts = materialize(_fetch(rows, classes.join(mixed.select("fp"), "fp", "left_semi"), width), "contexts")
    placed = contexts.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(width - gram)).withColumn("part", F.col("fp"))
    runs = materialize(_group_runs(placed, mixed.withColumnRenamed("fp", "part"), width, gram, keep_first), "runs")
    release(contexts)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("sig") % 256 - 1).alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    of_first = F.when((F.col("n") > 1) & F.lit(not keep_first), whole).otherwise(F.coalesce("runs", none))
    answers = classes.join(runs, ["fp", "sig", "full"], "left")
    answers = answers.select("fp", "sig", "full", F.col("uid").alias("uid0"), F.col("off").alias("off0"), of_first.alias("first"), "n")
    answers = materialize(answers.where((F.col("n") > 1) | (F.size("first") > 0)), "answers")
    for t in (classes, mixed, runs):
        release(t)
    joined = found.join(answers, ["fp", "sig", "full"])
    own = (F.col("uid") == F.col("uid0")) & (F.col("off") == F.col("off0"))
    ranges = joined.select("uid", "off", F.explode(F.when(own, F.col("first")).otherwise(whole)).alias("r"))
    return ranges.select("uid", F.struct((F.col("off") + F.col("r.a")).alias("a"), (F.col("off") + F.col("r.b") + width).alias("b")).alias("r")).groupBy("uid").agg(F.collect_list("r").alias("__q_ranges"))


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: ranges that touch or overlap are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join((*parts, raw[at:]))


def dedup(docs: DataFrame, width: int = WIDTH, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, digest: bool = False) -> DataFrame:
    """All columns of docs with the text's repeated bytes removed; with digest: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes that removal leaves as half a character are dropped from the text, not from the digest.
    """
    names, rows = docs.columns, with_uid(docs, id_col)
    rows = rows.withColumn("__q_text", F.col(text_col)) if not digest else rows.select("__q_uid", F.col(id_col).alias("doc_id"), F.col(text_col).alias("__q_text"))
    ranges = removed_ranges(rows, width, gram, keep_first)
    joined = rows.join(ranges.withColumnRenamed("uid", "__q_uid"), "__q_uid", "left")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__q_text"):
            cols: list[list] = [[] for _ in range(4)]
            for text, found in zip(batch.column("__q_text").to_pylist(), batch.column("__q_ranges").to_pylist(), strict=True):
                raw, spans = (text or "").encode(), merge([(r["a"], r["b"]) for r in found or ()])
                for col, v in zip(cols, (len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__q_text"):
            made = [t if not r else _kept(t.encode(), merge([(x["a"], x["b"]) for x in r])).decode("utf-8", "ignore") for t, r in zip(batch.column("__q_text").to_pylist(), batch.column("__q_ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == text_col else batch.column(c) for c in names], names)

    if digest:
        return joined.select("doc_id", "__q_text", "__q_ranges").mapInArrow(trimmed(numbers), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return joined.select(*others, "__q_text", "__q_ranges").mapInArrow(trimmed(texts), docs.schema)
