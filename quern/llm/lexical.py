"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

A posting is a row number and an impact, the part of a score that the query doesn't change: (10^9 tf) div (1000 tf +
20 m). A first pass counts documents and terms, on which m depends; in the second a task counts the terms of its
documents and sends a packed block for each term that some item asks for. Blocks meet by term and segment and are
written as lists in order of falling impact, in parts. A segment is the work of sixteen neighbouring tasks, so the list
of a term that all documents hold lies in as many segments as the input has tasks by sixteen, each of bounded length.

A search takes three phases, for the items in blocks of some hundred. The first fetches the head of every list; the
k-th highest sum an item has from heads alone is a lower bound of its k-th score. The second divides that bound by the
item's number of terms and fetches from every list all postings that are worth at least that much: what is missing of
a list is worth less, so each document has an upper bound, and a better k-th lower bound rules most out. The third
looks up the exact scores of the rest. In the second and third a posting is sent once, to the task of its document,
however many items ask for it; that task adds up by item and passes on only what may be among an item's best.

Defined cases: a null or empty text, and one without a term, is in no list and counts neither as a document nor for
the mean length; a text of any length is read whole; rows that share a doc_id, or have none, are documents of their
own, null ids first; benchmark rows that share an item_id (a null one too) are one item with all their terms; an item
without a term that occurs has no rows; repeated terms of an item count once; ties go to the smaller doc_id; empty
tables give no rows; other columns are ignored whatever their names are.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize, numbered, partitions, slices, with_uid

TERM, K = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 50
#: Tasks whose postings of a term make one segment, postings of a part of a list, and bytes of text to a block.
TASKS, PART, SLICE = 16, 4096, 16 << 20
#: Terms up to which a task is sent the terms that are asked for; with more of them all terms are listed.
ASKED = 200_000
#: Items of a block, and postings of a bucket of documents.
ITEMS, PER_BUCKET = 512, 2_000_000
_find = re.compile(TERM).findall


class Index(NamedTuple):
    lists: DataFrame  #: term, segment, part, most (its greatest impact), uids, impacts, by falling impact
    terms: DataFrame  #: term, w
    rows: DataFrame  #: uid, doc_id


def _bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """One binary value for each stretch between two bounds."""
    raw, offsets = np.ascontiguousarray(values), (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        n = [len(_find(t.lower())) for t in _bytes(batch, "_text") if t]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))]), pa.array([sum(n)])], ["docs", "terms"])


def _blocks(n_docs: int, n_terms: int, asked: frozenset | None, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() // tasks
        for batch in slices(batches, "_text", SLICE):
            yield _block(batch, segment, n_docs, n_terms, asked)

    return run


def _block(batch: pa.RecordBatch, segment: int, n_docs: int, n_terms: int, asked: frozenset | None) -> pa.RecordBatch:
    """A block for each term of a slice that is asked for: row numbers from a base on, and impacts."""
    terms: dict[bytes, int] = {}
    at, row, tf, n = array("q"), array("q"), array("q"), []
    for i, text in enumerate(_bytes(batch, "_text")):
        found = _find(text.lower()) if text else []
        held = Counter(found if asked is None else filter(asked.__contains__, found))
        at.extend([terms.setdefault(t, len(terms)) for t in held])
        tf.extend(held.values())
        row.extend([i] * len(held))
        n.append(len(found))
    at, row, tf, n = (np.array(x, np.int64) for x in (at, row, tf, n))
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * (50 + (50 * n[row] * n_docs) // n_terms))
    order = np.argsort(at, kind="stable")
    uid = batch.column("uid").to_numpy(zero_copy_only=False)
    base = uid.min()
    bounds = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms)))])
    places = uid[row[order]] - base
    wide = len(uid) > 0 and int(uid.max()) - int(base) >= 1 << 32
    columns = [pa.array([*terms], pa.binary()).cast(pa.string()), *(pa.array([v] * len(terms), t) for v, t in ((segment, pa.int32()), (base, pa.int64()), (wide, pa.bool_())))]
    packed = [_packed(places.astype(np.int64 if wide else np.uint32), bounds), _packed(impact[order].astype(np.uint32), bounds)]
    return pa.RecordBatch.from_arrays([*columns, *packed], ["term", "segment", "base", "wide", "places", "impacts"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and impacts of all blocks, one after the other, and the number of postings of each block."""
    parts = [np.frombuffer(p, np.int64 if wide else np.uint32) + base for p, wide, base in zip(*(batch.column(c).to_pylist() for c in ("places", "wide", "base")), strict=True)]
    impact = np.frombuffer(b"".join(batch.column("impacts").to_pylist()), np.uint32).astype(np.int64)
    return np.concatenate(parts).astype(np.int64), impact, np.array([len(p) for p in parts])


def _lists_of(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _by_impact(part: int):
    """Merges the neighbouring blocks of a term and segment into a list by falling impact, cut into parts."""

    def lists(batch: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        """`new` says where a list begins."""
        uid, impact, sizes = _unpacked(batch)
        group = np.repeat(np.cumsum(new) - 1, sizes)
        order = np.lexsort((uid, -impact, group))
        group, uid, impact = group[order], uid[order], impact[order]
        start = np.searchsorted(group, np.arange(group[-1] + 1))
        rank = np.arange(len(group)) - start[group]
        bounds = np.flatnonzero(rank % part == 0)
        firsts = pa.array(np.flatnonzero(new)[group[bounds]])
        ends = np.append(bounds, len(group))
        return pa.RecordBatch.from_arrays([batch.column("term").take(firsts), batch.column("segment").take(firsts), pa.array((rank[bounds] // part).astype(np.int32)), pa.array(impact[bounds]), _lists_of(uid, ends), _lists_of(impact, ends)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the open list's blocks
        for batch in batches:
            for some in slices(iter([batch]), "places", 8 << 20):
                keys = list(zip(some.column("term").to_pylist(), some.column("segment").to_pylist(), strict=True))
                last = keys[0] if not held else (held[-1].column("term")[-1].as_py(), held[-1].column("segment")[-1].as_py())
                new = np.array([a != b for a, b in zip(keys, [last, *keys[:-1]], strict=True)])
                if new.any():  # all before the last list is whole
                    end = int(np.flatnonzero(new)[-1])
                    whole = [*held, some.slice(0, end)]
                    lead = np.zeros(sum(b.num_rows for b in held), bool)
                    yield lists(pa.Table.from_batches(whole).combine_chunks().to_batches()[0], _led(np.concatenate([lead, new[:end]])))
                    held = [some.slice(end)]
                else:
                    held.append(some)
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield lists(whole, _led(np.zeros(whole.num_rows, bool)))

    return run


def _led(new: np.ndarray) -> np.ndarray:
    new[0] = True
    return new


NAMES = ["term", "segment", "part", "most", "uids", "impacts"]


def build(docs: DataFrame, items: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", tasks: int = TASKS, part: int = PART) -> Index:
    """The index of all rows of docs, written to the shared folder: of all terms, or of those that `items` hold."""
    asked = None
    if items is not None:
        words = items.select(F.lit(0).alias("item_id"), F.col(item_text_col).alias("_text")).mapInArrow(_terms_of, "item_id int, term string").select("term").distinct()
        found = words.limit(ASKED + 1).collect()
        asked = frozenset(r[0].encode() for r in found) if len(found) <= ASKED else None
    rows = with_uid(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")))
    total = rows.select("_text").mapInArrow(_totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (x or 0 for x in total)
    blocks = rows.select(F.col("__q_uid").alias("uid"), "_text").mapInArrow(_blocks(n_docs, max(n_terms, 1), asked, tasks), "term string, segment int, base long, wide boolean, places binary, impacts binary")
    sorted_ = blocks.repartition("term", "segment").sortWithinPartitions("term", "segment")
    lists = materialize(sorted_.mapInArrow(_by_impact(part), "term string, segment int, part int, most long, uids array<long>, impacts array<long>"), "lists")
    df = lists.groupBy("term").agg(F.sum(F.size("uids")).alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return Index(lists, materialize(df.select("term", w.alias("w")), "terms"), rows.select(F.col("__q_uid").alias("uid"), "doc_id"))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        found = [list(set(_find(t.lower()))) if t else [] for t in _bytes(batch, "_text")]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())], ["item_id", "term"])


def item_terms(items: DataFrame, index: Index, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term, w: the terms of each item that can add to a score; `item` is a struct, so that a null id is a key too."""
    df = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("_text"))
    found = df.mapInArrow(_terms_of, f"item_id {df.schema['item_id'].dataType.simpleString()}, term string").select(F.struct("item_id").alias("item"), "term").distinct()
    return found.join(index.terms.where("w > 0"), "term").select("item", "term", "w")


def kth(sums: DataFrame, k: int) -> DataFrame:
    """item, bound: the k-th highest sum of each item that has so many."""
    order = Window.partitionBy("item").orderBy(F.desc("s"))
    return sums.select("item", "s", F.row_number().over(order).alias("rn")).where(F.col("rn") <= k).groupBy("item").agg(F.min("s").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")


class Asked(NamedTuple):
    """A block of items. From at[t] to at[t + 1] lie the items that hold term t, with its worth and the least impact that counts."""

    at: np.ndarray
    item: np.ndarray
    w: np.ndarray
    least: np.ndarray
    terms: np.ndarray  #: by item: its number of terms, its threshold and its lower bound
    threshold: np.ndarray
    bound: np.ndarray


def _bucket(uid: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _by_bucket(buckets: int, term: np.ndarray, uid: np.ndarray, impact: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket of documents and term."""
    bucket = _bucket(uid, buckets)
    order = np.lexsort((term, bucket))
    term, uid, impact, bucket = term[order], uid[order], impact[order], bucket[order]
    edge = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(term, prepend=-(1 << 62)) != 0))
    ends = np.append(edge, len(uid))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array(term[edge]), _lists_of(uid, ends), _lists_of(impact, ends)], ["bucket", "term", "uids", "impacts"])


DEALT = "bucket long, term long, uids array<long>, impacts array<long>"


def _dealt(least: dict[str, int] | None, numbers: dict[str, int], buckets: int):
    """Postings by the document's bucket: all of them, or those of at least the term's `least` impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(iter([batch]), "uids", 4 << 20):
                terms, sizes = some.column("term").to_pylist(), some.column("uids").value_lengths().to_numpy()
                uid, impact = some.column("uids").flatten().to_numpy(), some.column("impacts").flatten().to_numpy()
                term = np.repeat(np.array([numbers[t] for t in terms], np.int64), sizes)
                if least is not None:
                    good = impact >= np.repeat(np.array([least[t] for t in terms], np.int64), sizes)
                    term, uid, impact = term[good], uid[good], impact[good]
                yield _by_bucket(buckets, term, uid, impact)

    return run


def _candidates(buckets: int):
    """Candidates in the shape of postings: the item stands in place of the term, below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            yield _by_bucket(buckets, -1 - batch.column("item").to_numpy(), uid, np.zeros(len(uid), np.int64))

    return run


def _sums(asked: Asked, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n: int, items: range, count: bool) -> tuple[np.ndarray, np.ndarray]:
    """By item and document, the sum of what counts and, if wanted, from how many lists it comes; postings are in order of terms."""
    sums, seen = np.zeros((len(items), n), np.int64), np.zeros((len(items), n) if count else (0, 0), np.int32)
    edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for j in range(asked.at[term[a]], asked.at[term[a] + 1]):
            i = asked.item[j] - items.start
            if 0 <= i < len(items):
                good = impact[a:b] >= asked.least[j]
                d = doc[a:b][good]  # a document is in a list once
                sums[i, d] += asked.w[j] * impact[a:b][good]
                if count:
                    seen[i, d] += 1
    return sums, seen


def _added(asked: Asked, k: int, exact: bool):
    """Sums of a bucket's documents: those whose upper bound reaches the item's lower bound, or the k best of the candidates."""

    def bucket(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        term = np.repeat(whole.column("term").to_numpy(), whole.column("uids").value_lengths().to_numpy())
        uid, impact = whole.column("uids").flatten().to_numpy(), whole.column("impacts").flatten().to_numpy()
        wanted, wanted_item = uid[term < 0], -1 - term[term < 0]
        docs = np.unique(wanted if exact else uid)
        good = (term >= 0) & np.isin(uid, docs)
        term, uid, impact = term[good], uid[good], impact[good]
        if not len(term):
            return
        order = np.argsort(term, kind="stable")
        term, doc, impact = term[order], np.searchsorted(docs, uid[order]), impact[order]
        step = max(1, (4 << 20) // len(docs))
        for first in range(0, len(asked.terms), step):
            items = range(first, min(first + step, len(asked.terms)))
            sums, seen = _sums(asked, term, doc, impact, len(docs), items, not exact)
            if exact:
                mine = (wanted_item >= first) & (wanted_item < items.stop)
                item, at = wanted_item[mine], np.searchsorted(docs, wanted[mine])
                score = sums[item - first, at]
                order = np.lexsort((docs[at], -score, item))
                item, at, score = item[order], at[order], score[order]
                best = (np.arange(len(item)) - np.searchsorted(item, item) < k) & (score > 0)
                item, at, score = item[best], at[best], score[best]
                upper = score
            else:
                here = slice(first, items.stop)
                most = sums + (asked.terms[here, None] - seen) * (asked.threshold[here, None] - 1)
                item, at = np.nonzero((seen > 0) & (most >= asked.bound[here, None]))
                score, upper, item = sums[item, at], most[item, at], item + first
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(docs[at]), pa.array(score), pa.array(upper)], ["item", "uid", "s", "upper"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            at = batch.column("bucket").to_numpy()
            edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and at[a] != now:
                    yield from bucket(held)
                    held = []
                now = at[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from bucket(held)

    return run


def _heads(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """item, terms, bound: from the lists' heads, the first k of each segment's first part, the k-th highest sum or 0."""
    order = Window.partitionBy("term").orderBy(F.desc("impact"), "uid")
    first = index.lists.where(F.col("part") == 0).join(wanted.select("term").distinct(), "term", "left_semi")
    heads = first.select("term", F.explode(F.arrays_zip(F.slice("uids", 1, k).alias("uids"), F.slice("impacts", 1, k).alias("impacts"))).alias("p"))
    heads = heads.select("term", F.col("p.uids").alias("uid"), F.col("p.impacts").alias("impact")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    sums = heads.join(wanted, "term").groupBy("item", "uid").agg(F.sum(F.col("w") * F.col("impact")).alias("s"))
    size = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("terms"))
    return size.join(kth(sums, k), "item", "left").select("item", "terms", F.coalesce("bound", F.lit(0)).alias("bound"))


def _asked(wanted: list, limits: list) -> tuple[Asked, dict[str, int], dict[str, int]]:
    """The arrays of a block, terms' numbers, and the least impact of each term that some item asks for."""
    by_item = {r["item"]: (r["terms"], max(1, -(-r["bound"] // r["terms"])), r["bound"]) for r in limits}
    terms, threshold, bound = np.array([by_item[i] for i in range(len(by_item))], np.int64).T
    rows = sorted((r["term"], r["item"], r["w"]) for r in wanted)
    numbers = {t: k for k, t in enumerate(dict.fromkeys(t for t, _, _ in rows))}
    term, item, w = (np.array(x, np.int64) for x in ([numbers[t] for t, _, _ in rows], [i for _, i, _ in rows], [x for _, _, x in rows]))
    least = -(-threshold[item] // w)
    lowest: dict[str, int] = {}
    for (t, _, _), x in zip(rows, least.tolist(), strict=True):
        lowest[t] = min(x, lowest.get(t, x))
    return Asked(np.searchsorted(term, np.arange(len(numbers) + 1)), item, w, least, terms, threshold, bound), numbers, lowest


def _block_of(index: Index, wanted: DataFrame, k: int, buckets: int) -> DataFrame:
    """item, uid, score, rank for a block of items, numbered from 0."""
    asked, numbers, lowest = _asked(wanted.collect(), _heads(index, wanted, k).collect())  # a block's items and their terms
    mine = index.lists.join(wanted.select("term").distinct(), "term", "left_semi")
    met = lambda rows, a, exact: rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_added(a, k, exact), "item long, uid long, s long, upper long")

    # Parts of a list whose greatest impact is too low for every item aren't fetched.
    lowest_of = wanted.sparkSession.createDataFrame(list(lowest.items()), "term string, least long")
    deep = mine.join(lowest_of, "term").where(F.col("most") >= F.col("least"))
    seen = materialize(met(deep.select("term", "uids", "impacts").mapInArrow(_dealt(lowest, numbers, buckets), DEALT), asked, False), "seen")
    near = seen.join(kth(seen, k), "item", "left").where(F.col("upper") >= F.coalesce("bound", F.lit(0)))

    known = mine.select("term", "uids", "impacts").mapInArrow(_dealt(None, numbers, buckets), DEALT)
    exact = met(known.union(near.select("item", "uid").mapInArrow(_candidates(buckets), DEALT)), asked._replace(least=np.zeros_like(asked.least)), True)
    place = Window.partitionBy("item").orderBy(F.desc("score"), "uid")
    return exact.select("item", "uid", F.col("s").alias("score")).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text", block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents with the highest scores above 0."""
    wanted = materialize(item_terms(items, index, id_col, text_col), "items")
    known = materialize(numbered(wanted.select("item").distinct(), [F.asc("item")], "number"), "numbers")
    wanted = materialize(wanted.join(known, "item").select((F.col("number") - 1).alias("number"), "term", "w"), "terms-of-items")
    postings = index.lists.agg(F.coalesce(F.sum(F.size("uids")), F.lit(0))).first()[0]
    buckets = max(partitions(items.sparkSession), -(-postings // PER_BUCKET))
    out = wanted.limit(0).select(F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("score"), F.lit(1).alias("rank"), "number")
    for b in range(-(-known.count() // block)):
        mine = wanted.where(F.floor(F.col("number") / block) == b).select((F.col("number") - b * block).alias("item"), "term", "w")
        out = out.union(_block_of(index, mine, k, buckets).select("uid", "score", "rank", (F.col("item") + b * block + 1).alias("number")))
    return out.join(known, "number").join(index.rows, "uid").select("item.item_id", "rank", "doc_id", "score")


def oracle(k: int = K) -> str:
    """DuckDB: scores of all documents for all items."""
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH t AS (SELECT doc_id, unnest({terms}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, a GROUP BY term, n_docs),
i AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), a GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
