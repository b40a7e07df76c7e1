"""Packing by Karmarkar-Karp multiway differencing.

A document's ids, with the end id, are cut into full windows, a body of a multiple of `grain` ids and a tail of fewer.
Pieces are dealt by a hash into buckets, and a bucket's pieces into groups of bounded size. In a group every piece starts as a partial partition of
k windows of which one holds it; the two partial partitions with the greatest differences between their fullest and
emptiest windows are merged, the fullest window of one with the emptiest of the other, until one partition is left.
k starts at the least possible number of windows and rises whenever a window exceeds the capacity.

Defined cases: a null or empty text is the end id alone; a text of any length is cut, never dropped; repeated rows
are packed like any other; ties go to the earlier piece; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import kept, slices, trimmed

VOCABULARY, CAPACITY, GRAIN, GROUP, END = "byte_bpe_50k.json", 1024, 64, 384, 0
#: Documents to a bucket, of which a task packs one after the other.
PER_BUCKET = 2048
#: All but the characters for which both libraries' patterns are known to agree (letters and signs up to U+024F).
_PLAIN = re.compile("[^\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


class FastTokenizer:
    """The tokenizers library's ids of whole texts.

    Texts of plain characters go to tiktoken with the same vocabulary as ranks, which gives the same ids several
    times faster; all others, and those with a special string, go to the tokenizers library itself.
    """

    def __init__(self, name: str):
        import base64
        import json
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        plain = [not _PLAIN.search(t) and not any(s in t for s in self.special) for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self.plain.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]


def tokenizer(name: str) -> FastTokenizer:
    return kept("packing", name, lambda: FastTokenizer(name))


def cuts(total: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, a body that is a multiple of `grain`, a tail below it.

    Tails are what lets differencing even the windows out; bodies keep documents together.
    """
    full, rest = divmod(total, capacity)
    lengths = [capacity] * full + [n for n in (rest - rest % grain, rest % grain) if n]
    out, at = [], 0
    for n in lengths:
        out.append((at, n))
        at += n
    return out


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Items by window after multiway differencing over k windows."""
    heap = []
    for i, n in enumerate(sizes):
        heap.append((-n, i, [n] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]))  # windows fall in size
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        order = sorted(range(k), key=lambda w: -sums[w])
        fell = [sums[w] for w in order]
        sets = [at[w] + bt[k - 1 - w] for w in order]
        heapq.heappush(heap, (fell[-1] - fell[0], i, fell, sets))
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most `capacity`, as few as differencing allows."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        made = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in made) <= capacity:
            return [w for w in made if w]
        k += 1


def _pieces(vocabulary: str, capacity: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in slices(batches, "_text"):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, ids in enumerate(tok.encode_batch([t or "" for t in batch.column("_text").to_pylist()])):
                raw = np.array([*ids, END], "<u4").tobytes()
                for start, n in cuts(len(ids) + 1, capacity, grain):
                    rows.append(i)
                    starts.append(start)
                    lengths.append(n)
                    sums.append(zlib.crc32(raw[4 * start : 4 * (start + n)]))
                    totals.append(len(ids) + 1)
            numbers = [pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *numbers], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _packed(capacity: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the open group's rows
        bucket, count, sequence = None, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sizes = rows.column("length").to_pylist()
            ids, offsets = [0] * len(sizes), [0] * len(sizes)
            rest = [i for i, n in enumerate(sizes) if n < capacity]
            for window in [*([i] for i, n in enumerate(sizes) if n >= capacity), *([rest[i] for i in w] for w in windows([sizes[i] for i in rest], capacity))]:
                at = 0
                for i in window:
                    ids[i], offsets[i] = (bucket << 32) + sequence, at
                    at += sizes[i]
                sequence += 1
            out = [rows.column(c) for c in NAMES[:5]]
            return pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], NAMES)

        for batch in batches:
            buckets, small = batch.column("_bucket").to_pylist(), batch.column("length").to_numpy() < capacity
            begin = 0
            for i, b in enumerate(buckets):
                if b != bucket or count >= group:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if held:
                        yield flush()
                    held, begin, count = [], i, 0
                    if b != bucket:
                        bucket, sequence = b, 0
                count += int(small[i])
            if len(buckets) > begin:
                held.append(batch.slice(begin))
        if held:
            yield flush()

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, grain: int = GRAIN, group: int = GROUP) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, from which place.

    Texts are tokenised where they are read; only a narrow row per piece is shuffled.
    """
    spark = docs.sparkSession
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PER_BUCKET)))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    pieces = df.mapInArrow(trimmed(_pieces(vocabulary, capacity, grain)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length"), F.lit(buckets)))
    pieces = pieces.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "doc_id", "start", "ids_crc32", "doc_tokens")
    return pieces.mapInArrow(trimmed(_packed(capacity, group)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long")
