"""Importance resampling towards a target distribution, over hashed word-run features counted in tries.

Features are the runs of one to three consecutive words. A task keeps its partition's runs in a trie: a node is a run,
its children are the runs one word longer, and it holds how often the run was met and the CRC state of its text, which
a child extends by a blank and its word. Counting walks every document once, adds up the nodes' counts by bucket and
sends one row for each bucket; the totals of the corpus and of the target give a gain for each bucket. Scoring walks
the documents again through tries whose nodes carry the gain of their bucket. The sum of gains, with Gumbel noise from
a hash of the id, is a document's score, and the documents with the highest scores are drawn: the noise makes that a
draw without replacement in proportion to the weights.

A trie that has grown past a bound is summed up and begun anew, so a task's memory follows the bound and the longest
text, never the partition. Tables of a row for each bucket are all that passes through the driver.

Defined cases: a null or empty text, and one without a word, has no features and weight 0; a text of any length is
walked whole; rows that share a doc_id, or have none, are documents of their own with the noise of that id (a null id
counts as empty text there and comes first); ties go to the smaller doc_id, and then to the row with the fewer
features; with an empty target or an empty corpus all gains follow the same rule; empty tables give no rows; other
columns are ignored by draw(), whatever their names are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, numbered, slices

WORD, RUN, BUCKETS, SEED, LEAST_WORDS, PERCENT = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", 3, 10_000, 42, 20, 5
#: Nodes after which a task's trie is summed up and begun anew, and bytes of text between two looks at that.
NODES, SLICE = 2 << 20, 2 << 20
_find = re.compile(WORD).findall


def _one_byte() -> np.ndarray:
    """CRC-32 of one byte, from its generator polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def _apply(shift: np.ndarray, states: np.ndarray) -> np.ndarray:
    """States moved by as many bytes as `shift` stands for: it has a row of 256 for each byte of a state."""
    return shift[0][states & 255] ^ shift[1][(states >> np.uint32(8)) & 255] ^ shift[2][(states >> np.uint32(16)) & 255] ^ shift[3][states >> np.uint32(24)]


class Shifts:
    """Moves CRC states over a number of bytes, as adding text does; one table for each power of two."""

    def __init__(self):
        one, ones = _one_byte(), np.arange(256, dtype=np.uint32)
        self.tables = [np.stack([one[(s & 255)] ^ (s >> np.uint32(8)) for s in (ones << np.uint32(8 * j) for j in range(4))])]

    def moved(self, states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, bit = states.copy(), 0
        while (lengths >> bit).any():
            if bit == len(self.tables):
                self.tables.append(_apply(self.tables[-1], self.tables[-1]))
            here = np.flatnonzero((lengths >> bit) & 1)
            out[here] = _apply(self.tables[bit], out[here])
            bit += 1
        return out


class Level:
    """The nodes of one depth: sorted (parent, word) keys with their numbers, and by number the CRC state and the count."""

    def __init__(self):
        self.keys, self.numbers = np.empty(0, np.int64), np.empty(0, np.int64)
        self.crc, self.count = np.empty(0, np.uint32), np.empty(0, np.int64)

    def add(self, crc: np.ndarray) -> np.ndarray:
        new = np.arange(len(self.crc), len(self.crc) + len(crc))
        self.crc = np.concatenate([self.crc, crc])
        self.count = np.concatenate([self.count, np.zeros(len(crc), np.int64)])
        return new


class Trie:
    """Word runs of a task's documents, up to `run` words long."""

    def __init__(self, run: int = RUN):
        self.words: dict[bytes, int] = {}
        self.levels = [Level() for _ in range(run)]
        self.shifts = Shifts()
        self.tail, self.tail_length = np.empty(0, np.uint32), np.empty(0, np.int64)  # of a blank and the word

    def __len__(self) -> int:
        return sum(len(level.crc) for level in self.levels)

    def _first(self, words: list[bytes]) -> np.ndarray:
        known, at = len(self.words), self.words
        nodes = np.array([at.setdefault(w, len(at)) for w in words], np.int64)
        new = list(islice(at, known, None))
        self.levels[0].add(np.array([zlib.crc32(w) for w in new], np.uint32))
        self.tail = np.concatenate([self.tail, np.array([zlib.crc32(b" " + w) for w in new], np.uint32)])
        self.tail_length = np.concatenate([self.tail_length, np.array([len(w) + 1 for w in new], np.int64)])
        return nodes

    def _children(self, depth: int, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        level = self.levels[depth]
        keys, back = np.unique(parents << 32 | words, return_inverse=True)
        spot = np.searchsorted(level.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = spot < len(level.keys)
        known[inside] = level.keys[spot[inside]] == keys[inside]
        new, word = keys[~known], keys[~known] & 0xFFFFFFFF
        nodes = np.empty(len(keys), np.int64)
        nodes[known] = level.numbers[spot[known]]
        states = self.levels[depth - 1].crc[new >> 32]
        nodes[~known] = level.add(self.shifts.moved(states, self.tail_length[word]) ^ self.tail[word])
        level.keys, level.numbers = np.insert(level.keys, spot[~known], new), np.insert(level.numbers, spot[~known], nodes[~known])
        return nodes[back.reshape(-1)]

    def walk(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Depth, and the document and the node of each run of so many words; nodes that are missing are made."""
        found = [_find(t.lower()) if t else [] for t in texts]
        n = np.array([len(f) for f in found], np.int64)
        doc = np.repeat(np.arange(len(found)), n)
        words = self._first([w for f in found for w in f])
        yield 0, doc, words
        nodes, here = words, np.arange(len(words))
        for depth in range(1, len(self.levels)):
            inside = (here + depth < len(doc)) & (doc[np.minimum(here + depth, len(doc) - 1)] == doc[here]) if len(doc) else np.zeros(0, bool)
            here = here[inside]
            nodes = self._children(depth, nodes[inside], words[here + depth])
            yield depth, doc[here], nodes

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for level in self.levels:
            np.add.at(out, (level.crc % np.uint32(buckets)).astype(np.int64), level.count)
        return out


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("_text").cast(pa.binary()).to_pylist()


def _counts(buckets: int, run: int, most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = np.zeros(buckets, np.int64), Trie(run)
        for batch in slices(batches, "_text", SLICE):
            for depth, _, nodes in trie.walk(_texts(batch)):
                level = trie.levels[depth]
                level.count += np.bincount(nodes, minlength=len(level.count))
            if len(trie) > most:
                totals, trie = totals + trie.totals(buckets), Trie(run)
        totals += trie.totals(buckets)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], ["bucket", "n"])

    return count


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN, nodes: int = NODES) -> np.ndarray:
    """How many features of all texts fall into each bucket: a task sends a row a bucket at most, which meet summed."""
    found = docs.select(F.col(text_col).alias("_text")).mapInArrow(_counts(buckets, run, nodes), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, 1000 times the log of how much more frequent it is in the target, with one added everywhere."""
    b, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + b) / ((s + 1) * (all_t + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(gain: np.ndarray, run: int, most: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, worth = Trie(run), [np.empty(0, np.int64)] * run
        for batch in slices(batches, "_text", SLICE):
            weight, features, words = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), None
            for depth, doc, nodes in trie.walk(_texts(batch)):
                new = trie.levels[depth].crc[len(worth[depth]) :]
                worth[depth] = np.concatenate([worth[depth], gain[new % np.uint32(len(gain))]])
                np.add.at(weight, doc, worth[depth][nodes])
                n = np.bincount(doc, minlength=batch.num_rows)
                features, words = features + n, n if words is None else words
            noise = np.array([_noise(h) for h in batch.column("_h").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, features, weight, weight + noise))], ["doc_id", "n_words", "n_features", "weight", "score"])
            if len(trie) > most:
                trie, worth = Trie(run), [np.empty(0, np.int64)] * run

    return score


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, seed: int = SEED, nodes: int = NODES) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), h.alias("_h"))
    return df.mapInArrow(_scores(gain, run, nodes), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def cut(scored: DataFrame, k: int, bins: int = 4096) -> int:
    """A score that the k highest rows reach and not many others: the bin of the k-th is split until it is small."""
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    above = 0
    while True:
        width = (high - low) // bins + 1
        at = F.floor((F.col("score") - F.lit(low)) / F.lit(width)).cast("int")
        held = dict(scored.where(F.col("score").between(low, high)).groupBy(at.alias("b")).count().collect())  # `bins` rows at most
        for b in sorted(held, reverse=True):
            if above + held[b] >= k:
                break
            above += held[b]
        if width == 1 or above + held[b] <= 2 * k:
            return low + b * width
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, and rank from 1 for the floor(percent * N / 100) rows drawn of N that are long enough.

    Only rows from about the last drawn score on are sorted, in ranges.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, target_col, buckets, run))
    scored = materialize(score(docs, gain, id_col, text_col, run, seed), "scored")
    out = ["doc_id", "n_features", "weight", "score"]
    fit = scored.where(F.col("n_words") >= least_words)
    k = fit.count() * percent // 100
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    near = (F.col("n_words") >= least_words) & (F.col("score") >= cut(fit, k))
    ranked = numbered(scored.where(near), [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features")])
    drawn = ranked.select(*out, F.when(F.col("__q_rank") <= k, F.col("__q_rank")).alias("rank"))
    return drawn.union(scored.where(~near).select(*out, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of docs with all their columns, and __q_rank; ids must be unique and not null."""
    ranks = draw(docs, target, **settings).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("__q_id"), F.col("rank").alias("__q_rank"))
    return docs.join(ranks, F.col(f"`{settings.get('id_col', 'doc_id')}`") == F.col("__q_id")).drop("__q_id")
