"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's bag holds the word and its character n-grams, each hashed to a bucket with an embedding, so a misspelling
nobody has seen shares most of its vectors with the words it comes from. A window's vector is the mean over the bags
of its words; a linear softmax over it and all embeddings are trained together by gradient descent. A text's score is
that of its worst window, so that a few words count in a long text as much as in a short one. Training labels are of
texts: after some steps over all windows only each text's worst ones, as the model sees them at that time, are learned
from, which is what a text is scored by. Last, the scale is set so that 0.7 parts the classes best on a fifth of the sample that was not fitted.

The fit takes at most `sample` labelled rows of each class, chosen by a hash of the id, and every window of each;
scoring reads every text whole.

Defined cases: a null text or one without letters has no window and the score of an empty window; a text or word of any
length counts whole; without two classes to learn from all scores are 0; repeated rows get equal results, as do texts
of the same words; a null id is never held out and never learned from; an empty table gives no rows; other columns are
ignored, so their names may clash with the result's.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import slices

BUCKETS, DIM, WINDOW, SAMPLE, LIMIT = 1 << 16, 6, 4, 1500, 0.7
_WORDS = re.compile(r"[^\W\d_]+")
_LOGIT = float(np.log(LIMIT / (1 - LIMIT)))


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def bag(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its 3- and 4-grams, with marks for its ends."""
    marked, crc = f"<{word}>", zlib.crc32
    found = [crc(marked[i : i + n].encode("utf-8", "replace")) % buckets for n in (3, 4) for i in range(len(marked) - n + 1)]
    found.append(crc(f"={word}".encode("utf-8", "replace")) % buckets)
    return found


def _ranges(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... for each size in turn."""
    begin = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(at - begin, sizes)


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, weights=rows[:, k], minlength=n) for k in range(rows.shape[1])], axis=1)


def fit(texts: Iterable[list[list[str]]], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, first: int = 20, steps: int = 60, seed: int = 1) -> tuple[np.ndarray, float, float]:
    """From texts as lists of windows of words: each bucket's margin, the bias, and the scale.

    `first` steps over all windows, each text's windows sharing its weight, then `steps` over the worst windows alone.
    """
    if len(set(labels)) < 2:
        return np.zeros(buckets, np.float32), -40.0, 1.0
    held = np.arange(len(labels)) % 5 == 4
    if len({y for y, h in zip(labels, held, strict=True) if not h}) < 2:
        held[:] = False
    vocabulary: dict[str, int] = {}
    words, sizes, owners = array("i"), array("i"), array("i")
    for t, windows in enumerate(texts):
        for w in windows:
            words.extend(vocabulary.setdefault(x, len(vocabulary)) for x in w)
            sizes.append(len(w))
            owners.append(t)
    subs, counts = array("i"), array("i")
    for w in vocabulary:
        found = bag(w, buckets)
        subs.extend(found)
        counts.append(len(found))
    del vocabulary
    words, sizes, owner, subs, sub_n = (np.array(x, np.int64) for x in (words, sizes, owners, subs, counts))
    label, window_at = np.array(labels), np.cumsum(sizes) - sizes
    sub_at, word_of_sub = np.cumsum(sub_n) - sub_n, np.repeat(np.arange(len(sub_n)), sub_n)
    subwords = np.maximum(np.add.reduceat(sub_n[words], window_at), LEAST)
    text_at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    place = np.arange(len(owner)) - np.repeat(text_at, np.diff(np.append(text_at, len(owner))))
    embed = np.random.default_rng(seed).normal(0, 0.01, (buckets, dim))
    out, bias = np.stack([np.linspace(-1, 1, dim), -np.linspace(-1, 1, dim)], axis=1) * 0.5, np.zeros(2)

    def margins() -> np.ndarray:
        by_word = np.add.reduceat((embed @ (out[:, 1] - out[:, 0]))[subs], sub_at)
        return np.add.reduceat(by_word[words], window_at) / subwords + bias[1] - bias[0]

    class Batch:
        """Some windows, weighed so that each class counts half, each text of a class alike."""

        def __init__(self, pick: np.ndarray):
            self.y, n = label[owner[pick]], subwords[pick][:, None]
            own = np.bincount(owner[pick], minlength=len(label))
            sides = [max(1, int(((own > 0) & (label == y)).sum())) for y in (0, 1)]
            self.weight, self.n = (0.5 / np.array(sides)[self.y] / own[owner[pick]])[:, None], n
            self.items, self.at = words[_ranges(window_at[pick], sizes[pick])], np.cumsum(sizes[pick]) - sizes[pick]
            self.window = np.repeat(np.arange(len(pick)), sizes[pick])

        def spread(self, rows: np.ndarray) -> np.ndarray:
            """A row for each window, summed over the buckets of its words."""
            return _scatter(subs, _scatter(self.items, (rows / self.n)[self.window], len(sub_n))[word_of_sub], buckets)

        def grads(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            mean = np.add.reduceat(np.add.reduceat(embed[subs], sub_at, axis=0)[self.items], self.at, axis=0) / self.n
            z = mean @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(self.y)), self.y] -= 1
            p *= self.weight
            return self.spread(p @ out.T), mean.T @ p, p.sum(axis=0)

    every = Batch(np.flatnonzero(~held[owner]))
    # A bucket's first steps are its share of toxic mass, damped where there is little mass: rare is not yet telling.
    mass = every.spread(every.weight) + DAMP / len(every.y) / 60
    speed = [np.zeros_like(p) for p in (embed, out, bias)]
    for _ in range(first):
        found = every.grads()
        for move, grad, rate in zip(speed, (found[0] / mass, *found[1:]), (RATE, 0.2, 0.2), strict=True):
            move *= 0.5
            move += 0.5 * rate * grad
        embed, out, bias = (p - move for p, move in zip((embed, out, bias), speed, strict=True))
    # The step of a bucket that few texts hold stays short here too: `floor` is the gradient of RARE texts.
    floor = RARE * 0.5 / max(1, int((label[~held] == 1).sum())) / LEAST * float(np.abs(out).mean())
    sums = [np.zeros_like(p) for p in (embed, out, bias)]
    for _ in range(steps):
        order = np.lexsort((-margins(), owner))
        worst = (place < np.where(label[owner] == 1, 1, 2)) & ~held[owner]  # of a toxic text its worst window, of others two
        new = []
        for p, grad, total, rate, least in zip((embed, out, bias), Batch(order[worst]).grads(), sums, (0.2, 0.04, 0.04), (floor, 1e-8, 1e-8), strict=True):
            total += grad * grad
            new.append(p - rate * grad / (np.sqrt(total) + least))
        embed, out, bias = new
    worst = np.full(len(labels), -np.inf)
    np.maximum.at(worst, owner, margins())
    judged = np.isfinite(worst) & (held if held.any() else True)
    cut, gap = _best_cut(worst[judged], label[judged])
    scale = min(20.0, 4.0 / max(gap, 0.05))
    return (embed @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0] - cut), scale


def _best_cut(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Where to cut for the best F1, in the middle of the gap there, and how wide half the classes' distance is."""
    order = np.argsort(-values, kind="stable")
    v, y = values[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, int(y.sum())))
    best = int(np.argmax(f1))
    below = v[best + 1] if best + 1 < len(v) else v[best] - 1.0
    spread = abs(float(np.median(values[labels == 1])) - float(np.median(values[labels == 0]))) / 2 if len(set(labels.tolist())) == 2 else 1.0
    return float(v[best] + below) / 2, spread


#: Step length; how many windows' mass, and later how many texts, a bucket must have to take half a step.
RATE, DAMP, RARE = 100.0, 300.0, 3.0
#: A window's mean is over at least so many subwords, so that a short one isn't judged by one word alone.
LEAST = 24


def windows_of(words: list[str], window: int = WINDOW) -> list[list[str]]:
    """The distinct words of runs of `window` words; the last run reaches back to be as long as the others."""
    return [list(dict.fromkeys(words[i : i + window])) for i in starts(len(words), window)]


def starts(n: int, window: int = WINDOW) -> list[int]:
    full = list(range(0, n - window + 1, window))
    return full + [max(0, n - window)] * (not full or full[-1] + window < n) if n else []


class Scorer:
    def __init__(self, margins: np.ndarray, bias: float, scale: float, window: int = WINDOW, most: int = 400_000):
        self.margins, self.bias, self.scale, self.window, self.most = margins, bias, scale, window, most
        self.known: dict[str, tuple[float, int]] = {}

    def _word(self, w: str) -> tuple[float, int]:
        found = bag(w, len(self.margins))
        made = float(self.margins[found].sum()), len(found)
        if len(self.known) < self.most:
            self.known[w] = made
        return made

    def score(self, text: str | None) -> float:
        words, known = words_of(text), self.known
        z = 0.0
        if words:
            pairs = [known.get(w) or self._word(w) for w in words]
            z = -1e9
            for i in starts(len(words), self.window):
                run = words[i : i + self.window]
                total = n = 0
                for a, b in pairs[i : i + self.window] if len(set(run)) == len(run) else [pairs[i + run.index(w)] for w in dict.fromkeys(run)]:
                    total += a
                    n += b
                z = max(z, total / max(n, LEAST))
        return 1 / (1 + float(np.exp(-min(60.0, max(-60.0, self.scale * (z + self.bias) + _LOGIT)))))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float, float]:
    """Fits on the rows of `labels`, at most `sample` of each class."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = [" ".join(words_of(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("_h"), pa.array(texts, pa.string())], ["y", "h", "words"])

    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).distinct()
    known = known.withColumn("_h", F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity")))
    picked = known.where("y = 1").orderBy("_h", "_id").limit(sample).union(known.where("y = 0").orderBy("_h", "_id").limit(sample))
    # At most 2 * sample ids and labels: a bounded broadcast.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).join(F.broadcast(picked), "_id")
    # One row for each labelled id, the least of its texts: repeated rows can't push out others, and what is collected is bounded.
    texts = texts.groupBy("_id", "y", "_h").agg(F.min("_text").alias("_text"))
    rows = texts.select("y", "_h", "_text").mapInArrow(cut, "y int, h long, words string").collect()
    rows = sorted((r for r in rows if r["words"]), key=lambda r: (r["h"], r["y"], r["words"]))
    return fit((windows_of(r["words"].split(" ")) for r in rows), [r["y"] for r in rows])


def predict(docs: DataFrame, model: tuple[np.ndarray, float, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in slices(batches, "_text"):
            scores = [scorer.score(t) for t in batch.column("_text").to_pylist()]
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= LIMIT) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    df = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every row."""
    return predict(docs, learn(docs, labels.where(~held_out("doc_id"))))
