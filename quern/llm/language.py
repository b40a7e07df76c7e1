"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the product of its letters' vectors, each rolled
by its distance from the n-gram's end (binding by permutation); a text's profile is the sum of its n-gram vectors
(bundling). A language's prototype is the sum of its documents' profiles, each scaled to length one. The language whose prototype has the greatest cosine with a text's profile wins.

Prototypes are learned from at most about `sample` labelled rows of each language (a documented bound, chosen by a hash
of the id), so that a rare language is learned from all its rows at any size; the pipeline learns from all rows. On demand the same rows also give limits:
for a language's texts of about one length (a power of two of letters) the cosine with it that all but a thousandth of
them reach, less a fifth; texts of fewer than 32 letters have no limit. What is below is like no language that was learned: random letters, keys, encoded bytes.

Letters are told apart by their lower-case code point modulo 4095, so that few letters of very distant scripts share a
vector; n-grams of three keep such texts apart.

Defined cases: a text that is null or has no letter is `und` with score 0; so is everything if nothing was learned.
Equal cosines go to the first language by name. Repeated rows get equal results; very long texts are read whole, in
blocks; a row without id is never learned from and not held out; an empty table gives no rows; other columns are
ignored, or kept whatever their names are but for __q_lang, __q_score, __q_least and __q_letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import kept, slices, trimmed

DIM, GRAM, SAMPLE, SEED = 512, 3, 5000, 7
#: Limits: the share of texts that may lie below, the part of that cosine that is asked for, texts for a limit, and the
#: least length class that is judged (32 letters; what is shorter can't be told from junk); no limit is above MOST.
BELOW, PART, LEAST_TEXTS, LEAST_CLASS, MOST = 0.001, 0.8, 20, 6, 0.3
_ITEMS, _BLOCK, _SCALE = 4096, 4096, 1 << 20


def _letters() -> np.ndarray:
    """Code point to letter number: lower case, 0 for what is no letter."""

    def make() -> np.ndarray:
        made = np.zeros(0x110000, np.uint16)
        for c in range(0x32400):
            if (ch := chr(c)).isalpha():
                made[c] = 1 + ord(ch.lower()[0]) % (_ITEMS - 1)
        return made

    return kept("language", "letters", make)


def _items(dim: int, seed: int) -> list[np.ndarray]:
    """The letters' vectors, rolled by 0, 1, ... places."""

    def make() -> list[np.ndarray]:
        base = np.random.default_rng(seed).integers(0, 2, (_ITEMS, dim), dtype=np.int8) * 2 - 1
        return [np.roll(base, k, axis=1) for k in range(GRAM)]

    return kept("language", (dim, seed), make)


def profile(text: str | None, dim: int = DIM, seed: int = SEED) -> np.ndarray | None:
    """A text's bundle of n-gram vectors, of length one; None if it has no letter."""
    if not text:
        return None
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    letter = codes != 0
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap for each run of other characters
    codes = np.concatenate(([0], codes[keep], [0])).astype(np.int64)
    grams, counts = np.unique((codes[:-2] << 24) | (codes[1:-1] << 12) | codes[2:], return_counts=True)
    two, one, zero = _items(dim, seed)[2], _items(dim, seed)[1], _items(dim, seed)[0]
    total = np.zeros(dim, np.float32)
    for at in range(0, len(grams), _BLOCK):
        g = grams[at : at + _BLOCK]
        bound = two[g >> 24] * one[(g >> 12) & 4095]
        bound *= zero[g & 4095]
        total += counts[at : at + _BLOCK].astype(np.float32) @ bound.astype(np.float32)
    size = float(np.sqrt((total.astype(np.float64) ** 2).sum()))
    return total / size if size else None


def fold(docs_id) -> F.Column:
    return F.crc32(docs_id.cast("string"))


class Model(NamedTuple):
    """Languages, their prototypes, and the least cosine by language and length class (the bit length of the number of letters)."""

    langs: list[str]
    prototypes: np.ndarray
    limits: np.ndarray


def length_class(text: str | None) -> int:
    if not text:
        return 0
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return int((_letters()[codes] != 0).sum()).bit_length()


def learn(docs: DataFrame, sample: int | None = SAMPLE, dim: int = DIM, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: bool = False) -> Model:
    """Languages and their prototypes, from the rows of `docs` that have an id, a text and a language; with `sample` None from all of them.

    Sums are of whole numbers, so they don't depend on the order in which partitions arrive.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("__q_text"))
    # One number for each language: as many rows as there will be prototypes.
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model([], np.zeros((0, dim), np.float32), np.zeros((0, 64)))
    if not counts:
        return none
    picked = labelled.select("lang", "__q_text")
    if sample is not None:
        share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, sample / n) * (1 << 20)))))
        picked = labelled.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 20)) < F.element_at(share, F.col("lang"))).select("lang", "__q_text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "__q_text"):
            for text, lang in zip(batch.column("__q_text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (p := profile(text, dim, seed)) is not None:
                    held = sums.setdefault(lang, np.zeros(dim, np.int64))
                    held += np.rint(p * _SCALE).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "vec"])

    parts = picked.mapInArrow(trimmed(bundle), "lang string, vec array<bigint>")
    sums = parts.select("lang", F.posexplode("vec").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("vec")).orderBy("lang").collect()
    if not rows:
        return none
    made = np.array([[x["v"] for x in r["vec"]] for r in rows], np.float64)
    made /= np.maximum(np.sqrt((made**2).sum(axis=1, keepdims=True)), 1e-12)
    model = Model([r["lang"] for r in rows], made.astype(np.float32), np.zeros((len(rows), 64)))
    return model._replace(limits=_limits(picked, model, seed)) if limits else model


def _limits(picked: DataFrame, model: Model, seed: int) -> np.ndarray:
    """The least cosines, from counts of each class's cosines in steps of 1/1000; a class of few texts has the limit of
    the next shorter one."""
    at = {lang: k for k, lang in enumerate(model.langs)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__q_text"):
            rows: list[list[int]] = [[], [], []]
            for text, lang in zip(batch.column("__q_text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (p := profile(text, model.prototypes.shape[1], seed)) is not None:
                    cos = max(0.0, float(model.prototypes[at[lang]] @ p))
                    for column, value in zip(rows, (at[lang], length_class(text), int(cos * 1000)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in rows], ["lang", "size", "cos"])

    counts = np.zeros((len(at), 64, 1101), np.int64)  # what is collected is bounded by this table
    for r in picked.mapInArrow(trimmed(judge), "lang int, size int, cos int").groupBy("lang", "size", "cos").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["lang"], r["size"], r["cos"]] = r["n"]
    out = np.zeros((len(at), 64))
    for lang in range(len(at)):
        for size in range(LEAST_CLASS, 64):
            n = counts[lang, size].sum()
            out[lang, size] = out[lang, size - 1] if n < LEAST_TEXTS else min(MOST, PART * int(np.argmax(np.cumsum(counts[lang, size]) > BELOW * n)) / 1000)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; with `keep`, those columns of docs and __q_lang, __q_score, __q_least and __q_letters."""
    langs, made, limits = model
    dim, at = made.shape[1], {lang: k for k, lang in enumerate(model.langs)}

    def guess(texts: list) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            p = profile(text, dim, seed) if langs else None
            if p is None:
                names.append("und")
                scores.append(0.0)
                continue
            cos = made @ p
            best = int(np.argmax(cos))
            names.append(langs[best])
            scores.append(float(min(1.0, max(0.0, cos[best]))))
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            names, scores = guess(texts)
            columns = [*(batch.column(c) for c in out), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if keep is not None:
                sizes = [length_class(t) for t in texts]
                columns += [pa.array([limits[at[lang], n] if lang in at else 0.0 for lang, n in zip(names, sizes, strict=True)], pa.float64()), pa.array([n > 0 for n in sizes], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    if keep is None:
        held = F.coalesce(fold(F.col(id_col)) % 4 == 2, F.lit(False)).alias("held_out")
        df, text, out, more = docs.select(F.col(text_col).alias("__q_text"), F.col(id_col).alias("doc_id"), held), "__q_text", ["doc_id", "held_out"], "lang_pred string, score double"
    else:
        df, text, out, more = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col]))), text_col, list(keep), "__q_lang string, __q_score double, __q_least double, __q_letters boolean"
    schema = T.StructType([*(df.schema[c] for c in out), *T.StructType.fromDDL(more)])
    return df.mapInArrow(trimmed(run), schema)


def learning_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that may be learned from."""
    return docs.where(fold(F.col(id_col)) % 4 != 2)
