"""Pluggable encoders: any function from texts to vectors, with a deterministic model-free default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(dim: int = 64) -> Encoder:
    """Signed feature hashing of lower-cased words, scaled to length one."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
            size = float(np.sqrt((row**2).sum()))
            if size:
                row /= size
        return out

    return encode


def encode(text: Column, factory: Callable[[], Encoder] | None = None, prefix: str = "", batch: int = 64) -> Column:
    """Vectors of texts. `factory` makes a worker's model once; it is asked for `batch` texts at a time, longest first.

    Texts of about one length come together, so that a model that pads wastes little. `prefix` is the role, as in
    `query: `; a null text is an empty one.
    """
    make = factory or hashed_words

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            rows = [prefix + (t or "") for t in texts]
            order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
            out: list = [None] * len(rows)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                for i, v in zip(some, model([rows[i] for i in some]), strict=True):
                    out[i] = v
            yield pd.Series(out, dtype="object")

    return vectors(text)


def bridge_phrases(text: Column, stop: tuple[str, ...]) -> Column:
    """Phrases of a text, with repeats: runs of words between signs and stop words, lower-cased, at most four words each.

    Longer runs are no phrases. Single words of fewer than three characters are none either.
    """
    parted = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N} \\t\\n\\r]+", " \u0001 ")
    words = F.transform(F.split(parted, "[ \\t\\n\\r]+"), lambda w: F.when(w.isin(*stop), "\u0001").otherwise(w))
    runs = F.transform(F.split(F.array_join(words, " "), "\u0001"), lambda r: F.trim(r))
    return F.filter(runs, lambda r: (F.length(r) > 2) & (F.size(F.split(r, " ")) <= 4))


def bridge_terms(tok: Column, stop: list[str], most: int = 24) -> Column:
    """Terms for a follow-up query: distinct words that are long and no stop words, longest first."""
    words = F.filter(F.array_distinct(F.transform(tok, F.lower)), lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    return F.slice(F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"]), 1, most)
