"""Token-array expressions: windows, splits, masks, padding, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, also where an inner lambda asks for it again with each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(tok: Column, size: int = 480, overlap: int = 80, cap: int | None = 512) -> Column:
    """Overlapping windows of at most `size` tokens over the first `cap` (None: all)."""

    def cut(kept: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(kept) - 1, F.lit(size - overlap))
        return F.when(F.size(kept) > 0, F.transform(starts, lambda s: F.slice(kept, s + 1, size)))

    return once(tok if cap is None else F.slice(tok, 1, cap), cut)


def even_split(tok: Column, most: int) -> Column:
    """As few chunks of equal size as fit `most`; the last may be shorter."""

    def cut(t: Column) -> Column:
        size = F.ceil(F.size(t) / F.ceil(F.size(t) / most)).cast("int")
        return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.size(t) - 1, size), lambda s: F.slice(t, s + 1, size)))

    return once(tok, cut)


def affixed(chunks: Column, prefix: list[str], suffix: list[str]) -> Column:
    """The first chunk gets the prefix, the last the suffix."""
    pre, suf = F.array(*map(F.lit, prefix)), F.array(*map(F.lit, suffix))
    empty = F.array().cast("array<string>")
    return once(chunks, lambda cs: F.transform(cs, lambda c, i: F.concat(F.when(i == 0, pre).otherwise(empty), c, F.when(i == F.size(cs) - 1, suf).otherwise(empty))))


def truncate_middle(tok: Column, most: int, new_tokens: int = 256) -> Column:
    """Head and tail halves where the array is longer than `most`, leaving room for new tokens."""
    half = most // 2 - new_tokens // 2
    return F.when(F.size(tok) > most, F.concat(F.slice(tok, 1, half), F.slice(tok, -half, half))).otherwise(tok)


def labels_of(ids: Column, start: Column, end: Column) -> Column:
    span = F.struct(start.alias("a"), end.alias("b"))
    return once(span, lambda s: F.transform(ids, lambda x, i: F.when((i >= s["a"]) & (i < s["b"]), x).otherwise(F.lit(IGNORE))))


def position_ids(parts: Column) -> Column:
    """Positions that restart in each part."""
    return F.flatten(F.transform(parts, lambda p: F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))))


def padded(a: Column, n: Column | int, pad: Column, left: bool = False) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    fill = F.array_repeat(pad, F.greatest(n - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def fixed_length(a: Column, n: int, pad: Column) -> Column:
    return F.slice(F.concat(a, F.array_repeat(pad, n)), 1, n)


def repeated_to(a: Column, n: int) -> Column:
    return F.slice(F.flatten(F.array_repeat(a, F.ceil(F.lit(n) / F.size(a)).cast("int"))), 1, n)


def subsequence_starts(a: Column, pattern: Column) -> Column:
    """Where `pattern` starts in `a`, from 0."""
    last = F.size(a) - F.size(pattern)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(a, i + 1, F.size(pattern)) == pattern)).otherwise(F.array().cast("array<int>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def mean_pool(vectors: Column) -> Column:
    return F.transform(F.element_at(vectors, 1), lambda _, k: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.element_at(v, k + 1).cast("double")) / F.size(vectors))


def max_pool(vectors: Column) -> Column:
    return F.transform(F.element_at(vectors, 1), lambda _, k: F.array_max(F.transform(vectors, lambda v: F.element_at(v, k + 1))))


def pooled(vectors: Column, kind: str) -> Column:
    """One vector of several token vectors: `mean`, `max`, `last` or `cls`, the first; another kind raises."""
    kinds = {"mean": mean_pool, "max": max_pool, "last": lambda v: F.element_at(v, -1), "cls": lambda v: F.element_at(v, 1)}
    if kind not in kinds:
        raise ValueError(f"no pooling: {kind}; known are {', '.join(kinds)}")
    return F.transform(kinds[kind](vectors), lambda x: x.cast("double"))


def max_sim(query: Column, passage: Column) -> Column:
    """Late interaction: each query vector's best passage vector, summed."""
    return F.aggregate(query, F.lit(0.0), lambda s, q: s + F.array_max(F.transform(passage, lambda p: dot(q, p))))


def sparse_weight(logit: Column) -> Column:
    return F.log1p(F.greatest(logit, F.lit(0.0)))


def word_ids(tok: Column, size: int = 50_000) -> Column:
    """Ids of words without a vocabulary: a hash of each."""
    from quern.functions.text import hash_int

    return F.transform(tok, lambda w: hash_int(w, "id", F.lit(size)))


def fixed_chunks(ids: Column, size: int, stride: int, pad: int = 0) -> Column:
    """Chunks of `size` ids that overlap by `stride`, the last ones padded, each with its attention mask."""
    chunks = windows(ids, size, stride, None)
    return F.transform(chunks, lambda c: F.struct(fixed_length(c, size, F.lit(pad).cast("long")).alias("ids"), fixed_length(F.transform(c, lambda _: F.lit(1)), size, F.lit(0)).alias("mask")))


def marked_labels(ids: Column, begin: int, role: int, newline: int, end: int) -> Column:
    """Labels by scanning for turn markers: what follows (begin, role, newline) up to and with the next `end`; -100 elsewhere."""

    def scan(ids: Column) -> Column:
        opens = F.filter(subsequence_starts(ids, F.array(*(F.lit(x).cast("long") for x in (begin, role, newline)))), lambda i: i.isNotNull())
        ends = F.filter(F.transform(ids, lambda x, i: F.when(x == end, i)), lambda i: i.isNotNull())
        spans = F.transform(opens, lambda s: F.struct((s + 3).alias("a"), F.coalesce(F.array_min(F.filter(ends, lambda e: e >= s + 3)), F.size(ids)).alias("b")))
        labelled = F.transform(F.array(spans), lambda sp: F.transform(ids, lambda x, i: F.when(F.exists(sp, lambda p: (i >= p["a"]) & (i <= p["b"])), x).otherwise(F.lit(IGNORE).cast("long"))))
        return F.element_at(labelled, 1)

    return F.element_at(F.transform(F.array(ids), scan), 1)


def spliced(ids: Column, at: Column, length: Column | int, insert: Column) -> Column:
    """`length` elements from place `at` (from 0) replaced by `insert`; unchanged where `at` is null."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.when(at.isNull(), ids).otherwise(F.concat(F.slice(ids, F.lit(1), at), insert, F.slice(ids, at + n + 1, F.size(ids))))


def logit_places(labels: Column) -> Column:
    """Places whose logits predict a label: one before each label that isn't ignored."""
    return F.filter(F.transform(labels, lambda x, i: F.when((x != IGNORE) & (i > 0), i - 1)), lambda i: i.isNotNull())


def offsets(lengths: Column) -> Column:
    """0 and the running sums of an array of lengths."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
