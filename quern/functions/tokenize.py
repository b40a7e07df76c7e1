"""Tokenising contexts with a chat template, and back.

A tokenizer is made once in each worker by a factory, so that files are read there and nothing large is shipped. Ids
come with the place in the templated text where each begins, and decode to that text again. The model-free default has
an id for each UTF-8 byte; file_tokenizer() takes any file of the tokenizers library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, END = "<|im_start|>", "<|im_end|>"
BLANKS = " \t\n\r"


class Tokenizer(Protocol):
    special: dict[str, int]

    def encode_batch(self, texts: list[str]) -> list[tuple[Sequence[int], Sequence[int]]]:
        """Ids, and the character at which each begins."""

    def decode(self, ids: list[int]) -> str: ...


class ByteTokenizer:
    """An id for each byte; the template's markers follow at 256."""

    special = {BEGIN: 256, END: 257}

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        made = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        # A byte that continues a character stands at that character.
        return [(b, np.cumsum((b & 0xC0) != 0x80) - 1) for b in made]

    def decode(self, ids: list[int]) -> str:
        return bytes(ids).decode("utf-8", "replace")


class FileTokenizer:
    """A file of the tokenizers library; markers it lacks get ids past its vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        known = {m: self.library.token_to_id(m) for m in (BEGIN, END)}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.special = {m: size + k if i is None else i for k, (m, i) in enumerate(known.items())}

    def encode_batch(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        return [(e.ids, [a for a, _ in e.offsets]) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids, skip_special_tokens=False)


def byte_tokenizer() -> Callable[[], Tokenizer]:
    return ByteTokenizer


def file_tokenizer(path: str) -> Callable[[], Tokenizer]:
    return lambda: FileTokenizer(path)


def templated(turns: list[tuple[str, str]], generation: bool = True) -> list[tuple[bool, str]]:
    """A conversation as pieces: markers (True) and texts between them; contents lose blanks at both ends."""
    out = []
    for role, content in turns:
        out += [(True, BEGIN), (False, f"{role}\n{(content or '').strip(BLANKS)}"), (True, END), (False, "\n")]
    return out + ([(True, BEGIN), (False, "assistant\n")] if generation else [])


#: Characters of contents, or ids, that are worked on at once; a longer row is worked on alone.
MOST = 1 << 20


def _parts(sizes: list[int], most: int = MOST) -> Iterator[slice]:
    """Ranges of rows whose sizes sum to about `most`, or of one row."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)))


_IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])


def tokenised(turns: Column, factory: Callable[[], Tokenizer] | None = None, generation: bool = True) -> Column:
    """ids and starts of conversations: arrays of (role, content) in the template, with the opening of an answer.

    Texts are encoded together, about `MOST` characters at once, and handed on as Arrow arrays, so that a worker's memory
    follows the longest conversation. Nulls: a null conversation has no ids but the opening's; a null content is empty.
    """
    make = factory or byte_tokenizer()

    def encoded(tok: Tokenizer, part: list) -> pa.Array:
        rows = [templated([(t["role"], t["content"]) for t in ([] if c is None else c)], generation) for c in part]
        made = iter(tok.encode_batch([x for row in rows for marker, x in row if not marker]))
        all_ids, all_starts = [], []
        for row in rows:
            ids, starts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
            for marker, x in row:
                some, places = ([tok.special[x]], [0]) if marker else next(made)
                ids.append(np.asarray(some, np.int32))
                starts.append(np.asarray(places, np.int32) + at)
                at += len(x)
            all_ids.append(np.concatenate(ids))
            all_starts.append(np.concatenate(starts))
        return pa.StructArray.from_arrays([_lists(all_ids), _lists(all_starts)], ["ids", "starts"])

    @F.arrow_udf(_IDS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = make()
        for batch in batches:
            sizes = [0] * len(batch)
            texts = pc.binary_length(batch.flatten().field("content"))
            for row, n in zip(pc.list_parent_indices(batch).to_pylist(), texts.to_pylist(), strict=True):
                sizes[row] += n or 0
            for part in _parts(sizes):
                yield encoded(tok, batch[part].to_pylist())

    return run(turns)


def detokenised(ids: Column, factory: Callable[[], Tokenizer] | None = None) -> Column:
    """The templated text of ids: markers as they are written, the rest decoded between them."""
    make = factory or byte_tokenizer()

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = make()
        names = {i: m for m, i in tok.special.items()}

        def text(row: np.ndarray) -> str:
            out, after = [], 0
            for at in [*np.flatnonzero(np.isin(row, list(names))).tolist(), len(row)]:
                out += [tok.decode(row[after:at].tolist()) if at > after else "", names[int(row[at])] if at < len(row) else ""]
                after = at + 1
            return "".join(out)

        for batch in batches:
            sizes = pc.coalesce(pc.list_value_length(batch), 0)
            for part in _parts(sizes.to_pylist()):
                rows = batch[part]
                yield pa.array([text(row.values.to_numpy(zero_copy_only=False)) if row.is_valid else "" for row in rows], pa.string())

    return run(ids)


def as_user(context: Column) -> Column:
    """A context as a conversation of one turn by the user."""
    return F.array(F.struct(F.lit("user").alias("role"), context.alias("content")))
