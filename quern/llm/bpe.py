"""BPE encoding and decoding by tree concatenation.

A text is normalised as the vocabulary file says and cut, halving again and again and wherever the middle falls, into
leaves of at most `leaf` characters. No leaf depends on another: all of a batch go to the encoder together, which may
use as many threads as `threads` says. Two neighbours are then joined bottom-up: a window around the join is encoded
again and grows until its first token equals the left side's token at that place and one of its inner tokens equals
the right side's. Since every pair of neighbouring tokens then comes from a true encoding, the whole is exact: a
token sequence is the BPE of its text when every neighbouring pair is. Leaves are short, so most documents are trees.

`cache` is how many distinct words keep their ids between leaves, as white space, which this vocabulary drops, parts
words for good; with 0 each leaf and each window goes to the library as it is. The ids are the same.

Defined cases: a null text is the empty text with no ids; special strings in a text get their own ids, as the
library does; texts of any length are encoded whole; repeated rows get equal results; an empty table gives no rows;
other columns are ignored, so their names may clash with the result's.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import slices

VOCABULARY = "word_bpe_49k.json"
LEAF, CACHE = 512, 300_000
#: All but the characters for which Python's lower() and NFC agree with the library's normaliser and whose white space is known.
_PLAIN = re.compile("[^\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]")
#: The pre-tokeniser's pattern for those characters; the underscore is neither a letter nor a digit there.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Characters that Python's split() takes for white space and the library does not, or that are rarer than that is worth.
_ODD_SPACE = re.compile("[^\t-\r -~\xa1-\u024f]")
#: A match of the pre-tokeniser looks at most so many bytes past its start before it has settled ('re, 've, 'll).
_AHEAD = 12
_WHITE = frozenset(b"\t\n\x0b\x0c\r ")
#: What a vocabulary file must say for the shortcuts of this module to hold: how it normalises and where it splits.
_NORMALISES = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_encoders: dict = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TreeEncoder:
    """Encodes with one vocabulary file of the tokenizers library; `leaf` in characters of normalised text."""

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE, threads: int = 1):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")  # read when the library first encodes
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Tokenizer

        self.leaf, self.most = max(16, leaf), cache
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normalizer = self.tokenizer.normalizer
        self.plain = Tokenizer.from_file(path)  # for text that is normalised already
        self.plain.no_truncation()
        self.plain.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if (spec.get("normalizer") or {}).get("normalizers") != _NORMALISES or (steps[0].get("pattern") or {}).get("Regex") != _SPLITS:
            raise ValueError(f"{path} normalises or splits texts in a way that this encoder doesn't know")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        from tokenizers.normalizers import Sequence

        self.plain.normalizer = Sequence([])
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.words = [""] * size
        self.width = [0] * size
        for t, i in spec["model"]["vocab"].items():
            self.words[i] = t
            self.width[i] = len(t) - len(self.suffix) if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix) else len(t)
        for t, i in self.special.items():
            self.words[i] = t
        self.known: dict[str, list[int]] = {}
        self.pieces: dict[str, list[int]] = {}

    def normalize(self, text: str) -> str:
        """The library's normal form but for the kind of white space, which never reaches a token."""
        if not _PLAIN.search(text) and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def direct(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalised texts without special strings; with a cache, each new word is encoded by the library.

        The first `most` distinct words stay in the cache; later ones are kept for this call only.
        """
        if not self.most:
            return [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        known, split = self.known, [t.split() if not _ODD_SPACE.search(t) else [w for w in t.split(" ") if w] for t in texts]
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in known))
        if not new:
            return [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in split]
        parts = [_PARTS.findall(w) if not _PLAIN.search(w) else [w] for w in new]
        pieces = self.pieces
        fresh = list(dict.fromkeys(p for ps in parts for p in ps if p not in pieces))
        here = {p: e.ids for p, e in zip(fresh, self.plain.encode_batch_fast(fresh, add_special_tokens=False), strict=True)}
        if len(pieces) < self.most:
            pieces.update(here)
        local = {w: list(chain.from_iterable(pieces[p] if p in pieces else here[p] for p in ps)) for w, ps in zip(new, parts, strict=True)}
        if len(known) < self.most:
            known.update(local)
            return [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in split]
        return [list(chain.from_iterable([known[w] if w in known else local[w] for w in ws])) for ws in split]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of every text (encode with add_special_tokens=False)."""
        leaves: list[str] = []
        plans = [[self._plan(self.normalize(part), leaves) for part in self.splitter.split(t)] if self.special else [self._plan(self.normalize(t), leaves)] for t in texts]
        ids = self.direct(leaves)
        out = []
        for t, plan in zip(texts, plans, strict=True):
            parts = [self._ids(p, ids)[1] for p in plan]
            if len(parts) == 1:
                out.append(parts[0])
                continue
            whole: list[int] = []
            for part, mark in zip(parts, [*self.splitter.findall(t), None], strict=True):
                whole += part
                if mark is not None:
                    whole.append(self.special[mark])
            out.append(whole)
        return out

    def _plan(self, text: str, leaves: list[str]):
        """A leaf's number, or the pair of a text's halves."""
        if len(text) <= self.leaf:
            leaves.append(text)
            return len(leaves) - 1, text
        middle = len(text) // 2
        return self._plan(text[:middle], leaves), self._plan(text[middle:], leaves)

    def _ids(self, plan, ids: list[list[int]]) -> tuple[str, list[int]]:
        """Text and ids of a plan; halves of one level are independent of each other."""
        if isinstance(plan[0], int):
            return plan[1], ids[plan[0]]
        (left, a), (right, b) = self._ids(plan[0], ids), self._ids(plan[1], ids)
        return left + right, self._join(left, a, right, b)

    def _join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        reach = 24
        while True:
            # The window's left edge: a token of `a` that starts at a character, away from the join.
            tail = left[-reach:].encode()
            head = right[:reach].encode()
            i, start = self._back(a, tail, len(left) <= reach)
            ends = self._starts(b, head, len(right) <= reach)
            if i is not None:
                window = tail[start:] + head
                m = self.direct([window.decode(errors="strict")])[0] if self._whole(window) else None
                if m is not None:
                    join = len(tail) - start
                    left_ok = i == 0 or (bool(m) and m[0] == a[i])
                    if left_ok and len(right) <= reach:
                        return a[:i] + m
                    if left_ok:
                        at = self._spans(m, window)
                        for k, p in enumerate(at):
                            end = p + self.width[m[k]]
                            if p >= join and end <= len(window) - _AHEAD and k + 1 < len(m):
                                j = ends.get(p - join)
                                if j is not None and b[j] == m[k]:
                                    return a[:i] + m[:k] + b[j:]
            reach *= 2

    @staticmethod
    def _whole(window: bytes) -> bool:
        return not window or (window[0] & 0xC0) != 0x80

    def _back(self, a: list[int], tail: bytes, all_of_it: bool) -> tuple[int | None, int]:
        """Index and place in `tail` of the earliest token that starts in it and ends away from its end; (0, 0) if it is all of the left side."""
        if all_of_it:
            return 0, 0
        p, best = len(tail), (None, 0)
        for i in range(len(a) - 1, -1, -1):
            while p and tail[p - 1] in _WHITE:
                p -= 1
            q = p - self.width[a[i]]
            if q < 0:
                break
            if p <= len(tail) - _AHEAD and (tail[q] & 0xC0) != 0x80:
                best = (i, q)
            p = q
        return best

    def _spans(self, ids: list[int], text: bytes) -> list[int]:
        """Where each token starts."""
        out, p = [], 0
        for t in ids:
            while p < len(text) and text[p] in _WHITE:
                p += 1
            out.append(p)
            p += self.width[t]
        return out

    def _starts(self, b: list[int], head: bytes, all_of_it: bool) -> dict[int, int]:
        out, p = {}, 0
        for j, t in enumerate(b):
            while p < len(head) and head[p] in _WHITE:
                p += 1
            if p >= len(head):
                break
            if (head[p] & 0xC0) != 0x80:
                out[p] = j
            p += self.width[t]
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids, skip_special_tokens=False): a file without a decoder joins its tokens by spaces."""
        if self.tokenizer.decoder is None:
            return " ".join(map(self.words.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def encoder(name: str = VOCABULARY, leaf: int = LEAF, cache: int = CACHE) -> TreeEncoder:
    """One encoder per process."""
    if (name, leaf, cache) not in _encoders:
        _encoders[name, leaf, cache] = TreeEncoder(name if "/" in name else vocabulary_path(name), leaf, cache)
    return _encoders[name, leaf, cache]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids: array of int. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, leaf)
        for batch in slices(batches, "_text"):
            ids = enc.encode_batch([t or "" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def encode_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, leaf)
        for batch in slices(batches, "_text"):
            n, sums, texts = [], [], []
            for ids in enc.encode_batch([t or "" for t in batch.column("_text").to_pylist()]):
                n.append(len(ids))
                sums.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                texts.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
