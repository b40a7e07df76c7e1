"""URL filters: rules of hosts and paths first, then a weighted vocabulary counted by one Aho-Corasick pass.

Strict and soft terms are looked up in the lower-cased url. A hit counts only between boundaries: the characters
before and after it are not letters or digits (of ASCII), so `adult` is no hit in `adulthood`. One strict term
blocks; so do soft terms whose weights, each distinct term once, reach `soft_limit`.

Defined cases: a null url or one without `://` has an empty host and path and fits no rule; a null url is allowed;
repeated urls get equal rows; a url of any length is read whole; an empty table gives no rows; other columns of the input are ignored, so their names may clash with the result's.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower

#: The vocabulary.
STRICT = ("porn", "xxx", "adult", "casino", "viagra", "escort", "hentai", "camgirl", "poker")
SOFT = {
    "ads": 0.75, "bets": 1.5, "bonus": 1.0, "cheap": 1.0, "click": 0.75, "farm": 0.75, "free": 1.0, "loan": 1.25,
    "pills": 1.5, "spam": 1.5, "track": 0.5, "win": 0.75,
}
SOFT_LIMIT = 2.0
#: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_automata: dict = {}


@dataclass(frozen=True)
class Vocabulary:
    strict: Sequence[str] = STRICT
    soft: Mapping[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_limit: float = SOFT_LIMIT

    @classmethod
    def read(cls, path: str, soft_limit: float = SOFT_LIMIT) -> Vocabulary:
        """From lines of a term, a tab, and `strict` or the term's weight; weights are below the limit, so that one soft term never blocks."""
        strict, soft = [], {}
        with open(path, encoding="utf-8") as f:
            for term, kind in (line.rstrip("\n").lower().split("\t") for line in f if line.strip()):
                if kind == "strict":
                    strict.append(term)
                elif not 0 < float(kind) < soft_limit:
                    raise ValueError(f"the weight of {term} must lie between 0 and {soft_limit}")
                else:
                    soft[term] = float(kind)
        return cls(tuple(strict), soft, soft_limit)


def automaton(vocabulary: Vocabulary):
    """One automaton per process for each set of terms."""
    import ahocorasick

    key = (tuple(vocabulary.strict), tuple(sorted(vocabulary.soft)))
    if key not in _automata:
        made = ahocorasick.Automaton()
        for term in sorted({*key[0], *key[1]}):
            made.add_word(term, term)
        made.make_automaton()
        _automata[key] = made, frozenset(key[0]), frozenset(key[1])
    return _automata[key]


def hits(url: str, terms) -> tuple[frozenset[str], frozenset[str]]:
    """The distinct strict and soft terms of an automaton() that stand between boundaries in `url`."""
    found, (machine, strict, soft) = set(), terms
    for last, term in machine.iter(url):
        first = last - len(term)
        if not (first >= 0 and _wordy(url[first])) and not (last + 1 < len(url) and _wordy(url[last + 1])):
            found.add(term)
    return strict & found, soft & found


def _wordy(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def _method(vocabulary: Vocabulary):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(vocabulary)
        for batch in batches:
            strict, soft, weight = [], [], []
            for url in batch.column("_lower").to_pylist():
                a, b = hits(url or "", terms)
                strict.append(len(a))
                soft.append(len(b))
                weight.append(float(sum(vocabulary.soft[t] for t in sorted(b))))
            cols = [pa.array(strict, pa.int32()), pa.array(soft, pa.int32()), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "n_strict", "n_soft", "soft_weight"])

    return score


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: host after the first `://` up to `/`, `?`, `#` or the end; path from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per page: id, host, path, rule (`host` + `path` of the longest fitting rule, else null), verdict, and the hits.

    The verdict is the rule's; without one it is the vocabulary's. No row is shuffled.
    """
    vocabulary = vocabulary or Vocabulary()
    host, path = split_url(F.col("_url"))
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    df = df.select("page_id", host.alias("host"), path.alias("path"), ascii_lower(F.col("_url")).alias("_lower"))
    df = df.mapInArrow(_method(vocabulary), f"page_id {df.schema['page_id'].dataType.simpleString()}, host string, path string, _lower string, n_strict int, n_soft int, soft_weight double")
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    bad = (F.col("n_strict") > 0) | (F.col("soft_weight") >= vocabulary.soft_limit)
    method = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "n_strict", "n_soft")


def oracle() -> str:
    """DuckDB SQL of op1's rows; the boundary checks are regular expressions there."""
    terms = lambda ts: "[" + ", ".join(f"'{t}'" for t in ts) + "]"
    count = lambda ts: f"len(list_filter({terms(ts)}, lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))"
    weight = " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END" for t, w in SOFT.items())
    cases = {kind: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(h, p, v)}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) for kind, out in (("rule", lambda h, p, v: h + p), ("verdict", lambda h, p, v: v))}
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(url, '{upper}', '{lower}'), '') AS low,
                  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
m AS (SELECT *, CAST({count(STRICT)} AS INTEGER) AS n_strict, CAST({count(SOFT)} AS INTEGER) AS n_soft, {weight} AS soft_weight FROM h)
SELECT page_id, host, path, CASE {cases["rule"]} ELSE NULL END AS rule,
       CASE {cases["verdict"]} WHEN n_strict > 0 OR soft_weight >= {SOFT_LIMIT:g} THEN 'block' ELSE 'allow' END AS verdict,
       n_strict, n_soft
FROM m"""
