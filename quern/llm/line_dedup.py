"""Line dedup over a distributed suffix array of line ids, with DataFrame operations only.

Every line gets an id (128 bits of hash). The suffixes of all documents' line sequences are ranked by prefix doubling:
the rank for h lines at a place and the rank h lines further on give the rank for 2h lines, as a suffix array's next
round does; a rank is the number of suffixes before it, so it says where in suffix order its group begins. Each
group of equal rank is an interval of the suffix array whose longest common prefix has at least h lines, and places
whose group has one member leave: nothing that long they start repeats. Doubling goes on until no group has two
members; it passes through `min_lines`, from where on the intervals count. In an interval the first place in reading
order (doc_id, row, line) is kept, and each other place repeats h lines of an earlier one. A place's greatest h is its
longest previous factor down to a power of two, and places a line further on carry it to its end: put together, these
stretches are the maximal repeated runs. Their lines are deleted. Repeats never cross documents; they may overlap
within one.

Documents of equal texts collapse to the first before that: all lines of the others are later copies if there are
`min_lines` of them. Where `long_words` is given, as in the pipeline, a single line is a repeat as well if it has so
many words, or if it is all of a document and all of an earlier one.

Defined cases: lines end at \\n only; a null text stays null and has no lines, an empty text has one empty line; of
rows that share a doc_id (or have none) the one whose row has the least hash comes first, and equal rows are copies; a
text of any length is split whole; a text all of whose lines are deleted becomes empty; an empty table gives no rows;
extra columns are kept by dedup_lines, and only names that begin with __q_ are taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import joined_ids, materialize, partitions, release, with_uid

MIN_LINES = 2
#: In the pipeline, a line of so many words counts as a run of its own.
LONG_WORDS = 50
_PLACE = ["doc_id", "uid", "pos"]


def _hashes(c: str) -> list:
    return [F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b")]


def _lines(text_col: str):
    return F.split(text_col, "\n", -1)


def copies(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid and number of lines of the rows whose text an earlier row has."""
    texts = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col("__q_uid").alias("uid"), F.size(_lines(text_col)).alias("n_lines"), *_hashes(text_col))
    # Counted map-side and written, so that a group of very many copies is one row here, and the join can split it.
    first = materialize(texts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "uid")).alias("first")).where("n > 1").drop("n"), "copied")
    out = materialize(texts.join(first, ["a", "b"]).where(F.struct("doc_id", "uid") != F.col("first")).select("uid", "n_lines"), "copies")
    release(first)
    return out


def line_table(rows: DataFrame, same: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, uid, pos and the line's id as two 64-bit numbers, without the rows in `same`."""
    lines = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col("__q_uid").alias("uid"), F.posexplode(_lines(text_col)).alias("pos", "line"))
    return lines.select(*_PLACE, *_hashes("line")).join(same.select("uid"), "uid", "left_anti")


def ranked(places: DataFrame, buckets: int) -> DataFrame:
    """Places with the rank of their key (a, b), its n, how often it occurs, and whether they are `later` than the first
    place with it; without places whose key occurs once.

    `bucket` deals keys into ranges in key order without sampling: sizes per range are summed first (one row each),
    and only within a range are keys sorted. A hot key is one row here; joining ranks back splits it as skew.
    """
    keys = materialize(places.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("bucket").alias("bucket"), F.min(F.struct(*_PLACE)).alias("first")), "keys")
    sizes = keys.groupBy("bucket").agg(F.sum("n").alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    inner = keys.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).where(F.col("n") > 1)
    ranks = inner.join(F.broadcast(offsets), "bucket").select("a", "b", "n", "first", (F.col("inner") + F.col("offset")).alias("rank"))
    found = places.select(*_PLACE, "a", "b").join(ranks, ["a", "b"])
    out = materialize(found.select(*_PLACE, "rank", "n", (F.struct(*_PLACE) > F.col("first")).alias("later")), "ranks")
    release(keys)
    return out


def intervals(lines: DataFrame, min_lines: int, buckets: int) -> list[DataFrame]:
    """By doubling: for h = min_lines and each later round, uid, pos and h of the places whose h lines an earlier place starts."""
    # Line ids are hashes, so ranges of their upper bits are even.
    spread = F.floor((F.shiftright("a", 20) + F.lit(1 << 43)) * F.lit(buckets) / F.lit(1 << 44)).cast("int")
    now, h, out = ranked(lines.withColumn("bucket", spread), buckets), 1, []
    while True:
        if h >= min_lines:
            out.append(now.where("later").select("uid", "pos", F.lit(h).alias("h")))
        total = now.agg(F.max(F.col("rank") + F.col("n"))).first()[0]
        if total is None:
            return out
        step = h if h >= min_lines else min(h, min_lines - h)  # up to min_lines the last round overlaps
        order = Window.partitionBy("doc_id", "uid").orderBy("pos").rangeBetween(step, step)
        follow = now.withColumn("b", F.first("rank").over(order)).where(F.col("b").isNotNull())
        # In key order and even: a group's places are spread over its range by the rank of what follows.
        spot = (F.col("a") + F.col("n") * (F.col("b") / F.lit(float(total)))) * F.lit(buckets) / F.lit(float(total))
        pairs = follow.select(*_PLACE, F.col("rank").alias("a"), "b", "n").withColumn("bucket", F.least(F.floor(spot).cast("int"), F.lit(buckets - 1)))
        following = ranked(pairs, buckets)
        if h < min_lines:
            release(now)
        now, h = following, h + step


def long_lines(rows: DataFrame, same: DataFrame, long_words: int, id_col: str, text_col: str) -> DataFrame:
    """uid, pos, h = 1: lines of so many words that an earlier place holds."""
    lines = rows.where(F.length(text_col) >= 2 * long_words - 1).select(F.col(id_col).alias("doc_id"), F.col("__q_uid").alias("uid"), F.posexplode(_lines(text_col)).alias("pos", "line"))
    # A line shorter than this can't have so many words; it isn't split.
    lines = lines.where(F.length("line") >= 2 * long_words - 1).where(F.size(F.filter(F.split("line", "\\s+"), lambda w: w != "")) >= long_words)
    held = materialize(lines.select(*_PLACE, *_hashes("line")).join(same.select("uid"), "uid", "left_anti"), "long")
    first = materialize(held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_PLACE)).alias("first")).where("n > 1").drop("n"), "first")
    return held.join(first, ["a", "b"]).where(F.struct(*_PLACE) > F.col("first")).select("uid", "pos", F.lit(1).alias("h"))


def removed_lines(rows: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """uid, start, end: stretches of lines to delete, none of which overlap; for rows with __q_uid."""
    same = copies(rows, id_col, text_col)
    found = intervals(line_table(rows, same, id_col, text_col), min_lines, partitions(rows.sparkSession))
    if long_words is not None:
        found.append(long_lines(rows, same, long_words, id_col, text_col))
    # Of each document's stretches, what reaches past all that begin before: every line comes once.
    before = Window.partitionBy("uid").orderBy("pos", F.desc("h")).rowsBetween(Window.unboundedPreceding, -1)
    none = rows.sparkSession.range(0).select(F.col("id").alias("uid"), F.lit(0).alias("pos"), F.lit(0).alias("h"))
    ends = reduce(DataFrame.union, found, none).withColumn("reach", F.coalesce(F.max(F.col("pos") + F.col("h")).over(before), F.lit(0)))
    new = ends.where(F.col("pos") + F.col("h") > F.col("reach")).select("uid", F.greatest("pos", "reach").alias("start"), (F.col("pos") + F.col("h")).alias("end"))
    whole = F.col("n_lines") >= min_lines if long_words is None else F.lit(True)
    return new.union(same.where(whole).select("uid", F.lit(0).alias("start"), F.col("n_lines").alias("end")))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """All columns of docs with the text deduplicated, and __q_n_lines, __q_n_removed, __q_n_runs."""
    rows = with_uid(docs, id_col)
    new = removed_lines(rows, min_lines, id_col, text_col, long_words)
    # Stretches that touch are one run.
    stretch = F.sort_array(F.collect_list(F.struct("start", "end")))
    gone = materialize(new.groupBy(F.col("uid").alias("__q_uid")).agg(stretch.alias("__q_gone")), "gone")
    lines, none = _lines(text_col), F.array().cast("array<struct<start:int,end:int>>")
    held = F.coalesce("__q_gone", none)
    # What is kept lies between one stretch's end and the next one's start.
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), held["end"]), F.concat(held["start"], F.array(F.size(lines))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.flatten(F.transform(F.filter(gaps, lambda g: g["b"] > g["a"]), lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))
    removed = F.aggregate(held, F.lit(0), lambda n, r: n + r["end"] - r["start"])
    runs = F.size(F.filter(held, lambda r, i: (i == 0) | (F.element_at(held, F.greatest(i, F.lit(1)))["end"] != r["start"])))
    joined = joined_ids(rows, gone)  # texts that lose nothing aren't shuffled
    return joined.select(
        *[F.when(F.col("__q_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("__q_n_lines"), removed.cast("long").alias("__q_n_removed"), runs.cast("long").alias("__q_n_runs"),
    )


def digest(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256 (of the remaining text; null for a null text)."""
    out = dedup_lines(docs.select("doc_id", "text"), min_lines)
    return out.select("doc_id", F.col("__q_n_lines").alias("n_lines"), F.col("__q_n_removed").alias("n_removed"), F.col("__q_n_runs").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB: deduplicated documents, from the table named DOCS, for min_lines = 2.
ORACLE_CTE = """
{p}_lines AS (SELECT doc_id, text, i - 1 AS pos, string_split(text, chr(10)) AS ls, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {docs} WHERE text IS NOT NULL)),
{p}_pairs AS (SELECT doc_id, pos, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM {p}_lines),
{p}_later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, pos) AS k FROM {p}_pairs WHERE b IS NOT NULL) WHERE k > 1),
{p}_gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM {p}_later),
{p}_marked AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone, lag(g.pos IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS before
  FROM {p}_lines l LEFT JOIN {p}_gone g ON l.doc_id = g.doc_id AND l.pos = g.pos),
{p}_kept AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE gone AND NOT before) AS BIGINT) AS n_runs,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM {p}_marked GROUP BY doc_id)"""


def oracle() -> str:
    return f"WITH {ORACLE_CTE.format(p='l', docs='documents')} SELECT doc_id, n_lines, n_removed, n_runs, sha256(text) AS kept_sha256 FROM l_kept"
