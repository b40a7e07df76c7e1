"""Evaluation reports: timings, length bins, pivots, upserts, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import grouping as G
from quern.operators import reporting as R
from quern.plans.registry import Tables, query, tokens

_STATS = "CAST(count(*) AS BIGINT) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, {p95} AS p95, {last}round(coalesce(stddev_samp(value), 0.0), 6) AS std"
_P95 = "list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1]"


@query("timer_stats", f"SELECT event_type AS name, {_STATS.format(p95=_P95, last='arg_max(value, (ts, event_id)) AS last, ')} FROM events GROUP BY event_type")
def timer_stats(t: Tables) -> DataFrame:
    return R.nine_stats(t.events, "value", ["ts", "event_id"], F.col("event_type").alias("name"))


@query("timer_global", f"SELECT {_STATS.format(p95=_P95, last='')} FROM events")
def timer_global(t: Tables) -> DataFrame:
    return R.nine_stats(t.events, "value", None)


@query("human_units", "SELECT event_id, CASE WHEN value < 0.001 THEN printf('%.1f us', value * 1000000) WHEN value < 1 THEN printf('%.1f ms', value * 1000) ELSE format('{:,.2f} s', value) END AS seconds FROM events")
def human_units(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.human_seconds(F.col("value")).alias("seconds"))


_BINS = ", ".join(f"({lo}, {hi})" for lo, hi in R.LENGTH_BINS)


@query("length_bins", f"WITH b(lo, hi) AS (VALUES {_BINS}), d AS (SELECT doc_id, len({tokens('text')}) AS n FROM documents), j AS (SELECT lo, hi, n FROM d JOIN b ON n >= lo AND n <= hi) SELECT lo || '-' || hi AS bin, CAST(count(*) AS BIGINT) AS samples, round(avg(n), 6) AS mean_len FROM j GROUP BY lo, hi UNION ALL SELECT 'overall', CAST(count(*) AS BIGINT), round(avg(n), 6) FROM d")
def length_bins(t: Tables) -> DataFrame:
    """Metrics by overlapping length bins, and overall."""
    d = t.documents.select("doc_id", F.size(X.tokens(F.col("text"))).alias("n"))
    return R.by_length_bin(d, "n", F.count(F.lit(1)).alias("samples"), F.round(F.avg("n"), 6).alias("mean_len"))


_METRICS = "m AS (SELECT source || '_f1' || CASE WHEN n_chars < 1000 THEN '_len_0-999' ELSE '_len_1000-9999999' END AS key, avg(n_chars) AS v FROM documents GROUP BY ALL UNION ALL SELECT source || '_em', avg(length(text)) FROM documents GROUP BY source)"


@query(
    "metrics_pivot",
    f"WITH {_METRICS}, p AS (SELECT regexp_extract(key, '^(.+?)_(f1|em)(?:_len_([0-9]+)-([0-9]+))?$', 1) AS task, regexp_extract(key, '^(.+?)_(f1|em)(?:_len_([0-9]+)-([0-9]+))?$', 2) AS metric, regexp_extract(key, '_len_([0-9]+-[0-9]+)$', 1) AS grp, v FROM m) SELECT task, CASE WHEN grp = '' THEN 'overall' ELSE grp END AS group_len, coalesce(CAST(round(max(v) FILTER (WHERE metric = 'f1'), 4) AS VARCHAR), 'N/A') AS f1, coalesce(CAST(round(max(v) FILTER (WHERE metric = 'em'), 4) AS VARCHAR), 'N/A') AS em, CAST(row_number() OVER (ORDER BY task, CASE WHEN grp = '' THEN 1 ELSE 0 END, CAST(CASE WHEN grp = '' THEN '0' ELSE string_split(grp, '-')[1] END AS BIGINT)) AS BIGINT) AS pos FROM p GROUP BY task, grp",
)
def metrics_pivot(t: Tables) -> DataFrame:
    """Metric keys `<task>_<metric>[_len_<lo>-<hi>]` from long to wide, groups in order with `overall` last."""
    by_len = t.documents.groupBy(F.concat("source", F.lit("_f1"), F.when(F.col("n_chars") < 1000, "_len_0-999").otherwise("_len_1000-9999999")).alias("key")).agg(F.avg("n_chars").alias("v"))
    whole = t.documents.groupBy(F.concat("source", F.lit("_em")).alias("key")).agg(F.avg(F.length("text")).alias("v"))
    return R.pivot_metrics(by_len.union(whole), ["f1", "em"])


_OLD = "old AS (SELECT source AS tasks, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS DOUBLE) AS chars FROM documents GROUP BY source)"


@query("csv_upsert", f"WITH {_OLD}, new AS (SELECT source AS tasks, CAST(-count(*) AS BIGINT) AS n FROM documents WHERE lang = 'de' AND n_chars > 2500 GROUP BY source) SELECT tasks, n, chars FROM old WHERE tasks NOT IN (SELECT tasks FROM new) UNION ALL SELECT tasks, n, NULL FROM new")
def csv_upsert(t: Tables) -> DataFrame:
    old = t.documents.groupBy(F.col("source").alias("tasks")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("double").alias("chars"))
    new = t.documents.where("lang = 'de' AND n_chars > 2500").groupBy(F.col("source").alias("tasks")).agg((-F.count(F.lit(1))).alias("n"))
    return G.upsert(old, new, "tasks")


@query("vector_upsert_last", "SELECT label AS namespace, vec_id % 50 AS pid, max(vec_id) AS version, arg_max(embedding[1], vec_id) AS first_component FROM embeddings GROUP BY label, vec_id % 50")
def vector_upsert_last(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("label").alias("namespace"), (F.col("vec_id") % 50).alias("pid"), F.col("vec_id").alias("version"), F.element_at("embedding", 1).alias("first_component"))
    return G.last_wins(rows, ["namespace", "pid"], ["version"])


@query("json_roundtrip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS doc FROM events")
def json_roundtrip(t: Tables) -> DataFrame:
    doc = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), doc.alias("doc"))


@query("weighted_mean", "SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS weighted FROM events GROUP BY event_type")
def weighted_mean(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id"), 6).alias("weighted"))


@query("finish_reason_filter", "SELECT user_id, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS skipped FROM events GROUP BY user_id")
def finish_reason_filter(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("kept"), F.count_if(F.col("event_type") == "error").alias("skipped"))


@query("run_names", "SELECT doc_id, left(sha256(source || '|' || lang), 8) AS run FROM documents")
def run_names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.run_name(F.col("source"), F.col("lang")).alias("run"))


@query("grouping_report", "SELECT coalesce(event_type, 'all') AS name, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), ())")
def grouping_report(t: Tables) -> DataFrame:
    """Per name and over all names in one pass."""
    return t.events.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.coalesce("event_type", F.lit("all")).alias("name"), "n", "mean")


@query("revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(t: Tables) -> DataFrame:
    """An extension beyond the reference: a star join with AQE choosing the joins."""
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query(
    "tracked_stages",
    """SELECT 'scan' AS name, CAST(count(*) AS BIGINT) AS calls, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT count(*) AS rows, sum(strlen(text)) AS bytes FROM documents)
UNION ALL SELECT 'filter', CAST(count(*) AS BIGINT), CAST(sum(rows) AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM (SELECT count(*) AS rows, coalesce(sum(strlen(text)), 0) AS bytes FROM documents WHERE lang = 'de' UNION ALL SELECT count(*), coalesce(sum(strlen(text)), 0) FROM documents WHERE n_chars >= 1000)""",
)
def tracked_stages(t: Tables) -> DataFrame:
    """Stages run under the tracker, summed up by name: calls, rows and bytes that passed by."""
    from quern.operators.instrument import Tracker

    tracker, run = Tracker(), lambda df: df.write.format("noop").mode("overwrite").save()
    tracker.run("scan", t.documents, run, "text")
    for kept in ("lang = 'de'", "n_chars >= 1000"):
        tracker.run("filter", t.documents.where(kept), run, "text")
    return tracker.table(t.spark).groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
