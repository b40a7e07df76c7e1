"""Readers and sinks, each as a round trip: what is written to the shared folder is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import reporting as O
from quern.operators.storage import scratch
from quern.plans.registry import Tables, query
from quern.plans.text_queries import QA_SQL, qa
from quern.sources import readers as R
from quern.sources import sinks as S
from quern.sources import vector_store as V
from quern.streaming.curate import curate


@query("roundtrip_parquet", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def roundtrip_parquet(t: Tables) -> DataFrame:
    path = scratch(t.spark, "parquet")
    S.write_parquet(t.documents, path)
    return R.read_any(t.spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("roundtrip_append", "SELECT conv_id % 3 AS part, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id % 3")
def roundtrip_append(t: Tables) -> DataFrame:
    """Three appends to one table."""
    path = scratch(t.spark, "append")
    for k in range(3):
        S.write_parquet(t.conversations.where(F.col("conv_id") % 3 == k), path, append=True)
    return R.read_any(t.spark, path).groupBy((F.col("conv_id") % 3).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("roundtrip_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def roundtrip_jsonl(t: Tables) -> DataFrame:
    """JSON lines, read by extension, written again as Parquet."""
    lines, path = f"{scratch(t.spark, 'lines')}.jsonl", scratch(t.spark, "parquet")
    S.write_jsonl(t.conversations, lines)
    S.write_parquet(R.read_any(t.spark, lines, "conv_id long, turn int, role string, text string"), path)
    return R.read_any(t.spark, path).select("conv_id", F.col("turn").cast(t.conversations.schema["turn"].dataType).alias("turn"), "role", "text")


@query("roundtrip_csv", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events")
def roundtrip_csv(t: Tables) -> DataFrame:
    path = f"{scratch(t.spark, 'rows')}.csv"
    t.events.select("event_id", "event_type").write.option("header", True).csv(path)
    return R.read_any(t.spark, path).select("event_id", "event_type")


@query("roundtrip_csv_text", "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'quoted', 'a \"b\", ' || chr(10) || ' c' UNION ALL SELECT -2, 0, '', NULL")
def roundtrip_csv_text(t: Tables) -> DataFrame:
    """Texts with quotes, separators and line ends, empty ones and nulls, through a CSV file."""
    path = f"{scratch(t.spark, 'texts')}.csv"
    kind = t.conversations.schema
    odd = t.spark.range(2).select(
        (-F.col("id") - 1).alias("conv_id"), F.lit(0).alias("turn"), F.when(F.col("id") == 0, "quoted").otherwise("").alias("role"), F.when(F.col("id") == 0, 'a "b", \n c').alias("text")
    )
    S.write_csv(t.conversations.select("conv_id", "turn", "role", "text").union(odd.select("conv_id", F.col("turn").cast(kind["turn"].dataType), "role", "text")), path)
    return S.read_csv(t.spark, path, f"conv_id long, turn {kind['turn'].dataType.simpleString()}, role string, text string")


@query("roundtrip_csv_upsert", "SELECT source AS tasks, CASE WHEN source < 's' THEN '0' ELSE CAST(count(*) AS VARCHAR) END AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def roundtrip_csv_upsert(t: Tables) -> DataFrame:
    """A report file whose rows of equal tasks are replaced by the second batch."""
    path = f"{scratch(t.spark, 'report')}.csv"
    rows = t.documents.where("source IS NOT NULL").groupBy(F.col("source").alias("tasks")).agg(F.count(F.lit(1)).alias("n"))
    S.upsert_csv(rows, path)
    S.upsert_csv(rows.where("tasks < 's'").withColumn("n", F.lit(0)), path)
    return R.read_any(t.spark, path).select("tasks", "n")


@query("roundtrip_vectors", "SELECT vec_id % 20 AS pid, CAST(max(vec_id) AS BIGINT) AS version FROM embeddings GROUP BY vec_id % 20")
def roundtrip_vectors(t: Tables) -> DataFrame:
    """A vector table: the greatest version of each key stays, also over two upserts."""
    path = scratch(t.spark, "vectors")
    rows = t.embeddings.select(F.lit("ns").alias("namespace"), (F.col("vec_id") % 20).alias("pid"), F.col("vec_id").alias("version"), "embedding")
    S.upsert_vectors(rows.where("version % 2 = 0"), path, "version")
    S.upsert_vectors(rows.where("version % 2 = 1"), path, "version")
    return t.spark.read.parquet(path).select("pid", "version")


@query("glob_scan", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'en')")
def glob_scan(t: Tables) -> DataFrame:
    """Several folders by one pattern."""
    path = scratch(t.spark, "glob")
    for lang in ("de", "en", "fr"):
        t.documents.where(F.col("lang") == lang).write.parquet(f"{path}/{lang}-part")
    return R.read_any(t.spark, f"{path}/[de][en]-part").select("doc_id", "lang")


@query("registry_scan", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn > 20 AND rn <= 90")
def registry_scan(t: Tables) -> DataFrame:
    """A logical name and split to a path and a row range."""
    registry = R.Registry()
    registry.add("corpus", "train", f"{t.sf_dir}/documents.parquet", "[20:90]")
    return registry.read(t.spark, "corpus", "train", "doc_id").select("doc_id")


@query(
    "generated_registry",
    "SELECT name, split, lo, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE doc_id % 2 WHEN 0 THEN 'toy' ELSE 'copy' END AS name, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split, unnest([0, 1000, 2000]) AS lo, n_chars FROM documents) WHERE n_chars >= lo AND (n_chars < lo + 1000 OR lo = 2000) GROUP BY name, split, lo",
)
def generated_registry(t: Tables) -> DataFrame:
    """Entries made for names, splits and length bins, all written in one pass and each read from its own JSON lines."""
    root, bins = scratch(t.spark, "toy"), [(0, 1000), (1000, 2000), (2000, 1 << 40)]
    registry = R.Registry()
    registry.add_generated(["toy", "copy"], bins, f"{root}/name={{name}}/split={{split}}/lo={{lo}}")
    docs = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "toy").otherwise("copy").alias("name"), F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test").alias("split"),
        F.when(F.col("n_chars") < 1000, 0).when(F.col("n_chars") < 2000, 1000).otherwise(2000).alias("lo"),
    )
    docs.where("n_chars IS NOT NULL").write.partitionBy("name", "split", "lo").json(root)
    out = None
    for entry, splits in registry.entries.items():
        name, lo, _ = entry.split("_")
        for split, (path, _) in splits.items():
            part = R.read_json_folder(t.spark, path, "doc_id long").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(split).alias("split"), F.lit(int(lo)).alias("lo"), "n")
            out = part if out is None else out.union(part)
    return out.where("n > 0")


@query("shard_scan", "SELECT doc_id, source FROM documents")
def shard_scan(t: Tables) -> DataFrame:
    """Shards of at most a hundred contexts below <org>/<model>/<name>/<split>, read by pattern."""
    root = scratch(t.spark, "shards")
    S.write_shards(t.documents.select("doc_id", "source"), f"{root}/self_gen/org/model/corpus/train", rows=100)
    return t.spark.read.parquet(R.shard_glob(root, "org", "model", "corpus", "train")).select("doc_id", "source")


@query("routed_files", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def routed_files(t: Tables) -> DataFrame:
    """Files go to train or test by what their path says."""
    root = scratch(t.spark, "routed")
    t.documents.where("doc_id % 3 <> 0").write.parquet(f"{root}/Train_set")
    t.documents.where("doc_id % 3 = 0").write.parquet(f"{root}/test_set")
    files = t.spark.read.option("recursiveFileLookup", True).parquet(root)
    return R.route_by_path(files).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _one_json(df: DataFrame, key: str | None, path: str) -> None:
    """All rows as one JSON document, an array or an object that holds it: for tables known to be small."""
    rows = F.to_json(F.collect_list(F.struct(*df.columns)))
    df.agg((F.concat(F.lit(f'{{"{key}":'), rows, F.lit("}")) if key else rows).alias("value")).write.text(path)


@query("needles_json", "SELECT n_nationkey AS id, n_name AS needle, form FROM nation, (SELECT unnest(['array', 'data']) AS form)")
def needles_json(t: Tables) -> DataFrame:
    """Needles as a bare array or under `data`; one per nation."""
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("needle"))
    out = []
    for form in ("array", "data"):
        path = scratch(t.spark, f"needles-{form}")
        _one_json(rows, None if form == "array" else "data", path)
        out.append(R.read_needles(t.spark, path).select(F.col("id").cast(t.nation.schema["n_nationkey"].dataType).alias("id"), "needle", F.lit(form).alias("form")))
    return out[0].union(out[1])


@query("records_json", "SELECT n_nationkey AS id, n_name AS question FROM nation")
def records_json(t: Tables) -> DataFrame:
    """Retrieval records under `records`."""
    path = scratch(t.spark, "records")
    _one_json(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("question")), "records", path)
    return R.read_records(t.spark, path).select(F.col("id").cast(t.nation.schema["n_nationkey"].dataType).alias("id"), "question")


@query("summary_and_records", "SELECT 'record' AS kind, CAST(item_id AS VARCHAR) AS v FROM benchmark UNION ALL SELECT 'summary', CAST(count(*) AS VARCHAR) FROM benchmark")
def summary_and_records(t: Tables) -> DataFrame:
    """A summary and its records as tagged JSON lines."""
    path = scratch(t.spark, "document")
    S.write_documents(t.benchmark.agg(F.count(F.lit(1)).alias("v")), t.benchmark.select(F.col("item_id").alias("v")), path)
    back = t.spark.read.schema("kind string, value struct<v:string>").json(path)
    return back.select("kind", F.col("value.v").alias("v"))


@query("stats_file", "SELECT event_type AS name, CAST(count(*) AS VARCHAR) AS count FROM events GROUP BY event_type")
def stats_file(t: Tables) -> DataFrame:
    """The tracker's statistics file."""
    path = f"{scratch(t.spark, 'stats')}.csv"
    S.write_stats_csv(O.nine_stats(t.events, "value", ["ts", "event_id"], F.col("event_type").alias("name")), path)
    return R.read_any(t.spark, path).select("name", "count")


@query(
    "byte_stats",
    """WITH b AS (SELECT event_type AS name, user_id * CASE WHEN event_type < 'm' THEN 1 WHEN event_type < 's' THEN 1000 ELSE 100000000 END AS bytes FROM events),
g AS (SELECT name, CAST(count(*) AS BIGINT) AS count, CAST(max(bytes) AS BIGINT) AS max, list_sort(list(bytes))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM b GROUP BY name)
SELECT name, count, max, p95, CASE WHEN max < 1024 THEN format('{:,.2f} B', max / 1) WHEN max < 1048576 THEN format('{:,.2f} KB', max / 1024) WHEN max < 1073741824 THEN format('{:,.2f} MB', max / 1048576) ELSE format('{:,.2f} GB', max / 1073741824) END AS peak FROM g""",
)
def byte_stats(t: Tables) -> DataFrame:
    """Byte counters by name, as timers are summed up, with a readable peak in any unit."""
    from quern.functions.text import human_bytes

    scale = F.when(F.col("event_type") < "m", 1).when(F.col("event_type") < "s", 1000).otherwise(100_000_000)
    stats = O.nine_stats(t.events.withColumn("bytes", F.col("user_id") * scale), "bytes", None, F.col("event_type").alias("name"))
    return stats.select("name", "count", "max", "p95", human_bytes(F.col("max")).alias("peak"))


@query("cached_table", "SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def cached_table(t: Tables) -> DataFrame:
    """A table in a folder named by its settings' hash: the second call reads what the first one wrote."""
    root = scratch(t.spark, "cache")
    build = lambda: t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    S.cached(t.spark, root, {"by": "lang"}, build)
    return S.cached(t.spark, root, {"by": "lang"}, lambda: build().where("false"))


@query("evaluator_files", "SELECT conv_id AS id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def evaluator_files(t: Tables) -> DataFrame:
    """Predictions, gold and samples as JSON lines of their own, joined again by id."""
    root = scratch(t.spark, "evaluation")
    per = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))
    S.write_evaluation(per.select("id", F.col("turns").alias("prediction")), per.select("id", F.col("chars").alias("gold")), per, per.agg(F.count(F.lit(1)).alias("n")), root)
    read = lambda name, schema: t.spark.read.schema(schema).json(f"{root}/{name}")
    return read("predictions", "id long, prediction long").join(read("gold", "id long, gold long"), "id").select("id", F.col("prediction").alias("turns"), F.col("gold").alias("chars"))


@query("file_layout", "SELECT form, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents, (SELECT unnest(['compact', 'raw']) AS form) GROUP BY form")
def file_layout(t: Tables) -> DataFrame:
    """Files written in both layouts, told apart by their columns when they are read, and their contexts read by layout."""
    root, out = scratch(t.spark, "layouts"), None
    t.documents.select(F.col("text").alias("context"), F.array("lang").alias("prompts"), F.array("source").alias("responses")).write.parquet(f"{root}/a")
    t.documents.write.parquet(f"{root}/b")
    for name in ("a", "b"):
        df = R.read_any(t.spark, f"{root}/{name}")
        form = R.layout_of(df)
        n = df.select(F.col("context" if form == "compact" else "text").alias("text")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
        row = n.select(F.lit(form).alias("form"), "n", "chars")
        out = row if out is None else out.union(row)
    return out


@query("page_text_cap", "SELECT page_id, substr(html, 1, 25000) AS text FROM pages")
def page_text_cap(t: Tables) -> DataFrame:
    """The fetcher's cap on a page's characters; the limit is the feature."""
    from quern.sources.html import capped

    return t.pages.select("page_id", capped(F.col("html")).alias("text"))


@query("vector_store_upsert", "SELECT vec_id % 50 AS pid, CAST(max(vec_id) AS BIGINT) AS version, arg_max(embedding[1], vec_id) AS x FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 50 < 10 GROUP BY vec_id % 50")
def vector_store_upsert(t: Tables) -> DataFrame:
    """A table in buckets: the second upsert rewrites only the buckets of its ten keys."""
    root = scratch(t.spark, "store")
    rows = t.embeddings.select(F.lit("ns").alias("namespace"), (F.col("vec_id") % 50).alias("pid"), F.col("vec_id").alias("version"), F.col("embedding")[0].alias("x"))
    V.upsert(rows.where("version % 2 = 0"), root, "version")
    V.upsert(rows.where("version % 2 = 1 AND pid < 10"), root, "version")
    return V.read(t.spark, root).select("pid", "version", "x")


@query("curate_stream", f"WITH {QA_SQL} SELECT conv_id % 6 AS batch, CAST(conv_id % 4 AS VARCHAR) AS context, CAST(count(*) AS BIGINT) AS n, md5(string_agg(gold, '|' ORDER BY conv_id, turn)) AS prompts, md5(string_agg(pred, '|' ORDER BY conv_id, turn)) AS responses FROM qa GROUP BY conv_id % 6, conv_id % 4")
def curate_stream(t: Tables) -> DataFrame:
    """Streamed curation: six files are six micro-batches, each grouped by context and appended on its own."""
    root = scratch(t.spark, "stream")
    rows = qa(t).select((F.col("conv_id") % 6).alias("batch"), (F.col("conv_id") % 4).cast("string").alias("context"), F.struct("conv_id", "turn").alias("pos"), F.col("gold").alias("prompt"), F.col("pred").alias("response"))
    rows.withColumn("part", F.col("batch")).repartition("part").write.partitionBy("part").parquet(f"{root}/in")
    schema = T.StructType([f for f in rows.schema if f.name != "batch"])
    curate(t.spark, f"{root}/in", schema, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    joined = lambda c: F.md5(F.array_join(c, "|")).alias(c)
    # A micro-batch's number is the stream's; the batch its rows came from is told by their conversations.
    done = t.spark.read.parquet(f"{root}/out")
    return done.select((F.col("pos")[0]["conv_id"] % 6).alias("batch"), "context", F.size("prompts").cast("long").alias("n"), joined("prompts"), joined("responses"))
