"""Dataset builders: scans, filters, grouping, unions, samples, needles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import grouping as G
from quern.plans.registry import Tables, h8, hkey, query
from quern.plans.text_queries import QA_SQL, qa


@query("scan_project_prune", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de' AND n_chars >= 1000")
def scan_project_prune(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'de' AND n_chars >= 1000").select("doc_id", "lang", "n_chars")


@query("filter_nonempty", "SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE text IS NOT NULL AND trim(text) <> '' AND source IS NOT NULL) AS BIGINT) AS kept FROM documents GROUP BY lang")
def filter_nonempty(t: Tables) -> DataFrame:
    ok = F.col("text").isNotNull() & (F.trim("text") != "") & F.col("source").isNotNull()
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("kept"))


@query("len_filter", "SELECT conv_id, turn FROM conversations WHERE length(text) <= 500 AND len(string_split(text, ' ')) <= 80")
def len_filter(t: Tables) -> DataFrame:
    return t.conversations.where((F.length("text") <= 500) & (F.size(F.split("text", " ")) <= 80)).select("conv_id", "turn")


@query("slice_rows", "SELECT doc_id, CAST(rn AS BIGINT) AS rn FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn > 100 AND rn <= 600")
def slice_rows(t: Tables) -> DataFrame:
    """The registry's row ranges, `train[100:600]`."""
    from quern.sources.readers import parse_slice

    _, a, b = parse_slice("train[100:600]")
    rows = G.numbered(t.documents.select("doc_id"), ["doc_id"])
    return rows.where((F.col("rn") > a) & (F.col("rn") <= b))


@query("compact_qa_groups", f"WITH {QA_SQL} SELECT conv_id, list(gold ORDER BY turn) AS prompts, list(pred ORDER BY turn) AS responses FROM qa GROUP BY conv_id")
def compact_qa_groups(t: Tables) -> DataFrame:
    return G.compact(qa(t).select("conv_id", "turn", F.col("gold").alias("prompt"), F.col("pred").alias("response")), ["conv_id"], ["turn"])


@query("compact_qa_last_gold", "SELECT source, doc_id // 1000 AS part, CAST(count(*) AS BIGINT) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS ids, arg_max(text, doc_id) AS gold_context FROM documents GROUP BY source, doc_id // 1000")
def compact_qa_last_gold(t: Tables) -> DataFrame:
    """Groups of a thousand ids, so that a source's list is bounded; the last value wins in each."""
    rows = t.documents.select("source", F.floor(F.col("doc_id") / 1000).cast("long").alias("part"), "doc_id", F.col("doc_id").cast("string").alias("prompt"), F.lit("").alias("response"), "text")
    g = G.compact(rows, ["source", "part"], ["doc_id"], gold="text")
    return g.select("source", "part", F.size("prompts").cast("long").alias("n"), F.md5(F.array_join("prompts", ",")).alias("ids"), "gold_context")


@query("batch_local_groups", "SELECT doc_id // 10 AS batch, source, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY doc_id // 10, source")
def batch_local_groups(t: Tables) -> DataFrame:
    """Groups within windows of ten: the streaming curator's shape."""
    return t.documents.groupBy(F.floor(F.col("doc_id") / 10).cast("long").alias("batch"), "source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))


@query("supporting_semijoin", "SELECT d.doc_id, d.source FROM documents d SEMI JOIN (SELECT * FROM labels WHERE quality = 1) l USING (doc_id)")
def supporting_semijoin(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("supporting_paragraphs", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda p: list_contains(['the', 'der', 'la', 'de', 'of'], lower(string_split(p, ' ')[1]))), chr(10)) AS gold FROM documents")
def supporting_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs whose title, here the first word, is in the list of supporting titles."""
    titles = F.array(*map(F.lit, ("the", "der", "la", "de", "of")))
    return t.documents.select("doc_id", F.array_join(F.filter(F.split("text", "\n"), lambda p: F.array_contains(titles, F.lower(F.element_at(F.split(p, " "), 1)))), "\n").alias("gold"))


@query("distinct_keep_first", "SELECT text, arg_min(source, doc_id) AS source, min(doc_id) AS doc_id FROM documents GROUP BY text")
def distinct_keep_first(t: Tables) -> DataFrame:
    return G.keep_first(t.documents.select("text", "source", "doc_id"), ["text"], ["doc_id"])


@query("distinct_contexts", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT text) AS BIGINT) AS contexts FROM documents")
def distinct_contexts(t: Tables) -> DataFrame:
    return t.documents.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("contexts"))


@query("union_mixed_schema", "SELECT 'document' AS kind, doc_id AS id, text, lang, CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text, NULL, role FROM conversations")
def union_mixed_schema(t: Tables) -> DataFrame:
    docs = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", "lang")
    turns = t.conversations.select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")
    return docs.unionByName(turns, allowMissingColumns=True)


@query("hash_shuffle_split", f"SELECT doc_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY {hkey('doc_id', 'split')}, doc_id) AS rn, count(*) OVER () AS n FROM documents)")
def hash_shuffle_split(t: Tables) -> DataFrame:
    return G.split_ratio(t.documents.select("doc_id"), "doc_id", 0.7, "split")


@query("hash_sample", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {hkey('doc_id', 'sample')}, doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= greatest(1, floor(n * 0.2))")
def hash_sample(t: Tables) -> DataFrame:
    """A sampling operator: a fifth of the rows without replacement."""
    return G.sample_fraction(t.documents.select("doc_id"), "doc_id", 0.2, "sample")


@query("hash_shuffle", f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {hkey('doc_id', 'shuffle')}, doc_id) AS BIGINT) AS rn FROM documents")
def hash_shuffle(t: Tables) -> DataFrame:
    return G.hash_numbered(t.documents.select("doc_id"), "doc_id", "shuffle")


_BINS = "SELECT item_id, len(string_split(text, ' ')) AS n, item_id % 10 AS bin FROM benchmark"


@query("needle_positions", f"WITH b AS ({_BINS}), c AS (SELECT item_id, n, bin, least(n * bin // 10, n - 1) AS lo, greatest(least((n * (bin + 1) + 9) // 10 - 1, n - 1), least(n * bin // 10, n - 1)) AS hi FROM b) SELECT item_id, bin, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, lo + {h8('item_id', 'depth')} % (hi - lo + 1) AS pos FROM c")
def needle_positions(t: Tables) -> DataFrame:
    """A place in each item's depth bin: floor(n*d/10) .. ceil(n*(d+1)/10) - 1, clamped."""
    n, d = F.size(F.split("text", " ")), F.col("item_id") % 10
    lo = F.least(F.floor(n * d / 10), n - 1)
    hi = F.greatest(F.least(F.floor((n * (d + 1) + 9) / 10) - 1, n - 1), lo)
    b = t.benchmark.select("item_id", d.alias("bin"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    return b.withColumn("pos", F.col("lo") + X.hash_int(F.col("item_id"), "depth", F.col("hi") - F.col("lo") + 1))


@query(
    "needle_contexts",
    f"WITH n AS (SELECT item_id, text, row_number() OVER (ORDER BY {hkey('item_id', 'needle')}, item_id) AS rn, count(*) OVER () AS n FROM benchmark), q AS (SELECT doc_id, text, row_number() OVER (ORDER BY {hkey('doc_id', 'question')}, doc_id) AS rn FROM documents), j AS (SELECT n.item_id, q.doc_id, n.text AS needle, string_split(q.text, chr(10)) AS blocks FROM n JOIN q USING (rn)), p AS (SELECT *, CAST({h8('item_id', 'place')} % (len(blocks) + 1) AS BIGINT) AS pos FROM j) SELECT item_id, doc_id, pos, array_to_string(list_concat(blocks[1:pos], [needle], blocks[pos + 1:]), chr(10)) AS context FROM p",
)
def needle_contexts(t: Tables) -> DataFrame:
    """Shuffled needles meet shuffled contexts one to one; each needle goes in at a place."""
    needles = G.hash_numbered(t.benchmark.select("item_id", F.col("text").alias("needle")), "item_id", "needle")
    texts = G.hash_numbered(t.documents.select("doc_id", F.split("text", "\n").alias("blocks")), "doc_id", "question")
    j = needles.join(texts, "rn").withColumn("pos", X.hash_int(F.col("item_id"), "place", F.size("blocks") + 1))
    return j.select("item_id", "doc_id", "pos", F.array_join(F.array_insert("blocks", (F.col("pos") + 1).cast("int"), F.col("needle")), "\n").alias("context"))


@query(
    "distractor_reject",
    "WITH a AS (SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> '')[1:3], ' ') AS ans FROM benchmark), w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> '') AS t FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM w) SELECT item_id, (SELECT count(*) FROM documents) - CAST(count(DISTINCT doc_id) AS BIGINT) AS distractors FROM a LEFT JOIN g ON g = ans GROUP BY item_id",
)
def distractor_reject(t: Tables) -> DataFrame:
    """How many documents may serve as distractors of each item: those without its answer, its first three words, as words."""
    clean = lambda c: X.tokens(F.regexp_replace(F.lower(c), "[^a-z0-9 \\t\\n\\r]", " "))
    answers = t.benchmark.select("item_id", F.array_join(F.slice(clean(F.col("text")), 1, 3), " ").alias("g"))
    w = t.documents.select("doc_id", clean(F.col("text")).alias("t"))
    grams = w.where(F.size("t") >= 3).select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 2), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1), F.element_at("t", i + 2)))).alias("g"))
    # Few answers go to where the documents are read, so that only hits are shuffled; many are joined as they come.
    few = answers.limit(100_001).count() <= 100_000
    hits = grams.join(F.broadcast(answers) if few else answers, "g").groupBy("item_id").agg(F.countDistinct("doc_id").alias("hit"))
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))  # one row
    return t.benchmark.select("item_id").join(hits, "item_id", "left").crossJoin(F.broadcast(n)).select("item_id", (F.col("n") - F.coalesce("hit", F.lit(0))).alias("distractors"))


@query("negative_pairs", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hkey('doc_id', 'negative')}, doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT a.doc_id AS context_id, b.doc_id AS prompt_id FROM r a JOIN r b ON b.rn = (a.rn + 1) % a.n WHERE a.n > 1")
def negative_pairs(t: Tables) -> DataFrame:
    """Every context with another one's prompt: the next in a random cycle."""
    rows = G.hash_numbered(t.documents.select("doc_id"), "doc_id", "negative").withColumn("rn", F.col("rn") - 1)
    n = t.documents.count()
    a = rows.select(F.col("doc_id").alias("context_id"), F.pmod(F.col("rn") + 1, F.lit(n)).alias("rn"))
    return a.join(rows.select(F.col("doc_id").alias("prompt_id"), "rn"), "rn").where(F.col("context_id") != F.col("prompt_id")).select("context_id", "prompt_id")


@query("mixture_probs", "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), w AS (SELECT source, n, sum(n) OVER () AS total FROM s), k AS (SELECT source, n, CASE WHEN n / total <= 0.01 THEN 0.01 END AS floor_p FROM w) SELECT source, CAST(n AS BIGINT) AS n, round(coalesce(floor_p, n / (sum(CASE WHEN floor_p IS NULL THEN n ELSE 0 END) OVER ()) * (1 - coalesce(sum(floor_p) OVER (), 0))), 9) AS p FROM k")
def mixture_probs(t: Tables) -> DataFrame:
    """Sources of at most one hundredth get one hundredth; the rest share what is left by size."""
    s = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = s.agg(F.sum("n").alias("total"))  # one row
    k = s.crossJoin(F.broadcast(total)).select("source", "n", F.when(F.col("n") / F.col("total") <= 0.01, 0.01).alias("floor_p"))
    sums = k.agg(F.sum(F.when(F.col("floor_p").isNull(), F.col("n")).otherwise(0)).alias("big"), F.coalesce(F.sum("floor_p"), F.lit(0.0)).alias("taken"))  # one row
    return k.crossJoin(F.broadcast(sums)).select("source", "n", F.round(F.coalesce("floor_p", F.col("n") / F.col("big") * (1 - F.col("taken"))), 9).alias("p"))


@query("interleave_draws", f"WITH s AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY (k - 0.5) / n, {hkey('lang', 'mix')}, doc_id) AS BIGINT) AS draw FROM s")
def interleave_draws(t: Tables) -> DataFrame:
    """One stream in which every source is spread evenly until all are exhausted."""
    # Numbers over all rows by language; a language's own start where its first row stands, so that no task holds a language.
    rows = G.numbered(t.documents.select("lang", "doc_id"), ["lang", "doc_id"], "_g")
    sizes = rows.groupBy(F.col("lang").alias("_lang")).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("n"))
    s = rows.join(sizes, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("k", F.col("_g") - F.col("_first") + 1)
    s = s.select("doc_id", "lang", ((F.col("k") - 0.5) / F.col("n")).alias("_at"), X.hash_order(F.col("lang"), "mix").alias("_m"))
    return G.numbered(s, ["_at", "_m", "doc_id"], "draw").select("doc_id", "lang", "draw")


@query("hash_draws_with_replacement", f"WITH c AS (SELECT count(*) AS n FROM documents), d AS (SELECT item_id, unnest(range(0, 25)) AS k FROM benchmark), p AS (SELECT item_id, k, CAST({h8('item_id * 100 + k', 'draw')} % n AS BIGINT) + 1 AS rn FROM d, c), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) SELECT item_id, CAST(k AS INTEGER) AS k, doc_id FROM p JOIN r USING (rn)")
def hash_draws_with_replacement(t: Tables) -> DataFrame:
    """Twenty-five distractor draws for each needle, with replacement."""
    n = t.documents.count()
    d = t.benchmark.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k"))
    d = d.withColumn("rn", X.hash_int(F.col("item_id") * 100 + F.col("k"), "draw", F.lit(max(1, n))) + 1)
    return d.join(G.numbered(t.documents.select("doc_id"), ["doc_id"]), "rn").select("item_id", "k", "doc_id")
