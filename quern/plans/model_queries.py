"""Queries behind pluggable models: encoders, tokenizers, stemmers and phrase extractors, each with its model-free default."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import stemming
from quern.functions import text as X
from quern.functions import tokenize as K
from quern.functions.encoders import bridge_phrases, encode
from quern.operators import retrieval as R
from quern.operators.storage import stable
from quern.plans.registry import Tables, query, quoted
from quern.plans.retrieval_queries import _SPARSE_SQL, _hits, _sparse_found, _with_chunks
from quern.plans.text_queries import qa


@query("rouge_l_stemmed")
def rouge_l_stemmed(t: Tables) -> DataFrame:
    """ROUGE-L of answers over stems."""
    return qa(t).select("conv_id", "turn", F.round(stemming.rouge_l_stemmed()(F.col("pred"), F.col("gold")), 6).alias("value"))


@query("sentence_cosine_top2")
def sentence_cosine_top2(t: Tables) -> DataFrame:
    """Of each of the two best chunks the two sentences nearest to the query by cosine, nearest first."""
    texts = _with_chunks(t, _hits(t)[1].where("rank <= 2")).select("item_id", "pid", "rank", F.array_join("tok", " ").alias("passage"))
    found = X.sentences(F.col("passage"))
    split = texts.select("item_id", "pid", "rank", F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array("passage"))).alias("at", "s"))
    # A sentence is encoded once, however many queries ask for it.
    vectors = stable(split.select("s").distinct().select("s", encode(F.col("s"), prefix="passage: ").alias("v")))
    asked = t.benchmark.select("item_id", encode(F.col("text"), prefix="query: ").alias("q"))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = split.join(vectors, "s").join(asked, "item_id").withColumn("score", F.round(dot, 6))
    best = R.top(scored.withColumnRenamed("rank", "place"), 2, ["item_id", "pid"], F.desc("score"), "at")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"])
    return best.groupBy("item_id", "pid", F.col("place").alias("rank")).agg(F.array_join(in_order, " ").alias("kept"))


_TURN = f"'{K.BEGIN}user' || chr(10) || trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) || '{K.END}' || chr(10) || '{K.BEGIN}assistant' || chr(10)"


@query("context_tokens", f"WITH c AS (SELECT doc_id, {_TURN} AS t FROM documents) SELECT doc_id, CAST(strlen(t) - {len(K.BEGIN) * 2 + len(K.END) - 3} AS BIGINT) AS n_ids, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS decoded FROM c")
def context_tokens(t: Tables) -> DataFrame:
    """Contexts as ids in the chat template, whose text comes back from them."""
    made = t.documents.select("doc_id", K.tokenised(K.as_user(F.col("text"))).alias("t"))
    # The last id is a line end: the text ends one character after its beginning.
    return made.select("doc_id", F.size("t.ids").cast("long").alias("n_ids"), (F.element_at("t.starts", -1) + 1).cast("long").alias("n_chars"), F.md5(K.detokenised(F.col("t.ids"))).alias("decoded"))


def _phrases_sql(x: str) -> str:
    words = f"list_transform(string_split_regex(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}} \\t\\n\\r]+', ' ' || chr(1) || ' ', 'g'), '[ \\t\\n\\r]+'), lambda w: CASE WHEN w IN ({quoted(X.STOPWORDS)}) THEN chr(1) ELSE w END)"
    return f"list_filter(list_transform(string_split(array_to_string({words}, ' '), chr(1)), lambda r: trim(r)), lambda r: length(r) > 2 AND len(string_split(r, ' ')) <= 4)"


@query(
    "bridge_terms",
    f"""WITH {_SPARSE_SQL}, seeds AS (SELECT item_id, pid, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pid) AS BIGINT) AS seed FROM sc QUALIFY seed <= 3),
ph AS (SELECT item_id, seed, phrase, count(*) AS tf FROM (SELECT item_id, seed, unnest({_phrases_sql("array_to_string(tok, ' ')")}) AS phrase FROM seeds JOIN chunks USING (pid)) GROUP BY ALL),
df AS (SELECT phrase, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_phrases_sql('text')}) AS phrase FROM documents) GROUP BY phrase),
w AS (SELECT item_id, seed, phrase, coalesce(df, 0) AS df, round(tf * ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(df, 0))), 9) AS weight FROM ph LEFT JOIN df USING (phrase))
SELECT item_id, seed, phrase, CAST(df AS BIGINT) AS df, CAST(row_number() OVER (PARTITION BY item_id, seed ORDER BY weight DESC, phrase) AS BIGINT) AS rank FROM w QUALIFY rank <= 24""",
)
def bridge_terms(t: Tables) -> DataFrame:
    """The phrases of each of the three best passages that matter most: often there and rare in the corpus, 24 at most."""
    seeds = _sparse_found(t, 3).select("query", "pid", "rank")
    texts = _with_chunks(t, seeds).select("query", "rank", F.array_join("tok", " ").alias("passage"))
    held = texts.select(F.col("query").alias("item_id"), F.col("rank").alias("seed"), F.explode(bridge_phrases(F.col("passage"), X.STOPWORDS)).alias("phrase"))
    held = stable(held.groupBy("item_id", "seed", "phrase").agg(F.count(F.lit(1)).alias("tf")))
    # Only phrases that are asked for are counted in the corpus, each once a document before any shuffle.
    seen = t.documents.select(F.explode(F.array_distinct(bridge_phrases(F.col("text"), X.STOPWORDS))).alias("phrase"))
    df = seen.join(held.select("phrase").distinct(), "phrase", "left_semi").groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    n = t.documents.count()
    weight = F.round(F.col("tf") * F.log((1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))), 9)
    found = R.top(held.join(df, "phrase", "left").withColumn("weight", weight), 24, ["item_id", "seed"], F.desc("weight"), "phrase")
    return found.select("item_id", "seed", "phrase", F.coalesce("df", F.lit(0)).cast("long").alias("df"), "rank")
