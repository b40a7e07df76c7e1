"""Training-data compilation: chunking, labels, positions, padding, batching, packing, losses, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions import text as X
from quern.operators import packing as P
from quern.plans.registry import Tables, h8, query, tokens
from quern.plans.text_queries import QA_SQL, qa

_TOK = f"tk AS (SELECT doc_id, {tokens('text')} AS tok FROM documents WHERE text IS NOT NULL)"


def _tok(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", X.tokens(F.col("text")).alias("tok"))


@query(
    "chunk_even_affix",
    f"""WITH {_TOK}, n AS (SELECT doc_id, tok, CAST(ceil(len(tok) / 512) AS INTEGER) AS n FROM tk WHERE len(tok) > 0), z AS (SELECT *, CAST(ceil(len(tok) / n) AS INTEGER) AS size FROM n),
c AS (SELECT doc_id, unnest(range(0, len(tok), size)) AS s, tok, size FROM z)
SELECT doc_id, CAST(s // size AS INTEGER) AS idx, md5(array_to_string(list_concat(CASE WHEN s = 0 THEN ['<bos>', '<user>'] ELSE [] END, tok[s + 1:s + size], CASE WHEN s + size >= len(tok) THEN ['<eos>'] ELSE [] END), ' ')) AS chunk_md5 FROM c""",
)
def chunk_even_affix(t: Tables) -> DataFrame:
    chunks = A.affixed(A.even_split(F.col("tok"), 512), ["<bos>", "<user>"], ["<eos>"])
    return _tok(t).select("doc_id", F.posexplode(chunks).alias("idx", "c")).select("doc_id", "idx", F.md5(F.array_join("c", " ")).alias("chunk_md5"))


@query("truncate_middle", f"WITH {_TOK} SELECT doc_id, CAST(len(tok) AS INTEGER) AS n, md5(array_to_string(CASE WHEN len(tok) > 256 THEN list_concat(tok[1:96], tok[len(tok) - 95:]) ELSE tok END, ' ')) AS kept_md5 FROM tk")
def truncate_middle(t: Tables) -> DataFrame:
    return _tok(t).select("doc_id", F.size("tok").alias("n"), F.md5(F.array_join(A.truncate_middle(F.col("tok"), 256, 64), " ")).alias("kept_md5"))


@query("messages_build", f"WITH {QA_SQL} SELECT conv_id, turn, 'You are a helpful assistant.' AS system, 'Answer the question based on the text.' || chr(10) || chr(10) || 'Question: ' || trim(gold, ' ') AS user, trim(pred, ' ') AS assistant FROM qa")
def messages_build(t: Tables) -> DataFrame:
    user = F.concat(F.lit("Answer the question based on the text.\n\nQuestion: "), F.trim("gold"))
    return qa(t).select("conv_id", "turn", F.lit("You are a helpful assistant.").alias("system"), user.alias("user"), F.trim("pred").alias("assistant"))


@query("chat_text", "SELECT conv_id, string_agg('Message from: ' || upper(role[1]) || role[2:] || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_text(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return g.select("conv_id", X.chat_text(F.col("m")).alias("chat"))


_TURNS = "tn AS (SELECT conv_id, turn, role, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS n FROM conversations)"


@query("labels_mask", f"WITH {_TURNS} SELECT conv_id, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS supervised, list(CASE WHEN role = 'assistant' THEN n ELSE -100 END ORDER BY turn) AS spans FROM tn GROUP BY conv_id")
def labels_mask(t: Tables) -> DataFrame:
    """Only the assistant's tokens carry labels; each turn's span is its length or -100."""
    tn = t.conversations.select("conv_id", "turn", "role", F.size(X.tokens(F.col("text"))).cast("long").alias("n"))
    span = F.when(F.col("role") == "assistant", F.col("n")).otherwise(F.lit(A.IGNORE).cast("long"))
    g = tn.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("supervised"), F.sort_array(F.collect_list(F.struct("turn", span.alias("s")))).alias("l"))
    return g.select("conv_id", "tokens", "supervised", F.col("l.s").alias("spans"))


@query("response_labels", f"WITH {QA_SQL}, l AS (SELECT conv_id, turn, {tokens('gold')} AS q, {tokens('pred')} AS a FROM qa) SELECT conv_id, turn, array_to_string(list_concat(list_transform(q, lambda w: -100), list_transform(a, lambda w: length(w))), ' ') AS labels FROM l")
def response_labels(t: Tables) -> DataFrame:
    """Ids are word lengths; -100 outside the response's span."""
    tok = qa(t).select("conv_id", "turn", X.tokens(F.col("gold")).alias("q"), X.tokens(F.col("pred")).alias("a"))
    ids = F.transform(F.concat("q", "a"), F.length)
    return tok.select("conv_id", "turn", F.array_join(F.transform(A.labels_of(ids, F.size("q"), F.size("q") + F.size("a")), lambda x: x.cast("string")), " ").alias("labels"))


@query("position_ids", f"WITH {_TURNS} SELECT conv_id, string_agg(array_to_string(range(0, n), ' '), ' ' ORDER BY turn) AS positions FROM tn GROUP BY conv_id")
def position_ids(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", X.tokens(F.col("text")).alias("tok")))).alias("l"))
    return g.select("conv_id", F.array_join(F.transform(A.position_ids(F.col("l.tok")), lambda x: x.cast("string")), " ").alias("positions"))


@query("sequence_boundaries", f"WITH {_TURNS}, p AS (SELECT conv_id, turn, unnest(range(0, n)) AS pos FROM tn), b AS (SELECT conv_id, turn, pos, lead(pos) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS nxt FROM p) SELECT conv_id, CAST(count(*) FILTER (WHERE nxt IS NULL OR nxt <= pos) AS BIGINT) AS sequences, CAST(count(*) AS BIGINT) AS tokens FROM b GROUP BY conv_id")
def sequence_boundaries(t: Tables) -> DataFrame:
    """A sequence ends where the next position id doesn't rise."""
    n = F.size(X.tokens(F.col("text")))
    p = t.conversations.where(n > 0).select("conv_id", "turn", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    b = p.withColumn("nxt", F.lead("pos").over(Window.partitionBy("conv_id").orderBy("turn", "pos")))
    return b.groupBy("conv_id").agg(F.count_if(F.col("nxt").isNull() | (F.col("nxt") <= F.col("pos"))).alias("sequences"), F.count(F.lit(1)).alias("tokens"))


@query("pad_mask", f"WITH {_TURNS}, m AS (SELECT conv_id, turn, n, max(n) OVER (PARTITION BY conv_id) AS w FROM tn) SELECT conv_id, turn, array_to_string(list_concat(list_transform(range(0, n), lambda i: 1), list_transform(range(n, w), lambda i: 0)), '') AS right_mask, array_to_string(list_concat(list_transform(range(n, w), lambda i: 0), list_transform(range(0, n), lambda i: 1)), '') AS left_mask FROM m")
def pad_mask(t: Tables) -> DataFrame:
    """Attention masks after padding to the batch's longest, here a conversation's."""
    tn = t.conversations.select("conv_id", "turn", F.transform(X.tokens(F.col("text")), lambda w: F.lit("1")).alias("ones"))
    m = tn.withColumn("w", F.max(F.size("ones")).over(Window.partitionBy("conv_id")))
    mask = lambda left: F.array_join(A.padded(F.col("ones"), F.col("w"), F.lit("0"), left), "")
    return m.select("conv_id", "turn", mask(False).alias("right_mask"), mask(True).alias("left_mask"))


@query("fixed_length", f"WITH {QA_SQL}, l AS (SELECT conv_id, turn, {tokens('gold')} AS q FROM qa) SELECT conv_id, turn, array_to_string(list_concat(q, list_transform(range(0, 128), lambda i: '<pad>'))[1:128], ' ') AS ids, CAST(least(len(q), 128) AS INTEGER) AS used FROM l")
def fixed_length(t: Tables) -> DataFrame:
    q = X.tokens(F.col("gold"))
    return qa(t).select("conv_id", "turn", F.array_join(A.fixed_length(q, 128, F.lit("<pad>")), " ").alias("ids"), F.least(F.size(q), F.lit(128)).alias("used"))


@query("repeat_to_length", "WITH b AS (SELECT item_id, string_split(text, ' ') AS tok FROM benchmark) SELECT item_id, md5(array_to_string(list_transform(range(0, 1000), lambda i: tok[i % len(tok) + 1]), ' ')) AS ids FROM b")
def repeat_to_length(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.md5(F.array_join(A.repeated_to(F.split("text", " "), 1000), " ")).alias("ids"))


@query("subsequence_search", f"WITH {_TOK}, s AS (SELECT doc_id, list_filter(range(0, len(tok) - 1), lambda i: lower(tok[i + 1]) = 'of' AND lower(tok[i + 2]) = 'the') AS places FROM tk) SELECT doc_id, CAST(len(places) AS INTEGER) AS hits, coalesce(CAST(places[1] AS INTEGER), -1) AS first, coalesce(CAST(places[len(places)] AS INTEGER), -1) AS last FROM s")
def subsequence_search(t: Tables) -> DataFrame:
    d = _tok(t).select("doc_id", F.transform("tok", F.lower).alias("tok"))
    # Positions of the pattern's first word are few: only they are compared with the pattern.
    pattern = F.array(F.lit("of"), F.lit("the"))
    at = d.select("doc_id", F.filter(F.transform("tok", lambda w, i: F.when((w == "of") & (F.slice("tok", i + 1, 2) == pattern), i)), lambda i: i.isNotNull()).alias("at"))
    return at.select("doc_id", F.size("at").alias("hits"), F.coalesce(F.try_element_at("at", F.lit(1)), F.lit(-1)).alias("first"), F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(-1)).alias("last"))


_ITEMS = f"it AS (SELECT doc_id // 125 AS batch_id, doc_id AS pos, len({tokens('text')}) AS len, length(text) AS ctx_len FROM documents)"


def _items(t: Tables) -> DataFrame:
    return t.documents.select(F.floor(F.col("doc_id") / 125).cast("long").alias("batch_id"), F.col("doc_id").alias("pos"), F.size(X.tokens(F.col("text"))).cast("long").alias("len"), F.length("text").cast("long").alias("ctx_len"))


_PACK_SQL = f"""{_ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS i FROM it),
p AS (SELECT batch_id, i, pos, len, ctx_len, CASE WHEN len <= 2048 AND ctx_len <= 12000 THEN 0 ELSE -1 END AS pack, CASE WHEN len <= 2048 AND ctx_len <= 12000 THEN 0 ELSE -1 END AS latest,
  CASE WHEN len <= 2048 AND ctx_len <= 12000 THEN len ELSE 1000000 END AS ua, CASE WHEN len <= 2048 AND ctx_len <= 12000 THEN ctx_len ELSE 1000000 END AS ub FROM o WHERE i = 1
 UNION ALL SELECT o.batch_id, o.i, o.pos, o.len, o.ctx_len,
  CASE WHEN o.len > 2048 OR o.ctx_len > 12000 THEN -1 WHEN ua + o.len <= 2048 AND ub + o.ctx_len <= 12000 THEN latest ELSE latest + 1 END,
  CASE WHEN o.len > 2048 OR o.ctx_len > 12000 THEN latest WHEN ua + o.len <= 2048 AND ub + o.ctx_len <= 12000 THEN latest ELSE latest + 1 END,
  CASE WHEN o.len > 2048 OR o.ctx_len > 12000 THEN 1000000 WHEN ua + o.len <= 2048 AND ub + o.ctx_len <= 12000 THEN ua + o.len ELSE o.len END,
  CASE WHEN o.len > 2048 OR o.ctx_len > 12000 THEN 1000000 WHEN ua + o.len <= 2048 AND ub + o.ctx_len <= 12000 THEN ub + o.ctx_len ELSE o.ctx_len END
  FROM p JOIN o ON o.batch_id = p.batch_id AND o.i = p.i + 1)"""


@query("pack_greedy", f"WITH RECURSIVE {_PACK_SQL} SELECT batch_id, pos, CAST(len AS BIGINT) AS len, CAST(ctx_len AS BIGINT) AS ctx_len, CAST(pack AS BIGINT) AS pack FROM p")
def pack_greedy(t: Tables) -> DataFrame:
    return P.pack_greedy(_items(t), 2048, 12000)


@query("pack_stats", f"WITH RECURSIVE {_PACK_SQL}, g AS (SELECT batch_id, pack, sum(len) AS len, count(*) AS items FROM p WHERE pack >= 0 GROUP BY batch_id, pack) SELECT CAST(count(*) AS BIGINT) AS packs, round(avg(len / 2048), 6) AS efficiency, round(avg(len), 4) AS len_avg, round(stddev_pop(len), 4) AS len_std, CAST(min(len) AS BIGINT) AS len_min, CAST(max(len) AS BIGINT) AS len_max, CAST(max(items) AS BIGINT) AS most_items FROM g")
def pack_stats(t: Tables) -> DataFrame:
    g = P.pack_greedy(_items(t), 2048, 12000).where("pack >= 0").groupBy("batch_id", "pack").agg(F.sum("len").alias("len"), F.count(F.lit(1)).alias("items"))
    return g.agg(
        F.count(F.lit(1)).alias("packs"), F.round(F.avg(F.col("len") / 2048), 6).alias("efficiency"), F.round(F.avg("len"), 4).alias("len_avg"), F.round(F.stddev_pop("len"), 4).alias("len_std"),
        F.min("len").alias("len_min"), F.max("len").alias("len_max"), F.max("items").alias("most_items"),
    )


@query(
    "qa_batch_greedy",
    f"""WITH RECURSIVE {QA_SQL}, b AS (SELECT conv_id, turn AS pos, len({tokens('gold')}) + len({tokens('pred')}) AS len FROM qa),
w AS (SELECT *, sum(len) OVER (PARTITION BY conv_id) <= 300 AND count(*) OVER (PARTITION BY conv_id) <= 3 AS fits FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM w),
p AS (SELECT conv_id, i, pos, len, CASE WHEN NOT fits AND len > 300 THEN -1 ELSE 0 END AS batch, CAST(0 AS BIGINT) AS latest, CASE WHEN NOT fits AND len > 300 THEN 0 ELSE len END AS used, CASE WHEN NOT fits AND len > 300 THEN 0 ELSE 1 END AS n FROM o WHERE i = 1
 UNION ALL SELECT o.conv_id, o.i, o.pos, o.len, CASE WHEN o.fits THEN 0 WHEN o.len > 300 THEN -1 WHEN used + o.len <= 300 AND n < 3 THEN latest WHEN n > 0 THEN latest + 1 ELSE latest END,
  CASE WHEN o.fits OR o.len > 300 THEN latest WHEN used + o.len <= 300 AND n < 3 THEN latest WHEN n > 0 THEN latest + 1 ELSE latest END,
  CASE WHEN o.len > 300 THEN used WHEN used + o.len <= 300 AND n < 3 THEN used + o.len ELSE o.len END, CASE WHEN o.len > 300 THEN n WHEN used + o.len <= 300 AND n < 3 THEN n + 1 ELSE 1 END
  FROM p JOIN o ON o.conv_id = p.conv_id AND o.i = p.i + 1)
SELECT conv_id, pos, CAST(len AS BIGINT) AS len, CAST(batch AS BIGINT) AS batch FROM p""",
)
def qa_batch_greedy(t: Tables) -> DataFrame:
    n = F.size(X.tokens(F.col("gold"))) + F.size(X.tokens(F.col("pred")))
    return P.batch_questions(qa(t).select("conv_id", F.col("turn").alias("pos"), n.alias("len")), ["conv_id"], 300, 3)


@query("chunk_count_draw", f"WITH d AS (SELECT doc_id, CAST(greatest(1, ceil(length(text) / 2000)) AS INTEGER) AS need, {h8('doc_id', 'chunks')} / 4294967296.0 AS u FROM documents) SELECT doc_id, need, CASE WHEN need > 4 THEN need ELSE greatest(need, CASE need WHEN 1 THEN CASE WHEN u < 0.4 THEN 1 WHEN u < 0.7 THEN 2 WHEN u < 0.9 THEN 3 ELSE 4 END WHEN 2 THEN CASE WHEN u < 0.5 THEN 2 WHEN u < 0.5 + 0.2 / 0.6 THEN 3 ELSE 4 END WHEN 3 THEN CASE WHEN u < 0.2 / 0.3 THEN 3 ELSE 4 END ELSE 4 END) END AS chunks FROM d")
def chunk_count_draw(t: Tables) -> DataFrame:
    """A weighted draw among feasible chunk counts: 1 to 4 with weights .4 .3 .2 .1; beyond, what is needed."""
    need = F.greatest(F.lit(1), F.ceil(F.length("text") / 2000)).cast("int")
    d = t.documents.select("doc_id", need.alias("need"), X.hash_unit(F.col("doc_id"), "chunks").alias("u"))
    n, u = F.col("need"), F.col("u")
    draw = F.when(n == 1, F.when(u < 0.4, 1).when(u < 0.7, 2).when(u < 0.9, 3).otherwise(4)).when(n == 2, F.when(u < 0.5, 2).when(u < 0.5 + 0.2 / 0.6, 3).otherwise(4)).when(n == 3, F.when(u < 0.2 / 0.3, 3).otherwise(4)).otherwise(n)
    return d.select("doc_id", "need", draw.alias("chunks"))


@query("nested_mean_loss", "WITH t AS (SELECT l_orderkey AS ctx, l_suppkey % 4 AS q, l_discount AS loss FROM lineitem), a AS (SELECT ctx, q, avg(loss) AS m FROM t GROUP BY ctx, q), b AS (SELECT ctx, avg(m) AS m FROM a GROUP BY ctx) SELECT round(avg(m), 8) AS loss, CAST(count(*) AS BIGINT) AS contexts FROM b")
def nested_mean_loss(t: Tables) -> DataFrame:
    """Token losses averaged by question, then by context, then over all."""
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("ctx"), (F.col("l_suppkey") % 4).alias("q")).agg(F.avg("l_discount").alias("m"))
    return q.groupBy("ctx").agg(F.avg("m").alias("m")).agg(F.round(F.avg("m"), 8).alias("loss"), F.count(F.lit(1)).alias("contexts"))


@query("distill_token_loss", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), z AS (SELECT vec_id, v, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS lse FROM e), k AS (SELECT vec_id, lse, list_sort(v, 'DESC')[1:16] AS top FROM z) SELECT vec_id, round(-list_sum(list_transform(top, lambda x: exp(x - lse) * (x - lse))), 6) AS loss FROM k")
def distill_token_loss(t: Tables) -> DataFrame:
    """Teacher's top 16 probabilities times the student's log probabilities, summed; here both are the same logits."""
    from quern.functions.metrics import let

    v = F.transform("embedding", lambda x: x.cast("double"))

    def loss(x, lse):
        return -F.aggregate(F.slice(F.sort_array(x, False), 1, 16), F.lit(0.0), lambda s, y: s + F.exp(y - lse) * (y - lse))

    total = lambda x: F.log(F.aggregate(x, F.lit(0.0), lambda s, y: s + F.exp(y)))
    return t.embeddings.select("vec_id", F.round(let(lambda x: let(lambda y, s: loss(y, s), x, total(x)), v), 6).alias("loss"))


@query(
    "token_prefix_match",
    f"WITH {QA_SQL}, k AS (SELECT conv_id, turn, {tokens('lower(gold)')} AS g, {tokens('lower(pred)')} AS p FROM qa), m AS (SELECT conv_id, turn, list_transform(range(1, least(len(g), len(p)) + 1), lambda i: g[i] = p[i]) AS same FROM k) SELECT conv_id, turn, round(len(list_filter(same, lambda x: x)) / greatest(len(same), 1), 6) AS accuracy, round(coalesce(list_position(same, false), 0) / 1.0, 1) AS first_wrong FROM m",
)
def token_prefix_match(t: Tables) -> DataFrame:
    same = F.zip_with(X.lower_tokens(F.col("gold")), X.lower_tokens(F.col("pred")), lambda a, b: a == b)
    both = F.filter(same, lambda x: x.isNotNull())
    m = qa(t).select("conv_id", "turn", both.alias("same"))
    return m.select("conv_id", "turn", F.round(F.size(F.filter("same", lambda x: x)) / F.greatest(F.size("same"), F.lit(1)), 6).alias("accuracy"), F.array_position("same", F.lit(False)).cast("double").alias("first_wrong"))


#: Templates, of which a hash picks one.
TEMPLATES = ("Answer without any explanation.\n\nQuestion: {}", "Give the answer to the question. Do not include any other text.\n\nQuestion: {}", "The question is: {}. Provide the answer based on the text, and nothing more.")


@query("template_pick", "SELECT item_id, replace([" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in TEMPLATES) + f"][{h8('item_id', 'template')} % {len(TEMPLATES)} + 1], '{{}}', text) AS prompt FROM benchmark")
def template_pick(t: Tables) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, TEMPLATES)), (X.hash_int(F.col("item_id"), "template", F.lit(len(TEMPLATES))) + 1).cast("int"))
    return t.benchmark.select("item_id", F.replace(pick, F.lit("{}"), F.col("text")).alias("prompt"))


@query("level_union", f"WITH {QA_SQL}, g AS (SELECT conv_id, list(gold ORDER BY turn) AS p0, list(pred ORDER BY turn) AS r0 FROM qa GROUP BY conv_id) SELECT conv_id, CAST(least(2 * len(p0), len(r0)) AS INTEGER) AS n, list_concat(p0, p0)[1:least(2 * len(p0), len(r0))] AS prompts FROM g")
def level_union(t: Tables) -> DataFrame:
    """Prompts of all levels in a row, cut to the number of responses."""
    from quern.operators.grouping import compact

    g = compact(qa(t).select("conv_id", "turn", F.col("gold").alias("prompt"), F.col("pred").alias("response")), ["conv_id"], ["turn"])
    n = F.least(F.size("prompts") * 2, F.size("responses"))
    return g.select("conv_id", n.alias("n"), F.slice(F.flatten(F.array("prompts", "prompts")), F.lit(1), n).alias("prompts"))


@query("prompt_fits", f"WITH {_TOK} SELECT doc_id, len(tok) + 64 <= 512 AS fits, CASE WHEN len(tok) + 64 > 512 THEN 'context_too_long' ELSE 'ok' END AS status FROM tk")
def prompt_fits(t: Tables) -> DataFrame:
    fits = F.size("tok") + 64 <= 512
    return _tok(t).select("doc_id", fits.alias("fits"), F.when(~fits, "context_too_long").otherwise("ok").alias("status"))


KINDS = ("mean", "max", "last", "cls")


@query("pooling", "WITH p AS (SELECT vec_id // 8 AS pid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k, vec_id FROM embeddings) SELECT pid, CAST(k - 1 AS INTEGER) AS k, round(avg(CAST(x AS DOUBLE)), 6) AS mean, max(x) AS peak, arg_max(x, vec_id) AS last, arg_min(x, vec_id) AS cls FROM p GROUP BY pid, k")
def pooling(t: Tables) -> DataFrame:
    """Mean, maximum, last and first vector of each passage of eight, by component."""
    p = t.embeddings.select(F.floor(F.col("vec_id") / 8).cast("long").alias("pid"), "vec_id", F.posexplode("embedding").alias("k", "x"))
    return p.groupBy("pid", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.max("x").alias("peak"), F.max_by("x", "vec_id").alias("last"), F.min_by("x", "vec_id").alias("cls"))


@query(
    "pooling_by_kind",
    """WITH p AS (SELECT vec_id // 8 AS pid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k, vec_id FROM embeddings),
a AS (SELECT pid, k, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(CAST(max(x) AS DOUBLE), 6) AS max, round(CAST(arg_max(x, vec_id) AS DOUBLE), 6) AS last, round(CAST(arg_min(x, vec_id) AS DOUBLE), 6) AS cls FROM p GROUP BY pid, k),
u AS (UNPIVOT a ON mean, max, last, cls INTO NAME kind VALUE x)
SELECT pid, kind, list(x ORDER BY k) AS vector FROM u GROUP BY pid, kind""",
)
def pooling_by_kind(t: Tables) -> DataFrame:
    """The same passages pooled by a chosen kind."""
    vecs = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])
    made = t.embeddings.groupBy(F.floor(F.col("vec_id") / 8).cast("long").alias("pid")).agg(vecs.alias("v"))
    kinds = F.explode(F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*(A.pooled(F.col("v"), k) for k in KINDS)))).alias("kind", "vector")
    # A negative number that rounds to nothing keeps its sign, as in the SQL.
    return made.select("pid", kinds).select("pid", "kind", F.transform("vector", lambda x: F.when(x < 0, -F.round(-x, 6)).otherwise(F.round(x, 6))).alias("vector"))
