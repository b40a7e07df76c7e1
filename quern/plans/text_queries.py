"""Normalisers, extractors and answer metrics over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.functions import text as X
from quern.functions.arrays import once
from quern.plans.registry import Tables, f1, h8, multiset, norm_a, norm_b, query, quoted, tokens

#: Predictions and gold answers: the assistant's turn against the user's turn before it.
QA_SQL = """qa AS (SELECT conv_id, turn, q AS gold, text AS pred FROM (
  SELECT conv_id, turn, role, text, lag(text) OVER w AS q, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant' AND before = 'user')"""


def qa(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = t.conversations.withColumn("gold", F.lag("text").over(w)).withColumn("before", F.lag("role").over(w))
    return df.where("role = 'assistant' AND before = 'user'").select("conv_id", "turn", "gold", F.col("text").alias("pred"))


for _name, _f, _sql in (
    ("norm_answer_a", X.normalize_a, norm_a("text")),
    ("norm_answer_b", X.normalize_b, norm_b("text")),
    ("norm_answer_c", X.normalize_c, "array_to_string(" + tokens("regexp_replace(array_to_string(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda w: w NOT IN ('a', 'an', 'the')), ' '), '[^a-z0-9 \\t\\n\\r]', ' ', 'g')") + ", ' ')"),
    (
        "norm_answer_d",
        X.normalize_d,
        "array_to_string(list_filter(string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[­᠎​-‏‪-‮⁠⁦-⁩﻿]', '', 'g'), '[ \\t\\x0B\\f]+(\\n|$)', '\\1', 'g'), ' ', ' ', 'g'), '[—–]+', '-', 'g'), '[“”«»„]', '\"', 'g'), '[‘’ʼ]', '''', 'g')), '[!-/:-@\\[-`{-~]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')",
    ),
    ("wiki_clean", X.wiki_clean, "trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), ' ', ' ', 'g'), '(?i)\\[(?:[0-9]+|edit|citation needed|source)\\]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"),
):
    query(_name, f"SELECT doc_id, {_sql} AS result FROM documents")(lambda t, f=_f: t.documents.select("doc_id", f(F.col("text")).alias("result")))


@query(
    "answer_span",
    f"""WITH {QA_SQL}, a AS (SELECT *, string_split_regex(lower(trim(pred)), '[ \\t\\n\\r,.!?:;]+')[1] AS head,
  regexp_replace(regexp_replace(trim(pred), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '[*`]', '', 'g') AS plain FROM qa),
b AS (SELECT *, coalesce(list_filter(list_transform(string_split(plain, chr(10)), lambda x: regexp_replace(trim(x), '^[-*#0-9.)]+[ \\t]*', '')), lambda x: x <> '')[1], plain) AS line FROM a)
SELECT conv_id, turn, CASE WHEN coalesce(pred, '') = '' THEN '' WHEN {norm_a("gold")} IN ('yes', 'no') AND head IN ('yes', 'no') THEN head
  WHEN regexp_extract(line, '^(.+?[.!?])([ \\t]|$)', 1) <> '' THEN trim(regexp_replace(regexp_extract(line, '^(.+?[.!?])([ \\t]|$)', 1), '[.!?]+$', '')) ELSE trim(line) END AS span FROM b""",
)
def answer_span(t: Tables) -> DataFrame:
    return qa(t).select("conv_id", "turn", X.answer_span(F.col("pred"), F.col("gold")).alias("span"))


_PG = f"{QA_SQL}, n AS (SELECT conv_id, turn, pred, gold, {norm_a('pred')} AS np, {norm_a('gold')} AS ng FROM qa), k AS (SELECT *, {tokens('np')} AS tp, {tokens('ng')} AS tg FROM n), m AS (SELECT *, {multiset('tp', 'tg')} AS c FROM k)"


def _metric(name: str, column, sql: str) -> None:
    query(name, f"WITH RECURSIVE {_PG} {sql}")(lambda t: qa(t).select("conv_id", "turn", F.round(column(F.col("pred"), F.col("gold")), 6).alias("value")))


_metric("exact_match", M.exact_match, "SELECT conv_id, turn, CAST(np = ng AS DOUBLE) AS value FROM m")
_metric("token_f1", M.token_f1, f"SELECT conv_id, turn, round({f1('c', 'len(tp)', 'len(tg)')}, 6) AS value FROM m")
_metric("token_f1_gold_context", lambda p, g: M.token_f1(p, g, 1.0), f"SELECT conv_id, turn, round({f1('c', 'len(tp)', 'len(tg)', '1.0')}, 6) AS value FROM m")
_metric("rouge_1", M.rouge_1, f"SELECT conv_id, turn, round({f1('c', 'len(tp)', 'len(tg)')}, 6) AS value FROM m")
_metric("contain", M.contains_answer, "SELECT conv_id, turn, CASE WHEN ng = '' THEN 0.0 ELSE CAST(contains(np, ng) AS DOUBLE) END AS value FROM m")
_metric(
    "rouge_l",
    M.rouge_l,
    f""", r AS (SELECT conv_id, turn, tp, tg, 0 AS i, list_transform(range(0, len(tg) + 1), lambda j: CAST(0 AS BIGINT)) AS row FROM k
 UNION ALL SELECT conv_id, turn, tp, tg, i + 1, list_reduce(range(1, len(tg) + 1), lambda acc, j: list_append(acc, greatest(acc[len(acc)], row[j + 1], CASE WHEN tg[j] = tp[i + 1] THEN row[j] + 1 ELSE 0 END)), [CAST(0 AS BIGINT)]) FROM r WHERE i < len(tp)),
l AS (SELECT conv_id, turn, tp, tg, row[len(row)] AS c FROM r WHERE i = len(tp))
SELECT conv_id, turn, round({f1('c', 'len(tp)', 'len(tg)')}, 6) AS value FROM l""",
)


@query(
    "gold_in_retrieved",
    f"""WITH {_PG}, g AS (SELECT conv_id, turn, tp, tg, len(list_filter(tg, lambda t: list_contains(tp, t))) AS hit FROM k)
SELECT conv_id, turn, len(tg) > 0 AND (contains(array_to_string(tp, ' '), array_to_string(tg, ' ')) OR (len(tg) >= 3 AND hit / len(tg) >= 0.5)) AS found FROM g""",
)
def gold_in_retrieved(t: Tables) -> DataFrame:
    return qa(t).select("conv_id", "turn", M.gold_in_retrieved(F.col("gold"), F.col("pred")).alias("found"))


#: Every third assistant turn, by hash, is made to decline, so that refusals occur.
_DECLINED_SQL = f"{QA_SQL}, d AS (SELECT conv_id, turn, gold, CASE {h8('conv_id * 100 + turn', 'decline')} % 3 WHEN 0 THEN 'The passages do not mention it. ' || pred WHEN 1 THEN 'Answer not in context' ELSE pred END AS pred, pred AS context FROM qa)"



def _declined(t: Tables) -> DataFrame:
    k = X.hash_int(F.col("conv_id") * 100 + F.col("turn"), "decline", F.lit(3))
    pred = F.when(k == 0, F.concat(F.lit("The passages do not mention it. "), "pred")).when(k == 1, "Answer not in context").otherwise(F.col("pred"))
    return qa(t).select("conv_id", "turn", "gold", pred.alias("pred"), F.col("pred").alias("context"))


@query(
    "refusal_flags",
    f"WITH {_DECLINED_SQL}, n AS (SELECT conv_id, turn, {norm_a('pred')} AS np FROM d) SELECT conv_id, turn, len(list_filter([{quoted(X.REFUSALS)}], lambda p: np = p OR starts_with(np, p || ' '))) > 0 AS lenient, np = '{X.STRICT_REFUSAL}' OR starts_with(np, '{X.STRICT_REFUSAL} ') AS strict FROM n",
)
def refusal_flags(t: Tables) -> DataFrame:
    return _declined(t).select("conv_id", "turn", X.is_refusal(F.col("pred")).alias("lenient"), X.is_refusal(F.col("pred"), False).alias("strict"))


_CREDIT_SQL = f"""{_DECLINED_SQL}, n AS (SELECT conv_id, turn, {norm_a('pred')} AS np, {norm_a('gold')} AS ng, {norm_a('context')} AS nc FROM d),
k AS (SELECT *, {tokens('np')} AS tp, {tokens('ng')} AS tg, {tokens('nc')} AS tc FROM n),
s AS (SELECT *, np = '{X.STRICT_REFUSAL}' OR starts_with(np, '{X.STRICT_REFUSAL} ') AS refused, len(tg) > 0 AND (contains(array_to_string(tc, ' '), array_to_string(tg, ' ')) OR (len(tg) >= 3 AND len(list_filter(tg, lambda t: list_contains(tc, t))) / len(tg) >= 0.5)) AS found, {multiset('tp', 'tg')} AS c FROM k),
v AS (SELECT conv_id, turn, refused, found, CASE WHEN ng = '' THEN 0.0 ELSE CAST(contains(np, ng) AS DOUBLE) END AS co, CAST(np = ng AS DOUBLE) AS em, {f1('c', 'len(tp)', 'len(tg)')} AS f FROM s)"""


def _credited(t: Tables) -> DataFrame:
    found = M.gold_in_retrieved(F.col("gold"), F.col("context"))
    df = _declined(t).select("conv_id", "turn", X.is_refusal(F.col("pred"), False).alias("refused"), found.alias("found"), M.exact_match(F.col("pred"), F.col("gold")).alias("em"), M.token_f1(F.col("pred"), F.col("gold")).alias("f"), M.contains_answer(F.col("pred"), F.col("gold")).alias("co"), "pred", "gold")
    return df


@query("refusal_credit", f"WITH {_CREDIT_SQL} SELECT conv_id, turn, CASE WHEN refused AND NOT found THEN 1.0 ELSE em END AS em, round(CASE WHEN refused AND NOT found THEN 1.0 ELSE f END, 6) AS f1, CASE WHEN refused AND NOT found THEN 1.0 ELSE co END AS contain, refused AND NOT found AS rouge_credited FROM v")
def refusal_credit(t: Tables) -> DataFrame:
    credit = lambda m: F.when(F.col("refused") & ~F.col("found"), 1.0).otherwise(m)
    return _credited(t).select("conv_id", "turn", credit(F.col("em")).alias("em"), F.round(credit(F.col("f")), 6).alias("f1"), credit(F.col("co")).alias("contain"), (F.col("refused") & ~F.col("found") & (credit(M.rouge_l(F.col("pred"), F.col("gold"))) == 1.0)).alias("rouge_credited"))


@query(
    "metric_summary",
    f"WITH {_CREDIT_SQL} SELECT CAST(count(*) AS BIGINT) AS n, round(sum(em) / count(*), 6) AS em, round(sum(f) / count(*), 6) AS f1, round(avg(CASE WHEN refused AND NOT found THEN 1.0 ELSE f END), 6) AS aware_f1, round(avg(CAST(refused AS INTEGER)), 6) AS refusal_rate, round(avg(CAST(NOT found AS INTEGER)), 6) AS retrieval_fail, round(max(CASE WHEN NOT refused THEN f END), 6) AS best_answered FROM v",
)
def metric_summary(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    aware = F.when(F.col("refused") & ~F.col("found"), 1.0).otherwise(F.col("f"))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return _credited(t).agg(
        n.alias("n"), F.round(F.sum("em") / n, 6).alias("em"), F.round(F.sum("f") / n, 6).alias("f1"), F.round(F.avg(aware), 6).alias("aware_f1"),
        rate(F.col("refused")).alias("refusal_rate"), rate(~F.col("found")).alias("retrieval_fail"), F.round(F.max(F.when(~F.col("refused"), F.col("f"))), 6).alias("best_answered"),
    )


@query(
    "multi_answer_f1",
    f"""WITH {QA_SQL}, a AS (SELECT conv_id, turn, pred, unnest(string_split(gold, chr(10))) AS ans, generate_subscripts(string_split(gold, chr(10)), 1) AS pos FROM qa),
k AS (SELECT conv_id, turn, pos, {tokens(norm_a('pred'))} AS tp, {tokens(norm_a('ans'))} AS tg FROM a), m AS (SELECT *, {multiset('tp', 'tg')} AS c FROM k),
s AS (SELECT conv_id, turn, pos, round({f1('c', 'len(tp)', 'len(tg)')}, 9) AS f, CASE WHEN len(tp) = 0 THEN 0.0 ELSE c / len(tp) END AS p, CASE WHEN len(tg) = 0 THEN 0.0 ELSE c / len(tg) END AS r FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY f DESC, pos) AS k FROM s)
SELECT round(avg(f), 6) AS f1, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, CAST(count(*) AS BIGINT) AS n FROM b WHERE k = 1""",
)
def multi_answer_f1(t: Tables) -> DataFrame:
    a = qa(t).select("conv_id", "turn", "pred", F.posexplode(F.split("gold", "\n")).alias("pos", "ans"))
    k = a.select("conv_id", "turn", "pos", X.tokens(X.normalize_a(F.col("pred"))).alias("tp"), X.tokens(X.normalize_a(F.col("ans"))).alias("tg"))
    m = k.select("conv_id", "turn", "pos", M.common_tokens(F.col("tp"), F.col("tg")).alias("c"), F.size("tp").alias("np"), F.size("tg").alias("ng"))
    part = lambda n: F.when(F.col(n) == 0, 0.0).otherwise(F.col("c") / F.col(n))
    s = m.select("conv_id", "turn", "pos", F.round(M.f1_of(F.col("c"), F.col("np"), F.col("ng")), 9).alias("f"), part("np").alias("p"), part("ng").alias("r"))
    best = s.groupBy("conv_id", "turn").agg(F.max_by(F.struct("f", "p", "r"), F.struct("f", -F.col("pos"))).alias("b"))
    return best.agg(F.round(F.avg("b.f"), 6).alias("f1"), F.round(F.avg("b.p"), 6).alias("precision"), F.round(F.avg("b.r"), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


@query(
    "answer_accuracy",
    "WITH p AS (SELECT conv_id, list(lower(text) ORDER BY turn) FILTER (WHERE role = 'assistant') AS ctx, min_by(lower(text), turn) FILTER (WHERE role = 'user') AS a FROM conversations GROUP BY conv_id) SELECT conv_id, coalesce(len(list_filter(ctx, lambda p: contains(p, a) OR len(list_filter(string_split(a, ' '), lambda w: NOT contains(p, w))) = 0)) > 0, false) AS hit FROM p",
)
def answer_accuracy(t: Tables) -> DataFrame:
    """Each conversation's replies as passages, its first request as the answer looked for."""
    g = t.conversations.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("ctx"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("a")
    )
    return g.select("conv_id", F.coalesce(M.answer_hit(F.col("ctx.text"), F.col("a")), F.lit(False)).alias("hit"))


@query(
    "html_blocks_regex",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>|<!--.*?-->', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?(?:h[1-6]|p|li|td|th|figcaption|div|br|article|section|ul|nav)\b[^>]*>', chr(1), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, list_filter(list_transform(string_split(h, chr(1)), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))), lambda x: x <> '') AS l FROM b)
SELECT page_id, CAST(len(l) AS INTEGER) AS n_blocks, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[greatest(i - 1, 1)]), chr(10) || chr(10)) AS text FROM c""",
)
def html_blocks_regex(t: Tables) -> DataFrame:
    blocks = t.pages.select("page_id", X.html_blocks(F.col("html")).alias("l"))
    return blocks.select("page_id", F.size("l").alias("n_blocks"), F.array_join(X.drop_repeats(F.col("l")), "\n\n").alias("text"))


@query("html_text")
def html_text(t: Tables) -> DataFrame:
    """The same by a full parser: see quern.sources.html."""
    from quern.sources.html import page_text

    return t.pages.select("page_id", page_text("html").alias("text"))


@query(
    "consecutive_dedup",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), m AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE before IS NULL OR before <> line) AS BIGINT) AS n_kept FROM m GROUP BY doc_id",
)
def consecutive_dedup(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.documents.where("text IS NOT NULL").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(X.drop_repeats(lines)).cast("long").alias("n_kept"))


@query(
    "ordered_unique_ci",
    "WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS w, generate_subscripts(string_split_regex(text, '[ \\t\\n\\r]+'), 1) AS pos FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY pos) AS k FROM w WHERE w <> '') SELECT doc_id, md5(string_agg(w, ' ' ORDER BY pos)) AS words_md5, CAST(count(*) AS BIGINT) AS n FROM r WHERE k = 1 GROUP BY doc_id",
)
def ordered_unique_ci(t: Tables) -> DataFrame:
    """Distinct words in first-seen order and casing, ignoring case."""
    # Within a document's own array, sorted by word and place: the first of each word, then by place again.
    placed = F.sort_array(F.transform(X.tokens(F.col("text")), lambda w, i: F.struct(F.lower(w).alias("k"), i.alias("i"), w.alias("w"))))
    first = once(placed, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["k"] != x["k"])))
    some = t.documents.where(F.size(X.tokens(F.col("text"))) > 0)  # asked of the tokens, as a filter on `l` would make it twice
    g = some.select("doc_id", F.sort_array(F.transform(first, lambda x: F.struct(x["i"], x["w"].alias("w")))).alias("l"))
    return g.select("doc_id", F.md5(F.array_join(F.col("l.w"), " ")).alias("words_md5"), F.size("l").cast("long").alias("n"))


_GOLD_SQL = f"""{QA_SQL}, b AS (SELECT conv_id, turn, list_filter(list_transform(string_split(pred, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS paras,
  list_filter(string_split_regex(regexp_replace(lower(gold), '[!-/:-@\\[-`{{-~]', '', 'g'), '[ \\t\\n\\r]+'), lambda w: w NOT IN ('', {quoted(X.STOPWORDS)})) AS kw,
  list_filter(string_split_regex(regexp_replace(lower(string_split(pred, '.')[1]), '[!-/:-@\\[-`{{-~]', '', 'g'), '[ \\t\\n\\r]+'), lambda w: w NOT IN ('', {quoted(X.STOPWORDS)})) AS aw FROM qa),
s AS (SELECT conv_id, turn, unnest(paras) AS para, generate_subscripts(paras, 1) - 1 AS idx, kw, aw FROM b),
c AS (SELECT conv_id, turn, para, idx, CAST(len(list_filter(kw, lambda w: contains(lower(para), w))) AS DOUBLE) + 2.0 * len(list_filter(aw, lambda w: contains(lower(para), w))) AS score FROM s),
r AS (SELECT *, row_number() OVER o AS rn, coalesce(sum(length(para)) OVER (PARTITION BY conv_id, turn ORDER BY score DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM c WINDOW o AS (PARTITION BY conv_id, turn ORDER BY score DESC, idx))"""


@query("gold_paragraphs", f"WITH {_GOLD_SQL} SELECT conv_id, turn, string_agg(para, chr(10) || chr(10) ORDER BY idx) AS gold_context, CAST(count(*) AS BIGINT) AS n FROM r WHERE NOT (rn - 1 >= 3 AND cum >= 200) GROUP BY conv_id, turn")
def gold_paragraphs(t: Tables) -> DataFrame:
    """Best paragraphs by the question's keyword hits and twice the answer's, here a reply's first sentence, until there are three and 200 characters, in their own order."""
    s = qa(t).select("conv_id", "turn", F.posexplode(X.paragraphs(F.col("pred"))).alias("idx", "para"), X.keywords(F.col("gold")).alias("kw"), X.keywords(F.element_at(F.split("pred", "\\."), 1)).alias("aw"))
    c = s.withColumn("score", X.paragraph_score(F.col("para"), F.col("kw"), F.col("aw")))
    o = Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "idx")
    r = c.withColumn("rn", F.row_number().over(o)).withColumn("cum", F.coalesce(F.sum(F.length("para")).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = r.where(~((F.col("rn") - 1 >= 3) & (F.col("cum") >= 200))).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("idx", "para"))).alias("l"))
    return g.select("conv_id", "turn", F.array_join(F.col("l.para"), "\n\n").alias("gold_context"), F.size("l").cast("long").alias("n"))


@query(
    "qa_pair_parse",
    f"WITH {QA_SQL}, t AS (SELECT conv_id, turn, 'Question 1: ' || replace(gold, chr(10), ' ') || chr(10) || 'Answer 1: ' || replace(pred, chr(10), ' ') || chr(10) || 'Question 2: ' || CAST(turn AS VARCHAR) AS s FROM qa), p AS (SELECT conv_id, turn, regexp_extract_all(s, '(?m)^Question [0-9]+: *(.*)$', 1) AS qs, regexp_extract_all(s, '(?m)^Answer [0-9]+: *(.*)$', 1) AS ans FROM t) SELECT conv_id, turn, CAST(least(len(qs), len(ans)) AS INTEGER) AS n, qs[1] AS question, ans[1] AS answer FROM p",
)
def qa_pair_parse(t: Tables) -> DataFrame:
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    s = F.concat(F.lit("Question 1: "), flat(F.col("gold")), F.lit("\nAnswer 1: "), flat(F.col("pred")), F.lit("\nQuestion 2: "), F.col("turn").cast("string"))
    p = qa(t).select("conv_id", "turn", X.qa_pairs(s).alias("p"))
    return p.select("conv_id", "turn", F.size("p").alias("n"), F.col("p")[0]["question"].alias("question"), F.col("p")[0]["answer"].alias("answer"))


@query("needle_answer", "SELECT item_id, regexp_extract('The secret is ' || text, '\\bis[ \\t\\n\\r]+(.+?)\\.[ \\t\\n\\r]*$', 1) AS answer FROM benchmark")
def needle_answer(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.needle_answer(F.concat(F.lit("The secret is "), "text")).alias("answer"))
