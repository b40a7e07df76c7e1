"""Training tables on token ids: chat templates, markers, labels, packs; templates, mappings, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions import templates as P
from quern.functions import text as X
from quern.operators import grouping as G
from quern.operators import preprocess as D
from quern.operators import retrieval as R
from quern.plans.registry import Tables, h8, hkey, query, quoted, tokens
from quern.plans.retrieval_queries import _BM25_SQL, _hits, _with_chunks
from quern.plans.text_queries import QA_SQL, qa

#: Ids of the turn markers, above those of words: begin, end, user, assistant, line end.
BEGIN, END, USER, ASSISTANT, NEWLINE = 100_001, 100_002, 100_003, 100_004, 100_006


def _ids_sql(x: str) -> str:
    return f"list_transform({tokens(x)}, lambda w: {h8('w', 'id')} % 50000)"


def _ids(c) -> F.Column:
    return A.word_ids(X.tokens(c))


def _joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query(
    "fixed_chunks",
    f"WITH k AS (SELECT conv_id, turn, {_ids_sql('text')} AS ids FROM conversations), s AS (SELECT *, unnest(range(0, len(ids), 48)) AS s FROM k) SELECT conv_id, turn, CAST(s // 48 AS INTEGER) AS idx, array_to_string(list_concat(ids[s + 1:s + 64], list_transform(range(0, 64), lambda i: 0))[1:64], ' ') AS ids, CAST(len(ids[s + 1:s + 64]) AS BIGINT) AS attended FROM s",
)
def fixed_chunks(t: Tables) -> DataFrame:
    """Chunks of 64 ids that overlap by 16, padded, with the attention mask's sum."""
    c = t.conversations.select("conv_id", "turn", F.posexplode(A.fixed_chunks(_ids(F.col("text")), 64, 16)).alias("idx", "c"))
    return c.select("conv_id", "turn", "idx", _joined(F.col("c.ids")).alias("ids"), F.aggregate("c.mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("attended"))


_ROLE_SQL = f"CASE WHEN role = 'assistant' THEN {ASSISTANT} ELSE {USER} END"
_CHAT_SQL = f"""tn AS (SELECT conv_id, turn, role, list_concat([{BEGIN}, {_ROLE_SQL}, {NEWLINE}], {_ids_sql('text')}, [{END}, {NEWLINE}]) AS ids FROM conversations),
lb AS (SELECT conv_id, turn, ids, CASE WHEN role = 'assistant' THEN list_concat([-100, -100, -100], ids[4:len(ids) - 1], [-100]) ELSE list_transform(ids, lambda x: -100) END AS labels FROM tn),
ch AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(labels ORDER BY turn)) AS labels, list(len(ids) ORDER BY turn) AS lens FROM lb GROUP BY conv_id)"""


def _chat(t: Tables) -> DataFrame:
    """conv_id, ids of the whole conversation by the chat template, and the turns' lengths."""
    role = F.when(F.col("role") == "assistant", ASSISTANT).otherwise(USER).cast("long")
    mark = lambda *xs: F.array(*(x if isinstance(x, F.Column) else F.lit(x).cast("long") for x in xs))
    turn = F.concat(mark(BEGIN, role, NEWLINE), _ids(F.col("text")), mark(END, NEWLINE))
    g = t.conversations.select("conv_id", "turn", turn.alias("ids")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "ids"))).alias("l"))
    return g.select("conv_id", F.flatten("l.ids").alias("ids"), F.transform("l.ids", lambda x: F.size(x).cast("long")).alias("lens"))


def _labelled(t: Tables) -> DataFrame:
    return _chat(t).withColumn("labels", A.marked_labels(F.col("ids"), BEGIN, ASSISTANT, NEWLINE, END))


@query("chat_ids", f"WITH {_CHAT_SQL} SELECT conv_id, array_to_string(ids, ' ') AS ids, array_to_string(list_filter(ids, lambda x: x < 100000), ' ') AS words FROM ch")
def chat_ids(t: Tables) -> DataFrame:
    """Conversations as ids by the chat template, and back without markers."""
    return _chat(t).select("conv_id", _joined(F.col("ids")).alias("ids"), _joined(F.filter("ids", lambda x: x < 100_000)).alias("words"))


@query("marker_labels", f"WITH {_CHAT_SQL} SELECT conv_id, array_to_string(labels, ' ') AS labels FROM ch")
def marker_labels(t: Tables) -> DataFrame:
    """The assistant's spans found by scanning for turn markers, their terminator with them."""
    return _labelled(t).select("conv_id", _joined(F.col("labels")).alias("labels"))


@query("label_logits", f"WITH {_CHAT_SQL} SELECT conv_id, array_to_string(list_filter(range(0, len(labels) - 1), lambda i: labels[i + 2] <> -100), ' ') AS places FROM ch")
def label_logits(t: Tables) -> DataFrame:
    """Which logits predict the labels: places shifted by one."""
    return _labelled(t).select("conv_id", _joined(A.logit_places(F.col("labels"))).alias("places"))


@query(
    "marker_splice",
    f"WITH {_CHAT_SQL}, a AS (SELECT conv_id, ids, list_filter(range(0, len(ids) - 2), lambda i: ids[i + 1] = {BEGIN} AND ids[i + 2] = {ASSISTANT} AND ids[i + 3] = {NEWLINE})[1] AS place FROM ch) SELECT conv_id, array_to_string(CASE WHEN place IS NULL THEN ids ELSE list_concat(ids[1:place], [7, 8], ids[place + 4:]) END, ' ') AS ids FROM a",
)
def marker_splice(t: Tables) -> DataFrame:
    """The first marker of an assistant's turn replaced by two other ids."""
    pattern = F.array(*(F.lit(x).cast("long") for x in (BEGIN, ASSISTANT, NEWLINE)))
    a = _chat(t).withColumn("at", F.try_element_at(A.subsequence_starts(F.col("ids"), pattern), F.lit(1)))
    return a.select("conv_id", _joined(A.spliced(F.col("ids"), F.col("at"), 3, F.array(F.lit(7).cast("long"), F.lit(8).cast("long")))).alias("ids"))


@query("pack_flatten", f"WITH {_CHAT_SQL}, p AS (SELECT conv_id // 4 AS pack, list(len(ids) ORDER BY conv_id) AS lens, md5(array_to_string(flatten(list(ids ORDER BY conv_id)), ' ')) AS ids_md5, md5(array_to_string(flatten(list(range(0, len(ids)) ORDER BY conv_id)), ' ')) AS positions_md5, CAST(sum(len(list_filter(labels, lambda x: x <> -100))) AS BIGINT) AS n_labels FROM ch GROUP BY conv_id // 4) SELECT pack, CAST(len(lens) AS INTEGER) AS samples, array_to_string(list_transform(range(0, len(lens) + 1), lambda i: CAST(coalesce(list_sum(lens[1:i]), 0) AS BIGINT)), ' ') AS offsets, ids_md5, positions_md5, n_labels FROM p")
def pack_flatten(t: Tables) -> DataFrame:
    """Four conversations a pack: ids in a row, positions that restart, running offsets, and the number of labels."""
    g = _labelled(t).groupBy(F.floor(F.col("conv_id") / 4).cast("long").alias("pack")).agg(F.sort_array(F.collect_list(F.struct("conv_id", "ids", "labels"))).alias("l"))
    lens = F.transform("l.ids", lambda x: F.size(x).cast("long"))
    return g.select(
        "pack", F.size("l").alias("samples"), _joined(A.offsets(lens)).alias("offsets"), F.md5(_joined(F.flatten("l.ids"))).alias("ids_md5"),
        F.md5(_joined(A.position_ids(F.col("l.ids")))).alias("positions_md5"), F.size(F.filter(F.flatten("l.labels"), lambda x: x != A.IGNORE)).cast("long").alias("n_labels"),
    )


@query("regroup_questions", f"WITH {QA_SQL} SELECT conv_id, list(reverse(trim(gold)) ORDER BY turn) AS questions FROM qa GROUP BY conv_id")
def regroup_questions(t: Tables) -> DataFrame:
    """Groups of questions flattened, worked on one by one, and put back in their groups and order."""
    groups = G.compact(qa(t).select("conv_id", "turn", F.col("gold").alias("prompt"), F.col("pred").alias("response")), ["conv_id"], ["turn"])
    flat = groups.select("conv_id", F.posexplode("prompts").alias("pos", "q")).withColumn("q", F.reverse(F.trim("q")))
    return flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "q"))).alias("l")).select("conv_id", F.col("l.q").alias("questions"))


@query("micro_batch_counts", f"WITH {_CHAT_SQL} SELECT conv_id // 16 AS step, CAST(sum(ceil(len(ids) / 256)) AS BIGINT) AS ctx_chunks, CAST(sum(len(list_filter(labels, lambda x: x <> -100))) AS BIGINT) AS labels FROM ch GROUP BY conv_id // 16")
def micro_batch_counts(t: Tables) -> DataFrame:
    """Context chunks and labels of each step's micro-batches."""
    g = _labelled(t).groupBy(F.floor(F.col("conv_id") / 16).cast("long").alias("step"))
    return g.agg(F.sum(F.ceil(F.size("ids") / 256)).cast("long").alias("ctx_chunks"), F.sum(F.size(F.filter("labels", lambda x: x != A.IGNORE))).cast("long").alias("labels"))


@query("chunks_per_context", f"SELECT round(avg(ceil(len({tokens('text')}) / 512)), 6) AS mean_chunks, CAST(count(*) AS BIGINT) AS contexts FROM documents WHERE len({tokens('text')}) > 0")
def chunks_per_context(t: Tables) -> DataFrame:
    chunks = F.size(A.even_split(X.tokens(F.col("text")), 512))
    return t.documents.where("text IS NOT NULL").select(chunks.alias("n")).where("n > 0").agg(F.round(F.avg("n"), 6).alias("mean_chunks"), F.count(F.lit(1)).alias("contexts"))


@query("chunk_windows_first4", f"WITH tk AS (SELECT doc_id, {tokens('text')} AS tok FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, tok, unnest(range(0, len(tok), 32)[1:4]) AS s FROM tk) SELECT doc_id, CAST(s // 32 AS INTEGER) AS idx, array_to_string(tok[s + 1:s + 40], ' ') AS chunk FROM s")
def chunk_windows_first4(t: Tables) -> DataFrame:
    """Distractor blocks: at most four windows of 40 tokens of each context."""
    return t.documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.slice(A.windows(X.tokens(F.col("text")), 40, 8, None), 1, 4)).alias("idx", "c")).select("doc_id", "idx", F.array_join("c", " ").alias("chunk"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("closed_qa_templates", f"SELECT item_id, CASE WHEN {h8('item_id', 'closed')} / 4294967296.0 < 0.5 THEN replace([{', '.join(map(_literal, P.CLOSED_QA))}][{h8('item_id', 'template')} % {len(P.CLOSED_QA)} + 1], '{{input}}', text) ELSE text END AS prompt FROM benchmark")
def closed_qa_templates(t: Tables) -> DataFrame:
    """One of all templates, with a probability of one half."""
    return t.benchmark.select("item_id", P.closed_qa(F.col("text"), F.col("item_id"), 0.5).alias("prompt"))


#: Data set names by turns, one for each item.
_NAMES = (*P.EVALUATION, "longbench/qasper_e", "longbench/hotpotqa_e", "longbench/2wikimqa_e", "pwc", "squad_e")


def _named(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", "text", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("item_id") % len(_NAMES) + 1).cast("int")).alias("name"))


_NAMED_SQL = f"nm AS (SELECT item_id, text, [{quoted(_NAMES)}][item_id % {len(_NAMES)} + 1] AS name FROM benchmark)"


@query("evaluation_templates", f"WITH {_NAMED_SQL} SELECT item_id, name, CASE " + " ".join(f"WHEN name IN ('{n}'{f', {chr(39)}{n}_e{chr(39)}' if n.startswith('longbench/') else ''}) THEN replace({_literal(x)}, '{{input}}', text)" for n, x in P.EVALUATION.items()) + " ELSE text END AS prompt FROM nm")
def evaluation_templates(t: Tables) -> DataFrame:
    return _named(t).select("item_id", "name", P.evaluation(F.col("name"), F.col("text")).alias("prompt"))


def _members_sql(sets: tuple[str, ...]) -> str:
    return f"name IN ({quoted([*sets, *(f'{s}_e' for s in sets if s.startswith('longbench/'))])})"


@query("split_membership", f"WITH {_NAMED_SQL} SELECT item_id, name, {_members_sql(P.CLOSED_QA_SETS)} AS closed, {_members_sql(P.MULTI_ANSWER_SETS)} AS several FROM nm")
def split_membership(t: Tables) -> DataFrame:
    return _named(t).select("item_id", "name", P.member_of(F.col("name"), P.CLOSED_QA_SETS).alias("closed"), P.member_of(F.col("name"), P.MULTI_ANSWER_SETS).alias("several"))


@query("rag_prompts", f"WITH {QA_SQL} SELECT conv_id, turn, replace(replace({_literal(P.RAG_FULL)}, '{{context}}', pred), '{{input}}', gold) AS full_answer, replace(replace({_literal(P.RAG_SHORT)}, '{{context}}', pred), '{{input}}', gold) AS short_answer FROM qa")
def rag_prompts(t: Tables) -> DataFrame:
    fill = lambda template: P.filled(template, F.col("gold"), F.col("pred"))
    return qa(t).select("conv_id", "turn", fill(P.RAG_FULL).alias("full_answer"), fill(P.RAG_SHORT).alias("short_answer"))


@query("teacher_messages", f"WITH {QA_SQL} SELECT conv_id, turn, 'You are a helpful assistant.' AS system, pred || chr(10) || chr(10) || 'Question: ' || gold AS user FROM qa")
def teacher_messages(t: Tables) -> DataFrame:
    """One message for each context and question, the context in it."""
    groups = G.compact(qa(t).select("conv_id", "turn", F.col("gold").alias("prompt"), F.col("pred").alias("response")), ["conv_id", "turn"], ["turn"])
    one = groups.select("conv_id", "turn", F.element_at("responses", 1).alias("context"), F.explode("prompts").alias("prompt"))
    return one.select("conv_id", "turn", F.lit("You are a helpful assistant.").alias("system"), F.concat("context", F.lit("\n\nQuestion: "), "prompt").alias("user"))


def _mapped(name: str, columns: str, *, squeeze: str = "trim(source)") -> None:
    """A data set's own columns made from documents, then its mapping; SQL has the result it must come to."""
    sql = "SELECT text AS context, 'q' || doc_id AS prompt, trim(source) AS response FROM documents WHERE text IS NOT NULL AND source IS NOT NULL"
    if name == "ropes":
        sql = sql.replace("text AS context", "text || chr(10) || chr(10) || lang AS context").replace("WHERE", "WHERE lang IS NOT NULL AND")

    @query(f"map_{name}", sql)
    def run(t: Tables) -> DataFrame:
        made = D.preprocess(t.documents.selectExpr(*columns.split(" | ")), name)
        return made.select("context", F.element_at("prompts", 1).alias("prompt"), F.element_at("responses", 1).alias("response"))


_Q = "concat('q', doc_id)"
_mapped("pwc", f"text AS input | {_Q} AS prompt | concat(source, ' ') AS answer")
_mapped("squad", f"text AS context | {_Q} AS question | named_struct('text', array(concat(' ', source), 'other')) AS answers")
_mapped("drop", f"text AS passage | {_Q} AS question | named_struct('spans', array(source, 'other')) AS answers_spans")
_mapped("ropes", f"text AS background | lang AS situation | {_Q} AS question | named_struct('text', array(source)) AS answers")
_mapped("longbench", f"text AS context | {_Q} AS input | array(source, 'other') AS answers")


@query("answers_by_family", "SELECT doc_id, [source, lang] AS squad, [source, lang] AS drop_, [source, lang] AS longbench FROM documents")
def answers_by_family(t: Tables) -> DataFrame:
    """All reference answers, from where each family keeps them."""
    both = F.array("source", "lang")
    squad = D.answers_of(t.documents.select("doc_id", F.struct(both.alias("text")).alias("answers")), "squad").select("doc_id", F.col("answers").alias("squad"))
    drop = D.answers_of(t.documents.select("doc_id", F.struct(both.alias("spans")).alias("answers_spans")), "drop").select("doc_id", F.col("answers").alias("drop_"))
    longbench = D.answers_of(t.documents.select("doc_id", both.alias("answers")), "longbench").select("doc_id", F.col("answers").alias("longbench"))
    return squad.join(drop, "doc_id").join(longbench, "doc_id")


@query("flipped_columns", "SELECT doc_id, source AS context, [text] AS prompts FROM documents")
def flipped_columns(t: Tables) -> DataFrame:
    return D.flipped(t.documents.select("doc_id", F.col("text").alias("context"), F.array("source").alias("prompts"))).select("doc_id", "context", "prompts")


@query("three_way_split", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hkey('doc_id', 'three')}, doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= least(round_even(n * 0.7, 0), n) THEN 'train' WHEN rn <= least(round_even(n * 0.7, 0), n) + least(round_even(n * 0.15, 0), n - least(round_even(n * 0.7, 0), n)) THEN 'validation' ELSE 'test' END AS part FROM r")
def three_way_split(t: Tables) -> DataFrame:
    return G.split_three(t.documents.select("doc_id"), "doc_id", 0.7, 0.15, "three")


@query(
    "noise_padded_draws",
    f"WITH c AS (SELECT count(*) AS n FROM documents), d AS (SELECT item_id, lower(string_split(text, ' ')[1]) AS ans, unnest(range(0, 25)) AS k FROM benchmark), p AS (SELECT item_id, ans, k, CAST({h8('item_id * 100 + k', 'noise')} % n AS BIGINT) + 1 AS rn FROM d, c), r AS (SELECT doc_id, lower(text) AS text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents), j AS (SELECT item_id, k, doc_id FROM p JOIN r USING (rn) WHERE NOT coalesce(contains(r.text, ans), false)), a AS (SELECT item_id, list(doc_id ORDER BY k)[1:10] AS ids FROM j GROUP BY item_id) SELECT b.item_id, array_to_string(list_concat(list_transform(coalesce(ids, []), lambda x: CAST(x AS VARCHAR)), list_transform(range(0, 10), lambda i: 'noise'))[1:10], ' ') AS blocks FROM benchmark b LEFT JOIN a USING (item_id)",
)
def noise_padded_draws(t: Tables) -> DataFrame:
    """Twenty-five draws with replacement, those that hold the answer rejected, the first ten kept and filled up with noise."""
    rows = G.numbered(t.documents.select("doc_id", "text"), ["doc_id"])
    n = rows.agg(F.max("rn").alias("n"))  # one row
    d = t.benchmark.select("item_id", F.lower(F.element_at(F.split("text", " "), 1)).alias("ans"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k")).crossJoin(F.broadcast(n))
    d = d.withColumn("rn", X.hash_int(F.col("item_id") * 100 + F.col("k"), "noise", F.col("n")) + 1).drop("n")
    kept = d.join(rows, "rn").where(~F.coalesce(F.contains(F.lower("text"), F.col("ans")), F.lit(False)))
    ids = kept.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("k", F.col("doc_id").cast("string").alias("id")))).alias("l")).select("item_id", F.col("l.id").alias("ids"))
    blocks = F.slice(F.concat(F.coalesce("ids", F.array().cast("array<string>")), F.array_repeat(F.lit("noise"), 10)), 1, 10)
    return t.benchmark.select("item_id").join(ids, "item_id", "left").select("item_id", F.array_join(blocks, " ").alias("blocks"))


@query("negatives_then_originals", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hkey('doc_id', 'negative')}, doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents), u AS (SELECT 0 AS kind, a.doc_id AS context_id, b.doc_id AS prompt_id FROM r a JOIN r b ON b.rn = (a.rn + 1) % a.n WHERE a.n > 1 UNION ALL SELECT 1, doc_id, doc_id FROM documents) SELECT kind, context_id, prompt_id, CAST(row_number() OVER (ORDER BY kind, context_id) AS BIGINT) AS rn FROM u")
def negatives_then_originals(t: Tables) -> DataFrame:
    """Negative pairs, then the originals after them."""
    from quern.plans.build_queries import negative_pairs

    originals = t.documents.select(F.lit(1).alias("kind"), F.col("doc_id").alias("context_id"), F.col("doc_id").alias("prompt_id"))
    both = negative_pairs(t).select(F.lit(0).alias("kind"), "context_id", "prompt_id").unionByName(originals)
    return G.numbered(both, ["kind", "context_id"])


@query("head_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def head_rows(t: Tables) -> DataFrame:
    """The reference's `limit`: the first hundred rows; the limit is the feature."""
    return t.documents.select("doc_id").orderBy("doc_id").limit(100)


@query("name_parameters", "SELECT doc_id, CAST((doc_id % 10) / 10 AS DOUBLE) AS temperature, CASE WHEN doc_id % 2 = 0 THEN 0.25 END AS closed_qa_prob FROM documents")
def name_parameters(t: Tables) -> DataFrame:
    """Settings read from a run's name."""
    name = F.concat("source", F.lit("_temp_0."), (F.col("doc_id") % 10).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit("_closed_qa_prob_0.25")).otherwise(F.lit("")))
    name = F.coalesce(name, F.concat(F.lit("none_temp_0."), (F.col("doc_id") % 10).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit("_closed_qa_prob_0.25")).otherwise(F.lit(""))))
    number = lambda key: F.nullif(F.regexp_extract(name, f"_{key}_([0-9.]+)", 1), F.lit("")).cast("double")
    return t.documents.select("doc_id", number("temp").alias("temperature"), number("closed_qa_prob").alias("closed_qa_prob"))


@query("hyphen_words", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[- \\t\\n\\r]'), lambda w: w <> '')) AS INTEGER) AS n, list_filter(string_split_regex(text, '[- \\t\\n\\r]'), lambda w: w <> '')[1] AS first FROM documents WHERE text IS NOT NULL")
def hyphen_words(t: Tables) -> DataFrame:
    words = F.filter(F.split("text", "[- \\t\\n\\r]"), lambda w: w != "")
    return t.documents.where("text IS NOT NULL").select("doc_id", F.size(words).alias("n"), F.try_element_at(words, F.lit(1)).alias("first"))


@query("small_texts", "SELECT item_id, text || CASE WHEN regexp_matches(text, '[A-Za-z]$') THEN '.' ELSE '' END AS stopped, 'query: ' || text AS asked, 'passage: ' || text AS stored, substr(text, 1, 40) AS capped, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), '|') AS lines FROM benchmark")
def small_texts(t: Tables) -> DataFrame:
    """Full stops, role prefixes, character caps and lines that aren't blank."""
    text = F.col("text")
    return t.benchmark.select("item_id", X.with_full_stop(text).alias("stopped"), F.concat(F.lit("query: "), text).alias("asked"), F.concat(F.lit("passage: "), text).alias("stored"), F.substring(text, 1, 40).alias("capped"), F.array_join(X.nonblank_lines(text), "|").alias("lines"))


@query("sub_questions", f"WITH {QA_SQL}, g AS (SELECT conv_id, turn, gold, list_filter(list_transform(string_split('- ' || gold || chr(10) || '2) ' || pred || chr(10) || '* no', chr(10)), lambda x: trim(regexp_replace(x, '^[-*0-9.) \\t]+', ''))), lambda x: length(x) > 3) AS l FROM qa) SELECT conv_id, turn, list_concat([gold], list_filter(l, lambda x, i: x <> gold AND list_position(l, x) = i))[1:3] AS queries FROM g")
def sub_questions(t: Tables) -> DataFrame:
    """The question, then generated ones without list marks, three at most."""
    made = F.concat(F.lit("- "), "gold", F.lit("\n2) "), "pred", F.lit("\n* no"))
    return qa(t).select("conv_id", "turn", X.sub_queries(F.col("gold"), made).alias("queries"))


@query("html_entities", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages")
def html_entities(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.unescape(F.col("html")).alias("text"))


@query("page_addresses", "SELECT page_id, coalesce(nullif(trim(url), ''), 'https://example.org/wiki/' || page_id) AS address FROM pages")
def page_addresses(t: Tables) -> DataFrame:
    """The first address of a record that isn't blank, else one made from its title."""
    fields = {"wikipedia_link": F.lit(""), "url": F.col("url"), "title": F.col("page_id").cast("string")}
    return t.pages.select("page_id", X.page_url(fields, "https://example.org/wiki/").alias("address"))


@query("page_contexts", "WITH l AS (SELECT conv_id, list(text ORDER BY turn)[1:5] AS l FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i AND x <> ''), chr(10) || chr(10)) AS context FROM l")
def page_contexts(t: Tables) -> DataFrame:
    """Distinct texts of a record's first five pages, here turns."""
    g = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return g.select("conv_id", X.context_of(F.col("l.text")).alias("context"))


@query("supporting_facts", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda p, i: string_split(p, ' ')[1] || ':' || (i - 1)), ' ') AS facts FROM documents WHERE text IS NOT NULL")
def supporting_facts(t: Tables) -> DataFrame:
    """Two parallel lists, titles and places, as a list of pairs."""
    lines = F.split("text", "\n")
    titles, places = F.transform(lines, lambda p: F.element_at(F.split(p, " "), 1)), F.transform(lines, lambda _, i: i)
    pairs = F.arrays_zip(titles.alias("title"), places.alias("idx"))
    return t.documents.where("text IS NOT NULL").select("doc_id", F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["title"], x["idx"].cast("string"))), " ").alias("facts"))


@query("nested_lists", "SELECT conv_id, CAST(sum(n) AS INTEGER) AS total, list(n ORDER BY turn) AS lens, md5(array_to_string(flatten(list(w ORDER BY turn)), ' ')) AS words FROM (SELECT conv_id, turn, string_split(text, ' ') AS w, CAST(len(string_split(text, ' ')) AS INTEGER) AS n FROM conversations) GROUP BY conv_id")
def nested_lists(t: Tables) -> DataFrame:
    """Lists of lists flattened, with their lengths."""
    g = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.split("text", " ").alias("w")))).alias("l"))
    lens = F.transform("l.w", F.size)
    return g.select("conv_id", F.aggregate(lens, F.lit(0), lambda s, n: s + n).alias("total"), lens.alias("lens"), F.md5(F.array_join(F.flatten("l.w"), " ")).alias("words"))


@query("unit_vectors", "WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n, embedding FROM embeddings) SELECT vec_id, round(n, 6) AS norm, round(embedding[1] / n, 6) AS first FROM n")
def unit_vectors(t: Tables) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.round(A.norm(v), 6).alias("norm"), F.round(F.element_at(A.unit(v), 1), 6).alias("first"))


@query(
    "rerank_by_overlap",
    f"WITH {_BM25_SQL}, s AS (SELECT item_id, pid, rank AS first_rank, len(list_filter(list_distinct({tokens('lower(b.text)')}), lambda w: list_contains(list_transform(c.tok, lambda x: lower(x)), w))) / greatest(1, len(list_distinct({tokens('lower(b.text)')}))) AS score FROM hits JOIN chunks c USING (pid) JOIN benchmark b USING (item_id)) SELECT item_id, pid, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, first_rank) AS BIGINT) AS rank FROM s QUALIFY rank <= 10",
)
def rerank_by_overlap(t: Tables) -> DataFrame:
    """Candidates of the first stage scored again pair by pair; here the scorer is the share of the query's words in the passage."""
    pairs = _with_chunks(t, _hits(t)[1]).select("item_id", "pid", F.col("rank").alias("first_rank"), F.transform("tok", F.lower).alias("passage"))
    pairs = pairs.join(t.benchmark.select("item_id", F.array_distinct(X.lower_tokens(F.col("text"))).alias("query")), "item_id")
    return R.rerank(pairs, lambda q, p: F.size(F.array_intersect(q, p)) / F.greatest(F.size(q), F.lit(1)), 10).select("item_id", "pid", "score", "rank")


@query("refusal_predicates", f"WITH {QA_SQL} SELECT conv_id, turn, starts_with(lower(pred), 'the') AS refused, CASE WHEN starts_with(lower(pred), 'the') THEN 1.0 ELSE 0.0 END AS credited FROM qa")
def refusal_predicates(t: Tables) -> DataFrame:
    """Any predicate may say what a refusal is."""
    from quern.functions.metrics import credited

    refused = F.startswith(F.lower("pred"), F.lit("the"))
    return qa(t).select("conv_id", "turn", refused.alias("refused"), credited(F.lit(0.0), refused, F.lit(False)).alias("credited"))


@query("evaluator_state", f"WITH {QA_SQL}, m AS (SELECT conv_id % 7 AS task, CASE WHEN conv_id % 7 <> 3 THEN CAST(length(pred) AS DOUBLE) END AS v FROM qa) SELECT task, CASE WHEN count(v) = 0 THEN 'None' ELSE CAST(round(sum(v) / count(v), 4) AS VARCHAR) END AS value, CAST(count(v) AS BIGINT) AS n_value FROM m GROUP BY task")
def evaluator_state(t: Tables) -> DataFrame:
    """A metric kept as a sum and a count; `None` where it was never updated."""
    m = qa(t).select((F.col("conv_id") % 7).alias("task"), F.when(F.col("conv_id") % 7 != 3, F.length("pred").cast("double")).alias("v"))
    g = m.groupBy("task").agg(F.sum("v").alias("s"), F.count("v").alias("n_value"))
    return g.select("task", F.when(F.col("n_value") == 0, "None").otherwise(F.round(F.col("s") / F.col("n_value"), 4).cast("string")).alias("value"), "n_value")


@query("alias_expansion", "SELECT doc_id, task FROM (SELECT doc_id, unnest(CASE WHEN lang = 'de' THEN ['qasper', 'hotpotqa'] ELSE [lang] END) AS task FROM documents)")
def alias_expansion(t: Tables) -> DataFrame:
    """A family's name is replaced by its members, one row each."""
    families = {"de": ["qasper", "hotpotqa"]}
    known = F.create_map(*(F.lit(k) if isinstance(k, str) else F.array(*map(F.lit, k)) for pair in families.items() for k in pair))
    return t.documents.select("doc_id", F.explode(F.coalesce(F.try_element_at(known, F.col("lang")), F.array("lang"))).alias("task"))


@query("padding_side_windows", f"WITH k AS (SELECT conv_id, turn, {_ids_sql('text')} AS ids FROM conversations), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS w FROM k) SELECT conv_id, turn, array_to_string(list_concat(list_transform(range(0, w - len(ids)), lambda i: 0), ids), ' ') AS left_padded FROM w")
def padding_side_windows(t: Tables) -> DataFrame:
    """Ids padded on the left to the longest of their batch, here a conversation."""
    k = t.conversations.select("conv_id", "turn", _ids(F.col("text")).alias("ids")).withColumn("w", F.max(F.size("ids")).over(Window.partitionBy("conv_id")))
    return k.select("conv_id", "turn", _joined(A.padded(F.col("ids"), F.col("w"), F.lit(0).cast("long"), True)).alias("left_padded"))
