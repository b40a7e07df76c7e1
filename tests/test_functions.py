"""Expressions against plain Python on hand-made and random rows."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions import metrics as M
from quern.functions import text as X
from quern.operators import packing as P


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def norm(s):
    s = "".join(c for c in re.sub(r"\s*_\s*", "_", s.lower()) if c not in string.punctuation)
    return " ".join(w for w in s.split() if w not in ("a", "an", "the"))


@pytest.mark.parametrize("text", ["The Cat_sat", "a  b\tc", "An apple, the pear!", "", "the", "Ünï côde the"])
def test_normalizers(spark, text):
    assert one(spark, X.normalize_a(F.col("t")), t=text) == norm(text)
    assert one(spark, X.normalize_d(F.col("t")), t=text + "—“x”…") == " ".join(w for w in re.sub(f"[{re.escape(string.punctuation)}]", " ", (text + '-"x"...').lower()).split() if w not in ("a", "an", "the"))


def test_extractors(spark):
    assert one(spark, X.answer_span(F.col("t"), F.col("g")), t="Yes, it is.", g="yes") == "yes"
    assert one(spark, X.answer_span(F.col("t"), F.col("g")), t="\n- **Paris** is it. More", g="x") == "Paris is it"
    assert one(spark, X.answer_span(F.col("t"), F.col("g")), t="", g="x") == ""
    assert one(spark, X.needle_answer(F.col("t")), t="The word is blue sky. ") == "blue sky"
    assert one(spark, X.wiki_clean(F.col("t")), t="A [12] b[edit]  c") == "A b c"
    assert one(spark, X.unescape(F.col("t")), t=" a &amp;lt; b ") == "a &lt; b"
    assert one(spark, X.is_refusal(F.col("t")), t="The passages do not mention X") and not one(spark, X.is_refusal(F.col("t")), t="passages do not mentionable")
    assert one(spark, X.is_refusal(F.col("t"), False), t="Answer not in context.") and not one(spark, X.is_refusal(F.col("t"), False), t="It is not clear")
    assert one(spark, X.sentences(F.col("t")), t="A b. C! D") == ["A b.", "C!", "D"]
    assert one(spark, X.paragraphs(F.col("t")), t="a\n\nb\n\nc") == ["a", "b", "c"] and one(spark, X.paragraphs(F.col("t")), t="a\nb") == ["a", "b"]
    assert one(spark, X.sub_queries(F.col("q"), F.col("t")), q="main", t="1. first one\n- no\n* second") == ["main", "first one", "second"]
    assert one(spark, X.with_full_stop(F.col("t")), t="ab") == "ab." and one(spark, X.human_bytes(F.col("t")), t=2048.0) == "2.00 KB"
    assert len(X.REFUSALS) == 59
    assert one(spark, X.page_url({"title": F.col("t"), "url": F.col("u")}, "https://w/"), t="A b", u=" ") == "https://w/A_b"
    assert one(spark, X.context_of(F.col("p")), p=["x", "", "x", "y"]) == "x\n\ny"


def test_metrics(spark):
    rnd = random.Random(0)
    for _ in range(25):
        p, g = ([rnd.choice("xyzw") for _ in range(rnd.randint(0, 7))] for _ in range(2))
        common = sum(min(p.count(w), g.count(w)) for w in set(p))
        want = 2 * (common / len(p)) * (common / len(g)) / (common / len(p) + common / len(g)) if common else 0.0
        assert one(spark, M.token_f1(F.col("p"), F.col("g")), p=" ".join(p), g=" ".join(g)) == pytest.approx(want)
    assert one(spark, M.token_f1(F.col("p"), F.col("g"), 1.0), p="the", g="a") == 1.0
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert M.lcs_length(a, b) == table[-1][-1]
    assert one(spark, M.gold_in_retrieved(F.col("g"), F.col("c")), g="w x y z", c="w q x") and not one(spark, M.gold_in_retrieved(F.col("g"), F.col("c")), g="w x", c="w q")


def test_arrays(spark):
    tok = [f"t{i}" for i in range(23)]
    assert one(spark, A.windows(F.col("a"), 10, 2, None), a=tok) == [tok[s : s + 10] for s in range(0, 23, 8)]
    assert one(spark, A.windows(F.col("a"), 10, 2, 12), a=tok) == [tok[:10], tok[8:12]]
    assert [len(c) for c in one(spark, A.even_split(F.col("a"), 10), a=tok)] == [8, 8, 7]
    assert one(spark, A.truncate_middle(F.col("a"), 10, 4), a=tok) == tok[:3] + tok[-3:]
    assert one(spark, A.labels_of(F.col("a"), F.lit(1), F.lit(3)), a=[5, 6, 7, 8]) == [-100, 6, 7, -100]
    assert one(spark, A.padded(F.col("a"), 3, F.lit(0), True), a=[5]) == [0, 0, 5] and one(spark, A.fixed_length(F.col("a"), 2, F.lit(0)), a=[5]) == [5, 0]
    assert one(spark, A.subsequence_starts(F.col("a"), F.col("b")), a=[1, 2, 1, 2, 1], b=[1, 2]) == [0, 2]
    assert one(spark, A.max_pool(F.array(F.col("a"), F.col("b"))), a=[1.0, 5.0], b=[3.0, 2.0]) == [3.0, 5.0] and one(spark, A.mean_pool(F.array(F.col("a"), F.col("b"))), a=[1.0, 5.0], b=[3.0, 2.0]) == [2.0, 3.5]
    assert one(spark, A.norm(A.unit(F.col("a"))), a=[3.0, 4.0]) == pytest.approx(1.0)


def test_packs_by_definition():
    rnd = random.Random(9)
    for _ in range(300):
        n = rnd.randint(0, 20)
        a, c = [rnd.randint(1, 12) for _ in range(n)], [rnd.randint(1, 12) for _ in range(n)]
        got = P.packs(a, c, 20, 15, 4)
        pos = pack = 0
        want = [-1] * n
        while pos < n:  # the longest run from here that fits
            end = pos
            while end < n and sum(a[pos : end + 1]) <= 20 and sum(c[pos : end + 1]) <= 15 and end - pos < 4:
                end += 1
            if end == pos:
                pos += 1
                continue
            for k in range(pos, end):
                want[k] = pack
            pack, pos = pack + 1, end
        assert got == want
    assert P.packs([25, 5, 5, 25, 5], [1] * 5, 20, 15) == [-1, 0, 0, -1, 1]
    assert P.qa_batches([5, 5, 30, 5], 12, -1) == [0, 0, -1, 1] and P.qa_batches([3, 3], 12, 4) == [0, 0]


def test_statistics_keep_null_groups(spark):
    from pyspark.sql import functions as F

    from quern.operators.reporting import nine_stats

    rows = [("a", 1.0), ("a", 4.0), (None, 2.0), (None, 2.0), (None, 9.0), ("n", None)]
    got = {r["name"]: r for r in nine_stats(spark.createDataFrame(rows, "name string, value double"), "value", None, F.col("name")).collect()}
    assert set(got) == {"a", None, "n"}
    assert (got["a"]["median"], got["a"]["p95"], got["a"]["count"]) == (2.5, 1.0, 2)
    assert (got[None]["median"], got[None]["p95"], got[None]["total"]) == (2.0, 2.0, 13.0)
    assert got["n"]["median"] is None and got["n"]["count"] == 1


def test_bm25_by_joins_and_by_matrices(spark):
    """Both ways to score give the same rows."""
    from quern.operators import retrieval as R

    words = ["ab", "bc", "cd", "de", "ef", "the"]
    chunks = spark.createDataFrame([(k, [words[(k * j) % 6] for j in range(1, 3 + k % 7)]) for k in range(60)] + [(99, [])], "pid long, tok array<string>")
    asked = spark.createDataFrame([(1, ["ab", "the", "ab"]), (2, ["zz"]), (3, ["ef", "cd"])], "item_id long, tok array<string>")
    rows = lambda most: sorted(map(tuple, R.bm25(chunks, asked, 5, most=most).select("item_id", "pid", "score", "rank").collect()))
    assert rows(0) == rows(100) and rows(100)
    assert R.bm25(chunks, asked.where("item_id = 2"), 5).count() == 0


def test_template_membership(spark):
    from pyspark.sql import functions as F

    from quern.functions import templates as P

    df = spark.createDataFrame([("longbench/qasper_e",), ("squad_e",), ("drop",), ("longbench/hotpotqa_e",)], "name string")
    got = [tuple(r) for r in df.select(P.member_of(F.col("name"), P.CLOSED_QA_SETS), P.member_of(F.col("name"), P.MULTI_ANSWER_SETS)).collect()]
    assert got == [(True, True), (False, False), (True, True), (False, True)] and len(P.CLOSED_QA) == 22
