"""Cases of findings: small inputs on which an earlier version gave other results, or did work that grows too fast."""

import glob
import os

import duckdb
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"


def shuffled(df):
    """How often the plan deals rows anew by a key, before any of it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_small_negatives_keep_their_sign(spark, tmp_path):
    """a negative component that rounds to nothing is -0.0 in the SQL's list."""
    spark.createDataFrame([(k, [-1e-7 * (k + 1), 1e-7, 0.0, -0.25], 0) for k in range(4)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {(p, k): list(map(str, v)) for p, k, v in con.execute(catalog.oracle_sql()["pooling_by_kind"]).fetchall()}
    got = {(r["pid"], r["kind"]): list(map(str, r["vector"])) for r in catalog.queries()["pooling_by_kind"](spark, str(tmp_path)).collect()}
    assert got == want and "-0.0" in got[0, "max"]


def test_contexts_are_tokenised_in_parts(spark):
    """a worker holds the ids of about MOST characters, not of all texts of an Arrow batch."""
    from pyspark.sql import functions as F

    from quern.functions import tokenize as K

    class Strict(K.ByteTokenizer):
        def encode_batch(self, texts):
            assert sum(map(len, texts)) <= 2 << 20
            return super().encode_batch(texts)

    rows = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("wörd "), 20_000).alias("text"))
    made = rows.select("id", K.tokenised(K.as_user(F.col("text")), Strict).alias("t")).select("t", K.detokenised(F.col("t.ids"), Strict).alias("d"))
    out = made.select(F.size("t.ids").alias("n"), F.length("d").alias("m")).groupBy("n", "m").count().collect()
    assert [(r["n"], r["m"], r["count"]) for r in out] == [(1 + 5 + 119_999 + 1 + 1 + 1 + 10, 12 + 5 + 99_999 + 10 + 1 + 12 + 10, 60)]


def test_sparse_search_shuffles_no_postings(spark, monkeypatch):
    """Passages are scored where they are read, with the rows that lists give; nothing is dealt by term."""
    from quern.operators import sparse_index
    from quern.plans import retrieval_queries as Q
    from quern.plans.registry import Tables

    rows = lambda: sorted(map(tuple, Q._sparse_found(Tables(spark, SF), 7).collect()))
    with monkeypatch.context() as m:
        m.setattr(Q.R, "POSTINGS", 0)
        want = rows()
    monkeypatch.setattr(sparse_index, "build", lambda *a, **k: pytest.fail("lists were built"))
    got = rows()
    assert [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want] and all(abs(a[2] - b[2]) < 2e-6 and abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_a_text_is_split_once(spark):
    """Windows of a text ask for its tokens once, not once a window."""
    from pyspark.sql import functions as F

    from quern.functions import arrays as A
    from quern.functions import text as X

    plan = spark.range(1).select(A.windows(X.tokens(F.col("id").cast("string")), 4, 2, None).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


@pytest.mark.parametrize("name", ["sparse_maxpool", "ordered_unique_ci"])
def test_rows_of_one_document_are_not_dealt_anew(spark, name):
    """what belongs to one chunk or document is worked on in its row."""
    assert shuffled(catalog.queries()[name](spark, SF)) == 0


def test_late_interaction_in_shards_and_blocks(spark, monkeypatch):
    """shards and blocks of any size give the rows of the SQL's definition."""
    from quern.plans import retrieval_queries as Q

    monkeypatch.setattr(Q, "SHARD", 5)
    monkeypatch.setattr(Q, "BLOCK", 2)
    monkeypatch.setattr(Q, "AT_ONCE", 1)
    vec = lambda k: [[float((k * 7 + j * 3 + c) % 11) for c in range(3)] for j in range(1 + k % 3)]
    made = spark.createDataFrame([(k, vec(k)) for k in range(23)], "pid long, vecs array<array<float>>")
    asked = spark.createDataFrame([(k, vec(k)) for k in (0, 4, 9, 13, 22)], "query_id long, qvecs array<array<float>>")
    got = {(r["query_id"], r["rank"]): (r["pid"], r["score"]) for r in Q.late_interaction(made, asked, 3).collect()}
    for q in (0, 4, 9, 13, 22):
        scores = sorted((-sum(max(sum(a * b for a, b in zip(x, y)) for y in vec(p)) for x in vec(q)), p) for p in range(23) if p != q)
        assert [got[q, r] for r in (1, 2, 3)] == [(p, -s) for s, p in scores[:3]]


def test_the_pipeline_learns_languages_from_all_rows(spark, monkeypatch):
    """no bound on the rows that prototypes and limits come from."""
    import corpus_pipeline
    from quern.llm import language

    asked = []
    monkeypatch.setattr(language, "learn", lambda docs, **more: asked.append(more) or language.Model([], None, None))
    monkeypatch.setattr(language, "predict", lambda docs, model, keep: docs.selectExpr("*", "1.0 AS __q_score", "true AS __q_letters"))
    corpus_pipeline.language_id(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), SF)
    assert asked[0].get("sample", language.SAMPLE) is None


def test_texts_that_lose_nothing_are_not_joined(spark):
    """op6_line_dedup: rows without stretches keep nulls, the others get theirs."""
    from quern.llm.common import joined_ids

    rows = spark.range(1000).selectExpr("id AS __q_uid", "'x' AS text")
    found = spark.createDataFrame([(3, [1]), (999, [2, 3])], "__q_uid long, gone array<int>")
    got = {r["__q_uid"]: r["gone"] for r in joined_ids(rows, found).collect()}
    assert len(got) == 1000 and {k: v for k, v in got.items() if v is not None} == {3: [1], 999: [2, 3]}


def test_texts_are_cut_where_they_are_searched(spark, monkeypatch):
    """Statistics and scores come from texts, with the rows that chunks of tokens give; no row is made for a token."""
    from pyspark.sql import functions as F

    from quern.operators import retrieval as R
    from quern.operators import scan

    text = lambda k: "".join(f"w{(k * j * j) % 23}é{' \t\n\r'[(k + j) % 4] * (1 + (k + j) % 3)}" for j in range(k % 29))
    rows = [(k, text(k)) for k in range(60)] + [(90, None), (91, ""), (92, " \n "), (93, "\u00a0w1é \u2028 \x0b W2É\x00x"), (94, "w1é"), (95, "w1é w5é  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, ["w1é", "w4é", "w1é"]), (2, ["zz"]), (3, ["w5é", "w9é", "W2É\x00x"])], "item_id long, tok array<string>")
    lowered = docs.select("doc_id", F.lower("text").alias("text"))
    chunks, texts = R.chunk_table(lowered, 5, 2), scan.Texts(lowered, 5, 2)
    monkeypatch.setattr(scan, "BYTES", 40)
    monkeypatch.setattr(scan, "HELD", 100)
    counted = scan.frequencies(texts)
    want = chunks.select(F.explode(F.array_distinct("tok")).alias("term")).groupBy("term").count()
    assert sorted((r["term"], r["df"]) for r in counted.where("term IS NOT NULL").collect()) == sorted(map(tuple, want.collect()))
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
    found = lambda of: sorted(map(tuple, R.bm25(of, asked, 7, lowered=True).select("item_id", "pid", "score", "rank").collect()))
    assert found(texts) == found(chunks) and found(texts)
    assert found(scan.Texts(docs.limit(0))) == []


@pytest.mark.parametrize("size, overlap", [(5, 2), (5, 4), (6, 0), (7, 6), (480, 80)])
def test_windows_of_split_texts(size, overlap):
    """Words and windows as the definitions have them; none goes on from one text to the next."""
    import random
    import re

    import numpy as np
    import pyarrow as pa

    from quern.operators import scan

    draw = random.Random(size)
    for _ in range(40):
        texts = ["".join(draw.choice(" \t\n\r\x0b\u00a0aé𝄞") for _ in range(draw.randrange(60))) for _ in range(draw.randrange(5))] + draw.choice([[], [""], [" "]])
        held = pa.array(["x y", *texts], pa.string()).slice(1)
        words, counts = scan._split(held)
        want = [[w for w in re.split("[ \t\n\r]+", x) if w] for x in texts]
        assert words.to_pylist() == [w for x in want for w in x] and counts.tolist() == list(map(len, want))
        part = scan._cut(np.arange(len(texts)) * 3, words, counts, size, size - overlap)
        chunks = [(3 * k * scan.CHUNKS + i, x[at : at + size]) for k, x in enumerate(want) for i, at in enumerate(range(0, len(x), size - overlap))]
        assert list(zip(part.pid.tolist(), part.sizes.tolist())) == [(p, len(x)) for p, x in chunks]
        chunk, place, index = part.found(np.arange(len(words)))
        assert sorted(zip(chunk.tolist(), place.tolist(), (words[i].as_py() for i in index.tolist()))) == [(c, i, w) for c, (_, x) in enumerate(chunks) for i, w in enumerate(x)]


def test_bm25_splits_texts_once(spark, monkeypatch):
    """one pass over texts counts terms and keeps what is asked; scores come from that, also when terms are handed on in bits."""
    from pyspark.sql import functions as F

    from quern.operators import retrieval as R
    from quern.operators import scan

    monkeypatch.setattr(scan, "BYTES", 40)
    monkeypatch.setattr(scan, "HELD", 100)
    monkeypatch.setattr(scan, "SHARES", 3)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        read.add(1)
        return " ".join(f"w{(k * j * j) % 23}é" for j in range(k % 29))

    docs = spark.range(60).repartition(3).select(F.col("id").alias("doc_id"), text.asNondeterministic()("id").alias("text"))
    asked = spark.createDataFrame([(1, ["w1é", "w4é", "w1é"]), (2, ["zz"]), (3, ["w5é", "w9é"])], "item_id long, tok array<string>")
    rows = lambda most: sorted(map(tuple, R.bm25(scan.Texts(docs, 5, 2), asked, 7, most=most, lowered=True).select("item_id", "pid", "score", "rank").collect()))
    got = rows(100)
    assert read.value == 60
    assert got == rows(0) and {r[0] for r in got} == {1, 3}


def test_counts_of_an_index(spark, monkeypatch):
    """every term of every chunk is counted once a chunk, an empty one too; of terms not asked for only how many have which df is left."""
    from collections import Counter

    import pyarrow as pa

    from quern.operators import scan

    monkeypatch.setattr(scan, "HELD", 200)
    monkeypatch.setattr(scan, "AT_ONCE", 4)
    rows = [(k, [("", "é", f"w{j * k % 7}", f"rare{k}", "w" * (70 + j))[(k + j) % 5] for j in range(k % 9)]) for k in range(80)]
    asked = pa.array(["", "absent", "w3", "é"])
    index = scan.index(spark.createDataFrame(rows, "pid long, tok array<string>").repartition(4), asked).cache()
    df = Counter(w for _, tok in rows for w in set(tok))
    counts = scan.chunk_counts(index, asked).collect()
    assert {r["term"]: r["df"] for r in counts if r["term"] is not None} == {w: df[w] for w in ("", "w3", "é")}
    assert {r["df"]: r["n"] for r in counts if r["term"] is None} == Counter(df.values())
    assert sorted((r["pid"], r["size"]) for r in index.where("share IS NULL").collect()) == [(k, len(tok)) for k, tok in rows]
    index.unpersist()
