"""Readers, sinks, streams and ordered operators on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import grouping as G
from quern.operators import retrieval as R
from quern.operators.reporting import nine_stats
from quern.sources import readers, sinks
from quern.sources.html import html_blocks
from quern.streaming.curate import curate, window_stats


def test_readers(spark, tmp_path):
    (tmp_path / "needles.json").write_text(json.dumps({"data": [{"needle": "n is x.", "question": "q"}, {"needle": "m is y.", "question": "r"}]}))
    (tmp_path / "bare.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert readers.read_needles(spark, str(tmp_path / "needles.json")).count() == 2
    assert readers.read_records(spark, str(tmp_path / "bare.json")).count() == 2
    assert readers.parse_slice("train[5:9]") == ("train", 5, 9) and readers.parse_slice("test") == ("test", 0, None)
    with pytest.raises(ValueError):
        readers.parse_slice("train[5")
    df = spark.range(100).toDF("id")
    sinks.write_shards(df, f"{tmp_path}/train_x", rows=30)
    registry = readers.Registry()
    registry.add("x", "train", f"{tmp_path}/train_x", "[10:20]")
    assert sorted(r["id"] for r in registry.read(spark, "x", "train", "id").collect()) == list(range(10, 20))
    registry.add_generated(["toy"], [(0, 127)], "{name}/{split}.jsonl")
    assert registry.entries["toy_0_127"]["test"] == ("toy/test.jsonl", "")
    assert readers.route_by_path(spark.read.parquet(f"{tmp_path}/train_x")).select("split").distinct().first()[0] == "train"
    with pytest.raises(ValueError):
        readers.require_columns(df, "nope")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_any(spark, f"{tmp_path}/none.parquet").count()


def test_sinks(spark, tmp_path):
    row = lambda **k: spark.createDataFrame([k])
    path = f"{tmp_path}/m.csv"
    sinks.upsert_csv(row(tasks="b", f1=1).union(row(tasks="a", f1=2)), path)
    sinks.upsert_csv(row(tasks="b", em=3), path)
    assert sorted((r["tasks"], r["f1"], r["em"]) for r in spark.read.option("header", True).csv(path).collect()) == [("a", "2", None), ("b", None, "3")]
    sinks.upsert_vectors(row(namespace="n", pid=1, v=1), f"{tmp_path}/v", "v")
    sinks.upsert_vectors(row(namespace="n", pid=1, v=2).union(row(namespace="n", pid=2, v=1)), f"{tmp_path}/v", "v")
    assert sorted((r["pid"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/v").collect()) == [(1, 2), (2, 1)]
    built = []
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path), {"k": 1}, lambda: (built.append(1), spark.range(3))[1]).count() == 3
    assert len(built) == 1
    sinks.write_documents(row(n=1), spark.range(2), f"{tmp_path}/doc")
    assert spark.read.json(f"{tmp_path}/doc").groupBy("kind").count().count() == 2


def test_streams(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("c", k, f"q{k}", f"a{k}"), ("c", k + 10, "z", "z")], "context string, pos int, prompt string, response string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    curate(spark, f"{tmp_path}/in", "context string, pos int, prompt string, response string", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(out) == 2 and sorted(r["prompts"][0] for r in out) == ["q0", "q1"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert window_stats(events).agg(F.sum("n")).first()[0] == events.count()


def test_numbers_and_stats(spark):
    df = spark.range(500).repartition(7).toDF("id")
    got = sorted((r["id"], r["rn"]) for r in G.numbered(df, [F.desc("id")]).collect())
    assert got == [(i, 500 - i) for i in range(500)]
    stats = nine_stats(spark.createDataFrame([(float(i), i) for i in range(10)], "v double, t int"), "v", ["t"]).first()
    assert (stats["p95"], stats["last"], stats["count"]) == (8.0, 9.0, 10)
    assert nine_stats(spark.createDataFrame([(2.0, 1)], "v double, t int"), "v", ["t"]).first()["std"] == 0.0


def test_fusion(spark):
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "query_id long, list_no int, key string, rank long")
    scores = {r["key"]: r["score"] for r in R.rank_fusion(lists).collect()}
    assert scores["b"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and max(scores, key=scores.get) == "b"
    first, second = lists.where("list_no = 0"), lists.where("list_no = 1")
    assert [r["key"] for r in R.candidate_union(first, second).orderBy("pos").collect()] == ["a", "b", "c"]
    s = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 3.0)], "item_id long, pid long, score double")
    norm = {(r["item_id"], r["pid"]): r["norm"] for r in R.min_max(s, 2).collect()}
    assert norm == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 1.0}


def test_html():
    page = '<p>out</p><main><p>a<script>x="</p>"</script> b[1]</p><ul><li><b>d</b> e</ul><div class="navbox"><p>no</p></div><p>e &amp; f</p><p>e &amp; f</p><!-- c --></main>'
    assert html_blocks(page) == ["a b", "d e", "e & f"]
    assert html_blocks("<p>x<p>y") == ["x y", "y"] and html_blocks(None) == []
