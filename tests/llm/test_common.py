"""Tables of a run: each run deletes its own, also when it fails or when two run at once."""

import os
from threading import Barrier, Thread

import pytest


def held(spark):
    return {n for n in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) if n.startswith("quern-")}


def test_a_run_leaves_its_result_only(spark):
    from quern.llm.common import finished, materialize, release

    before = held(spark)
    out = finished(lambda: finished(lambda: materialize(spark.range(3), "a"), "b").union(materialize(spark.range(2), "c")), "d")
    assert out.count() == 5 and len(held(spark) - before) == 1
    release(out)

    def fails():
        materialize(spark.range(3), "a")
        finished(lambda: spark.range(1), "b")
        raise ValueError

    with pytest.raises(ValueError):
        finished(fails, "d")
    assert held(spark) == before


def test_two_runs_at_once_keep_apart(spark):
    from quern.llm.common import finished, materialize, release

    before, meet, found = held(spark), Barrier(2, timeout=60), {}

    def run(n):
        def make():
            made = materialize(spark.range(n), "own")
            meet.wait()  # both have a table
            if n == 3:
                return made
            slow = finished(lambda: spark.range(n), "inner")
            return made.union(slow)

        found[n] = finished(make, "out")

    threads = [Thread(target=run, args=(n,)) for n in (3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(90)
    assert found[3].count() == 3 and found[4].count() == 8 and len(held(spark) - before) == 2
    for df in found.values():
        release(df)
    assert held(spark) == before


@pytest.mark.parametrize("bits", [1 << 24, 1 << 15, 1 << 4])
def test_rows_by_ids_through_a_filter(spark, monkeypatch, bits):
    """Exact for any filling of the filter, down to one in which every bit is set; for no ids, all ids and negative ones."""
    from pyspark.sql import functions as F

    from quern.llm import common as C

    monkeypatch.setattr(C, "FILTER_BITS", bits)
    rows = spark.range(-1500, 1500, 1, 4).select(F.col("id").alias("__q_uid"), F.concat(F.lit("t"), "id").alias("text"))
    for keep in (F.lit(False), F.lit(True), F.pmod(F.col("__q_uid"), F.lit(7)) == 3):
        ids = rows.where(keep).select("__q_uid")
        want = {r["__q_uid"] for r in ids.collect()}
        inside, outside = C.with_ids(rows, ids), C.without_ids(rows, ids)
        assert inside.columns == outside.columns == rows.columns
        inside, outside = [[tuple(r) for r in df.collect()] for df in (inside, outside)]
        assert sorted(inside) == sorted((i, f"t{i}") for i in want)
        assert sorted(outside) == sorted((i, f"t{i}") for i in range(-1500, 1500) if i not in want)


def test_the_filter_rules_most_rows_out(spark):
    from pyspark.sql import functions as F

    from quern.llm.common import _marked

    rows = spark.range(100000).select(F.col("id").alias("__q_uid"))
    hit = {r["__q_uid"] for r in _marked(rows, rows.where("__q_uid % 100 = 0")).where("__q_hit").collect()}
    assert set(range(0, 100000, 100)) <= hit and len(hit) < 1200


def test_a_worker_keeps_one_owners_tables(monkeypatch):
    from quern.llm import common as C
    from quern.llm import language, packing

    monkeypatch.setattr(C, "_kept", {})
    monkeypatch.setattr(packing, "FastTokenizer", lambda name: object())
    held = packing.tokenizer("a")
    assert packing.tokenizer("a") is held and packing.tokenizer("b") is not held
    assert language.profile("some words") is not None
    assert set(C._kept) == {"language"}
    letters = language._letters()
    assert letters is language._letters()


def test_the_pipeline_sends_small_batches_of_texts(spark):
    import corpus_pipeline

    from quern.llm.common import BATCH_ROWS

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('some english words number ', id) AS text", "'en' AS lang", "'s' AS source", "10 AS n_chars").coalesce(1)
    before = spark.conf.get(key)
    try:
        for rows, most in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("7", 7)):
            spark.conf.set(key, rows)
            assert corpus_pipeline.language_id(spark, docs.limit(1), "") is not None
            assert int(spark.conf.get(key)) == most

        spark.conf.set(key, "10000")
        assert corpus_pipeline.language_id(spark, docs, "").count() == 5000

        def sizes(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

        found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 5000 and max(found) <= BATCH_ROWS
    finally:
        spark.conf.set(key, before)


def test_trimmed_gives_all_batches(spark):
    from quern.llm.common import trimmed

    assert sorted(r["id"] for r in spark.range(100).mapInArrow(trimmed(lambda batches: batches), "id long").collect()) == list(range(100))
