"""K-d tree sharding: every row once, the tree's own law at each node, and the defined odd cases."""

import random
import zlib
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"


def check_rows(rows, docs, shards):
    """Slots are gapless, every row is there once, sizes and checksums are those of plain Python."""
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["crc"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards and sorted(v) == list(range(len(v))) for s, v in slots.items())


def test_query(spark):
    from quern.llm.queries import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op11_kdtree_shards"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows = got.withColumnRenamed("text_crc32", "crc").collect()
    check_rows(rows, docs, 40)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert {tuple(r) for r in queries()["op11_kdtree_shards"](spark, SF).collect()} == {tuple(r) for r in rows}


def made(spark, rnd, n=3000):
    """Short documents, a third of which come from one source and a tenth of which are one text."""
    rows = []
    for i in range(n):
        text = "one very common text" if i % 10 == 0 else "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 400))) if i % 7 else f"copy {i // 70} " * 4
        rows.append((i, text, rnd.choice(["en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 50}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), [(r[0], r[1]) for r in rows]


def test_nodes_split_their_widest_dimension_at_the_weighted_median(spark):
    from quern.llm.common import materialize
    from quern.llm.sharding import BITS, TIE, celled, grow, keys, narrow

    df, docs = made(spark, random.Random(1))
    rows, shards, dims = materialize(narrow(df, "doc_id", "text", ["lang", "source", "doc_id"]), "narrow"), 13, 4
    limit = sum(len(t.encode()) + 16 for _, t in docs) / shards / 50
    parted = celled(rows, dims, limit)
    from pyspark.sql import functions as F

    cells = parted.groupBy("text", "crc", "part").agg(F.sum("size").alias("weight"), *(F.min(f"d{i}").alias(f"d{i}") for i in range(dims)))
    grown, root = grow(keys(cells, dims), dims, shards, limit)
    held = [r.asDict() for r in grown.collect()]
    most = max(r["weight"] for r in held)
    assert most <= 2 * limit  # the hot text was dealt to cells

    def walk(node, inside):
        if node.lower is None:
            assert all(r["node"] == node.first for r in inside)
            return
        spread = [(max(r[f"k{i}"] for r in inside) >> TIE) - (min(r[f"k{i}"] for r in inside) >> TIE) for i in range(dims)]
        assert max(spread) < 1 << BITS and node.dim == spread.index(max(spread))
        lower, upper = ([r for r in inside if (r[f"k{node.dim}"] < node.split) == side] for side in (True, False))
        total, low = (sum(r["weight"] for r in x) for x in (inside, lower))
        assert abs(low - total * (node.shards // 2) / node.shards) <= max(limit, most) / 2 + 1
        walk(node.lower, lower)
        walk(node.upper, upper)

    walk(root, held)


def test_bytes_are_even_and_light_copies_stay_together(spark):
    from quern.llm.sharding import assign

    df, docs = made(spark, random.Random(2))
    rows = assign(df, 10).collect()
    check_rows(rows, docs, 10)
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["size"]
    assert len(held) == 10 and max(held.values()) <= 1.05 * sum(held.values()) / 10 and min(held.values()) >= 0.95 * sum(held.values()) / 10
    where, sizes = defaultdict(set), Counter()
    for r in rows:
        where[r["crc"]].add(r["shard"])
        sizes[r["crc"]] += r["size"]
    limit = sum(held.values()) / 10 / 50
    assert all(len(s) == 1 for c, s in where.items() if sizes[c] <= limit) and max(map(len, where.values())) > 1
    assert {r["shard"] for r in assign(df, target_bytes=-(-sum(held.values()) // 5)).collect()} == set(range(5))


def test_odd_rows(spark):
    from quern.llm.sharding import assign, digest

    docs = [(None, None), (None, ""), (1, "x"), (1, "x"), (2, "é" * 9), (3, "long " * 30_000), (4, None)] + [(7, "same row")] * 400
    df = spark.createDataFrame([(i, t, None, "s", float("nan"), 3) for i, t in docs], "doc_id long, text string, lang string, source string, size double, shard int")
    for meta in ([], ["size", "lang"], ["doc_id", "shard"]):
        rows = assign(df, 6, metadata=meta).collect()
        check_rows(rows, docs, 6)
    same = Counter(r["shard"] for r in rows if r["doc_id"] == 7)
    assert len(same) > 2  # equal rows of one id are dealt too
    check_rows(assign(df, 1).collect(), docs, 1)
    check_rows(assign(df.where("doc_id = 2"), 40).collect(), [(2, "é" * 9)], 40)
    assert digest(df.limit(0)).count() == 0


def test_shards_are_written(spark, tmp_path):
    from quern.llm.sharding import shard_documents

    df, _ = made(spark, random.Random(3), 500)
    back = shard_documents(df.withColumn("shard", df.doc_id * 2), f"file://{tmp_path}/out", shards=5)
    assert set(back.columns) == {*df.columns, "shard", "__q_shard", "__q_slot"} and len(list((tmp_path / "out").glob("__q_shard=*"))) == 5
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert back.select("__q_shard", "__q_slot").distinct().count() == 500
