"""Ranked lexical search against plain scoring of all documents, with the defined odd cases."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute(docs, items, k=50):
    tfs = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(map(bool, tfs)), sum(sum(c.values()) for c in tfs)
    df = Counter(t for c in tfs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    wanted, out = {}, []
    for i, text in items:
        wanted.setdefault(i, set()).update(terms(text))
    for item, ts in wanted.items():
        scored = []
        for (d, _), c in zip(docs, tfs, strict=True):
            m = 50 + (50 * sum(c.values()) * n_docs) // max(total, 1)
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_query_equals_its_sql_and_plain_scoring(spark):
    from quern.llm.lexical import oracle
    from quern.llm.queries import queries

    got = queries()["op12_tput"](spark, SF)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows = sorted(map(tuple, got.collect()), key=repr)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows == sorted(con.execute(oracle()).fetchall(), key=repr)
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()]
    assert rows == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


@pytest.mark.parametrize("k,part", [(1, 1), (3, 2), (50, 4096)])
def test_odd_rows(spark, k, part):
    from quern.llm import lexical

    rnd = random.Random(k)
    words = [f"w{j}" for j in range(60)] + ["Éa", "éa", "中文", "İ", "K2"]
    text = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=n))
    docs = [(1, None), (2, ""), (3, " !? "), (None, "w7 w7"), (None, "w7"), (5, "w7 w7"), (5, "w7 w7"), (6, "w7 w7"), (7, "a" * 90_000 + " w1"), (8, text(50_000))]
    docs += [(k, text(rnd.randint(1, 80))) for k in range(20, 150)] + [(k, "w1 w2 hot copy") for k in range(200, 320)]
    items = [(1, None), (2, ""), (3, "nowhere"), (4, "w7"), (5, "W7 w7 éa ÉA"), (5, "k2"), (None, "hot w59"), (None, "w3"), (7, text(300)), (8, "w1"), (9, "w1 w1 zzz")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, term string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    search = lambda d, b: sorted(map(tuple, lexical.search(lexical.build(d, b if part > 1 else None, tasks=part, part=part), b, k, block=3 if k == 3 else 512).collect()), key=repr)
    assert search(df, bench) == brute(docs, items, k)
    assert search(df.limit(0), bench) == [] and search(df, bench.limit(0)) == []


def test_lists_fall_in_impact_and_hold_every_posting(spark):
    from quern.llm import lexical

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = lexical.build(docs)
    held = Counter()
    for r in index.lists.collect():
        assert r["impacts"] == sorted(r["impacts"], reverse=True) and r["most"] == r["impacts"][0] and len(r["uids"]) <= lexical.PART
        held.update((r["term"], u) for u in r["uids"])
    assert held == Counter((t.decode(), i) for i, text in docs.select("doc_id", "text").collect() for t in set(terms(text)))


def test_ids_far_apart(spark):
    from quern.llm import lexical

    docs = [(1, "a b"), (1 << 50, "a b"), (-(1 << 50), "a"), (1 << 33, "b b b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert sorted(map(tuple, lexical.search(lexical.build(df, bench), bench, 4).collect()), key=repr) == brute(docs, [(1, "a b")], 4)
