"""Stemmers, tokenizers, encoders, entities, the sparse index, the vector store and streamed curation on small inputs."""

import html
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import stemming
from quern.functions import text as X
from quern.functions import tokenize as K
from quern.functions.encoders import bridge_phrases, encode, hashed_words

SF = "/root/testdata/sf0.001"

#: Published examples of the rules, in the order of the steps, and words that the extensions change.
STEMS = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration
valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil
ties tie dies die died die tried tri enjoy enjoy by by say say dying die news news proceed proceed geologi geolog hopefulli hope y y as as"""


def test_stems_of_published_examples():
    words = STEMS.split()
    assert [(w, stemming.stem(w)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))


def test_every_rule_of_the_stemmer_is_used():
    for end, new in stemming.SECOND + stemming.THIRD:
        for stem in ("x", "contrib"):  # no pair before the ending, and some
            got = stemming._second(stem + end) if (end, new) in stemming.SECOND else stemming._replaced(stem + end, stemming.THIRD)
            longer = next(e for e, _ in (stemming.SECOND if (end, new) in stemming.SECOND else stemming.THIRD) if (stem + end).endswith(e))
            assert longer != end or got == (stem + end if not stemming.pairs(stem) else stemming._second(stem + "al") if end == "alli" else stem + new), (stem, end)
    for end in stemming.FOURTH:
        before = "tractants" if end == "ion" else "tractant"
        longer = next(e for e in stemming.FOURTH if (before + end).endswith(e))
        assert stemming._fourth(before + end) == (before + end)[: -len(longer)]
        assert stemming._fourth("tr" + end) == "tr" + end
    assert stemming._fourth("tractaion") == "tractaion"  # an ion after neither s nor t stays


def test_stemmed_rouge(spark):
    from quern.plans import catalog

    def brute(p, g):
        a, b = stemming.stems(p, {}), stemming.stems(g, {})
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        n = row[-1][-1]
        return round(2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b)), 6) if n else 0.0

    pairs = [("Running the programs", "runs a program"), (None, "x"), ("", ""), ("The cats!", "cat"), ("a-b c", "A B c"), ("same", "same")] + [("word " * k, "words") for k in range(5)]
    df = spark.createDataFrame(pairs, "p string, g string")
    for most in (1, 1 << 18):
        got = [r[0] for r in df.select(stemming.rouge_l_stemmed(most)(F.col("p"), F.col("g"))).collect()]
        assert [round(x, 6) for x in got] == [brute(p, g) for p, g in pairs]
    from quern.plans.registry import Tables
    from quern.plans.text_queries import qa

    want = {(r["conv_id"], r["turn"]): brute(r["pred"], r["gold"]) for r in qa(Tables(spark, SF)).collect()}
    assert {(r["conv_id"], r["turn"]): r["value"] for r in catalog.queries()["rouge_l_stemmed"](spark, SF).collect()} == want


def test_entities(spark):
    rnd = random.Random(5)
    parts = ["&", "amp;", "&amp", "lt", "&lt;", "&notin;", "&notit;", "&#39;", "&#x27", "&#X1F600;", "&#0;", "&#128;", "&#xD800;", "&#1114112;", "&bogus;", "&nbsp;", "&hellip", ";", "x", " ", "\n", "&#x110000;", "&CounterClockwiseContourIntegral;", "&copy2", "é"]
    texts = [None, "", "a &lt;b&gt; &amp;lt; c"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(2000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.decode_entities(F.col("t")).alias("d")).collect()
    import re

    for r in rows:
        t = texts[r["i"]]
        assert r["d"] == (None if t is None else re.sub("[ \t\n\r]+", " ", html.unescape(t).replace("\xa0", " ")).strip(" ")), t


TURNS = [[("user", " Hello wörld\n"), ("assistant", "Ich  bin’s 中文")], [("user", None)], [], None, [("system", "x"), ("user", ""), ("assistant", "naïve\n\nend ")]]


@pytest.mark.parametrize("kind", ["bytes", "file"])
def test_ids_decode_to_the_templated_text(spark, kind):
    import public_tokenizers

    factory = K.byte_tokenizer() if kind == "bytes" else K.file_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TURNS)], "i int, turns array<struct<role:string,content:string>>")
    rows = df.select("i", K.tokenised(F.col("turns"), factory).alias("t")).select("i", "t", K.detokenised(F.col("t.ids"), factory).alias("text")).collect()
    lib = factory()
    for r in rows:
        pieces = K.templated(TURNS[r["i"]] or [])
        assert r["text"] == "".join(x for _, x in pieces)
        ids, starts, at = [], [], 0
        for marker, x in pieces:
            if marker:
                some, places = [lib.special[x]], [0]
            elif kind == "bytes":
                some, places = list(x.encode()), [i for i, c in enumerate(x) for _ in c.encode()]
            else:
                e = lib.library.encode(x, add_special_tokens=False)
                some, places = e.ids, [a for a, _ in e.offsets]
            ids, starts, at = ids + some, starts + [at + p for p in places], at + len(x)
        assert list(r["t"]["ids"]) == ids and list(r["t"]["starts"]) == starts


def test_encoders_are_made_once_and_asked_in_batches(spark):
    sizes = [3, 1, 90, 7, 0]

    def factory():
        model = hashed_words()

        def run(texts):
            assert len(texts) <= 2 and all(len(a) >= len(b) for a, b in zip(texts, texts[1:]))  # noqa: B905
            return model(texts)

        return run

    texts = [None] + ["w " * n for n in sizes]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", encode(F.col("t"), factory, "passage: ", batch=2).alias("v")).collect()
    want = hashed_words()(["passage: " + (t or "") for t in texts])
    assert all(np.allclose(r["v"], want[r["i"]]) for r in got)


def test_sentences_by_cosine(spark):
    from quern.plans import catalog
    from quern.plans.registry import Tables
    from quern.plans.retrieval_queries import _hits

    t = Tables(spark, SF)
    chunks, hits = _hits(t)
    rows = hits.where("rank <= 2").join(chunks, "pid").select("item_id", "pid", "rank", F.array_join("tok", " ").alias("p"), X.sentences(F.array_join("tok", " ")).alias("s")).collect()
    text, model, want = dict(t.benchmark.select("item_id", "text").collect()), hashed_words(), {}
    for r in rows:
        s = r["s"] or [r["p"]]
        score = np.round(model(["passage: " + x for x in s]).astype(float) @ model(["query: " + text[r["item_id"]]])[0].astype(float), 6)
        want[r["item_id"], r["pid"], r["rank"]] = " ".join(s[i] for i in sorted(range(len(s)), key=lambda i: (-score[i], i))[:2])
    assert {(r["item_id"], r["pid"], r["rank"]): r["kept"] for r in catalog.queries()["sentence_cosine_top2"](spark, SF).collect()} == want


def test_bridge_phrases(spark):
    df = spark.createDataFrame([("The Battle of Hastings (1066), was fought in England; a b",), ("one two three four five",), (None,)], "t string")
    rows = [r[0] for r in df.select(bridge_phrases(F.col("t"), X.STOPWORDS)).collect()]
    assert rows == [["battle", "hastings", "1066", "fought", "england"], [], None]


@pytest.mark.parametrize("seed", range(3))
def test_sparse_search_equals_a_full_join(spark, seed):
    from quern.operators import sparse_index as S

    rnd = random.Random(seed)
    term = lambda: f"t{min(rnd.randrange(1, 60), rnd.randrange(1, 60), rnd.randrange(1, 60))}"
    vec = lambda n: {term(): round(rnd.random() ** 3 + 0.01, 6) for _ in range(n)}
    passages = {p * 3: vec(rnd.randint(0, 25)) for p in range(300)}
    queries = {q: vec(rnd.randint(0, 12)) for q in range(12)} | {90: {"t1": 0.5}, 91: {"unknown": 1.0}, 92: {f"t{j}": 1.0 for j in range(60)}}
    if seed == 2:  # every passage has a hit
        passages = {p: v | {"t1": 0.5} for p, v in passages.items()}
    rows = lambda vs: [(k, t, w) for k, v in vs.items() for t, w in v.items()]
    v = spark.createDataFrame(rows(passages) + [(0, "zero", 0.0)], "pid long, term string, weight double")
    p = spark.createDataFrame([(k,) for k in passages], "pid long")
    q = spark.createDataFrame(rows(queries) + [(0, "zero", 1.0)], "query long, term string, weight double")
    index = S.build(v, p, bits=4)
    full = {k: {d: round(sum(w * x[t] for t, w in y.items() if t in x), 6) for d, x in passages.items() if set(x) & set(y)} for k, y in queries.items()}
    k = 5
    best = {(a, d): s for a, m in full.items() for d, s in sorted(m.items(), key=lambda x: (-x[1], x[0]))[:k]}
    got = S.search(index, q, k, bits=4).collect()
    assert {(r["query"], r["pid"]) for r in got} == set(best) and all(abs(r["score"] - best[r["query"], r["pid"]]) < 2e-6 for r in got)

    def ends(m):
        return (min(m.values()) if len(m) == len(passages) else 0.0), max(m.values())

    scaled = lambda m, s: 0.0 if ends(m)[1] <= ends(m)[0] else (s - ends(m)[0]) / (ends(m)[1] - ends(m)[0])
    for r in S.normalised(index, q, k, bits=4).collect():
        assert abs(r["norm"] - scaled(full[r["query"]], full[r["query"]][r["pid"]])) < 1e-5
    bridges = [(a, s, t, w) for a in (0, 1, 2, 90) for s in (1, 2) for t, w in vec(8).items()]
    b = spark.createDataFrame(bridges, "query long, seed long, term string, weight double")
    by = defaultdict(dict)
    for a, s, t, w in bridges:
        by[a, s][t] = w
    want = {}
    for a in queries:
        total = defaultdict(float, {d: scaled(full[a], s) for d, s in full[a].items()})
        more = defaultdict(float)
        for (x, _), y in by.items():
            if x == a:
                m = {d: round(sum(w * z[t] for t, w in y.items() if t in z), 6) for d, z in passages.items() if set(z) & set(y)}
                for d, s in m.items():
                    more[d] = max(more[d], scaled(m, s))
        fused = {d: total[d] + 0.7 * more[d] for d in set(total) | set(more)}
        want[a] = sorted(fused.values(), reverse=True)[:4]
    found = defaultdict(list)
    for r in S.fused(index, q, b, 4, first=4, bits=4).collect():
        found[r["query"]].append(r["score"])
    assert {a: len(x) for a, x in want.items() if x} == {a: len(x) for a, x in found.items()}
    assert all(np.allclose(sorted(found[a], reverse=True), want[a], atol=1e-5) for a in found)
    report = S.reading(index, q, k, bits=4).first()
    assert report["read_whole"] <= report["postings"]


def test_vector_store_rewrites_touched_buckets_only(spark, tmp_path):
    from quern.sources import vector_store as V

    root = f"{tmp_path}/store"
    df = lambda rows, more="": spark.createDataFrame(rows, "namespace string, pid long, v int" + more)
    V.upsert(df([("n", k, 1) for k in range(100)] + [("n", 5, 3), (None, None, 1)]), root, "v", buckets=16)
    first = V.manifest(spark, root)
    touched = V.upsert(df([("n", 5, 2), ("n", 7, 9), ("m", 7, 1)]), root, "v")
    second = V.manifest(spark, root)
    assert {b for b in first["folders"] if first["folders"][b] != second["folders"][b]} == {str(b) for b in touched} and len(touched) <= 3
    held = {(r["namespace"], r["pid"]): r["v"] for r in V.read(spark, root).collect()}
    assert held == {("n", k): 1 for k in range(100)} | {("n", 5): 3, ("n", 7): 9, ("m", 7): 1, (None, None): 1}
    bad = df([("n", 1, 5)]).withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        V.upsert(bad, root, "v")
    assert V.manifest(spark, root) == second
    with pytest.raises(RuntimeError):
        V._publish(spark, root, second)  # another upsert was first
    assert V.upsert(df([]), root, "v") == [] and V.manifest(spark, root)["version"] == 2
    V.upsert(df([("n", 1, 5, "new")], ", x string"), root, "v")
    assert {(r["pid"], r["v"], r["x"]) for r in V.read(spark, root).where("pid < 3").collect()} == {(0, 1, None), (1, 5, "new"), (2, 1, None)}


def test_a_replayed_stream_gives_the_same_groups(spark, tmp_path):
    from quern.streaming.curate import curate

    schema = "context string, pos int, prompt string, response string"
    for k in range(3):
        spark.createDataFrame([(f"c{k % 2}", 2, f"q{k}", "a"), (f"c{k % 2}", 1, f"p{k}", "b")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    held = []
    for run in ("one", "two"):  # the second run has no checkpoint, so it replays every batch over the first one's
        curate(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/{run}").awaitTermination(120)
        held.append(sorted((r["context"], tuple(r["prompts"])) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert held[0] == held[1] == [("c0", ("p0", "q0")), ("c0", ("p2", "q2")), ("c1", ("p1", "q1"))]


@pytest.mark.parametrize("cells,part", [(1, 10**6), (7, 10**6), (12, 20)])
def test_vector_search_equals_all_products(spark, cells, part, monkeypatch):
    from quern.operators import vector_index as V

    monkeypatch.setattr(V, "PART", part)
    rng = np.random.default_rng(cells)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([centres[i % 6] + 0.2 * rng.normal(size=8) for i in range(240)] + [np.tile(centres[0], 40)]).reshape(-1, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index = V.build(df, cells)
    asked = df.where("embedding IS NOT NULL AND vec_id % 7 = 0 OR vec_id = 901").select(F.col("vec_id").alias("id"), "embedding")
    held = {i: np.array(v) for i, v in rows if v is not None}
    for k in (1, 5, 500):
        got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in V.search(index, asked, k)[0].collect())
        want = []
        for q in (i for i in held if i % 7 == 0 or i == 901):
            order = sorted((i for i in held if i != q), key=lambda i: (-np.round(held[q] @ held[i], 6), i))[:k]
            want += [(q, r + 1, i) for r, i in enumerate(order)]
        assert got == sorted(want)
    if cells == 7:
        assert V.visited(df, F.col("vec_id") % 7 == 0, 5, 7) < 0.6  # far cells aren't read
    assert V.top_k(df.limit(0), F.lit(True), 3).count() == 0


def test_tracker(spark):
    from quern.operators.instrument import Tracker
    from quern.operators.reporting import nine_stats

    ticks = iter(range(100))
    tracker = Tracker(lambda: float(next(ticks)))
    assert tracker.run("read", spark.createDataFrame([("é",), (None,)], "t string"), lambda d: d.count(), "t") == 2

    class Model:
        def step(self, n):
            return self.step(n - 1) if n else "done"

        def fail(self):
            raise ValueError

    for _ in range(2):
        tracker.wrap(Model, "step", "steps")
        tracker.wrap(Model, "fail")
    assert Model().step(3) == Model().step(0) == "done"
    with pytest.raises(ValueError):
        Model().fail()
    tracker.unwrap(Model, "step")
    Model().step(1)
    assert tracker.records == [("read", 0, 1.0, 2, 2), ("steps", 0, 1.0, None, None), ("steps", 1, 1.0, None, None), ("fail", 0, 1.0, None, None)]
    stats = {r["name"]: (r["count"], r["total"]) for r in nine_stats(tracker.table(spark), "seconds", ["seq"], F.col("name")).collect()}
    assert stats == {"read": (1, 1.0), "steps": (2, 2.0), "fail": (1, 1.0)}
