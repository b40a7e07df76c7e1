"""Importance resampling against plain counting, with the defined odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(words), [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets=10_000, percent=5, least=20):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[1])
    s, t = count([x for _, x in docs]), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, fs = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = fit[: len(fit) * percent // 100]
    out = [(*r[:4], k + 1) for k, r in enumerate(drawn)]
    return Counter(out) + Counter((*r[:4], None) for r in (Counter(rows) - Counter(drawn)).elements())


def test_draw_equals_plain_counting(spark):
    from quern.llm.queries import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = queries()["op13_importance"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in got.dtypes)
    assert Counter(map(tuple, got.collect())) == brute(docs, target)


@pytest.mark.parametrize("percent", [0, 1, 37, 100])
def test_odd_rows(spark, percent):
    from quern.llm.importance import draw, drawn_documents

    rnd = random.Random(percent)
    text = lambda n: " ".join(rnd.choice(["a", "Bé", "C", "x-y", "_", "9", "中文", "İ"]) for _ in range(n))
    docs = [(1, None), (2, ""), (None, text(30)), (None, text(50)), (5, "!!"), (6, text(20)), (6, text(20)), (7, "same " * 40), (7, "same " * 40), (8, "w" * 70_000 + " end"), (9, text(60_000))] + [(k, text(rnd.randint(0, 60))) for k in range(10, 80)]
    target = [None, "", text(40), "Bé C 中文 9"]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, score int, _text string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert Counter(map(tuple, draw(df, bench, percent).collect())) == brute(docs, target, percent=percent)
    assert draw(df.limit(0), bench).count() == 0
    assert Counter(map(tuple, draw(df, bench.limit(0), percent).collect())) == brute(docs, [], percent=percent)
    clean = df.where("doc_id >= 10")
    kept = drawn_documents(clean, bench, percent=percent)
    assert kept.columns == [*df.columns, "__q_rank"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute(docs[11:], target, percent=percent) if r[4])


def test_tries_carry_crc_states_and_may_be_begun_anew():
    from quern.llm.importance import Shifts, Trie, _counts
    import pyarrow as pa

    rnd = random.Random(1)
    pairs = [(rnd.randbytes(rnd.randint(0, 9)), rnd.randbytes(rnd.choice([0, 1, 2, 3, 17, 300, 70_000]))) for _ in range(60)]
    a, n = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([len(b) for _, b in pairs])
    assert (Shifts().moved(a, n) ^ np.array([zlib.crc32(b) for _, b in pairs], np.uint32)).tolist() == [zlib.crc32(a + b) for a, b in pairs]
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 90))).encode() for _ in range(80)]
    trie, want = Trie(), Counter(f for t in texts for f in features(t.decode())[1])
    for t in texts:
        for depth, _, nodes in trie.walk([t, None]):
            trie.levels[depth].count += np.bincount(nodes, minlength=len(trie.levels[depth].count))
    held = Counter(dict(zip(trie.levels[2].crc.tolist(), trie.levels[2].count.tolist(), strict=True)))
    assert held == Counter({zlib.crc32(f): n for f, n in want.items() if f.count(b" ") == 2})
    batches = [pa.RecordBatch.from_arrays([pa.array([t.decode()])], ["_text"]) for t in texts]
    for most in (0, 500, 1 << 20):
        (got,) = _counts(97, 3, most)(iter(batches))
        whole = Counter()
        for f, n in want.items():
            whole[zlib.crc32(f) % 97] += n
        assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == whole


def test_cut_keeps_at_least_k(spark):
    from quern.llm.importance import cut

    rnd = random.Random(2)
    for scores in ([rnd.randrange(-(10**9), 10**9) for _ in range(500)], [7] * 300, [0] * 200 + [10**15] + list(range(90)), [5]):
        df = spark.createDataFrame([(s,) for s in scores], "score long")
        for k in {1, len(scores) // 3 or 1, len(scores)}:
            least = cut(df, k, 16)
            assert sum(s >= least for s in scores) >= k
