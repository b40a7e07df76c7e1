"""The training-data operators against brute force, round trips and held-out labels, with the defined odd cases."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, score double"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash", 0.5) for i, t, lang in rows], DOCS)


ODD = [(1, None, "en"), (2, "", "en"), (3, "x", None), (None, "no id here at all", "en"), (5, "a b c " * 4000, "en"), (6, "same text twice\nline two\nline three", "en"), (7, "same text twice\nline two\nline three", "en"), (7, "same text twice\nline two\nline three", "en"), (8, "1234 5678", "de"), (9, "é" * 300, "fr")]


# op1


def brute_rule(host, path):
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    fits = [(h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_rules_and_vocabulary(spark):
    from quern.llm.url_filter import judge_urls

    urls = [None, "", "no scheme", "http://a.net/x", "http://a.net", "https://EXAMPLE.net/en/1", "https://x.example.com/de/1?q=/en/", "http://b.org/fr/#a", "http://adulthood.com/", "http://adult-x.com/", "http://free-bets.com/", "http://free.com/free", "http://x.com/FREE/cheap", "ftp://h?x", "http://net/", "http://exorg/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", __import__("pyspark").sql.functions.lit("clash"))
    got = {r["page_id"]: r for r in judge_urls(df).collect()}
    blocked = {9, 10, 12}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule, verdict = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == (verdict or ("block" if i in blocked else "allow")), url
    assert judge_urls(df.limit(0)).count() == 0


def test_url_vocabulary_by_weights(spark, tmp_path):
    from quern.llm.url_filter import Vocabulary, judge_urls

    (tmp_path / "terms").write_text("".join([f"bad{k}\tstrict\n" for k in range(300)] + [f"so{k}\t{0.25 * (1 + k % 6)}\n" for k in range(300)]))
    vocabulary = Vocabulary.read(str(tmp_path / "terms"))
    rnd, urls = random.Random(3), ["http://a.com/" + "x/" * 200_000 + "bad7", "http://a.com/so5/so5/so5"]
    urls += ["http://a.com/" + rnd.choice("/-_.").join(rnd.choice([f"so{rnd.randrange(400)}", f"bad{rnd.randrange(250, 700)}", "word"]) for _ in range(rnd.randint(1, 4))) for _ in range(200)]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), vocabulary=vocabulary).collect()}
    for i, url in enumerate(urls):
        terms = set(re.split("[^a-z0-9]+", url))
        bad = bool(terms & set(vocabulary.strict)) or sum(vocabulary.soft.get(t, 0) for t in terms) >= 2
        assert got[i] == ("block" if bad else "allow"), url[:80]
    (tmp_path / "wrong").write_text("one\t2.0\n")
    with pytest.raises(ValueError):
        Vocabulary.read(str(tmp_path / "wrong"))


# op2


def test_bpe_equals_the_library():
    from quern.llm.bpe import TreeEncoder, vocabulary_path

    enc = TreeEncoder(vocabulary_path("word_bpe_49k.json"), leaf=16)
    rnd, lib = random.Random(2), enc.tokenizer
    pieces = ["a", "ab", "the", "'", "'s", "'re", "'ll", "é", "ñ", "1", "!", "...", "-", " ", "  ", "\n", " ", "İ", "Σ", "中", "👍", "é", "\x1c", "\x85", "<|endoftext|>", "<|", "ing", "tion", "​", "²", "ªb", "_", "__", "_'", "‿", "def __init__(self):"]
    # One character of each of Unicode's categories and of each block of 256, so that every kind meets every other.
    kinds = sorted({(unicodedata.category(chr(c)), c >> 8): chr(c) for c in range(0x1F000) if not 0xD800 <= c < 0xE000}.values())
    for k in range(3000):
        some = rnd.sample(pieces, rnd.choice([1, 2, 4, len(pieces)])) + (rnd.sample(kinds, 6) if k % 3 == 0 else [])
        text = "".join(rnd.choice(some) for _ in range(rnd.choice([1, 8, 60, 300])))
        enc.leaf, enc.most = rnd.choice([16, 20, 33, 512, 4096]), 300_000 * (k % 2)
        ids = lib.encode(text, add_special_tokens=False).ids
        assert enc.encode_batch([text])[0] == ids, repr(text)
        assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    enc.leaf = 64
    for text in ("a" * 20000, "ab!" * 5000, "x1" * 4000, "_" * 5000, "def __init__(self, _x=1): pass\n" * 300, "".join(rnd.choice("abcdef_'") for _ in range(9000))):
        assert enc.encode_batch([text])[0] == lib.encode(text, add_special_tokens=False).ids


def test_bpe_refuses_vocabularies_it_does_not_know():
    from quern.llm.bpe import TreeEncoder, vocabulary_path

    with pytest.raises(ValueError, match="doesn't know"):
        TreeEncoder(vocabulary_path("byte_bpe_50k.json"))


def test_bpe_digest(spark):
    from quern.llm.bpe import encode_digest, encode_texts, encoder

    lib, df = encoder().tokenizer, docs_of(spark, ODD)
    want = sorted((str(i), *_digest(lib, t)) for i, t, _ in ODD)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in encode_digest(df).collect()) == want
    assert encode_digest(df.limit(0)).count() == 0 and encode_texts(df).count() == len(ODD)


def _digest(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# op3


def test_toxicity_finds_unseen_misspellings():
    from quern.llm.toxicity import Scorer, fit, windows_of, words_of

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["ba", "ke", "lo", "mi", "tu", "ra"]) for _ in range(3))
    bad = ["moronic", "idiotic", "worthless", "disgusting"]
    texts, labels = [], []
    for k in range(600):
        words = [word() for _ in range(60)]
        if k % 3 == 0:
            for at in rnd.sample(range(60), 3):
                words[at] = rnd.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    cut = 450
    model = fit([windows_of(words_of(t)) for t in texts[:cut]], labels[:cut])
    scorer = Scorer(*model)
    right = [(scorer.score(t) >= 0.7) == bool(y) for t, y in zip(texts[cut:], labels[cut:], strict=True)]
    assert np.mean(right) > 0.95
    clean = " ".join(word() for _ in range(40))
    assert scorer.score(clean + " moronicc idiotik") > scorer.score(clean)


def plain_score(text, margins, bias, scale):
    """The score by the definition, gram by gram: the worst run of four words."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    best = 0.0 if not words else -1e9
    at = list(range(0, len(words) - 3, 4))
    if words and (not at or at[-1] + 4 < len(words)):
        at.append(max(0, len(words) - 4))
    for i in at:
        total, n = 0.0, 0
        for w in set(words[i : i + 4]):
            grams = [f"={w}"] + [f"<{w}>"[k : k + 3] for k in range(len(w))] + [f"<{w}>"[k : k + 4] for k in range(len(w) - 1)]
            total += sum(float(margins[zlib.crc32(g.encode()) % len(margins)]) for g in grams)
            n += len(grams)
        best = max(best, total / max(24, n))
    return 1 / (1 + np.exp(-(scale * (best + bias) + np.log(0.7 / 0.3))))


def test_toxicity_score_by_definition():
    from quern.llm.toxicity import Scorer

    rng, rnd = np.random.default_rng(3), random.Random(3)
    model = rng.normal(0, 0.02, 1 << 10).astype(np.float32), -0.01, 3.0
    scorer = Scorer(*model)
    long = "x" * 70
    for text in [None, "", "12 _", "one", "one two three four five", "a a a a b", f"{long}a tail", f"{long}b tail", *(" ".join(rnd.choice(["ab", "Öl", "straße", "x1y", "ccc", long]) for _ in range(rnd.randint(1, 40))) for _ in range(50))]:
        assert scorer.score(text) == pytest.approx(plain_score(text, *model), abs=1e-6)
    assert scorer.score(f"{long}a" * 3) != scorer.score(f"{long}b" * 3)  # nothing of a long word is left out


def test_toxicity_learns_from_all_windows(spark, monkeypatch):
    from quern.llm import toxicity

    long = " ".join(f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}{'xyz'[k // 1000]}" for k in range(2502))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: dict(zip(y, texts, strict=True)))
    learned = toxicity.learn(docs_of(spark, [(1, long, "en"), (2, "so it is", "en")]), labels)
    assert [w for run in learned[1][:-1] for w in run] == long.split()[:2500] and learned[1][-1] == long.split()[-4:]
    assert learned[0] == [["so", "it", "is"]]


def test_toxicity_query(spark):
    from quern.llm.queries import op3_toxicity
    from quern.llm.toxicity import score_toxicity

    rows = op3_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    odd = score_toxicity(docs_of(spark, ODD), none).collect()
    assert len(odd) == len(ODD) and all(r["predicted"] == 0 for r in odd)


# op4


def test_packing(spark):
    from quern.llm.packing import difference, pack, tokenizer, windows

    parts = difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]  # the method's known result
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 1024) for _ in range(80)]
    made = windows(sizes)
    assert sorted(i for w in made for i in w) == list(range(80)) and max(sum(sizes[i] for i in w) for w in made) <= 1024
    lib = tokenizer("byte_bpe_50k.json").tokenizer
    rows = [*ODD, (10, "word " * 9000, "en"), (11, "<|endoftext|> and   中文", "en")]
    got = pack(docs_of(spark, rows)).toPandas()
    by_id = {}
    for i, t, _ in rows:
        by_id.setdefault(str(i), []).append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    got["key"] = got.doc_id.map(lambda x: "None" if x != x or x is None else str(int(x)))
    for key, ids in by_id.items():
        pieces = got[got.key == key]
        assert pieces.length.sum() == sum(len(x) for x in ids)
        for p in pieces.itertuples():
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 1024 and (g.offset.values == np.r_[0, np.cumsum(g.length.values)[:-1]]).all()
    assert pack(docs_of(spark, [])).count() == 0


def test_little_padding():
    from quern.llm.packing import cuts, windows

    rnd = random.Random(3)
    sizes = [n for _ in range(180) for _, n in cuts(rnd.randint(1, 4000)) if n < 1024]
    assert 1 - sum(sizes) / 1024 / len(windows(sizes)) < 0.02


# op5


def test_top_k(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quern.llm import kdtree

    monkeypatch.setattr(kdtree, "SHARD", 64)
    monkeypatch.setattr(kdtree, "BLOCK", 2)
    monkeypatch.setattr(kdtree, "LEAF", 8)
    monkeypatch.setattr(kdtree, "PILOT", 20)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(60)] + [(900, None), (901, [float("nan")] * 6), (902, [None] + [1.0] * 5), (None, [1.0] * 6), (903, [float("inf")] * 6), (7, rows[7][1]), (950, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in kdtree.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = {}
    for i, v in good:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in good if j != i)[:5]
            want[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert kdtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# op6


def brute_lines(rows, m):
    seen, out = set(), []
    for i, t in rows:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - m + 1):
            key = tuple(lines[p : p + m])
            if key in seen:
                gone |= set(range(p, p + m))
            seen.add(key)
        out.append((i, len(lines), len(gone), sum(1 for p in gone if p - 1 not in gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup(spark, m):
    from quern.llm.line_dedup import dedup_lines

    rnd = random.Random(m)
    rows = [(i, "\n".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))) for i in range(60)] + [(60, ""), (61, "\n".join("z" * 40)), (62, "only")]
    got = dedup_lines(docs_of(spark, [(i, t, "en") for i, t in rows]), m).collect()
    assert sorted((r["doc_id"], r["__q_n_lines"], r["__q_n_removed"], r["__q_n_runs"], r["text"]) for r in got) == sorted(brute_lines(rows, m))
    assert got[0]["score"] == 0.5


def test_line_dedup_doubles_to_the_end(spark):
    """Runs of many lines, of which the greatest powers of two are found as intervals; brute force says what goes."""
    from quern.llm import line_dedup as L

    rnd = random.Random(17)
    run = [f"line {k}" for k in range(100)]
    rows = [(i, "\n".join([*(f"own {i} {k}" for k in range(rnd.randint(0, 5))), *run[rnd.randint(0, 30) : rnd.randint(40, 100)], f"end {i}"])) for i in range(12)] + [(20, "\n".join(["z"] * 50)), (21, "\n".join(run)), (22, "\n".join(run))]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    got = L.dedup_lines(docs).collect()
    assert sorted((r["doc_id"], r["__q_n_lines"], r["__q_n_removed"], r["__q_n_runs"], r["text"]) for r in got) == sorted(brute_lines(rows, 2))
    from quern.llm.common import with_uid

    uids = with_uid(docs)
    depths = [d.first()["h"] if not d.isEmpty() else None for d in L.intervals(L.line_table(uids, L.copies(uids, "doc_id", "text"), "doc_id", "text"), 2, 4)]
    assert depths[:5] == [2, 4, 8, 16, 32] and all(d in (64, None) for d in depths[5:])


def test_line_dedup_odd(spark):
    from quern.llm.line_dedup import dedup_lines

    out = dedup_lines(docs_of(spark, ODD)).collect()
    assert len(out) == len(ODD)
    assert sorted(r["text"] for r in out if r["doc_id"] in (6, 7)) == ["", "", "same text twice\nline two\nline three"]
    assert [r["text"] for r in dedup_lines(docs_of(spark, [(3, "x\ny", "en"), (3, "x\ny", "en"), (3, "x\ny\nz", "en")])).collect()].count("") >= 1
    named = spark.createDataFrame([("b", "one\ntwo", 1), ("a", "one\ntwo\nthree", 2), ("c", "one\ntwo", 3)], "doc_id string, text string, pos int")
    assert sorted(tuple(r)[:3] for r in dedup_lines(named).collect()) == [("a", "one\ntwo\nthree", 2), ("b", "", 1), ("c", "", 3)]
    assert [r["text"] for r in out if r["doc_id"] == 1] == [None]
    assert dedup_lines(docs_of(spark, [])).count() == 0


# op7


def brute_bytes(rows, width, keep_first):
    seen = {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            seen.setdefault(b[s : s + width], []).append((k, s))
    out = []
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        m = bytearray(len(b))
        for s in range(len(b) - width + 1):
            at = seen[b[s : s + width]]
            if len(at) > 1 and (not keep_first or at[0] != (k, s)):
                m[s : s + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, m, strict=True) if not g)
        out.append((i, len(b), sum(m), sum(1 for x in range(len(m)) if m[x] and (x == 0 or not m[x - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_longest_previous_factors():
    """Against the definition, for suffixes of whole texts and of ranges of starts."""
    from quern.llm.substring_dedup import longest_previous_factors, suffix_order

    rnd = random.Random(4)
    for width in (5, 8, 20, 33):
        texts = ["".join(rnd.choice("ab") if rnd.random() < 0.9 else "c" for _ in range(rnd.randint(1, 90))).encode() for _ in range(8)] + [b"ab" * 60, b"x" * 50]
        wanted = [(rnd.randint(-3, 5), rnd.randint(20, 200)) for _ in texts]
        place, text, start, common = suffix_order(texts, width, wanted)
        suffixes = [(texts[t][s:], int(p)) for t, s, p in zip(text, start, place, strict=True)]
        assert sorted((int(t), int(s)) for t, s in zip(text, start, strict=True)) == [(t, s) for t, x in enumerate(texts) for s in range(len(x)) if s + width <= len(x) and wanted[t][0] <= s <= wanted[t][1]]
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        top = 8  # common prefixes are told exactly below twice the last round's length
        while top < width:
            top *= 2
        want = [max((min(same(a, b), 2 * top) for b, q in suffixes if q < p), default=0) for a, p in suffixes]
        got = longest_previous_factors(place, common, width)
        assert [min(int(g), top) for g in got] == [min(w, top) if w >= width else 0 for w in want]


@pytest.mark.parametrize("keep_first,classes", [(False, 8192), (True, 8192), (False, 1), (True, 1), (False, 4), (True, 4)])
def test_substring_dedup(spark, monkeypatch, keep_first, classes):
    from quern.llm import substring_dedup as S

    monkeypatch.setattr(S, "CLASSES", classes)
    rnd = random.Random(5)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(150, 500))) for _ in range(8)]
    rows = [(i, "".join(rnd.choice(passages)[rnd.randint(0, 60) :] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 90))) for _ in range(rnd.randint(0, 4)))) for i in range(40)]
    rows += [(40, "ab" * 400), (41, None), (42, "q" * 199), (43, "w" * 200), (44, "r" * 201), (45, "x" * 5000)]
    got = S.dedup(docs_of(spark, [(i, t, "en") for i, t in rows]), keep_first=keep_first, digest=True).collect()
    assert sorted(map(tuple, got)) == sorted(brute_bytes(rows, 200, keep_first))


def test_substring_dedup_odd(spark, monkeypatch):
    from quern.llm import substring_dedup as S

    out = S.dedup(docs_of(spark, [*ODD, (20, "long passage " * 30, "en"), (21, "long passage " * 30 + "tail", "en")]))
    assert out.count() == len(ODD) + 2 and out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert S.dedup(docs_of(spark, []), digest=True).count() == 0
    monkeypatch.setattr(S, "BLOCK", 700)  # texts in several blocks of windows
    rows = [(i, ("abcdefghij" * 60 + str(i)) * 3) for i in range(4)]
    got = S.dedup(docs_of(spark, [(i, t, "en") for i, t in rows]), keep_first=False, digest=True).collect()
    assert sorted(map(tuple, got)) == sorted(brute_bytes(rows, 200, False))


# op8


@pytest.mark.parametrize("m", [4, 9, 14, 21, 64])
def test_covering_is_complete(m):
    from quern.llm.simhash import replicas

    rng = np.random.default_rng(m)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([base, base ^ flip(), base ^ flip() ^ flip(), base ^ flip() ^ flip() ^ flip()]))
    anchor, index, own = replicas(x, m)
    home, met = {}, set()
    for a, i, o in zip(anchor.tolist(), index.tolist(), own.tolist(), strict=True):
        if o:
            home.setdefault(a, []).append(i)
    for a, i in zip(anchor.tolist(), index.tolist(), strict=True):
        met |= {(min(i, j), max(i, j)) for j in home.get(a, ()) if j != i}
    near = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 2}
    assert near and near <= met


@pytest.mark.parametrize("cell", [8192, 3])
def test_near_duplicates(spark, monkeypatch, cell):
    import xxhash

    from quern.llm import simhash

    monkeypatch.setattr(simhash, "CELL", cell)
    rnd = random.Random(8)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta x", "Éta"]
    rows = []
    for k in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            if copy and rnd.random() < 0.6:
                copy[rnd.randrange(len(copy))] = "other"
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, "  \n"), (502, "one"), (503, "one two"), (504, "ONE TWO")]

    def fp(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fp(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = simhash.near_duplicates(docs_of(spark, [(i, t, "en") for i, t in rows])).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{prints[i]:016x}", find(i)) for i in prints)
    assert simhash.near_duplicates(docs_of(spark, ODD)).count() == len(ODD)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_components(spark):
    from quern.llm.components import components

    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == find(i) for a, b in edges if a != b for i in (a, b))


# op9


def test_language(spark):
    from quern.llm import language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict(docs, language.learn(language.learning_rows(docs))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    model = language.learn(language.learning_rows(docs_of(spark, ODD)))
    odd = {r["doc_id"]: r for r in language.predict(docs_of(spark, ODD), model).collect()}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[8]["lang_pred"] == "und" and odd[5]["lang_pred"] != "und"
    empty = docs_of(spark, [])
    assert language.predict(empty, language.learn(empty)).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs_of(spark, ODD), language.learn(empty)).collect()} == {"und"}


def plain_profile(text, dim, seed):
    """The bundle by the definition: one n-gram after the other, each letter's vector rolled by its distance from the end."""
    items = np.random.default_rng(seed).integers(0, 2, (4096, dim), dtype=np.int8).astype(int) * 2 - 1
    codes, gap = [0], True
    for c in text:
        if c.isalpha():
            codes.append(1 + ord(c.lower()[0]) % 4095)
            gap = False
        elif not gap:
            codes.append(0)
            gap = True
    codes += [0] if gap else [0]
    total = np.zeros(dim)
    for x, y, z in zip(codes, codes[1:], codes[2:], strict=False):
        total += np.roll(items[x], 2) * np.roll(items[y], 1) * items[z]
    return total / np.sqrt((total**2).sum())


def test_language_by_definition(spark):
    """Profiles, prototypes, predictions and cosines against plain loops."""
    from quern.llm import language

    rnd = random.Random(6)
    texts = {"xx": ["ab", "Abba", "cab bac", "bad dab"], "yy": ["zum", "Öl", "muz zum", "über"]}
    for t in ["a", "Abba cab", "x1y  z!", "été", "Zoë", " ab", "ab ", "中文 ab", "a" * 9000]:
        assert np.allclose(language.profile(t), plain_profile(t, language.DIM, language.SEED), atol=1e-5), t
    rows = [(k, " ".join(rnd.choice(texts[lang]) for _ in range(rnd.randint(1, 30))), lang) for k, lang in enumerate(["xx", "yy"] * 20)]
    asked = [(100 + k, " ".join(rnd.choice(texts["xx"] + texts["yy"]) for _ in range(rnd.randint(1, 9))), None) for k in range(30)]
    model = language.learn(docs_of(spark, rows))
    made = {lang: sum(plain_profile(t, language.DIM, language.SEED) for _, t, x in rows if x == lang) for lang in ("xx", "yy")}
    got = {r["doc_id"]: r for r in language.predict(docs_of(spark, asked), model).collect()}
    for i, t, _ in asked:
        p = plain_profile(t, language.DIM, language.SEED)
        cos = {lang: float(p @ v / np.sqrt((v**2).sum())) for lang, v in made.items()}
        best = max(cos.values())
        assert got[i]["score"] == pytest.approx(max(0.0, best), abs=1e-4) and cos[got[i]["lang_pred"]] > best - 1e-4


def test_language_limits(spark):
    """Random letters, hex and base64 are like no language; the labelled texts are, a rare language's too."""
    import base64

    from pyspark.sql import functions as F

    from quern.llm import language

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rnd = random.Random(2)
    rare = [(10**6 + k, " ".join(rnd.choice(["kuu", "yö", "tähti", "metsä", "järvi", "talvi"]) for _ in range(60)), "fi") for k in range(60)]
    model = language.learn(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rare, "doc_id long, text string, lang string")), sample=2000, limits=True)
    junk = [(k, f("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(300))), None) for k, f in enumerate([str, lambda t: t.encode().hex(), lambda t: base64.b64encode(rnd.randbytes(300)).decode()] * 10)]
    rejected = F.col("__q_score") < F.col("__q_least")
    assert language.predict(docs_of(spark, junk), model, keep=["doc_id"]).where(rejected).count() >= 18
    assert language.predict(docs, model, keep=["doc_id"]).where(rejected).count() <= 10
    assert language.predict(docs_of(spark, rare), model, keep=["doc_id"]).where(rejected | (F.col("__q_lang") != "fi")).count() == 0


# op10


def test_webp_payloads(spark):
    from quern.llm.webp import decode, decode_samples, encode_samples, payload_of, store_texts

    for text in (None, "", "a", "a" * 64, "ab" * 5000, "".join(map(chr, range(1, 256))) * 40, "z" * (1 << 20) + "tail"):
        payload, n = payload_of(text)
        media = encode_samples(payload)
        assert len(payload) % 64 == 0 and payload and decode_samples(media) == payload and n == len((text or "").encode())
    assert decode(encode_samples(b"\0" * 64))[0].shape == (1, 16)
    rows = store_texts(docs_of(spark, ODD), keep_media=True).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert len(r["media"]) == r["media_bytes"] and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
        assert hashlib.sha256(decode_samples(bytes(r["media"]))).hexdigest() == r["payload_sha256"]
    assert store_texts(docs_of(spark, [])).count() == 0


def _stream(write):
    from quern.llm.webp import Writer, _riff

    w = Writer()
    write(w)
    return _riff(w.to_bytes())


def _code(w, lengths):
    """A normal code, written with plain lengths 0 .. 7 only, three bits to a length."""
    from quern.llm.webp import ORDER, Code

    w.bits(0, 1)
    used = [3] * 8 + [0] * 11
    w.bits(15, 4)
    for s in ORDER:
        w.bits(used[s], 3)
    w.bits(0, 1)
    table = {s: (n, c) for s, n, c in Code(used).codes()}
    for n in lengths:
        size, code = table[n]
        w.code(code, size)
    return {s: (n, c) for s, n, c in Code(lengths).codes()}


def _flat7(size, symbols):
    out = [0] * size
    for s in symbols:
        out[s] = (len(symbols) - 1).bit_length()
    return out


def _put(w, table, symbol):
    n, c = table[symbol]
    w.code(c, n)


def test_webp_references_and_cache():
    """Literals, a back reference by a near distance, and colour cache hits, decoded symbol by symbol."""
    from quern.llm.webp import HASH, _head, _one, decode

    def write(w):
        _head(w, 8, 2)
        w.bits(0, 1)
        w.bits(1, 1)
        w.bits(2, 4)  # a cache of four colours
        w.bits(0, 1)
        slot = (HASH * 0xFF0A1405 & 0xFFFFFFFF) >> 30
        green = _code(w, _flat7(256 + 24 + 4, [20, 30, 256 + 2, 280 + slot]))
        red = _code(w, _flat7(256, [10, 40]))
        _one(w, 5)
        _one(w, 255)
        _one(w, 1)  # distance prefix 1 is code 2: one to the left
        for g, r in ((20, 10), (30, 40)):
            _put(w, green, g)
            _put(w, red, r)
        _put(w, green, 256 + 2)  # three pixels like the one before
        _put(w, green, 280 + slot)  # the first colour from the cache
        for _ in range(10):
            _put(w, green, 280 + slot)

    pixels, _ = decode(_stream(write))
    a, b = 0xFF0A1405, 0xFF281E05
    assert pixels.ravel().tolist() == [a, b, b, b, b] + [a] * 11


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors_and_colours(mode):
    """Every predictor, with subtract-green and cross-colour before it: the residuals are made here, pixel by pixel."""
    from quern.llm import webp

    rng = np.random.default_rng(mode)
    width, height = 7, 6
    want = (rng.integers(0, 2**24, width * height, dtype=np.uint32) | np.uint32(0xFF000000)).tolist()
    signed = lambda v: v - 256 if v > 127 else v
    multiplier = (30, -70, 90)  # green to red, green to blue, red to blue
    # Forward in the order in which the decoder undoes them last to first: green, colour, predict.
    step = []
    for p in want:
        a, r, g, b = webp._bytes(p)
        r, b = (r - g) & 255, (b - g) & 255
        r2 = (r - (multiplier[0] * signed(g) >> 5)) & 255
        b2 = (b - (multiplier[1] * signed(g) >> 5) - (multiplier[2] * signed(r) >> 5)) & 255
        step.append(webp._join((a, r2, g, b2)))
    residual = [webp._subtract(p, webp._predicted(step, at, at % width, width, mode)) for at, p in enumerate(step)]

    def write(w):
        webp._head(w, width, height)
        for kind in (webp.GREEN,):
            w.bits(1, 1)
            w.bits(kind, 2)
        w.bits(1, 1)
        w.bits(webp.CROSS, 2)
        w.bits(1, 3)  # blocks of 8
        _single(w, 0xFF, multiplier[2] & 255, multiplier[1] & 255, multiplier[0] & 255)
        w.bits(1, 1)
        w.bits(webp.PREDICT, 2)
        w.bits(1, 3)
        _single(w, 0xFF, 0, mode, 0)
        w.bits(0, 1)
        w.bits(0, 1)
        w.bits(0, 1)
        tables = [_full_code(w, size) for size in (280, 256, 256, 256)]
        webp._one(w, 0)
        for p in residual:
            a, r, g, b = webp._bytes(p)
            for table, v in zip(tables, (g, r, b, a), strict=True):
                _put(w, table, v)

    def _single(w, a, r, g, b):
        w.bits(0, 1)
        for v in (g, r, b, a, 0):
            webp._one(w, v)

    pixels, _ = webp.decode(_stream(write))
    assert pixels.ravel().tolist() == want


def _full_code(w, size):
    """All 256 literals at 8 bits: one bit for each length."""
    from quern.llm.webp import ORDER, Code

    w.bits(0, 1)
    used = [int(s in (0, 8)) for s in range(19)]
    n = max(k for k, s in enumerate(ORDER) if used[s]) + 1
    w.bits(n - 4, 4)
    for s in ORDER[:n]:
        w.bits(used[s], 3)
    w.bits(1, 1)
    w.bits(3, 3)
    w.bits(254, 8)
    for _ in range(256):
        w.bits(1, 1)
    return {s: (k, c) for s, k, c in Code([8] * 256 + [0] * (size - 256)).codes()}


@pytest.mark.parametrize("colours", [2, 3, 9, 40])
def test_webp_palette(colours):
    """Palettes of 1, 2, 4 and 8 bits a pixel."""
    from quern.llm import webp

    rng = np.random.default_rng(colours)
    width, height = 11, 3
    table = rng.integers(0, 2**32, colours, dtype=np.uint32)
    index = rng.integers(0, colours, (height, width))
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, size = 1 << packed, 8 >> packed
    rows = [[sum(int(index[y, x + k]) << (k * size) for k in range(per) if x + k < width) for x in range(0, width, per)] for y in range(height)]
    steps = [webp._subtract(int(p), int(q)) for p, q in zip(table, [0, *table[:-1]], strict=True)]

    def write(w):
        webp._head(w, width, height)
        w.bits(1, 1)
        w.bits(webp.PALETTE, 2)
        w.bits(colours - 1, 8)
        w.bits(0, 1)
        tables = [_full_code(w, n) for n in (280, 256, 256, 256)]
        webp._one(w, 0)
        for p in steps:
            a, r, g, b = webp._bytes(p)
            for t, v in zip(tables, (g, r, b, a), strict=True):
                _put(w, t, v)
        w.bits(0, 1)
        w.bits(0, 1)
        w.bits(0, 1)
        green = _full_code(w, 280)
        for v in (0, 0, 255, 0):
            webp._one(w, v)
        for row in rows:
            for v in row:
                _put(w, green, v)

    pixels, _ = webp.decode(_stream(write))
    assert (pixels == table[index]).all()


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C
    from quern.llm.packing import tokenizer

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(["en", "th", "er", "on", "an", "re"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    passage = text(4)
    rows = [(i, text(6), "en") for i in range(12)]
    rows += [(20, rows[0][1], "en"), (21, rows[1][1] + " x", "en"), (22, text(2) + "\n" + passage, "en"), (23, text(2) + "\n" + passage, "en"), (24, "1234 !!", "en"), (25, None, "en"), (26, "", "en")]
    docs = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # Brute force, stage by stage.
    have = [(i, t) for i, t, _ in rows if t and re.search("[^\\W\\d_]", t)]
    have = [(x[0], x[4]) for x in brute_lines(have, 2)]
    from quern.llm.simhash import fingerprint

    prints, kept = [(i, fingerprint(t), t) for i, t in have], []
    group = {i: i for i, _, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a, _ in prints:
            for j, b, _ in prints:
                if (a ^ b).bit_count() <= 2 and group[j] < group[i]:
                    group[i], changed = group[j], True
    kept = [(i, t) for i, _, t in prints if group[i] == i]
    seen, left = {}, []
    for k, (i, t) in enumerate(kept):
        b = t.encode()
        for s in range(len(b) - 199):
            seen.setdefault(b[s : s + 200], (k, s))
    for k, (i, t) in enumerate(kept):
        b, m = t.encode(), bytearray(len(t.encode()))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] != (k, s):
                m[s : s + 200] = b"\1" * 200
        left.append((i, bytes(x for x, g in zip(b, m, strict=True) if not g).decode("utf-8", "ignore")))
    lib = tokenizer("byte_bpe_50k.json").tokenizer
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    got = C.run(spark, str(tmp_path)).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert [n for n, _ in C.STAGES] and C.ORACLE_SQL is None
    clash = ["_text", "uid", "a", "keys", "doc id x", "lang_pred", "score", "bytes"]
    wide = docs
    for c in clash:
        wide = wide.withColumn(c, docs["doc_id"])
    for _, stage in C.STAGES[:-1]:
        made = stage(spark, wide, str(tmp_path))
        assert made.columns == wide.columns and all(r["_text"] == r["doc_id"] == r["doc id x"] for r in made.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert stage(spark, docs.limit(5).union(docs.limit(5)), str(tmp_path)).columns == docs.columns
    assert C.pack(spark, docs.limit(0), "").count() == 0


def test_shared_folder_holds_only_results(spark, tmp_path):
    import os

    from quern.llm import queries

    spark.read.parquet(f"{SF}/documents.parquet").limit(60).write.parquet(f"{tmp_path}/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    for name in ("op6_line_dedup", "op7_suffix_array", "op8_simhash"):
        before = set(os.listdir(folder))
        assert queries.queries()[name](spark, str(tmp_path)).count() == 60
        assert len(set(os.listdir(folder)) - before) == 1


def test_near_duplicate_stage(spark):
    """Planted pairs with a similarity from 0.8 to 0.95 go, those below stay; chains and odd texts too."""
    import corpus_pipeline as C

    rnd = random.Random(12)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    similar = lambda s, t: len(s & t) / len(s | t)
    rows, at = [], []
    for k in range(60):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(150, 400))]
        edited = list(words)
        for p in range(2, len(words), rnd.choice([200, 90, 60, 50, 45, 40, 36, 30])):
            edited[p] = "other"
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(edited))] + ([(3 * k + 2, " ".join(words).upper())] if k % 5 == 0 else [])
        at.append(similar(grams(" ".join(words)), grams(" ".join(edited))))
    assert sum(0.8 <= s <= 0.95 for s in at) > 20 and sum(s < 0.8 for s in at) > 10
    chain = [f"c{k}" for k in range(200)]  # each is like the next, not like the first
    rows += [(1000 + k, " ".join(chain[8 * k :] + [f"d{j}" for j in range(8 * k)])) for k in range(6)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one three")]
    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}
    near = [(i, j) for i in sets for j in sets if j < i and similar(sets[i], sets[j]) >= 0.8]
    for _ in rows:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    docs = docs_of(spark, [(i, t, "en") for i, t in rows]).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, "").collect()) == sorted(i for i, r in root.items() if i == r)
    assert C.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_single_line_repeats_in_pipeline(spark):
    """Long single lines and one-line documents lose their later copies; short common lines stay."""
    import corpus_pipeline as C

    words = lambda n, k: " ".join(f"w{k}x{j}" for j in range(n))
    long, under = words(50, 1), words(49, 2)
    rows = [(1, f"a1\n{long}\na2"), (2, f"b1\n{long}\nb2\n{under}\nb3"), (3, f"c1\n{under}\nc2\nshort"), (4, long), (5, "a whole text"), (6, "a whole text"), (7, "short"), (8, "short"), (9, f"{long}\nd\n{long}"), (10, "x\nshort\ny"), (11, None), (12, ""), (13, "")]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows]).select("doc_id", "text", "lang", "source", "n_chars")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in C.dedup_lines(spark, docs, "").collect()}
    want = {**dict(rows), 2: f"b1\nb2\n{under}\nb3", 4: "", 6: "", 8: "", 9: "d"}
    assert got == {i: (t, None if t is None else len(t)) for i, t in want.items()}


def test_toxicity_repeated_rows(spark, monkeypatch):
    from quern.llm import toxicity

    docs = docs_of(spark, [(i, f"text number {'abcdef'[i]}", "en") for i in [0] * 30 + [1] * 30 + [2, 3, 4, 5]])
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(6)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: (list(texts), y))
    texts, y = toxicity.learn(docs, labels, sample=3)
    assert sorted(y) == [0, 0, 0, 1, 1, 1] and len({str(t) for t in texts}) == 6
