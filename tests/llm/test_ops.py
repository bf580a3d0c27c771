"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import string

import corpus_pipeline
import numpy as np
import pytest
from cubewright.llm import fingerprint, langid, lm_score, mixing, packing, pii, simhash, suffix_dedup, topk, url_filter
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n string, part int, length string, count int, fp string"
R = random.Random(7)
LONG = " ".join("".join(R.choice("abcdefg") for _ in range(5)) for _ in range(20000))
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog", "en", "a"),
    (1, "The cat sat on the mat and looked at the dog", "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, " \n\t ", "de", "b"),
    (None, "mail me at x.y@example.org or +49 (0)30 1234567 now", "en", None),
    (5, LONG, "de", "c"),
    (6, "12345 67890", None, "a"),
    (7, "a", "fr", "c"),
    (8, "card 4111 1111 1111 1111 and ip 10.0.0.1, not 300.1.1.1", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, 1, "x", 2, "y", 3, "z") for r in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def per_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


DIGESTS = {
    "lm": lambda d: lm_score.stupid_backoff(d).select("doc_id", "n_words", F.round("log_score", 6)),
    "mix": lambda d: mixing.mix_plan(d).select("doc_id", "mix_size", "mix_copies"),
    "fingerprint": lambda d: fingerprint.fingerprints(d).select("doc_id", "n_chars", "edited_sha256"),
    "pack": lambda d: packing.pack(d, packing.default_tokenizer()).select("doc_id", "piece", "length"),
    "language": lambda d: langid.identify(d, langid.learn(d, least=1)).select("doc_id", "lang_pred"),
    "suffix": lambda d: suffix_dedup.remove_repeats(d, 400).select("doc_id", "n_bytes", "n_removed"),
    "simhash": lambda d: simhash.near_duplicates(d).select("doc_id", "fp", "component_id"),
    "copies": lambda d: simhash.near_copies(d).select("doc_id", "fp", "component_id"),
    "pii": lambda d: pii.find_pii(d).select("doc_id", pii.joined(F.col("pii"))),
}


@pytest.mark.parametrize("name", DIGESTS)
def test_odd_rows(name, docs, empty):
    got = per_row(DIGESTS[name](docs))
    assert DIGESTS[name](empty).count() == 0
    if name != "pack":
        assert len(got) == len(TEXTS)
        assert sorted((r[0] for r in got), key=repr) == sorted((t[0] for t in TEXTS), key=repr)
    same = {r[:2] for r in got if r[0] == 1}  # what follows a document differs between repeated rows
    assert len([r for r in got if r[0] == 1]) == 2 and len(same) == 1
    assert got == per_row(DIGESTS[name](docs.repartition(3, "n_chars")))


def brute_backoff(texts, order, backoff=0.4):
    from collections import Counter
    from math import log

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    grams = [Counter(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1)) for ws in words]
    total = sum(grams, Counter())
    out = []
    for ws, own in zip(words, grams):
        rest, n, s = Counter(total), sum(map(len, words)) - len(ws), 0.0
        rest.subtract(own)
        for i in range(len(ws)):
            scale = 1.0
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(ws[i - k + 1 : i + 1])
                if rest[g] > 0:
                    s += log(scale * rest[g] / (rest[g[:-1]] if k > 1 else n))
                    break
                scale *= backoff
            else:
                s += log(scale / (n + 1))
        out.append((len(ws), round(s, 6)))
    return sorted(out)


def thue_morse(n):
    """Two words of ``2**n`` letters that sums of powers modulo 2**64 can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words_alike_in_sums_of_powers(spark):
    from tokenizers import Tokenizer

    a, b = thue_morse(11)
    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    df = spark.createDataFrame([(0, a), (1, b), (2, f"x {b} y"), (3, a[:9] + " " + a[:9].upper())], "doc_id long, text string")
    for r in packing.pack(df.coalesce(1), path, keep_ids=True).collect():
        text = {0: a, 1: b, 2: f"x {b} y", 3: a[:9] + " " + a[:9].upper()}[r.doc_id]
        assert list(r.ids) == (plain.encode(text, add_special_tokens=False).ids + [0])[r.start : r.start + r.length]
    got = {r.doc_id: r.log_score for r in lm_score.stupid_backoff(df).collect()}
    assert got[0] == pytest.approx(np.log(0.4 / 7)) and got[1] == pytest.approx(np.log(1 / 6))
    long = spark.createDataFrame([(0, a), (1, b), (2, a)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(long, 2048).collect()} == {0: 2048, 1: 0, 2: 2048}


def test_other_tokenizer_is_refused(tmp_path):
    import json
    from pathlib import Path

    rules = json.loads(Path(packing.default_tokenizer()).read_text())
    rules["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(rules))
    with pytest.raises(ValueError):
        packing.Encoder(str(tmp_path / "t.json"))


CLASHES = ["lang_pred", "lang_score", "pii", "clean", "mix_size", "mix_copies", "mix_target", "source_size", "fp", "root", "keep", "rule", "__id", "__th", "__clean", "__copy", "__source", "__pii", "__lang_pred", "part", "h", "count", "length", "block", "value", "text_2", "stop", "start"]


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_with_clashing_columns_and_empty_tables(spark, docs, sf, at):
    name, stage = corpus_pipeline.STAGES[at]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = plain.withColumns({c: F.lit("kept") for c in CLASHES})
    got = stage(spark, more, sf)
    base = [c for c in ("doc_id", "text", "lang", "source", "n_chars", "piece", "start" if name == "packing" else "doc_id", "length" if name == "packing" else "doc_id") if c in got.columns]
    assert per_row(got.select(base)) == per_row(stage(spark, plain, sf).select(base))
    if name != "packing":
        assert got.columns == more.columns and got.where(F.greatest(*CLASHES) != "kept").count() == 0
    none = stage(spark, more.limit(0), sf)
    assert none.count() == 0 and none.columns == got.columns


def test_operators_with_clashing_columns(spark, docs):
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit("x") for c in CLASHES})
    assert langid.identify(more, langid.learn(more, least=1)).select("lang_pred", "stop").count() == len(TEXTS)
    assert pii.find_pii(more).select(F.size("pii"), "clean").count() == len(TEXTS)
    assert mixing.mix_plan(more).agg(F.sum("mix_copies")).first()[0] == mixing.mixed(more).count()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(spark, order):
    texts = [" ".join(R.choice("ab cd ef gh the of".split()) for _ in range(R.randrange(30))) for _ in range(60)] + [None, "", "new", "the the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = lm_score.stupid_backoff(df, order, block_bytes=300, bits=3).select("n_words", F.round("log_score", 6)).collect()
    assert sorted(map(tuple, got)) == brute_backoff(texts, order)


def test_mixing_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "é": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weights = dict(zip(["a", "b", "c", "é", None], [1, 2, 3, 1, 2]))
    want, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    assert got == pytest.approx(want)


def test_mixing_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    plan = mixing.mix_plan(docs).cache()
    near = plan.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("t"), F.first("mix_target").alias("w")).collect()
    draws = plan.withColumn("f", F.col("mix_target") / F.col("mix_source_size") % 1).groupBy("source").agg(F.sum(F.pow("mix_size", F.lit(2)) * F.col("f") * (1 - F.col("f"))).alias("v")).collect()
    spread = {r.source: r.v**0.5 for r in draws}  # standard deviation of what the draws of a source add up to
    off = [(r.t - r.w) / spread[r.source] for r in near if spread[r.source] > 0]
    assert max(map(abs, off)) < 4 and sum(x * x for x in off) / len(off) < 2
    assert all(abs(r.t - r.w) < 1e-6 * r.w for r in near if not spread[r.source]) and abs(sum(r.t for r in near) / sum(r.w for r in near) - 1) < 0.1
    assert plan.where("mix_copies > 3").count() == 0
    assert mixing.mixed(docs).count() == plan.agg(F.sum("mix_copies")).first()[0]


def test_fingerprints(spark):
    texts = ["".join(R.choice(string.ascii_lowercase + " é") for _ in range(R.choice([0, 1, 2, 3, 50, 700]))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df, parts=9).collect()}
    marks = fingerprint.embed(texts)
    for i, t in enumerate(texts):
        other = texts[i - 1] if i else texts[-1]
        e = fingerprint.edited(t, other)
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(fingerprint.likeness(marks[i], fingerprint.embed([e])[0]))
        assert got[i].near_next == pytest.approx(fingerprint.likeness(marks[i], marks[i - 1]))


def test_fingerprints_of_equal_and_missing_ids(spark):
    """The order is by id, then by hash of the text, however rows without an id or with one id are dealt out."""
    rows = [(i if i < 20 else 7 if i < 120 else None, f"text {i} " + "abc" * (i % 50)) for i in range(220)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [tuple(r) for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()]
    want = sorted((str(i), hashlib.sha256(fingerprint.edited(t, o).encode()).hexdigest()) for (i, t), (_, o) in zip(order, order[1:] + order[:1]))
    for parts in (1, 4, 16):
        assert sorted((str(r.doc_id), r.edited_sha256) for r in fingerprint.fingerprints(df, parts).collect()) == want


def test_edits_move_fingerprints_little():
    base = "".join(R.choice(string.ascii_lowercase) for _ in range(2000))
    near = base[:700] + "x" + base[700:1500] + base[1503:]
    other = "".join(R.choice(string.ascii_lowercase) for _ in range(2000))
    a, b, c = fingerprint.embed([base, near, other])
    assert fingerprint.likeness(a, b) > 0.8 > 0.2 > fingerprint.likeness(a, c)


def test_walks_apart_and_together():
    """A text has the same fingerprint alone, among few and among many; a long one takes time in proportion."""
    import time

    texts = ["".join(R.choice(string.ascii_lowercase) for _ in range(R.choice([0, 1, 5, 40, 700, 3000]))) for _ in range(150)]
    together = fingerprint.embed(texts)
    assert together == [fingerprint.embed([t])[0] for t in texts] and together[:9] == fingerprint.embed(texts[:9])
    began = time.time()
    assert len(fingerprint.embed(["".join(R.choice("abcdefgh ") for _ in range(1000)) * 1000])[0]) > 400
    assert time.time() - began < 20


def test_near_pairs(spark):
    base = "".join(R.choice(string.ascii_lowercase) for _ in range(1000))
    texts = [base, base[:500] + base[501:], "".join(R.choice(string.ascii_lowercase) for _ in range(1000)), base]
    prints = spark.createDataFrame([(i, __import__("base64").b64encode(p).decode()) for i, p in enumerate(fingerprint.embed(texts))], "doc_id long, fingerprint string")
    assert {r.doc_id: r.class_id for r in fingerprint.near_pairs(prints).collect()} == {0: 0, 1: 0, 2: 2, 3: 0}


@pytest.mark.parametrize("cap", [4096, 5])
def test_near_pairs_against_likeness(spark, cap):
    """Early, late and short edits, another opening of a long text, short texts, and a bucket whose smallest member is unlike the others."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    texts = []
    for n in (3, 8, 40, 300, 3000, 20000):
        for _ in range(4):
            t = word(n)
            texts += [t, t[:-1] + "!", "!" + t[1:], t[: n // 2] + t[n // 2 + 1 :], t + word(n // 12), word(n // 12) + t[n // 12 :], t[: n // 3] + word(n - n // 3)]
    texts += (lambda t: [word(600) + t[600:], word(600) + t[600:], word(900) + t[900:]])(word(20000))
    prints = fingerprint.embed(texts)
    pairs = [(a, b) for b in range(len(prints)) for a in range(b) if fingerprint.likeness(prints[a], prints[b]) >= 0.8]
    want = simhash.forest(len(prints), iter([(np.array([a]), np.array([b])) for a, b in pairs]))
    df = spark.createDataFrame([(i, __import__("base64").b64encode(p).decode()) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    got = {r.doc_id: r.class_id for r in fingerprint.near_pairs(df, cap=cap).collect()}
    assert got == dict(enumerate(want.tolist())) and len(pairs) > 40


def test_topk(spark):
    """Equal ids are rows of their own: both ask, and each answers the other."""
    rng = np.random.default_rng(3)
    v = [[float(x) for x in row] for row in rng.normal(size=(300, 8))]
    rows = [(i, x) for i, x in enumerate(v)] + [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (400, v[0]), (401, v[0]), (402, [])]
    rows += [(100, [float(x) for x in rng.normal(size=8)]), (100, v[100]), (7, v[7])]
    df = spark.createDataFrame([(i, x, "z") for i, x in rows], "vec_id long, embedding array<double>, rank string")
    ints = [(i, np.floor(1024 * np.array(x + [0.0] * (8 - len(x))))) for i, x in rows if i < 1000]
    want = []
    for n, (q, x) in enumerate(ints):
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for m, (i, y) in enumerate(ints) if m != n)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for size, ask in ((64, 2), (4096, 256), (7, 1)):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=10, pivots=5, block=size, query_block=ask).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = topk.top_k(df.where("vec_id in (0, 3, 1000)"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 3)]
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_topk_prunes(spark):
    """Most blocks are left out before queries and vectors meet, and in the others most vectors are not evaluated."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-9, 9, (20, 8))
    v = centres[rng.integers(0, 20, 4000)] + rng.integers(-50, 50, (4000, 8)) / 1000
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    evaluated = topk.candidates(df, F.col("vec_id") < 50, pivots=16, block=100, query_block=10).agg(F.sum("evaluated")).first()[0]
    assert evaluated < 50 * 4000 / 4


def test_packing(spark):
    path = packing.default_tokenizer()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = [t[1] for t in TEXTS] + ["it's WE'LL don't ''s 5's x'sam <|endoftext|> é", "日本語 テスト Σας", "a  b\r\nc\x0bd\xa0e"]
    texts += ["".join(R.choice("ab'sé 1.,\n£") for _ in range(R.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for capacity in (2048, 64):
        packed = packing.pack(df, path, capacity, keep_ids=True).cache()
        rows = packed.collect()
        for i, t in enumerate(texts):
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
            assert [x for r in own for x in r.ids] == plain.encode(t or "", add_special_tokens=False).ids + [0]
            assert all(r.length == capacity for r in own[:-1]) and [r.start for r in own] == [capacity * r.piece for r in own]
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append(r)
        for own in by.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= capacity
        assert len(by) <= 1.1 * sum(r.length for r in rows) / capacity + 1
        seqs = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
        assert seqs == {k: [x for r in own for x in r.ids] for k, own in by.items()}


def test_plan_uses_every_piece():
    counts = {R.randrange(1, 101): R.randrange(1, 500) for _ in range(60)}
    used = {}
    for items, times in packing.plan(counts, 100):
        assert sum(items) <= 100
        for x in items:
            used[x] = used.get(x, 0) + times
    assert used == counts


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.NET/en/x", "https://a.example.net/de/", "http://example.net", "http://a.example.com/de/1?x=/en/", "http://x.org/fr/", "http://xorg/fr/", "http://notexample.com/de/", "ftp://a.b/ads/1", "http://net:80/", "http://1.2.3.4/", "x://host?://net/", "http://casino.example.org/"]
    df = spark.createDataFrame([(i, u, "q") for i, u in enumerate(urls)] + [(3, urls[3], "q")], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, url_filter.HOST_RULES + url_filter.FREE_RULES).collect()}
    allow = (None, "allow")
    assert got == dict(enumerate([allow, allow, allow, ("example.net/en/", "allow"), ("net/", "block"), allow, ("example.com/de/", "block"), ("org/fr/", "allow"), allow, allow, (None, "block"), allow, (None, "block"), allow, (None, "block")]))
    assert url_filter.judge(df.limit(0), url_filter.HOST_RULES).count() == 0


def test_language_against_sets():
    """Without false positives of its filters a model decides as plain sets of n-grams do."""
    rng = random.Random(8)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(3, 8))) for _ in range(60)] for k, a in (("aa", "abcdefg"), ("bb", "efghijk"), ("cc", "ijklmno"))}
    own = {k: set(langid.grams([" ".join(w).encode()])[0].tolist()) for k, w in words.items()}
    slots = np.zeros((1 << 20, 1), np.uint64)
    for i, k in enumerate(own):
        for at in langid.places(np.array(sorted(own[k]), np.uint64), 1 << 20, 3):
            slots[at, 0] |= np.uint64(1 << i)
    model = langid.Model(list(own), slots, np.zeros(3), np.ones(3), 3)
    texts = [" ".join(rng.choice(words[rng.choice(list(words))]) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    lang, score = model.decide(texts)
    for t, got, s in zip(texts, lang, score):
        g = langid.grams([t.encode()])[0].tolist()
        share = {k: sum(x in own[k] for x in g) / len(g) for k in own}
        assert got == max(share, key=share.get) and s == pytest.approx(max(share.values()))


def brute_walk(text):
    """A walk by its definition, a character at a time."""
    out, pos, step, before = [], 0, 0, 0
    wanted = set(fingerprint.STEPS.tolist())
    codes = [ord(c) for c in text]
    while pos < len(codes):
        shift = int(fingerprint.mix(np.array([step], np.uint64))[0]) >> 48
        if step in wanted:
            before = codes[pos - 1] if pos else 0
            out.append((codes[pos] * 2654435761 + before * 2246822519 & 0xFFFFFFFF) >> 24)
        key = (codes[pos] * 3266489917 & 0xFFFFFFFF) >> 16
        pos += int(fingerprint.MOVES[key + shift & 0xFFFF])
        step += 1
    return bytes(out)


def test_walks_by_definition():
    texts = ["", "a", "é日本", "abc " * 300] + ["".join(R.choice("abcdefgh é") for _ in range(R.randrange(900))) for _ in range(40)]
    assert fingerprint.embed(texts) == [brute_walk(t) for t in texts]


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()))
    got = langid.identify(docs.where(langid.held_out()), model).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "lang_score").toPandas()
    assert got["ok"].mean() > 0.97 and got["lang_score"].between(0, 1).all()


def test_many_languages():
    langs = [f"l{i:03d}" for i in range(70)]
    slots = np.zeros((1 << 12, 2), np.uint64)
    for k in range(70):
        for at in langid.places(langid.grams([f"word{k:03d}".translate(str.maketrans("0123456789", "abcdefghij")).encode()])[0], 1 << 12, 3):
            slots[at, k // 64] |= np.uint64(1) << np.uint64(k % 64)
    model = langid.Model(langs, slots, np.zeros(70), np.ones(70), 3)
    assert model.decide(["wordagj", "12", None])[0] == ["l069", "und", "und"]


@pytest.mark.parametrize("cap", [1000, 4])
def test_suffix_dedup(spark, cap):
    rnd = lambda n: "".join(R.choice("abcdefgh ij\né") for _ in range(n))
    p, base = rnd(90), rnd(300)
    texts = [base, base, rnd(60) + p + rnd(100), p + rnd(6), rnd(99), "a" * 400, "ab" * 200, rnd(20) + p + rnd(2) + p, "", "\0" * 150 + "x"]
    texts += [base[:k] + "z" + base[k + 1 :] for k in range(0, 300, 17)] + [rnd(R.randrange(60)) + p[:85] + rnd(R.randrange(60)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, base)], "doc_id long, text string")
    want = suffix_dedup.brute_force([t.encode() for t in texts] + [base.encode()], 80)
    got = {(r.doc_id, r.n_removed, r.n_spans, r.s) for r in suffix_dedup.remove_repeats(df, 80, cap).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).collect()}
    assert got == {(i % len(texts), *w) for i, w in enumerate(want)}


@pytest.mark.parametrize("zero", [b"", b"\0"])
def test_suffix_array_and_prefixes(zero):
    pieces = [b"".join(R.choice([b"ab", b"abab", b"b", b"a" * 40, zero]) for _ in range(R.randrange(1, 30))) + zero * R.randrange(3) for _ in range(12)]
    pieces += [pieces[0], pieces[1][3:], pieces[2] + zero]
    data = b"".join(p + bytes(8) for p in pieces)
    ends = np.cumsum([len(p) + 8 for p in pieces]) - 8
    raw = np.frombuffer(data, np.uint8)
    limit = np.zeros(len(raw), np.int32)
    for p, e in zip(pieces, ends):
        limit[e - len(p) : e] = e
    words = suffix_dedup._packed(raw)
    sa = suffix_dedup.suffix_array(raw, limit)
    assert sa.tolist() == sorted(np.flatnonzero(limit).tolist(), key=lambda i: (data[i : limit[i]], i))
    for least in (1, 20):
        plcp = suffix_dedup.kasai(raw, limit, words, sa, least)
        for a, b in zip(sa.tolist(), sa[1:].tolist()):
            n = 0
            while a + n < limit[a] and b + n < limit[b] and data[a + n] == data[b + n]:
                n += 1
            assert plcp[b] == (n if limit[b] - b >= least else 0)


def test_order_of_wide_keys():
    key = np.array([R.randrange(5) << 61 for _ in range(100)], np.uint64)
    for bits in (64, 40):
        order, got = suffix_dedup._ordered(key >> np.uint64(64 - bits), bits)
        assert order.tolist() == np.argsort(key, kind="stable").tolist() and (got == np.sort(key) >> np.uint64(64 - bits)).all()


def brute_groups(fps, bits):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [fps[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("cap", [4096, 8])
def test_hamming_groups(spark, cap):
    rng = np.random.default_rng(5)
    fps = set()
    for c in rng.integers(0, 1 << 62, 12).tolist():
        for _ in range(25):
            x = c
            for b in rng.choice(63, rng.integers(0, 7), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    got = {r.fp: r.root for r in simhash.hamming_groups(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, cap).collect()}
    assert [got.get(x, x) for x in fps] == brute_groups(fps, 4)


def test_near_copies_against_jaccard(spark, sf):
    rows = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] for r in rows}
    edits = {}
    for i in list(words)[::10]:  # copies with every 60th word replaced: about 0.85 in common
        if len(words[i]) > 120:
            edits[100000 + i] = [f"neu{k}" if k % 60 == 30 else w for k, w in enumerate(words[i])]
    words |= edits
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_copies(df).select("doc_id", "component_id", "keep").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    has, common = {}, {}
    for i, s in sets.items():
        for g in s:
            has.setdefault(g, []).append(i)
    for ids in has.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] = common.get((a, b), 0) + 1
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in common.items()}
    close = [p for p, j in alike.items() if j >= 0.8]
    linked = [got[a].component_id == got[b].component_id for a, b in close]
    assert len(close) > 30 and sum(linked) >= 0.95 * len(close)
    best = {i: 0.0 for i in words}
    for (a, b), j in alike.items():
        best[a], best[b] = max(best[a], j), max(best[b], j)
    assert [(i, len(words[i]), best[i]) for i in words if best[i] < 0.5 and not got[i].keep] == []
    assert sum(r.keep for r in got.values()) == len({r.component_id for r in got.values()})


def test_near_copies_have_no_link_below(spark):
    """Copies at 0.82 are linked; a pair at 0.67 to 0.77, which sketches can't tell from 0.8, is not."""
    rng = random.Random(3)
    rows, near, far = [], [], []
    for k in range(60):
        ws = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(304)]
        rows.append((3 * k, " ".join(ws)))
        for i, edits, pairs in ((1, 6, near), (2, 8 + k % 4, far)):
            rows.append((3 * k + i, " ".join(f"neu{n}" if n % (300 // edits) == 20 else w for n, w in enumerate(ws))))
            pairs.append((3 * k, 3 * k + i))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and a // 3 == b // 3}
    assert all(alike[p] > 0.8 for p in near) and all(0.65 < alike[p] < 0.8 for p in far) and all(j < 0.8 for p, j in alike.items() if p not in near)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [p for p in far if got[p[0]] == got[p[1]]] == []
    assert sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)


@pytest.mark.parametrize("cap, most", [(4096, 1 << 21), (7, 1 << 21), (4096, 1500)])
def test_exact_links_against_jaccard(spark, cap, most):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(6):
            ws = list(ws)
            for _ in range(rng.randrange(3)):
                ws[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(ws[: 80 - rng.randrange(9)]))
    sets = [simhash.shingle_set(t) for t in texts]
    want = simhash.forest(len(sets), iter([(np.array([a]), np.array([b])) for b in range(len(sets)) for a in range(b) if 5 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 4 * (len(sets[a]) + len(sets[b]) - c)]))
    assert (simhash.exact_forest(sets, 0.8, step=100) == want).all() and 12 < len(set(want.tolist())) < len(sets)
    df = spark.createDataFrame([(i, 0, i, 0, len(h), t) for i, (h, t) in enumerate(zip(sets, texts))], "fp long, root long, __id long, __th long, size long, text string")
    got = {r.v: r.root for r in simhash.components(simhash.exact_links(df.select("__id", "__th", "text"), df.drop("text"), 5, 0.8, cap, most)).collect()}
    assert got == {i: int(w) for i, w in enumerate(want) if i != w}


@pytest.mark.parametrize("leaf, cap", [(2, 20), (64, 4096)])
def test_sketch_links_in_large_groups(spark, leaf, cap):
    base = [R.getrandbits(64) for _ in range(simhash.WIDE)]
    rows = [[w ^ (1 << R.randrange(64)) for w in base] for _ in range(150)] + [[R.getrandbits(64) for _ in base] for _ in range(150)]
    signed = [[w - (1 << 64) if w >> 63 else w for w in r] for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(signed)], "fp long, " + ", ".join(f"w{i} long" for i in range(simhash.WIDE)))
    got = {r.v: r.root for r in simhash.components(simhash.sketch_links(df, 0.8, 0.95, cap, leaf)).collect()}
    assert got == {i: 0 for i in range(1, 150)}


def test_simhash_matches_definition(spark):
    text = "The THE quick brown fox; ÀB jumps over a lazy dog again and again"
    words = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).split(" ")
    hashes = [spark.sql("select xxhash64(:a) h", args={"a": " ".join(words[i : i + 4])}).first().h & (1 << 64) - 1 for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want and simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    shapes = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, shape in shapes.items():
        for m in re.finditer(shape, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [t[1] for t in TEXTS]
    texts += ["".join(R.choice("0123456789 .-@+ab_%é(") for _ in range(R.randrange(200))) for _ in range(400)]
    texts += ["0" * 20000, "a" * 20000 + "@", "1." * 10000, "a@b.c " * 1000, "a@" + "b." * 9000 + "c", "a@b.com_x@d.com", "1.2.3.4.5.6.7.8"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_pii(df).select("doc_id", pii.joined(F.col("pii")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i].split(",") if s.split(":")[0] in pii.BASE] == brute_pii(t)


def test_pii_takes_time_in_proportion(spark):
    """Twice the spans in a text take about twice the time; found and redacted as by hand."""
    import time

    took = {}
    for n in (500, 32000, 64000, 32000, 64000):
        text = "é a@b.co, " * n
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        r = pii.redact(pii.find_pii(df)).select(F.sha2("text", 256).alias("s")).first()
        took[n] = time.time() - began
        assert r.s == hashlib.sha256(("é <EMAIL>, " * n).encode()).hexdigest()
    assert took[64000] < 3.5 * took[32000] + 1


def test_pii_context_and_overlaps(spark):
    """Context words across several matches; overlapping spans of two kinds make one stretch."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["call ", "api-key ", "ab12" * 6, "a@b.co", " ", "1.2.3.4", "+4930123456789", "visa 4111 1111 1111 1111", "é", "x" * 45, ",", "host "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_pii(df)
    for r, clean in zip(found.orderBy("doc_id").collect(), [x.text for x in pii.redact(found).orderBy("doc_id").collect()]):
        t, want, at = r.text, "", 0
        for s in r.pii:
            near = re.search(pii.CONTEXT[s.kind], t[max(0, s.start - 40) : s.start].lower())
            assert s.score == pytest.approx(sum(pii.SCORES[s.kind]) if near else pii.SCORES[s.kind][0])
        for s in sorted(r.pii, key=lambda s: (s.start, -s.stop)):
            if s.start >= at:
                want += t[at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.stop)
        assert clean == want + t[at:]


def test_pii_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op10_pii(spark, sf).collect():
        want = brute_pii(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(w.startswith(k + ":") for w in want) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.spans.startswith(",".join(want))


def test_registered_queries_run(spark, sf):
    """Every query of this folder runs on the given tables and has its columns."""
    from cubewright.llm.queries import QUERIES

    shapes = {"op2": "doc_id size source_size target taken", "op3": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op4": "query_id rank vec_id score", "op5": "doc_id piece start length ids_crc32 sequence_id offset", "op6": "page_id host path rule verdict", "op7": "doc_id held_out lang_pred score", "op8": "doc_id n_bytes n_removed n_spans kept_sha256", "op9": "doc_id fingerprint component_id", "op10": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op11": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op12": "page_id url text n_chars", "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256"}
    for name, q in QUERIES.items():
        df = q(spark, sf)
        assert set(shapes.get(name.split("_")[0], "doc_id").split()) <= set(df.columns) and df.collect()


def test_pii_more_kinds(spark):
    texts = ["DE89 3704 0044 0532 0130 00 is my iban", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "123-45-6789", "é a@b.co and 4111111111111111!", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 24be64439e3e49cf46b2d7c90f3602a3d0b907ff', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff token"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    found = pii.find_pii(df)
    got = {r.doc_id: [x.kind for x in r.pii] for r in found.collect()}
    assert got == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["email", "card"], 5: ["secret"], 6: []}
    assert {r.doc_id: (r.text, r.n_chars) for r in pii.redact(found).collect()}[4] == ("é <EMAIL> and <CARD>!", 21)


def brute_stages(rows):
    """What the stages make of ``rows`` (doc_id, text, lang, source), by hand: kept ids, kept ids, redacted texts, copies; and the pieces."""
    from fractions import Fraction

    from tokenizers import Tokenizer

    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    yield {r["doc_id"] for r in rows}
    sets = {}
    for r in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        sets[r["doc_id"]] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    ids = sorted(sets)
    label = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and label[a] != label[b] and 5 * (n := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - n):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    rows = [r for r in rows if label[r["doc_id"]] == r["doc_id"]]
    yield {r["doc_id"] for r in rows}
    for r in rows:
        spans = [s.split(":") for s in brute_pii(r["text"])]
        for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", r["text"]):
            if len(m[0]) <= 256 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and re.search(pii.CONTEXT["secret"], r["text"][max(0, m.start() - 40) : m.start()].lower()):
                spans.append(("secret", str(m.start()), str(m.end())))
        spans = sorted(((int(a), -int(b), k) for k, a, b in spans))
        out, at = "", 0
        for a, b, k in spans:
            if a >= at:
                out += r["text"][at:a] + f"<{k.upper()}>"
            at = max(at, -b)
        r["text"] = out + r["text"][at:]
    yield {r["doc_id"]: r["text"] for r in rows}
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    sources = sorted({r["source"] for r in rows})
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    want, open_, left = {}, {s: k % 3 + 1 for k, s in enumerate(sources)}, Fraction(sum(total.values()))
    while open_:
        over = {s for s, w in open_.items() if left * w / sum(open_.values()) > 3 * total[s]}
        want |= {s: Fraction(3 * total[s]) for s in over} if over else {s: left * w / sum(open_.values()) for s, w in open_.items()}
        left -= sum(want[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in want}
    copies = []
    for r in rows:
        rate = want[r["source"]] / total[r["source"]] if total[r["source"]] else Fraction(1)
        draw = int(hashlib.md5(f"42:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13
        copies += [r["doc_id"]] * (int(rate) + (draw < float(rate - int(rate))))
    yield sorted(copies)
    plain = Tokenizer.from_file(packing.default_tokenizer())
    tokens = {r["doc_id"]: plain.encode(r["text"], add_special_tokens=False).ids + [0] for r in rows}
    yield sorted((i, s // 2048, s, len(tokens[i][s : s + 2048]), __import__("zlib").crc32(np.array(tokens[i][s : s + 2048], "<u4").tobytes())) for i in copies for s in range(0, len(tokens[i]), 2048))


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    seen = [lambda d: {r.doc_id for r in d.collect()}, lambda d: {r.doc_id for r in d.collect()}, lambda d: {r.doc_id: r.text for r in d.collect()}, lambda d: sorted(r.doc_id for r in d.collect())]
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, brute_stages(rows))):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert seen[k](docs) == want, name
        else:
            assert sorted(tuple(r)[:5] for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == want
            fill = {}
            for r in docs.orderBy("sequence_id", "offset").collect():
                assert r.offset == fill.get(r.sequence_id, 0)
                fill[r.sequence_id] = r.offset + r.length
            assert max(fill.values()) <= 2048 and len(fill) <= 1.1 * sum(fill.values()) / 2048 + 1


def test_pipeline(spark, docs, sf, tmp_path):
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == docs.columns
        d.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        if name == "language":
            assert per_row(d.select("doc_id"))[:-1] == [(1,), (1,), (5,), (7,), (8,)]
        if name == "near_duplicates":
            assert d.where("doc_id = 1").count() == 1 and d.count() == 5
        if name == "personal_data":
            assert "<EMAIL>" in d.where("doc_id is null").first().text
    assert corpus_pipeline.run(spark, sf).count() > 0
