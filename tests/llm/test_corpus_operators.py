"""Search, reputation, passages, repeated strings, language model and pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from clonal_spark.llm import chaining, column_bwt, components, gru_lm, host_reputation, projection_search
from clonal_spark.session import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- substring dedup by columns ---


def brute_left(texts):
    return [left for *_, left in brute_covered(texts, column_bwt.PASSAGE)]


def brute_repeats(texts):
    return [(n, removed, runs, hashlib.sha256(left).hexdigest()) for n, removed, runs, left in brute_covered(texts)]


def brute_covered(texts, length=column_bwt.LENGTH):
    raw = [(t or "").encode() for t in texts]
    starts = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        left = bytes(x for x, y in zip(b, covered, strict=True) if not y)
        runs = sum(1 for i in range(len(b)) if covered[i] and not (i and covered[i - 1]))
        out.append((len(b), sum(covered), runs, left))
    return out


def some_text(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def test_column_bwt(spark):
    shared, edited = some_text(900, 1), None
    edited = shared[:500] + "#" + shared[501:]
    texts = [None, "", "x", "x" * 399, "x" * 400, "x" * 1200, "ab" * 700, "é" * 500, "k" + "é" * 450, shared, "p" + shared, edited, some_text(300, 2) + shared[100:700] + some_text(300, 3), some_text(3000, 4), some_text(3000, 4), shared[:399], shared[:400]]
    docs = spark.createDataFrame([(t, i, "clash", 0) for i, t in enumerate(texts)], "text string, doc_id long, row_key string, place int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in column_bwt.removals(docs).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))
    cut = column_bwt.apply(docs)
    assert cut.columns == docs.columns and cut.count() == len(texts) and cut.where("doc_id = 0").first().text is None
    assert column_bwt.removals(docs.limit(0)).count() == 0


def test_column_bwt_repeated_rows_and_null_ids(spark):
    a, b = some_text(700, 5), some_text(700, 6)
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (None, b)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in column_bwt.removals(docs).collect()) == [(0, 700), (1, 700), (1, 700), (2, 700)]


def test_collection_over_many_blocks(tmp_path):
    rng = random.Random(7)
    base = bytes(rng.choice(b"ab") for _ in range(column_bwt.WIDTH))
    texts = []
    for _ in range(40):
        t = bytearray(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = rng.choice(b"cd")
        texts.append(bytes(t))
    some = column_bwt.Collection(str(tmp_path))
    for lo in range(0, 40, 7):
        part = texts[lo : lo + 7]
        some.add(np.zeros(len(part), np.int64), np.arange(lo, lo + len(part)), np.zeros(len(part), np.int64), part)
    first, last = some.repeated()
    for i, t in enumerate(texts):
        hits = [c for c in range(column_bwt.WIDTH - column_bwt.LENGTH + 1) if any(j != i and t[c : c + 400] == u[c : c + 400] for j, u in enumerate(texts))]
        assert ((first[i], last[i]) == (hits[0], hits[-1])) if hits else first[i] > last[i]


# --- chaining ---


def test_chains_are_the_best():
    rng = np.random.default_rng(8)
    for _ in range(30):
        xy = np.unique(rng.integers(0, 60, (12, 2)), axis=0)
        x, y = xy[:, 0], xy[:, 1]
        best = [float(chaining.K)] * len(x)
        for j in range(len(x)):
            for i in range(len(x)):
                if x[i] < x[j] and y[i] < y[j]:
                    best[j] = max(best[j], chaining.K + best[i] - chaining.GAP * (x[j] - x[i] + y[j] - y[i]))
        found = chaining.chains(x, y)
        if found:
            assert max(s for _, s in found) == pytest.approx(max(b for b in best if b > chaining.K), abs=1e-9)


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert chaining.common(a, b) == table[-1][-1]


def prose(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(100000)}" for _ in range(n)]


def test_passages(spark):
    passage = prose(70, 1)
    fuzzy = passage[:20] + ["changed"] + passage[21:45] + ["one", "more"] + passage[45:]
    texts = {
        0: prose(100, 2) + passage + prose(90, 3),
        1: prose(30, 4) + fuzzy + prose(40, 5),
        2: [w.upper() for w in passage] + prose(60, 6),
        3: prose(200, 7),
        4: prose(200, 7),
        5: prose(300, 8) + passage[:20],
        6: prose(10, 9),
        7: prose(10, 9),
    }
    rows = [(" ".join(t), i, "x") for i, t in texts.items()] + [(None, 8, "x"), ("", 9, "x"), (" ".join(texts[0]), None, "x")]
    docs = spark.createDataFrame(rows, "text string, doc_id long, seed string").repartition(3)
    got = chaining.passages(docs).collect()
    pairs = {(r.doc_id, r.other_id): r for r in got}
    assert set(pairs) == {(1, 0), (2, 0), (2, 1), (4, 3)} and pairs[4, 3].kind == "copy"
    assert (pairs[1, 0].start, pairs[1, 0].stop, pairs[1, 0].other_start, pairs[1, 0].other_stop) == (30, 102, 100, 170)
    assert (pairs[2, 0].start, pairs[2, 0].stop) == (0, 70) and pairs[2, 0].n_matched == 70
    assert chaining.passages(docs.limit(0)).count() == 0


def test_passages_of_many_documents_stay_linear(spark):
    passage = prose(80, 20)
    docs = spark.createDataFrame([(i, " ".join(prose(40, 100 + i) + passage + prose(40, 500 + i))) for i in range(60)], "doc_id long, text string")
    got = chaining.passages(docs).collect()
    assert len(got) <= 2 * 60 and {r.doc_id for r in got} | {r.other_id for r in got} == set(range(60))


# --- components ---


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {x: got.get(x, x) for x in parent} == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


# --- search ---


def brute_nearest(rows, k, chosen):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, np.float32))]
    out = {}
    for i, v in good:
        if chosen(i):
            scored = sorted((-float(v @ w) / (math.sqrt(v @ v) * math.sqrt(w @ w)), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_search(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(20)] + [(450, None), (451, [0.0] * 16), (452, [float("nan")] * 16), (453, [1.0, None] * 8), (454, [1.0] * 5), (455, [1.0, 2.0, 3.0, 4.0, 5.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(v, i, 3) for i, v in rows], "embedding array<float>, vec_id long, block int").repartition(4)
    want = brute_nearest(rows, 5, lambda i: i % 5 == 0)
    got = {}
    for r in projection_search.search(df, "vec_id % 5 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and len(found) == len(want[q])
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
        total += len(want[q])
    assert hits / total >= 0.9
    assert projection_search.search(df.limit(0), "vec_id % 5 = 0").count() == 0


def test_search_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(projection_search, "BLOCK_ROWS", 100)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = brute_nearest(rows, 5, lambda i: i % 50 == 0)
    got = {}
    for r in projection_search.search(df, "vec_id % 50 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


# --- reputation ---


def test_rules_and_hosts(spark):
    urls = [
        ("http://a.ORG/x", "a.org", "/x", "org/", "allow"), ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"), ("https://m.example.org/en/12?q#f", "m.example.org", "/en/12", "example.org/en/1", "block"),
        ("x://b.com/de/", "b.com", "/de/", "com/de/", "block"), ("http://b.com/fr/y", "b.com", "/fr/y", "com/fr/", "allow"), ("http://notcom/fr/", "notcom", "/fr/", None, "allow"), ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"), ("http://h.net", "h.net", "", None, "allow"), ("http://h.net?u=http://z.org/", "h.net", "", None, "allow"), ("http://É.net/", "É.net", "/", None, "allow"), ("http://org", "org", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(u[0], i, "c") for i, u in enumerate(urls)], "url string, page_id long, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in host_reputation.judge(pages, labels).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), urls[i]
    assert host_reputation.judge(pages.limit(0), labels).count() == 0


def test_bad_hosts_are_blocked_only_with_evidence(spark):
    rows, labels, n = [], [], 0
    for host, count, bad in (("spam.x.net", 80, 78), ("good.x.net", 80, 2), ("fine.y.net", 100, 5), ("rare.y.net", 1, 1), ("new.y.net", 3, None)):
        for k in range(count):
            rows.append((n, f"http://{host}/{k}"))
            if bad is not None:
                labels.append((n, int(k >= bad), 0))
            n += 1
    got = host_reputation.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.host, r.verdict) for r in got.collect()} == {("spam.x.net", "block"), ("good.x.net", "allow"), ("fine.y.net", "allow"), ("rare.y.net", "allow"), ("new.y.net", "allow")}


# --- language model ---


def lower_words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


@pytest.fixture(scope="module")
def two_tongues(spark):
    rng = random.Random(12)
    words = {t: [f"{t}{rng.choice('aeiou')}{rng.randrange(60)}{e}" for _ in range(90)] for t, e in (("lo", "um"), ("ka", "ish"))}
    rows = []
    for i in range(300):
        tongue = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[tongue]) for _ in range(rng.randrange(5, 120)))))
    rows += [(900, None), (901, ""), (902, "UNSEEN wörds only"), (903, "x " * 3000), (904, "Él É")]
    return rows


def test_language_model(spark, two_tongues):
    docs = spark.createDataFrame([(t, i, 1.0) for i, t in two_tongues], "text string, doc_id long, score double").repartition(3)
    got = {r.doc_id: r for r in gru_lm.score_documents(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in two_tongues}
    counts = Counter()
    for i, t in two_tongues:
        if not held[i]:
            counts.update([*lower_words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in two_tongues:
        tokens = [*lower_words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and math.isfinite(got[i].score) and got[i].score < 0
    assert gru_lm.score_documents(docs.limit(0)).count() == 0


def test_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(13)
    w = gru_lm.initial(rng.integers(1, 50, gru_lm.HEAD).astype(float), rng.integers(0, 9, gru_lm.TAILS).astype(float))
    docs = [np.array([1 + (3 * i + j) % 7 for j in range(40)], np.int32) for i in range(200)]
    before = gru_lm.run(w, docs).sum()
    adam = gru_lm.Adam(w)
    for _ in range(30):
        gru_lm.run(w, docs, adam)
    after = gru_lm.run(w, docs)
    assert after.sum() > 0.5 * before
    # every next token's probability, summed over all targets, is one
    start = np.array([5, 6, 7], np.int32)
    alone = gru_lm.run(w, [start])[0]
    window = gru_lm.Window(w, np.array([[0]], np.int32), [np.array([0])], np.zeros((1, gru_lm.STATE), np.float32))
    every = [window.loss(np.array([[t]]), np.array([[True]]), False)[0, 0] for t in range(gru_lm.HEAD + gru_lm.TAILS)]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    # lanes and windows do not change a document's score
    assert gru_lm.run(w, [docs[0], start, docs[1]], count=2)[1] == pytest.approx(alone, rel=1e-4)


def test_gradients_are_right():
    rng = np.random.default_rng(14)
    w = gru_lm.initial(rng.integers(1, 50, gru_lm.HEAD).astype(float), rng.integers(1, 9, gru_lm.TAILS).astype(float))
    w = {k: (x + rng.standard_normal(x.shape) * 0.2 * (np.abs(x) < 1e8)).astype(np.float64) for k, x in w.items()}
    inputs, targets = rng.integers(0, gru_lm.HEAD + gru_lm.TAILS, (4, 3)), rng.integers(0, gru_lm.HEAD + gru_lm.TAILS, (4, 3))
    there, fresh = np.ones((4, 3), bool), [np.array([0]), np.array([], int), np.array([1, 2]), np.array([], int)]

    def loss():
        return -gru_lm.Window(w, inputs, fresh, np.full((3, gru_lm.STATE), 0.1, np.float32)).loss(targets, there, False).sum()

    window = gru_lm.Window(w, inputs, fresh, np.full((3, gru_lm.STATE), 0.1, np.float32))
    window.loss(targets, there, True)
    for name, g in window.backward().items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        value, step = w[name][at], 2e-2
        w[name][at] = value + step
        up = loss()
        w[name][at] = value - step
        down = loss()
        w[name][at] = value
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=2e-3), name


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    """Each stage against its own brute force on what its predecessor kept."""
    import public_tokenizers
    import tiktoken
    from test_text_operators import brute_groups, brute_repetition, brute_targets

    import corpus_pipeline
    from clonal_spark.llm import bpe, mixing, repetition

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def step(name, before):
        out = stages[name](spark, before, sf)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = step("quality_rules", docs)
    want = set()
    for i, r in texts.items():
        m = brute_repetition(r.text)
        bad = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or 100 * m["dup_line_chars"] > repetition.LINE_LIMIT * m["word_chars"]
        if not bad and all(100 * m[f"dup_chars_{n}"] <= most * m["word_chars"] for n, most in repetition.NGRAM_LIMITS.items()):
            want.add(i)
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    two = step("near_dedup", one)
    want = {i for i, (_, c) in brute_groups({i: texts[i].text for i in want}).items() if c == i}
    assert {r.doc_id for r in two.collect()} == want and two.columns == docs.columns
    three = step("substring_dedup", two)
    cut = {r.doc_id: r for r in three.collect()}
    for i, left in zip(sorted(want), brute_left([texts[i].text for i in sorted(want)]), strict=True):
        assert cut[i].text == left.decode("utf-8", "ignore") and cut[i].n_chars == len(cut[i].text)
    assert three.columns == docs.columns
    four = step("mixing", three)
    sizes, taken = Counter(), Counter()
    for r in cut.values():
        sizes[r.source] += len(WORD.findall(r.text))
    for r in four.collect():
        taken[r.source] += len(WORD.findall(r.text))
        assert r.text == cut[r.doc_id].text
    target = brute_targets(dict(sizes), {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))})
    longest = max(len(WORD.findall(r.text)) for r in cut.values())
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1 for s in sizes) and four.columns == docs.columns
    five = step("bpe", four)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert five.count() == four.count()
    for r in five.dropDuplicates().collect():
        assert r.n_tokens == len(known.encode_ordinary(cut[r.doc_id].text)) and r.decoded_sha256 == hashlib.sha256(cut[r.doc_id].text.encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, five.collect()))


def test_weights_are_averaged_by_tokens(spark, monkeypatch):
    """In shares of tasks and at once, with the same mean."""
    rng = np.random.default_rng(4)
    weights = {(c, t): rng.normal(size=8).astype(np.float32) for c in range(2) for t in range(23)}
    rows = [(c, t, 100 + 7 * t, w.tobytes()) for (c, t), w in weights.items()]
    for shares in (1, 4, 1024):
        monkeypatch.setattr(gru_lm, "SHARES", shares)
        got = {r.chunk: np.frombuffer(bytes(r.weights), np.float32) for r in gru_lm.averaged(spark.createDataFrame(rows, gru_lm.AVERAGED).repartition(3)).collect()}
        for c in range(2):
            assert got[c] == pytest.approx(np.average([weights[c, t] for t in range(23)], axis=0, weights=[100 + 7 * t for t in range(23)]), abs=1e-6)
