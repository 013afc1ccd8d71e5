"""Multiple-instance toxicity: sentences, noisy-or and gradient against plain forms, held-out accuracy, hard rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from clonal_spark.llm import _text, toxicity
from clonal_spark.session import Scratch

BAD = ["grumpf", "snarlo", "vexorim"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 6))) + rng.choice(["", "", "", "."]) for _ in range(n)) + "."


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, toxic = prose(rng, rng.randint(5, 80)), int(rng.random() < 0.3)
        if toxic:
            words = text.split(" ")
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "en", "isch"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, 1, toxic))
    return rows, labels


def plain_sentences(text):
    """(start, end) in bytes."""
    raw, cuts = text.encode(), [0]
    for m in re.finditer(rb"[.!?](?=[\x20\x09-\x0d])|\n", raw):
        if m.end() < len(raw):
            cuts.append(m.end())
    cuts = sorted(set(cuts))
    return list(zip(cuts, [*cuts[1:], len(raw)], strict=True))


def plain_features(raw):
    out = set()
    for word in re.findall(rb"[A-Za-z0-9\x80-\xff]+", raw):
        word = word.lower() if word.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        for n in (None, *toxicity.PREFIXES):
            if n is None or len(word) > n:
                out.add((n, word[:n]))
    return out


def hashed(feature):
    n, word = feature
    data = np.frombuffer(word, np.uint8)
    h = int(_text.ranges_hash(data, np.array([0]), np.array([len(data)]), toxicity._VALUE)[0])
    return h ^ (0 if n is None else int(toxicity._SALTS[1 + toxicity.PREFIXES.index(n)]))


TEXTS = ["", "One. Two words! Three? yes", "a.b c.\nd\n\ne", "x", ".", "...", " . ", "Grumpf grumpfen. fine.", "\n", "no end", "é à. Ünd? ok.", "trailing. ", "Grumpfisch", "", "v3.14 is. 2."]


def test_sentences_and_features():
    for seed in range(40):
        texts = random.Random(seed).choices(TEXTS, k=9)
        slab = next(_text.slabs(pa.array(texts)))
        starts, first = toxicity.sentence_starts(slab.data, slab.offsets)
        ends = np.append(starts[1:], len(slab.data))
        for i, text in enumerate(texts):
            of = slab.offsets[i]
            assert [(a - of, b - of) for a, b in zip(starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist(), strict=True)] == plain_sentences(text)
        hashes, at = toxicity.features(_text.LOWER[slab.data], slab.offsets)
        doc = np.searchsorted(slab.offsets, at, "right") - 1
        for i, text in enumerate(texts):
            assert set(hashes[doc == i].tolist()) == {hashed(f) for f in plain_features(text.encode())}


def test_gradient():
    rng = np.random.default_rng(1)
    label, plain, per_doc = np.array([1, 0, 1, 0]), np.array([3, 2, 0, 1]), np.array([2, 1, 1, 0])
    sizes = np.array([1, 2, 1, 3])
    feats = rng.integers(0, 4, sizes.sum())
    w = np.append(rng.normal(size=4), -2.0)

    def likelihood(w):
        total, k, at = 0.0, 0, 0
        for y, n0, m in zip(label, plain, per_doc, strict=True):
            none = (1 - 1 / (1 + math.exp(-w[-1]))) ** n0
            for s in sizes[k : k + m]:
                none *= 1 - 1 / (1 + math.exp(-(w[-1] + w[feats[at : at + s]].sum())))
                at += s
            k += m
            total += math.log(1 - none if y else none)
        return total

    g, ll = toxicity.gradient(w, label, plain, per_doc, sizes, feats)
    assert ll == pytest.approx(likelihood(w))
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        assert g[i] == pytest.approx((likelihood(w + step) - likelihood(w - step)) / 2e-6, rel=1e-4, abs=1e-7)


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus(1500)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.where(~toxicity.is_held_out()), marks, Scratch(spark, "test-toxicity"))
    return rows, labels, docs, marks, model


def test_held_out_accuracy(fitted):
    rows, labels, docs, marks, model = fitted
    assert all(b > a - 1e-3 for a, b in zip(model.trace[-6:], model.trace[-5:], strict=False)) and model.trace[-1] > model.trace[0]
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    out = [(truth[i], r.predicted) for i, r in got.items() if r.held_out]
    assert np.mean([p for t, p in out if t]) > 0.95 and np.mean([p for t, p in out if not t]) < 0.02


def test_scores_by_plain_form(spark, fitted):
    *_, model = fitted
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=False))
    texts = [*TEXTS, None, "Grumpf. Snarlo! vexorim?", "a. " * 300 + "snarlo b."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    spans = {}
    for r in toxicity.locate(docs, model).collect():
        spans.setdefault(r.doc_id, set()).add((r.start, r.end))
    for r in toxicity.score(docs, model).collect():
        raw = (texts[r.doc_id] or "").encode()
        cut = plain_sentences(texts[r.doc_id] or "")
        p = [1 / (1 + math.exp(-(model.weights[-1] + sum(weights.get(hashed(f), 0.0) for f in plain_features(raw[a:b]))))) for a, b in cut]
        assert r.score == pytest.approx(1 - math.prod(1 - x for x in p), abs=1e-12) and r.n_sentences == len(cut)
        assert spans.get(r.doc_id, set()) == {s for s, x in zip(cut, p, strict=True) if x >= 0.5} and r.n_offending == len(spans.get(r.doc_id, ()))
        assert r.worst_score == pytest.approx(max(p)) and p[cut.index((r.worst_start, r.worst_end))] == pytest.approx(max(p))
    assert sum(map(len, spans.values())) >= 6


def test_hard_rows(spark):
    kind = "text string, doc_id long, score double, label string, id string"
    empty = spark.createDataFrame([], kind)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, None), (3, 0, 1), (None, 0, 1), (3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(empty, labels).count() == 0
    rows = [(None, 1, 0.5, "x", "y"), ("", None, None, None, None), ("grumpf all", 3, 1.0, "a", "b"), ("grumpf all", 3, 1.0, "a", "b"), ("fine text." + " fine text." * 49_999, 4, 0.0, "", ""), ("a", 2, 0.0, "", "")]
    got = toxicity.score_documents(spark.createDataFrame(rows, kind), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 3), (False, 4), (True, None)]
    assert all(0 <= r.score <= 1 for r in got) and {r.n_sentences for r in got if r.doc_id == 4} == {50_000}
    none = toxicity.score_documents(spark.createDataFrame(rows, kind), labels.where("toxic = 0")).collect()
    assert {round(r.worst_score, 9) for r in none} == {toxicity.PRIOR}


def test_sample_of_labels(spark, fitted, monkeypatch):
    """More labelled rows than the bound: a part of them is learnt from, by their ids, and every row is scored."""
    rows, labels, docs, marks, _ = fitted
    monkeypatch.setattr(toxicity, "SAMPLE", 700)
    scratch = Scratch(spark, "test-toxicity-sample")
    model = toxicity.train(docs, marks, scratch)
    taught = spark.read.parquet(scratch.path("labelled")).count()
    assert 600 < taught < 800
    truth = {i: t for i, _, t in labels}
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.97
