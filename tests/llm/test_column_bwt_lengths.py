"""Repeated strings of several lengths at once against brute force, repeated rows and clashing columns."""

import random

import pytest
from test_corpus_operators import brute_covered, brute_repeats, some_text

from clonal_spark.llm import column_bwt

SHORT = column_bwt.PASSAGE


def mixed_texts(seed, n=60):
    """Texts that share strings of every length about SHORT and LENGTH, some of them at an end, some within periods."""
    rng = random.Random(seed)
    shared = [some_text(m, 100 * seed + m) for m in (SHORT - 1, SHORT, SHORT + 1, 300, 399, 400, 401, 700)]
    out = ["ab" * 350, "ab" * 150, "x" * 250, "", None, shared[1], shared[5]]
    for i in range(n):
        parts = [some_text(rng.randrange(0, 300), 1000 * seed + i)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            cut = rng.randrange(len(s))
            parts += [s if rng.random() < 0.6 else s[cut:], some_text(rng.randrange(0, 200), rng.randrange(10**6))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_two_lengths(spark, seed):
    texts = mixed_texts(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in column_bwt.removals(docs, passages=SHORT).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == dict(enumerate(brute_repeats(texts)))
    assert {i: r.n_passage_bytes for i, r in got.items()} == {i: c[1] for i, c in enumerate(brute_covered(texts, SHORT))}
    assert len({r.n_removed for r in got.values()}) > 3


def test_cut_at_a_shorter_length(spark):
    texts = mixed_texts(3)
    docs = spark.createDataFrame([(i, t, "clash", 1, None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, spans string, others int, n_chars int")
    got = {r.doc_id: r for r in column_bwt.apply(docs, n_chars_col="n_chars", length=SHORT).collect()}
    for i, (t, c) in enumerate(zip(texts, brute_covered(texts, SHORT), strict=True)):
        want = None if t is None else c[3].decode()
        assert (got[i].text, got[i].spans, got[i].others, got[i].n_chars) == (want, "clash", 1, None if t is None else len(want))


def test_many_repeated_rows(spark):
    """Rows of equal id and text: spans are one list for them, not one a row."""
    text = some_text(1500, 9)
    docs = spark.createDataFrame([(7, text)] * 400 + [(8, some_text(900, 10))], "doc_id long, text string").repartition(4)
    got = column_bwt.removals(docs, passages=SHORT).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans, r.n_passage_bytes) for r in got) == [(7, 1500, 1, 1500)] * 400 + [(8, 0, 0, 0)]


def test_long_text(spark):
    """A text of more than a slab, which repeats a stretch of its own."""
    stretch = some_text(600, 11)
    text = some_text(1_300_000, 12) + stretch + some_text(1_300_000, 13) + stretch
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in column_bwt.removals(docs, passages=SHORT).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans, got[1].n_passage_bytes) == (len(text), 1200, 2, 1200) and got[2].n_removed == 0


@pytest.mark.parametrize("most", [1, 5])
def test_hot_anchors_are_parted(spark, monkeypatch, most):
    """The same result where anchors of more than a few fragments are parted by the starts of their windows."""
    monkeypatch.setattr(column_bwt, "SPLIT", most)
    passage = some_text(520, 77)
    rng = random.Random(78)
    texts = [some_text(rng.randrange(0, 200), 80 + i) + passage[rng.choice([0, 0, 30, 140]) : rng.choice([520, 520, 410, 330])] + some_text(rng.randrange(0, 200), 200 + i) for i in range(40)]
    texts += mixed_texts(4, 25) + [passage, passage, "p" + passage, "ab" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in column_bwt.removals(docs, passages=SHORT).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == dict(enumerate(brute_repeats(texts)))
    assert {i: r.n_passage_bytes for i, r in got.items()} == {i: c[1] for i, c in enumerate(brute_covered(texts, SHORT))}
    cut = {r.doc_id: r.text for r in column_bwt.apply(docs, length=300).collect()}
    assert cut == {i: None if t is None else c[3].decode() for i, (t, c) in enumerate(zip(texts, brute_covered(texts, 300), strict=True))}
