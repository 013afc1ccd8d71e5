"""Nulls, empty tables, repeated rows, clashing columns, ties and long texts for all operators and every stage."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from test_corpus_operators import brute_nearest
from test_text_operators import WORD, brute_groups

import corpus_pipeline
from clonal_spark.llm import bpe, gru_lm, host_reputation, minhash, mixing, projection_search, repetition

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Columns of documents, and some whose names the operators use within.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, gone_doc_id long, taken int, kept boolean, row_key string, words string"


def some_docs(spark, extra=True):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one, two, long = text(120), text(90), text(400_000)
    texts = [(1, one), (2, one), (2, one), (3, two), (3, two + " more"), (4, None), (5, ""), (None, text(40)), (None, None), (6, long), (7, text(60)), (8, text(60).upper()), (9, " \n ")]
    rows = [(i, t, "en", None if i == 7 else "ab"[(i or 0) % 2], None if t is None else len(t), 1, 2, False, "clash", "clash") for i, t in texts]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame if extra else frame.select("doc_id", "text", "lang", "source", "n_chars")


def test_double_vectors_are_scored_as_doubles(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(12)
    # differences below a float's precision decide the order
    rows = [(i, (base + 1e-9 * rng.standard_normal(12) * (i + 1)).tolist()) for i in range(40)] + [(40 + i, rng.standard_normal(12).tolist()) for i in range(60)]
    got = {}
    for r in projection_search.search(spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, vector string"), "vec_id % 50 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        for _, v, score in found:
            a, b = vectors[q], vectors[v]
            assert score == pytest.approx(float(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), abs=1e-15)
    assert set(got) == {0, 50} and [v for _, v, _ in sorted(got[50])] == [v for v, _ in brute_nearest([(i, [float(x) for x in v]) for i, v in rows], 5, lambda i: i == 50)[50]]


def test_repeated_rows_of_near_dedup(spark):
    docs = some_docs(spark)
    got = minhash.groups(docs).collect()
    assert len(got) == docs.count()
    distinct = {i: t for i, t in [(r.doc_id, r.text) for r in docs.collect()] if i is not None and i not in (3,)}
    want = brute_groups(distinct)
    for r in got:
        if r.doc_id in want:
            assert (r.n_shingles, r.component_id, r.kept) == (want[r.doc_id][0], want[r.doc_id][1], want[r.doc_id][1] == r.doc_id)
        elif r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert r.component_id == 3 and r.kept
    left = minhash.apply(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [1, 3, 3, 4, 5, 6, 7, 8, 9]


def test_repeated_rows_of_text_operators(spark):
    docs = some_docs(spark)
    n = docs.count()
    rules = repetition.repetition_coverage(docs).collect()
    assert len(rules) == n and {r.n_words for r in rules if r.doc_id == 6} == {400_000} and {r.n_words for r in rules if r.doc_id in (4, 5, 9)} == {0}
    mixed = mixing.mixture(docs).collect()
    assert len(mixed) == n and sorted(map(tuple, mixed), key=str) == sorted(map(tuple, mixing.mixture(docs.repartition(5)).collect()), key=str)
    assert all(0 <= r.taken <= 3 * r["size"] for r in mixed)
    coded = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(hashlib.sha256((r.text or "").encode()).hexdigest())
    for r in coded:
        assert r.decoded_sha256 in texts[r.doc_id]
    assert len(coded) == n


def test_repeated_rows_of_the_model(spark):
    docs = some_docs(spark)
    got = gru_lm.score_documents(docs).collect()
    assert len(got) == docs.count() and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert sorted(r.n_tokens for r in got if r.doc_id in (4, 5, 6, 9)) == [1, 1, 1, 400_001]
    same = [r for r in got if r.doc_id == 2]
    assert len(same) == 2 and same[0].base_score == pytest.approx(same[1].base_score) and same[0].score == pytest.approx(same[1].score, rel=1e-3)


def test_hosts_of_repeated_and_null_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "http://a.org/x", "x"), (2, "x" * 3_000_000, "x"), (3, "HTTP://B.com/de/?", "x")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 0, None), (1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = host_reputation.judge(pages, labels).collect()
    assert {(r.page_id, r.host, r.path) for r in got} == {(1, "", ""), (None, "a.org", "/x"), (2, "", ""), (3, "b.com", "/de/")}


@pytest.mark.parametrize("extra", [False, True])
def test_every_stage_on_hard_rows(spark, extra, tmp_path):
    """Columns stay, nulls and repeated rows have their defined results, and an empty table stays one."""
    docs, empty = some_docs(spark, extra), some_docs(spark, extra).limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, nothing = stage(spark, docs, ""), stage(spark, empty, "")
        last = k + 1 == len(corpus_pipeline.STAGES)
        assert nothing.count() == 0 and (last or nothing.columns == docs.columns), name
        path = str(tmp_path / f"{extra}{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert last or [f.name for f in docs.schema] == [f.name for f in empty.schema]
        empty = docs.limit(0)
    kept = {r.doc_id for r in docs.collect()}
    assert kept <= {1, 3, 6, 7, 8, None} and 1 in kept


def test_pipeline_of_an_empty_table(spark, tmp_path):
    some_docs(spark, False).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_pattern_is_the_contracts():
    assert WORD.findall("a\x0bb\x85c d") == ["a", "b\x85c", "d"]
