"""Texts that hold the strings of added tokens, by the library's default, and vocabularies that need wide ids."""

import random
import zlib

import public_tokenizers
import pytest

from clonal_spark.llm import token_store
from clonal_spark.session import Scratch

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_by_default(spark):
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(FILE), random.Random(4)
    parts = ["<|endoftext|>", "<|endof", "text|>", " a", "b ", "  ", "\n", "it's", "<|endoftext|>", "é", "word" * 30]
    texts = [None, "", "<|endoftext|>", "a <|endoftext|> b", "<|endof", "text|> x", "plain text", *("".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(60)), "tail " * 500_000 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "test")
    token_store.write_store(docs, scratch, FILE, plain_added=False)
    rows = {r.doc_id: r for r in token_store.read_digests(spark, scratch).collect()}
    lists, start = {r.doc_id: r.ids for r in token_store.documents_of(spark, scratch).collect()}, 0
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert lists[i] == ids and (rows[i].start, rows[i].n_tokens) == (start, len(ids))
        assert rows[i].ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        start += len(ids)
    assert lists[3] == [64, 220, 50256, 275, 0]


def test_repeated_rows_keep_a_row_each(spark):
    docs = spark.createDataFrame([(5, "same words here")] * 6 + [(5, "other"), (None, "x"), (None, None)], "doc_id long, text string")
    scratch = Scratch(spark, "test")
    token_store.write_store(docs, scratch, FILE, plain_added=False)
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in token_store.read_digests(spark, scratch).collect())
    assert [r[2] for r in rows] == [None] * 2 + [5] * 7 and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_narrow_ids_need_a_small_vocabulary(spark, monkeypatch):
    class Large:
        def __init__(self, *_):
            self.bytes = [0] * 70_000

    monkeypatch.setattr(token_store, "Encoder", Large)
    monkeypatch.setattr(token_store, "_ENCODERS", {})
    with pytest.raises(ValueError, match="wide"):
        list(token_store._chunked("large", False, True)(iter([])))
