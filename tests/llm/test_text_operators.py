"""Text operators against brute force, on a fixture of hard cases and on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from clonal_spark.llm import bpe, minhash, mixing, repetition, token_store
from clonal_spark.session import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = " ".join(f"word{i}" for i in range(40))
TEXTS = [
    None,
    "",
    " ",
    "  \n x",
    "one",
    "a b c d",
    "A B C D",
    SENTENCE,
    SENTENCE.upper(),
    SENTENCE + " more",
    SENTENCE.replace("word20", "other"),
    " ".join(["la"] * 60),
    "line one two\n" * 9,
    "éà ü | $5 & <b>#</b> ***\r\nnext\x0bline\x0cpage",
    "a\0b c \0",
    "it's  done \t now\n\n  z <|endoftext|> ",
    "x" * 5000,
    "=-" * 3000,
    SENTENCE + "\n" + "tail " * 4000,
    "the end.\n" + SENTENCE,
]
SCHEMA = "text string, note string, doc_id long, source string, taken int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(t, "n", i, ["a", None, "b"][i % 3], 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    tokenizer.encode_special_tokens = True
    scratch = Scratch(spark, "test")
    token_store.write_store(docs, scratch, file)
    rows, lists, start = by_id(token_store.read_digests(spark, scratch)), by_id(token_store.documents_of(spark, scratch)), 0
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(raw))
        assert lists[i].ids == ids and lists[i].start == start
        start += len(ids)
    assert sum(r.n_docs for r in spark.read.parquet(scratch.path("manifest")).collect()) == len(TEXTS)
    scratch = Scratch(spark, "test")
    token_store.write_store(empty, scratch, file)
    assert token_store.read_digests(spark, scratch).count() == 0


def test_token_store_detects_damage(spark, docs):
    scratch, other = Scratch(spark, "test"), Scratch(spark, "test")
    file = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(docs, scratch, file)
    token_store.write_store(docs.where("doc_id < 8"), other, file)
    spark.read.parquet(scratch.path("recipes")).write.mode("overwrite").parquet(other.path("recipes"))
    with pytest.raises(Exception, match="does not give its root"):
        token_store.read_digests(spark, other).collect()


def test_cuts_follow_content():
    import numpy as np

    ids = np.random.default_rng(1).integers(0, 50000, 20000).astype(np.uint32)
    a, b = (token_store.cuts(token_store.marks(x), 0, len(x)) for x in (ids, ids[100:]))
    assert a[-1] == 20000 and all(x < y for x, y in zip(a, a[1:]))
    assert len({x - 100 for x in a} & set(b)) > 0.8 * len(a)


def test_bpe(docs, empty):
    import tiktoken

    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file), special_tokens={})
    rows = by_id(bpe.encode_decode(docs, file, public_tokenizers.PATTERN, with_ids=True))
    for i, text in enumerate(TEXTS):
        ids = known.encode_ordinary(text or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, file, public_tokenizers.PATTERN).count() == 0


def slab_of(texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_encoders_on_odd_texts():
    """Every way of cutting must leave ids as the libraries give them."""
    import random

    import numpy as np
    import tiktoken
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file), special_tokens={})
    own, encoder = bpe.Bpe(file, public_tokenizers.PATTERN), token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "..", "'s", "'", "a", "B", "é", "\u0301", "7", "½", "_", "\xa0", "\u2003", "\u3000", "“", "foo", "\0", "\x1c", "\x85", "日", "😀", " x", "<|endoftext|>", "\x7f"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(0, 14))) for _ in range(4000)]
    ids, n, raw, _ = own.encode(*slab_of(texts))
    want = [known.encode_ordinary(t) for t in texts]
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == [] and bytes(raw) == "".join(texts).encode()
    ids, n = encoder.encode(*slab_of(texts))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])], want, strict=True) if a != b] == []


def test_bpe_forgets_and_keeps_right(monkeypatch):
    import tiktoken

    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 40)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file), special_tokens={})
    own = bpe.Bpe(file, public_tokenizers.PATTERN)
    for round_ in range(6):
        texts = [f"common words, then {round_}x{i} rare{i * round_}." for i in range(30)]
        ids, n, raw, _ = own.encode(*slab_of(texts))
        assert ids.tolist() == [i for t in texts for i in known.encode_ordinary(t)]
        assert bytes(raw) == "".join(texts).encode()


def brute_repetition(text):
    words = WORD.findall(text or "")
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text or ""))}
    lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
    out["n_dup_lines"] = sum(lines.values()) - len(lines)
    out["dup_line_chars"] = sum(n * sum(map(len, WORD.findall(x))) for x, n in lines.items() if n > 1)
    for n in repetition.NGRAM_LIMITS:
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        covered = {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        out[f"dup_chars_{n}"] = sum(len(words[j]) for j in covered)
        if n == 5:
            out["n_repeat_words"] = len(covered)
    return out


def test_repetition(docs, empty):
    rows = by_id(repetition.repetition_coverage(docs))
    for i, text in enumerate(TEXTS):
        want = brute_repetition(text)
        assert {k: rows[i][k] for k in want} == want, i
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert rows[i].base_failed == failed and not (failed and rows[i].kept)
    kept = repetition.apply(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert repetition.repetition_coverage(empty).count() == 0 and repetition.apply(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = mixing.mixture(docs).collect()
    assert len(rows) == len(TEXTS)
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"] and r["size"] == len(WORD.findall(TEXTS[r.doc_id] or ""))
    assert abs(sum(x[0].target for x in by.values()) - total) < 1e-6
    for some in by.values():
        assert some[0].source_size == sum(x["size"] for x in some) and abs(sum(x.taken for x in some) - some[0].target) <= 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixture(docs.repartition(5)).collect()), key=str)
    assert mixing.mixture(empty).count() == 0
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns and mixing.apply(empty).count() == 0


def brute_targets(sizes, weights, most=3):
    """The literal loop: share by weight, cap what is above, share the excess again."""
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        weight = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else weights[s] * left / weight for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 7, "e": 400, "f": 90}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    rows = spark.createDataFrame([(s, n, i + 1, weights[s]) for i, (s, n) in enumerate(sorted(sizes.items()))], "source string, source_size long, position int, weight long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes, weights))


def brute_groups(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_minhash(docs, empty):
    rows = by_id(minhash.groups(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == brute_groups(dict(enumerate(TEXTS)))
    kept = minhash.apply(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert minhash.groups(empty).count() == 0


def test_minhash_chains_and_families(spark):
    """Near copies around a template, and chains whose ends are not alike."""
    import random

    random.seed(3)
    rows, base = {}, [f"w{random.randrange(10**6)}" for _ in range(120)]
    for i in range(60):
        words = list(base)
        for _ in range(random.randrange(0, 4)):
            words[random.randrange(120)] = f"x{random.randrange(10**6)}"
        rows[i] = " ".join(words)
    words = [f"c{random.randrange(10**6)}" for _ in range(100)]
    for i in range(60, 100):
        words = [*words[2:], f"c{random.randrange(10**6)}", f"c{random.randrange(10**6)}"]
        rows[i] = " ".join(words)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(df).collect()}
    assert got == brute_groups(rows)


def test_minhash_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(docs).collect()}
    assert got == brute_groups({r.doc_id: r.text for r in docs.collect()})
