"""The event sweep against all pairs of tokens, over hard texts, small blocks and small slices."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from clonal_spark.llm import alignment

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def known():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    return a, b


def brute_tokens(known, text):
    """(id, start, end) of both sides, or two empty lists."""
    a, b = known
    if not text:
        return [], []
    whole = (" " + text).encode()
    chars = alignment._characters()
    sides = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    sides.append([(i, bytes(chars[c] for c in a.id_to_token(i))) for i in ids])
    ids = b.encode(text)
    sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids])
    out = []
    for side in sides:
        if b"".join(x for _, x in side) != whole:
            return [], []
        at, rows = 0, []
        for i, x in side:
            rows.append((i, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return out


def brute(known, texts):
    """Links by comparing ranges, groups by common ends."""
    docs, count = [], Counter()
    for text in texts:
        a, b = brute_tokens(known, text)
        links = []
        low = 0
        for i, x, y in a:
            while low < len(b) and b[low][2] <= x:
                low += 1
            k = low
            while k < len(b) and b[k][1] < y:
                links.append((i, b[k][0]))
                k += 1
        count.update(links)
        ends = sorted({y for *_, y in a} & {y for *_, y in b})
        groups, start = [], 0
        for end in ends:
            groups.append(([i for i, x, y in a if start <= x and y <= end], [i for i, x, y in b if start <= x and y <= end]) if len(ends) < 3000 else None)
            start = end
        docs.append((a, b, links, ends, groups))
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for a, b, links, ends, groups in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups) if None not in groups else None
        digest = None if text is None else hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(ends), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


HARD = [
    None, "", " ", "  ", "a", " a", "a ", "<s>", "</s> <unk>", "<|endoftext|>", "x <|endoftext|> y", "<0x41>", "\t\n\r", "é", "naïve café", "日本語テキスト", "😀 smile 😀😀", "▁", "a▁b", "ﬁne Å ½", " nbsp", "é",
    "The quick brown fox, jumps... over 12345 lazy dogs!", "aaaaaaaaaaaaaaaaaaaa", "    indented\n\n\ncode  here", "\x00nul", "\x7f\x80", "mixedCASE_and-snake", "ü" * 50, "  spaced   out  ", "word " * 40,
]


def prose(rng, n):
    return "".join(rng.choice(["the ", "an", "tion", "ing ", "über", "ß", " ", "\n", "7", ". ", "schön ", "é", "qu", "日", "\t"]) for _ in range(n))


def check(spark, known, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.align(docs, A_FILE, B_FILE).collect()
    want = brute(known, texts)
    mine = sorted((r.doc_id is not None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)
    assert len(got) == len(texts)
    expected = sorted((i is not None, i or 0, *w) for (i, _), w in zip(rows, want, strict=True))
    assert mine == expected


def test_hard_texts(spark, known):
    rng = random.Random(5)
    texts = HARD + [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    assert sum(x[0] > 0 for x in brute(known, texts)) > 70 and any(x and not brute_tokens(known, x)[0] for x in texts)
    check(spark, known, texts)


def test_ties_and_repeated_rows(spark, known):
    check(spark, known, ["same text", "same text", "same text", None, "other text", "x"], [7, 7, 8, None, None, 9])


def test_small_blocks_and_slices(spark, known, monkeypatch):
    """Documents over many blocks, steps and batches, and counts in several slices."""
    monkeypatch.setattr(alignment, "SLICE_PAIRS", 40)
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (3, 2000, 0, 1, 700, 1500)] + HARD[:6] + ["ü" * 400]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for block, held in ((5, 7), (1, 1), (64, 100)):
            events, machine = alignment._events, alignment._machine

            def small(make, block=block, held=held):
                def made(*args):
                    inner = make(*args)

                    def run(batches):
                        alignment.BLOCK, alignment.HELD = block, held
                        yield from inner(batches)
                        alignment.BLOCK, alignment.HELD = 4096, 200_000

                    return run

                return made

            monkeypatch.setattr(alignment, "_events", small(events))
            monkeypatch.setattr(alignment, "_machine", small(machine))
            check(spark, known, texts)
            monkeypatch.setattr(alignment, "_events", events)
            monkeypatch.setattr(alignment, "_machine", machine)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_text_in_parts(known):
    b = alignment.SentencePieces(B_FILE)
    rng = random.Random(2)
    text = prose(rng, 500) + "  " + "x" * 300 + "   y  " + prose(rng, 300)
    whole = known[1].encode(text)
    for long in (1, 10, 60):
        alignment.LONG = long
        try:
            parts = b.parts(text)
            assert len(parts) > 5 and [i for x in known[1].encode(parts) for i in x] == whole
        finally:
            alignment.LONG = 200_000


def test_groups(spark, known):
    rng = random.Random(4)
    texts = HARD + [prose(rng, 50) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {}
    for r in alignment.groups(docs, A_FILE, B_FILE).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.a, r.b))
    for i, text in enumerate(texts):
        a, b = brute_tokens(known, text)
        ends = sorted({y for *_, y in a} & {y for *_, y in b})
        want, start = [], 0
        for end in ends:
            want.append((start - 1, end - 1, [t for t, x, y in a if start <= x and y <= end], [t for t, x, y in b if start <= x and y <= end]))
            start = end
        assert sorted(got.get(i, [])) == want


def test_empty_table_and_clashing_columns(spark, known):
    kind = "ids string, text string, row_key int, doc_id long, side string, pairs string"
    assert alignment.align(spark.createDataFrame([], kind), A_FILE, B_FILE).count() == 0
    rows = [("a", "one two", 1, 5, "x", "y"), (None, None, None, None, None, None)]
    got = sorted(alignment.align(spark.createDataFrame(rows, kind), A_FILE, B_FILE).collect(), key=lambda r: r.n_a)
    assert [(r.doc_id, r.n_a, r.groups_sha256 == "") for r in got] == [(None, 0, True), (5, 2, False)]
