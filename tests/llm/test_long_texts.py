"""Very long words and texts in bounded memory and time, and scores by one token after the other."""

import math
import random
import resource
import subprocess
import sys
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from clonal_spark.llm import bpe, gru_lm

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def naive(w, ids):
    """Log-probability of a document and its end, by a plain forward pass in double precision."""
    s = gru_lm.STATE
    w = {k: x.astype(np.float64) for k, x in w.items()}
    h, total, token = np.zeros(s), 0.0, 0
    for target in [*ids.tolist(), 0]:
        gx, gh = w["embed"][token] @ w["wx"] + w["b"], h @ w["wh"]
        z, r = (1 / (1 + np.exp(-(gx[i * s : (i + 1) * s] + gh[i * s : (i + 1) * s]))) for i in (0, 1))
        n = np.tanh(gx[2 * s :] + r * gh[2 * s :])
        h = z * h + (1 - z) * n
        scores = h @ w["wc"] + w["bc"]
        c = target // gru_lm.SLOTS if target < gru_lm.HEAD else target - gru_lm.HEAD + gru_lm.HEAD_CLASSES
        total += scores[c] - math.log(np.exp(scores).sum())
        if target < gru_lm.HEAD:
            slots = h @ w["wo"][c] + w["bo"][c]
            total += slots[target % gru_lm.SLOTS] - math.log(np.exp(slots).sum())
        token = target
    return total


def weights(rng):
    w = gru_lm.initial(rng.integers(1, 50, gru_lm.HEAD).astype(float), rng.integers(1, 9, gru_lm.TAILS).astype(float))
    return {k: x + rng.normal(0, 0.2, x.shape).astype(np.float32) for k, x in w.items()}


@pytest.mark.parametrize("count", [1, 3, 512])
def test_scores_token_by_token(count):
    rng = np.random.default_rng(21)
    w = weights(rng)
    docs = [rng.integers(1, gru_lm.HEAD + gru_lm.TAILS, n).astype(np.int32) for n in (0, 1, 15, 16, 17, 40, 0, 333)]
    assert gru_lm.run(w, docs, count=count) == pytest.approx([naive(w, d) for d in docs], rel=1e-4, abs=1e-3)
    assert len(gru_lm.run(w, [])) == 0


def test_one_long_document_among_short_ones():
    """Memory goes with all tokens, not with the longest text times the lanes."""
    code = """
import resource, numpy as np
from clonal_spark.llm import gru_lm
rng = np.random.default_rng(1)
w = gru_lm.initial(rng.integers(1, 50, gru_lm.HEAD).astype(float), rng.integers(1, 9, gru_lm.TAILS).astype(float))
docs = [rng.integers(1, 500, n).astype(np.int32) for n in [1_000_000] + [20] * 600]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = gru_lm.run(w, docs)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, np.isfinite(out).all())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(done[0]) < 400 and done[1] == "True"


@pytest.fixture(scope="module")
def both():
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(FILE), special_tokens={})
    return bpe.Bpe(FILE, public_tokenizers.PATTERN), known


def test_stitched_words(both):
    own, known = both
    rng = random.Random(31)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ab", "aaab", "theinganderion", "x", "é日ü", "lololololol"]
    words = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1025, 4000))) for _ in range(60)]
    words += ["x" * n for n in (1025, 2047, 5000)] + ["abc" * 700, "the" * 900, "thethe" + "hello" * 501, "a" * 1500 + "b" * 1500]
    ids, n = own.words([w.encode() for w in words] + [b"short"])
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [w[:40] for w, g in zip(words, got, strict=False) if g != known._encode_single_piece(w)] == [] and got[-1] == known._encode_single_piece("short")


def test_a_word_of_a_megabyte(both):
    own, known = both
    word = "".join(random.Random(32).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=1 << 20))
    began = time.time()
    ids, _ = own.words([word.encode()])
    assert time.time() - began < 120 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 3_000_000
    # token by token, every two neighbours are the encoding of their joined bytes, and the bytes are the word's
    assert b"".join(own.token[i] for i in ids.tolist()) == word.encode()
    assert ids[:2000].tolist() == known._encode_single_piece(word[:8000])[:2000]
