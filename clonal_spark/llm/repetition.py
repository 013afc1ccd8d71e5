"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths, in numpy, mark the characters that stand inside duplicated
n-grams and duplicated lines. Hashes have 64 bits, so equal hashes are taken as equal words or lines.

Defined results: a null or empty text has no words, fails the base rules and is not kept; rows with
the same doc_id are judged on their own; columns besides doc_id and the text are ignored.
A document of any length is judged whole, in memory proportional to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clonal_spark.llm import _text

#: n-gram lengths in words, and the largest share (per cent) of word characters inside duplicated n-grams.
NGRAM_LIMITS = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}
#: The largest share (per cent) of word characters in lines that occur more than once.
LINE_LIMIT = 30

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_LEADS = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_LIMITS)]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(again, keys)
    at[at == len(again)] = 0
    return again[at] == keys


def _spread(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words that a window of n words starting at starts covers."""
    edge = np.zeros(total + 1, np.int64)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES of each document of a slab."""
    w = _text.words(data, offsets)
    n_docs, n_words = len(offsets) - 1, len(w.starts)
    doc = np.repeat(np.arange(n_docs), np.diff(w.offsets))
    own = _text.mix(doc.astype(np.uint64) + np.uint64(1))  # makes equal hashes of other documents differ
    chars = _text.segment_sum(_LEADS[data], w.starts, w.ends)
    out = {"n_words": np.diff(w.offsets), "word_chars": _text.segment_sum(chars, w.offsets[:-1], w.offsets[1:]), "n_symbols": _text.segment_sum(_SYMBOL[data], offsets[:-1], offsets[1:])}

    stop = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], stop + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    end = np.where(data[end - 1] == 0x0A, end - 1, end) if len(end) else end
    first, last = np.searchsorted(w.starts, begin), np.searchsorted(w.starts, end)
    full = last > first
    begin, end, first, last = begin[full], end[full], first[full], last[full]
    line_doc = doc[first]
    keys = _text.ranges_hash(data, begin, end, _text._VALUE) ^ own[first]
    twice = _twice(keys)
    rows = np.flatnonzero(twice)
    _, once = np.unique(keys[rows], return_index=True)
    later = np.ones(len(rows), bool)
    later[once] = False
    out["n_dup_lines"] = np.bincount(line_doc[rows[later]], minlength=n_docs)
    line_chars = _text.segment_sum(chars, first, last)
    out["dup_line_chars"] = np.bincount(line_doc[rows], line_chars[rows], minlength=n_docs).astype(np.int64)

    rolled = np.zeros(n_words, np.uint64)
    ends_at = w.offsets[1:][doc] if n_words else np.zeros(0, np.int64)
    where = np.arange(n_words)
    for n in range(1, max(NGRAM_LIMITS) + 1):
        grown = n_words - n + 1
        if grown > 0:
            rolled = rolled[:grown] + w.hashes[n - 1 :] * np.uint64(pow(0xC2B2AE3D27D4EB4F, n - 1, 1 << 64))
        if n not in NGRAM_LIMITS:
            continue
        if grown > 0:
            at = where[:grown][where[:grown] + n <= ends_at[:grown]]
            covered = _spread(at[_twice(_text.mix(rolled[at]) ^ own[at])], n, n_words)
        else:
            covered = np.zeros(n_words, bool)
        out[f"dup_chars_{n}"] = _text.segment_sum(np.where(covered, chars, 0), w.offsets[:-1], w.offsets[1:])
        if n == 5:
            out["n_repeat_words"] = _text.segment_sum(covered.astype(np.int64), w.offsets[:-1], w.offsets[1:])
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    kept = ~failed & (100 * m["dup_line_chars"] <= LINE_LIMIT * m["word_chars"])
    for n, most in NGRAM_LIMITS.items():
        kept &= 100 * m[f"dup_chars_{n}"] <= most * m["word_chars"]
    return failed, kept


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [measure(s.data, s.offsets) for s in _text.slabs(batch.column(1))]
        m = {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in MEASURES}
        failed, kept = verdicts(m)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in MEASURES), pa.array(failed), pa.array(kept)], names=["doc_id", *MEASURES, "base_failed", "kept"])


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: MEASURES, base_failed and kept. A map over the scan; nothing is shuffled."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in MEASURES) + ", base_failed boolean, kept boolean"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_judged, schema)


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns and rows. The verdict is made beside each row, so nothing is joined."""
    names = docs.columns
    at = names.index(text_col)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s in _text.slabs(batch.column(at)):
                keep.append(verdicts(measure(s.data, s.offsets))[1])
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
        _text.release()

    return docs.mapInArrow(filtered, docs.schema)
