"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences. A sentence has a probability p = sigmoid(bias + sum of the weights of the features
that it holds), and the document's is the noisy-or 1 - prod(1 - p). Weights are learnt from the documents' labels only,
by the gradient of the bags' log-likelihood, so the fitted sentence scores say where a document offends.

Features are a word's hash and those of its first PREFIXES bytes (inflected and joined words share these). Which of them
count is chosen over the training rows: those that a share of CANDIDATE of the documents labelled 1 hold, and that
the likelihood ratio between the two labels marks with at least EVIDENCE; the FEATURES with the most evidence stay.
Candidates are at most the mean number of features of a document over CANDIDATE, whatever the corpus' size.

Training takes all labelled training rows up to SAMPLE of them, beyond that those whose id's hash falls below the bound that
leaves about SAMPLE. So the labels that meet the texts are broadcast with a known bound, and no text is shuffled. Bags are
written once as indexes of chosen features, and each of ITERATIONS steps is one job that sums gradients per partition and
feature before the shuffle; FEATURES + 1 sums reach the driver. Scoring covers every row.

Sentences end behind `.`, `!` or `?` that white space or the end follows, and at a line feed; words are runs of bytes that
are no ASCII white space, sign or punctuation, with A-Z lower-cased.

Defined results: a null or empty text is one empty sentence; rows with the same doc_id are documents of their own, and
each meets that id's label if its labels agree (a doc_id with both labels, or a null label, teaches nothing); a null
doc_id has no label; without training rows of both labels every sentence's score is the prior's."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.llm import _text
from clonal_spark.llm._pieces import Pieces
from clonal_spark.session import Scratch

PREFIXES = (4, 5, 6)
CANDIDATE, LEAST, EVIDENCE, FEATURES = 0.002, 3, 14.0, 4096
ITERATIONS, RATE, DECAY = 24, 0.5, 1e-4
#: Labelled rows that are learnt from: all up to this number, about this number of more.
SAMPLE = 200_000
#: Sentences of a bag without labels in sight: the score where nothing can be learnt.
PRIOR = 0.01

_APART = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])
_VALUE = np.where(_APART, np.uint64(0), _text._VALUE)
_WHITE = _text._SEPARATOR
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_SALTS = [np.uint64(0)] + [np.uint64((0xA0761D6478BD642F * n) & (2**64 - 1)) for n in PREFIXES]
#: Features of documents that a counting task holds before it sends them on.
HELD = 8_000_000


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sentence_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a slab's sentences, and the first sentence of each document; an empty document has one sentence."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        follows = np.append(_WHITE[data[1:]], True)
        cut[1:] = (_STOP[data] & follows) | (data == 0x0A)
    cut[offsets] = False
    inner = np.flatnonzero(cut[:n])
    starts = np.sort(np.concatenate([offsets[:-1], inner]), kind="stable")
    first = np.searchsorted(inner, offsets[:-1]) + np.arange(len(offsets) - 1)
    return starts, np.append(first, len(starts))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slab's features, and the byte at which the word of each starts."""
    apart = _APART[data]
    begins, stops = ~apart, ~apart
    begins[1:] &= apart[:-1]
    stops[:-1] &= apart[1:]
    some = offsets[:-1] < offsets[1:]  # a word never crosses documents
    begins[offsets[:-1][some]] = ~apart[offsets[:-1][some]]
    stops[offsets[1:][some] - 1] = ~apart[offsets[1:][some] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes, at = [_text.ranges_hash(data, starts, ends, _VALUE)], [starts]
    for n, salt in zip(PREFIXES, _SALTS[1:], strict=True):
        long = starts[ends - starts > n]
        hashes.append(_text.ranges_hash(data, long, long + n, _VALUE) ^ salt)
        at.append(long)
    return np.concatenate(hashes), np.concatenate(at)


def _slabs(text: pa.Array) -> Iterator[tuple[_text.Slab, np.ndarray]]:
    for slab in _text.slabs(text):
        yield slab, _text.LOWER[slab.data]


def _documents(held: list[np.ndarray]) -> pa.RecordBatch:
    """Documents per feature, summed before they are sent."""
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["feature", "n"])


def _positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each feature is."""
    held, size = [], 0
    for batch in batches:
        for slab, data in _slabs(batch.column(0)):
            hashes, at = features(data, slab.offsets)
            keys, which = np.unique(hashes, return_inverse=True)
            doc = np.searchsorted(slab.offsets, at, "right") - 1
            pairs = np.unique(which * np.int64(len(slab.offsets)) + doc)
            held.append(keys[pairs // len(slab.offsets)])
            size += len(pairs)
            if size >= HELD:
                yield _documents(held)
                held, size = [], 0
    if held:
        yield _documents(held)


_TABLES: dict[str, Pieces] = {}


def _table(name: str, keys) -> Pieces:
    """A worker's table of the broadcast hashes, built once."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Pieces()
        _TABLES[name].add(keys.value)
    return _TABLES[name]


def _found(table: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the table's features in a slab, and the bytes where their words start."""
    hashes, at = features(data, offsets)
    which = table.find(np.maximum(hashes, np.uint64(1)))
    there = which >= 0
    return which[there].astype(np.int64), at[there]


def _negative(name: str, keys):
    """The same for the broadcast candidates only: one row per task and candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(name, keys)
        n = np.zeros(table.count, np.int64)
        for batch in batches:
            for slab, data in _slabs(batch.column(0)):
                which, at = _found(table, data, slab.offsets)
                doc = np.searchsorted(slab.offsets, at, "right") - 1
                pairs = np.unique(which * len(slab.offsets) + doc)
                n += np.bincount(pairs // len(slab.offsets), minlength=len(n))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(table.hashes[met].view(np.int64)), pa.array(n[met])], names=["feature", "n"])

    return run


def _sentences(table: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of sentences, the first of each document, and (sentence, feature) pairs, each once."""
    starts, first = sentence_starts(data, offsets)
    which, at = _found(table, data, offsets)
    # Of the sentences that start at one byte, all but the last are empty.
    pairs = np.unique((np.searchsorted(starts, at, "right") - 1) * np.int64(max(table.count, 1)) + which)
    return starts, first, pairs // max(table.count, 1), pairs % max(table.count, 1)


def _bags(name: str, keys):
    """Per document: its label, how many sentences hold no feature, and the features of each of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(name, keys)
        for batch in batches:
            for slab, data in _slabs(batch.column(0)):
                starts, first, sentence, feature = _sentences(table, data, slab.offsets)
                docs = len(slab.offsets) - 1
                marked, sizes = np.unique(sentence, return_counts=True)
                by_doc = np.searchsorted(marked, first)
                total = np.concatenate([[0], np.cumsum(sizes)])
                plain = np.diff(first) - np.diff(by_doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1)[slab.first : slab.first + docs],
                        pa.array(plain),
                        pa.ListArray.from_arrays(pa.array(by_doc.astype(np.int32)), pa.array(sizes.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(total[by_doc].astype(np.int32)), pa.array(feature.astype(np.int32))),
                    ],
                    names=["label", "plain", "sizes", "features"],
                )

    return run


def _logs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sentences' logits: -log(1 - p) and p."""
    return np.logaddexp(0.0, x), 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def gradient(w: np.ndarray, label: np.ndarray, plain: np.ndarray, per_doc: np.ndarray, sizes: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the bags' summed log-likelihood; w holds the bias behind the features' weights. per_doc: marked sentences of
    each document, sizes: features of each such sentence."""
    owner, sentence = np.repeat(np.arange(len(label)), per_doc), np.repeat(np.arange(len(sizes)), sizes)
    logit = w[-1] + np.bincount(sentence, w[feats], len(sizes))
    cost, p = _logs(logit)
    cost0, p0 = _logs(w[-1:])
    clean = np.maximum(np.bincount(owner, cost, len(label)) + plain * cost0[0], 1e-12)  # -log of the bag's (1 - P)
    likely = np.where(label == 1, np.log(-np.expm1(-clean)), -clean)
    # d log P / d clean = (1 - P) / P for a bag labelled 1, -1 for one labelled 0
    slope = np.where(label == 1, 1 / np.expm1(np.minimum(clean, 700.0)), -1.0)
    by_sentence = slope[owner] * p
    out = np.zeros(len(w))
    out[:-1] = np.bincount(feats, by_sentence[sentence], len(w) - 1)
    out[-1] = by_sentence.sum() + (slope * plain).sum() * p0[0]
    return out, float(likely.sum())


def _gradients(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        total, likely, n = np.zeros(len(w)), 0.0, 0
        for b in batches:
            sizes, feats = b.column(2), b.column(3)
            per_doc = np.diff(sizes.offsets.to_numpy())
            g, ll = gradient(w, b.column(0).to_numpy(), b.column(1).to_numpy(), per_doc, sizes.flatten().to_numpy(), feats.flatten().to_numpy())
            total, likely, n = total + g, likely + ll, n + b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(total[at], [likely, n]))], names=["k", "v"])

    return run


def fit_bags(bags: DataFrame, n_features: int, start: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Weights (the bias behind them) and the mean log-likelihood before each step, by Adam over all bags."""
    sc, w = bags.sparkSession.sparkContext, start.copy()
    m, v, trace = np.zeros(len(w)), np.zeros(len(w)), []
    for t in range(1, ITERATIONS + 1):
        sent = sc.broadcast(w)
        sums = {r.k: r.v for r in bags.mapInArrow(_gradients(sent), "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        sent.destroy()
        n = max(sums.get(-2, 0.0), 1.0)
        g = np.zeros(len(w))
        for k, value in sums.items():
            if k >= 0:
                g[k] = value / n
        g[:-1] -= DECAY * w[:-1]
        trace.append(sums.get(-1, 0.0) / n)
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        w += RATE * (1 - 0.9 * t / ITERATIONS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
    return w, trace


class Model:
    """Chosen features (hashes), their weights and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, trace: list[float] | None = None):
        self.keys, self.weights, self.trace = keys, weights, trace or []


def evidence(n_pos, n_neg, positives: int, negatives: int):
    """The likelihood ratio G of a feature's counts of documents against none's, where label 1 holds it more often."""
    rate = (n_pos + n_neg) / F.lit(float(positives + negatives))
    part = lambda n, of: F.when(n > 0, n * F.log(n / (of * rate))).otherwise(0.0)
    rest = lambda n, of: F.when(n < of, (of - n) * F.log((of - n) / (of * (1 - rate)))).otherwise(0.0)
    g = 2 * (part(n_pos, positives) + rest(n_pos, positives) + part(n_neg, negatives) + rest(n_neg, negatives))
    return F.when(n_pos * float(negatives) > n_neg * float(positives), g).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the rows of docs whose id has a label in `labels`."""
    sc, name = docs.sparkSession.sparkContext, uuid.uuid4().hex
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most"))
    marks = marks.where("label = most AND label IN (0, 1)").select("id", F.col("label").cast("int").alias("label"))
    marks = scratch.write(marks, "marks")
    share = SAMPLE / max(marks.count(), 1)
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "id").select("text", "label")
    rows = scratch.write(rows, "labelled", compression="zstd")
    ends = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    positives, negatives = ends.get(1, 0), ends.get(0, 0)
    if not positives or not negatives:
        return Model(np.zeros(0, np.uint64), np.array([math.log(PRIOR / (1 - PRIOR))]))
    counted = "feature bigint, n bigint"
    least = max(LEAST, math.ceil(CANDIDATE * positives))
    held = rows.where("label = 1").select("text").mapInArrow(_positive, counted).groupBy("feature").agg(F.sum("n").alias("n_pos")).where(F.col("n_pos") >= least)
    held = scratch.write(held, "candidates")
    candidates = held.select("feature").toArrow().column(0).to_numpy().view(np.uint64)
    sent = sc.broadcast(candidates[candidates > 1])
    others = rows.where("label = 0").select("text").mapInArrow(_negative(f"{name}-candidates", sent), counted).groupBy("feature").agg(F.sum("n").alias("n_neg"))
    both = held.where("feature NOT IN (0, 1)").join(others, "feature", "left").withColumn("n_neg", F.coalesce("n_neg", F.lit(0)))
    judged = both.withColumn("g", evidence(F.col("n_pos"), F.col("n_neg"), positives, negatives)).where(F.col("g") >= EVIDENCE)
    chosen = judged.orderBy(F.desc("g"), "feature").limit(FEATURES).select("feature").toArrow()
    keys = chosen.column(0).to_numpy().view(np.uint64)
    known = sc.broadcast(keys)
    bags = rows.mapInArrow(_bags(f"{name}-chosen", known), "label int, plain bigint, sizes array<int>, features array<int>")
    bags = scratch.write(bags, "bags")
    sentences = float(bags.agg(F.avg(F.col("plain") + F.size("sizes"))).first()[0] or 1.0)
    start = np.zeros(len(keys) + 1)
    rate = positives / (positives + negatives)
    start[-1] = math.log(max(rate / sentences, 1e-9))
    w, trace = fit_bags(bags, len(keys), start)
    return Model(keys, w, trace)


def _scored(name: str, keys, weights, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w = _table(name, keys), weights.value
        for batch in batches:
            for slab, data in _slabs(batch.column(1)):
                n = len(slab.offsets) - 1
                starts, first, sentence, feature = _sentences(table, data, slab.offsets)
                logit = w[-1] + np.bincount(sentence, w[feature], len(starts))
                cost, p = _logs(logit)
                at = np.repeat(np.arange(n), np.diff(first))
                score = np.clip(-np.expm1(-np.bincount(at, cost, n)), 0.0, 1.0)
                ends = np.append(starts[1:], len(data))
                part = slice(slab.first, slab.first + n)
                marked = np.flatnonzero(p >= 0.5)
                if spans:
                    fields = [pa.array((starts - slab.offsets[:-1][at])[marked]), pa.array((ends - slab.offsets[:-1][at])[marked]), pa.array(p[marked])]
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(marked, first).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "end", "score"]))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(score), lists], names=["doc_id", "score", "spans"])
                    continue
                top = np.lexsort((-np.arange(len(p)), p, at))[first[1:] - 1]  # the first of the highest
                of = slab.offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(2)[part], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.diff(first)),
                     pa.array(np.bincount(at[marked], minlength=n)), pa.array(starts[top] - of), pa.array(ends[top] - of), pa.array(p[top])],
                    names=["doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", "worst_start", "worst_end", "worst_score"],
                )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_sentences, n_offending, and the worst sentence's bytes and score."""
    sc, kind = docs.sparkSession.sparkContext, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), is_held_out(id_col).alias("held_out"))
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, n_sentences bigint, n_offending bigint, worst_start bigint, worst_end bigint, worst_score double"
    return rows.mapInArrow(_scored(uuid.uuid4().hex, sc.broadcast(model.keys), sc.broadcast(model.weights), False), schema)


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Offending sentences, one row each: doc_id, start, end (bytes of the text) and score, where it is 0.5 or more."""
    sc, kind = docs.sparkSession.sparkContext, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, score double, spans array<struct<start:bigint,end:bigint,score:double>>"
    found = rows.mapInArrow(_scored(uuid.uuid4().hex, sc.broadcast(model.keys), sc.broadcast(model.weights), True), schema)
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.score")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Trains on the labelled rows that are not held out and scores all rows."""
    model = train(docs.where(~is_held_out(id_col)), labels, Scratch(docs.sparkSession, "toxicity"), id_col, text_col, label_col)
    return score(docs, model, id_col, text_col)
