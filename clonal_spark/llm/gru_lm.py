"""LM scoring by a gated recurrent language model.

Words are counted over all training documents. The HEAD most frequent ones (the end of a document is
always one) have vectors and slots of their own; other words belong to one of TAILS classes by their last
two bytes, and within its class a word has its add-half share of training counts, with one share for all
unseen words. The output softmax is factored: classes first, then the head words of a class. So the model
is a distribution over all known words and one unseen word per class, whatever the corpus' size.

Training is truncated backpropagation through time in numpy, over every training document once: rounds
take disjoint sets of documents; in a round each task starts from the common weights, trains on its
documents, and weights are averaged by tokens. Lanes carry state across windows to the document's end, in
training and scoring alike, so a text of any length is scored whole.

Counts of the KNOWN most frequent words are broadcast (bounded by that parameter); the other words of a
document meet the count table in a join, as their counts are needed for the sum only.

Defined results: a null text is an empty one and has the end token only; a null doc_id counts as the empty
text's hash and is trained on; rows with the same doc_id are documents of their own; with no training
documents, counts are 0 and the model gives its initial weights.
"""

from __future__ import annotations

import contextlib
import ctypes
import heapq
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.llm import _text
from clonal_spark.llm._pieces import Pieces
from clonal_spark.session import Scratch

#: Head words, in classes of SLOTS; tail classes; sizes of word vectors and state.
HEAD, SLOTS, TAILS, EMBED, STATE = 512, 32, 48, 12, 16
HEAD_CLASSES = HEAD // SLOTS
CLASSES = HEAD_CLASSES + TAILS
KNOWN = 200_000
#: Lanes, steps of a window, tokens of a step, learning rate, gradient limit, words that a worker holds at once.
LANES, STEPS, LEAST, RATE, CLIP, HELD = 512, 16, 2048, 0.01, 1.0, 1_200_000
#: Of 16 sets of documents, those that each round trains on.
ROUNDS = ((0,), (1, 2, 3), tuple(range(4, 16)))
CHUNK = 8192
LOG10 = math.log(10)


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _by_last_bytes() -> tuple[np.ndarray, np.ndarray]:
    two = np.array([tail_class(bytes(x)) for x in np.ndindex(256, 256)], np.int32)
    return np.array([tail_class(bytes([x])) for x in range(256)], np.int32), two


_LAST: list[np.ndarray] = []


def _tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tail classes of words, by tables over their last bytes."""
    if not _LAST:
        _LAST.extend(_by_last_bytes())
    last, before = data[ends - 1].astype(np.int32), data[np.maximum(ends - 2, 0)].astype(np.int32)
    return np.where(ends - starts > 1, _LAST[1][before * 256 + last], _LAST[0][last])


def _slab_words(text: pa.Array) -> Iterator[tuple[_text.Slab, np.ndarray, _text.Words]]:
    """Slabs with A-Z lower-cased, and their words."""
    for slab in _text.slabs(text):
        data = _text.LOWER[slab.data]
        yield slab, data, _text.words(data, slab.offsets)


#: Distinct words that a counting task holds before it sends them on.
COUNTED = 400_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts with their numbers, summed in the task before they are sent; the end is the empty word."""
    table, names, n, ends_seen = Pieces(), [], np.zeros(1 << 16, np.int64), 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*names, b""], pa.binary()), pa.array(np.append(n[: table.count], ends_seen))], names=["word", "n"])

    for batch in batches:
        for slab, data, w in _slab_words(batch.column(0)):
            ends_seen += len(slab.offsets) - 1
            which = table.find(w.hashes)
            missing = np.flatnonzero(which < 0)
            if len(missing):
                new, one, back = np.unique(w.hashes[missing], return_index=True, return_inverse=True)
                which[missing] = table.add(new)[back]
                raw = data.tobytes()
                names.extend([raw[x:y] for x, y in zip(w.starts[missing[one]].tolist(), w.ends[missing[one]].tolist(), strict=True)])
            if table.count > len(n):
                n = np.concatenate([n, np.zeros(table.count, np.int64)])
            n[: table.count] += np.bincount(which, minlength=table.count)
            if table.count > COUNTED:
                yield rows()
                table, names, n, ends_seen = Pieces(), [], np.zeros(1 << 16, np.int64), 0
    if ends_seen:
        yield rows()


def initial(head_counts: np.ndarray, tail_counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights that give the counts' own distribution; slots and classes without a word get no mass."""
    rng = np.random.default_rng(11)
    n = np.zeros(HEAD)
    n[: len(head_counts)] = head_counts
    by_class = np.concatenate([n.reshape(-1, SLOTS).sum(1), tail_counts + 0.5])
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": draw(HEAD + TAILS, EMBED, scale=0.3),
        "wx": draw(EMBED, 3 * STATE, scale=EMBED**-0.5),
        "wh": draw(STATE, 3 * STATE, scale=STATE**-0.5),
        "b": np.zeros(3 * STATE, np.float32),
        "wc": np.zeros((STATE, CLASSES), np.float32),
        "bc": np.where(by_class > 0, np.log(np.maximum(by_class, 1e-9) / by_class.sum()), -1e9).astype(np.float32),
        "wo": np.zeros((HEAD_CLASSES, STATE, SLOTS), np.float32),
        "bo": np.where(n > 0, np.log(np.maximum(n, 1e-9) / max(n.sum(), 1)), -1e9).astype(np.float32).reshape(-1, SLOTS),
    }


class Window:
    """Forward and backward passes over (steps, lanes) of inputs; fresh: for each step, lanes that start a document."""

    def __init__(self, w: dict[str, np.ndarray], inputs: np.ndarray, fresh: list[np.ndarray], h: np.ndarray):
        t, b = inputs.shape
        s2 = 2 * STATE
        self.w, self.inputs, self.fresh = w, inputs, fresh
        self.x = w["embed"][inputs.ravel()]
        gx = self.x @ w["wx"]
        gx += w["b"]
        gx = gx.reshape(t, b, -1)
        self.gates, self.n, self.g, self.before, self.h = (np.empty((t, b, k), np.float32) for k in (s2, STATE, STATE, STATE, STATE))
        gh = np.empty((b, 3 * STATE), np.float32)
        for i in range(t):
            before, gates, n, now = self.before[i], self.gates[i], self.n[i], self.h[i]
            before[:] = h
            if len(fresh[i]):
                before[fresh[i]] = 0
            np.matmul(before, w["wh"], out=gh)
            np.add(gx[i, :, :s2], gh[:, :s2], out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            self.g[i] = gh[:, s2:]
            np.multiply(gates[:, STATE:], gh[:, s2:], out=n)
            n += gx[i, :, s2:]
            np.tanh(n, out=n)
            np.subtract(before, n, out=now)
            now *= gates[:, :STATE]
            now += n
            h = now
        self.last = h.copy()

    def loss(self, targets: np.ndarray, there: np.ndarray, learn: bool) -> np.ndarray:
        """Log-probabilities of the targets (class, and slot for head words) where there is a token. Biases start as
        log-probabilities, so exponentials need no shift; they are bounded all the same."""
        w, h = self.w, self.h.reshape(-1, STATE)
        rows = np.flatnonzero(there.ravel())
        y = targets.ravel()[rows]
        hr = h if len(rows) == len(h) else h[rows]
        head = y < HEAD
        cls = np.where(head, y // SLOTS, y - (HEAD - HEAD_CLASSES))
        # tokens in the order of their classes, so that the tokens of a class are a slice
        order = np.argsort(cls.astype(np.int16), kind="stable")
        y, cls, hr = y[order], cls[order], hr[order]
        p = hr @ w["wc"]
        p += w["bc"]
        np.minimum(p, 60, out=p)
        np.exp(p, out=p)
        total = p @ np.ones(CLASSES, np.float32)
        at = np.arange(len(rows))
        logp = np.log(np.maximum(p[at, cls], 1e-37) / total)
        if learn:
            p *= (1 / total)[:, None]
            p[at, cls] -= 1
            self.grads = {"wc": hr.T @ p, "bc": p.sum(0), "wo": np.zeros_like(w["wo"]), "bo": np.zeros_like(w["bo"])}
            dh = p @ w["wc"].T
        edges = np.searchsorted(cls, np.arange(HEAD_CLASSES + 1)).tolist()
        ones = np.ones(SLOTS, np.float32)
        for c in range(HEAD_CLASSES):
            a, b = edges[c], edges[c + 1]
            if a == b:
                continue
            slot, hs, k = y[a:b] - c * SLOTS, hr[a:b], at[: b - a]
            q = hs @ w["wo"][c]
            q += w["bo"][c]
            np.minimum(q, 60, out=q)
            np.exp(q, out=q)
            s = q @ ones
            logp[a:b] += np.log(np.maximum(q[k, slot], 1e-37) / s)
            if learn:
                q *= (1 / s)[:, None]
                q[k, slot] -= 1
                self.grads["wo"][c], self.grads["bo"][c] = hs.T @ q, q.sum(0)
                dh[a:b] += q @ w["wo"][c].T
        back = rows[order]
        out = np.zeros(there.size)
        out[back] = logp
        if learn:
            self.dh = np.zeros_like(h)
            self.dh[back] = dh
        return out.reshape(there.shape)

    def backward(self) -> dict[str, np.ndarray]:
        w, (t, b) = self.w, self.inputs.shape
        dh_out = self.dh.reshape(t, b, STATE)
        s2 = 2 * STATE
        dgx = np.empty((t, b, 3 * STATE), np.float32)
        dgh = np.empty((t, b, 3 * STATE), np.float32)
        # what does not depend on the steps after is made for all steps at once
        z, r = self.gates[:, :, :STATE], self.gates[:, :, STATE:]
        for_n = (1 - z) * (1 - self.n * self.n)
        for_z = (self.before - self.n) * (z * (1 - z))
        for_r = self.g * (r * (1 - r))
        carried = np.zeros((b, STATE), np.float32)
        back = np.ascontiguousarray(w["wh"].T)
        for i in range(t - 1, -1, -1):
            d = carried
            d += dh_out[i]
            x = dgx[i]
            dn = d * for_n[i]
            np.multiply(d, for_z[i], out=x[:, :STATE])
            np.multiply(dn, for_r[i], out=x[:, STATE:s2])
            x[:, s2:] = dn
            y = dgh[i]
            y[:, :s2] = x[:, :s2]
            np.multiply(dn, r[i], out=y[:, s2:])
            carried = y @ back
            d *= z[i]
            carried += d
            if len(self.fresh[i]):
                carried[self.fresh[i]] = 0
        flat = dgx.reshape(-1, 3 * STATE)
        g = self.grads
        g["wh"] = self.before.reshape(-1, STATE).T @ dgh.reshape(-1, 3 * STATE)
        g["wx"], g["b"] = self.x.T @ flat, flat.sum(0)
        dx, ids = flat @ w["wx"].T, self.inputs.ravel()
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        g["embed"] = np.zeros_like(w["embed"])
        g["embed"][ids[starts]] = np.add.reduceat(dx[order], starts, 0)
        return g


class Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
        self.held, self.tokens = {}, 0

    def add(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], tokens: int, last: bool) -> None:
        """Windows of few lanes are summed up, so that every step has LEAST tokens (but for a call's last)."""
        if self.tokens:
            g = {k: x + self.held[k] for k, x in g.items()}
        self.held, self.tokens = g, self.tokens + tokens
        if self.tokens >= LEAST or last and self.tokens >= LEAST // 4:
            self.step(w, self.held, self.tokens)
            self.held, self.tokens = {}, 0

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], tokens: int) -> None:
        self.t += 1
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values())) / tokens
        scale = min(1.0, CLIP / max(norm, 1e-12)) / tokens
        rate = RATE * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            x = x * np.float32(scale)
            self.m[k] += np.float32(0.1) * (x - self.m[k])
            self.v[k] += np.float32(0.01) * (x * x - self.v[k])
            w[k] -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-6))


def lanes(lengths: np.ndarray, count: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the shortest lane; lanes come longest first."""
    heap = [(0, i) for i in range(min(count, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), i))
    return sorted(out, key=lambda x: -int(lengths[x].sum()))


def one_thread() -> None:
    """Keeps numpy's matrix library to one thread, as a task has one core: on small matrices more threads only wait for
    each other. Its library is found among the mapped ones; where it is another one, nothing changes."""
    with contextlib.suppress(OSError):
        with open("/proc/self/maps") as maps:
            files = {line.split()[-1] for line in maps if "openblas" in line}
        for file in files:
            library = ctypes.CDLL(file)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)


def run(w: dict[str, np.ndarray], docs: list[np.ndarray], learn: Adam | None = None, count: int = LANES) -> np.ndarray:
    """Natural log-probability of each document (ids without the end, which is 0): of classes and head words."""
    lengths = np.array([len(d) + 1 for d in docs], np.int64)
    dealt = lanes(lengths, count)
    sizes = np.array([lengths[x].sum() for x in dealt])
    most = int(sizes.max()) if len(sizes) else 0
    # the lanes' tokens one after the other; a window takes its steps of each lane that goes so far
    order = np.array([d for some in dealt for d in some], np.int64)
    ends = np.cumsum(lengths[order])
    targets = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    words = np.ones(len(targets), bool)
    words[ends - 1] = False
    targets[words] = np.concatenate([docs[d] for d in order]) if len(order) else []
    inputs = np.append(np.zeros(1, np.int32), targets[:-1])
    begins = np.append(True, ~words[:-1])
    owner = np.repeat(order, lengths[order])
    first = np.cumsum(sizes) - sizes
    out = np.zeros(len(docs))
    h = np.zeros((len(dealt), STATE), np.float32)
    for t in range(0, most, STEPS):
        b = int((sizes > t).sum())  # lanes that are not at their end
        step = t + np.arange(STEPS)[:, None]
        there = step < sizes[:b]
        at = np.where(there, first[:b] + step, 0)
        window = Window(w, np.where(there, inputs[at], 0), [np.flatnonzero(x) for x in begins[at] & there], h[:b])
        h = window.last
        logp = window.loss(np.where(there, targets[at], 0), there, learn is not None)
        out += np.bincount(owner[at[there]], logp[there], len(docs))
        if learn is not None:
            learn.add(w, window.backward(), int(there.sum()), most - t <= STEPS)
    return out


class Vocabulary:
    """Known words in the order of their counts, after the end (index 0): a table of their hashes, and the id of each one's vector."""

    def __init__(self, joined: bytes, counts: np.ndarray):
        data = np.frombuffer(joined, np.uint8)
        w = _text.words(data, np.array([0, len(data)]))
        self.table = Pieces()
        self.table.add(w.hashes)
        self.counts = counts
        self.ids = np.arange(len(w.hashes) + 1, dtype=np.int32)
        self.ids[HEAD:] = HEAD + _tails(data, w.starts, w.ends)[HEAD - 1 :]

    def index(self, w: _text.Words) -> np.ndarray:
        """Indexes from 1 on; 0 for words that are not known."""
        return self.table.find(w.hashes) + 1

    def vectors(self, data: np.ndarray, w: _text.Words, index: np.ndarray) -> np.ndarray:
        out = self.ids[index]
        missing = np.flatnonzero(index == 0)
        out[missing] = HEAD + _tails(data, w.starts[missing], w.ends[missing])
        return out


_SHARED: dict[str, Vocabulary] = {}


def _shared(name: str, known) -> Vocabulary:
    """A worker's vocabulary, built once."""
    if name not in _SHARED:
        _SHARED.clear()
        _SHARED[name] = Vocabulary(*known.value)
    return _SHARED[name]


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflat(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _trained(name: str, known, weights):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        vocabulary = _shared(name, known)
        w = {k: x.copy() for k, x in weights.value.items()}
        adam, tokens, held, size = Adam(w), 0, [], 0
        for batch in batches:
            for slab, data, words in _slab_words(batch.column(0)):
                vectors = vocabulary.vectors(data, words, vocabulary.index(words))
                held += np.split(vectors, words.offsets[1:-1])
                size += len(vectors)
                tokens += len(vectors) + len(slab.offsets) - 1
                if size >= HELD:
                    run(w, held, adam)
                    held, size = [], 0
        if held:
            run(w, held, adam)
        if tokens:
            x = flat(w)
            parts = [x[i : i + CHUNK].tobytes() for i in range(0, len(x), CHUNK)]
            task = TaskContext.get().partitionId() if TaskContext.get() else 0
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([tokens] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "task", "tokens", "weights"])

    return train


#: A chunk of the weights of a task; groups of tasks whose weights are averaged first.
AVERAGED = "chunk int, task int, tokens bigint, weights binary"
SHARES = 1024


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """The mean by tokens, in the order of tasks, so that runs agree."""
    rows = rows.sort_values("task")
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) * n for n, x in zip(rows["tokens"], rows["weights"], strict=True))
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "task": rows["task"].iloc[:1], "tokens": [rows["tokens"].sum()], "weights": [(total / rows["tokens"].sum()).astype(np.float32).tobytes()]})


def averaged(rows: DataFrame) -> DataFrame:
    """One row per chunk of the weights: means of SHARES groups of tasks, then the mean of those, so no group holds a row of
    every task."""
    some = rows.groupBy("chunk", F.pmod("task", F.lit(SHARES)).alias("share")).applyInPandas(_averaged, AVERAGED)
    return some.groupBy("chunk").applyInPandas(_averaged, AVERAGED)


def _scored(name: str, known, weights, tail_totals: np.ndarray, denominator: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        vocabulary = _shared(name, known)
        w, task, made = weights.value, TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        logs = np.log10(vocabulary.counts + 0.5)
        seen = vocabulary.counts > 0
        held: list[tuple] = []

        def rows() -> pa.RecordBatch:
            """One row per document that is held."""
            nonlocal made
            docs = [d for h in held for d in h[-1]]
            lengths, base, within, n_known = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4, 5))
            model = run(w, docs) / LOG10
            made += len(docs)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([h[0] for h in held]),
                    pa.concat_arrays([h[1] for h in held]),
                    pa.array(np.arange(made - len(docs), made) + (task << 40)),
                    pa.array(lengths + 1),
                    pa.array(n_known + int(seen[0])),
                    pa.array(base + logs[0] - (lengths + 1) * denominator),
                    pa.array(model + within),
                    pa.concat_arrays([h[6] for h in held]),
                ],
                names=["doc_id", "held_out", "row_key", "n_tokens", "n_known", "base_score", "score", "rest"],
            )

        kind = pa.struct([("word", pa.binary()), ("n", pa.int32())])
        for batch in batches:
            for slab, data, words in _slab_words(batch.column(2)):
                n_docs = len(slab.offsets) - 1
                index = vocabulary.index(words)
                vectors = vocabulary.vectors(data, words, index)
                there = index > 0
                have = np.where(there, logs[index], 0.0)
                tail = vectors >= HEAD
                within = np.where(tail, have - tail_totals[np.maximum(vectors - HEAD, 0)], 0.0)
                lengths = np.diff(words.offsets)
                doc = np.repeat(np.arange(n_docs), lengths)
                sums = lambda x: np.bincount(doc, x, n_docs)  # noqa: B023, E731
                missing = np.flatnonzero(~there)
                raw, names, times, counts = data.tobytes(), [], [], np.zeros(n_docs + 1, np.int32)
                bounds = np.searchsorted(missing, words.offsets).tolist()
                starts, ends = words.starts[missing].tolist(), words.ends[missing].tolist()
                for k in range(n_docs):
                    if bounds[k] < bounds[k + 1]:
                        found = Counter([raw[starts[j] : ends[j]] for j in range(bounds[k], bounds[k + 1])])
                        names.extend(found)
                        times.extend(found.values())
                    counts[k + 1] = len(names)
                rest = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int32())], fields=list(kind)))
                part = slice(slab.first, slab.first + n_docs)
                held.append((batch.column(0)[part], batch.column(1)[part], lengths, sums(have), sums(within), sums(there & seen[index]).astype(np.int64), rest, np.split(vectors, words.offsets[1:-1])))
                if sum(int(h[2].sum()) for h in held) >= HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training=None) -> DataFrame:
    """Trains on the rows of the Column training (default: not held out by is_held_out) and scores all rows:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    sc, scratch, name = spark.sparkContext, Scratch(spark, "gru-lm"), uuid.uuid4().hex
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    docs = docs.withColumn("held_out", is_held_out() if training is None else ~training)
    taught = docs.where("NOT held_out")

    counts = scratch.write(taught.select("text").mapInArrow(_counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    # Words above a count that at most KNOWN reach: a histogram of a few hundred rows finds it, so no task or driver sorts
    # the vocabulary, and at most KNOWN rows come to the driver, whatever the corpus' size.
    steps = F.floor(F.log2(F.col("n").cast("double")) * 16)
    histogram = counts.where("length(word) > 0").groupBy(steps.alias("step")).agg(F.count("*").alias("words")).collect()
    least, reached = None, 0
    for r in sorted(histogram, key=lambda r: -r.step):
        reached += r.words
        if reached > KNOWN:
            break
        least = r.step
    top = counts.where("length(word) > 0").where(F.lit(False) if least is None else steps >= least).select("word", "n").toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    ends = int((counts.where("length(word) = 0").agg(F.sum("n")).first()[0]) or 0)
    head_words, head_counts = top.column("word").to_pylist(), np.append(ends, top.column("n").to_numpy()).astype(np.float64)
    classes = counts.where("length(word) > 0").groupBy((F.crc32(F.expr("substring(word, -2, 2)")) % TAILS).cast("int").alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    sums, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in classes:
        sums[r.tail], kinds[r.tail] = r.n, r.v
    for word, c in zip(head_words[: HEAD - 1], head_counts[1:], strict=False):
        sums[tail_class(word)] -= c
        kinds[tail_class(word)] -= 1
    known = sc.broadcast((b" ".join(head_words), head_counts))
    weights = initial(head_counts[:HEAD], sums)

    part = F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(16))
    for sets in ROUNDS:
        sent = sc.broadcast(weights)
        grown = taught.where(part.isin(*sets)).select("text").mapInArrow(_trained(name, known, sent), AVERAGED)
        # One row per chunk of the weights comes to the driver.
        rows = averaged(grown).collect()
        if rows:
            weights = unflat(np.concatenate([np.frombuffer(bytes(r.weights), np.float32) for r in sorted(rows, key=lambda r: r.chunk)]), weights)

    denominator = math.log10(n + 0.5 * (v + 1))
    totals = np.log10(np.maximum(sums, 0) + 0.5 * (np.maximum(kinds, 0) + 1))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, row_key bigint, n_tokens bigint, n_known bigint, base_score double, score double, rest array<struct<word:binary,n:int>>"
    scored = scratch.write(docs.select("doc_id", "held_out", "text").mapInArrow(_scored(name, known, sc.broadcast(weights), totals, denominator), schema), "scored")
    rare = scored.select("row_key", F.explode("rest").alias("r")).select("row_key", "r.word", F.col("r.n").alias("times"))
    met = rare.join(counts, "word", "left").groupBy("row_key").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("known"))
    result = scored.drop("rest").join(met, "row_key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return result.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
