"""MinHash near-dedup with SetSketch registers.

Each document's set of word shingles becomes M registers: exponentially spaced truncated minima of a
Poisson process per shingle (mergeable by maximum, and locality-sensitive). Bands of ROWS registers give
bucket keys. Documents with equal sets form a class first, and only its least doc_id goes on. In each
bucket all members are paired with the least one; the pair's registers give a maximum-likelihood estimate
of the similarity (set sizes are known), and pairs that may reach the threshold are verified on full
sets. Then, in two waves, members of a bucket that are in different components of the verified links are
compared in the same way: at first with the few nearest by registers, which closes families, at last with all
that are left (by LONG_M registers), so no link is lost and what is linked already is not paired. All members of a bucket are
within one task only as registers of 2 * M bytes.

Work beyond the first pairing grows with the pairs of one bucket that stay in different components and
whose estimate comes within MARGIN of the threshold.

A pair at the threshold shares no band with probability (1 - 0.75 ** ROWS) ** BANDS = 5e-6 for 4 and 32.

Defined results: A-Z are lower-cased; fewer words than a shingle has make one shingle; a null or empty
text has an empty set, is linked with nothing and kept; rows with the same doc_id count as one document;
a null doc_id is never linked and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.llm import _text
from clonal_spark.llm.components import joined_components
from clonal_spark.session import Scratch

SHINGLE = 5
#: Per cent.
SIMILARITY = 75
M, ROWS, BANDS = 128, 4, 32
#: SetSketch's base, rate and the largest register.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: An estimate this far below the threshold is four standard deviations away.
MARGIN = 0.16
#: Registers of the last wave, of which the low byte is kept; their agreement has a smaller margin.
LONG_M, LONG_MARGIN = 1024, 0.056


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the slab's documents, joined and ascending in each, and their numbers."""
    data = _text.LOWER[data]
    w = _text.words(data, offsets)
    grams = _text.ngrams(w.hashes, SHINGLE)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        if b - a < SHINGLE:
            s = _text.ngrams(w.hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            s = np.sort(grams[a : b - SHINGLE + 1])
            s = s[np.append(True, s[1:] != s[:-1])]
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def registers(elements: np.ndarray, sizes: np.ndarray, m: int = M) -> np.ndarray:
    """SetSketch registers (documents, m) of joined sets; m is a power of two."""
    least = np.full(len(sizes) * m, np.inf)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    state, x = elements.copy(), np.zeros(len(elements))
    full = sizes > 0
    while len(state):
        state = _text.mix(state + np.uint64(0x9E3779B97F4A7C15))
        x = x - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (RATE * m)
        slot = doc * m + (_text.mix(state) & np.uint64(m - 1)).astype(np.int64)
        better = np.flatnonzero(x < least[slot])
        np.minimum.at(least, slot[better], x[better])
        most = least.reshape(-1, m).max(1)
        go = x < most[doc]
        state, x, doc = state[go], x[go], doc[go]
    out = np.zeros(len(least), np.uint16)
    set_ = np.repeat(full, m)
    out[set_] = np.clip(np.floor(1 - np.log(least[set_]) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out.reshape(-1, m)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard estimates from register rows and set sizes: register a is larger with
    probability p(u - v J), smaller with p(v - u J), for u and v the sizes' shares and
    p(x) = -log_b(1 - x (b - 1) / b). The likelihood is concave in J; bisection on its slope."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        more, less = p(np.maximum(u - v * j, 1e-12)), p(np.maximum(v - u * j, 1e-12))
        return up * np.log(np.maximum(more, 1e-12)) + down * np.log(np.maximum(less, 1e-12)) + same * np.log(np.maximum(1 - more - less, 1e-12))

    for _ in range(22):
        left, right = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        rising = value(left) < value(right)
        lo, hi = np.where(rising, left, lo), np.where(rising, hi, right)
    return (lo + hi) / 2


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = _text.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for slab in _text.slabs(batch.column(1)):
            elements, sizes = shingle_sets(slab.data, slab.offsets)
            ends = np.cumsum(sizes)
            first = _text.segment_sum(_text.mix(elements ^ np.uint64(0x5851F42D4C957F2D)), ends - sizes, ends)
            second = _text.segment_sum(_text.mix(elements ^ np.uint64(0x14057B7EF767814F)), ends - sizes, ends)
            regs = registers(elements, sizes)
            bands = _text.mix(np.zeros((len(sizes), BANDS), np.uint64) + salt)
            for j in range(ROWS):
                bands = _text.mix(bands ^ regs[:, j::ROWS][:, :BANDS].astype(np.uint64))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[slab.first : slab.first + n],
                    pa.array(sizes),
                    pa.array(first.view(np.int64)),
                    pa.array(second.view(np.int64)),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "registers", "bands"],
            )
    _text.release()


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both register rows: those whose estimate does not rule them out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n_a, n_b = batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy()
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("reg_u", "reg_v"))
        keep = similarity(a, b, n_a, n_b) >= SIMILARITY / 100 - MARGIN
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep))], names=["u", "v"])


def _apart(top: int | None):
    """Rows (key, doc, n, registers, bands, component) with the rows of a key together: likely pairs of a key whose
    components differ; for each document outside the key's largest component its `top` nearest by registers, or all.
    A pair that shares several keys is made in that of its first common band only."""

    def pairs(key: int, docs: np.ndarray, sizes: np.ndarray, regs: np.ndarray, bands: np.ndarray, comps: np.ndarray) -> Iterator[pa.RecordBatch]:
        band = int(np.flatnonzero(bands[0] == key)[0])
        m, margin = (M, MARGIN) if top else (LONG_M, LONG_MARGIN)
        least = m * (SIMILARITY / 100 - margin) - 1
        names, counts = np.unique(comps, return_counts=True)
        if len(names) < 2:
            return
        largest = names[np.argmax(counts)]
        us, vs = [], []
        for i in np.flatnonzero(comps != largest).tolist():  # pairs within the largest component are not made
            # of two documents outside it, the one of the lesser component makes the pair, when all are made
            other = np.flatnonzero(comps != comps[i] if top else (comps == largest) | (comps > comps[i]))
            other = other[np.minimum(sizes[other], sizes[i]) * 100 >= SIMILARITY * np.maximum(sizes[other], sizes[i])]
            other = other[~(bands[other, :band] == bands[i, :band]).any(1)]
            # at this base, agreeing registers bound the estimate from above
            agree = (regs[other] == regs[i]).sum(1)
            good = agree >= least
            other, agree = other[good], agree[good]
            if top and len(other) > top:
                other = other[np.lexsort((docs[other], -agree))[:top]]
            us.append(np.full(len(other), i))
            vs.append(other)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        for lo in range(0, len(i), 4096):
            a, b = i[lo : lo + 4096], j[lo : lo + 4096]
            good = similarity(regs[a], regs[b], sizes[a], sizes[b]) >= SIMILARITY / 100 - margin
            a, b = a[good], b[good]
            a, b = docs[a], docs[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, docs, sizes, comps = (batch.column(c).to_numpy() for c in ("key", "doc_id", "n_shingles", "component"))
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(len(keys), -1)
            bands = batch.column("bands").flatten().to_numpy().reshape(len(keys), BANDS)
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and keys[lo] != key:
                    yield from pairs(key, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                key = keys[lo]
                held.append((docs[lo:hi], sizes[lo:hi].astype(np.float64), regs[lo:hi], bands[lo:hi], comps[lo:hi]))
        if held:
            yield from pairs(key, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slab in _text.slabs(batch.column(1)):
            elements, sizes = shingle_sets(slab.data, slab.offsets)
            parts = np.split(elements, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0)[slab.first : slab.first + len(sizes)], pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "shingles"])


def _long_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
            regs = registers(np.concatenate(sets), np.array([len(x) for x in sets]), LONG_M)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "registers"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([a, b]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= SIMILARITY * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(keep, pa.bool_())), batch.column("v").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The links (a, b) among pairs (u, v), by full sets."""
    met = pairs.join(sets.toDF("u", "set_u"), "u").join(sets.toDF("v", "set_v"), "v")
    return scratch.write(met.mapInArrow(_linked, "a bigint, b bigint"), name)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, registers binary, bands array<bigint>"
    sketches = scratch.write(docs.mapInArrow(_sketched, schema), "sketches", compression="none")
    full = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")

    classes = scratch.write(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    copied = classes.where("copies > 1").select("set_a", "set_b", "n_shingles", "rep")
    copies = full.select("doc_id", "set_a", "set_b", "n_shingles").join(copied, ["set_a", "set_b", "n_shingles"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    copies = scratch.write(copies, "copies")
    reps = full.join(copies.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti")

    members = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead <> last").select("key", "lead")
    shared = scratch.write(members.join(buckets, "key").select("key", "doc_id", "lead"), "shared")
    pairs = shared.where("doc_id <> lead").select(F.col("lead").alias("u"), F.col("doc_id").alias("v")).distinct()
    side = reps.select("doc_id", "n_shingles", "registers", "bands")
    own = side.drop("bands")
    met = pairs.join(own.toDF("u", "n_u", "reg_u"), "u").join(own.toDF("v", "n_v", "reg_v"), "v")
    likely = scratch.write(met.mapInArrow(_likely, "u bigint, v bigint"), "likely")
    # Sets of documents that share a bucket, once. The join is by sorting at every size, as both sides grow.
    some = shared.select("doc_id").distinct().hint("merge")
    sets = scratch.write(docs.join(some, "doc_id", "left_semi").mapInArrow(_as_sets, "doc_id bigint, shingles binary"), "sets", compression="none")
    links = _verified(likely, sets, scratch, "links-0")

    # Members of a bucket in different components: first their nearest few, so that families close up; then all that are left.
    tested, now = likely, None
    for wave, top in enumerate((4, None), 1):
        now = joined_components(now, links, scratch, f"wave-{wave}")
        placed = shared.join(now.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        placed = scratch.write(placed.select("key", "doc_id", "component"), f"placed-{wave}")
        split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        apart = placed.join(split, "key", "left_semi")
        if top:
            apart = apart.join(side, "doc_id")
        else:
            far = sets.join(apart.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_long_sketches, "doc_id bigint, registers binary")
            apart = apart.join(side.drop("registers"), "doc_id").join(far, "doc_id")
        apart = apart.select("key", "doc_id", "n_shingles", "registers", "bands", "component")
        made = apart.repartition("key").sortWithinPartitions("key").mapInArrow(_apart(top), "u bigint, v bigint").distinct()
        rest = scratch.write(made.join(tested, ["u", "v"], "left_anti"), f"rest-{wave}")
        links = _verified(rest, sets, scratch, f"links-{wave}")
        tested = tested.unionByName(rest)
        scratch.drop(f"placed-{wave}")
    found = joined_components(now, links, scratch, "all").toDF("doc_id", "component_id")
    # copies follow their class's least document, so a class of very many is no star
    followed = copies.join(found.toDF("a", "component_id"), "a", "left").select(F.col("b").alias("doc_id"), F.coalesce("component_id", "a").alias("component_id")).distinct()
    found = found.unionByName(followed)
    result = sketches.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one of each group."""
    gone = groups(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("gone_doc_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["gone_doc_id"], "left_anti")
