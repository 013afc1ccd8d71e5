"""Suffix-array dedup by column-wise multi-document construction.

Bytes are removed that a string of LENGTH bytes covers which also starts anywhere else. Several lengths can be
judged at once. Every window of the least length has one anchor: the leftmost of its SEED-byte strings with the
least hash. Equal windows have equal anchors at equal offsets, and a longer window begins with one of the least
length, so only fragments around equal anchors (as far back as such a window may start, and the greatest length
ahead) can hold them; an anchor seen once is done with. Equal fragments are one text with a count.

Fragments that share an anchor but differ are a collection for column-wise construction: they stand aligned
at the anchor, and in each round, from the last column to the first, one symbol of every fragment is put in
front of its suffix. The collection's order is updated by a stable sort on that symbol, and common prefixes
of neighbours by range minima, so each round is a sequential pass. Columns lie in an external file of the
task (deleted with it); in memory there are some 40 bytes per fragment. An anchor of more than SPLIT different
fragments is not one task's: its windows are parted by where they start, into halves. All windows of a half share the
bytes between its last start and its first end, so these bytes are a key of their own; fragments are cut to what
the half can cover, equal ones become one again, and halves of too many fragments are halved further. A suffix whose common prefix with a neighbour in
the order reaches a length marks a window that also starts in another fragment.

Defined results: texts are UTF-8 bytes, a null is empty; matches never cross documents; a repeated row is
another document with the same text, so both lose what they share; rows are told apart by a 64-bit hash of
id and text; anchors and fragments by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.llm import _text
from clonal_spark.session import Scratch

LENGTH, SEED = 400, 32
#: A passage of over 50 words has this many bytes at least, unless its words have less than three letters on average.
PASSAGE = 200
WIDTH = LENGTH - SEED + LENGTH
#: Fragments after which a collection is worked on, at the next anchor.
COLLECTION = 60_000
#: Different fragments of an anchor that one task takes.
SPLIT = 20_000


def _prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of weighed bytes, and the weights' inverses: hash(a, b) = (sums[b] - sums[a]) * inverse[a]."""
    n = len(data)
    weights, inverse = _text._upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_text._VALUE[data] * weights[:n], out=sums[1:])
    return sums, inverse


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of width values: running minima within blocks, forwards and backwards."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = (LENGTH,)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slab: document, place in the slab, seed hash and fragment hash of each anchor. A fragment's lowest
    bit says whether it has the greatest length."""
    none = np.zeros(0, np.int64)
    length, longest = min(lengths), max(lengths)
    if len(data) < length:
        return none, none, none, none
    sums, inverse = _prefix_hashes(data)
    seeds = _text.mix((sums[SEED:] - sums[:-SEED]) * inverse[: len(data) - SEED + 1])
    keyed = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
    least = sliding_minimum(keyed, length - SEED + 1)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ok = np.arange(len(least)) + length <= offsets[1:][doc[: len(least)]]
    at = (least[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    d = doc[at]
    low, high = np.maximum(at - (length - SEED), offsets[:-1][d]), np.minimum(at + longest, offsets[1:][d])
    whole = _text.mix((sums[high] - sums[low]) * inverse[low] + (at - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (high - low).astype(np.uint64))
    whole = whole & ~np.uint64(1) | (high - low >= longest).astype(np.uint64)
    return d, at, seeds[at].view(np.int64), whole.view(np.int64)


def _anchored(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for slab in _text.slabs(batch.column(1)):
                d, at, seed, whole = anchors(slab.data, slab.offsets, lengths)
                yield pa.RecordBatch.from_arrays([pa.array(keys[slab.first + d]), pa.array(seed), pa.array(whole), pa.array((at - slab.offsets[:-1][d]).astype(np.int32))], names=["row_key", "seed", "fragment", "place"])
        _text.release()

    return run


#: Rows whose texts are Python objects at once.
ROWS = 1000


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _cut(lengths: tuple[int, ...]):
    """Rows (text, [(seed, fragment, place)]) to one row per fragment: seed, fragment, from_column, bytes."""
    before, longest = min(lengths) - SEED, max(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            seeds, wholes, texts, froms = [], [], [], []
            for text, wanted in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    at = w["place"]
                    seeds.append(w["seed"])
                    wholes.append(w["fragment"])
                    texts.append(text[max(0, at - before) : at + longest])
                    froms.append(max(0, before - at))
                    if len(seeds) == 4096:
                        yield _cut_batch(seeds, wholes, froms, texts)
                        seeds, wholes, texts, froms = [], [], [], []
            if seeds:
                yield _cut_batch(seeds, wholes, froms, texts)
        _text.release()

    return run


def _cut_batch(seeds, wholes, froms, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(wholes, pa.int64()), pa.array(froms, pa.int32()), pa.array(texts, pa.binary())], names=["seed", "fragment", "from_column", "bytes"])


class Collection:
    """Aligned fragments in a column file: blocks of WIDTH columns by the block's fragments."""

    def __init__(self, folder: str, width: int = WIDTH, lengths: tuple[int, ...] = (LENGTH,)):
        self.width, self.lengths = width, lengths
        self.file = open(os.path.join(folder, "columns"), "w+b")  # noqa: SIM115
        self.blocks: list[tuple[int, int]] = []
        self.groups: list[np.ndarray] = []
        self.spans: list[np.ndarray] = []
        self.names: list[np.ndarray] = []
        self.n = 0

    def add(self, groups: np.ndarray, names: np.ndarray, froms: np.ndarray, texts: list[bytes]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        block = np.zeros((len(texts), self.width), np.uint8)
        row = np.repeat(np.arange(len(texts)), sizes)
        ends = np.cumsum(sizes)
        column = np.arange(int(ends[-1])) - np.repeat(ends - sizes - froms, sizes)
        block[row, column] = np.frombuffer(b"".join(texts), np.uint8)
        self.blocks.append((self.file.tell(), len(texts)))
        self.file.write(np.ascontiguousarray(block.T).tobytes())
        self.groups.append(groups)
        self.names.append(names)
        self.spans.append(np.stack([froms, froms + sizes]).astype(np.int32))
        self.n += len(texts)

    def column(self, c: int) -> np.ndarray:
        parts = []
        for at, n in self.blocks:
            self.file.seek(at + c * n)
            parts.append(np.frombuffer(self.file.read(n), np.uint8))
        return np.concatenate(parts)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """As `marked`, for the first of the lengths."""
        return self.marked()[0]

    def marked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, first and last column of each fragment at which a window starts that another one of
        its group shares; first > last where there is none. All these windows hold the anchor."""
        self.file.flush()
        n = self.n
        group = np.concatenate(self.groups)
        spans = np.concatenate(self.spans, 1)
        out = [(np.full(n, self.width, np.int32), np.full(n, -1, np.int32)) for _ in self.lengths]
        _, dense = np.unique(group, return_inverse=True)
        order = np.argsort(dense, kind="stable")  # fragments by group, then by suffix
        at_group = dense[order]
        begins = np.append(True, at_group[1:] != at_group[:-1])
        rank_group = np.cumsum(begins) - 1  # the same for every round
        common = np.zeros(n, np.int32)  # with the one before in the order
        for c in range(self.width - 1, -1, -1):
            symbols = self.column(c)[order].astype(np.int16)
            here = (spans[0][order] <= c) & (c < spans[1][order])
            symbols[~here] = 256
            # One symbol in front: stable by (group, symbol). Groups keep their places, so sort by symbol, then by group.
            by_symbol = np.argsort(symbols, kind="stable")
            moved = by_symbol[np.argsort(rank_group[by_symbol], kind="stable")]
            now = symbols[moved]
            same = np.zeros(n, bool)
            same[1:] = (now[1:] == now[:-1]) & (rank_group[1:] == rank_group[:-1]) & (now[1:] != 256)
            grown = np.zeros(n, np.int32)
            rows = np.flatnonzero(same)
            if len(rows):
                a, b = moved[rows - 1] + 1, moved[rows] + 1  # range minima over the old order
                near = b - a == 1
                grown[rows[near]] = common[a[near]] + 1
                far = np.flatnonzero(~near)
                if len(far):
                    edges = np.stack([a[far], b[far]], 1).ravel()
                    grown[rows[far]] = np.minimum.reduceat(np.append(common, 0), edges)[::2] + 1
            order, common = order[moved], grown
            if c <= self.width - max(self.lengths):
                for length, (first, last) in zip(self.lengths, out, strict=True):
                    best = common >= length
                    hit = best.copy()
                    hit[:-1] |= best[1:]
                    found = order[hit]
                    first[found] = c
                    last[found] = np.maximum(last[found], c)
        return out


def _constructed(lengths: tuple[int, ...]):
    """Fragments in the order of their seeds to the columns covered: fragment, length, low, high."""
    width = min(lengths) - SEED + max(lengths)

    def done(some: Collection) -> pa.RecordBatch:
        names, rows = np.concatenate(some.names), []
        for length, (first, last) in zip(lengths, some.marked(), strict=True):
            hit = np.flatnonzero(first <= last)
            rows.append((names[hit], np.full(len(hit), length, np.int32), first[hit], last[hit] + np.int32(length)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["fragment", "length", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.TemporaryDirectory()
        try:
            some, open_seed = Collection(folder.name, width, lengths), None
            for batch in batches:
                seeds = batch.column(0).to_numpy()
                lo = 0
                while lo < len(seeds):
                    hi = min(lo + 4096, len(seeds))
                    if some.n >= COLLECTION:  # go on up to the end of the last seed only
                        hi = lo + int(np.searchsorted(seeds[lo:] != open_seed, True))
                        if hi == lo:
                            yield done(some)
                            some.file.close()
                            some = Collection(folder.name, width, lengths)
                            continue
                        hi = min(hi, lo + 4096)
                    some.add(seeds[lo:hi], batch.column(1).to_numpy()[lo:hi], batch.column(2).to_numpy()[lo:hi].astype(np.int64), batch.column(3)[lo:hi].to_pylist())
                    open_seed = seeds[hi - 1]
                    lo = hi
            if some.n:
                yield done(some)
            some.file.close()
        finally:
            folder.cleanup()
        some = None
        _text.release()

    return run


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(p if isinstance(p, bytes) else int(p).to_bytes(8, "little", signed=True) for p in parts), digest_size=8).digest(), "little", signed=True)


def _halved(lengths: tuple[int, ...]):
    """Fragments (name, part, lo, hi, from_column, bytes), whose windows start in [lo, hi), to what either half of these
    starts can cover: name, part and child (names of the half's key and of the cut fragment), and the same columns."""
    short, longest = min(lengths), max(lengths)
    names = ["name", "part", "child", "lo", "hi", "from_column", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, part, lo, hi, first, raw in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                mid, end = (lo + hi) // 2, first + len(raw)
                for a, b in ((lo, mid), (mid, hi)):
                    if a == b or first > b - 1 or end < a + short:
                        continue
                    left, right = max(first, a), min(end, b - 1 + longest)
                    key = _hash(part, a, raw[b - 1 - first : a + short - first])
                    cut = raw[left - first : right - first]
                    rows.append((name, key, _hash(key, left, cut), a, b, left, cut))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _split(items: DataFrame, scratch: Scratch, lengths: tuple[int, ...]) -> DataFrame:
    """Marks (fragment, length, low, high) of fragments of hot anchors: name, part, lo, hi, from_column, bytes."""
    short, links, marks = min(lengths), [], []
    row = lambda rows, length, high: rows.select("child", F.lit(length).alias("length"), F.col("from_column").alias("low"), high.cast("int").alias("high"))
    while True:
        level = len(links)
        halves = scratch.write(items.mapInArrow(_halved(lengths), "name bigint, part bigint, child bigint, lo int, hi int, from_column int, bytes binary"), f"halves-{level}")
        links.append(halves.select("name", "child"))
        same = halves.groupBy("part", "child").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("lo", "hi", "from_column", "bytes")])
        same = scratch.write(same, f"same-{level}")
        several = same.join(same.groupBy("part").agg(F.count("*").alias("fragments")).where("fragments > 1"), "part")
        last = lambda length: F.least(F.col("hi") - 1, F.col("from_column") + F.length("bytes") - length)
        # cut fragments that stand more than once, and of a single start all that share its shortest window
        found = [row(same.where((F.col("n") > 1) & (last(x) >= F.col("from_column"))), x, last(x) + x) for x in lengths]
        found.append(row(several.where("hi - lo = 1"), short, F.col("lo") + short))
        rest = several.where("hi - lo > 1")
        built = rest.where(F.col("fragments") <= SPLIT).select(F.col("part").alias("seed"), F.col("child").alias("fragment"), "from_column", "bytes")
        found.append(_built(built, lengths).withColumnRenamed("fragment", "child"))
        union = found[0]
        for f in found[1:]:
            union = union.unionByName(f)
        marks.append(scratch.write(union, f"marks-{level}"))
        items = rest.where(F.col("fragments") > SPLIT).select(F.col("child").alias("name"), "part", "lo", "hi", "from_column", "bytes")
        if items.isEmpty():
            break
    out = None
    for link, own in zip(reversed(links), reversed(marks), strict=True):
        own = own if out is None else own.unionByName(out.withColumnRenamed("name", "child"))
        out = link.join(own, "child").select("name", "length", "low", "high").distinct()
    return out.withColumnRenamed("name", "fragment")


def _built(cut: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Column-wise construction over (seed, fragment, from_column, bytes)."""
    parted = cut.repartition("seed").sortWithinPartitions("seed")
    return parted.mapInArrow(_constructed(lengths), "fragment bigint, length int, low int, high int")


def spans_of(docs: DataFrame, scratch: Scratch, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """Rows (row_key, length, low, high) of covered bytes, from docs (row_key, text). Spans may overlap."""
    before, longest = min(lengths) - SEED, max(lengths)
    found = scratch.write(docs.mapInArrow(_anchored(lengths), "row_key bigint, seed bigint, fragment bigint, place int"), "anchors", compression="none")
    # Equal fragments meet in partial aggregates, so an anchor of very many equal ones is one row a task.
    classes = found.groupBy("fragment").agg(F.first("seed").alias("seed"), F.count("*").alias("n"), F.min("row_key").alias("row_key"), F.min_by("place", "row_key").alias("place"))
    several = classes.groupBy("seed").agg(F.count("*").alias("fragments")).where("fragments > 1")
    classes = classes.join(several, "seed", "left").where("n > 1 OR fragments > 1")
    classes = scratch.write(classes.select("fragment", "seed", "n", "row_key", "place", F.coalesce("fragments", F.lit(0)).alias("fragments")), "classes", compression="none")

    def cut(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("row_key").agg(F.collect_list(F.struct("seed", "fragment", "place")).alias("wanted"))
        # rows with the same id and text are equal, so any one of them serves
        texts = docs.join(wanted, "row_key").dropDuplicates(["row_key"]).select("text", "wanted")
        return texts.mapInArrow(_cut(lengths), "seed bigint, fragment bigint, from_column int, bytes binary")

    marked = _built(cut(classes.where(F.col("fragments").between(1, SPLIT))), lengths)
    hot = classes.where(F.col("fragments") > SPLIT)
    if not hot.isEmpty():
        start = [F.col("fragment").alias("name"), F.col("seed").alias("part"), F.lit(0).alias("lo"), F.lit(before + 1).alias("hi"), "from_column", "bytes"]
        marked = marked.unionByName(_split(cut(hot).select(*start), scratch, lengths))
    # a text that stands more than once is covered as a whole
    whole = classes.where("n > 1").select("fragment", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("length")).where((F.col("length") < longest) | (F.col("fragment") % 2 != 0))
    whole = whole.select("fragment", "length", F.lit(0).alias("low"), (F.lit(before) + F.col("length")).alias("high"))
    spans = whole.unionByName(marked).groupBy("fragment", "length").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = scratch.write(spans, "spans", compression="none")
    at = F.col("place") - before
    return found.select("row_key", "fragment", "place").join(spans, "fragment").select("row_key", "length", F.greatest(at + F.col("low"), F.lit(0)).alias("low"), (at + F.col("high")).alias("high"))


def _grouped(spans: DataFrame) -> DataFrame:
    """A row for each row_key; spans of repeated rows, which are equal, count once."""
    return spans.groupBy("row_key").agg(F.collect_set(F.struct("length", "low", "high")).alias("spans"))


def _merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def _runs(spans: list[dict] | None, length: int, n: int) -> list[tuple[int, int]]:
    return _merged([(s["low"], s["high"]) for s in spans or [] if s["length"] == length], n)


def _left(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, last = [], 0
    for a, b in runs:
        parts.append(text[last:a])
        last = b
    parts.append(text[last:])
    return b"".join(parts)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(F.xxhash64(docs[id_col], text).alias("row_key"), docs[id_col].alias("doc_id"), text.alias("text"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False, passages: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with_spans the removed byte ranges, and with
    passages (a number of bytes) n_passage_bytes: those that strings of that length cover which also start elsewhere."""
    scratch = Scratch(docs.sparkSession, "column-bwt")
    keyed = _keyed(docs, id_col, text_col)
    spans = _grouped(spans_of(keyed.select("row_key", "text"), scratch, (LENGTH, *([passages] if passages else []))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows, ranges, shorter = [], [], []
            for text, found in zip(batch.column(1).fill_null("").cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = _runs(found, LENGTH, len(text))
                left = _left(text, runs)
                rows.append((len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
                ranges.append([{"low": a, "high": b} for a, b in runs])
                shorter.append(sum(b - a for a, b in _runs(found, passages, len(text))) if passages else 0)
            cols = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_spans:
                arrays.append(pa.array(ranges, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))))
                names.append("spans")
            if passages:
                arrays.append(pa.array(shorter, pa.int64()))
                names.append("n_passage_bytes")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        _text.release()

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", spans array<struct<low:int,high:int>>" if with_spans else "") + (", n_passage_bytes bigint" if passages else "")
    return keyed.join(spans, "row_key", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = None, length: int = LENGTH) -> DataFrame:
    """The documents without the bytes that repeated strings of the length cover, with all their columns; a null text
    stays null. Cuts may fall within a character: incomplete UTF-8 at a cut is dropped. n_chars_col: a column that
    follows the text's length."""
    scratch = Scratch(docs.sparkSession, "column-bwt")
    keyed = _keyed(docs, id_col, text_col).select("row_key", "text")
    spans = _grouped(spans_of(keyed, scratch, (length,)))
    names = docs.columns
    rows = docs.select(F.xxhash64(docs[id_col], docs[text_col].cast("string")).alias("row_key"), docs[text_col].cast("string").alias("text"), F.struct(*[docs[c] for c in names if c != text_col]).alias("others"))
    joined = rows.join(spans, "row_key", "left").select("others", "text", "spans")

    def cut_text(text: str | None, spans: list[dict] | None) -> str | None:
        if not text or not spans:
            return text
        raw = text.encode()
        return _left(raw, _runs(spans, length, len(raw))).decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            out = [cut_text(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["others", "text"])
        _text.release()

    kind = joined.schema["others"].dataType.simpleString()
    cut = joined.mapInArrow(run, f"others {kind}, text string")
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col(f"others.`{n_chars_col}`")).cast(docs.schema[n_chars_col].dataType).alias(n_chars_col) if n_chars_col in names else None
    columns = [F.col("text").alias(text_col) if c == text_col else length if c == n_chars_col else F.col(f"others.`{c}`") for c in names]
    return cut.select(*columns)
