"""Cross-tokenizer alignment by an event sweep.

Tokenizer A is byte-level (a tokenizers file) and encodes a space and the text; tokenizer B is a SentencePiece model,
which puts that space itself. Every token is an event at the byte where it ends. Events of both sides are one table,
packed in blocks of BLOCK consecutive tokens (a block's offset is the byte where it starts); rows are dealt out by
document, sorted by document and offset within partitions, and streamed through a machine.

The machine keeps the tokens of either side behind the last byte where both ended, and the running digest of the document
that is open: nothing else, however long a document is. As both sides end at a document's end, a partition is one stream
of bytes to it. A byte where both sides end closes a group; every byte where some side ends is one link, since the bytes
between two neighbouring ends lie in one token of each side, and the common bytes of two tokens hold no further end.

How often a pair of ids is linked is counted over all documents. The counts come back to the documents in slices of about
SLICE_PAIRS pairs, so what is broadcast is bounded whatever the number of pairs: more slices are more passes over
the links.

Defined results: a null or empty text, or one whose tokens' bytes are not the space and the text (a tokenizer that
normalises, an unknown piece), has no tokens: zeros, and '' for the digest. Rows with the same doc_id are documents of
their own; a null doc_id stays null."""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.llm import _text
from clonal_spark.llm._pieces import Pieces, Ragged
from clonal_spark.llm.token_store import Encoder
from clonal_spark.session import Scratch

#: Tokens of a block of events; tokens that the machine works on at once; characters of a text that B encodes at once.
BLOCK, HELD, LONG = 4096, 200_000, 200_000
#: Bytes and rows of text that are encoded at once; pieces whose ids a worker remembers.
SLAB, ROWS, REMEMBERED = 1 << 20, 1000, 300_000
#: Pairs of ids whose counts are broadcast at once.
SLICE_PAIRS = 1 << 20

_A, _B = 0, 1


def _characters() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _table(pieces: list[bytes]) -> Ragged:
    out = Ragged(np.uint8)
    out.put(np.arange(len(pieces)), np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]))
    return out


class ByteLevel:
    """Tokenizer A: ids of slabs, and each id's bytes."""

    def __init__(self, file: str):
        self.encoder = Encoder(file, memory=REMEMBERED)
        vocabulary, chars = self.encoder.tokenizer.get_vocab(with_added_tokens=False), _characters()
        self.bytes = [b""] * self.encoder.tokenizer.get_vocab_size()
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.table = _table(self.bytes)

    def encode(self, slab: _text.Slab) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.encoder.encode(slab.data, slab.offsets)
        return ids.astype(np.int64), counts

    def forget(self) -> None:
        """Drops the remembered pieces: a worker that has encoded may go on with tasks that do not."""
        if self.encoder.pieces.count:
            self.encoder.pieces, self.encoder.ids = Pieces(), Ragged()
            _text.release()


class SentencePieces:
    """Tokenizer B: the same. The slab's texts start with the space that the model puts itself."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        count = self.model.get_piece_size()
        self.bytes = []
        for i in range(count):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.table = _table(self.bytes)
        # A piece has spaces at its start only, so words part anywhere before a space and are the same alone.
        self.apart = not any(" " in p.decode("utf-8", "ignore").lstrip(" ") for p in self.bytes)

    def parts(self, text: str) -> list[str]:
        """A long text in parts; the space in front of each but the first is the one that the model puts."""
        out, start = [], 0
        while self.apart and len(text) - start > LONG and (cut := re.compile("(?<=[^ ]) ").search(text, start + LONG)):
            out.append(text[start : cut.start()])
            start = cut.end()
        return [*out, text[start:]]

    def encode(self, slab: _text.Slab) -> tuple[np.ndarray, np.ndarray]:
        raw, at = slab.data.tobytes(), slab.offsets.tolist()
        texts = [self.parts(raw[a + 1 : b].decode()) for a, b in itertools.pairwise(at)]
        lists = self.model.encode(list(itertools.chain.from_iterable(texts)), num_threads=1)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(lengths.sum()))
        ends = np.cumsum([len(t) for t in texts])
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends], prepend=0)


_OPEN: dict[tuple[str, str], tuple[ByteLevel, SentencePieces]] = {}


def tokenizers(a_file: str, b_file: str) -> tuple[ByteLevel, SentencePieces]:
    """A worker's tokenizers, read once."""
    if (a_file, b_file) not in _OPEN:
        _OPEN[a_file, b_file] = ByteLevel(a_file), SentencePieces(b_file)
    return _OPEN[a_file, b_file]


def _whole(table: Ragged, ids: np.ndarray, counts: np.ndarray, slab: _text.Slab) -> np.ndarray:
    """Which documents' tokens join to their bytes."""
    joined, lengths = table.gather(ids)
    if len(joined) == len(slab.data) and np.array_equal(joined, slab.data):
        reached = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        if np.array_equal(reached, slab.offsets[1:]):
            return np.ones(len(counts), bool)
    stop = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    return np.array([np.array_equal(joined[a:b], slab.data[c:d]) for (a, b), (c, d) in zip(itertools.pairwise(stop.tolist()), itertools.pairwise(slab.offsets.tolist()), strict=True)], bool)


def _blocks(table: Ragged, ids: np.ndarray, counts: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Blocks of a side's events: their documents, offsets and packed ids."""
    n = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(counts) - counts)[doc] + nth * BLOCK
    length = np.minimum(counts[doc] - nth * BLOCK, BLOCK)
    reached = np.concatenate([[0], np.cumsum(table.lengths[ids].astype(np.int64))])
    offset = reached[first] - reached[(np.cumsum(counts) - counts)[doc]]
    width = np.dtype(kind).itemsize
    ends = np.concatenate([[0], np.cumsum(length * width)]).astype(np.int32)
    return doc, offset, pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))])


def _events(a_file: str, b_file: str, kind: str):
    """Documents to events of both sides. A document without tokens has one block without events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tokenizers(a_file, b_file)
        base, made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
        slabs = 0
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            texts = batch.column(1).fill_null("")
            for slab in _text.slabs(pc.binary_join_element_wise(" ", texts, ""), SLAB):
                n, slabs = len(slab.offsets) - 1, slabs + 1
                if slabs % 16 == 0:
                    _text.release()
                found = [side.encode(slab) for side in sides]
                good = np.diff(slab.offsets) > 1
                for side, (ids, counts) in zip(sides, found, strict=True):
                    good &= _whole(side.table, ids, counts, slab)
                keys, names = np.arange(made, made + n) + base, batch.column(0)[slab.first : slab.first + n]
                made += n
                for which, (side, (ids, counts)) in enumerate(zip(sides, found, strict=True)):
                    ids, counts = ids[np.repeat(good, counts)], np.where(good, counts, 0)
                    doc, offset, packed = _blocks(side.table, ids, counts, kind)
                    if which == _A and not good.all():
                        bad = np.flatnonzero(~good)
                        doc, offset = np.append(doc, bad), np.append(offset, np.zeros(len(bad), np.int64))
                        packed = pa.concat_arrays([packed, pa.array([b""] * len(bad), pa.binary())])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[doc]), names.take(pa.array(doc)), pa.array(offset), pa.array(np.full(len(doc), which, np.int32)), packed], names=["row_key", "doc_id", "offset", "side", "ids"])
        _text.release()

    return run


def events(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """End events of both tokenizers, dealt out by document and sorted by offset: row_key, doc_id, offset, side (0: A,
    1: B), ids (little-endian unsigned, of 16 bits where both vocabularies allow)."""
    wide = max(len(t.bytes) for t in tokenizers(a_file, b_file)) > 1 << 16
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(_events(a_file, b_file, "<u4" if wide else "<u2"), f"row_key bigint, doc_id {kind}, offset bigint, side int, ids binary")
    return found.repartition("row_key").sortWithinPartitions("row_key", "offset", "side")


@dataclass
class Step:
    """What the machine has settled at once. a, b: ids; a_doc, b_doc, group_doc: which of the documents at hand a token or
    group is of; a_group, b_group: numbers of groups, from 0 on; link_a, link_b: indexes of the linked tokens."""

    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_doc: np.ndarray


def sweep(a: np.ndarray, b: np.ndarray, a_doc: np.ndarray, b_doc: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[Step, int, int]:
    """Settles both streams up to the last byte where both sides end; the tokens of either side that this takes."""
    ends_a, ends_b = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
    room = int(max(ends_a[-1] if len(a) else 0, ends_b[-1] if len(b) else 0)) + 1
    at_a, at_b = np.zeros(room, np.int8), np.zeros(room, np.int8)
    at_a[ends_a], at_b[ends_b] = 1, 1
    both = at_a & at_b
    closed = np.flatnonzero(both)
    stop = int(closed[-1]) + 1 if len(closed) else 0
    n_a, n_b = int(np.searchsorted(ends_a, stop)), int(np.searchsorted(ends_b, stop))
    ends_a, ends_b = ends_a[:n_a], ends_b[:n_b]
    some = np.flatnonzero(at_a[:stop] | at_b[:stop])
    before = np.cumsum(both[:stop], dtype=np.int32)
    group = lambda ends: before[ends] - both[ends]
    link_a = np.cumsum(at_a[:stop], dtype=np.int32)[some] - at_a[some]
    link_b = np.cumsum(at_b[:stop], dtype=np.int32)[some] - at_b[some]
    a_group = group(ends_a)
    return Step(a[:n_a], b[:n_b], a_doc[:n_a], b_doc[:n_b], a_group, group(ends_b), link_a, link_b, a_doc[:n_a][both[ends_a].astype(bool)]), n_a, n_b


def _digits(most: int) -> np.ndarray:
    """Each number's decimal digits, behind zero bytes."""
    width = len(str(most))
    n = np.arange(most + 1)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    return np.where(n > 0, n % 10 + ord("0"), 0).astype(np.uint8)


class Writer:
    """The text a1,a2|b1;a3|b2,b3 of steps."""

    def __init__(self, a_most: int, b_most: int):
        self.digits = _digits(max(a_most, b_most))
        self.digits[0, -1] = ord("0")

    def write(self, s: Step, n_docs: int, begun: bool) -> list[memoryview]:
        """Bytes of each document; begun: the first one has groups before these."""
        groups = len(s.group_doc)
        b_in, a_in = np.cumsum(np.bincount(s.b_group, minlength=groups)), np.cumsum(np.bincount(s.a_group, minlength=groups))
        rows = np.zeros((len(s.a) + len(s.b), self.digits.shape[1] + 1), np.uint8)
        b_before = np.append(0, b_in)[s.a_group] if groups else np.zeros(0, np.int64)
        at_a, at_b = np.arange(len(s.a)) + b_before, np.arange(len(s.b)) + (a_in[s.b_group] if groups else np.zeros(0, np.int64))
        first_a, first_b = np.diff(s.a_group, prepend=-1) > 0, np.diff(s.b_group, prepend=-1) > 0
        opens = np.diff(s.a_doc, prepend=-1) > 0
        if begun and len(opens) and s.a_doc[0] == 0:
            opens[0] = False
        rows[at_a, 1:], rows[at_b, 1:] = self.digits[s.a], self.digits[s.b]
        rows[at_a, 0] = np.where(opens, 0, np.where(first_a, ord(";"), ord(",")))
        rows[at_b, 0] = np.where(first_b, ord("|"), ord(","))
        there = rows != 0
        written = np.cumsum(np.append(0, there.sum(1)))
        tokens = np.cumsum(np.bincount(s.a_doc, minlength=n_docs) + np.bincount(s.b_doc, minlength=n_docs))
        bounds = written[np.append(0, tokens)].tolist()
        text = memoryview(rows[there].tobytes())
        return [text[x:y] for x, y in itertools.pairwise(bounds)]


@dataclass
class Open:
    """The document that may go on in the next rows."""

    key: int | None = None
    doc_id: pa.Array | None = None
    sums: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    digest: Callable = field(default_factory=hashlib.sha256)
    a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _portions(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about HELD events at most."""
    ids = batch.column("ids")
    at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + HELD * width, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Joined ids of packed blocks, and how many each has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data.view(kind).astype(np.int64), np.diff(at) // width


def _machine(a_file: str, b_file: str, kind: str):
    """Sorted events to rows per document: its counts and digest once it has ended, and its distinct links so far. Links of a
    document that is open when others end come in a row of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = tokenizers(a_file, b_file)
        side_a.forget()
        n_ids = len(side_b.bytes)
        len_a, len_b = (np.array([len(x) for x in s.bytes], np.int64) for s in (side_a, side_b))
        writer = Writer(len(side_a.bytes) - 1, n_ids - 1)
        small = np.int32 if len(side_a.bytes) * n_ids < 1 << 31 else np.int64
        last = Open()

        def rows(keys, names, sums, digests, ended, starts, pairs, times) -> pa.RecordBatch:
            zero = np.where(ended[:, None], sums, 0)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(x))
            return pa.RecordBatch.from_arrays([pa.array(keys), names, *[pa.array(zero[:, i]) for i in range(4)], pa.array(digests, pa.string()), lists(pairs.astype(small)), lists(times.astype(np.int32))], names=["row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        def finished(x: Open) -> pa.RecordBatch:
            if len(x.a) or len(x.b):
                raise ValueError("a document's sides end at different bytes")
            digest = x.digest.hexdigest() if x.sums[0] else ""
            return rows(np.array([x.key]), x.doc_id, x.sums[None, :], [digest], np.array([True]), np.zeros(2), np.zeros(0), np.zeros(0))

        for whole in batches:
            for batch in _portions(whole, np.dtype(kind).itemsize):
                keys = batch.column("row_key").to_numpy()
                if last.key is not None and keys[0] != last.key:
                    yield finished(last)
                    last = Open()
                new = np.append(True, keys[1:] != keys[:-1])
                run_of, first = np.cumsum(new) - 1, np.flatnonzero(new)
                n = len(first)
                streams = []
                for which, held in ((_A, last.a), (_B, last.b)):
                    mine = np.flatnonzero(batch.column("side").to_numpy() == which)
                    ids, counts = _ids(batch.column("ids").take(pa.array(mine)), kind)
                    streams += [np.concatenate([held, ids]), np.concatenate([np.zeros(len(held), np.int64), np.repeat(run_of[mine], counts)])]
                a, a_doc, b, b_doc = streams
                step, used_a, used_b = sweep(a, b, a_doc, b_doc, len_a, len_b)
                goes_on = last.key is not None
                sums = np.stack([np.bincount(x, minlength=n) for x in (step.a_doc, step.b_doc, step.group_doc, step.a_doc[step.link_a])], 1)
                texts = writer.write(step, n, goes_on and bool(last.sums[0]))
                pair = step.a_doc[step.link_a] * (len(side_a.bytes) * n_ids) + step.a[step.link_a] * n_ids + step.b[step.link_b]
                pair, times = np.unique(pair, return_counts=True)
                starts = np.searchsorted(pair, np.arange(n + 1) * (len(side_a.bytes) * n_ids))
                names = batch.column("doc_id").take(pa.array(first))
                digests: list[str | None] = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts[:-1]] + [None]
                if goes_on:
                    sums[0] += last.sums
                    last.digest.update(texts[0])
                    if n > 1:
                        digests[0] = last.digest.hexdigest() if sums[0, 0] else ""
                ended = np.arange(n) < n - 1
                if used_a < len(a) and a_doc[used_a] != n - 1 or used_b < len(b) and b_doc[used_b] != n - 1:
                    raise ValueError("a document's sides end at different bytes")
                yield rows(keys[first], names, sums, digests, ended, starts, pair % (len(side_a.bytes) * n_ids), times)
                if n > 1 or not goes_on:
                    last = Open(int(keys[-1]), names[-1:], digest=hashlib.sha256(texts[-1]))
                last.sums, last.a, last.b = sums[-1], a[used_a:], b[used_b:]
        if last.key is not None:
            yield finished(last)
        _text.release()

    return run


def _judged(keys, first: bool):
    """Links' counts from a slice of the pairs' counts, per row; the other columns come with the first slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = keys.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            found, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            where = np.minimum(np.searchsorted(pairs, found), max(len(pairs) - 1, 0))
            there = pairs[where] == found if len(pairs) else np.zeros(len(found), bool)
            n = np.where(there, counts[where], 0) if len(pairs) else np.zeros(len(found), np.int64)
            top = there & best[where] if len(pairs) else there
            per_row = lambda x: pa.array(_text.segment_sum(x, at[:-1], at[1:]))  # noqa: B023, E731
            others = [batch.column(c) if first else pa.array(np.zeros(batch.num_rows, np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")]
            digest = batch.column("groups_sha256") if first else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), *others, digest, per_row(times * top), per_row(times * n)], names=["row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return run


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, scratch, name = docs.sparkSession, Scratch(docs.sparkSession, "alignment"), uuid.uuid4().hex
    side_a, side_b = tokenizers(a_file, b_file)
    wide, n_ids = max(len(side_a.bytes), len(side_b.bytes)) > 1 << 16, len(side_b.bytes)
    pair_type = "int" if len(side_a.bytes) * n_ids < 1 << 31 else "bigint"
    found = events(docs, a_file, b_file, id_col, text_col)
    kind = dict(found.dtypes)["doc_id"]
    columns = f"row_key bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    links = found.mapInArrow(_machine(a_file, b_file, "<u4" if wide else "<u2"), f"{columns}, pairs array<{pair_type}>, times array<int>")
    links = scratch.write(links, f"links-{name}", compression="zstd")
    counts = scratch.write(links.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("n")), f"counts-{name}")
    by_b = counts.withColumn("b", F.col("pairs") % n_ids)
    most = by_b.groupBy("b").agg(F.max("n").alias("most"))
    judged = scratch.write(by_b.join(most, "b").select("pairs", "n", (F.col("n") == F.col("most")).alias("best")), f"judged-{name}")
    slices, parts = max(1, -(-judged.count() // SLICE_PAIRS)), []
    for k in range(slices):
        known = judged.where(F.pmod(F.hash("pairs"), F.lit(slices)) == k).toArrow().sort_by("pairs")
        sent = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pairs", "n", "best")))
        parts.append(links.mapInArrow(_judged(sent, k == 0), f"{columns}, n_best bigint, count_sum bigint"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return every.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256")).drop("row_key")


def _groups(a_file: str, b_file: str, kind: str):
    """Sorted events to groups: what `align` digests, as rows of up to HELD tokens of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = tokenizers(a_file, b_file)
        len_a, len_b = (np.array([len(x) for x in s.bytes], np.int64) for s in (side_a, side_b))
        key, held, at = None, [np.zeros(0, np.int64)] * 2, 0
        for whole in batches:
            for batch in _portions(whole, np.dtype(kind).itemsize):
                keys, side = batch.column("row_key").to_numpy(), batch.column("side").to_numpy()
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                for x, y in itertools.pairwise([*first.tolist(), len(keys)]):
                    if keys[x] != key:
                        key, held, at = keys[x], [np.zeros(0, np.int64)] * 2, 0
                    part = batch.slice(x, y - x)
                    a, b = (np.concatenate([held[w], _ids(part.column("ids").filter(pa.array(side[x:y] == w)), kind)[0]]) for w in (_A, _B))
                    step, used_a, used_b = sweep(a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), len_a, len_b)
                    held = [a[used_a:], b[used_b:]]
                    n = len(step.group_doc)
                    if not n:
                        continue
                    sizes = [np.bincount(g, minlength=n) for g in (step.a_group, step.b_group)]
                    inner = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(s)).astype(np.int32)), pa.array(ids.astype(np.int32))) for s, ids in zip(sizes, (step.a, step.b), strict=True)]
                    stops = at + np.cumsum(np.bincount(step.a_group, len_a[step.a], n)).astype(np.int64)
                    starts = np.append(at, stops[:-1])
                    at = int(stops[-1])
                    doc = part.column("doc_id").take(pa.array(np.zeros(n, np.int64)))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(starts - 1), pa.array(stops - 1), *inner], names=["doc_id", "start", "end", "a", "b"])

    return run


def groups(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves, one row each: doc_id, start, end (bytes of the text; the space in front is byte -1), a and b
    (ids in order)."""
    side_a, side_b = tokenizers(a_file, b_file)
    kind = "<u4" if max(len(side_a.bytes), len(side_b.bytes)) > 1 << 16 else "<u2"
    found = events(docs, a_file, b_file, id_col, text_col)
    return found.mapInArrow(_groups(a_file, b_file, kind), f"doc_id {dict(found.dtypes)['doc_id']}, start bigint, end bigint, a array<int>, b array<int>")
