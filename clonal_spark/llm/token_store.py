"""Token-ID / binary output: a content-addressed store of id streams.

A rolling hash over the last WINDOW ids cuts each document's ids into chunks, wherever it falls below a
threshold, so equal passages give equal chunks. A chunk is named by the digest of its bytes and stored
once. Recipes hold each document's chunk names in ascending doc_id order with a Merkle root over them;
each recipe shard's manifest has the Merkle root over its documents.

Files below the store's folder:
  chunks/    Parquet: digest, n_ids, ids (unsigned little-endian, 16 bits where the vocabulary allows)
  recipes/   Parquet, sorted by doc_id: doc_id, start, n_tokens, digests (16 bytes each), root
  manifest/  Parquet: shard, first and last doc_id, documents, ids, root

Reading back checks each shard's recipes against its manifest; `read_digests` also checks every chunk's bytes against
its name once, and every recipe's root; a document's CRC is combined from its chunks' CRCs, so a chunk of many copies is read once. `documents_of` gives whole
id lists, of chunks as they are. A mismatch raises, so a damaged store cannot pass.

Defined results: a null text is an empty one and has the end id only; rows with the same doc_id each
keep a row, in the order of their roots; a null doc_id comes first.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonal_spark.llm import _pieces, _text
from clonal_spark.llm._pieces import Pieces, Ragged
from clonal_spark.session import Scratch

END_ID = 0
#: The cut needs a hash below 2 ** 32 / MEAN_IDS and MIN_IDS since the last; MAX_IDS cuts in any case.
WINDOW, MIN_IDS, MEAN_IDS, MAX_IDS = 8, 256, 768, 8192
DIGEST_BYTES = 16
#: Documents whose leaves are one row on the way to a shard's root.
BLOCK_LEAVES = 4096

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece once while it is remembered."""

    def __init__(self, file: str, plain_added: bool = True, memory: int = _pieces.MEMORY_PIECES):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.added = [] if plain_added else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # of pieces; texts that hold an added token are encoded as they are
        # a token's characters stand for one byte each
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)
        self.pieces, self.ids = Pieces(), Ragged()

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, indexes: np.ndarray) -> None:
        """Pieces that start with a space and a non-space are encoded many at a time: their words stay apart."""
        raw, n = data.tobytes(), len(data)
        joined = (data[starts] == 0x20) & (ends - starts > 1) & _pieces._SOLID[data[np.minimum(starts + 1, n - 1)]]
        for lo in range(0, len(starts), 50_000):
            part = slice(lo, lo + 50_000)
            many, own = np.flatnonzero(joined[part]) + lo, np.flatnonzero(~joined[part]) + lo
            bounds = list(zip(starts[many].tolist(), ends[many].tolist(), strict=True))
            texts = [b"".join([raw[a:b] for a, b in bounds[i : i + 500]]).decode() for i in range(0, len(bounds), 500)]
            flat = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            reached, stop = np.cumsum(self.bytes[flat]), np.cumsum(ends[many] - starts[many])
            stops = np.searchsorted(reached, stop) + 1
            if len(stop) and not np.array_equal(reached[stops - 1], stop):
                raise ValueError("the tokenizer is not byte-level")
            self.ids.put(indexes[many], flat, np.diff(stops, prepend=0))
            texts = [raw[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.ids.put(indexes[own], np.fromiter((i for x in lists for i in x), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids of a slab's texts, and how many each has."""
        if self.pieces.count > self.memory:
            self.pieces, (self.ids,) = _pieces.forgetting(self.pieces, [self.ids], self.memory)
        starts, first = _pieces.cut(data, offsets)
        ends = np.append(starts[1:], len(data))
        h = _pieces.hashed(data, starts, ends)
        which = self.pieces.find(h)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            indexes = self.pieces.add(new)
            which[missing] = indexes[back]
            self._learn(data, starts[missing[one]], ends[missing[one]], indexes)
        self.pieces.meet(which)
        ids, lengths = self.ids.gather(which)
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[first])
        return self._with_added(data, offsets, ids, counts) if self.added else (ids, counts)

    def _with_added(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, but texts that hold an added token's string as the library encodes them by default."""
        raw, holders = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[doc + 1]:
                    holders.add(doc)
                    at = raw.find(token, int(offsets[doc + 1]))
                else:
                    at = raw.find(token, at + 1)
        if not holders:
            return ids, counts
        self.tokenizer.encode_special_tokens = False
        ends, counts, parts, last = np.cumsum(counts), counts.copy(), [], 0
        for doc in sorted(holders):
            whole = self.tokenizer.encode(raw[offsets[doc] : offsets[doc + 1]].decode(), add_special_tokens=False).ids
            parts += [ids[last : ends[doc] - counts[doc]], np.array(whole, ids.dtype)]
            last, counts[doc] = ends[doc], len(whole)
        self.tokenizer.encode_special_tokens = True
        return np.concatenate([*parts, ids[last:]]), counts


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of chunks that the rolling hash of the last WINDOW ids proposes."""
    gear = _GEAR[ids & 0xFFFF]
    h = gear.copy()
    for j in range(1, min(WINDOW, len(ids))):
        h[j:] += gear[: len(ids) - j] << np.uint32(3 * j)
    return np.flatnonzero(h < (1 << 32) // MEAN_IDS) + 1


def cuts(proposed: np.ndarray, a: int, b: int) -> list[int]:
    """Ends of the chunks of ids[a:b]: proposals that leave MIN_IDS since the last, MAX_IDS in any case. MIN_IDS
    exceeds WINDOW, so no hash that counts has seen another document's ids."""
    out, last = [], a
    while b - last > MIN_IDS:
        k = int(np.searchsorted(proposed, last + MIN_IDS))
        last = min(int(proposed[k]) if k < len(proposed) else b, last + MAX_IDS, b)
        out.append(last)
    if last < b:
        out.append(b)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairwise digests up to one; a lone last node goes up as it is."""
    nodes = leaves or [b""]
    while len(nodes) > 1:
        nodes = [hashlib.sha256(b"".join(nodes[i : i + 2])).digest()[:DIGEST_BYTES] if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return hashlib.sha256(b"root" + nodes[0]).digest()[:DIGEST_BYTES]


def crc_combine(a: int, b: int, n: int) -> int:
    """The CRC-32 of two joined byte strings from their CRCs and the second one's length."""
    return b ^ _shift(a, n)


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


_SHIFTS: list[tuple[list[int], list[list[int]]]] = []


def _shift(crc: int, n: int) -> int:
    """crc after n zero bytes, by squared operators, each as four tables of bytes."""
    k = 0
    while n >> k:
        if k >= len(_SHIFTS):
            if _SHIFTS:
                m = _SHIFTS[-1][0]
                m = [_times(m, c) for c in m]
            else:  # one zero bit, squared to a byte
                m = [0xEDB88320, *(1 << i for i in range(31))]
                for _ in range(3):
                    m = [_times(m, c) for c in m]
            _SHIFTS.append((m, [[_times(m, v << 8 * j) for v in range(256)] for j in range(4)]))
        if n >> k & 1:
            a, b, c, d = _SHIFTS[k][1]
            crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]
        k += 1
    return crc


def _chunked(tokenizer_file: str, wide: bool, plain_added: bool):
    kind = "<u4" if wide else "<u2"
    named = (tokenizer_file, plain_added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if named not in _ENCODERS:
            _ENCODERS[named] = Encoder(*named)
        encoder = _ENCODERS[named]
        if not wide and len(encoder.bytes) > 1 << 16:
            raise ValueError("ids of this vocabulary need wide=True")
        here: set[bytes] = set()  # chunks that this task has sent already
        for batch in batches:
            for slab in _text.slabs(batch.column(1)):
                flat, counts = encoder.encode(slab.data, slab.offsets)
                n_docs = len(counts)
                # every document's ids with the end behind them
                ends = np.cumsum(counts + 1)
                ids = np.full(int(ends[-1]), END_ID, kind)
                inside = np.ones(len(ids), bool)
                inside[ends - 1] = False
                ids[inside] = flat
                proposed = marks(ids)
                digests, roots, chunks, chunk_counts = [], [], [], np.zeros(n_docs + 1, np.int32)
                for i, (a, b) in enumerate(zip((ends - counts - 1).tolist(), ends.tolist(), strict=True)):
                    names, last = [], a
                    for end in cuts(proposed, a, b):
                        raw = ids[last:end].tobytes()
                        name = hashlib.sha256(raw).digest()[:DIGEST_BYTES]
                        names.append(name)
                        if name not in here:
                            if len(here) > 300_000:
                                here.clear()
                            here.add(name)
                            chunks.append((name, raw))
                        last = end
                    chunk_counts[i + 1] = len(chunks)
                    digests.append(b"".join(names))
                    roots.append(merkle_root(names))
                sent = pa.StructArray.from_arrays([pa.array([c[0] for c in chunks], pa.binary()), pa.array([c[1] for c in chunks], pa.binary())], ["digest", "ids"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[slab.first : slab.first + n_docs], pa.array(counts + 1), pa.array(digests, pa.binary()), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(pa.array(chunk_counts), sent)],
                    names=["doc_id", "n_tokens", "digests", "root", "chunks"],
                )

    return run


def write_store(docs: DataFrame, scratch: Scratch, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", wide: bool = False, plain_added: bool = True) -> None:
    """Encodes whole texts, ends each document with END_ID, and writes chunks, recipes and manifest. plain_added: the
    strings of the tokenizer's added tokens are ordinary text; else they are those tokens, as by the library's default."""
    kind = dict(docs.dtypes)[id_col]
    encoded = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_chunked(tokenizer_file, wide, plain_added), f"doc_id {kind}, n_tokens bigint, digests binary, root binary, chunks array<struct<digest:binary,ids:binary>>")
    plain = {"parquet.enable.dictionary": "false"}  # payloads do not repeat
    staged = scratch.write(encoded, "staged", compression="snappy", **plain)
    unique = staged.select(F.explode("chunks").alias("c")).select("c.*").groupBy("digest").agg(F.first("ids").alias("ids"))
    unique.withColumn("n_ids", F.floor(F.length("ids") / (4 if wide else 2)).cast("long")).write.options(compression="zstd", **plain).parquet(scratch.path("chunks"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = staged.select("doc_id", "n_tokens", "digests", "root").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    placed = scratch.write(ordered.withColumn("shard", F.spark_partition_id()), "placed", compression="zstd")
    # One row per shard comes to the driver: their number is set by the partitions, not by the documents.
    totals = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    before, starts = 0, []
    for shard in sorted(totals):
        starts.append((shard, before))
        before += totals[shard]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(starts or [(0, 0)], "shard int, shard_start long"))
    within = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, 0)
    recipes = placed.join(offsets, "shard").withColumn("start", F.col("shard_start") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
    recipes = scratch.write(recipes.select("doc_id", "start", "n_tokens", "digests", "root", "shard"), "recipes", compression="zstd")
    scratch.drop("staged")
    scratch.drop("placed")
    _manifest(recipes).write.parquet(scratch.path("manifest"))


def _manifest(recipes: DataFrame) -> DataFrame:
    """A row per shard. Leaves are digests of a document's doc_id, start and root, in their order; BLOCK_LEAVES of them at a
    time have a root, and the shard's root is over these, so no row grows with a shard's documents but by 16 bytes a block."""
    order = Window.partitionBy("shard").orderBy("start", F.col("doc_id").cast("string").asc_nulls_first(), "root")
    leaf = F.struct("start", F.col("doc_id").cast("string").alias("doc_id"), "root")
    placed = recipes.select("shard", "doc_id", "n_tokens", leaf.alias("leaf"), F.floor((F.row_number().over(order) - 1) / BLOCK_LEAVES).alias("block"))
    blocks = placed.groupBy("shard", "block").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"), F.sort_array(F.collect_list("leaf")).alias("leaves"))
    root = F.udf(lambda leaves: merkle_root([hashlib.sha256(f"{r.start} {r.doc_id!r} ".encode() + bytes(r.root)).digest()[:DIGEST_BYTES] for r in leaves]), "binary")
    over = F.udf(lambda roots: merkle_root([bytes(r.root) for r in roots]), "binary")
    rooted = blocks.select("shard", "first_doc", "last_doc", "n_docs", "n_ids", F.struct("block", root("leaves").alias("root")).alias("part"))
    shards = rooted.groupBy("shard").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"), F.sort_array(F.collect_list("part")).alias("parts"))
    return shards.withColumn("root", over("parts")).drop("parts")


def _check_manifest(spark: SparkSession, scratch: Scratch, recipes: DataFrame) -> None:
    """Raises where a shard's recipes are not those that its manifest was made of."""
    kept = spark.read.parquet(scratch.path("manifest"))
    facts = [c for c in kept.columns if c != "shard"]
    both = kept.select("shard", F.struct(*facts).alias("kept")).join(_manifest(recipes).select("shard", F.struct(*facts).alias("now")), "shard", "full_outer")
    if off := both.where(~F.col("kept").eqNullSafe(F.col("now"))).select("shard").head():
        raise ValueError(f"the manifest of shard {off.shard} does not give its root, documents and ids")


def _checked_chunks(wide: bool):
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, ns = [], []
            for digest, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(raw).digest()[:DIGEST_BYTES] != digest:
                    raise ValueError("a chunk's bytes differ from its name")
                ids = np.frombuffer(raw, kind).astype("<u4")
                crcs.append(zlib.crc32(ids.tobytes()))
                ns.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(ns, pa.int64())], names=["digest", "crc", "n_ids"])

    return run


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for start, n_tokens, root, parts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            if merkle_root([p["digest"] for p in parts]) != root or sum(p["n_ids"] for p in parts) != n_tokens:
                raise ValueError(f"the recipe at {start} does not give its root")
            crc = 0
            for p in parts:
                crc = crc_combine(crc, p["crc"], 4 * p["n_ids"])
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64()), pa.array([len(p) for p in batch.column(4).to_pylist()], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])


def references(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each recipe."""
    count = (F.length("digests") / DIGEST_BYTES).cast("int")
    places = recipes.withColumn("seq", F.explode(F.sequence(F.lit(0), count - 1)))
    return places.withColumn("digest", F.expr(f"substring(digests, seq * {DIGEST_BYTES} + 1, {DIGEST_BYTES})")).drop("digests")


def read_digests(spark: SparkSession, scratch: Scratch, wide: bool = False) -> DataFrame:
    """From the store's files: doc_id, start, n_tokens, ids_crc32, n_chunks, all verified. Copies of a
    chunk meet its one small row (digest, crc, length); AQE splits a digest that many recipes share."""
    recipes = spark.read.parquet(scratch.path("recipes"))
    _check_manifest(spark, scratch, recipes)
    chunks = spark.read.parquet(scratch.path("chunks")).select("digest", "ids").mapInArrow(_checked_chunks(wide), "digest binary, crc bigint, n_ids bigint")
    met = references(recipes).join(chunks, "digest", "left")
    parts = F.sort_array(F.collect_list(F.struct("seq", "digest", F.coalesce("crc", F.lit(-1).cast("long")).alias("crc"), F.coalesce("n_ids", F.lit(0).cast("long")).alias("n_ids"))))
    whole = met.groupBy("doc_id", "start", "n_tokens", "root").agg(parts.alias("parts"))
    kind = dict(recipes.dtypes)["doc_id"]
    return whole.mapInArrow(_combined, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, n_chunks bigint")


def documents_of(spark: SparkSession, scratch: Scratch, wide: bool = False) -> DataFrame:
    """Whole id lists from the store: doc_id, start, ids."""
    size = 4 if wide else 2
    recipes = spark.read.parquet(scratch.path("recipes"))
    _check_manifest(spark, scratch, recipes)
    met = references(recipes).join(spark.read.parquet(scratch.path("chunks")), "digest")
    whole = met.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2)
            ids = np.frombuffer(b"".join(parts.flatten().field(1).to_pylist()), "<u4" if size == 4 else "<u2")
            n_ids = np.fromiter((len(x) // size for x in parts.flatten().field(1).to_pylist()), np.int64)
            ends = np.concatenate([[0], np.cumsum(n_ids)])[np.concatenate([[0], np.cumsum(pa.compute.list_value_length(parts).to_numpy())])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return whole.mapInArrow(run, f"doc_id {dict(recipes.dtypes)['doc_id']}, start bigint, ids array<bigint>")
