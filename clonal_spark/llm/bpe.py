"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database per Python worker.

Texts become remembered pieces (see _pieces); the words of new pieces become token-position rows. A
recursive query joins neighbouring tokens with the merge table and contracts each word's leftmost
minimum-rank pair until no pair is left. Words longer than LONG_WORD bytes go through a second form of
the query, which contracts in one round all those occurrences of the minimum-rank pair that the
one-at-a-time order would contract next to each other; its rounds grow with the distinct ranks, not
with the length. Words longer than STITCH bytes are encoded in chunks, which meet pair by pair: a list of tokens is
a text's encoding exactly if every two neighbours are that of their joined bytes, so where two chunks meet
a widening stretch of tokens is encoded anew until its neighbours on both sides stay. Decoding joins ids with the vocabulary and aggregates bytes in position order.

The merge table holds every split of a token into two tokens, as ranks of concatenations decide merges.

Defined results: a null text is an empty one with no ids; repeated rows are encoded each; ids are those
of the rank file, without special tokens; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clonal_spark.llm import _pieces, _text
from clonal_spark.llm._pieces import Pieces, Ragged

LONG_WORD = 128
#: Bytes from which a word is encoded in chunks, and those of a chunk.
STITCH, PART = 1024, 96
#: Words, and bytes of words, that one query takes.
QUERY_WORDS, QUERY_BYTES = 30_000, 300_000
#: Bytes of texts that are worked on at once, and pieces that a worker remembers beside its database.
SLAB, MEMORY_PIECES = 2 << 20, 500_000

_ENCODE = """
WITH RECURSIVE step(w, pos, tok, best) AS (
  SELECT w, pos, tok, min(CASE WHEN r IS NOT NULL THEN r::BIGINT << 32 | pos END) OVER (PARTITION BY w)
  FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM start) s
  LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
  UNION ALL
  SELECT w, pos, tok, min(CASE WHEN r IS NOT NULL THEN r::BIGINT << 32 | pos END) OVER (PARTITION BY w)
  FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt
        FROM (SELECT w, pos, CASE WHEN pos = best & 4294967295 THEN (best >> 32)::INTEGER ELSE tok END AS tok,
                     lag(pos) OVER (PARTITION BY w ORDER BY pos) = best & 4294967295 AS gone
              FROM step WHERE best IS NOT NULL)
        WHERE gone IS NOT TRUE) s
  LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt)
SELECT w, pos, tok FROM step WHERE best IS NULL ORDER BY w, pos
"""

# take: occurrences of the least rank, every second one where they overlap; a contraction that makes a
# pair of lower rank ends the round for its word, as that pair comes first.
_ENCODE_LONG = """
WITH RECURSIVE step(w, pos, tok, r, least) AS (
  SELECT w, pos, tok, r, min(r) OVER (PARTITION BY w)
  FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM start) s
  LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
  UNION ALL
  (WITH numbered AS (
     SELECT w, pos, tok, least, r IS NOT DISTINCT FROM least AS hit, row_number() OVER (PARTITION BY w ORDER BY pos) AS i
     FROM step WHERE least IS NOT NULL),
   runs AS (
     SELECT *, i - row_number() OVER (PARTITION BY w, hit ORDER BY i) AS run FROM numbered),
   chosen AS (
     SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY i) % 2 = 1 AS take FROM runs),
   seen AS (
     SELECT *, lag(tok) OVER o AS before, lag(take, 2) OVER o AS pair_before, lead(tok, 2) OVER o AS after
     FROM chosen WINDOW o AS (PARTITION BY w ORDER BY i)),
   judged AS (
     SELECT s.*, min(CASE WHEN take AND (x.r < least OR y.r < least) THEN i END) OVER (PARTITION BY s.w) AS last_one
     FROM seen s
     LEFT JOIN merges x ON s.take AND x.a = CASE WHEN pair_before THEN least ELSE before END AND x.b = s.least
     LEFT JOIN merges y ON s.take AND y.a = s.least AND y.b = s.after),
   done AS (
     SELECT w, pos, i, CASE WHEN take AND i <= coalesce(last_one, i) THEN least ELSE tok END AS tok,
            lag(take AND i <= coalesce(last_one, i)) OVER (PARTITION BY w ORDER BY i) AS gone
     FROM judged)
   SELECT w, pos, tok, r, min(r) OVER (PARTITION BY w)
   FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM done WHERE gone IS NOT TRUE) s
   LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt))
SELECT w, pos, tok FROM step WHERE least IS NULL ORDER BY w, pos
"""

_DECODE = "SELECT g, unhex(string_agg(hex, '' ORDER BY i)) AS bytes FROM ids JOIN vocabulary USING (tok) GROUP BY g ORDER BY g"


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Bpe:
    def __init__(self, ranks_file: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(ranks_file)
        self.pattern = regex.compile(pattern)
        self.single = np.zeros(256, np.int32)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*splits, strict=True))
        self._table("merges", pa.table({"a": a, "b": b, "r": r}))
        self._table("vocabulary", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
        shown = Ragged(np.uint8)
        size = max(ranks.values()) + 1
        shown.put(np.arange(size), np.frombuffer("".join(f" {i}" for i in range(size)).encode(), np.uint8), np.array([len(f" {i}") for i in range(size)]))
        self.shown = shown
        self.pieces, self.ids, self.bytes = Pieces(), Ragged(np.uint32), Ragged(np.uint8)
        self.token = {r: t for t, r in ranks.items()}
        self.stays: dict[tuple[int, int], bool] = {}

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids of non-empty words, and how many each has."""
        long = [i for i, w in enumerate(words) if len(w) > STITCH]
        if not long:
            return self._contracted(words)
        which = set(long)
        ids, n = self._contracted([w for i, w in enumerate(words) if i not in which])
        lists = dict(zip(long, self._stitched([words[i] for i in long]), strict=True))
        rest = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
        every = [lists[i] if i in which else next(rest) for i in range(len(words))]
        return np.concatenate(every).astype(np.uint32), np.fromiter(map(len, every), np.int64, len(every))

    def _lists(self, words: list[bytes]) -> list[list[int]]:
        ids, n = self._contracted(words)
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if words else []

    def _stitched(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, from those of its chunks; in each round neighbours meet, of all words at once."""
        cut = [[w[i : i + PART] for i in range(0, len(w), PART)] for w in words]
        made = iter(self._lists([c for chunks in cut for c in chunks]))
        rows = [[next(made) for _ in chunks] for chunks in cut]
        while any(len(r) > 1 for r in rows):
            met = iter(self._meet([(r[k], r[k + 1]) for r in rows for k in range(0, len(r) - 1, 2)]))
            rows = [[next(met) for _ in range(len(r) // 2)] + r[len(r) // 2 * 2 :] for r in rows]
        return [r[0] for r in rows]

    def _meet(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        out: list[list[int]] = [a + b for a, b in pairs]
        left = [p for p, ok in enumerate(self._stay([(a[-1], b[0]) for a, b in pairs])) if not ok]
        width = 2
        while left:
            between = self._lists([b"".join(map(self.token.__getitem__, pairs[p][0][-width:] + pairs[p][1][:width])) for p in left])
            edges: list[tuple[int, int]] = []
            owners: list[int] = []
            for p, m in zip(left, between, strict=True):
                a, b = pairs[p]
                out[p] = a[:-width] + m + b[width:]
                for pair in ((a[-width - 1], m[0]) if len(a) > width else None, (m[-1], b[width]) if len(b) > width else None):
                    if pair:
                        edges.append(pair)
                        owners.append(p)
            left = sorted({p for p, ok in zip(owners, self._stay(edges), strict=True) if not ok})
            width *= 2
        return out

    def _stay(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether two tokens are the encoding of their joined bytes."""
        new = sorted({p for p in pairs if p not in self.stays})
        if len(self.stays) > MEMORY_PIECES:
            self.stays.clear()
            new = sorted(set(pairs))
        self.stays |= {p: got == list(p) for p, got in zip(new, self._lists([self.token[a] + self.token[b] for a, b in new]), strict=True)}
        return [self.stays[p] for p in pairs]

    def _contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for chosen, query in ((np.flatnonzero(lengths <= LONG_WORD), _ENCODE), (np.flatnonzero(lengths > LONG_WORD), _ENCODE_LONG)):
            total = np.cumsum(lengths[chosen])
            lo = 0
            while lo < len(chosen):
                hi = min(lo + QUERY_WORDS, max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + QUERY_BYTES, "right"))))
                some = chosen[lo:hi]
                flat = np.frombuffer(b"".join([words[i] for i in some]), np.uint8)
                rows = pa.table({"w": np.repeat(some.astype(np.int32), lengths[some]), "pos": np.arange(len(flat), dtype=np.int32), "tok": self.single[flat]})
                self.db.register("start", rows)
                got = self.db.execute(query).fetchnumpy()
                parts.append((np.asarray(got["w"]), np.asarray(got["tok"])))
                lo = hi
        w = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        tok = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
        order = np.argsort(w, kind="stable")
        return tok[order].astype(np.uint32), np.bincount(w, minlength=len(words))

    def decoded(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined bytes of id lists, and how many each has."""
        out, sizes, lo = [], np.zeros(len(lengths), np.int64), 0
        ends = np.cumsum(lengths)
        while lo < len(lengths):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4 * QUERY_BYTES, "right")))
            first = int(ends[lo - 1]) if lo else 0
            part = ids[first : ends[hi - 1]]
            self.db.register("ids", pa.table({"g": np.repeat(np.arange(lo, hi, dtype=np.int32), lengths[lo:hi]), "i": np.arange(len(part), dtype=np.int32), "tok": part.astype(np.int32)}))
            got = self.db.execute(_DECODE).fetchnumpy()
            column = [bytes(x) for x in got["bytes"]]
            sizes[np.asarray(got["g"])] = [len(x) for x in column]
            out.extend(column)
            lo = hi
        return np.frombuffer(b"".join(out), np.uint8), sizes

    def _learn(self, new: list[bytes], indexes: np.ndarray) -> None:
        """Pieces of several words are put together from their words, which are remembered as pieces too."""
        found = [self.pattern.findall(p.decode()) for p in new]
        single = np.array([len(ws) == 1 for ws in found], bool)
        several = [ws for ws in found if len(ws) > 1]
        words = [w.encode() for ws in several for w in ws]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        h = _pieces.hashed(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends) if words else np.zeros(0, np.uint64)
        members = self.pieces.find(h)
        missing = np.flatnonzero(members < 0)
        fresh, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
        more = self.pieces.add(fresh)
        members[missing] = more[back]
        todo = [p for p, s in zip(new, single.tolist(), strict=True) if s] + [words[i] for i in missing[one].tolist()]
        at = np.concatenate([indexes[single], more])
        ids, lengths = self.words(todo)
        self.ids.put(at, ids, lengths)
        self.bytes.put(at, *self.decoded(ids, lengths))
        owners = np.repeat(np.arange(len(several)), [len(ws) for ws in several])
        for table in (self.ids, self.bytes):
            flat, each = table.gather(members)
            table.put(indexes[~single], flat, np.bincount(owners, each, len(several)).astype(np.int64))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Joined ids of a slab's texts and how many each has, then the same of the decoded bytes."""
        if self.pieces.count > MEMORY_PIECES:
            self.pieces, (self.ids, self.bytes) = _pieces.forgetting(self.pieces, [self.ids, self.bytes], MEMORY_PIECES)
        starts, first = _pieces.cut(data, offsets)
        ends = np.append(starts[1:], len(data))
        h = _pieces.hashed(data, starts, ends)
        which = self.pieces.find(h)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            indexes = self.pieces.add(new)
            which[missing] = indexes[back]
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(starts[missing[one]].tolist(), ends[missing[one]].tolist(), strict=True)], indexes)
        self.pieces.meet(which)
        out = []
        for table in (self.ids, self.bytes):
            flat, lengths = table.gather(which)
            out += [flat, np.diff(np.concatenate([[0], np.cumsum(lengths)])[first])]
        return tuple(out)


_BPES: dict[tuple[str, str], Bpe] = {}

DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _bpe(ranks_file: str, pattern: str) -> Bpe:
    if (ranks_file, pattern) not in _BPES:
        _BPES[ranks_file, pattern] = Bpe(ranks_file, pattern)
    return _BPES[ranks_file, pattern]


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids its ids. A map over the scan."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _text.release()  # of tasks of other kinds that this worker had
        bpe = _bpe(ranks_file, pattern)
        for batch in batches:
            for slab in _text.slabs(batch.column(1), SLAB):
                ids, n_ids, raw, n_raw = bpe.encode(slab.data, slab.offsets)
                rows, j = [], 0
                shown, lengths = bpe.shown.gather(ids)
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_ids)])].tolist()
                for k, m in enumerate(n_raw.tolist()):
                    rows.append((hashlib.sha256(shown[ends[k] + 1 : ends[k + 1]]).hexdigest(), hashlib.sha256(raw[j : j + m]).hexdigest()))
                    j += m
                columns = [batch.column(0)[slab.first : slab.first + len(n_ids)], pa.array(n_ids), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ids)]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        _text.release()

    schema = f"doc_id {kind}, {DIGESTS}" + (", ids array<int>" if with_ids else "")
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
