"""Texts as indexes of remembered pieces, for encoders that split text at a byte-level pattern.

The pattern's words are an optional space and a run of letters, digits or marks, or runs of white space. So
a text can be cut, whatever stands around, before a space that a non-space follows, before white space that
follows a non-space, between a letter or digit and a full stop or comma, and behind a lone line feed before
a non-space: words and their ids stay the same. Where bytes do not show what a character is, there is no
cut. Pieces recur; each distinct one is encoded once per Python worker while it is remembered. Pieces are
told apart by 64-bit hashes, in a table with open addressing that is searched for whole slabs at once."""

from __future__ import annotations

import numpy as np

from clonal_spark.llm import _text

#: Distinct pieces that a worker remembers; beyond it, it keeps those it met in more than one call.
MEMORY_PIECES = 1_300_000

_byte = np.arange(256)
_SPACE, _SOFT, _HARDLY, _WHITE, _POINT, _ALNUM, _FEED = (1 << i for i in range(7))
_white = (_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D))
#: First bytes of characters that are no white space for certain; last bytes of such are below 0x80.
_solid = ((_byte > 0x20) & (_byte < 0x7F)) | ((_byte >= 0xC3) & (_byte <= 0xDF)) | (_byte >= 0xE4)
_hard = (_byte > 0x20) & (_byte < 0x7F)
_SOLID = _solid
_KINDS = sum(
    flag * mask.astype(np.uint8)
    for flag, mask in (
        (_SPACE, _byte == 0x20), (_SOFT, _solid), (_HARDLY, _hard), (_WHITE, _white), (_POINT, (_byte == ord(".")) | (_byte == ord(","))),
        (_ALNUM, np.array([chr(i).isalnum() and i < 128 for i in range(256)])), (_FEED, _byte == 0x0A),
    )
).astype(np.uint8)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of a slab, and the first piece of each document."""
    n = len(data)
    cuts = np.zeros(n + 1, bool)
    if n > 1:
        kinds = _KINDS[data]
        here, then = kinds[:-1], kinds[1:]
        solid = then & _SOFT  # of the byte behind
        inner = offsets[(offsets > 0) & (offsets < n)]
        solid[inner - 1] = 0  # what follows is of another document
        # bits are moved so that a product of two conditions is one "and"
        cuts[: n - 1] = (here & (solid >> 1) & _SPACE).view(bool)
        behind = ((then >> 1) & here & _HARDLY) | ((then << 1) & here & _ALNUM)  # white after hard; point after letter or digit
        cuts[1:n] |= behind != 0
        cuts[2:n] |= ((here[1:] >> 4) & here[:-1] & (solid[1:] << 1) & _HARDLY) != 0
    cuts[offsets] = True
    starts = np.flatnonzero(cuts[:n])
    return starts, np.searchsorted(starts, offsets)


class Pieces:
    """Index of each remembered hash."""

    def __init__(self, room: int = 1 << 16):
        self.keys, self.at = np.zeros(room, np.uint64), np.zeros(room, np.int32)
        self.count = 0
        self.hashes = np.zeros(room, np.uint64)
        self.met = np.zeros(room, np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indexes, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        place = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        key = self.keys[place]
        hit = key == h
        out[hit] = self.at[place[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        while len(left):
            place[left] = (place[left] + 1) & int(mask)
            key = self.keys[place[left]]
            hit = key == h[left]
            out[left[hit]] = self.at[place[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Indexes of distinct hashes that are not there yet."""
        new = np.arange(self.count, self.count + len(h), dtype=np.int32)
        if self.count + len(h) > len(self.hashes):
            more = max(len(self.hashes) // 2, len(h))
            self.hashes, self.met = np.concatenate([self.hashes, np.zeros(more, np.uint64)]), np.concatenate([self.met, np.zeros(more, np.uint8)])
        self.hashes[new] = h
        self.count += len(h)
        if self.count * 3 > len(self.keys) * 2:
            room = len(self.keys)
            while self.count * 3 > room * 2:
                room *= 2
            self.keys, self.at = np.zeros(room, np.uint64), np.zeros(room, np.int32)
            self._place(self.hashes[: self.count], np.arange(self.count, dtype=np.int32))
        else:
            self._place(h, new)
        return new

    def _place(self, h: np.ndarray, index: np.ndarray) -> None:
        mask = len(self.keys) - 1
        place = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[place[left]] == 0]
            self.keys[place[free]] = h[free]  # of several at one place, one stays
            mine = self.keys[place[left]] == h[left]
            self.at[place[left[mine]]] = index[left[mine]]
            left = left[~mine]
            place[left] = (place[left] + 1) & mask

    def meet(self, which: np.ndarray) -> None:
        """Notes a call's indexes; `often` are those of more than one call."""
        which = np.flatnonzero(np.bincount(which, minlength=self.count))
        self.met[which] = np.minimum(self.met[which] + 1, 2)

    def often(self) -> np.ndarray:
        return np.flatnonzero(self.met[: self.count] == 2)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.maximum(_text.ranges_hash(data, starts, ends, _text._VALUE), np.uint64(1))


class Ragged:
    """Integer lists by index, joined in one array."""

    def __init__(self, kind=np.uint32):
        self.flat, self.filled = np.zeros(1 << 16, kind), 0
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def put(self, indexes: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        if self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 2, len(flat)), self.flat.dtype)])
        if len(indexes) and (most := int(indexes.max()) + 1) > len(self.starts):
            grown = max(most - len(self.starts), len(self.starts) // 2)
            self.starts = np.concatenate([self.starts, np.zeros(grown, np.int64)])
            self.lengths = np.concatenate([self.lengths, np.zeros(grown, np.int32)])
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.starts[indexes] = self.filled + np.cumsum(lengths) - lengths
        self.lengths[indexes] = lengths
        self.filled += len(flat)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of which, joined, and their lengths."""
        lengths = self.lengths[which].astype(np.int64)
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[which] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.flat[at], lengths

    def kept(self, which: np.ndarray) -> Ragged:
        """A new one with only the lists of which, under new indexes."""
        out = Ragged(self.flat.dtype)
        out.put(np.arange(len(which)), *self.gather(which))
        return out


def forgetting(pieces: Pieces, tables: list[Ragged], most: int) -> tuple[Pieces, list[Ragged]]:
    """What remains of the memory: pieces met in more than one call, if they are few enough."""
    often = pieces.often()
    if len(often) > most * 3 // 4:
        often = often[:0]
    out = Pieces()
    out.add(pieces.hashes[often])
    return out, [t.kept(often) for t in tables]
