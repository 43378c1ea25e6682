"""Whole texts as byte arrays: words, their hashes and the hashes of word windows, for whole Arrow batches at a time.

Everything here is a small vectorised helper for code that Spark calls per Arrow batch. Texts are split into blocks of a
bounded number of bytes; only a single text longer than a block makes a larger one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 6 << 20
_STEP = 1 << 20
_BASE_BYTES, _BASE_WORDS = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _flags(codes: Iterable[int], inside: bool) -> np.ndarray:
    out = np.full(256, not inside)
    out[list(codes)] = inside
    return out


#: True at bytes of words: [^\x20\x09-\x0D]+
SPACED = _flags([0x20, *range(0x09, 0x0E)], False)
#: True at bytes of words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = _flags([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, at least n of each."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=U64))
        if n > 4 * _STEP:  # too large to keep
            return out[0], out[1]
        _tables[base] = (out[0], out[1])
    return _tables[base]


@dataclass
class Block:
    rows: pa.RecordBatch
    data: np.ndarray  # bytes of all texts
    offs: np.ndarray  # of texts in data, one more than rows
    valid: np.ndarray  # text is not null

    def __len__(self) -> int:
        return len(self.offs) - 1

    def ints(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """An integer column with 0 at nulls, and where it is not null."""
        c = self.rows.column(name)
        return np.asarray(pc.fill_null(c, 0).cast(pa.int64())), np.asarray(pc.is_valid(c))

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def tags(self) -> np.ndarray:
        """CRC-32 of each text: tells apart rows that share an id."""
        return np.fromiter((zlib.crc32(self.data[a:b]) for a, b in zip(self.offs[:-1], self.offs[1:], strict=True)), np.uint32, len(self))


def blocks(batches: Iterable[pa.RecordBatch], column: str, budget: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most budget bytes of text, or of one longer text. Null texts count as empty."""
    held: list[pa.RecordBatch] = []
    size = 0

    def merged() -> Block:
        t = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        c = t.column(t.schema.get_field_index(column))
        valid = np.asarray(pc.is_valid(c))
        c = pc.fill_null(c.cast(pa.large_binary()), b"")
        if c.offset:
            c = pa.concat_arrays([c, c.slice(0, 0)])
        offs = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data = np.frombuffer(c.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
        return Block(t, data, offs - offs[0], valid)

    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())), 0)).astype(np.int64)
        at = 0
        total = np.cumsum(lengths)
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = int(np.searchsorted(total, done + budget - size, "right"))
            if to <= at:
                if held:
                    yield merged()
                    held, size = [], 0
                    continue
                to = at + 1
            held.append(batch.slice(at, to - at))
            size += int(total[to - 1] - done)
            at = to
    if held:
        yield merged()


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of bytes that table holds; none crosses from one text to the next."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    before[edge[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[edge[1:]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offs))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of data[starts[i]:ends[i]]; both ascend."""
    import hashlib

    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _STEP, "right")))
        hi = int(ends[j - 1])
        if hi - lo > _STEP:  # one very long word
            out[i] = int.from_bytes(hashlib.blake2b(data[lo:hi].tobytes(), digest_size=8).digest(), "little")
        else:
            up, down = powers(_BASE_BYTES, _STEP + 1)
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum((data[lo:hi].astype(U64) + U64(1)) * up[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of width words of each text: hash, text, position.

    short: a text with fewer words, but not none, has one window of all its words.
    """
    n = len(words)
    up, down = powers(_BASE_WORDS, n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(words * up[:n], out=sums[1:])
    counts = np.diff(first)
    k = np.maximum(counts - width + 1, 0)
    if short:
        k = np.where((counts > 0) & (counts < width), 1, k)
    text = np.repeat(np.arange(len(counts)), k)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
    at = first[:-1][text] + pos
    span = np.minimum(counts, width)[text]
    h = (sums[at + span] - sums[at]) * down[at]
    return mix(h + span.astype(U64) * U64(0xE7037ED1A0B428DB)), text, pos


def runs(pos: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals that windows of width at the sorted positions cover, cut at limit."""
    if not len(pos):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.flatnonzero(np.diff(pos) > width) + 1
    lo = pos[np.concatenate([[0], new])]
    hi = pos[np.concatenate([new - 1, [len(pos) - 1]])] + width
    return lo, np.minimum(hi, limit)
