"""Best-fit packing of token sequences: large items are matched, smaller ones fill the tightest gaps.

Where a piece goes depends on its length only, so the plan is made from the number of pieces of each length (as many
numbers as the capacity) and holds for any number of pieces. Pieces above a third of the capacity are matched greedily,
the longest first with the longest that still fits, at most two to a sequence; then shorter ones, longest first, go into
the sequence with the tightest gap that holds them, or a new one. Pieces of one length are numbered in Spark, and their
number says which sequence and offset they take.

Defined cases: null text counts as empty; an empty document is its end mark alone. Only documents longer than the
capacity are cut; all pieces but the last are then full. Rows that share an id are packed each on its own.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks
from .ranks import ranked
from .shared import thrifty, written

CAPACITY = 2048
END_ID = 0
#: Bytes of chunks and of their ids that a Python worker keeps, twice at most, and what an entry takes besides.
MEMO_BYTES, ENTRY_BYTES = 48 << 20, 200
#: The same where packing has the workers to itself: fewer chunks are encoded again.
ALONE_BYTES = 96 << 20


def byte_letters() -> list[str]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


class Encoder(dict):
    """Ids of chunks between white space, as little-endian 32-bit numbers, kept from text to text.

    No token of a tokenizer that drops white space spans any, so a text's ids are those of its chunks. Words of Latin-1
    letters are one piece for the tokenizer and go straight to its model; other chunks take its whole course.
    """

    def __init__(self, definition: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.memo_bytes = memo_bytes
        self.tokenizer = Tokenizer.from_str(definition)
        self.letters = byte_letters()
        self.held = 0
        self.older: dict[bytes, bytes] = {}  # what was kept before the last change; chunks in use move back

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) <= "\xff":
            ids = [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in text.lower().encode()]))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        return self._kept(chunk, self._ids(chunk) if ids is None else ids)

    def _ids(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(b".,;:!?")
        if core != chunk and core[-1:].isalpha() and b"<|" not in chunk:  # marks after a final letter are a piece of their own
            return self[core] + self[chunk[len(core) :]]
        return self._word(chunk)

    def _kept(self, chunk: bytes, ids: bytes) -> bytes:
        taken = len(chunk) + len(ids) + ENTRY_BYTES
        if self.held + taken > self.memo_bytes:
            self.older = dict(self)
            self.clear()
            self.held = 0
        if taken <= self.memo_bytes:
            self[chunk] = ids
            self.held += taken
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[int, Encoder] = {}


def _loaded(definition: str, memo_bytes: int) -> Encoder:
    key = hash((definition, memo_bytes))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition, memo_bytes)
    return _encoders[key]


def _tokenized(definition, capacity: int, keep_ids: bool, memo_bytes: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(definition.value, memo_bytes)
        end = np.array([END_ID], "<u4").tobytes()
        for block in blocks(batches, "_text", 2 << 20):
            base = random.getrandbits(38) << 24
            rows = []
            ids, known = block.ints("_id")
            for i in range(len(block)):
                own = encoder.encode(block.text(i)) + end
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    rows.append((int(ids[i]) if known[i] else None, piece, at // 4, len(part) // 4, zlib.crc32(part), base + len(rows), part if keep_ids else None))
            cols = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "at", "ids"])
        encoder.older = {}

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, past rank, first sequence, sequences, offset), and the number of sequences.

    Piece number r of a length goes, by its row, to sequence `first sequence + (r - first rank) % sequences`.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    third = capacity // 3
    kinds: list[tuple[int, list[tuple[int, int]], int]] = []  # gap, [(length, copies)], sequences
    top = capacity
    for a in range(capacity, third, -1):
        while left[a]:
            top = min(capacity - a, a)
            while top > third and not left[top]:
                top -= 1
            if top > third and (top != a or left[a] > 1):
                n = int(left[a] // 2 if top == a else min(left[a], left[top]))
                kinds.append((capacity - a - top, [(a, 2)] if top == a else [(a, 1), (top, 1)], n))
                left[a] -= n
                left[top] -= n
            elif top == a:  # a single one of this length: the next shorter may go with it
                n = 1
                b = a - 1
                while b > third and not left[b]:
                    b -= 1
                left[a] -= 1
                if b > third:
                    left[b] -= 1
                    kinds.append((capacity - a - b, [(a, 1), (b, 1)], 1))
                else:
                    kinds.append((capacity - a, [(a, 1)], 1))
            else:
                kinds.append((capacity - a, [(a, 1)], int(left[a])))
                left[a] = 0
    by_gap: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(capacity + 1)]
    for gap, parts, n in kinds:
        by_gap[gap].append((parts, n))
    for s in range(third, 0, -1):
        gap = s
        while left[s]:
            while gap < capacity and not by_gap[gap]:
                gap += 1
            if gap < capacity and by_gap[gap]:
                parts, n = by_gap[gap].pop()
            else:
                gap, parts, n = capacity, [], int(left[s])
            copies = gap // s
            full = int(min(n, left[s] // copies))
            if full:
                by_gap[gap - copies * s].append(([*parts, (s, copies)], full))
                left[s] -= full * copies
            if full < n:
                rest = int(left[s]) if left[s] < copies else 0
                if rest:
                    by_gap[gap - rest * s].append(([*parts, (s, rest)], 1))
                    left[s] = 0
                if parts and n - full - (1 if rest else 0):
                    by_gap[gap].append((parts, n - full - (1 if rest else 0)))
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for kind in by_gap:
        for parts, n in kind:
            offset = 0
            for length, copies in parts:
                for _ in range(copies):
                    rows.append((length, used[length], used[length] + n, sequence, n, offset))
                    used[length] += n
                    offset += length
            sequence += n
    out = np.array(rows, np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequence


def _placed(sent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        key = (rows[:, 0] << 48) + rows[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "_rank"))
            at = rows[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            keep = [c for c in b.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(at[:, 3] + (rank - at[:, 1]) % at[:, 4]), pa.array(at[:, 5])], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), with the piece's ids as bytes if keep_ids."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # the driver's copy goes to the workers
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    pieces = written(rows.mapInArrow(_tokenized(definition, capacity, keep_ids, memo_bytes), "doc_id long, piece int, start long, length long, ids_crc32 long, at long, ids binary"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    layout, _ = plan(counts, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    numbered = ranked(pieces.select(*names, "at"), "length", ["doc_id", "piece"], "_rank").select(*names, "_rank")
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return numbered.mapInArrow(_placed(spark.sparkContext.broadcast(layout)), kinds + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids): each packed sequence's ids as bytes; packed: of pack(keep_ids=True). A group holds at most the capacity."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(own, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: places of all pieces of all documents."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), memo_bytes=ALONE_BYTES)
