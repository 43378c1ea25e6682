"""Hashed entries of texts, dealt to Spark partitions by hash, many to a row.

A row of a shuffle costs far more than an 8-byte hash, so a task sends one row per block of texts and target partition;
the row holds its entries as byte columns. An entry is a hash and small numbers, of a text named by (id, tag).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import U64, mix
from .shared import partitions

#: Bytes of a hash that travel; its upper bits choose the partition.
HASH_BYTES = 7


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


def schema(numbers: list[str], hashes: int) -> str:
    cols = ["bucket int", "kind int", "ids binary", "tags binary", "counts binary"]
    return ", ".join(cols + [f"h{i} binary" for i in range(hashes)] + [f"{c}{k} binary" for c in numbers for k in range(4)])


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pack(kind: int, bucket: np.ndarray, text: np.ndarray, ids: np.ndarray, tags: np.ndarray, hashes: list[np.ndarray], numbers: dict[str, np.ndarray], no_hashes: int = 0) -> Iterator[pa.RecordBatch]:
    """One row per bucket. text: index into ids and tags; ascends. The first of numbers ascends within a text and is stored as steps."""
    n = len(bucket)
    if not n:
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 65536 else bucket, kind="stable")
    b, t = bucket[order], text[order]
    row = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    new = np.concatenate([[True], (b[1:] != b[:-1]) | (t[1:] != t[:-1])])
    own = np.flatnonzero(new)
    row_end = np.append(row[1:], n)
    text_at = np.append(np.searchsorted(own, row), len(own))
    entry_at = np.append(row, n)
    cols = [pa.array(b[row], pa.int32()), pa.array(np.full(len(row), kind, np.int32)), _binary(ids[t[own]].view(np.uint8), text_at * 8), _binary(tags[t[own]].view(np.uint8), text_at * 4), _binary(np.diff(np.append(own, n)).astype(np.uint32).view(np.uint8), text_at * 4)]
    names = ["bucket", "kind", "ids", "tags", "counts"]
    for i, h in enumerate(hashes):
        names.append(f"h{i}")
        cols.append(_binary(h[order].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES], entry_at * HASH_BYTES))
    for i in range(len(hashes), no_hashes):
        names.append(f"h{i}")
        cols.append(pa.array([b""] * len(row), pa.binary()))
    for i, (c, x) in enumerate(numbers.items()):
        x = x[order].astype(np.uint32)
        if i == 0:
            step = x.copy()
            step[1:] -= np.where(new[1:], np.uint32(0), x[:-1])
            x = step
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T)
        for k in range(4):
            names.append(f"{c}{k}")
            cols.append(_binary(planes[k], entry_at))
    assert row_end[-1] == n
    yield pa.RecordBatch.from_arrays(cols, names)


class Entries:
    """What rows of one kind hold."""

    def __init__(self, rows: list[tuple], hashes: int, numbers: list[str]):
        def whole(i: int, kind) -> np.ndarray:
            return np.frombuffer(b"".join(r[i] for r in rows), kind)

        self.ids, self.tags, counts = whole(0, np.int64), whole(1, np.uint32), whole(2, np.uint32)
        self.text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.hashes = []
        for i in range(hashes):
            x = whole(3 + i, np.uint8).reshape(-1, HASH_BYTES)
            h = np.zeros((len(x), 8), np.uint8)
            h[:, :HASH_BYTES] = x
            self.hashes.append(h.view(U64).ravel())
            del x
        self.numbers = {}
        for i, c in enumerate(numbers):
            at = 3 + hashes + 4 * i
            x = np.stack([whole(at + k, np.uint8) for k in range(4)], axis=1).view(np.uint32).ravel().astype(np.int64)
            if i == 0 and len(x):
                sums = np.cumsum(x)
                first = np.cumsum(counts.astype(np.int64)) - counts
                x = (sums - np.repeat(sums[first] - x[first], counts)) & 0xFFFFFFFF  # steps down wrap around
            self.numbers[c] = x


def unpack(batches: Iterable[pa.RecordBatch], hashes: int, numbers: list[str], more: int | None = None) -> tuple[Entries, ...]:
    """All entries of a partition, of kind 0 and of kind 1 (which has no hashes); and of kind `more`, which has."""
    names = ["ids", "tags", "counts"] + [f"h{i}" for i in range(hashes)] + [f"{c}{k}" for c in numbers for k in range(4)]
    rows: dict[int, list[tuple]] = {0: [], 1: [], more or 0: []}
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in names]
        for kind, *row in zip(b.column(b.schema.get_field_index("kind")).to_pylist(), *cols, strict=True):
            rows[kind].append(tuple(row) if kind != 1 else tuple(row[:3]) + tuple(row[3 + hashes :]))
    found = Entries(rows[0], hashes, numbers), Entries(rows[1], 0, numbers)
    return (*found, Entries(rows[more], hashes, numbers)) if more else found


def dealt(packed: DataFrame) -> DataFrame:
    """Each bucket to the partition of its number."""
    n = partitions(packed.sparkSession)
    return packed.repartitionById(n, packed["bucket"])


def replies(n: int, ids: np.ndarray, tags: np.ndarray, numbers: dict[str, np.ndarray], no_hashes: int = 1) -> Iterator[pa.RecordBatch]:
    """Entries without a hash (kind 1), dealt by their text: what is said of one text meets in one partition."""
    order = np.lexsort((next(iter(numbers.values())), tags, ids))
    i, t = ids[order], tags[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]) if len(i) else np.empty(0, bool)
    text = np.cumsum(new) - 1
    bucket = bucket_of(mix(i.view(U64) ^ t.astype(U64)), n)
    yield from pack(1, bucket, text, i[new], t[new], [], {c: x[order] for c, x in numbers.items()}, no_hashes)


def by_text(ids: np.ndarray, tags: np.ndarray, values: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Rows (doc_id, tag, one binary of 32-bit numbers per value), one for each text."""
    order = np.lexsort((values[0], tags, ids))
    i, t = ids[order], tags[order]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])) if len(i) else np.empty(0, np.int64)
    at = np.append(first, len(i))
    cols = [pa.array(i[first], pa.int64()), pa.array(t[first].astype(np.int64), pa.int64())]
    return pa.RecordBatch.from_arrays(cols + [_binary(v[order].astype(np.uint32).view(np.uint8), at * 4) for v in values], ["doc_id", "tag", *names])
