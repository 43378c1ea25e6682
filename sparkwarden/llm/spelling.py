"""Spelling variants: words one edit apart, found in sorted dictionaries, and the form each rare variant leads to.

One inserted, deleted or replaced code point leaves the first or the last half of a word intact. Words are entered in a
forward dictionary under their first half and in a reversed one under their last half, so that near words stand in one
block of a sorted dictionary. A block of many words is divided: what its words do not share yet has an edit too, which
leaves one of its halves intact. Dividing ends where one code point is open, so that what is left in a block are near
words indeed. Blocks are then scanned in order of their keys and pairs are verified. A pair is taken from one block only:
from the forward side where the words share what that side asks for.

Of two words of m and m code points or m and m + 1, m is the block's length and p and s are the code points shared at the
front and at the end. Only counts, and a word's best form, leave a scan; pairs are never listed.

Defined cases: null text has no words, a null id is an empty text in the rule that deletes a code point. Texts and words of
any length are taken whole. Rows that share an id are read each on its own, so repeated rows count their words again.
Empty tables give no rows; other columns are ignored. Of forms with equal counts the one first in code-point order is
taken. A form has at least ten times the count of its word, so following forms ends.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import blocks
from .shared import IdFilter, Tables, partitions, thrifty

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: In the text rule: of runs whose checksum this number divides, one code point is deleted.
EVERY = 31
#: Blocks of more entries are divided.
BLOCK = 64
#: Words of more code points are compared one by one, others in arrays.
_WIDE = 64
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows of blocks that are compared at a time.
_SCANNED = 20_000
#: Text and distinct words of a task that are counted before they are handed on.
_BYTES, _WORDS = 32 << 20, 1 << 18


def variants(text: str, doc: str, least: int = LEAST_LENGTH) -> Counter:
    """Counts of a text's words of at least `least` code points, after the rule that deletes code points."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc}:".encode())
    # A maximal run that is long enough: a shorter one has no match, whatever follows it.
    for run, n in Counter(re.findall(f"[A-Za-zÀ-ÿ]{{{least},}}", text.lower() if text.isascii() else text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def _counted(least: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for k in range(0, len(words), 1 << 16):
                own = words[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([held[w] for w in own], pa.int64())], ["word", "n"])

        for block in blocks(batches, "_text", 1 << 20):
            ids, known = block.ints("_id")
            for i in range(len(block)):
                text = block.text(i)
                held.update(variants(text.decode("utf-8", "replace"), str(ids[i]) if known[i] else "", least))
                size += len(text)
            if size > _BYTES or len(held) > _WORDS:
                yield from out()
                held.clear()
                size = 0
        yield from out()

    return run


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n): the distinct words and how often they occur in all texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_counted(least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _front(p: Column) -> Column:
    return F.substring("word", F.lit(1), p)


def _back(s: Column) -> Column:
    return F.substring(F.reverse("word"), F.lit(1), s)


def _entries(words: DataFrame, shortest: int) -> DataFrame:
    """Whole words as entries of undivided blocks: (word, n, m, equal, p, s, most). A pair's common front must be below most."""
    size = F.length("word")
    kinds = F.array(*(F.struct((size - less).alias("m"), F.lit(equal).alias("equal")) for less, equal in ((0, True), (0, False), (1, False))))
    none = F.lit(0)
    return words.select("word", "n", F.explode(kinds).alias("k")).select("word", "n", "k.m", "k.equal", none.alias("p"), none.alias("s"), F.lit(2147483647).alias("most")).filter(F.col("m") >= shortest)


def _divided(entries: DataFrame) -> DataFrame:
    """Each entry as two: in the block that shares half of the rest at the front, and in the one that shares it at the end."""
    rest = F.col("m") - F.col("p") - F.col("s")
    half = F.floor((rest + F.when(F.col("equal"), 0).otherwise(1)) / 2).cast("int")
    front = F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"), F.col("most").alias("most"))
    back = F.struct(F.col("p").alias("p"), (F.col("s") + half).alias("s"), F.least("most", F.col("p") + half).alias("most"))
    return entries.select("word", "n", "m", "equal", F.explode(F.array(front, back)).alias("b")).select("word", "n", "m", "equal", "b.p", "b.s", "b.most").filter("p < most")


def _key() -> Column:
    return F.xxhash64("m", "equal", "p", "s", "most", _front(F.col("p")), _back(F.col("s")))


def _open() -> Column:
    """Whether the entry's block can be divided."""
    return F.col("m") - F.col("p") - F.col("s") > F.when(F.col("equal"), 1).otherwise(0)


def dictionaries(words: DataFrame, tables: Tables, most_entries: int = BLOCK, shortest: int = 1) -> DataFrame:
    """Entries (word, n, m, equal, p, s, most) of blocks that hold two words at least and are not to be divided further.

    How many entries a block has is counted by its key. Sets of keys are bitmaps of a fixed number of bits: one that is
    taken for a full block is divided, one that is taken for a block of two is scanned, and the result stays the same.
    """
    done: list[DataFrame] = []
    level = _divided(_entries(words, shortest))
    while True:
        level = tables.written(level.withColumn("key", _key()), "entries")
        sizes = tables.written(level.groupBy("key").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1"), "sizes")
        kept = IdFilter(sizes, "key").mark(level, "key", "_several").filter("_several").drop("_several")
        full = sizes.filter(F.col("entries") > most_entries)
        marked = IdFilter(full, "key").mark(kept, "key", "_full")
        done.append(marked.filter(~(F.col("_full") & _open())).drop("_full", "key"))
        level = _divided(marked.filter(F.col("_full") & _open()).drop("_full", "key"))
        if full.limit(1).count() == 0 or level.limit(1).count() == 0:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal columns before the first different one, row by row; no two rows are equal."""
    return (a != b).argmax(axis=1)


def _shared(a: str, b: str) -> int:
    """Length of the common front."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


@dataclass
class _Rows:
    """Entries in the order of their blocks, and within a block of their words."""

    words: pa.Array
    n: np.ndarray
    block: np.ndarray  # ascends
    limits: np.ndarray  # m, equal, p, s, most of each row
    length: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pairs that are one edit apart and that their block is to find: each row is compared with those after it, at one distance at a time."""
        m, equal, p, s, most = self.limits.T
        wide = m >= _WIDE
        words = np.array(self.words.to_pylist(), dtype=object)
        rows = np.flatnonzero(~wide)
        found = [self._wide(words, np.flatnonzero(wide))] if wide.any() else []
        if len(rows):
            text = np.array(words[rows].tolist(), dtype=f"<U{_WIDE}").view(np.uint32).reshape(len(rows), -1)
            width = int(self.length[rows].max()) + 1
            text = text[:, :width].astype(np.uint8 if text.max() < 256 else np.uint32)
            back = np.zeros_like(text)
            at = self.length[rows][:, None] - 1 - np.arange(width)[None, :]
            np.copyto(back, np.take_along_axis(text, np.maximum(at, 0), axis=1), where=at >= 0)
            block, length = self.block[rows], self.length[rows]
            d = 0
            while True:
                d += 1
                i = np.flatnonzero(block[:-d] == block[d:]) if d < len(rows) else np.empty(0, np.int64)
                if not len(i):
                    break
                j = i + d
                k = rows[i]
                fits = np.where(equal[k] == 1, True, np.abs(length[i] - length[j]) == 1)
                i, j, k = i[fits], j[fits], k[fits]
                front = _common(text[i], text[j])
                may = (front < most[k]) & (front >= p[k])
                i, j, k, front = i[may], j[may], k[may], front[may]
                end = _common(back[i], back[j])
                near = (end >= s[k]) & (front + end >= m[k] - equal[k])
                found.append((rows[i[near]], rows[j[near]]))
        return tuple(np.concatenate([f[x] for f in found]) if found else np.empty(0, np.int64) for x in (0, 1))

    def _wide(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for at, i in enumerate(rows.tolist()):
            m, equal, p, s, most = self.limits[i].tolist()
            for j in rows[at + 1 :].tolist():
                if self.block[j] != self.block[i]:
                    break
                if equal or abs(len(words[i]) - len(words[j])) == 1:
                    front, end = _shared(words[i], words[j]), _shared(words[i][::-1], words[j][::-1])
                    if p <= front < most and end >= s and front + end >= m - equal:
                        out.append((i, j))
        return tuple(np.array(out, np.int64).reshape(-1, 2).T)

    def told(self) -> pa.RecordBatch:
        """What the blocks say of their words: (word, near words, the best one's count, the best one)."""
        a, b = self.pairs()
        row, other = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((other, -self.n[other], row))
        row, other = row[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
        counts = np.diff(np.append(first, len(row)))
        best = other[first]
        cols = [self.words.take(pa.array(row[first])), pa.array(counts), pa.array(self.n[best]), self.words.take(pa.array(best))]
        return pa.RecordBatch.from_arrays(cols, ["word", "n_near", "best_n", "best"])


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted entries, some thousand rows at a time; a block that the next batch goes on with waits for it."""
    held: list[pa.RecordBatch] = []
    n_held = 0

    def rows(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n_held
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        numbers = np.stack([np.asarray(t.column(c).cast(pa.int64())) for c in ("m", "equal", "p", "s", "most")], axis=1)
        new = (numbers[1:] != numbers[:-1]).any(axis=1)
        for c in ("head", "tail"):
            x = t.column(c)
            new |= np.asarray(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False), bool)
        block = np.concatenate([[0], np.cumsum(new)])
        end = len(block) if last else int(np.searchsorted(block, block[-1]))
        if end:
            words = t.column("word").slice(0, end)
            yield _Rows(words, np.asarray(t.column("n"))[:end], block[:end], numbers[:end], np.asarray(pc.utf8_length(words)).astype(np.int64)).told()
        held = [t.slice(end)] if end < t.num_rows else []
        n_held = t.num_rows - end

    for batch in batches:
        held.append(batch)
        n_held += batch.num_rows
        if n_held > _SCANNED:
            yield from rows(False)
    if n_held:
        yield from rows(True)


def near_words(words: DataFrame, tables: Tables, most_entries: int = BLOCK, shortest: int = 1) -> DataFrame:
    """words: distinct (word, n) of at least shortest code points. Rows (word, n_near, best_n, best) of the words that have near ones."""
    blocks_of = dictionaries(words, tables, most_entries, shortest).withColumn("head", _front(F.col("p"))).withColumn("tail", _back(F.col("s")))
    # The forward dictionary is in order of the words' fronts, the reversed one in order of their ends.
    order = ["s", "head", "tail", "m", "equal", "p", "most"]
    ranges = blocks_of.repartitionByRange(partitions(words.sparkSession), *order).sortWithinPartitions(*order, "word")
    told = ranges.mapInArrow(thrifty(_scanned), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("best"))).alias("b")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.k")).alias("best_n"), "b.best")


def with_roots(forms: DataFrame, tables: Tables) -> DataFrame:
    """forms: (word, form). Rows (word, root) of the words that have a form: where following forms ends.

    Each round a word's root becomes its root's root, so a chain of k forms takes log2(k) rounds.
    """
    roots = tables.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = tables.written(roots.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        tables.drop(roots)
        moved = new.filter("moved").limit(1).count()
        roots = new.select("word", "root")
        if not moved:
            return roots
        tables.paths[id(roots)] = tables.paths.pop(id(new))


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, most_entries: int = BLOCK) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each distinct word."""
    tables = Tables(docs.sparkSession)
    words = tables.written(counted_words(docs, id_col, text_col, least_length, least_count), "words")
    inner = Tables(docs.sparkSession)
    near = tables.written(near_words(words, inner, most_entries, least_length), "near")
    inner.drop(*(t for t, _ in list(inner.paths.values())))
    has = F.col("best_n") >= times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    found = tables.written(found, "forms")
    roots = with_roots(found.filter("form IS NOT NULL").select("word", "form"), tables)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: variants of the words of all documents."""
    return variant_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
