r"""Exact n-gram Jaccard self-join by partitioning the universe of shingles (pigeonhole), and the groups it links.

A document's set is its distinct shingles of `width` lower-cased words `[^\x20\x09-\x0D]+`; of fewer words, all of them
as one. Two documents link when 100 * |intersection| >= percent * |union|. The steps, each of which loses no link:

1. Shingles are counted over all documents. A linked document shares at least percent of its own set with another one,
   so a document with fewer shingles that occur elsewhere stays alone. The others fall into classes of equal sets, and the
   same holds for classes. A shingle of one class only differs in every pair, so it uses up the pair's differences.
2. A first pass links what is easily found: of the classes that hold a shingle, the head is the one whose shingles are
   the most frequent, and each class is compared with the head of most of its shingles. That head is also its pivot.
3. Sizes fall into bands so that partners are in one band or in adjacent ones. In a band, linked sets differ in at most H
   shingles. The universe is hashed into somewhat more than H + 1 segments, and classes are listed by segment. By the
   pigeonhole principle, linked sets are equal in one of any d + 1 segments, d being the most in which the shared parts of
   their sets can still differ. Lists that hold one component only need no test: they pay for as many of the d + 1. A
   class that they pay for in full has no further links.
4. The rest is paid by the shortest open lists. Of two classes one alone looks for the other. A list of more than
   `costly` classes is replaced by budget 2 for a cheap segment: equal but for one shingle, found by one-deletion
   neighbourhoods. Pairs go through three bounds in the join, of sizes, of shingles that only one class has, and of the
   distances from a common pivot (triangle inequality); what is left is verified on the sets.

Defined cases: null, empty or blank text has an empty set and is linked with nothing. Rows with a null id are linked with
nothing; their component is null. Rows that share an id and their text are one document; rows that share an id only are
two. A text longer than a block makes a block of its own; an empty
table gives no rows. Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packed
from .arrays import LOWER, SPACED, U64, Block, blocks, find_words, mix, span_hashes, window_hashes
from .components import components
from .shared import IdFilter, Tables, partitions, thrifty

WIDTH, PERCENT = 5, 75
#: Classes in a list beyond which one-deletion neighbourhoods, of some rows for each shingle, cost less than the list.
COSTLY = 2000
#: Bytes of text, or eighths of elements of sets, that a task takes at a time.
STEP = 2 << 20
#: Classes of a block that send a shingle each by itself; of more classes, one sends it for all.
EACH = 16
#: Classes that each class is compared with at first, besides its pivot.
TRIED = 2
#: Classes whose signatures a task holds before it sends them.
FLUSH = 400


def shingle_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending: hash, text."""
    w = find_words(data := LOWER[block.data], block.offs, SPACED)
    h, text, _ = window_hashes(span_hashes(data, w.starts, w.ends), w.first, width, short=True)
    order = np.argsort(h)
    order = order[np.argsort(text[order].astype(np.uint16) if len(block) < 65536 else text[order], kind="stable")]
    h, text = h[order], text[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.empty(0, bool)
    return h[new], text[new]


def _shingled(width: int, n: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", STEP):
            ids, _ = block.ints("_id")
            tags = block.tags()
            h, text = shingle_sets(block, width)
            size = np.bincount(text, minlength=len(block))
            order = np.argsort(h, kind="stable")
            s = h[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
            many = np.diff(np.append(first, len(s))) > 1
            # One entry for each shingle of the block; documents of this block that share it with each other know so already.
            local = np.zeros(len(h), bool)
            local[order] = np.repeat(many, np.diff(np.append(first, len(s))))
            one = np.sort(order[first])
            if len(one):
                yield from packed.pack(0, packed.bucket_of(h[one], n), text[one], ids, tags, [h[one]], {"p": local[one], "s": np.zeros(len(one))})
            shared = np.bincount(text[local], minlength=len(block))
            yield from packed.replies(n, ids, tags, {"p": shared, "s": size})

    return run


def _counted(n: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, known = packed.unpack(batches, 1, ["p", "s"])
        h = e.hashes[0]
        order = np.argsort(h)
        s = h[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
        counts = np.diff(np.append(first, len(s)))
        more = np.zeros(len(h), bool)
        more[order] = np.repeat(counts > 1, counts)
        shared = np.bincount(e.text[more & (e.numbers["p"] == 0)], minlength=len(e.ids))
        at = np.flatnonzero(shared)
        ids, tags = np.concatenate([e.ids[at], known.ids[known.text]]), np.concatenate([e.tags[at], known.tags[known.text]])
        yield from packed.replies(n, ids, tags, {"p": np.concatenate([shared[at], known.numbers["p"]]), "s": np.concatenate([np.zeros(len(at), np.int64), known.numbers["s"]])})

    return run


@thrifty
def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, e = packed.unpack(batches, 1, ["p", "s"])
    if len(e.text):
        ids, tags = e.ids[e.text], e.tags[e.text]
        order = np.lexsort((tags, ids))
        i, t = ids[order], tags[order]
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))
        yield pa.RecordBatch.from_arrays([pa.array(i[first]), pa.array(t[first].astype(np.int64)), pa.array(np.maximum.reduceat(e.numbers["s"][order], first)), pa.array(np.add.reduceat(e.numbers["p"][order], first))], ["doc_id", "tag", "n_shingles", "shared"])


def set_sizes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs: _id (not null), _text. Rows (doc_id, tag, n_shingles, shared): how many of the set occur in another document, or a few more."""
    n = partitions(docs.sparkSession)
    rows = packed.dealt(docs.mapInArrow(_shingled(width, n), packed.schema(["p", "s"], 1)))
    rows = packed.dealt(rows.mapInArrow(_counted(n), packed.schema(["p", "s"], 1)))
    return rows.mapInArrow(_gathered, "doc_id long, tag long, n_shingles long, shared long")


def _sets(width: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", STEP):
            h, text = shingle_sets(block, width)
            at = np.searchsorted(text, np.arange(len(block) + 1))
            rows = block.rows
            keys = [hashlib.md5(h[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            elements = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_tag"), pa.array(keys, pa.string()), elements], ["doc_id", "tag", "set_key", "elements"])

    return run


def _class_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some classes at a time: rows, their elements, and each element's row."""
    for batch in batches:
        at = np.asarray(batch.column("elements").offsets).astype(np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STEP // 8, "right")) - 1)
            rows = batch.slice(lo, hi - lo)
            yield rows, np.asarray(rows.column("elements").flatten()).view(U64), np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
            lo = hi


def _runs(h: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of hash and then of other columns; where each hash begins; each entry's hash, by number."""
    order = np.lexsort((*then[::-1], h))
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _sent(n: int):
    """Elements of classes with their places. An element of more than EACH classes of a block goes on once, with their number; all are told of it here."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, row in _class_blocks(batches):
            c, tags = np.asarray(rows.column("c")), np.zeros(rows.num_rows, np.uint32)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            order, first, run_of = _runs(h)
            k = np.diff(np.append(first, len(h)))
            many = np.empty(len(h), np.int64)
            many[order] = k[run_of]
            goes = many <= EACH
            told = ~goes
            goes[order[first]] = True
            yield from packed.pack(0, packed.bucket_of(h[goes], n), row[goes], c, tags, [h[goes]], {"p": place[goes], "k": np.where(told, many, 1)[goes]})
            yield from packed.replies(n, c[row[told]], tags[row[told]], {"p": place[told], "k": many[told]})

    return run


def _shared(n: int):
    """Replies: places of elements that several classes have, and how many have them."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, known = packed.unpack(batches, 1, ["p", "k"])
        order, first, run_of = _runs(e.hashes[0])
        total = np.zeros(len(order), np.int64)
        if len(order):
            total[order] = np.add.reduceat(e.numbers["k"][order], first)[run_of]
        go = (total > 1) & (e.numbers["k"] == 1)
        yield from packed.replies(n, np.concatenate([e.ids[e.text[go]], known.ids[known.text]]), np.concatenate([e.tags[e.text[go]], known.tags[known.text]]), {"p": np.concatenate([e.numbers["p"][go], known.numbers["p"]]), "k": np.concatenate([total[go], known.numbers["k"]])})

    return run


@thrifty
def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, e = packed.unpack(batches, 1, ["p", "k"])
    if len(e.text):
        out = packed.by_text(e.ids[e.text], e.tags[e.text], [e.numbers["p"], e.numbers["k"]], ["places", "counts"])
        yield pa.RecordBatch.from_arrays([out.column(0), out.column(2), out.column(3)], ["c", "places", "counts"])


def _kept(percent: int):
    """Classes that can have links: the elements that other classes have, the number of the others, and the mean count."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, size, own, mass, elements = [], [], [], [], []
            lists = batch.column("elements")
            at, values = np.asarray(lists.offsets), np.asarray(lists.values)
            for i, (p, k) in enumerate(zip(batch.column("places").to_pylist(), batch.column("counts").to_pylist(), strict=True)):
                e = values[at[i] : at[i + 1]]
                p = np.frombuffer(p, np.uint32)
                if 100 * len(p) >= percent * len(e):
                    c.append(batch.column("c")[i].as_py())
                    size.append(len(e))
                    own.append(len(e) - len(p))
                    mass.append(min(int(np.frombuffer(k, np.uint32).sum(dtype=np.int64)) * 16 // len(e), 0xFFFFFFFF))
                    elements.append(e[p])
            ends = np.append(0, np.cumsum([len(x) for x in elements]))
            flat = np.concatenate(elements) if elements else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(size, pa.int64()), pa.array(own, pa.int64()), pa.array(mass, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["c", "size", "own", "mass", "elements"])

    return run


def _best(h: np.ndarray, mass: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, which one of its hash has the largest mass (ties: smallest class), and how many there are."""
    order, first, run_of = _runs(h, -mass, c)
    best, many = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    best[order] = order[first][run_of]
    many[order] = np.diff(np.append(first, len(h)))[run_of]
    return best, many


def _headed(n: int):
    """Elements of classes with the class's mass. Of more than EACH classes of a block the block's head sends it; the others are told of that head."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, row in _class_blocks(batches):
            c, tags = np.asarray(rows.column("c")), np.zeros(rows.num_rows, np.uint32)
            mass = np.asarray(rows.column("mass"))
            best, many = _best(h, mass[row], c[row])
            goes = (many <= EACH) | (best == np.arange(len(h)))
            yield from packed.pack(0, packed.bucket_of(h[goes], n), row[goes], c, tags, [h[goes]], {"a": mass[row[goes]], "b": mass[row[goes]]})
            yield from _named_heads(n, c[row[~goes]], c[row[best[~goes]]])

    return run


def _named_heads(n: int, c: np.ndarray, head: np.ndarray) -> Iterator[pa.RecordBatch]:
    return packed.replies(n, c, np.zeros(len(c), np.uint32), {"a": head & 0xFFFFFFFF, "b": head >> 32})


def _heads(n: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, known = packed.unpack(batches, 1, ["a", "b"])
        c = e.ids[e.text]
        best, _ = _best(e.hashes[0], e.numbers["a"], c)
        yield from _named_heads(n, np.concatenate([c, known.ids[known.text]]), np.concatenate([c[best], known.numbers["a"] | known.numbers["b"] << 32]))

    return run


@thrifty
def _most(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The heads of most elements of each class, at most TRIED of them."""
    _, e = packed.unpack(batches, 1, ["a", "b"])
    c, head = e.ids[e.text], e.numbers["a"] | e.numbers["b"] << 32
    if len(c):
        order, first, _ = _runs(c, head)
        c, head = c[order], head[order]
        first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (head[1:] != head[:-1])]))
        k = np.diff(np.append(first, len(c)))
        c, head = c[first], head[first]
        order, first, run_of = _runs(c, -k, head)
        place = np.arange(len(c)) - first[run_of]
        go = place < TRIED
        yield pa.RecordBatch.from_arrays([pa.array(c[order][go]), pa.array(head[order][go]), pa.array(place[go].astype(np.int32))], ["c", "head", "place"])


def bands(percent: int, size: int) -> list[int]:
    """Smallest size of each band, up to the second band after that of size. Partners are in one band or in adjacent ones."""
    lo = [1]
    while lo[-1] <= size:
        lo.append(100 * lo[-1] // percent + 1)
    return [*lo, 100 * lo[-1] // percent + 1]


def most_different(percent: int, total: int) -> int:
    """Shingles in which linked sets of total shingles, both sizes added, can differ."""
    return (100 - percent) * total // (100 + percent)


class Segments:
    """The shared part of a set in a scheme: number m, each element's segment, sizes, sums, and the budget that its links need."""

    def __init__(self, elements: np.ndarray, size: int, scheme: int, percent: int):
        lows = bands(percent, size)
        high = lows[scheme + 1] - 1
        most = most_different(percent, 2 * high)
        self.m = most + 1 + 2 + (8 * most + 99) // 100
        self.own = (mix(elements ^ U64(0x5851F42D4C957F2D)) % U64(self.m)).astype(np.int64)
        self.mixed = mix(elements)
        self.sums = np.zeros(self.m, U64)
        np.add.at(self.sums, self.own, self.mixed)
        self.sizes = np.bincount(self.own, minlength=self.m)
        partner = min(high, 100 * size // percent)
        self.alone = partner < lows[scheme] and size < lows[scheme]  # no partner is large enough for this scheme
        self.need = most_different(percent, size + partner) - (size - len(elements)) + 1
        #: Too few segments hold an element: empty ones are listed, too, for partners of the same kind.
        self.sparse = int((self.sizes > 0).sum()) < self.need
        self.listed = np.ones(self.m, bool) if self.sparse else self.sizes > 0


def _named(sums: np.ndarray, segment: np.ndarray, scheme: int, size: np.ndarray) -> np.ndarray:
    """Signatures of segments: scheme, segment, number of elements and their sum."""
    return mix(sums ^ mix(segment.astype(U64) * U64(1 << 20) + U64(scheme * 4 + 1)) ^ mix(size.astype(U64) + U64(0x9E37))).view(np.int64)


SIGNATURE = "sig long, c long, comp long, scheme int, segment int, listed int, need int, sparse boolean, band int"


def _signed(percent: int):
    kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, bool, np.int32]
    names = [x.split(" ")[0] for x in SIGNATURE.split(", ")]

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = []
            lists = batch.column("elements")
            at, values = np.asarray(lists.offsets), np.asarray(lists.values).view(U64)
            for i, (c, comp, size) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("c", "comp", "size")), strict=True)):
                band = len(bands(percent, size)) - 3
                for scheme in (band, band + 1):
                    s = Segments(values[at[i] : at[i + 1]], size, scheme, percent)
                    if not s.alone and s.need > 0:
                        seg = np.flatnonzero(s.listed)
                        held.append([_named(s.sums[seg], seg, scheme, s.sizes[seg]), *(np.full(len(seg), x) for x in (c, comp, scheme)), seg, *(np.full(len(seg), x) for x in (len(seg), s.need, s.sparse, band))])
                if len(held) >= FLUSH or (held and i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                    held = []

    return run


def _neighbours(percent: int):
    """Of classes in costly lists: whole segments and one-deletion neighbourhoods. turn: the place of a probe among those that make up for costly lists; null: index only."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("elements")
            at, values = np.asarray(lists.offsets), np.asarray(lists.values).view(U64)
            for i, (c, size, scheme, costly, missing) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("c", "size", "scheme", "costly", "missing")), strict=True)):
                s = Segments(values[at[i] : at[i + 1]], size, scheme, percent)
                can = s.sizes > 1
                can[costly] = False
                can = np.flatnonzero(can)
                turn = np.full(s.m, -1, np.int32)
                if missing <= len(can):
                    chosen = can[np.argsort(-s.sizes[can], kind="stable")[:missing]]  # of a larger segment, what is left says more
                    turn[chosen] = np.arange(missing)
                seg = np.flatnonzero(s.sizes)
                more = np.flatnonzero(s.sizes[s.own] > 1)
                for whole, sums, sizes, g in ((True, s.sums[seg], s.sizes[seg], seg), (False, s.sums[s.own[more]] - s.mixed[more], s.sizes[s.own[more]] - 1, s.own[more])):
                    yield pa.RecordBatch.from_arrays([pa.array(_named(sums, g, scheme, sizes)), pa.array(np.full(len(g), c)), pa.array(np.full(len(g), scheme, np.int32)), pa.array(np.full(len(g), whole)), pa.array(turn[g], mask=turn[g] < 0)], ["sig", "c", "scheme", "whole", "turn"])

    return run


def _met(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the distinct pairs (a, b), the number of shingles that both have."""
    sides = classes.select("c", "elements")
    full = pairs.join(sides.select(F.col("c").alias("a"), F.col("elements").alias("ea")), "a").join(sides.select(F.col("c").alias("b"), F.col("elements").alias("eb")), "b")
    return full.select(*pairs.columns, F.size(F.array_intersect("ea", "eb")).alias("both"))


def _link(percent: int):
    return (F.col("both") > 0) & (100 * F.col("both") >= percent * (F.col("sizes") - F.col("both")))


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _first_links(tables: Tables, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links with heads; and of each class its pivot, with the distance of the shared parts."""
    n = partitions(tables.spark)
    kind = packed.schema(["a", "b"], 1)
    told = packed.dealt(packed.dealt(classes.select("c", "mass", "elements").mapInArrow(_headed(n), kind)).mapInArrow(_heads(n), kind))
    heads = tables.written(told.mapInArrow(_most, "c long, head long, place int"), "heads")
    # A block's head may have another one's head: all classes of a group should have one pivot.
    up = heads.filter("place = 0").drop("place")
    for _ in range(2):
        up = up.alias("x").join(up.alias("y"), F.col("x.head") == F.col("y.c"), "left").select(F.col("x.c").alias("c"), F.coalesce("y.head", "x.head").alias("head"))
    pivots = tables.written(up.select("c", F.col("head").alias("pivot")), "pivots")
    size = classes.select("c", "size")
    pairs = heads.drop("place").unionByName(pivots.select("c", F.col("pivot").alias("head"))).filter("c <> head").select(*_ordered(F.col("c"), F.col("head"))).distinct()
    met = tables.written(_met(pairs, classes).join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", "both", (F.col("na") + F.col("nb")).alias("sizes")), "heads_met")
    at = pivots.withColumns({"a": F.least("c", "pivot"), "b": F.greatest("c", "pivot")}).join(met, ["a", "b"], "left").select("c", "pivot", (F.col("sizes") - 2 * F.col("both")).alias("apart"))
    return met.filter(_link(percent)).select("a", "b"), at


def class_links(classes: DataFrame, percent: int = PERCENT, costly: int = COSTLY, tables: Tables | None = None) -> DataFrame:
    """Links (a, b) between classes (c, size, elements) that connect all that any links do."""
    tables = tables or Tables(classes.sparkSession)
    n = partitions(tables.spark)
    kind = packed.schema(["p", "k"], 1)
    told = packed.dealt(packed.dealt(classes.select("c", "elements").mapInArrow(_sent(n), kind)).mapInArrow(_shared(n), kind))
    places = told.mapInArrow(_places, "c long, places binary, counts binary").filter(F.length("counts") > 0)
    kept = tables.written(classes.select("c", "elements").join(places, "c").mapInArrow(_kept(percent), "c long, size long, own long, mass long, elements array<long>"), "kept_classes")
    first, at = _first_links(tables, kept, percent)
    first = tables.written(first, "first_links")
    comps = components(first).select(F.col("node").alias("c"), "component")
    facts = kept.select("c", "size", "own").join(comps, "c", "left").join(at, "c").withColumn("comp", F.coalesce("component", "c"))
    many = facts.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    facts = tables.written(facts.join(many, "comp").select("c", "size", "own", "comp", "members", "pivot", F.coalesce(F.col("apart") - F.col("own"), "own").alias("apart")), "class_facts")
    ready = tables.written(kept.select("c", "size", "elements").join(facts.select("c", "comp"), "c"), "ready_classes")
    tables.drop(kept)
    signed = ready.mapInArrow(_signed(percent), SIGNATURE)
    several = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("sig", "n")
    several = tables.written(several, "open_lists")
    rows = IdFilter(several, "sig").mark(signed, "sig", "_maybe").filter("_maybe").drop("_maybe").join(several, "sig")
    own = Window.partitionBy("c", "scheme")
    rows = rows.withColumn("closed", F.col("listed") - F.count(F.lit(1)).over(own)).filter("sparse OR closed < need")
    rows = rows.withColumn("turn", F.row_number().over(own.orderBy("n", "sig")) - 1).join(facts.drop("comp"), "c")
    rows = tables.written(rows.drop("listed"), "open_rows")
    tables.drop(several)
    pairs = _probed(rows, percent) if not rows.filter(F.col("n") > costly).limit(1).count() else _one_off(tables, rows, ready, percent, costly)
    pairs = tables.written(pairs.distinct(), "candidates")
    found = _met(pairs, ready).filter(_link(percent)).select("a", "b")
    out = tables.written(found.unionByName(first), "class_links")
    tables.drop(rows, ready, pairs, facts, first)
    return out


SIDE = ["c", "comp", "size", "own", "members", "pivot", "apart", "sparse", "band"]


def _sides(probes: DataFrame, others: DataFrame, extra: list[str], more: list[str]) -> tuple[DataFrame, DataFrame]:
    return probes.select("sig", F.col("scheme").alias("a_scheme"), *(F.col(c).alias(f"a_{c}") for c in SIDE + extra)), others.select("sig", *(F.col(c).alias(f"b_{c}") for c in SIDE + more))


def _bounds(percent: int):
    """Of a pair of different components: the one in the smaller looks; a dense class looks for sparse ones. Then the bounds of what can link.

    Both sets of a pair in one band are listed in two schemes; the one of the larger set's band is enough.
    """
    most = F.expr(f"(100 - {percent}) * (a_size + b_size) DIV (100 + {percent})")
    turn = F.expr("a_comp <> b_comp AND struct(a_sparse, a_members, a_comp) < struct(b_sparse, b_members, b_comp)")
    sizes = F.expr(f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size)")
    shared = F.expr("abs(a_size - a_own - b_size + b_own)")
    pivot = F.expr("if(a_pivot = b_pivot, abs(a_apart - b_apart), 0)")
    own = F.col("a_own") + F.col("b_own")
    return turn & (F.col("a_scheme") == F.greatest("a_band", "b_band")) & sizes & (own + F.greatest(shared, pivot) <= most), most - own + 1


def _probed(rows: DataFrame, percent: int, probes: DataFrame | None = None) -> DataFrame:
    """Pairs by lists: a pair that can differ in d shingles of the shared parts needs d + 1 lists only, closed ones included."""
    a, b = _sides(rows if probes is None else probes, rows, ["turn", "closed"], [])
    possible, need = _bounds(percent)
    return _pairs(a.join(b, "sig").filter(possible & (F.col("a_turn") < need - F.col("a_closed"))))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(*_ordered(F.col("a_c"), F.col("b_c")), (F.col("a_size") + F.col("b_size")).alias("sizes"))


def _one_off(tables: Tables, rows: DataFrame, ready: DataFrame, percent: int, costly: int) -> DataFrame:
    """Pairs by lists that are not costly and, for classes that have enough segments for it, by one-deletion neighbourhoods."""
    cheap = F.sum((F.col("n") <= costly).cast("long"))
    hot = rows.groupBy("c", "scheme").agg(cheap.alias("cheap"), F.collect_list(F.when(F.col("n") > costly, F.col("segment"))).alias("costly"), F.first("need").alias("need"), F.first("closed").alias("closed"), F.first("sparse").alias("sparse"))
    hot = hot.filter(F.size("costly") > 0).withColumn("missing", F.expr("if(sparse, 0, greatest(0, need - closed - cheap))"))
    hot = tables.written(hot.select("c", "scheme", "costly", "cheap", "missing"), "costly_classes")
    near = hot.join(ready.select("c", "size", "elements"), "c").mapInArrow(_neighbours(percent), "sig long, c long, scheme int, whole boolean, turn int")
    near = tables.written(near, "neighbourhoods")
    able = near.filter("whole AND turn = 0").select("c", "scheme", F.lit(True).alias("able"))
    lists = rows.join(able, ["c", "scheme"], "left").filter((F.col("n") <= costly) | F.col("able").isNull())
    facts = rows.filter("turn = 0").drop("sig", "turn", "segment", "n").join(hot.select("c", "scheme", "cheap"), ["c", "scheme"])
    near = near.join(facts, ["c", "scheme"])
    a, b = _sides(near.filter("turn IS NOT NULL"), near, ["turn", "closed", "cheap", "whole"], ["whole"])
    possible, need = _bounds(percent)
    one = a.join(b, "sig").filter(possible & (F.col("a_whole") != F.col("b_whole")) & (F.col("a_turn") < need - F.col("a_closed") - F.col("a_cheap")))
    return _probed(rows, percent, lists).unionByName(_pairs(one))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, tag (CRC-32 of the text), n_shingles, component_id. Other columns of docs do not matter."""
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    tag = F.crc32(F.col("_text").cast("binary"))
    sizes = tables.written(set_sizes(rows.filter("_id IS NOT NULL"), width), "set_sizes")
    near = sizes.filter(f"n_shingles > 0 AND 100 * shared >= {percent} * n_shingles").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    texts = IdFilter(near, "_id").mark(rows, "_id", "_maybe").filter("_maybe").withColumn("_tag", tag).join(near, ["_id", "_tag"]).select("_id", "_tag", "_text")
    sets = tables.written(texts.mapInArrow(_sets(width), "doc_id long, tag long, set_key string, elements array<long>"), "sets")
    classes = sets.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.first("elements").alias("elements"))
    classes = tables.written(classes.select(F.monotonically_increasing_id().alias("c"), "set_key", "first_id", F.size("elements").cast("long").alias("size"), "elements"), "classes")
    members = tables.written(sets.select("doc_id", "tag", "set_key").distinct().join(classes.select("set_key", "c", "first_id"), "set_key").drop("set_key"), "members")
    tables.drop(sets)
    links = class_links(classes, percent, tables=tables)
    tables.drop(classes)
    comps = components(links).select(F.col("node").alias("c"), "component")
    named = members.join(comps, "c", "left").withColumn("comp", F.coalesce("component", "c"))
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    linked = named.join(smallest, "comp").select("doc_id", "tag", "component_id")
    known = sizes.select("doc_id", "tag", "n_shingles").join(linked, ["doc_id", "tag"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    known = tables.written(known, "groups")
    tables.drop(*(t for t, _ in list(tables.paths.values()) if t is not known))
    out = rows.filter("_id IS NOT NULL").select(F.col("_id").alias("doc_id"), tag.alias("tag")).join(known, ["doc_id", "tag"])
    nameless = rows.filter("_id IS NULL").select("_id", tag.alias("_tag"), "_text").mapInArrow(_sets(width), "doc_id long, tag long, set_key string, elements array<long>")
    return out.unionByName(nameless.select("doc_id", "tag", F.size("elements").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the set size and group of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS t FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.t = e.a
)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(t) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""
