r"""Benchmark decontamination over a distributed positional inverted index.

The training texts are indexed in segments, one row for each block of documents: the words they share with the
benchmark, each with its ascending list of positions. A segment holds whole documents, so the index needs no shuffle
and a word that every document holds is split over all segments. Items are searched segment by segment: the lists of a
phrase's words are shifted by their place in the phrase and intersected, rarest first. An item matches where a window
of `width` consecutive words of it occurs; an item of fewer words, but not none, is one window.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text with A-Z lower-cased, and are told apart by 64-bit hashes.

Defined cases: null or empty text has no words, is not contaminated and gives an item no window. Items whose id is null
are left out; items that share an id count once. Every input row gives a row, also those that share an id or have none.
The benchmark is the stated query set: it is searched in blocks of bounded size, each against every segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, blocks, find_words, span_hashes
from .shared import written

WIDTH = 10
#: Characters of benchmark text in one block of the query set.
BLOCK_CHARS = 32_000_000
#: Distinct benchmark words up to which the index keeps only their postings; beyond it keeps every word's.
MAX_VOCABULARY = 2_000_000
#: Free positions between two documents of a segment.
GAP = 64

SEGMENT = "segment long, ids binary, id_known binary, n_words binary, terms binary, counts binary, steps binary"


def term_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The words' hashes of each text."""
    offs = np.cumsum([0, *map(len, texts)])
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    w = find_words(data, offs, ALNUM)
    h = span_hashes(data, w.starts, w.ends)
    return [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def _indexed(vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = None if vocabulary is None else vocabulary.value
        for block in blocks(batches, "_text"):
            data = LOWER[block.data]
            w = find_words(data, block.offs, ALNUM)
            h = span_hashes(data, w.starts, w.ends)
            at = np.arange(len(h)) + np.repeat(np.arange(len(block)) * GAP, w.counts)
            if known_words is None:
                terms, term = np.unique(h, return_inverse=True)
            else:
                terms = known_words
                term = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
                mine = terms[term] == h if len(terms) else np.zeros(len(h), bool)
                term, at = term[mine], at[mine]
            order = np.argsort(term.astype(np.uint16) if len(terms) < 65536 else term, kind="stable")
            term, at = term[order], at[order]
            n = np.bincount(term, minlength=len(terms))
            first = np.cumsum(n) - n
            step = np.diff(at, prepend=0)
            used = np.flatnonzero(n)
            step[first[used]] = at[first[used]]
            ids, known = block.ints("_id")
            row = [uuid.uuid4().int >> 65, ids.tobytes(), known.tobytes(), w.counts.astype(np.uint32).tobytes(), terms[used].tobytes(), n[used].astype(np.uint32).tobytes(), step.astype(np.uint32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], ["segment", "ids", "id_known", "n_words", "terms", "counts", "steps"])

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: np.ndarray | None = None) -> DataFrame:
    """The index as a table in the shared folder. vocabulary: sorted hashes of the only words to index."""
    spark = docs.sparkSession
    own = None if vocabulary is None or len(vocabulary) > MAX_VOCABULARY else spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return written(rows.mapInArrow(_indexed(own), SEGMENT), "positional_index")


class Segment:
    """The postings of one index row."""

    def __init__(self, row: dict):
        self.id = row["segment"]
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_known"], bool)
        self.n_words = np.frombuffer(row["n_words"], np.uint32).astype(np.int64)
        self.start = np.cumsum(self.n_words) - self.n_words + np.arange(len(self.n_words)) * GAP
        terms, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.steps, self.terms, self.counts, self.first = np.frombuffer(row["steps"], np.uint32), terms, counts, np.cumsum(counts) - counts
        self.lists: dict[int, np.ndarray] = {}

    def places(self, words: np.ndarray) -> np.ndarray:
        """The index of each word's list, -1 where no document has it."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def postings(self, place: int) -> np.ndarray:
        if place not in self.lists:
            a = self.first[place]
            self.lists[place] = np.cumsum(self.steps[a : a + self.counts[place]].astype(np.int64))
        return self.lists[place]

    def phrase(self, places: np.ndarray) -> np.ndarray:
        """Positions at which the words of these lists follow each other."""
        found: np.ndarray | None = None
        for k in np.argsort(self.counts[places], kind="stable"):
            shifted = self.postings(int(places[k]))
            if found is None:
                found = shifted - k
                continue
            if not len(found):
                break
            at = np.searchsorted(shifted, found + k)
            at[at == len(shifted)] = 0
            found = found[shifted[at] == found + k]
        return found if found is not None else np.empty(0, np.int64)

    def within(self, places: np.ndarray, span: int) -> np.ndarray:
        """Starts of stretches of at most span words of one document that hold all the words, one start for each word that begins one."""
        starts = np.unique(np.concatenate([self.postings(int(p)) for p in places]))
        end = starts.copy()
        for k in np.argsort(self.counts[places], kind="stable"):  # the rarest leaves the fewest
            post = self.postings(int(places[k]))
            at = np.searchsorted(post, starts)
            ok = at < len(post)
            starts, end, at = starts[ok], end[ok], at[ok]
            end = np.maximum(end, post[at])
            ok = end - starts < span
            starts, end = starts[ok], end[ok]
        doc = self.document(starts)
        return starts[doc == self.document(end)]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, positions, "right") - 1


def _windows(segment: Segment, words: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Starts of every occurrence of any window of the item, and the window's length."""
    k = min(width, len(words))
    places = segment.places(words)
    seen = np.cumsum(np.concatenate([[0], places >= 0]))
    whole = np.flatnonzero(seen[k:] - seen[:-k] == k)
    found = [segment.phrase(places[i : i + k]) for i in whole]
    found = [x for x in found if len(x)]
    return (np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)), k


def _spans(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(starts[new], ends[np.append(new[1:], len(starts)) - 1], strict=True)]


FOUND = "segment long, doc_no int, doc_id long, n_words long, spans array<struct<lo: int, hi: int>>, items array<string>"


def _searched(items, width: int, all_rows: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.list_(pa.string())]
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                hits: dict[int, tuple[list, list, set]] = {}
                for item, words in items.value:
                    starts, k = _windows(s, words, width)
                    if len(starts):
                        doc = s.document(starts)
                        cut = np.flatnonzero(np.diff(doc)) + 1
                        for part in np.split(np.arange(len(starts)), cut):
                            d = int(doc[part[0]])
                            h = hits.setdefault(d, ([], [], set()))
                            h[0].append(starts[part] - s.start[d])
                            h[1].append(starts[part] - s.start[d] + k)
                            h[2].add(item)
                pick = np.arange(len(s.ids)) if all_rows else np.array(sorted(hits), np.int64)
                spans = [_spans(np.concatenate(hits[d][0]), np.concatenate(hits[d][1])) if d in hits else [] for d in pick.tolist()]
                names = [sorted(hits[d][2]) if d in hits else [] for d in pick.tolist()]
                cols = [np.full(len(pick), s.id), pick, pa.array(s.ids[pick], mask=~s.known[pick]), s.n_words[pick], spans, names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(cols, kind, strict=True)], ["segment", "doc_no", "doc_id", "n_words", "spans", "items"])

    return run


def query_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[list[tuple[str, np.ndarray]]]:
    """The query set in blocks of about BLOCK_CHARS characters: item id as text, hashes of its words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter("i IS NOT NULL")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 + int(chars) // BLOCK_CHARS
    out = []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        hashes = term_hashes([r["t"].encode() for r in rows])
        out.append([(r["i"], h) for r, h in zip(rows, hashes, strict=True) if len(h)])
    return out


def vocabulary_of(query: list[list[tuple[str, np.ndarray]]]) -> np.ndarray:
    return np.unique(np.concatenate([h for block in query for _, h in block] or [np.empty(0, np.uint64)]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (hit stretches of words, from lo to before hi), items, contaminated."""
    query_set = query_blocks(benchmark, item_col, item_text_col)
    index = build_index(docs, id_col, text_col, vocabulary_of(query_set))
    send = docs.sparkSession.sparkContext.broadcast
    found = [index.mapInArrow(_searched(send(block), width, k == 0), FOUND) for k, block in enumerate(query_set)]
    rows = found[0]
    if len(found) > 1:
        for other in found[1:]:
            rows = rows.unionByName(other)
        rows = rows.groupBy("segment", "doc_no").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        rows = rows.withColumn("spans", _merged(F.array_sort("spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"), (n_hit > 0).alias("contaminated"))


def _merged(spans):
    """Overlapping sorted spans as one each."""
    empty = F.slice(spans, 1, 0)
    last = lambda out: F.element_at(out, -1)

    def step(out, x):
        joined = F.struct(last(out)["lo"].alias("lo"), F.greatest(last(out)["hi"], x["hi"]).alias("hi"))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["hi"] >= x["lo"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(spans, empty, step)


def near(index: DataFrame, queries: list[tuple[str, str]], span: int) -> DataFrame:
    """Proximity matches: rows (doc_id, query, position) where all words of a query stand within span words, in any order.

    index: made without a vocabulary, or with one that holds the queries' words. position: of the first of these words.
    queries: (name, text) pairs, a stated and small set.
    """
    hashes = term_hashes([t.encode() for _, t in queries])
    sent = index.sparkSession.sparkContext.broadcast([(q, np.unique(h)) for (q, _), h in zip(queries, hashes, strict=True) if len(h)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                for name, words in sent.value:
                    places = s.places(words)
                    if (places >= 0).all():
                        starts = s.within(places, span)
                        d = s.document(starts)
                        yield pa.RecordBatch.from_arrays([pa.array(s.ids[d], mask=~s.known[d]), pa.array([name] * len(d), pa.string()), pa.array(starts - s.start[d], pa.int64())], ["doc_id", "query", "position"])

    return index.mapInArrow(run, "doc_id long, query string, position long")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: benchmark windows in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: translate() lower-cases A-Z only.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT k FROM q
), win AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)
), hit AS (
  SELECT win.doc_id, q.item_id, win.i, win.k FROM win JOIN q ON win.p = q.p AND win.k = q.k
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
