"""Byte-level BPE by a table of distinct words, and decoding by a table of pieces.

Texts are split into words in Spark. A task turns a block of texts into its distinct words and, for each place of a text,
the number of the word there (frequent words have small numbers, so that places compress well). Words meet by hash in
partitions, where each distinct word is encoded once, and the ids go back to the blocks that hold the word; there they
are joined to the places. Blocks hold a bounded number of distinct words, so a word in a third of all texts travels once
a block. Decoding joins ids with the table of pieces, which the vocabulary bounds: it is broadcast, and a text's pieces
are joined to one text.

Words are what the tokenizer's own splitting gives: added tokens first, then its pattern. Words of different hashes are
never taken for each other: they travel whole.

Defined cases: null text counts as empty, and an empty text has no ids. Texts and words of any length are taken whole; a
text longer than a block makes a block of its own. Rows that share an id are encoded each on its own, null ids stay.
Empty tables give no rows; other columns are ignored. Ids outside the vocabulary decode to nothing, and bytes that are no
UTF-8 to the replacement character, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, blocks, mix
from .packed import bucket_of
from .packing import byte_letters
from .shared import Tables, partitions, thrifty

#: Bytes of text and distinct words after which a block ends, at the next text's end.
BLOCK_BYTES, BLOCK_WORDS = 32 << 20, 1 << 18
#: Kinds of rows: places of a block's texts, words for a bucket, ids for a block.
_PLACES, _WORDS, _IDS = 0, 1, 2
_ROW = "kind int, block long, bucket int, names binary, a binary, b binary, c binary"
_JOINED = ["names", "a", "b", "replies"]

# The pattern of byte-level splitting, and the same for texts below U+0100 in the syntax of `re`.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_latin = re.compile(LATIN)
# Besides U+0000 to U+00FF, ranges whose letters, digits and spaces are the same in every version of Unicode
# that libraries use: Latin, Greek, Cyrillic, kana, Han, Hangul, punctuation, arrows and pictures.
SETTLED = "\x00-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u2010-\u2027\u2030-\u205e\u2190-\u21ff\u3000-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001faff"
_settled = re.compile(f"[{SETTLED}]*")


def _squeezed(*values: bytes) -> list[bytes]:
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    return [c.compress(v) for v in values]


def _whole(value) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(value)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, which compresses far better than one after the other."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Tokenizer:
    """Splits texts as the definition says, and encodes single words. Only plain byte-level definitions are taken."""

    def __init__(self, definition: str):
        import regex
        from tokenizers import Tokenizer as Library

        d = json.loads(definition)
        pre = d["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not d["normalizer"] and d["model"].get("type", "BPE") == "BPE"
        simple = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in d["added_tokens"])
        if not plain or not simple or (d["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE without normaliser and with plain added tokens")
        self.library = Library.from_str(definition)
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.any = regex.compile(PATTERN)
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        bytes_of = {c: i for i, c in self.letters.items()}
        self.pieces = [b""] * (1 + max([*d["model"]["vocab"].values(), *self.added.values()]))
        for piece, i in d["model"]["vocab"].items():
            self.pieces[i] = bytes(bytes_of[c] for c in piece)
        for piece, i in self.added.items():
            self.pieces[i] = piece.encode()

    def _found(self, text: str) -> list[str]:
        """Words of a text without added tokens. Where versions of Unicode may differ, the library's own splitting decides."""
        if text.isascii() or max(text) <= "\xff":
            return _latin.findall(text)
        if _settled.fullmatch(text):
            return self.any.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if not self.cut or not any(t in text for t in self.added):
            return self._found(text)
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.added else self._found(part))]

    def ids(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        return [t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]


_loaded: dict[int, Tokenizer] = {}


def _tokenizer(definition: str) -> Tokenizer:
    key = hash(definition)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(definition)
    return _loaded[key]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _row(kind: int, block: int, bucket: int, *values: bytes) -> pa.RecordBatch:
    values = [*values, *[None] * (4 - len(values))]
    cols = [pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([v], pa.binary()) for v in values)]
    return pa.RecordBatch.from_arrays(cols, ["kind", "block", "bucket", "names", "a", "b", "c"])


def _split(definition, n: int, block_bytes: int, block_words: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(definition.value)

        def ended(numbers: dict, ids: list, known: list, counts: list, places: list) -> Iterator[pa.RecordBatch]:
            block = random.getrandbits(62)
            at = np.concatenate(places) if places else np.empty(0, np.uint32)
            often = np.argsort(-np.bincount(at, minlength=len(numbers)), kind="stable")
            new = np.empty(len(numbers), np.uint32)
            new[often] = np.arange(len(numbers), dtype=np.uint32)
            names = np.array(ids, np.int64).tobytes() + np.array(known, np.uint8).tobytes()
            yield _row(_PLACES, block, 0, names, *_squeezed(np.array(counts, np.int64).tobytes(), _planes(new[at])))
            words = [w.encode() for w in numbers]
            words = [words[i] for i in often]
            to = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
            to = bucket_of(mix(to.astype(U64)), n)
            order = np.argsort(to, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0])) if len(order) else np.empty(0, np.int64)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                own = [words[i] for i in order[a:b].tolist()]
                lengths = np.fromiter(map(len, own), np.uint32, len(own))
                yield _row(_WORDS, block, int(to[order[a]]), None, *_squeezed(b"".join(own), _planes(lengths), _planes(np.diff(order[a:b], prepend=0))))

        held: tuple[dict, list, list, list, list] = (_Numbers(), [], [], [], [])
        size = 0
        for texts in blocks(batches, "_text", 1 << 20):
            ids, known = texts.ints("_id")
            for i in range(len(texts)):
                numbers, own_ids, own_known, counts, places = held
                text = texts.text(i)
                words = tokenizer.words(text.decode("utf-8", "replace"))
                own_ids.append(int(ids[i]))
                own_known.append(bool(known[i]))
                counts.append(len(words))
                places.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(text)
                if size >= block_bytes or len(numbers) >= block_words:
                    yield from ended(*held)
                    held, size = (_Numbers(), [], [], [], []), 0
        if held[1]:
            yield from ended(*held)

    return run


def _lists(words: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths.astype(np.int64))
    return [words[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def _encoded(definition):
    """Each distinct word of a bucket is encoded once; its ids go to every block that asked."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(definition.value)
        found: dict[bytes, bytes] = {}
        for b in batches:
            for block, words, lengths, slots in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "a", "b", "c")), strict=True):
                out = []
                for w in _lists(_whole(words), _from_planes(_whole(lengths))):
                    ids = found.get(w)
                    if ids is None:
                        ids = found[w] = np.array(tokenizer.ids(w.decode()), "<u4").tobytes()
                    out.append(ids)
                sizes = np.fromiter(map(len, out), np.uint32, len(out)) >> 2
                yield _row(_IDS, block, 0, None, *_squeezed(_planes(np.frombuffer(b"".join(out), "<u4")), _planes(sizes)), slots)

    return run


def _texts(names: bytes, counts: bytes, places: bytes, replies: list[dict]) -> Iterator[pa.RecordBatch]:
    """Ids of the texts of a block: those of its words, joined to its places."""
    parts = [(np.cumsum(_from_planes(_whole(r["c"])).astype(np.int64)), _from_planes(_whole(r["b"])).astype(np.int64), _from_planes(_whole(r["a"]))) for r in replies]
    n_words = sum(len(slots) for slots, _, _ in parts)
    size, start = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
    flat = np.concatenate([np.empty(0, np.uint32), *(ids for _, _, ids in parts)])
    before = 0
    for slots, sizes, own in parts:
        size[slots] = sizes
        start[slots] = before + np.cumsum(sizes) - sizes
        before += len(own)
    k = len(names) // 9
    ids, known = np.frombuffer(names, np.int64, k), np.frombuffer(names, np.uint8, offset=8 * k)
    n, at = np.frombuffer(_whole(counts), np.int64), _from_planes(_whole(places))
    end = np.cumsum(n)
    lo = 0
    while lo < k:  # about a million places at a time
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] + (1 << 20), "right")))
        own = at[end[lo] - n[lo] : end[hi - 1]]
        sizes = size[own]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(start[own] - ends[:-1], sizes) + np.arange(ends[-1])
        cut = ends[np.concatenate([[0], np.cumsum(n[lo:hi])])]
        values = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(4 * cut), pa.py_buffer(flat[take].astype("<u4"))])
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], mask=known[lo:hi] == 0), pa.array(np.diff(cut)), values.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])
        lo = hi


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            names, counts, places, replies = (b.column(b.schema.get_field_index(c))[k].as_py() for c in _JOINED)
            yield from _texts(names, counts, places, replies or [])


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, n_tokens, ids): a text's ids as little-endian 32-bit numbers."""
    spark = docs.sparkSession
    n = partitions(spark)
    with open(tokenizer_path, encoding="utf-8") as f:  # the driver's copy goes to the workers
        definition = f.read()
    Tokenizer(definition)
    sent = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    parts = Tables(spark).bucketed(rows.mapInArrow(_split(sent, n, block_bytes, block_words), _ROW), "words_and_places", "block")
    asked = parts.filter(F.col("kind") == _WORDS)
    replies = asked.repartitionById(n, "bucket").mapInArrow(_encoded(sent), _ROW)
    # A block has a bounded number of words, so its replies fit a row. Its places stay where they are, in the block's bucket.
    back = replies.groupBy("block").agg(F.collect_list(F.struct("a", "b", "c")).alias("replies"))
    places = parts.filter(F.col("kind") == _PLACES).select("block", "names", "a", "b")
    return places.join(back.hint("shuffle_merge"), "block", "left").select(_JOINED).mapInArrow(thrifty(_gathered), "doc_id long, n_tokens long, ids binary")


def _joined(pieces, digest: Callable | None = None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[bytes] = pieces.value
        get = table.__getitem__
        top = len(table)
        for b in batches:
            texts, others = [], []
            for value in b.column("ids"):
                ids = np.frombuffer(value.as_buffer(), "<u4") if value.is_valid else np.empty(0, "<u4")
                known = ids if not len(ids) or ids.max() < top else ids[ids < top]
                text = b"".join(map(get, known.tolist()))
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = text.decode("utf-8", "replace").encode()
                texts.append(text)
                if digest:
                    others.append(digest(ids, text))
            keep = [c for c in b.schema.names if c != "ids"] if digest else b.schema.names
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            if digest:
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x[k] for x in others], pa.string()) for k in range(2))], [*keep, "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary()).cast(pa.string())], [*keep, "text"])

    return run


def _pieces(encoded: DataFrame, tokenizer_path: str):
    """The table of pieces by id; its size is the vocabulary's."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return encoded.sparkSession.sparkContext.broadcast(Tokenizer(f.read()).pieces)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded with the column text. encoded: of encode, or any table with a binary column ids of 32-bit numbers."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_joined(_pieces(encoded, tokenizer_path)), f"{kind}, text string")


class _Decimal(dict):
    def __missing__(self, i: int) -> bytes:
        self[i] = out = b"%d" % i
        return out


_decimal = _Decimal()


def _digested(ids: np.ndarray, text: bytes) -> tuple[str, str]:
    listed = b",".join(map(_decimal.__getitem__, ids.tolist()))
    return hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()


def digests(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): what encode and decode give, as digests."""
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_joined(_pieces(encoded, tokenizer_path), _digested), kind)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: ids of all documents, and the texts decoded from them, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode(docs, path), path)
