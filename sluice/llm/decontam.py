"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Texts are lower-cased (A-Z only); words are runs of ASCII letters, digits and non-ASCII characters. The windows of an
item are all its runs of `window` consecutive words, or the item itself if it has fewer (but any). A window is
contained in a document only if its rarest word is, so this one word is its necessary prefix: rarity is counted over
all documents, the document's words are joined with the prefixes, the word's place in the window gives the start,
which must leave room on both sides (length and positional bounds), and what is left is compared word by word.

Items are indexed in pieces of bounded size. All pieces go through in one read of the documents: a task takes a batch
through one index after the other and holds one at a time. With more than one piece rarity is counted by hash buckets,
in one read for all of them; which of a window's words is its prefix has no influence on what is found.

Null and empty texts have no words and no hits. Repeated documents each get a row; repeated items count once.
An item whose id is null marks words and counts as an item of the name "null". No documents give no rows, no items no
hits. Texts of any length are read whole. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import lean, raw

#: Bytes of item text in an index, of which a task holds one at a time; log2 of the buckets in which words are counted.
PIECE_BYTES = 4 << 20
BUCKET_BITS = 18
SLICE_BYTES = 1 << 20
RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Index:
    """Windows of some items, each under its rarest word."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        named: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                named.setdefault(tuple(ids[i : i + window]), set()).add(name)
        self.names = [sorted(x) for x in named.values()]
        self.length = np.array([len(x) for x in named], np.int64)
        self.words = np.full((len(named), window), -2, np.int32)
        for row, ids in zip(self.words, named, strict=True):
            row[: len(ids)] = ids

    def order(self, counts: np.ndarray) -> None:
        """Puts every window under its rarest word; counts: occurrences by word number (ties go to the smaller one)."""
        count = np.append(counts, 0)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        self.offset = np.argmin(np.where(self.words >= 0, rank[self.words], 1 << 62), axis=1) if len(self.words) else np.zeros(0, np.int64)
        prefix = self.words[np.arange(len(self.words)), self.offset]
        self.under = np.argsort(prefix, kind="stable")
        self.first = np.searchsorted(prefix[self.under], np.arange(len(self.vocabulary) + 1))

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in ws), np.int32, len(ws))

    def find(self, ids: np.ndarray, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, window numbers) of the windows that occur in a document."""
        known = np.nonzero(ids >= 0)[0]
        n = self.first[ids[known] + 1] - self.first[ids[known]]
        known, n = known[n > 0], n[n > 0]
        for at in range(0, len(known), block):
            p, k = known[at : at + block], n[at : at + block]
            within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            w = self.under[np.repeat(self.first[ids[p]], k) + within]
            start = np.repeat(p, k) - self.offset[w]
            fits = (start >= 0) & (start + self.length[w] <= len(ids))
            start, w = start[fits], w[fits]
            for j in range(self.words.shape[1]):
                if not len(w):
                    break
                there = self.words[w, j]
                equal = (there == -2) | (ids[np.minimum(start + j, len(ids) - 1)] == there)
                start, w = start[equal], w[equal]
            if len(w):
                yield start, w


def _bucket(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) >> (32 - BUCKET_BITS)


def _counts(docs: DataFrame, index: Index) -> np.ndarray:
    """Occurrences in all documents of each word of the index."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(index.vocabulary)
    return _counted(docs, lambda ws: np.fromiter((vocabulary.value.get(w, -1) for w in ws), np.int64, len(ws)), len(index.vocabulary))


def _bucket_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences in all documents of the words of each bucket."""
    return _counted(docs, lambda ws: np.fromiter(map(_bucket, ws), np.int64, len(ws)), 1 << BUCKET_BITS)


def _counted(docs: DataFrame, numbers: Callable[[list[bytes]], np.ndarray], size: int) -> np.ndarray:
    """How often each number below `size` comes up among those of the documents' words; -1 is none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for b in batches:
            for text in b.column(0):
                total += np.bincount(numbers(words(raw(text))) + 1, minlength=size + 1)
        some = np.nonzero(total[1:])[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1:][some])], ["word", "n"])

    out = np.zeros(size, np.int64)
    for r in docs.mapInArrow(lean(work), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


def _slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of one document or of about SLICE_BYTES of text, whose words are held together."""
    begin = size = 0
    for i, text in enumerate(batch.column(text_at)):
        n = len(text.as_buffer()) if text.is_valid else 0
        if size and size + n > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _held(index: Broadcast, alone: bool) -> Index:
    """A broadcast index; unless it is the only one, the worker does not keep it."""
    value = index.value
    if not alone:
        index.__dict__.pop("_value", None)
    return value


def _hits(indexes: list[Broadcast], text_at: int, clean_only: bool) -> Callable:
    """mapInArrow function: adds RESULT to the rows, or keeps those without hits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in _slices(whole, text_at)):
            texts = [words(raw(t)) for t in b.column(text_at)]
            found: list[list[np.ndarray]] = [[] for _ in texts]
            names: list[set[str]] = [set() for _ in texts]
            for index in indexes:
                ix = _held(index, len(indexes) == 1)
                for ws, bounds, who in zip(texts, found, names, strict=True):
                    ids = ix.numbers(ws)
                    for start, w in ix.find(ids):
                        bounds.append(np.stack([start, start + ix.length[w]], 1).ravel())
                        who.update(x for one in np.unique(w) for x in ix.names[one])
            merged = [_merge(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]
            n_hit = [int((x[1::2] - x[::2]).sum()) for x in merged]
            if clean_only:
                yield b.filter(pa.array([n == 0 for n in n_hit], pa.bool_()))
                continue
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
            sums = [pa.array(map(len, texts), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *sums], [*b.schema.names, *(f.name for f in RESULT)])

    return work


def _merge(bounds: np.ndarray) -> np.ndarray:
    """Disjoint sorted [start, end) pairs that cover the given ones."""
    if len(bounds) < 4:
        return bounds
    x = bounds.reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    fresh = np.concatenate([[True], x[1:, 0] > reach[:-1]])
    return np.stack([x[fresh, 0], reach[np.concatenate([np.nonzero(fresh)[0][1:] - 1, [len(x) - 1]])]], 1).ravel()


def _scan(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, piece_bytes: int, clean_only: bool) -> DataFrame:
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col).cast("binary"), F.lit(b"")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    pieces = max(1, -(-total // piece_bytes))
    texts, buckets, indexes = docs.select(text_col), None, []
    for i in range(pieces):
        index = Index([(r[0], bytes(r[1])) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(pieces)) == i).collect()], window)
        if pieces == 1:
            index.order(_counts(texts, index))
        else:
            buckets = _bucket_counts(texts) if buckets is None else buckets
            index.order(buckets[np.fromiter(map(_bucket, index.vocabulary), np.int64, len(index.vocabulary))])
        indexes.append(docs.sparkSession.sparkContext.broadcast(index))
    schema = docs.schema if clean_only else T.StructType(docs.schema.fields + RESULT)
    return docs.mapInArrow(lean(_hits(indexes, docs.columns.index(text_col), clean_only)), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per document: its id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated."""
    return _scan(docs.select(F.col(id_col), F.col(text_col).alias("document_text")), benchmark, "document_text", item_col, item_text_col, window, piece_bytes, False).drop("document_text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, without those that hold a window of an item."""
    return _scan(docs, benchmark, text_col, item_col, item_text_col, window, piece_bytes, True)
