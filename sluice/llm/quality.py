"""Quality classifier by importance resampling.

Two hashed n-gram models, bags of byte n-grams in a fixed number of buckets, are fitted: the target's from labelled
good documents (a bounded sample, see `max_target`), the raw text's from all documents. A document's importance is the
log ratio of its likelihoods under the two, tempered for long ones: evidence of more than EVIDENCE n-grams counts like
that of so many, so that a document's length alone decides little. Standard Gumbel noise, a hash of seed and id, is
added to the importance, and the k largest sums stay: a draw of k documents without replacement, with weights
exp(importance). k is given, or a share of the documents with an n-gram: that of label 1 among all labelled rows, plus
two standard errors of it, since a good document lost costs more than a poor one kept. The k-th largest is found
exactly by radix selection, 16 bits of the sums a round.

Null and short texts without an n-gram have importance 0, take no part in the draw and stay: `selected` is true. Rows
with equal ids get equal noise; ties with the k-th largest all stay, so repeated rows stay or go together. Labels other
than 0 and 1 are none. Without labels the models are equal, importance is 0 and k is all. An empty table gives no rows.
Texts of any length are worked through in pieces. Columns of `docs` may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import cut, raw, smallest_hashes, unused

#: log2 of the buckets; n-gram lengths in bytes (up to 8).
BUCKET_BITS = 16
LENGTHS = (4, 8)
#: Occurrences of each bucket that the target model takes from the raw model, so that what it hasn't seen counts little.
PRIOR = 8.0
#: N-grams whose evidence counts in full; that of more is scaled down to so many.
EVIDENCE = 256
#: Standard errors of the share of good labels that k is above it.
ERRORS = 2.0
#: Labelled documents used for the target model at most: those with the smallest hash of their id.
MAX_TARGET = 20_000
#: Bytes of a text that are worked on at once.
PIECE = 1 << 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _grams(text: bytes, bits: int, lengths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, each n in buckets of its own, in pieces of bounded size."""
    longest = max(lengths)
    for at in range(0, max(len(text), 1), PIECE):
        a = np.frombuffer(text[at : at + PIECE + longest - 1], np.uint8).astype(np.uint64)
        begun = min(PIECE, len(text) - at)
        for i, n in enumerate(lengths):
            m = min(begun, len(a) - n + 1)
            if m <= 0:
                continue
            x = a[:m].copy()
            for j in range(1, n):
                x |= a[j : j + m] << np.uint64(8 * j)
            yield ((x * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64) + (i << bits)


def _model(texts: DataFrame, bits: int, lengths: tuple[int, ...]) -> np.ndarray:
    """N-grams of all texts by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lengths) << bits, np.int64)
        for b in batches:
            for text in b.column(0):
                for g in _grams(raw(text), bits, lengths):
                    total += np.bincount(g, minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = np.zeros(len(lengths) << bits, np.float64)
    for r in texts.mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def _log_ratio(target: np.ndarray, raw: np.ndarray, bits: int) -> np.ndarray:
    """Per bucket, log of the target's share over the raw text's, each n-gram length on its own.

    The target's share is smoothed towards the raw text's by PRIOR occurrences, so an absence counts by how many
    occurrences were to be expected.
    """
    out = np.zeros(len(raw))
    for at in range(0, len(raw), 1 << bits):
        t, r = target[at : at + (1 << bits)], raw[at : at + (1 << bits)]
        if t.sum():
            out[at : at + (1 << bits)] = np.log((t + PRIOR) / (r / max(1.0, r.sum()) * t.sum() + PRIOR))
    return out


def gumbel(seed: int, key: Column) -> Column:
    """Standard Gumbel noise as a function of seed and key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def log_ratio(docs: DataFrame, target: DataFrame, text_col: str = "text", bits: int = BUCKET_BITS, lengths: tuple[int, ...] = LENGTHS) -> np.ndarray:
    """The importance of an n-gram by bucket; `target` has the texts of the target model in `text_col`."""
    model = lambda df: _model(df.select(text_col), bits, lengths)
    return _log_ratio(model(target), model(docs), bits).astype(np.float32)


def _scored(df: DataFrame, text_col: str, weights: np.ndarray, bits: int, lengths: tuple[int, ...], keep_text: bool, ratio: str, grams: str) -> DataFrame:
    """`df`, with its text column or without, and columns `ratio` (log ratio of the whole text) and `grams` (its n-grams)."""
    weight = df.sparkSession.sparkContext.broadcast(weights)
    text_at = df.columns.index(text_col)
    kept = [i for i in range(len(df.columns)) if keep_text or i != text_at]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(ratio, T.DoubleType()), T.StructField(grams, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, count = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column(text_at)):
                for g in _grams(raw(text), bits, lengths):
                    value[i] += weight.value[g].sum(dtype=np.float64)
                    count[i] += len(g)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(value), pa.array(count)], schema.names)

    return df.mapInArrow(work, schema)


def importance(ratio: Column, grams: Column, evidence: int = EVIDENCE) -> Column:
    return ratio * F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest(grams, F.lit(1)))


def drawn_key(value: Column, id_: Column, seed: int) -> Column:
    """Importance and noise."""
    return value + gumbel(seed, F.coalesce(id_.cast("string"), F.lit("null")))


def _step(key: Column) -> Column:
    """The key in steps of 2**-32, as a non-negative long."""
    bounded = F.greatest(F.least(key, F.lit(float(1 << 20))), F.lit(-float(1 << 20)))
    return F.round(bounded * float(1 << 32)).cast("long") + F.lit(1 << 61).cast("long")


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of non-negative longs, exactly; None if k exceeds the rows or is not positive."""
    if k < 1:
        return None
    prefix, known = 0, 0
    for shift in (48, 32, 16, 0):
        within = df if not known else df.where(F.shiftright(F.col(column), shift + 16) == prefix)
        digits = within.groupBy(F.shiftright(F.col(column), shift).bitwiseAND(F.lit(0xFFFF).cast("long")).alias("digit")).count().collect()
        for digit, n in sorted(((r[0], r[1]) for r in digits), reverse=True):
            if k <= n:
                break
            k -= n
        else:
            return None
        prefix, known = prefix << 16 | digit, known + 16
    return prefix


def target_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_target: int = MAX_TARGET) -> DataFrame:
    """The documents whose label is 1, `max_target` ids of them at most, chosen by a hash of the id."""
    (own,) = unused(docs, "good_id")
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias(own)).where(F.col(own).isNotNull()).distinct()
    chosen = smallest_hashes(good, own, max_target)
    return docs.join(F.broadcast(chosen), docs[id_col] == F.col(own), "left_semi")


def good_share(labels: DataFrame, label_col: str = "quality", errors: float = ERRORS) -> float:
    """The share of label 1 among all labels 0 and 1, plus `errors` standard errors; 1 without labels."""
    n, good = labels.where(F.col(label_col).isin(0, 1)).agg(F.count("*"), F.sum(F.col(label_col).cast("long"))).first()
    if not n:
        return 1.0
    share = good / n
    return min(1.0, share + errors * (share * (1 - share) / n) ** 0.5)


def _draw(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, k: int | None, seed: int, max_target: int) -> tuple[np.ndarray, DataFrame, int | None, int]:
    """(weights by bucket, scores of all rows, the least step that stays or None for all, k)."""
    target = cut(target_rows(docs, labels, id_col, label_col, max_target).select(F.col(text_col)))
    weights = log_ratio(docs, target, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    scored = _scored(rows, "text", weights, BUCKET_BITS, LENGTHS, False, "ratio", "grams").withColumn("importance", importance(F.col("ratio"), F.col("grams")))
    scored = scored.withColumn("key", drawn_key(F.col("importance"), F.col("id"), seed))
    scored = cut(scored.withColumn("step", _step(F.col("key"))))
    drawn_from = scored.where("grams > 0")
    if k is None:
        k = math.ceil(good_share(labels, label_col) * drawn_from.count())
    return weights, scored, kth_largest(drawn_from, "step", k), k


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, seed: int = 11, max_target: int = MAX_TARGET) -> DataFrame:
    """id, text_hash, importance, grams, key (importance + noise), selected per row of `docs`."""
    _, scored, least, k = _draw(docs, labels, id_col, text_col, label_col, k, seed, max_target)
    stays = F.lit(k > 0) if least is None else F.col("step") >= least
    return scored.select("id", "text_hash", "importance", "grams", "key", (stays | (F.col("grams") == 0)).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, seed: int = 11, max_target: int = MAX_TARGET) -> DataFrame:
    """The rows of `docs`, all columns, that `select` selects.

    Whether a row stays depends on it and the cut alone, so rows are scored again where they are and none is shuffled.
    """
    weights, _, least, k = _draw(docs, labels, id_col, text_col, label_col, k, seed, max_target)
    ratio, grams = unused(docs, "ratio", "grams")
    scored = _scored(docs, text_col, weights, BUCKET_BITS, LENGTHS, True, ratio, grams)
    key = drawn_key(importance(F.col(ratio), F.col(grams)), F.col(id_col), seed)
    stays = F.lit(k > 0) if least is None else _step(key) >= least
    return scored.where(stays | (F.col(grams) == 0)).select(*docs.columns)
