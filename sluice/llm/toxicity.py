"""Toxicity: a counterfactual-regularised classifier.

Texts become the set of the hashed beginnings of their words (lower-cased, 3 to 8 bytes, so whole short words and
stems). Logistic regression is fitted to a bounded sample of labelled documents, on the stems that tell the labels
apart best. For each sampled document that names an identity group, counterfactuals are made by swapping the terms for
those of other groups of the same kind; the squared difference of the scores, before the sigmoid, is penalised, so a
neutral mention of a group moves the score little. Inputs of a score are the text alone.

Null and empty texts get the score of no stems. Repeated rows get equal scores. If labels are missing or all equal,
the score is the share of toxic labels, smoothed. A label that is null is no label; of several labels of a document
each counts; of several documents with a labelled id one is learnt from. An empty table gives no rows. Texts of any
length are read whole, in pieces. Columns besides id, text and labels play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import cut, smallest_hashes

#: log2 of the buckets that stems are hashed to; stem lengths in bytes; stems the model has.
BUCKET_BITS = 18
LENGTHS = (3, 4, 5, 6, 8)
STEMS = 1024
#: Labelled documents to learn from at most: those with the smallest hash of their id.
MAX_TRAIN = 20_000
#: Weights of the penalties: on weights, and on score changes under swaps.
RIDGE = 1.0
FAIRNESS = 5.0
SWAPS = 2
#: Bytes of a text that are worked on at once.
PIECE = 1 << 22
#: Identity terms by kind; a term is swapped for another of its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("american", "mexican", "chinese", "indian", "french", "german", "spanish", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("disabled", "deaf", "blind", "autistic"),
    ("immigrants", "refugees", "natives"),
    ("young", "old"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("ausländer", "einwanderer", "flüchtlinge"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos", "budistas"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs", "bouddhistes"),
    ("immigrés", "réfugiés", "étrangers"),
)
_KIND = {t.encode(): kind for kind in reversed(IDENTITIES) for t in kind}  # a term of two kinds belongs to the first
_TERM = re.compile(rb"(?<![a-z\x80-\xff])(" + b"|".join(_KIND) + rb")(?![a-z\x80-\xff])")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & (1 << 64) - 1 | 1) for i in range(len(LENGTHS))]


def fold(text: bytes | None) -> bytes:
    """ASCII letters in lower case and non-ASCII bytes; all else is a space."""
    return (text or b"").translate(_FOLD)


def stems(folded: bytes, bits: int = BUCKET_BITS) -> np.ndarray:
    """Sorted bucket numbers of the beginnings of the words; a shorter word's beginning includes its end."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, max(1, len(folded)), PIECE):
        a = np.frombuffer(b" " * (at == 0) + folded[max(0, at - 1) : at + PIECE + 8] + b" " * 8, np.uint8)
        begun = np.nonzero((a[1 : PIECE + 1] != 32) & (a[: PIECE + 1][: len(a[1 : PIECE + 1])] == 32))[0] + 1
        begun = begun[begun + 8 <= len(a)]
        word = np.ascontiguousarray(a[begun[:, None] + np.arange(8)]).view(np.uint64).ravel()
        ended = np.cumsum(a[begun[:, None] + np.arange(8)] == 32, axis=1) > 0  # bytes after the word's end do not count
        for n, mult in zip(LENGTHS, _MULTIPLIERS, strict=True):
            kept = _masked(word, ended, n)
            found.append(np.unique((kept * mult) >> np.uint64(64 - bits)).astype(np.int64))
    return np.unique(np.concatenate(found))


def _masked(word: np.ndarray, ended: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes of each word, those from its end on as spaces."""
    bytes_ = np.where(ended, 32, word.view(np.uint8).reshape(-1, 8)).astype(np.uint8) if len(word) else np.zeros((0, 8), np.uint8)
    bytes_[:, n:] = 0
    return np.ascontiguousarray(bytes_).view(np.uint64).ravel()


def counterfactuals(folded: bytes, swaps: int = SWAPS) -> list[bytes]:
    """The text with each identity term swapped for the next, second next, ... of its kind; none without a term."""
    if not _TERM.search(folded):
        return []

    def swapped(by: int) -> bytes:
        def one(m: re.Match) -> bytes:
            kind = _KIND[m[1]]
            return kind[(kind.index(m[1].decode()) + by) % len(kind)].encode()

        return _TERM.sub(one, folded)

    return list(dict.fromkeys(x for x in map(swapped, range(1, swaps + 1)) if x != folded))


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        table = np.zeros(1 << BUCKET_BITS)
        table[self.buckets] = self.weights
        margin = np.array([self.bias + table[stems(fold(t))].sum() for t in texts])
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learnable: Column, max_train: int) -> DataFrame:
    """label, text of at most max_train labelled ids, one document each."""
    usable = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id IS NOT NULL AND __label IN (0, 1)")
    chosen = smallest_hashes(usable.where(learnable), "__id", max_train)
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")  # an id that is repeated in docs gives one text
    return found.groupBy("__id", F.col("__label").alias("label")).agg(one).select("label", "text")


def train(sample: DataFrame, n_stems: int = STEMS, ridge: float = RIDGE, fairness: float = FAIRNESS) -> Model:
    """Fits the model to a bounded table of label, text: stems are counted on the executors, weights fitted on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (1 << BUCKET_BITS) + 1), np.int64)
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[label, stems(fold(text.as_py()))] += 1
                total[label, -1] += 1
        some = np.nonzero(total.sum(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["bucket", "n0", "n1"])

    n = np.zeros((2, (1 << BUCKET_BITS) + 1))
    for r in sample.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        n[:, r.bucket] = r.n0, r.n1
    docs, n = n[:, -1], n[:, :-1]
    if not docs.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((docs[1] + 0.5) / (docs[0] + 1.0))))
    buckets = np.sort(_telling(n, docs)[:n_stems])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                folded = fold(text.as_py())
                own = _known(buckets, stems(folded))
                out.append((label, own, [_known(buckets, stems(x)) for x in counterfactuals(folded)]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.list_(pa.int32())))], ["label", "own", "other"])

    got = sample.mapInArrow(rows, "label int, own array<int>, other array<array<int>>").collect()
    x = np.zeros((len(got), len(buckets)), np.float32)
    swaps = []
    for i, r in enumerate(got):
        x[i, r.own] = 1
        for other in r.other:
            d = x[i].copy()
            d[other] -= 1
            if d.any():
                swaps.append(d)
    y = np.array([r.label for r in got], np.float32)
    weights, bias = _fit(x, y, np.array(swaps, np.float32).reshape(len(swaps), len(buckets)), ridge, fairness)
    return Model(buckets, weights, bias)


def _known(buckets: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Positions in `buckets` of those that were found."""
    at = np.searchsorted(buckets, found)
    at[at == len(buckets)] = 0
    return at[buckets[at] == found].astype(np.int32) if len(buckets) else np.zeros(0, np.int32)


def _telling(n: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Buckets by how surely their share of toxic documents is not the overall one, surest first (signed root of G)."""
    rate = docs[1] / docs.sum()
    total = n.sum(0)
    z = np.where(total > 0, (n[1] - total * rate) / np.sqrt(np.maximum(total, 1) * rate * (1 - rate) + 1.0), 0.0)
    return np.argsort(-np.abs(z), kind="stable")


def _fit(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, ridge: float, fairness: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss + ridge |w|^2 / 2 + fairness (mean of squared score changes) / 2 a row."""
    n = len(x)
    positive = max(1.0, y.sum())
    weight = np.where(y > 0, 0.5 * n / positive, 0.5 * n / max(1.0, n - positive)).astype(np.float32)  # both labels count alike
    xb = np.hstack([x, np.ones((n, 1), np.float32)])
    start = np.random.default_rng(0).normal(size=xb.shape[1]).astype(np.float32)  # not orthogonal to what swaps change
    steepest = _largest(lambda v: xb.T @ (weight * (xb @ v)) * 0.25 / n, start)
    if len(swaps):
        steepest += _largest(lambda v: fairness / len(swaps) * (swaps.T @ (swaps @ v)), start[:-1])

    def descended(rate: float) -> np.ndarray:
        w = back = np.zeros(xb.shape[1], np.float32)
        t = 1.0
        for _ in range(steps):
            after = (1 + float(np.sqrt(1 + 4 * t * t))) / 2  # a numpy scalar would turn all into doubles
            z = w + (t - 1) / after * (w - back)
            p = 1 / (1 + np.exp(-np.clip(xb @ z, -30, 30)))
            g = xb.T @ (weight * (p - y)) / n
            g[:-1] += ridge / n * z[:-1]
            if len(swaps):
                g[:-1] += fairness / len(swaps) * (swaps.T @ (swaps @ z[:-1]))
            back, w, t = w, (z - rate * g).astype(np.float32), after
        return w

    def loss(w: np.ndarray) -> float:
        margin = xb @ w
        fair = fairness / len(swaps) * float(((swaps @ w[:-1]) ** 2).sum()) / 2 if len(swaps) else 0.0
        return float(np.mean(weight * (np.logaddexp(0, margin) - y * margin))) + ridge / n * float(w[:-1] @ w[:-1]) / 2 + fair

    rate, before = 1 / (1.2 * steepest + ridge / n), loss(np.zeros(xb.shape[1], np.float32))
    while True:  # steps that were too long after all, which the estimate makes unlikely, are halved
        with np.errstate(all="ignore"):
            w = descended(rate)
            if loss(w) <= before:
                return w[:-1].astype(np.float64), float(w[-1])
        rate /= 2


def _largest(times: Callable[[np.ndarray], np.ndarray], v: np.ndarray, rounds: int = 40) -> float:
    """The largest eigenvalue of a positive matrix, by power iteration from v."""
    size = float(np.linalg.norm(v)) or 1.0
    for _ in range(rounds):
        v = times(v / size)
        size = float(np.linalg.norm(v))
        if not size:
            return 0.0
    return size


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id as text is 0 modulo folds), score, predicted (1 if score >= 0.5).

    Labels of held-out ids are not learnt from. A null id is not held out and has no label.
    """
    held = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)) == 0
    sample = cut(_sample(docs, labels, id_col, text_col, label_col, ~held(F.col("__id")), max_train))
    model = docs.sparkSession.sparkContext.broadcast(train(sample))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.value.scores([x.as_py() for x in b.column(2)]), pa.float64())], schema.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(work, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
