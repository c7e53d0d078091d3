"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both agree.

A byte-level BPE cuts a text into pre-tokens by a left-to-right pattern in which white space occurs only as the first
character of a pre-token or in runs of its own, so wherever ASCII white space follows a character that is not white
space (by Unicode, so U+00A0 is) a pre-token starts, whatever stands further left, and what comes before it does not
look past it. Such a place is a stable boundary. Two chunks are spliced at a stable boundary inside their overlap at
which both encodings have a token start and from which, up to the next stable boundary in the overlap, both have the
same tokens. Where no boundary qualifies, the overlap is doubled, in the end to the whole text. Added special strings
hold no white space, so no splice cuts one.

Shorter texts are cut at all their stable boundaries, so their counts add up from pieces; a worker remembers the counts
of the short pieces it has met, and encodes the others.

Null and empty texts have no tokens. Repeated rows each get a row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk and of the first overlap; texts up to a chunk are encoded at once.
CHUNK = 32_768
OVERLAP = 512
#: Characters of texts that are counted together; pieces a worker remembers, and the characters of the longest of them.
BATCH_CHARS = 1 << 20
REMEMBERED, REMEMBERED_CHARS = 500_000, 40
_STABLE = re.compile(r"(?<=\S)(?=[\x20\x09-\x0d])")
#: The pieces between stable boundaries; where white space is not ASCII, what follows its run belongs to the same piece.
_PIECE = re.compile(r"\s*\S+(?:[^\S\x20\x09-\x0d]\s*\S*)*|\s+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _remembered(path: str) -> dict[str, int]:
    """Counts of pieces, kept by a worker from task to task."""
    return {}


def _encoded(tokenizer, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and first characters' places in the whole text of a chunk that starts at `at`."""
    e = tokenizer.encode(text, add_special_tokens=False)
    starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
    return np.array(e.ids, np.int64), np.maximum.accumulate(starts) + at if len(starts) else starts


def _splice(left: tuple, right: tuple, stable: list[int]) -> int | None:
    """A place at which the two encodings agree; `stable` are the boundaries inside their overlap, ascending."""
    for p, q in zip(stable, stable[1:], strict=False):
        a = left[0][np.searchsorted(left[1], p) : np.searchsorted(left[1], q)]
        b = right[0][np.searchsorted(right[1], p) : np.searchsorted(right[1], q)]
        if len(a) and np.array_equal(a, b):
            return p
    return None


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text by overlapping chunks; the same as encoding it at once."""
    total, begin, end = 0, 0, min(chunk, len(text))
    left = _encoded(tokenizer, text[:end], 0)
    while end < len(text):
        wide, p = overlap, None
        while True:
            start = max(begin, end - wide)
            stable = [m.start() + start + 1 for m in _STABLE.finditer(text[start + 1 : end])]
            if len(stable) > 1:
                stop = min(end + chunk, len(text))
                right = _encoded(tokenizer, text[start:stop], start)
                p = _splice(left, right, stable)
                if p is not None:
                    break
            if start == begin:
                break
            wide *= 2
        if p is None:  # no boundary in all that is held: hold more of the text
            end = min(end + max(chunk, end - begin), len(text))
            left = _encoded(tokenizer, text[begin:end], begin)
            continue
        total += int(np.searchsorted(left[1], p))
        keep = np.searchsorted(right[1], p)
        left, begin, end = (right[0][keep:], right[1][keep:]), p, stop
    return total + len(left[0])


def _count_short(tokenizer, texts: list[str], known: dict[str, int]) -> list[int]:
    """Tokens of each text from those of its pieces; `known` keeps the counts of short ones."""
    if len(known) > REMEMBERED:
        known.clear()
    pieces = [_PIECE.findall(t) for t in texts]
    fresh = list({p for ps in pieces for p in ps if p not in known})
    found = {p: len(e) for p, e in zip(fresh, tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True)}
    known.update((p, n) for p, n in found.items() if len(p) <= REMEMBERED_CHARS)
    return [sum(known[p] if p in known else found[p] for p in ps) for ps in pieces]


def count_batch(tokenizer, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP, known: dict[str, int] | None = None) -> list[int]:
    known = {} if known is None else known
    counts, waiting, size = [0] * len(texts), [], 0

    def flush() -> None:
        nonlocal size
        for i, n in zip(waiting, _count_short(tokenizer, [texts[i] for i in waiting], known), strict=True):
            counts[i] = n
        waiting.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > chunk:
            counts[i] = count_long(tokenizer, text, chunk, overlap)
            continue
        waiting.append(i)
        size += len(text)
        if size >= BATCH_CHARS:
            flush()
    if waiting:
        flush()
    return counts


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). `path`: a byte-level BPE's JSON file."""
    path = path or default_path()
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(path), _remembered(path)
        for b in batches:
            n = np.array(count_batch(tokenizer, b.column(2).to_pylist(), chunk, overlap, known), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)], schema.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(work, schema)
