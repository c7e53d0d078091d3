"""Folding of disguised text for matching: invisible characters, compatibility forms, stacked marks, lookalikes.

The result is for matching only. Case is kept. ASCII text is its own result.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are removed.
INVISIBLE = (
    r"\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{00AD}\x{180E}\x{FE00}-\x{FE0F}\x{E0000}-\x{E001F}\x{E007F}"
    r"\x{061C}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}"
)

# Lookalike letters (Cyrillic, Greek and others) and the ASCII letters they stand for in mixed words.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ѕ": "S", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Т": "T", "Х": "X", "У": "Y", "Ԍ": "G", "Ɂ": "I", "Ѵ": "V", "Ԝ": "W", "а": "a",
    "в": "b", "с": "c", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "т": "t", "х": "x", "у": "y", "ԁ": "d", "ɡ": "g", "ո": "n", "ѵ": "v", "ԝ": "w", "ƅ": "b",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "σ": "o", "μ": "u",
}

# Small capitals and the letters they stand for everywhere.
SMALL_CAPITALS = {
    "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ꜰ": "f", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j",
    "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ꞯ": "q", "ʀ": "r", "ꜱ": "s", "ᴛ": "t",
    "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z",
}

LOOKALIKE_FROM, LOOKALIKE_TO = "".join(LOOKALIKES), "".join(LOOKALIKES.values())
SMALL_FROM, SMALL_TO = "".join(SMALL_CAPITALS), "".join(SMALL_CAPITALS.values())
#: Tag characters mirror printable ASCII.
TAG_FROM, TAG_TO = "".join(chr(0xE0020 + i) for i in range(95)), "".join(chr(0x20 + i) for i in range(95))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in x])


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, f"[{INVISIBLE}]", "")


def fold_marks_and_lookalikes(text: Column) -> Column:
    """What follows NFKC: marks stacked on ASCII letters and digits go, lookalikes in mixed runs, small capitals, tags."""
    text = F.regexp_replace(text, r"([0-9A-Za-z])\p{M}+", "$1")
    runs = F.regexp_extract_all(text, F.lit(r"(\p{IsAlphabetic}+|\P{IsAlphabetic}+)"), F.lit(1))
    mixed = lambda run: run.rlike("[A-Za-z]") & run.rlike(f"[{LOOKALIKE_FROM}]")
    folded = F.array_join(F.transform(runs, lambda run: F.when(mixed(run), F.translate(run, LOOKALIKE_FROM, LOOKALIKE_TO)).otherwise(run)), "")
    folded = F.when(text.rlike(f"[{LOOKALIKE_FROM}]"), folded).otherwise(text)
    return F.translate(F.translate(folded, SMALL_FROM, SMALL_TO), TAG_FROM, TAG_TO)


def normalize(text: Column) -> Column:
    """The folded text; null for null. Python sees only texts with non-ASCII characters, in Arrow batches."""
    foreign = F.when(~_is_ascii(text), strip_invisible(text))
    return F.when(_is_ascii(text), text).otherwise(fold_marks_and_lookalikes(_nfkc(foreign)))


def normalize_each(texts: Column) -> Column:
    """normalize() of each element of an array."""
    foreign = F.transform(texts, lambda t: F.when(~_is_ascii(t), strip_invisible(t)))
    done = F.transform(_nfkc_each(foreign), fold_marks_and_lookalikes)
    return F.zip_with(texts, done, lambda t, d: F.when(_is_ascii(t), t).otherwise(d))
