"""Encoded payloads inside a text: base64 runs, base64 wrapped over lines, ROT13."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What looks like base64, on one line and wrapped over two or more.
RUN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
# The first two are possessive, which matches the same: Java takes a stack frame a line otherwise, and tries shorter lines.
WRAPPED = r"(?:[A-Za-z0-9+/_-]{16,100}+\r?\n){2,}+[A-Za-z0-9+/_-]{0,100}={0,2}"

_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ROTATED = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
#: White space by Unicode, for the share of printable characters.
_SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def rot13(text: Column) -> Column:
    return F.translate(text, _PLAIN, _ROTATED)


def decode_base64(raw: Column) -> Column:
    """Bytes of a run in the standard or URL-safe alphabet; null if too short, of an impossible length, or not base64."""
    return _bytes(_clean(raw))


def _clean(raw: Column) -> Column:
    for old, new in (("=", ""), ("-", "+"), ("_", "/")):
        raw = F.replace(raw, F.lit(old), F.lit(new))
    return raw


def _bytes(clean: Column) -> Column:
    return F.when((F.length(clean) >= 4) & (F.length(clean) % 4 != 1) & clean.rlike(r"\A[A-Za-z0-9+/]*\z"), F.try_to_binary(clean, F.lit("base64")))


def plausible_text(data: Column) -> Column:
    """The bytes as text if they are UTF-8, 8 characters or more, nine tenths of them printable ASCII or white space."""
    return _plausible(F.try_validate_utf8(data.cast("string")))


def _plausible(text: Column) -> Column:
    printable = F.length(F.regexp_replace(text, rf"[^\x21-\x7E{_SPACE}]", ""))
    return F.when((F.length(text) >= 8) & (printable * 100 >= F.length(text) * 90), text)


def decoded_base64(text: Column) -> Column:
    """Plaintexts of the base64 runs, then of the wrapped blocks, in order; not normalized. Nothing is decoded twice."""
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    found = F.when(text.contains("\n"), F.regexp_extract_all(text, F.lit(WRAPPED), F.lit(0))).otherwise(F.array().cast("array<string>"))
    blocks = F.transform(found, lambda x: F.regexp_replace(x, r"\s", ""))
    # a transform for each step, so that no step is worked out again wherever the next one names it
    data = F.transform(F.transform(F.concat(runs, blocks), _clean), _bytes)
    return F.array_compact(F.transform(F.transform(data, lambda x: F.try_validate_utf8(x.cast("string"))), _plausible))


def decode_candidates(text: Column) -> Column:
    """The decoded plaintexts and, always last, the ROT13 of the whole text."""
    return F.concat(decoded_base64(text), F.array(rot13(text)))
