"""Request bodies: strict JSON, the texts to scan, and the streaming flag.

A body is valid if a strict parser takes all of it: UTF-8 without a byte order mark, nothing after the value, no NaN
or infinities, numbers within a double's range, no lone surrogates, at most 127 levels. Of repeated keys the last
counts. An empty or null body is valid and has no text.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH = 127
BODY = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("stream", T.BooleanType())])
_SURROGATE = re.compile("[\ud800-\udfff]")


def _number(text: str) -> float:
    x = float(text)
    if math.isinf(x):
        raise ValueError("number out of range")
    return x


def _integer(text: str) -> int | float:
    return int(text) if len(text) < 300 else _number(text)


def _no_constant(text: str):
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_float=_number, parse_int=_integer)


def _check(value, escapes: bool) -> None:
    """Raises on too many levels and, if the body has escapes, on lone surrogates."""
    level, depth = [value], 0
    while level:
        nested = []
        for v in level:
            if isinstance(v, str):
                if escapes and _SURROGATE.search(v):
                    raise ValueError("lone surrogate")
            elif isinstance(v, dict):
                if escapes and any(_SURROGATE.search(k) for k in v):
                    raise ValueError("lone surrogate")
                nested.append(v.values())
            elif isinstance(v, list):
                nested.append(v)
        depth += bool(nested)
        if depth > MAX_DEPTH:
            raise ValueError("too many levels")
        level = [x for n in nested for x in n]


def parse_strict(body: bytes):
    """The value, or ValueError."""
    text = body.decode("utf-8").strip(" \t\n\r")
    try:
        value, end = _DECODER.raw_decode(text)
    except RecursionError as e:
        raise ValueError("too many levels") from e
    if end != len(text):
        raise ValueError("trailing characters")
    _check(value, "\\u" in text)
    return value


def _content(value) -> Iterator[str]:
    """Texts of a message's content: a string, or blocks with texts and contents of their own."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for block in value:
            if isinstance(block, dict):
                if isinstance(block.get("text"), str):
                    yield block["text"]
                yield from _content(block.get("content"))


def _at(value, *keys):
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _messages(value) -> Iterator[str]:
    for m in value if isinstance(value, list) else ():
        yield from _content(_at(m, "content"))
        calls = _at(m, "tool_calls")
        arguments = [_at(c, "function", "arguments") for c in calls] if isinstance(calls, list) else []
        yield from (a for a in (*arguments, _at(m, "function_call", "arguments")) if isinstance(a, str))


def _texts(body) -> Iterator[str]:
    yield from _messages(_at(body, "messages"))
    yield from _messages(_at(body, "additional_messages"))
    yield from _content(_at(body, "system"))
    for key in ("prompt", "instructions", "additional_instructions"):
        if isinstance(_at(body, key), str):
            yield body[key]
    given = _at(body, "input")
    if isinstance(given, str):
        yield given
    for item in given if isinstance(given, list) else ():
        yield from _content(_at(item, "content"))
        if isinstance(_at(item, "text"), str):
            yield item["text"]


def prompt_text_of(value) -> str:
    """All texts of a parsed body that a model would read, joined by single spaces."""
    return " ".join(_texts(value))


@F.pandas_udf(BODY)
def _read(bodies: pd.Series) -> pd.DataFrame:
    rows = []
    for b in bodies:
        if not b:
            rows.append((True, "", False))
            continue
        try:
            value = parse_strict(bytes(b))
        except ValueError:
            rows.append((False, "", False))
        else:
            rows.append((True, prompt_text_of(value), _at(value, "stream") is True))
    return pd.DataFrame(rows, columns=["valid", "text", "stream"])


def read_body(body: Column) -> Column:
    """struct<valid, text, stream> of a body (binary or string); text is empty for invalid ones."""
    return _read(body.cast("binary"))
