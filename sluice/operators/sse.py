"""Event-stream responses scanned as whole bodies: which event first completes a match.

Data lines start with "data:"; "[DONE]" ends the scan. Every other data line is an event and counts, whether or not it
is JSON or has text. The text of choices[0].delta.content is added to a window that keeps the last 500 characters; the
folded window is scanned after each addition. A null body has no events.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.body import parse_strict
from sluice.functions.gates import candidates
from sluice.functions.normalize import normalize_each
from sluice.functions.rules import response_rules
from sluice.functions.scan import matches
from sluice.operators.requests import once

WINDOW = 500
DONE = "[DONE]"
_WINDOWS = T.StructType([T.StructField("scanned", T.IntegerType()), T.StructField("events", T.ArrayType(T.IntegerType())), T.StructField("windows", T.ArrayType(T.StringType()))])


def data_of(line: str) -> str | None:
    """What follows "data:", trimmed; None for other lines."""
    return line[5:].strip() if line.startswith("data:") else None


def delta_of(data: str, both_shapes: bool = False) -> str:
    """The text that an event adds: choices[0].delta.content, or with `both_shapes` else delta.text; "" if none."""
    try:
        value = parse_strict(data.encode("utf-8", "surrogatepass"))
    except ValueError:
        return ""
    choices = value.get("choices") if isinstance(value, dict) else None
    first = choices[0] if isinstance(choices, list) and choices else None
    delta = first.get("delta") if isinstance(first, dict) else None
    text = delta.get("content") if isinstance(delta, dict) else None
    if not isinstance(text, str) and both_shapes and isinstance(value, dict):
        delta = value.get("delta")
        text = delta.get("text") if isinstance(delta, dict) else None
    return text if isinstance(text, str) else ""


@F.pandas_udf(_WINDOWS)
def _windows(bodies: pd.Series) -> pd.DataFrame:
    rows = []
    for body in bodies:
        scanned, events, windows, window = 0, [], [], ""
        for line in (body or "").split("\n"):
            data = data_of(line)
            if data is None:
                continue
            if data == DONE:
                break
            scanned += 1
            if delta := delta_of(data):
                window = (window + delta)[-WINDOW:]
                events.append(scanned)
                windows.append(window)
        rows.append((scanned, events, windows))
    return pd.DataFrame(rows, columns=["scanned", "events", "windows"])


def first_hit(scanned: Column, events: Column, windows: Column) -> Column:
    """struct<scanned, hit_at, hits>: events up to the first whose window matches, its number, and the rules."""
    rules = response_rules()
    none = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<string>").alias("hits"))

    def step(found: Column, x: Column) -> Column:  # windows after the first hit are not matched
        now = F.array(matches(x["w"], x["p"], rules))
        return F.when(F.size(found["hits"]) > 0, found).otherwise(F.transform(now, lambda h: F.struct(F.when(F.size(h) > 0, x["e"]).alias("at"), h.alias("hits")))[0])

    parts = F.arrays_zip(events.alias("e"), windows.alias("w"), candidates(windows, rules).alias("p"))
    parts = F.transform(parts, lambda x: F.struct(x["e"].alias("e"), x["w"].alias("w"), x["p"].alias("p")))
    found = F.array(F.aggregate(parts, none, step))
    return F.transform(found, lambda f: F.struct(F.coalesce(f["at"], scanned).alias("scanned"), f["at"].alias("hit_at"), f["hits"].alias("hits")))[0]


def scan_sse(df: DataFrame, body_col: str = "body", out_col: str = "sse") -> DataFrame:
    """Adds struct<scanned int, hit_at int, hits array<string>> for each body (string or binary)."""
    body = F.col(body_col)
    text = F.make_valid_utf8(body.cast("binary").cast("string"))
    df = once(df, {"_w": _windows(text)})
    df = once(df, {"_n": normalize_each(F.col("_w.windows"))})
    return once(df, {out_col: first_hit(F.col("_w.scanned"), F.col("_w.events"), F.col("_n"))}).drop("_w", "_n")
