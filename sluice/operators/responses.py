"""The response side for whole bodies: flags, headers, enforcement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.normalize import normalize
from sluice.functions.rules import Rule
from sluice.functions.scan import scan_response
from sluice.operators.requests import once

BLOCKED_MESSAGE = "Response blocked: the model output matches an egress rule."
STATUS_HEADER, FLAGS_HEADER = "x-inspection", "x-inspection-response-flags"


JSON = "application/json"


def content_type(df: DataFrame) -> Column:
    """The upstream's content type, JSON where it gives none."""
    return F.coalesce(F.col("upstream_headers")["content-type"], F.lit(JSON)) if "upstream_headers" in df.columns else F.lit(JSON)


def response_text(body: Column) -> Column:
    """The raw body as text, invalid UTF-8 replaced; escapes of JSON stay as they are."""
    return F.make_valid_utf8(F.coalesce(body.cast("binary"), F.lit(b"")).cast("string"))


def inspect_responses(df: DataFrame, response_block: bool = False, body_col: str = "upstream_body", status_col: str = "upstream_status", extra: Sequence[Rule] = ()) -> DataFrame:
    """Adds response_hits, response_headers (map), response_status and response_body (what the caller gets).

    Flags are reported in a header; where responses block, a flagged one becomes a 403 with the rules and without the output.
    The content type is that of `upstream_headers` (lower-case names), if there is such a column, else JSON.
    """
    df = once(df, {"_text": normalize(response_text(F.col(body_col)))})
    df = once(df, {"response_hits": scan_response(F.col("_text"), extra)}).drop("_text")
    flagged = F.size("response_hits") > 0
    header = F.when(flagged, F.create_map(F.lit(FLAGS_HEADER), F.array_join("response_hits", ","))).otherwise(F.create_map(F.lit(STATUS_HEADER), F.lit("clean")))
    status, body, kind = F.col(status_col), F.col(body_col).cast("binary"), content_type(df)
    if response_block:
        kind = F.when(flagged, JSON).otherwise(kind)
        error = F.struct(F.struct(F.lit(BLOCKED_MESSAGE).alias("message"), F.lit("response_blocked").alias("type"), F.lit("response_blocked").alias("code")).alias("error"), F.struct(F.col("response_hits").alias("rules")).alias("inspection"))
        status, body = F.when(flagged, F.lit(403)).otherwise(status), F.when(flagged, F.to_json(error).cast("binary")).otherwise(body)
    header = F.map_concat(F.create_map(F.lit("content-type"), kind), header)
    return df.withColumns({"response_headers": header, "response_status": status, "response_body": body})
