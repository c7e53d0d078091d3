"""The request side: exchanges in, decisions out, all in one narrow stage.

Exchange: method, path, headers (map, lower-case names), body (binary), all nullable; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.body import read_body
from sluice.functions.decode import decoded_base64, rot13
from sluice.functions.identity import fingerprint
from sluice.functions.normalize import normalize, normalize_each
from sluice.functions.rules import Rule
from sluice.functions.scan import scan_atlas, scan_decoded

MALFORMED = "malformed_json"
BLOCKED_MESSAGE = "Request blocked: it matches inspection rules."
MALFORMED_MESSAGE = "Request blocked: its body is not valid JSON and cannot be scanned."
_EMPTY = "array<string>"

# Headers that reach the upstream.
PASSED_HEADERS = ("content-type", "authorization", "anthropic-version", "x-api-key")


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with columns that are computed once a row: filters on them are not pushed below, nor are they inlined.

    They come out of a generator that makes one row of each.
    """
    return df.drop(*columns).select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def scan_texts(df: DataFrame, text_col: str = "text", extra: Sequence[Rule] = ()) -> DataFrame:
    """Adds scan_text (normalized), dlp_hits (with decoded payloads, normalized too) and atlas_hits."""
    text = F.col("scan_text")
    df = once(df, {"scan_text": normalize(F.coalesce(F.col(text_col), F.lit("")))})
    df = once(df, {"_texts": F.concat(F.array(text), normalize_each(decoded_base64(text)), F.array(rot13(text)))})
    dlp = [r for r in extra if r.family != "AML"]
    atlas = [r for r in extra if r.family == "AML"]
    return once(df, {"dlp_hits": scan_decoded(F.col("_texts"), dlp), "atlas_hits": scan_atlas(text, atlas)}).drop("_texts")


def decision(dlp_hits: Column, atlas_hits: Column, atlas_block: bool = False) -> Column:
    """struct<decision, rules>: block if a request rule matches, or a technique where techniques block."""
    empty = F.array().cast(_EMPTY)
    block = F.size(dlp_hits) > 0
    rules = dlp_hits
    if atlas_block:
        block, rules = block | (F.size(atlas_hits) > 0), F.concat(dlp_hits, atlas_hits)
    return F.struct(F.when(block, "block").otherwise("allow").alias("decision"), F.when(block, rules).otherwise(empty).alias("rules"))


def inspect_requests(df: DataFrame, atlas_block: bool = False, extra: Sequence[Rule] = ()) -> DataFrame:
    """Adds to each exchange:

    valid, text, stream (of the body), agent (identity hash; "unknown" for a body that is empty or invalid),
    scan_text, dlp_hits, atlas_hits, decision ("block" or "allow"), rules (the reasons), top_rule (the first, or null),
    status (403 if blocked, else null), message, and error_body (the JSON that a blocked caller gets).
    """
    body = F.coalesce(F.col("body").cast("binary"), F.lit(b""))
    df = df.withColumn("_body", read_body(body))
    empty = F.octet_length(body) == 0
    df = df.withColumns({"valid": F.col("_body.valid"), "text": F.col("_body.text"), "stream": F.col("_body.stream"), "agent": F.when(F.col("_body.valid") & ~empty, fingerprint(F.col("headers"))["hash"]).otherwise("unknown")}).drop("_body")
    df = scan_texts(df, "text", extra)
    df = df.withColumn("_d", decision(F.col("dlp_hits"), F.col("atlas_hits"), atlas_block))
    rules = F.when(F.col("valid"), F.col("_d.rules")).otherwise(F.array(F.lit(MALFORMED)))
    df = df.withColumns({"decision": F.when(F.col("valid"), F.col("_d.decision")).otherwise("block"), "rules": rules}).drop("_d")
    block = F.col("decision") == "block"
    df = df.withColumns(
        {
            "top_rule": F.when(block, F.coalesce(F.try_element_at("rules", F.lit(1)), F.lit("blocked"))),
            "status": F.when(block, F.lit(403)),
            "message": F.when(block, F.when(F.col("valid"), BLOCKED_MESSAGE).otherwise(MALFORMED_MESSAGE)),
        }
    )
    error = F.struct(F.struct(F.col("message"), F.lit("request_blocked").alias("type")).alias("error"), F.struct(F.lit(True).alias("blocked"), "rules").alias("inspection"))
    return df.withColumn("error_body", F.when(block, F.to_json(error)))


def routed(df: DataFrame) -> DataFrame:
    """Exchanges that are inspected: any method, paths under /v1/."""
    return df.where(F.startswith("path", F.lit("/v1/")))


def forwarded(df: DataFrame, gateway_key: str = "", base_url: str = "") -> DataFrame:
    """Allowed exchanges as the upstream gets them: the body untouched, only the passed headers, the gateway's key if set.

    With a base URL also upstream_url: the base and the exchange's path, by default that of chat requests.
    """
    kept = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PASSED_HEADERS))
    if gateway_key:
        kept = F.map_concat(F.map_filter(kept, lambda k, v: k != "authorization"), F.create_map(F.lit("authorization"), F.lit(f"Bearer {gateway_key}")))
    out = df.where("decision = 'allow'").withColumn("headers", kept)
    return out.withColumn("upstream_url", F.concat(F.lit(base_url), F.coalesce("path", F.lit("/v1/chat/completions")))) if base_url else out


def with_upstream_failures(df: DataFrame, error_col: str = "upstream_error") -> DataFrame:
    """Adds to forwarded exchanges status 502 and an error body where the upstream could not be reached."""
    failed = F.col(error_col).isNotNull()
    error = F.struct(F.struct(F.concat(F.lit("upstream unreachable: "), F.col(error_col)).alias("message"), F.lit("upstream_error").alias("type")).alias("error"))
    return df.withColumns({"status": F.when(failed, F.lit(502)).otherwise(F.col("status")), "error_body": F.when(failed, F.to_json(error))})
