"""The whole flow over exchanges: request decision, forwarding, upstream answer, response enforcement, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import metrics
from sluice.operators.requests import forwarded, inspect_requests, routed, with_upstream_failures
from sluice.operators.responses import STATUS_HEADER, content_type, inspect_responses
from sluice.sources.exchanges import Options
from sluice.streaming.sse import inspect_chunks, stream_header


@dataclass(frozen=True)
class Outcome:
    """requests: all inspected exchanges; failures: allowed ones whose upstream could not be reached (status 502);
    responses: whole answers to the other allowed ones; opened: streamed answers as they begin (status and headers);
    streams: what happens to their chunks and what the caller gets (None without chunks); decisions and blocks: the
    counters over all; findings: the log's rows."""

    requests: DataFrame
    failures: DataFrame
    responses: DataFrame
    opened: DataFrame
    streams: DataFrame | None
    decisions: DataFrame
    blocks: DataFrame
    findings: DataFrame

    def exposition(self) -> DataFrame:
        return metrics.exposition(self.decisions, self.blocks)


def run_gateway(exchanges: DataFrame, options: Options | None = None, chunks: DataFrame | None = None, stream_id: str = "stream_id", ids: tuple[str, ...] = ()) -> Outcome:
    """Plans the flow for exchanges with upstream_status and upstream_body; paths outside /v1/ are not the gateway's.

    Columns that exchanges may have besides: upstream_error (text; not null where the upstream could not be reached)
    and upstream_headers. chunks: the event streams (stream_id, seq, chunk) that answer exchanges which asked for
    streaming, matched by the exchanges' column `stream_id`; those of blocked and failed exchanges were never received
    and are left out. `ids`: columns that name an exchange in the findings.
    """
    options = options or Options()
    block = options.response_block
    requests = inspect_requests(routed(exchanges), options.atlas_block)
    allowed = forwarded(requests, options.upstream_api_key, options.upstream_base_url)
    failed = F.col("upstream_error").isNotNull() if "upstream_error" in exchanges.columns else F.lit(False)
    failures = with_upstream_failures(allowed.where(failed)) if "upstream_error" in exchanges.columns else allowed.where(failed)
    answered = allowed.where(~failed)
    responses = inspect_responses(answered.where(~F.col("stream") & F.col("upstream_status").isNotNull()), block)
    head = F.create_map(F.lit("content-type"), content_type(answered), F.lit(STATUS_HEADER), stream_header(block))
    opened = answered.where("stream").withColumns({"response_status": F.col("upstream_status"), "response_headers": head})
    found = metrics.findings(requests, *ids, atlas_block=options.atlas_block).unionByName(metrics.response_findings(responses, *ids, response_block=block))
    streams = None
    if chunks is not None:
        names = opened.select(F.col(stream_id).alias("stream_id"), *[F.col(i).alias(f"id_{n}") for n, i in enumerate(ids)], "agent")
        streams = inspect_chunks(chunks.join(names.select("stream_id"), "stream_id", "left_semi"), block)
        tripped = streams.where(F.size("hits") > 0).join(names, "stream_id")
        found = found.unionByName(metrics.stream_findings(tripped.select("hits", "agent", *[F.col(f"id_{n}").alias(i) for n, i in enumerate(ids)]), *ids, response_block=block))
    blocks = metrics.blocked_counts(requests, responses if block else None, streams if block else None)
    return Outcome(requests, failures, responses, opened, streams, metrics.decision_counts(requests), blocks, found)
