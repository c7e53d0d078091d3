"""Counters, their text exposition, and findings for a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUESTS, BLOCKS = "sluice_requests_total", "sluice_blocked_total"


def _counts(inspected: DataFrame) -> DataFrame:
    """decision, top_rule, n: what both request counters are made of, so that one query scans its requests once."""
    return inspected.groupBy("decision", "top_rule").agg(F.count("*").alias("n"))


def decision_counts(inspected: DataFrame) -> DataFrame:
    """decision, count."""
    return _counts(inspected).groupBy("decision").agg(F.sum("n").alias("count"))


def blocked_by_top_rule(inspected: DataFrame) -> DataFrame:
    """rule, count: each blocked request counts once, for its first reason."""
    blocked = F.sum(F.when(F.col("decision") == "block", F.col("n")))
    return _counts(inspected).groupBy(F.col("top_rule").alias("rule")).agg(blocked.alias("count")).where("count > 0")


def blocked_responses(inspected: DataFrame, hits_col: str = "response_hits") -> DataFrame:
    """rule, count: each blocked response (or tripped stream: hits_col="hits") counts for every rule it matches."""
    return inspected.select(F.explode(hits_col).alias("rule")).groupBy("rule").agg(F.count("*").alias("count"))


def blocked_counts(requests: DataFrame, responses: DataFrame | None = None, streams: DataFrame | None = None) -> DataFrame:
    """rule, count over both sides; pass responses and stream actions only where they block."""
    counts = blocked_by_top_rule(requests)
    if responses is not None:
        counts = counts.unionByName(blocked_responses(responses))
    if streams is not None:
        counts = counts.unionByName(blocked_responses(streams, "hits"))
    return counts.groupBy("rule").agg(F.sum("count").alias("count"))


def exposition(decisions: DataFrame, blocks: DataFrame) -> DataFrame:
    """line: the counters in the Prometheus text format, in order."""

    def samples(df: DataFrame, place: int, name: str, label: str, value: str, text: str) -> DataFrame:
        escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r"\\\""), "\n", r"\\n")
        lines = df.select(F.lit(place).alias("p"), F.lit(1).alias("q"), F.concat(F.lit(f'{name}{{{label}="'), escaped, F.lit('"} '), F.col("count").cast("string")).alias("line"))
        head = df.sparkSession.createDataFrame([(place, 0, f"# HELP {name} {text}\n# TYPE {name} counter")], "p int, q int, line string")
        return head.unionByName(lines)

    both = samples(decisions, 0, REQUESTS, "decision", "decision", "Requests by decision.").unionByName(samples(blocks, 1, BLOCKS, "rule", "rule", "Blocks by rule."))
    return both.orderBy("p", "q", "line").select("line")


def family(rule_id: Column) -> Column:
    return F.substring_index(rule_id, ".", 1)


def findings(inspected: DataFrame, *ids: str, atlas_block: bool = False) -> DataFrame:
    """A log row per exchange with hits: the `ids` columns, agent, action ("block" or "log"), kind, rules."""

    def row(action: str, kind: str, rules: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(kind).alias("kind"), rules.alias("rules"))

    found = F.when(F.col("decision") == "block", row("block", "request", F.col("rules")))
    if not atlas_block:
        found = found.when(F.size("atlas_hits") > 0, row("log", "technique", F.col("atlas_hits")))
    return inspected.select(*ids, "agent", F.inline(F.array_compact(F.array(found))))


def response_findings(inspected: DataFrame, *ids: str, response_block: bool = False) -> DataFrame:
    """A log row per flagged whole response, columns as in `findings`; kind is "response"."""
    return _flagged(inspected, ids, "response_hits", "response", response_block)


def stream_findings(actions: DataFrame, *ids: str, response_block: bool = False) -> DataFrame:
    """A log row per tripped stream; `actions` are the chunks' with their exchanges' `ids` and agent; kind is "stream"."""
    return _flagged(actions, ids, "hits", "stream", response_block)


def _flagged(df: DataFrame, ids: tuple[str, ...], hits: str, kind: str, block: bool) -> DataFrame:
    return df.where(F.size(hits) > 0).select(*ids, "agent", F.lit("block" if block else "log").alias("action"), F.lit(kind).alias("kind"), F.col(hits).alias("rules"))


def hit_counts(scanned: DataFrame, hits_col: str) -> DataFrame:
    """rule_id, count: rows with each hit."""
    return scanned.select(F.explode(hits_col).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("count"))


def family_rollup(scanned: DataFrame, hits_col: str) -> DataFrame:
    """family, rule_id, count with subtotals: null stands for all."""
    hit = scanned.select(F.explode(hits_col).alias("rule_id")).withColumn("family", family(F.col("rule_id")))
    return hit.rollup("family", "rule_id").agg(F.count("*").alias("count"))


def tactic_counts(scanned: DataFrame, rules: DataFrame, hits_col: str = "atlas_hits") -> DataFrame:
    """tactic, hits: technique hits by tactic; `rules` is the rules table, which has a row per rule."""
    tactics = F.broadcast(rules.where("tactic IS NOT NULL").select("rule_id", "tactic"))
    return scanned.select(F.explode(hits_col).alias("rule_id")).groupBy("rule_id").count().join(tactics, "rule_id").groupBy("tactic").agg(F.sum("count").alias("hits"))
