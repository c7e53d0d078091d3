"""Where exchanges and stream chunks come from and findings go to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EXCHANGE = "method string, path string, headers map<string,string>, body binary, upstream_status int, upstream_body binary"
CHUNK = "stream_id string, seq bigint, chunk binary"


@dataclass(frozen=True)
class Options:
    """Settings of the engine. The gateway key replaces callers' own; techniques and responses block only if asked to."""

    upstream_base_url: str = "https://api.openai.com"
    upstream_api_key: str = ""
    atlas_block: bool = False
    response_block: bool = False
    listen_addr: str = "0.0.0.0:9003"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Options:
        """From variables of these names in capitals: an empty one counts as unset, a switch is on only for "true"."""

        def text(name: str) -> str:
            return env.get(name.upper()) or getattr(cls, name)

        def switch(name: str) -> bool:
            return (env.get(name.upper()) or "false") == "true"

        return cls(text("upstream_base_url").rstrip("/"), text("upstream_api_key"), switch("atlas_block"), switch("response_block"), text("listen_addr"))

    def upstream_url(self, path: str) -> str:
        return self.upstream_base_url + (path or "/v1/chat/completions")


def read_exchanges(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A table of exchanges; header names become lower-case. In JSON files bodies are base64."""
    df = spark.read.format(format).schema(EXCHANGE).load(path)
    return lower_headers(df)


def read_table(spark: SparkSession, path: str, small: int = 64 << 20, least: int = 256 << 10) -> DataFrame:
    """A Parquet table; one of at most `small` bytes that is read in few parts is dealt to the cores, `least` bytes each."""
    df = spark.read.parquet(path)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(spark.sparkContext.defaultParallelism, -(-size // least))
    return df.repartition(parts) if size <= small and df.rdd.getNumPartitions() < parts else df


def lower_headers(df: DataFrame) -> DataFrame:
    """Header names in lower case; of names that then clash the first stays."""
    entries = F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return df.withColumn("headers", F.map_from_entries(first))


def stream_exchanges(spark: SparkSession, path: str, format: str = "parquet", schema: str = EXCHANGE, max_files: int = 100) -> DataFrame:
    """The same as a stream of files (schema=CHUNK for stream chunks, which have no headers)."""
    df = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    return lower_headers(df) if "headers" in df.columns else df


def from_records(records: DataFrame) -> DataFrame:
    """EXCHANGE rows of log records, as a message queue's reader gives them, streaming or not: columns key, value and
    headers (array<struct<key string, value binary>>, null without).

    The value is the request's body. Record headers `:method`, `:path`, `:upstream-status` and `:upstream-body` hold
    what is no request header; method and path default to a POST of a chat. Other record headers are request headers.
    """
    empty = F.array().cast("array<struct<key:string,value:binary>>")
    entries = F.coalesce(F.col("headers").cast("array<struct<key:string,value:binary>>"), empty)
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.make_valid_utf8(e["value"].cast("string")).alias("value")))
    special = lambda name: F.try_element_at(F.filter(named, lambda e: e["key"] == name), F.lit(1))["value"]
    raw_body = F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == ":upstream-body"), F.lit(1))["value"]
    kept = F.filter(named, lambda e: ~F.startswith(e["key"], F.lit(":")))
    keys = F.transform(kept, lambda e: e["key"])
    first = F.filter(kept, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return records.select(
        F.coalesce(special(":method"), F.lit("POST")).alias("method"),
        F.coalesce(special(":path"), F.lit("/v1/chat/completions")).alias("path"),
        F.map_from_entries(first).alias("headers"),
        F.col("value").cast("binary").alias("body"),
        special(":upstream-status").try_cast("int").alias("upstream_status"),
        raw_body.alias("upstream_body"),
    )


def stream_records(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Exchanges from a Kafka topic as a stream; Spark's Kafka package must be on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true")
    return from_records(reader.options(**options).load())


def chat_requests(conversations: DataFrame, stream: bool = False) -> DataFrame:
    """conv_id and an exchange per conversation: its turns as the messages of a chat request."""
    message = F.struct(F.col("turn"), F.struct("role", F.col("text").alias("content")).alias("m"))
    bodies = conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    body = F.to_json(F.struct(F.lit("any").alias("model"), F.lit(stream).alias("stream"), "messages")).cast("binary")
    headers = F.create_map(F.lit("authorization"), F.concat(F.lit("Bearer sk-conv-"), F.col("conv_id").cast("string")), F.lit("content-type"), F.lit("application/json"))
    return bodies.select("conv_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("path"), headers.alias("headers"), body.alias("body"))


def delta_chunks(turns: DataFrame, key: str = "conv_id", role: str = "assistant") -> DataFrame:
    """stream_id, seq, chunk: each of a conversation's turns of a role as one event of a stream."""
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    return turns.where(F.col("role") == role).select(F.col(key).cast("string").alias("stream_id"), F.col("turn").cast("long").alias("seq"), F.concat(F.lit("data: "), delta, F.lit("\n\n")).cast("binary").alias("chunk"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='sluice-')}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """What a stream makes of all that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def write_findings(findings: DataFrame, path: str) -> None:
    """Appends findings as JSON lines."""
    findings.write.mode("append").json(path)


def stream_findings(findings: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends findings of a stream as JSON lines, exactly once; `once`: what is there, then stop."""
    out = findings.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
