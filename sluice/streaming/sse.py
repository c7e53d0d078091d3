"""Live event streams: chunks in, chunks out, and a sticky trip at the first match.

Chunks (stream_id, seq, chunk as bytes) need not end at lines or characters: each is decoded on its own, what follows
the last line feed waits for more, and an unterminated last line is never scanned. "[DONE]" is skipped. An event adds
choices[0].delta.content, or else delta.text, to a window of 500 characters, which is folded and scanned after each
addition. The chunk that completes a match trips its stream; afterwards nothing is scanned.

Output: stream_id, seq, action, hits, sent. Where responses block, the tripping chunk is "withhold_and_terminate" and
later ones are "drop"; otherwise all are "forward". Only the tripping chunk has hits. `sent` is what the caller gets: a
forwarded chunk, `terminal_event` for the tripping one, null for dropped ones.
Null chunks are empty; null seq comes first; chunks of equal seq are taken in the order of their bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.functions.scan_python import normalize, scan_response
from sluice.operators.sse import DONE, WINDOW, data_of, delta_of

FORWARD, TERMINATE, DROP = "forward", "withhold_and_terminate", "drop"
STATE = "partial string, window string, tripped boolean"
STREAM_HEADER = "x-inspection"


@dataclass
class Scanner:
    """The state of one stream."""

    partial: str = ""
    window: str = ""
    tripped: bool = False

    def push(self, chunk: bytes | None) -> list[str]:
        """Hits if this chunk completes the first match, else nothing."""
        if self.tripped:
            return []
        *lines, self.partial = (self.partial + (chunk or b"").decode("utf-8", "replace")).split("\n")
        for line in lines:
            data = data_of(line.rstrip())
            delta = delta_of(data, both_shapes=True) if data is not None and data != DONE else ""
            if not delta:
                continue
            self.window = (self.window + delta)[-WINDOW:]
            if hits := scan_response(normalize(self.window)):
                self.tripped = True
                return hits
        return []

    def act(self, chunk: bytes | None, block: bool) -> tuple[str, list[str], bytes | None]:
        """(action, hits, sent)."""
        done = self.tripped
        hits = self.push(chunk)
        if not block or not (done or hits):
            return FORWARD, hits, chunk
        return (DROP, hits, None) if done else (TERMINATE, hits, terminal_event(hits))


def terminal_event(hits: list[str]) -> bytes:
    """What a blocked stream ends with."""
    error = {"error": {"message": "Response blocked: streamed output matches an egress rule.", "type": "response_blocked", "code": "response_blocked"}, "inspection": {"rules": hits}}
    return f"data: {json.dumps(error)}\n\ndata: {DONE}\n\n".encode()


def stream_header(block: bool) -> Column:
    """Value of the header that tells the caller how its stream is handled."""
    return F.lit("stream-enforced" if block else "stream-observed")


def _schema(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("stream_id", df.schema["stream_id"].dataType), T.StructField("seq", T.LongType()), T.StructField("action", T.StringType()), T.StructField("hits", T.ArrayType(T.StringType())), T.StructField("sent", T.BinaryType())])


def inspect_stream(chunks: DataFrame, block: bool = False, ttl: str | None = "1 hour") -> DataFrame:
    """The operator for a streaming DataFrame; a stream's state is forgotten `ttl` after its last chunk.

    With a ttl a query runs batches to look for expired streams until it is stopped; without, one that is triggered for
    what is available ends.
    """
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else 0
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        scanner = Scanner(*state.get) if state.exists else Scanner()
        rows = pd.concat(list(batches)).sort_values(["seq", "chunk"], na_position="first", kind="stable")
        done = [(key[0], s, *scanner.act(None if c is None else bytes(c), block)) for s, c in zip(rows["seq"], rows["chunk"], strict=True)]
        state.update((scanner.partial, scanner.window, scanner.tripped))
        if millis:
            state.setTimeoutDuration(millis)
        yield pd.DataFrame(done, columns=["stream_id", "seq", "action", "hits", "sent"])

    chunks = chunks.select("stream_id", F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"))
    return chunks.groupBy("stream_id").applyInPandasWithState(step, _schema(chunks), STATE, "append", timeout)


def inspect_chunks(chunks: DataFrame, block: bool = False) -> DataFrame:
    """The same for a finished table: streams pass sorted through their tasks, which hold one stream's state at a time."""
    chunks = chunks.select("stream_id", F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"))
    schema = _schema(chunks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, scanner, first = None, Scanner(), True
        for b in batches:
            done = []
            for stream, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if first or stream != current:
                    current, scanner, first = stream, Scanner(), False
                done.append(scanner.act(chunk, block))
            kinds = (pa.string(), pa.list_(pa.string()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[i] for x in done], t) for i, t in enumerate(kinds))], schema.names)

    ordered = chunks.repartition("stream_id").sortWithinPartitions("stream_id", F.col("seq").asc_nulls_first(), "chunk")
    return ordered.mapInArrow(work, schema)
