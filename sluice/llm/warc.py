"""WARC: archives written from pages, read back, and assembled into transactions.

Writing: each page becomes a request, a response or revisit, and a metadata record, tied by WARC-Concurrent-To. Of
pages with equal payloads (by SHA-1) of at least `min_payload` bytes the one with the largest id is the response,
the others revisit it; pages with smaller payloads are all responses. A null payload is empty; null ids and URLs leave
their fields out, and null ids count as smallest. Equal rows are pages of their own: one is the response, the others
revisit it. Line breaks in URLs are percent-encoded. Archives are gzip files of records, each followed by two line
breaks; the text source's line separator writes these.

Reading: a file, cut at double line breaks, reaches one task in order (gzip files are not split), where records are cut
out by their Content-Length, so payloads may hold anything, record headers included. Header lines end in CR LF, as the
standard says. Memory is that of the largest record. A file that ends inside a record loses that record alone.

Assembly: request and metadata records reach their response (or revisit, or resource) through concurrent-to
identifiers, whichever side names the other and also by way of another record of the transaction; one nested row per
capture. Records that reach no response are captures of their own without one. No pages give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import cut, raw, remove_folder, shared_folder

DATE = "2024-01-01T00:00:00Z"
#: Records that a capture is built around.
ANCHORS = ("response", "revisit", "resource", "conversion")
#: Pages with repeated payloads up to this many are broadcast (about 200 bytes each).
BROADCAST_REVISITS = 50_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, content_type string, header_digest string, fields map<string,string>, payload_bytes long, payload_digest string"


def base32_of_hex(hex40: Column) -> Column:
    """Base32 of a 40-digit hex string: 5 digits are 20 bits are 4 letters."""

    def letters(i: Column) -> Column:
        bits = F.conv(F.substr(hex40, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def _urn(key: Column, kind: str) -> Column:
    h = F.md5(F.concat(key, F.lit(f"/{kind}")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substr(h, F.lit(1), F.lit(8)), *[x for at, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substr(h, F.lit(at), F.lit(n)))], F.lit(">"))


def _head(kind: Column, record_id: Column, content_type: str, size: Column, *headers: tuple[str, Column]) -> Column:
    """A record's header lines and the empty line after them; headers with null values are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"), F.lit(f"Content-Type: {content_type}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), size.cast("string")))
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), _CRLF), F.lit(_CRLF * 2))


def _pages(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, payload, sha, size, key), a row each, and the same without url and payload as a table of its own.

    The key is a hash of id, URL and payload; where rows are equal in these, a running number is added to all keys.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    base = base.withColumn("sha", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    base = base.withColumn("key", F.md5(F.to_json(F.struct("page_id", "url", "sha")).cast("binary")))
    narrow = cut(base.select("key", "page_id", "sha", "size"))
    if narrow.groupBy("key").count().where("count > 1").isEmpty():
        return base, narrow
    # numbers are those of rows in a written table, so they hold when a lost executor's work is done again
    base = cut(base)
    base = base.withColumn("key", F.concat("key", F.lit("/"), F.monotonically_increasing_id().cast("string")))
    return base, cut(base.select("key", "page_id", "sha", "size"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """The records of all pages, as rows of one string column `value`: a page's three, with two line breaks between them."""
    base, narrow = _pages(pages, id_col, url_col, payload_col)
    large = narrow.where(F.col("size") >= min_payload)
    first = large.groupBy("sha").agg(F.max(F.struct("page_id", "key")).alias("top"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select("sha", F.col("top.key").alias("first_key"), "n"))
    again = first.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    revisits = large.select("key", "sha").join(first.select("sha", "first_key"), "sha").where("key <> first_key").select("key", "first_key")
    if not again:
        revisits = revisits.where("false")
    elif again <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)  # so no payload is shuffled; more revisits join by key
    page = base.join(revisits, "key", "left")
    again = F.col("first_key").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    main, digest = _urn(F.col("key"), "response"), F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF * 2))
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    asked = F.concat(F.lit("GET "), F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{_CRLF}Host: "), host, F.lit(_CRLF * 2))
    told = F.concat(F.lit("fetched-with: sluice\r\n"), F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(_CRLF)), F.lit("")))
    refers = F.when(again, _urn(F.col("first_key"), "response"))
    profile = F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    body = F.when(again, "").otherwise(F.col("payload"))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))
    # one concatenation holds the payload: it is copied once
    return page.select(
        F.concat(
            _head(F.lit("request"), _urn(F.col("key"), "request"), "application/http;msgtype=request", F.octet_length(asked), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main)),
            asked,
            F.lit(_CRLF * 2),
            _head(F.when(again, "revisit").otherwise("response"), main, "application/http;msgtype=response", size, ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("WARC-Profile", profile), ("WARC-Refers-To", refers)),
            http,
            body,
            F.lit(_CRLF * 2),
            _head(F.lit("metadata"), _urn(F.col("key"), "metadata"), "application/warc-fields", F.octet_length(told), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main)),
            told,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> None:
    records(pages, id_col, url_col, payload_col, min_payload).write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class Parser:
    """Cuts records out of a file's bytes, given in order and in pieces of any size."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.headers: list[bytes] | None = None
        self.length = 0

    def feed(self, piece: bytes) -> Iterator[tuple[list[bytes], bytes]]:
        """(header lines, block) of every record that the piece completes."""
        self.held += piece
        while True:
            if self.headers is None:
                start = len(self.held) - len(self.held.lstrip(b"\r\n"))
                end = self.held.find(b"\r\n\r\n", start)
                if len(self.held) - start >= 5 and not self.held.startswith(b"WARC/", start):
                    raise ValueError(f"no WARC record starts with {bytes(self.held[start : start + 40])!r}")
                if end < 0:
                    return
                self.headers = bytes(self.held[start:end]).split(b"\r\n")
                length = next((h.partition(b":")[2] for h in self.headers if h[:15].lower() == b"content-length:"), None)
                if length is None:
                    raise ValueError("a record without Content-Length")
                self.length = int(length)
                del self.held[: end + 4]
            if len(self.held) < self.length:
                return
            yield self.headers, bytes(self.held[: self.length])
            del self.held[: self.length]
            self.headers = None


def _parsed(headers: list[bytes], block: bytes) -> dict:
    out: dict = {"concurrent_to": []}
    names = {b"warc-record-id": "record_id", b"warc-type": "type", b"warc-target-uri": "target_uri", b"warc-date": "date", b"warc-refers-to": "refers_to", b"content-type": "content_type", b"warc-payload-digest": "header_digest"}
    for h in headers[1:]:
        name, _, value = h.partition(b":")
        name, value = name.strip().lower(), value.strip().decode("utf-8", "replace")
        if name == b"warc-concurrent-to":
            out["concurrent_to"].append(value)
        elif name in names:
            out[names[name]] = value
    kind = out.get("content_type", "")
    payload = block
    if kind.startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    out["fields"] = [tuple(x.strip() for x in line.decode("utf-8", "replace").split(":", 1)) for line in block.split(b"\r\n") if b":" in line] if kind.startswith("application/warc-fields") else []
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record, columns RECORD and, if asked for, payload binary (an HTTP message's body, else the block)."""
    pieces = spark.read.option("lineSep", _CRLF * 2).text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    schema = RECORD + (", payload binary" if with_payload else "")
    kinds = {"record_id": pa.string(), "type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "concurrent_to": pa.list_(pa.string()), "refers_to": pa.string(), "content_type": pa.string(), "header_digest": pa.string(), "fields": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"payload": pa.binary()} if with_payload else {})

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in kinds.items()], list(kinds))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parser, rows, size = None, Parser(), [], 0
        for b in batches:
            for name, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name != file:
                    file, parser = name, Parser()
                for got in parser.feed(raw(piece) + b"\r\n\r\n"):
                    rows.append(_parsed(*got))
                    if with_payload:
                        size += rows[-1]["payload_bytes"]
                    else:
                        del rows[-1]["payload"]
                    if len(rows) >= 1024 or size >= 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return pieces.mapInArrow(work, schema)


def assemble(recs: DataFrame) -> DataFrame:
    """capture_id, response (struct, null if there is none), requests and metadata (arrays of structs, by record id).

    `recs` is used several times: give a table or a checkpoint, not archives. Warcinfo and records without an id are
    left out. A record that reaches several responses belongs to the one with the smallest id.
    """
    recs = recs.where("record_id IS NOT NULL AND type <> 'warcinfo'")
    anchors = recs.where(F.col("type").isin(*ANCHORS))
    parts = recs.where(~F.col("type").isin(*ANCHORS))
    named = recs.select("record_id", F.explode("concurrent_to").alias("other"))
    links = named.select(F.col("record_id").alias("part"), "other").union(named.select(F.col("other").alias("part"), F.col("record_id").alias("other"))).distinct()
    ids = anchors.select(F.col("record_id").alias("other"), F.col("record_id").alias("capture_id"))
    is_part = parts.select(F.col("record_id").alias("part"))
    reached = cut(links.join(ids, "other").join(is_part, "part", "left_semi").groupBy("part").agg(F.min("capture_id").alias("capture_id")))
    while True:  # by way of another part, as long as that reaches more
        open_links = links.join(is_part, "part", "left_semi").join(reached.select("part"), "part", "left_anti")
        by = reached.select(F.col("part").alias("other"), "capture_id")
        more = open_links.join(by, "other")
        if more.isEmpty():
            break
        reached = cut(reached.unionByName(more.groupBy("part").agg(F.min("capture_id").alias("capture_id"))))
    whole = F.struct(*[F.col(c) for c in recs.columns])
    placed = parts.join(reached, parts.record_id == reached.part, "left").select(F.coalesce("capture_id", "record_id").alias("capture_id"), "type", whole.alias("r"))
    groups = placed.groupBy("capture_id").agg(F.collect_list(F.when(F.col("type") == "request", F.col("r"))).alias("requests"), F.collect_list(F.when(F.col("type") != "request", F.col("r"))).alias("metadata"))
    middle = anchors.select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    by_id = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    none = F.array().cast(groups.schema["requests"].dataType)
    out = middle.join(groups, "capture_id", "full")
    return out.select("capture_id", "response", *[F.array_sort(F.coalesce(c, none), by_id).alias(c) for c in ("requests", "metadata")])


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Writes the archives, reads and assembles them, and returns per capture: page_id, payload_bytes, payload_digest,
    record_type, refers_to (the page_id of the response that a revisit refers to)."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, min_payload)
    captures = assemble(cut(read_records(spark, path, with_payload=False)))
    r, fields = F.col("response"), F.col("metadata")[0]["fields"]
    flat = captures.where(r.isNotNull()).select(F.try_element_at(fields, F.lit("page-id")).cast(pages.schema[id_col].dataType).alias("page_id"), r["record_id"].alias("id"), r["type"].alias("record_type"), r["refers_to"].alias("refers"), r["payload_bytes"].alias("bytes"), r["payload_digest"].alias("digest"))
    flat = cut(flat)
    remove_folder(spark, path)
    seen = flat.where("record_type = 'response'").select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("seen_bytes"), F.col("digest").alias("seen_digest"))
    again = flat.where("record_type = 'revisit'").join(seen, "refers", "left")
    own = flat.where("record_type <> 'revisit'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast(pages.schema[id_col].dataType).alias("refers_to"))
    return own.unionByName(again.select("page_id", F.col("seen_bytes").alias("payload_bytes"), F.col("seen_digest").alias("payload_digest"), "record_type", "refers_to"))
