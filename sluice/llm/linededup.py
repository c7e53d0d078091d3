"""Line dedup by site-relative frequency, in DataFrame functions only.

A page's lines are its text cut at line feeds; a line's key is its text without surrounding white space. On each host,
the pages that contain a line are divided by all the host's pages; the line is boilerplate if the ratio exceeds
`max_ratio` and at least `min_pages` pages have it. Boilerplate lines go wherever they occur on the host.

Pages of a host with the same text count as one, in both counts: lines that only a page's copies repeat are that page's
own, and would otherwise go from all copies alike. Blank lines always stay. A page counts once for a line it repeats. A
null text is a page without lines and stays null; a text whose lines all go becomes empty. Null is a host like any
other. Every row has its result, repeated rows too. No rows give no rows. Long texts are cut like others: a page's lines
are one array. Columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, meet, unused

#: Boilerplate lines up to this many are broadcast (40 bytes each); more are joined by shuffles.
BROADCAST_LINES = 200_000
#: Lines of a list that a lookup reads, on average.
LISTED = 4


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def boilerplate(df: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """host, h1, h2 of the boilerplate lines of each host.

    One pass over the texts: the blank key, which every page is given and no line counts for, counts the host's pages.
    Copies meet by (line, page), so neither a hot host nor a line on all its pages is one task's.
    """
    text = F.col(text_col)
    keys = F.array_distinct(F.filter(F.transform(_lines(text), _key), lambda k: k != ""))
    keys = F.array_append(F.coalesce(keys, F.array().cast("array<string>")), "")
    pages = df.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("p1"), F.xxhash64(F.lit("second"), text).alias("p2"), F.explode(keys).alias("key"))
    lines = pages.select("host", "p1", "p2", _hash(F.col("key")).alias("h"), (F.col("key") == "").alias("total")).select("host", "p1", "p2", "h.h1", "h.h2", "total")
    counts = lines.groupBy("host", "h1", "h2", "total").agg(F.count_distinct("p1", "p2").alias("n"))
    counts = cut(counts.where(F.col("total") | (F.col("n") >= min_pages)))
    totals = counts.where("total").select("host", F.col("n").alias("pages"))
    # few lines of a host can exceed the ratio, but many more reach min_pages: totals come by a join, not a broadcast hint
    return meet(counts.where("NOT total"), totals, "host").where(F.col("n") / F.col("pages") > max_ratio).select("host", "h1", "h2")


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 4, broadcast_lines: int = BROADCAST_LINES, counts: tuple[str, str] | None = None) -> DataFrame:
    """`df` with boilerplate lines taken out of the text; `counts` names two more columns, the page's lines and those
    dropped (both int, 0 for null)."""
    bad = cut(boilerplate(df, host_col, text_col, max_ratio, min_pages))
    work = _in_place if bad.count() <= broadcast_lines else _by_shuffle
    (stay,) = unused(df, "stay")
    return _done(work(df, bad, host_col, text_col, stay), text_col, stay, counts)


def _listed(bad: DataFrame) -> DataFrame:
    """bad_host and `lists`: the host's lines, dealt by hash to lists of a few, so that a lookup reads one of them."""
    sizes = cut(bad.groupBy("host").agg(F.ceil(F.count("*") / LISTED).cast("int").alias("n")))
    place = F.pmod("h1", F.col("n")).cast("int")
    dealt = meet(bad, sizes, "host").groupBy("host", place.alias("place")).agg(F.collect_list(F.struct("h1", "h2")).alias("some"))
    places = sizes.select("host", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    whole = meet(places, dealt, "host", "place", how="left").select("host", F.struct("place", "some").alias("x"))
    return whole.groupBy(F.col("host").alias("bad_host")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["some"]).alias("lists"))


def _in_place(df: DataFrame, bad: DataFrame, host_col: str, text_col: str, stay: str) -> DataFrame:
    """Adds `stay`, the lines that stay: one hash join with each host's lists; no text is shuffled."""
    host, lists = unused(df, "bad_host", "lists")
    out = df.join(F.broadcast(_listed(bad).withColumnsRenamed({"bad_host": host, "lists": lists})), F.col(host_col).eqNullSafe(F.col(host)), "left")
    text, n = F.col(text_col), F.size(lists)
    rows = F.transform(_lines(text), lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    rows = F.transform(rows, lambda r: F.struct(r["line"].alias("line"), (r["key"] == "").alias("blank"), *[F.xxhash64(*seed, r["key"]).alias(h) for h, seed in (("h1", ()), ("h2", (F.lit("second"),)))]))
    known = lambda r: F.exists(F.coalesce(F.get(lists, F.pmod(r["h1"], n).cast("int")), F.array().cast("array<struct<h1:long,h2:long>>")), lambda b: (b["h1"] == r["h1"]) & (b["h2"] == r["h2"]))
    kept = F.transform(F.filter(rows, lambda r: r["blank"] | ~known(r)), lambda r: r["line"])
    return out.withColumn(stay, F.when(F.col(lists).isNull(), _lines(text)).otherwise(kept)).drop(host, lists)


def _done(out: DataFrame, text_col: str, stay: str, counts: tuple[str, str] | None) -> DataFrame:
    if counts:
        text = F.col(text_col)
        lines = F.coalesce(F.size(_lines(text)), F.lit(0))
        out = out.withColumns({counts[0]: F.when(text.isNull(), 0).otherwise(lines), counts[1]: F.when(text.isNull(), 0).otherwise(lines - F.size(stay))})
    return out.withColumn(text_col, F.array_join(stay, "\n")).drop(stay)


def _by_shuffle(df: DataFrame, bad: DataFrame, host_col: str, text_col: str, stay: str) -> DataFrame:
    """The same by joining lines with boilerplate lines by (host, hash), a frequent line spread over salts, and
    regrouping by page. Equal (host, text) get equal results, so they are worked out once and joined back."""
    salts = 32
    host, p1, p2 = unused(df, "own_host", "p1", "p2")
    keyed = df.withColumns({p1: F.xxhash64(F.col(text_col)), p2: F.xxhash64(F.lit("second"), F.col(text_col)), host: F.col(host_col)})
    texts = keyed.select(F.col(host).alias("host"), F.col(p1).alias("p1"), F.col(p2).alias("p2"), F.col(text_col).alias("text")).groupBy("host", "p1", "p2").agg(F.any_value("text").alias("text"))
    lines = texts.where("text IS NOT NULL").select("host", "p1", "p2", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("h", F.when(_key(F.col("line")) != "", _hash(_key(F.col("line"))))).withColumn("salt", F.pmod(F.xxhash64("p1", "pos"), F.lit(salts)))
    many = bad.select(F.col("host").alias("bad_host"), F.struct("h1", "h2").alias("bad_h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("bad_salt"))
    kept = lines.join(many, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("h") == F.col("bad_h")) & (F.col("salt") == F.col("bad_salt")), "left_anti")
    found = kept.groupBy("host", "p1", "p2").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias(stay))
    found = cut(found.withColumnsRenamed({"host": host, "p1": p1, "p2": p2}))
    out = meet(keyed, found, host, p1, p2, how="left")
    empty = F.array().cast("array<string>")
    return out.withColumn(stay, F.when(F.col(text_col).isNotNull(), F.coalesce(stay, empty))).drop(p1, p2, host)


def digest(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 4) -> DataFrame:
    """Per page: doc_id, n_lines, n_dropped, n_chars (of the text that stays, null for null), text_sha256 (of it)."""
    pages = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    out = drop_boilerplate(pages, "host", "text", max_ratio, min_pages, counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
