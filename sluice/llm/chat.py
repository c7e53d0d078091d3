"""Chat formatting: cumulative-snapshot collapse, then rendering.

Chat applications log a conversation again after each turn. A logged conversation that is a prefix of a longer one
adds nothing, so only maximal conversations are rendered. A turn's hash binds its position, role and text; the XOR of
the hashes of the first k turns is a rolling hash of the prefix of length k, which, unlike a chained one, adds up from
parts of a conversation. A conversation goes if its whole hash is a proper prefix hash of another (an anti-join on
length and hash); of equal conversations the one with the smallest id stays.

All of this is decided on narrow rows, in which hashes stand for texts. They are dealt to tasks by ranges of
(conversation, turn, role), so a conversation of any size, with any turn numbers, is spread over tasks, and positions
and hashes are summed over its parts. Only texts that tie in turn and role take part themselves. Then the texts of the
conversations that stay are shuffled, once.

Turns are ordered by turn, role, text, nulls last; equal rows count once. Null is an id like any other, though the
largest. A null role renders as "unknown", a null text as nothing. No rows give no rows. Hashes have 128 bits. Columns
besides the four have no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut, meet

#: Turns rendered into one row; longer conversations take several, to be joined in the order of `segment`.
SEGMENT = 256
#: Ids of conversations that stay, up to this many, are broadcast (12 bytes each).
BROADCAST_CHATS = 200_000
_ORDER = ("turn", "role", "tie")


def _last(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def _hashes(text: Column) -> list[Column]:
    return [text.isNull().alias("none"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _places(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(conv_id, turn, role, tie, none, h1, h2 of the distinct rows, whether some rows are equal).

    `tie` is the text where others have the same turn and role, else null.
    """
    key = ["conv_id", "turn", "role"]
    hashed = rows.select(*key, F.struct(*_hashes(F.col("text"))).alias("t"))
    places = cut(hashed.groupBy(*key).agg(F.min("t").alias("t"), F.max("t").alias("other"), F.count("*").alias("n")))
    facts = places.agg(F.max((F.col("t") != F.col("other")).cast("int")), F.max("n")).first()
    single = places.where("t = other").select(*key, F.lit(None).cast("string").alias("tie"), "t.none", "t.h1", "t.h2")
    if not facts[0]:
        return single, bool(facts[1] and facts[1] > 1)
    many = cut(places.where("t <> other").select(*key))
    tied = meet(rows, many, *key, how="left_semi").distinct()
    return single.unionByName(tied.select(*key, F.col("text").alias("tie"), *_hashes(F.col("text")))), True


def _ordered(places: DataFrame) -> DataFrame:
    """With `chunk`, the part of all rows that a row is in, and `pos` in its conversation (from 1); a written table."""
    chunks = cut(places.repartitionByRange(*_last("conv_id", *_ORDER)).withColumn("chunk", F.spark_partition_id()))
    sizes = chunks.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(*_last(*_ORDER))
    joined = meet(chunks.withColumn("at", F.row_number().over(inside)), starts, "conv_id", "chunk")
    return cut(joined.withColumn("pos", F.col("base") + F.col("at")).select("conv_id", "turn", "role", "none", "h1", "h2", "chunk", "pos"))


def _prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, h1, h2) of every proper prefix, and (conv_id, n, h1, h2) of every whole conversation."""
    parts = [F.col("role").isNull(), F.col("role"), F.col("none"), F.col("h1"), F.col("h2")]
    hashed = turns.select("conv_id", "chunk", "pos", F.xxhash64("pos", *parts).alias("t1"), F.xxhash64(F.lit("turn"), *reversed(parts), "pos").alias("t2"))
    chunks = cut(hashed.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2")))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("conv_id")
    zero = F.lit(0).cast("long")
    starts = chunks.select("conv_id", "chunk", F.sum("n").over(all_of).alias("whole"), *[F.coalesce(F.bit_xor(f"x{i}").over(before), zero).alias(f"b{i}") for i in (1, 2)])
    up_to = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.select("conv_id", "chunk", "pos", *[F.bit_xor(f"t{i}").over(up_to).alias(f"p{i}") for i in (1, 2)])
    joined = meet(inside, starts, "conv_id", "chunk").where("pos < whole")
    prefixes = joined.select(F.col("pos").alias("n"), *[F.col(f"p{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)])
    whole = chunks.groupBy("conv_id").agg(F.sum("n").alias("n"), F.bit_xor("x1").alias("h1"), F.bit_xor("x2").alias("h2"))
    return prefixes, whole


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n (turns) of the conversations that are no proper prefix of another; of equal ones the smallest id."""
    prefixes, whole = _prefixes(turns)
    one = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return one.join(prefixes.distinct(), ["n", "h1", "h2"], "left_anti").select("conv_id", "n")


def _line(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _whole_chats(rows: DataFrame, kept: DataFrame, repeated: bool) -> DataFrame:
    """Conversations of one segment: their rows are sorted where they meet, by turn, role and text."""
    joined = meet(rows, F.broadcast(kept), "conv_id")
    joined = joined.dropDuplicates(rows.columns) if repeated else joined
    fields = [x for c in ("turn", "role", "text") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda x: _line(x["role"], x["text"]))
    return joined.groupBy("conv_id", "n").agg(F.array_join(lines, "").alias("rendered")).select("conv_id", F.lit(0).alias("segment"), F.col("n").alias("n_turns"), "rendered")


def _segments(rows: DataFrame, turns: DataFrame, kept: DataFrame, few: bool, repeated: bool, segment: int) -> DataFrame:
    """Conversations of any size: rows get their positions by a join on all of a turn but its text, which is hashed."""
    placed = meet(turns, kept, "conv_id")
    if few:  # only their texts are shuffled
        rows = meet(rows, F.broadcast(kept.select("conv_id")), "conv_id", how="left_semi")
    texts = rows.select("conv_id", "turn", "role", "text", *_hashes(F.col("text")))
    texts = meet(texts, placed, "conv_id", "turn", "role", "none", "h1", "h2").select("conv_id", "n", "pos", "role", "text")
    texts = texts.dropDuplicates(["conv_id", "pos"]) if repeated else texts
    lines = texts.select("conv_id", F.floor((F.col("pos") - 1) / segment).cast("int").alias("segment"), F.col("n").alias("n_turns"), F.struct("pos", _line(F.col("role"), F.col("text")).alias("line")).alias("x"))
    sorted_lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    return lines.groupBy("conv_id", "segment", "n_turns").agg(F.array_join(sorted_lines, "").alias("rendered"))


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, broadcast_chats: int = BROADCAST_CHATS) -> DataFrame:
    """conv_id, segment (from 0), n_turns (of the conversation), rendered: the turns of the segment as one text."""
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    places, repeated = _places(rows)
    turns = _ordered(places)
    kept = cut(maximal(turns))
    long = kept.where(F.col("n") > segment)
    if kept.count() > broadcast_chats:
        return _segments(rows, turns, kept, False, repeated, segment)
    short = _whole_chats(rows, kept.where(F.col("n") <= segment), repeated)
    return short if long.isEmpty() else short.unionByName(_segments(rows, turns, long, True, repeated, segment))
