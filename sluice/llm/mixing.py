"""Mixing sources to target weights, in DataFrame functions only.

Each source's words, documents in a fixed pseudorandom order, are one stream packed into blocks of `block` words (the
last may be shorter). A source's target is a share of `budget` times all words by its weight, but at most `repeat`
times the source's own words, the excess reshared by weight until no source is above. A source is due as many slots as
blocks make up its target: whole rounds through all its blocks, then a part of one more round, whose last slot is cut
to the word.

Every output shard of `shard_slots` slots draws its source counts from the multinomial over the sources' shares of all
slots, slot by slot with a hash of shard and slot. A source's slots are numbered by running sums of its counts over the
shards, and a number maps to a round and, through a pseudorandom permutation of the source's block indices
(swap-or-not, exact on any range), to a block; slots and blocks are joined by (source, block index). So that targets
hold to the word, numbers beyond what a source is due are left out, and numbers that the draw did not reach are thrown
to shards one by one: both are about the root of the source's slots.

Null and empty texts have size 0 and nothing taken; null is a source of its own, the last in order. Repeated rows and
repeated ids each have their own words. An empty table gives no rows. Columns besides id, text and source play no part,
whatever their names. All randomness is a hash of `seed`, the source's place and the index, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import WORD, cut, same

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a source are numbered in so many buckets, which bounds the rows of any one window.
BUCKETS = 4096
#: Slots of a shard; intervals in which a drawn place is looked up, and the rows of that table that may be broadcast.
SHARD_SLOTS = 4096
INTERVALS = 4096
BROADCAST_SOURCES = 100_000
ROUNDS = 24


def _permuted(x: Column, n: Column, seed: int, *key: Column) -> Column:
    """`x` in [0, n) under a pseudorandom permutation that `seed` and `key` choose: swap-or-not rounds."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), *key, r), n) + n - x, n)
        swap = F.xxhash64(F.lit(seed + 1), *key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, partner).otherwise(x)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)).otherwise(x)


def targets(sizes: DataFrame, budget: float = 1.5, repeat: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, sid (place in code point order, null last), source_size, target for a row of source, source_size each.

    A source is capped if its cap by weight is below the level at which the others share what is left; the level is
    found from running sums in the order of cap by weight.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.array(*map(F.lit, weights))[F.pmod(F.col("sid"), F.lit(len(weights)))]
    s = sizes.withColumn("sid", F.row_number().over(place).cast("long") - 1).withColumn("w", weight).withColumn("cap", repeat * F.col("source_size"))
    s = s.withColumn("rate", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    up_to = Window.orderBy("rate", "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", budget * F.sum("source_size").over(everything))
    left = F.col("total") - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))
    share = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up_to), F.lit(0.0))
    s = s.withColumn("level", left / share)
    # the sources before the first with rate > level are capped; its level, the highest of these, holds for it and all after
    level = F.max(F.when(F.col("rate") > F.col("level"), F.col("level"))).over(everything)
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * level))
    return s.select("source", "sid", "source_size", target.alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, budget: float = 1.5, repeat: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks): the documents with their places in the streams, and the pieces of them that each block holds.

    documents: id, size, bucket, sid, source, text_hash, source_size, target, start (first word's place in its source's stream).
    blocks: sid, block_index, id, start, size and length (words of the piece), first (of the piece in the block).
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    text_hash = F.xxhash64(F.col(text_col))
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), text_hash.alias("text_hash")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash"), F.lit(BUCKETS))))
    buckets = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), budget, repeat, weights)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    buckets = cut(buckets.join(sources, buckets.source.eqNullSafe(sources.source)).drop(sources.source))
    inside = Window.partitionBy("sid", "bucket").orderBy("id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    documents = sized.join(buckets, same(sized, buckets, "source", "bucket")).select(*[sized[c] for c in sized.columns], "sid", "source_size", "target", "base")
    documents = cut(documents.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).select("id", "size", "sid", "bucket", "source", "text_hash", "source_size", "target", "start"))
    touched = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = documents.where("size > 0").select("sid", "id", "start", "size", F.explode(touched).alias("block_index"))
    at = F.col("block_index") * block
    first = F.greatest(F.col("start"), at)
    pieces = pieces.withColumn("first", first - at).withColumn("length", F.least(F.col("start") + F.col("size"), at + block) - first)
    return documents, pieces


def due(documents: DataFrame, block: int = 128, seed: int = 17) -> DataFrame:
    """sid, n (blocks), q (slots the source is due), and what cuts the last slot to the word: rounds, rest, last_at, short."""
    s = documents.groupBy("sid").agg(F.max("source_size").alias("n_words"), F.max("target").alias("target")).where("n_words > 0 and target >= 1")
    s = s.withColumn("n_words", F.greatest("n_words", F.lit(1).cast("long")))  # filters may run after what follows
    s = s.withColumn("n", F.ceil(F.col("n_words") / block)).withColumn("words", F.floor("target"))
    s = s.withColumn("rounds", F.floor(F.col("words") / F.col("n_words")))
    s = s.withColumn("rest", F.col("words") - F.col("rounds") * F.col("n_words"))
    s = s.withColumn("last_at", _inverse_last(F.col("n"), seed, F.col("sid"), F.col("rounds")))
    short = F.col("n") * block - F.col("n_words")  # words the last block lacks; they shift what follows it in the part round
    partial = F.least(F.when(F.col("rest") > 0, F.ceil((F.col("rest") + F.when(F.col("last_at") * block < F.col("rest"), short).otherwise(0)) / block)).otherwise(0), F.col("n"))
    return s.withColumn("short", short).withColumn("q", F.col("rounds") * F.col("n") + partial).where("q > 0").select("sid", "n", "q", "rounds", "rest", "last_at", "short")


def draw(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> tuple[DataFrame, int]:
    """(sid, shard, slot for every slot drawn, shards): each slot's source is drawn by the sources' shares of all q slots.

    A slot's hash is a place among all slots that are due; the sources' ranges are cut at fixed intervals, so the place
    is looked up by an equi-join on its interval, a broadcast one while sources are few (checked).
    """
    spark = sources.sparkSession
    totals = sources.agg(F.sum("q"), F.count("*")).first()
    total, many = int(totals[0] or 0), int(totals[1]) + INTERVALS > BROADCAST_SOURCES
    shards = max(1, -(-total // shard_slots))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slot = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / shard_slots).alias("shard"), (F.col("id") % shard_slots).alias("slot"))
    slot = slot.withColumn("place", F.pmod(F.xxhash64(F.lit(seed + 2), "shard", "slot"), F.lit(max(1, total))))
    width = max(1, -(-total // INTERVALS))
    end = F.sum("q").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    ranges = sources.select("sid", "q", end.alias("end")).select("sid", (F.col("end") - F.col("q")).alias("begin"), "end")
    ranges = ranges.withColumn("interval", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))))
    slot = slot.withColumn("interval", F.floor(F.col("place") / width))
    drawn = slot.join(ranges.hint("merge") if many else F.broadcast(ranges), "interval").where("place >= begin and place < end")
    return drawn.select("sid", "shard", "slot"), shards


def slots(documents: DataFrame, block: int = 128, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """sid, block_index, shard, slot, words (how many of the block's first words the slot takes).

    Slots thrown to a shard after the draw follow its drawn ones. Windows hold one shard's slots or one source's shards.
    """
    sources = cut(due(documents, block, seed))
    drawn, shards = draw(sources, shard_slots, seed)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(drawn.groupBy("sid", "shard").agg(F.count("*").alias("drawn")))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("drawn").over(before), F.lit(0).cast("long")))
    inside = Window.partitionBy("sid", "shard").orderBy("slot")
    placed = drawn.withColumn("at", F.row_number().over(inside).cast("long") - 1).join(counts.select("sid", "shard", "base"), ["sid", "shard"])
    placed = placed.select("sid", "shard", "slot", (F.col("base") + F.col("at")).alias("number"))
    got = counts.groupBy("sid").agg(F.sum("drawn").alias("got"))
    # numbers from the drawn ones up to what is due, unfolded in runs so that no task unfolds a source alone
    lack = sources.join(got, "sid", "left").select("sid", "q", F.coalesce("got", F.lit(0).cast("long")).alias("got")).where("got < q")
    run = F.explode(F.sequence(F.floor(F.col("got") / shard_slots), F.floor((F.col("q") - 1) / shard_slots)))
    lack = lack.withColumn("run", run).repartition(parts, "sid", "run")
    first = F.greatest("got", F.col("run") * shard_slots)
    lack = lack.select("sid", F.explode(F.sequence(first, F.least(F.col("q"), (F.col("run") + 1) * shard_slots) - 1)).alias("number"))
    place = F.xxhash64(F.lit(seed + 3), "sid", "number")
    lack = lack.select("sid", F.pmod(place, F.lit(shards)).alias("shard"), (F.lit(shard_slots) + F.shiftrightunsigned(place, 2)).alias("slot"), "number")
    s = placed.unionByName(lack).join(sources, "sid").where("number < q")
    s = s.withColumn("turn", F.floor(F.col("number") / F.col("n"))).withColumn("i", F.col("number") % F.col("n"))
    s = s.withColumn("block_index", _permuted(F.col("i"), F.col("n"), seed, F.col("sid"), F.col("turn")))
    seen = F.col("i") * block - F.when(F.col("last_at") < F.col("i"), F.col("short")).otherwise(0)
    words = F.when(F.col("turn") < F.col("rounds"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - seen))
    return s.select("sid", "block_index", "shard", "slot", words.cast("long").alias("words"))


def _inverse_last(n: Column, seed: int, *key: Column) -> Column:
    """The x that the permutation sends to n - 1: every round is its own inverse, so they are run backwards."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), *key, r), n) + n - x, n)
        swap = F.xxhash64(F.lit(seed + 1), *key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, partner).otherwise(x)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)), n - 1, step)).otherwise(F.lit(0).cast("long"))


def mixed_pieces(documents: DataFrame, pieces: DataFrame, block: int = 128, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """The mix itself: sid, shard, slot, id, start (of the document), first (word of the piece in its document), taken."""
    drawn = slots(documents, block, shard_slots, seed)
    joined = pieces.join(drawn.hint("merge"), ["sid", "block_index"])  # slots look few to the planner before they are unfolded
    taken = F.least(F.col("length"), F.col("words") - F.col("first"))
    return joined.withColumn("taken", taken).where("taken > 0").select("sid", "shard", "slot", "id", "start", (F.col("block_index") * block + F.col("first") - F.col("start")).alias("first"), "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, budget: float = 1.5, repeat: float = 2.0, weights: tuple[float, ...] = WEIGHTS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted),
    n_pieces, and first_shard and last_shard that hold a piece of it (null without any)."""
    documents, pieces = plan(docs, id_col, text_col, source_col, block, budget, repeat, weights, seed)
    drawn = mixed_pieces(documents, pieces, block, shard_slots, seed)
    drawn = drawn.groupBy("sid", "start").agg(F.sum("taken").alias("taken"), F.count("*").alias("n_pieces"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    # a document with words has its stream place to itself; those without take nothing
    zero, no_shard = F.lit(0).cast("long"), F.lit(None).cast("long")
    some = documents.where("size > 0").join(drawn, ["sid", "start"], "left")
    none = documents.where("size = 0").withColumns({"taken": zero, "n_pieces": zero, "first_shard": no_shard, "last_shard": no_shard})
    columns = [F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("n_pieces", zero).alias("n_pieces"), "first_shard", "last_shard"]
    return some.select(*columns).unionByName(none.select(*columns))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, budget: float = 1.5, repeat: float = 2.0, weights: tuple[float, ...] = WEIGHTS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """What a training job reads: shard, slot, source, text (the slot's words, joined by spaces)."""
    documents, pieces = plan(docs, id_col, text_col, source_col, block, budget, repeat, weights, seed)
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(0))
    source = F.col(source_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), source.alias("source"), F.xxhash64(F.col(text_col)).alias("text_hash"), words.alias("w")).dropDuplicates(["id", "source", "text_hash"])
    taken = mixed_pieces(documents, pieces, block, shard_slots, seed).join(documents.select("sid", "start", "text_hash", "source").where("size > 0"), ["sid", "start"])
    joined = taken.join(texts, same(taken, texts, "id", "source", "text_hash")).select("shard", "slot", taken["source"], "first", "taken", "w", (F.col("start") + F.col("first")).alias("at"))
    part = F.struct("at", F.array_join(F.slice("w", F.col("first").cast("int") + 1, F.col("taken").cast("int")), " ").alias("t"))
    return joined.groupBy("shard", "slot", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), " ").alias("text"))
