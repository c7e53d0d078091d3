"""What the training-data operators share: lineage cuts, null-safe joins, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a table that may be dealt anew to all cores, and the least that a core gets.
SMALL_TABLE, SMALL_PART = 64 << 20, 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one that its reader splits into fewer parts than there are cores is dealt to more of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(spark.sparkContext.defaultParallelism, -(-size // SMALL_PART))
    return df.repartition(parts) if size <= SMALL_TABLE and df.rdd.getNumPartitions() < parts else df


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names in spark.checkpoint.dir; a local session without one gets its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sluice-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared checkpoint folder: lost executors cost no recomputation."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of `df` has one of them (in any case)."""
    taken = {c.lower() for c in df.columns}
    tail = ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition over equally named columns in which null equals null."""
    return reduce(Column.__and__, (left[n].eqNullSafe(right[n]) for n in names))


def meet(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on equally named columns in which null equals null, kept once; the two may come from the same table."""
    theirs = dict(zip(names, unused(left, *(f"right_{n}" for n in names)), strict=True))
    other = right.withColumnsRenamed(theirs)
    on = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(theirs[n])) for n in names))
    return left.join(other, on, how).drop(*theirs.values())


def smallest_hashes(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The `limit` rows of `df` with the smallest hash of `key` (ties by all columns): a sample that reruns agree on.

    Rows beyond twice the expected cut are dropped before the sort, so no task gets more than a few times `limit`.
    """
    h = F.xxhash64(key)
    n = df.count()
    if n > 4 * limit:
        df = df.where(h < F.lit(-(1 << 63) + int((1 << 64) * 2 * limit / n)))
    return df.orderBy(h, *df.columns).limit(limit)


def raw(value: pa.Scalar) -> bytes:
    """The UTF-8 bytes of a string or binary Arrow value, without decoding them; none for null."""
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def give_back() -> None:
    """Returns free memory of this process to the system; Python's and Arrow's allocators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def lean(work: Callable) -> Callable:
    """The mapInArrow function `work`; a worker, which Spark keeps for later tasks, gives its memory back after it."""

    def then_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return then_lean


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that `edges` (columns a, b) names; root is the smallest node of its component.

    Alternates large-star and small-star steps. Every step is an aggregation and an equi-join, so a hub's
    neighbours never meet in one group, and the number of rounds grows with the logarithm of the longest chain.
    Self loops and repeated edges change nothing; no edges give no rows. Nulls are not nodes.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _signature(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = cut(large.join(low, "u").select(pair.alias("p")).select("p.u", "p.v").where("u <> v").distinct())
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h, "u"))).first())
