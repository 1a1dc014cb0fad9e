"""What the operators of this subpackage share: cutting lineage, sizing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be broadcast. A table is broadcast only after its bytes have been counted and are below this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session whose one machine runs everything (tests) gets a folder of its own
    where it names none; on a cluster that is an error, since executors don't see each other's folders."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        at = sc._jsc.sc().getCheckpointDir()
        if at.isDefined():
            found = at.get()
        elif re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            found = tempfile.mkdtemp(prefix="docscreen-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, which goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # the table replaces its shuffles
        df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def freeing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, whose worker gives its memory back at the end: workers wait for their next task with all that
    the last one's arrays took, beside those at work."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        given_back()

    return rows


def given_back() -> None:
    """Freed memory of Arrow and of the C library goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows below a plan; sources that Catalyst knows no size of count nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def bounded(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its files are small enough and joined by a shuffle if they aren't. Parquet may
    hold a table in an eighth of its memory."""
    return F.broadcast(df) if 8 * input_bytes(df) <= BROADCAST_BYTES else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Shuffle partitions for work in proportion to a table's size; never fewer than the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, input_bytes(df) // bytes_each))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n whole numbers that a repartition by them into n deals to n different partitions."""
    keys = spark.range(16 * n + 64).select(F.col("id").cast("int").alias("k")).withColumn("at", F.pmod(F.hash("k"), F.lit(n)))
    found = {r["at"]: r["k"] for r in keys.groupBy("at").agg(F.min("k").alias("k")).collect()}  # n numbers
    return [found.get(i, i) for i in range(n)]


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the actions inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, component): component is the smallest node that can be reached.

    Alternating large-star and small-star rounds over DataFrames until the edge set no longer changes, which takes some
    log(nodes) squared of them. Each round's
    minimum is a partial aggregate, so a hub doesn't reach one task; the edges of a hub join back by a join whose
    skewed side AQE can split. Nodes without an edge to another node aren't returned; null ends are left out.
    """
    e = checkpoint(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _state(after)
        e = after
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(r[0]), r[1]
