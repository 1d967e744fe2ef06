"""Pieces that several operators share: the shared scratch folder, exact components, byte slices of a batch."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds between two calls that hand memory back, at least.
TRIM_EVERY = 3.0
_trimmed = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary folder of our own only in a local session (tests), where one machine is all there is."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if there, as its texts have it now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trimmed(spark: SparkSession) -> None:
    """Has the driver's JVM hand the native memory that it has freed back to the system: hundreds of short jobs leave its allocator's arenas in pieces.

    By the JVM's own diagnostic command, every few seconds at most; a JVM without it is left as it is.
    """
    global _trimmed
    if time.monotonic() - _trimmed < TRIM_EVERY:
        return
    _trimmed = time.monotonic()
    from py4j.protocol import Py4JJavaError

    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    try:
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError as error:
        if "MBeanException" not in str(error) and "ReflectionException" not in str(error) and "InstanceNotFound" not in str(error):
            raise


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark removes shuffle files from the executors' disks once the driver's JVM has collected what refers to them."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def collected(spark: SparkSession) -> None:
    """Has the driver and the executors' JVMs collect their garbage, so that heap that one operator has filled is handed back before the next one's Python workers grow beside it.

    By as many tasks as run at once, each of which calls System.gc(); calls that meet in a JVM are one collection.
    """
    swept(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def released() -> None:
    """Hands the memory that a Python worker has freed back to the system: workers stay for later tasks, and an executor holds several."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


#: What a worker holds from task to task, by name: how to drop it.
HELD: dict[str, Callable[[], None]] = {}


def forget(but: str = "") -> None:
    """Drops what this worker holds for other operators' tasks."""
    for name, drop in HELD.items():
        if name != but:
            drop()


def frugal(run: Callable, holds: str = "") -> Callable:
    """A function for mapInArrow that drops what others than `holds` have left in the worker, and hands its memory back when its task is done."""

    def each(batches: Iterator) -> Iterator:
        forget(holds)
        try:
            yield from run(batches)
        finally:
            released()

    return each


#: Seconds from which on a group's work is worth handing memory back for.
WORTH = 0.05


def frugal_group(run: Callable) -> Callable:
    """The same for a function for applyInArrow: it is called once a group, so groups of less than WORTH seconds, whose memory the next one uses again, hand nothing back."""

    def each(group):
        forget()
        began = time.monotonic()
        try:
            return run(group)
        finally:
            if time.monotonic() - began >= WORTH:
                released()

    return each


class Scratch:
    """Tables written to the shared folder. They cut lineage: a lost executor costs its tasks, not the stages before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.there: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        trimmed(self.spark)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        self.there[path] = kept
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for df in kept:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.there.pop(df.scratch_path, None)

    def clear(self, *but: DataFrame) -> None:
        """Removes all tables but those that are still read, and the shuffle files behind them."""
        left = {df.scratch_path for df in but}
        self.drop(*(df for path, df in list(self.there.items()) if path not in left))
        swept(self.spark)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the component's smallest node.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the longest
    path, each node's minimum is pre-aggregated before its shuffle, and each round is written to the shared folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = pairs.join(near, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def both(e: DataFrame) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
        return e.select(ends).select("e.u", "e.v")

    now = scratch.keep(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        wide = star(both(now), large=True)
        down = wide.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        after = scratch.keep(star(down, large=False))
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def byte_slices(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
