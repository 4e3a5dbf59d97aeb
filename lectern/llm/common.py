"""Spark helpers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its measured rows and bytes are below these bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's spark.checkpoint.dir. Only a local session may go without; it gets a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; later stages survive lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder: unlike `cut`, the last stage does not run twice, so it suits stages of much work."""
    folder = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession, wait: bool = False) -> None:
    """Deletes the files of shuffles that nothing refers to any more, and gives the driver's memory back; Spark does so only when the driver happens to collect its garbage."""
    _release()
    spark._jvm.System.gc()
    if wait:  # what Python let go of, the JVM hears a moment later
        for _ in range(2):
            time.sleep(0.5)
            spark._jvm.System.gc()
        time.sleep(0.5)


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row, about: 8 for each fixed column, the others as text."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    size = F.lit(8 * len(df.columns)).cast("long")
    return size + F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide]))) if wide else size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and `size` bytes, else as it is. df should be written already (`cut`)."""
    n, total = df.agg(F.count("*"), F.sum(_bytes(df))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows and the bytes of an Arrow batch, so that batches of very long texts fit in memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def tidy(run):
    """A mapInArrow function that gives its memory back to the system when a task ends; workers live on, and allocators would keep it."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return tidied


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def own(name: str) -> str:
    """A column name that inputs won't have."""
    return f"__lectern_{name}"


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """A 64-bit key that rows with equal id and text share; null-safe."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull())


def wide_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """A 128-bit key that rows with equal id and text share; null-safe."""
    return F.struct(row_key(df, id_col, text_col).alias("a"), F.xxhash64(F.lit("b"), F.col(text_col), F.col(id_col).cast("string")).alias("b"))


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def widened(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of df with more columns."""
    return T.StructType([*df.schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items()]])


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df without those of these names: a result column replaces an input column of its name."""
    return [F.col(f"`{c}`") for c in df.columns if c not in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, per: int = 50_000) -> DataFrame:
    """The rows, written like `cut`, in as few partitions as their number asks for.

    Tables that are small beside the input would else keep a task, and a shuffle file, for each shuffle partition.
    """
    out = cut(df)
    release(df.sparkSession)
    return out.coalesce(out.count() // per + 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph; component is the smallest node reachable.

    Alternating large-star and small-star rounds; each halves paths, each is written
    to the checkpoint folder, and no group is collected: both stars are a minimum by key and a join.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, before = state(e), None
    while now != before:
        parts = now[0] // 50_000 + 1
        e = e.coalesce(parts)
        # large star: every neighbour above u is linked to the least neighbour of u (or u)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").coalesce(parts).distinct().coalesce(parts)
        # small star: u and its lower neighbours are linked to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(parts).distinct()
        e = cut(small.coalesce(parts))
        before, now = now, state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct().coalesce(now[0] // 50_000 + 1)
