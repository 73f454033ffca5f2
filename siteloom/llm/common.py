"""What the corpus operators share: word splitting, materialised tables, hashing."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

U = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def zero() -> Column:
    """0 as a long that the optimizer takes for non-deterministic: filters aren't pushed below the projection that adds it,

    where they would copy (and so compute again) the long expressions they refer to.
    """
    return F.when(F.spark_partition_id() < 0, 1).otherwise(0).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset, one of our own in local mode, where all is one machine; on a cluster an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file:///tmp/siteloom-checkpoints/{spark.sparkContext.applicationId}"
    return path.rstrip("/")


def own(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, one for each stem."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialise(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write df as a table in the shared folder and read it again: a cut in the lineage that outlives lost executors.

    The table is removed when the application ends. free: let the shuffle files go that led to it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siteloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    if free:
        release(spark)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialise() that no later step reads."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is no longer referred to.

    It does so when the driver's JVM collects garbage, which may not be for half an hour; after a table is written, what
    led to it isn't needed.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h ^ (h >> U(31))
    h = h * U(0x9FB21C651E98DF25)
    h = h ^ (h >> U(28))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def mix_in_place(h: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """mix() for long arrays, without new memory."""
    for shift, factor in ((31, 0x9FB21C651E98DF25), (28, 0xD6E8FEB86659FD93), (32, None)):
        np.right_shift(h, U(shift), out=spare)
        np.bitwise_xor(h, spare, out=h)
        if factor:
            np.multiply(h, U(factor), out=h)
    return h
