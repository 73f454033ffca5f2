"""Results that are kept and used again: by a fingerprint of the files that they come from, and of the parameters."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths: list[str], parameters: dict) -> str:
    """A digest of the files under some paths (name, size and time of change) and of parameters; files that don't exist raise an error."""
    files = []
    for path in sorted(paths):
        p, fs = _path(spark, path)
        found = fs.listFiles(p, True)
        while found.hasNext():
            x = found.next()
            files.append([x.getPath().toString(), x.getLen(), x.getModificationTime()])
    return hashlib.sha256(json.dumps([sorted(files), parameters], sort_keys=True).encode()).hexdigest()[:32]


def reused(spark: SparkSession, folder: str, name: str, paths: list[str], parameters: dict, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """make()'s rows, or those of an earlier run over the same files with the same parameters; force: made anew.

    They are written aside and renamed, so a run that breaks off leaves nothing to be taken for a result, and of two runs at
    once one counts.
    """
    place = f"{folder.rstrip('/')}/{name}-{fingerprint(spark, paths, parameters)}"
    p, fs = _path(spark, place)
    if force or not fs.exists(p):
        aside = f"{folder.rstrip('/')}/.{name}-{uuid.uuid4().hex}"
        make().write.parquet(aside)
        if force:
            fs.delete(p, True)
        if fs.exists(p) or not fs.rename(_path(spark, aside)[0], p):
            fs.delete(_path(spark, aside)[0], True)
    return spark.read.parquet(place)


def basic_info(spark: SparkSession, folder: str, files: dict[str, str], read: Callable[[str, str], DataFrame], sites: DataFrame, window: int, parameters: dict | None = None, force: bool = False) -> DataFrame:
    """One row for each sample (files: name -> path): sample, coverage, read_length, mean_is, std_is, from reads around sites.

    read makes reads of a path and a sample's name. parameters has to tell the sites apart; samples are reused one by one.
    """
    out = None
    for sample, path in sorted(files.items()):
        def make(sample: str = sample, path: str = path) -> DataFrame:
            return scan.library(scan.window_statistics(read(path, sample), sites, window)).select(F.lit(sample).alias("sample"), "coverage", "read_length", "mean_is", "std_is")

        one = reused(spark, folder, "basic-info", [path], {"sample": sample, "window": window, **(parameters or {})}, make, force)
        out = one if out is None else out.unionByName(one)
    return out


def combined(info: DataFrame) -> DataFrame:
    """basic_info() -> one row for all samples: their coverages added up, and the means of the rest; zeros without samples."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return info.agg(zero(F.sum("coverage")).alias("coverage"), *(zero(F.avg(c)).alias(c) for c in ("read_length", "mean_is", "std_is")))
