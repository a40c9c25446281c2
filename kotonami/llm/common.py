"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the local fallback, made once for each driver process.
_FALLBACK: list[str] = []


class _Staged(threading.local):
    """Folders that a thread of the driver has staged and not deleted."""

    def __init__(self):
        self.paths: list[str] = []


_STAGED = _Staged()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables below ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _FALLBACK[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """The file system and the name of ``path`` there."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def passing_folder(spark: SparkSession, path: str) -> str:
    """``path``, made and to be deleted when the driver ends."""
    files, name = _files(spark, path)
    files.mkdirs(name)
    files.deleteOnExit(name)
    _STAGED.paths.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs the rereading of files and no recomputation,
    and lets several consumers use one computation. The folder is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = passing_folder(spark, new_folder(spark, label))
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame], label: str, since: int | None = None) -> DataFrame:
    """``make()``, staged; what was staged on the way, or since there were ``since`` folders, is deleted."""
    begin = staged_folders() if since is None else since
    out = staged(make(), label)
    for path in _STAGED.paths[begin:-1]:
        files, name = _files(spark, path)
        files.delete(name, True)
    del _STAGED.paths[begin:-1]
    return out


def staged_folders() -> int:
    """How many folders this thread has staged and not deleted."""
    return len(_STAGED.paths)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; extra columns, whatever they are called, go no further."""
    return df.select(*[df[name] for name in names])


def normalised(text) -> F.Column:
    """Lower case words of letters and digits, one space between them; null becomes empty."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.trim(words)


def bucket_of(doc_id, modulus: int):
    """``crc32(doc_id as text) mod modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus
