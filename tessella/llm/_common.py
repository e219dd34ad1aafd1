"""What the operators share: the shared folder, written tables, bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and a word, in every operator that counts words.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local master may go without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes `df` as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of the shared folder with all that is in them."""
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that saved() wrote."""
    for df in frames:
        cleared(df.sparkSession, *{x.rpartition("/")[0] for x in df.inputFiles()})


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def filesystem(uri: str):
    """pyarrow's file system for a URI of the shared folder, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_whole(uri: str, chunks) -> None:
    """Writes a file under another name first, so that a task that is lost or run twice leaves a whole file or none."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft, compression=None) as out:
        for x in chunks:
            out.write(x)
    system.move(draft, path)


def release() -> None:
    """Gives a Python worker's freed memory back to the machine: workers live on, and their allocators keep what tasks used."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
