"""Helpers that several operators share: shared storage, tokenising rules, joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code-point class of a white-space word, for Java regular expressions.
SPACE_CLASS = r"\x20\x09-\x0D"


def _table() -> bytes:
    keep = bytearray(b" " * 256)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            keep[b] = b
        elif 0x41 <= b <= 0x5A:
            keep[b] = b + 32
    return bytes(keep)


_ALNUM = _table()


def alnum_words(data: bytes) -> list[bytes]:
    """Lower-cases A-Z and returns the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

    On UTF-8 bytes the class is digits, a-z and every byte from 0x80, so one
    table look-up and a split on ASCII white space do it.
    """
    return alnum_bytes(data).split()


def alnum_bytes(data: bytes) -> bytes:
    """The same bytes, A-Z in lower case, with a space for each that is in no such word."""
    return data.translate(_ALNUM)


def ascii_lower(data: bytes) -> bytes:
    """Lower-cases A-Z only."""
    return data.lower()


#: Rows of whole texts in one Arrow batch.
ARROW_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per context, so that
    it needn't be installed there, and bounds the rows that a worker gets at once."""
    import os
    import zipfile

    if int(spark.conf.get(_ARROW_ROWS)) > ARROW_ROWS:
        spark.conf.set(_ARROW_ROWS, str(ARROW_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_catchment_engine", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):  # already read from an archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="catchment-"), "catchment_engine.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(archive)
    sc._catchment_engine = True


def sliced(batches, rows: int = 512):
    """Batches in slices of some rows: what Python makes of a slice is gone before the next.
    At the end, free memory goes back to the system, as the worker may be idle then."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        b = None
    trim()


def trim() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset and all runs on one machine (tests), a temporary one for each application."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="catchment-shared-")
        at = _own[app]
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Writes a table to shared storage and reads it again: its lineage is cut,
    a lost executor loses nothing, and the planner knows its size (so that a
    broadcast is chosen only where the files are below the threshold)."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Deletes the files of staged tables that nothing will read again."""
    for df in staged:
        drop_path(df.sparkSession, df._staged_at)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def once(c: Column) -> Column:
    """c, computed in the projection where it stands. The planner copies a column that is used
    once into its user, which for a lambda's body means once for each element; it doesn't
    copy what isn't deterministic, such as this condition, which always holds."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content; used together with doc_id."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


#: Rows of keys that are broadcast at most, about 100 bytes each; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of docs with no equal (null-safe) keys in gone, a staged table."""
    names = {k: f"__gone_{i}" for i, k in enumerate(keys)}
    other = gone.select(*[F.col(k).alias(v) for k, v in names.items()]).distinct()
    on = None
    for k, v in names.items():
        on = docs[k].eqNullSafe(other[v]) if on is None else on & docs[k].eqNullSafe(other[v])
    return docs.join(F.broadcast(other) if gone.count() <= BROADCAST_ROWS else other, on, "left_anti")
