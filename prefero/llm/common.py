"""Helpers that the operators share: tables, staged results and text rules."""

from __future__ import annotations

import contextlib
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word for sizes and language-model tokens: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates such words.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes up to which a measured table is broadcast; beyond it a shuffle join runs.
BROADCAST_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a session in one process uses its warehouse folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


#: Bytes of rows that go to a Python worker at once, however long the texts.
BATCH_BYTES, BATCH_SETTING = 8_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Folder of each staged table; tables staged inside each open ``scratch`` block, the innermost last.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_OPEN: list[list[DataFrame]] = []


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def discard(df: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more."""
    path = _FOLDERS.pop(df, None)
    if path:
        files, place = _place(df.sparkSession, path)
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


def is_staged(df: DataFrame) -> bool:
    """Whether ``df`` is a table as it was staged."""
    return df in _FOLDERS


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside the block go when it ends; what outlives it is staged with ``outlives``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for df in _OPEN.pop():
            discard(df)


def staged(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, keeps the result if executors are lost, and freezes what
    an upstream plan might otherwise compute differently the second time.  The
    folder goes with the ``scratch`` block around it (``outlives``: the block around
    that), at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/prefero-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    around = _OPEN[: len(_OPEN) - outlives]
    if around:
        around[-1].append(out)
    return out


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> contextlib.AbstractContextManager[None]:
    """Jobs inside the block hand rows to Python workers in Arrow batches of about ``most`` bytes; the setting is put back."""
    return _set(spark, BATCH_SETTING, str(most))


def short_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of queries inside the block go when the query ends, not when the driver happens to collect garbage; for tables staged once."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by columns to as many tasks as the session shuffles to, few bytes or many: for work that is heavy by the row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _cell_bytes(cell: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(cell), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.aggregate(F.coalesce(cell, F.array().cast(kind)), F.lit(24).cast("long"), lambda n, x: n + _cell_bytes(x, kind.elementType))
        return F.greatest(F.size(cell), F.lit(0)).cast("long") * 8 + 24
    if isinstance(kind, T.StructType):
        return sum((_cell_bytes(cell[f.name], f.dataType) for f in kind), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows as Spark holds them, about."""
    return df.agg(F.sum(sum((_cell_bytes(df[f.name], f.dataType) for f in df.schema), F.lit(16).cast("long")))).collect()[0][0] or 0


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a staged table) marked for broadcast if its measured size is small, else as it is."""
    return F.broadcast(df) if measured_bytes(df) <= most else df


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until no column of ``frames`` has it in either case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def lowered_bytes(text: str) -> bytes:
    """UTF-8 with A-Z in lower case; ASCII classes split it as they split the text."""
    return text.encode("utf-8", "replace").lower()


def parts_between(text: Column, separators: str) -> Column:
    """The non-empty parts of a text between runs of separators; none for null.

    Splitting takes time in proportion to the text; extracting every match of a
    pattern copies the text for each.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.size(parts_between(text, SPACES)).cast("long")


def id_text(col: str) -> Column:
    """An id as text; a null id has the text of null, so it stays defined."""
    return F.coalesce(F.col(col).cast("string"), F.lit("null"))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id's text modulo n: the split of rows into folds."""
    return F.crc32(id_text(col)) % n

