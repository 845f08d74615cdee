"""Shared by the operators of this folder: shared storage, code shipping, memory, small helpers."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import shared_folder, ship


#: Bytes of an Arrow batch, where the session has Spark's own default: texts may be long.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b")


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever the driver's path is, and keep their
    batches small."""
    name, default, small = BATCH
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, small)
    ship(spark)


def release() -> None:
    """At a task's end: give its memory back, as the worker waits for other tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_WORKING: list[list[DataFrame]] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and no
    executor's loss can take it away."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _WORKING:
        _WORKING[-1].append(out)
    return out


def finished(tag: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written; the tables that were written on the way are deleted."""
    _WORKING.append([])
    try:
        result = materialise(make(), tag)
    finally:
        made = _WORKING.pop()
    for table in made:
        if table is not result:
            forget(table)
    if _WORKING:
        _WORKING[-1].append(result)
    return result


def forget(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing will read it again."""
    sc = df.sparkSession.sparkContext
    try:
        files = df.inputFiles()[:1]  # an empty table has a file, too
    except Exception:  # noqa: BLE001  it has been deleted already
        return
    for f in files:
        path = sc._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def id_columns(id_col: str) -> list[Column]:
    """An id for Python workers, where a null among longs would make all of them inexact: the id or 0,
    and whether it is null.  ``ids_of`` gives them back."""
    known = F.col(id_col).cast("long")
    return [F.coalesce(known, F.lit(0)).alias("doc_id"), known.isNull().alias("no_id")]


def ids_of(pdf: pd.DataFrame) -> list[int | None]:
    return [None if null else name for name, null in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist())]


def longs(values: list[int | None]):
    """Longs, nulls among them, without a way through floats."""
    return pd.array(values, "Int64")


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """One key, never null, for the rows with the same id and the same text: what an operator
    finds for a row follows from these two.  ``row_key_of`` is the same in Python."""
    return row_key_from(F.col(id_col), text_col)


def row_key_from(known: Column, text_col: str = "text") -> Column:
    head = F.coalesce(known.cast("string"), F.lit("null"))
    return F.sha2(F.concat(head, F.lit(":"), text_or_empty(text_col)), 256)


def row_key_of(doc_id: int | None, text: bytes) -> str:
    return hashlib.sha256(b"%s:%s" % (b"null" if doc_id is None else b"%d" % doc_id, text)).hexdigest()
