"""Makes the package importable for Python workers, and finds the folder that executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    _DONE.add(app)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    target = Path(tempfile.mkdtemp()) / f"marlstone_{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "marlstone").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is named, a local session (tests) gets a folder of
    its own; on a cluster, whose executors would not see it, that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The table, written and read again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
