"""Session defaults and the size checks behind every broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def build_session(name: str = "askweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` is only set for local runs."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _width(df: DataFrame, name: str) -> Column:
    """Bytes of a column's value: of its text, its fixed width, or its JSON form."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 8
    return F.lit(8)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is within both bounds, by one distributed sum over its rows and their bytes.

    It decides between a broadcast and a shuffled join; no rows leave their tasks.
    """
    width = sum((_width(df, c) for c in df.columns), F.lit(8))
    size = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def broadcast_if_fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


_own_folder: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Only a local session may do without: it gets a folder of its own, removed at
    exit.  Elsewhere a machine's own folder would hide rows from other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="askweave-")
        atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
    return _own_folder[app]


def _app_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/askweave/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_app_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for results several later steps need: they are computed once, their row
    count is known from file metadata, and a lost executor costs a re-read instead
    of a recomputation.  ``release`` removes what an application has written.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables this application has stored; frames that read them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def default_cpus() -> str:
    return os.environ.get("BENCH_CPUS", "8")
