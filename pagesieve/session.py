"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where ``cut_lineage`` writes inside ``intermediates_in``.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def local_session(app: str = "pagesieve", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass in your own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({name.replace("__", "."): value for name, value in conf.items()})
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only where that is unset (local tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="pagesieve-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    It survives the loss of executors like a reliable checkpoint, and its readers take only the columns they need.
    """
    path = f"{_FOLDER.get() or shared_folder(df.sparkSession) + '/pagesieve'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates_in(folder: str) -> Iterator[None]:
    """Inside, ``cut_lineage`` writes below ``folder``, so that whoever owns the folder can remove what is no longer needed."""
    before = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(before)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of ours, in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def within(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows: a distributed count, which gathers no rows in one task."""
    return df.count() <= max_rows


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` hinted for broadcast when its checked size allows it, otherwise unhinted (a shuffle join)."""
    return F.broadcast(df) if within(df, max_rows) else df
