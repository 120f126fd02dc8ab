"""What the operators need from the session: the package on every executor, and a folder all of them share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import cache
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / f"{root.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: one model or vocabulary with its caches. Workers outlive an operator, so the next one's takes its
    place, and the memory goes back to the system."""
    own = sys.__dict__.setdefault("_tidemark_held", {})
    if key not in own:
        let_go()
        own[key] = make()
    return own[key]


def let_go() -> None:
    """Give up what another operator held in this worker process; for operators that hold nothing."""
    own = sys.__dict__.get("_tidemark_held")
    if own:
        own.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass


def named(column: str) -> Column:
    """The top-level column of that very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_dir()
    return found.rstrip("/")


@cache
def _own_dir() -> str:
    """One process runs everything: its own folder is shared, and goes when it ends."""
    path = tempfile.mkdtemp(prefix="tidemark-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and lost executors cost nothing. The files stay as long as something may
    read them: until remove_intermediates or the end of the session."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_intermediates(spark: SparkSession) -> None:
    """Delete all that operators of this application have set aside; results that were not written yet can't be read any more."""
    drop_path(spark, f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")


def located(docs: DataFrame) -> DataFrame:
    """(row, file, at): each row of docs as a struct, and the numbers that tell it apart; a table that isn't read from Parquet files is written once first."""
    row, docs, place = _in_place(docs)
    return docs.select(row, F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))


def in_files(docs: DataFrame) -> DataFrame:
    """(row, part, piece, at): the number of a row's part and of the part's file, as Spark names them, and its place in the file."""
    row, docs, place = _in_place(docs)
    part, piece = (F.regexp_extract(place["file_name"], rf"{sign}-?(\d+)", 1).cast("int") for sign in ("^part", "-c"))
    return docs.select(row, F.coalesce(part, F.lit(0)).alias("part"), F.coalesce(piece, F.lit(0)).alias("piece"), place["row_index"].alias("at"))


def _in_place(docs: DataFrame) -> tuple[Column, DataFrame, Column]:
    row, place = F.struct(*map(named, docs.columns)).alias("row"), _place(docs)
    if place is None:
        docs = cut(docs.select(row), "located")
        row, place = F.col("row"), _place(docs)
    return row, docs, place


def _place(docs: DataFrame) -> Column | None:
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["file_path"], place["row_index"]).schema  # noqa: B018  resolved now
    except AnalysisException:
        return None
    return place


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cpus(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def on_disk(path: str) -> str:
    """A path that pyarrow's file systems accept."""
    return path if "://" in path else ("file://" + path.removeprefix("file:") if path.startswith(("file:", "/")) else "file://" + os.path.abspath(path))
