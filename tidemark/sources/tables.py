"""Reading tables (Parquet before CSV), handing them over as views, and writing results."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.schemas import ALIASES, TABLES

Tables = Mapping[str, DataFrame]


def canonical(tables: Tables) -> dict[str, DataFrame]:
    """Tables under their canonical names."""
    return {ALIASES.get(k, k): v for k, v in tables.items()}


def read_table(spark: SparkSession, data_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """<dir>/<name>.parquet if it can be read, else <dir>/<name>.csv with a header; dates in text become timestamps."""
    schema = schema or TABLES[name]
    try:
        df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    except AnalysisException:
        as_text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema])
        df = spark.read.schema(as_text).option("header", True).csv(f"{data_dir}/{name}.csv")
    kinds = dict(df.dtypes)
    dates = {f.name: F.try_to_timestamp(f.name) for f in schema if isinstance(f.dataType, T.TimestampType) and kinds.get(f.name) == "string"}
    return df.withColumns(dates) if dates else df


def load_tables(spark: SparkSession, data_dir: str, names: Sequence[str] = tuple(TABLES), schemas: Mapping[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    return {n: read_table(spark, data_dir, n, (schemas or {}).get(n)) for n in names}


def resolve(spark: SparkSession, tables: Tables | None, data_dir: str | None, names: Sequence[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """Tables handed in, or else those of data_dir."""
    if tables is not None:
        return canonical(tables)
    if data_dir is None:
        raise ValueError("give tables or data_dir")
    return load_tables(spark, data_dir, names)


def register(tables: Tables) -> None:
    for name, df in canonical(tables).items():
        df.createOrReplaceTempView(name)


def run_script(spark: SparkSession, script: str) -> None:
    """Run statements that end in semicolons, in order."""
    for statement in filter(None, map(str.strip, script.split(";"))):
        spark.sql(statement)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; arrays become text. Written by all tasks; one_file is for result tables of a few hundred rows at most."""
    flat = [F.concat_ws("|", F.col(n)).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes]
    rows = df.select(*flat)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A folder of its own below spark.checkpoint.dir, which all executors see; a temporary one where a single process runs everything."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='tidemark-')).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def to_json(facts: Any, indent: int | None = 2) -> str:
    return json.dumps(facts, indent=indent, default=str)
