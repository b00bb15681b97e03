"""Results as CSV, JSON and flat tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder below the one that driver and executors share, so that a run's tables can be dropped together; below a temporary one where all is one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return f"{folder.rstrip('/')}/wayline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that every use sees the same partitions."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def write_csv(rows: DataFrame, log: str) -> str:
    """Write rows as CSV with a header and quoted where needed, a folder per log, each file sorted by signal and time; the path."""
    path = shared_path(rows.sparkSession, "csv")
    columns = ["signal", "timestamp_us", "value", *[c for c in rows.columns if c not in ("signal", "timestamp_us", "value")]]
    rows.select(*columns).sortWithinPartitions(log, "signal", "timestamp_us").write.option("header", True).partitionBy(log).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(rows: DataFrame, log: str) -> str:
    """Write rows as JSON lines, a folder per log; the path."""
    path = shared_path(rows.sparkSession, "json")
    rows.write.partitionBy(log).json(path)
    return path


def json_safe(value: Column, kind: T.DataType, most: int) -> Column:
    """A value in which each list of more than most items gives way to a mark with its length, at any depth of structs.

    A column has one type, so a list that may be long becomes a struct of its items, null if skipped, only on the way to
    JSON text: the mark and the list are both written as text and read back by the JSON parser as a variant.
    """
    if isinstance(kind, T.StructType):
        return F.struct(*[json_safe(value[f.name], f.dataType, most).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        mark = F.to_json(F.struct(F.lit(True).alias("__skipped__"), F.size(value).alias("length")))
        return F.parse_json(F.when(F.size(value) > most, mark).otherwise(F.to_json(value)))
    return value


def flatten(results: DataFrame, column: str) -> DataFrame:
    """The scalars of a struct column, and of structs in it, as columns with dotted names; deeper ones and lists are left out."""
    out = [F.col(f"`{c}`") for c in results.columns if c != column]
    for f in results.schema[column].dataType.fields:
        if isinstance(f.dataType, T.StructType):
            inner = [g for g in f.dataType.fields if not isinstance(g.dataType, (T.StructType, T.ArrayType, T.MapType))]
            out += [F.col(column)[f.name][g.name].alias(f"{column}.{f.name}.{g.name}") for g in inner]
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.col(column)[f.name].alias(f"{column}.{f.name}"))
    return results.select(*out)
