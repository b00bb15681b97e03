"""Raw record streams: start records name the entries that data records carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators import kernel as K

# The types that payloads are read as.
TYPES = ["boolean", "double", "float", "int64", "string", "raw"]


def resolve(starts: DataFrame, data: DataFrame) -> DataFrame:
    """Data records (log_id, ts_us, seq, entry_id, payload) with name and type of their entry as of then.

    starts has log_id, ts_us, seq, entry_id, name, type. An entry may be started again with another name. The first
    start of a name in a log settles its type. Data before any start of their entry are dropped.
    """
    first = starts.groupBy("log_id", "name").agg(F.min_by("type", F.struct("ts_us", "seq")).alias("type"))
    found = K.asof_backward(data, starts, ["log_id", "entry_id"], ["name"]).where("name is not null")
    return found.join(first, ["log_id", "name"])


def decode(records: DataFrame) -> DataFrame:
    """Adds kind and the payload as v_double, v_long, v_str, v_bool or, where it can't be read as its type, as bytes in v_bin."""
    known = F.create_map(*[F.lit(x) for t in TYPES for x in (t, t)], F.lit("rawBytes"), F.lit("raw"))
    struct = F.col("type").startswith("struct:") | F.col("type").startswith("structschema:")
    kind = F.coalesce(F.try_element_at(known, F.col("type")), F.when(struct, "struct").otherwise("unknown"))
    rows = records.withColumn("kind", kind)
    of = lambda kinds, value: F.when(F.col("kind").isin(kinds), value)
    payload = F.col("payload")
    rows = rows.withColumns(
        {"v_double": of(["double", "float"], payload.try_cast("double")), "v_long": of(["int64"], payload.try_cast("bigint")), "v_str": of(["string"], payload), "v_bool": of(["boolean"], payload.try_cast("boolean"))}
    )
    return rows.withColumn("v_bin", F.when(F.coalesce(F.col("v_double").isNotNull(), F.lit(False)) | F.col("v_long").isNotNull() | F.col("v_str").isNotNull() | F.col("v_bool").isNotNull(), None).otherwise(payload.cast("binary")))
