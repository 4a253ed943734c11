"""Schemas of events and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAP = T.MapType(T.StringType(), T.StringType())

#: An event. ts_ms: milliseconds since 1970, null if the timestamp can't be read; seq: order of arrival.
EVENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("labels", _MAP),
        T.StructField("join_keys", _MAP),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
COLUMNS = [f.name for f in EVENT.fields]


def events(df: DataFrame) -> DataFrame:
    """df with the columns of EVENT, in order; what it lacks is derived or null. Extra columns are left out."""
    from .functions.times import millis

    have = set(df.columns)
    out = []
    for f in EVENT.fields:
        if f.name in have:
            c = F.col(f.name).cast(f.dataType)
        elif f.name == "ts_ms":
            c = millis(F.col("timestamp"))
        elif f.name == "seq":
            c = F.monotonically_increasing_id()
        elif f.name == "labels":
            c = F.create_map().cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)
