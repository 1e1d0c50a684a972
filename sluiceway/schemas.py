"""Explicit schemas of every stored table; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

LOG = _struct(("offset", _L), ("raw", _S))
COMMIT = _struct(
    ("batch_id", _L), ("batch", _S), ("first_offset", _L), ("rows", _L), ("source", _S),
    ("files", T.ArrayType(_S)),
)
EVENTS = _struct(
    ("event_id", _S), ("user_id", _S), ("event_type", _S), ("timestamp", _S), ("value", _D)
)
ALERTS = _struct(
    ("txn_id", _S), ("account_id", _S), ("rule", _S), ("reason", _S), ("timestamp", _S)
)
HOLDS = _struct(("txn_id", _S), ("account_id", _S), ("timestamp", _S), ("reason", _S))
FLAGS = _struct(("account_id", _S))
REJECTS = _struct(("raw", _S), ("error", _S), ("details", T.ArrayType(_S)))
MINUTES = _struct(("minute", _L), ("count", _L), ("latest", _L), ("batch", _S))
COUNTS = _struct(("consumed", _L))
WAREHOUSE = T.StructType([*EVENTS.fields, T.StructField("event_date", T.DateType())])

EVENT_KEY = ("event_id",)
ALERT_KEY = ("txn_id", "rule")
HOLD_KEY = ("txn_id",)
FLAG_KEY = ("account_id",)


LOG_STORED = _struct(("offset", _L), ("raw", _S), ("batch_id", _S))
LOG_READ = _struct(("offset", _L), ("raw", _S), ("batch_id", _L))


def with_batch_name(schema: T.StructType, bucket: str) -> T.StructType:
    return T.StructType(
        [*schema.fields, T.StructField(bucket, T.IntegerType()), T.StructField("batch", _S)]
    )
