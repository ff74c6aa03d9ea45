"""Batch twin of the hook stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import variant as vr

_NAMED = ("transcript_path", "session_id", "cwd")


def from_bodies(requests: DataFrame) -> DataFrame:
    """``requests(tool, event, body, ts)`` to hook events; every further key of the body goes to ``extra`` as text."""
    fields = F.from_json("body", "map<string,string>")
    v = F.col("v")
    return requests.withColumn("v", vr.parse_strict(F.col("body"))).select(
        "tool",
        "event",
        *[vr.string_at(v, f".{n}").alias(n) for n in _NAMED],
        F.map_filter(fields, lambda k, _: ~k.isin(*_NAMED)).alias("extra"),
        "ts",
        "body",
    )
