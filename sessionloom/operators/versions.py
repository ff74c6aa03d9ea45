"""Tool versions: extraction (F20) and range lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.sizes import broadcast_if_small

_VERSION = r"(\d+)\.(\d+)\.(\d+)"
MAX_TOOLS = 10_000


def extract_version(output: Column) -> Column:
    """First ``major.minor.patch`` in a text as a comparable struct; null if there is none."""
    part = lambda i: F.regexp_extract(output, _VERSION, i).try_cast("bigint")
    found = F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))
    return F.when(output.rlike(_VERSION), found)


def lookup(inventory: DataFrame, ranges: DataFrame) -> DataFrame:
    """Half-open range lookup per tool.

    ``inventory(..., tool, version)`` with a version struct; ``ranges(tool, min, max, name)`` sorted by ``min``, ``max`` null
    when open. All ranges of a tool become one array, so the join is an equi-join on the tool and every inventory row stays one
    row. ``fallback`` is ``exact``, ``newer_than_known`` (highest range used) or ``older_than_known`` (no name).
    """
    order = F.array_sort(F.collect_list(F.struct("min", "max", "name")))
    per_tool = ranges.groupBy("tool").agg(order.alias("ranges"))
    per_tool = broadcast_if_small(per_tool, MAX_TOOLS)
    v = F.col("version")
    hits = F.filter("ranges", lambda r: (v >= r["min"]) & (r["max"].isNull() | (v < r["max"])))
    older = F.col("ranges").isNull() | (v < F.element_at("ranges", 1)["min"])
    exact = F.size(hits) > 0
    return inventory.join(per_tool, "tool", "left").select(
        *inventory.columns,
        F.when(older, None).when(exact, F.element_at(hits, 1)["name"]).otherwise(F.element_at("ranges", -1)["name"]).alias("name"),
        F.when(older, "older_than_known").when(exact, "exact").otherwise("newer_than_known").alias("fallback"),
    )
