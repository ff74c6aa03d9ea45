"""Chains of parents (E9): the root and the depth of every record, with breaks named."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.session import shared_dir

ROOTED, ORPHANED, CYCLIC = "rooted", "orphaned", "cyclic"


def _stored(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/parent-chains-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parent_chains(records: DataFrame, scope: str, key: str, parent: str) -> DataFrame:
    """``(scope, key, root, depth, kind)`` of every record that has a key.

    By pointer doubling: a round replaces a record's pointer by that of the record it points to, so the number of rounds grows with the logarithm of the
    longest chain, and each is a join of narrow rows. ``rooted``: the chain ends at a record without a parent; ``orphaned``: it ends at one whose
    parent is not there; ``root`` is that last record. ``cyclic``: it never ends; such rows have neither root nor depth.

    A chain stays within its scope. Records that repeat a key are one. A record that is its own parent is a cycle.
    """
    nodes = records.where(F.col(key).isNotNull()).groupBy(scope, key).agg(F.min(parent).alias("__parent"))
    there = nodes.select(F.col(scope).alias("__s"), F.col(key).alias("__k"))
    linked = nodes.join(there, F.col(scope).eqNullSafe(F.col("__s")) & (F.col("__parent") == F.col("__k")), "left")
    kind = F.when(F.col("__parent").isNull(), ROOTED).when(F.col("__k").isNull(), ORPHANED)
    # A record that ends a chain points to itself; ``kind`` is set on records whose chain is known to end.
    ends = kind.isNotNull()
    start = linked.select(scope, key, F.when(ends, F.col(key)).otherwise(F.col("__k")).alias("to"), F.when(ends, 0).otherwise(1).cast("long").alias("depth"), kind.alias("kind"))
    rows = _stored(start)
    open_, longest = rows.where("kind is null").count(), 1
    total = open_ + 1
    while open_ and longest <= 2 * total:
        known = rows.select(F.col(scope).alias("__s"), F.col(key).alias("__k"), F.col("to").alias("__to"), F.col("depth").alias("__depth"), F.col("kind").alias("__kind"))
        same = F.col(scope).eqNullSafe(F.col("__s")) & (F.col("__at") == F.col("__k"))
        waiting = rows.where("kind is null").withColumnRenamed("to", "__at").join(known, same)
        moved = waiting.select(scope, key, F.col("__to").alias("to"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__kind").alias("kind"))
        rows = _stored(rows.where("kind is not null").unionByName(moved))
        open_ = rows.where("kind is null").count()
        longest *= 2
    cyclic = F.col("kind").isNull()
    return rows.select(
        scope, key, F.when(~cyclic, F.col("to")).alias("root"), F.when(~cyclic, F.col("depth")).alias("depth"), F.coalesce("kind", F.lit(CYCLIC)).alias("kind")
    )
