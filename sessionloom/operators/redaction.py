"""Redaction with one path numbering over all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import redact as rd
from sessionloom.operators.sizes import broadcast_if_small
from sessionloom.session import shared_dir

# A row's own path numbers stand between these private-use characters until the numbers over all rows are known. The slash keeps
# what a later path rule sees the same as with a final name, which starts with one too.
OPENING, CLOSING = "/\ue000", "\ue001"
MARK = "/\ue000([0-9]+)\ue001"


def _fill(text: Column, value_of) -> Column:
    """``text`` with every mark replaced by ``value_of(number)``."""
    numbers = F.regexp_extract_all(text, F.lit(MARK), F.lit(1))
    value = lambda i: F.coalesce(value_of(F.get(numbers, i).cast("int")), F.lit(""))
    return F.array_join(F.transform(F.split(text, MARK), lambda piece, i: F.concat(piece, value(i))), "")


def _identities(paths: str) -> Column:
    """Paths as comparable across rows: a path around an already replaced one holds that one's text instead of its number."""
    nothing = F.array().cast("array<string>")
    nested = F.exists(paths, lambda p: F.contains(p, F.lit("\ue000")))
    resolved = F.aggregate(
        paths,
        nothing,
        lambda done, p: F.concat(
            done, F.array(_fill(p, lambda k: F.concat(F.lit("\ue002"), F.get(done, k - 1), F.lit("\ue003"))))
        ),
    )
    return F.when(nested, resolved).otherwise(F.col(paths))


def global_rank(df: DataFrame, order: str, out: str) -> DataFrame:
    """Position of each row in the order of a unique column, from one on.

    Range partitioning sorts without a single-task window: positions within a partition plus the sizes of the partitions
    before it, one row each. The ranges are checkpointed so that both uses see the same ones.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    ranged = df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(order)
    return (
        ranged.join(F.broadcast(bases), "__part")
        .withColumn(out, F.col("__base") + F.row_number().over(inside))
        .drop("__part", "__base")
    )


def redact_run(df: DataFrame, order: str, column: str) -> DataFrame:
    """Redact a text column; the k-th distinct personal path over all rows, in the order of the unique column ``order``, becomes
    number k.

    A path is counted once per row and deduplicated before it is ranked; what is joined back to a row is its list of numbers. The marked texts are stored,
    as three jobs read them and the rules are the costly part.
    """
    marked = rd.number_paths(rd.redact_secrets(df, column), column, OPENING, CLOSING)
    path = f"{shared_dir(df.sparkSession)}/redact-run-{uuid.uuid4().hex}"
    marked.write.parquet(path)
    marked = df.sparkSession.read.schema(marked.schema).parquet(path)
    uses = marked.select(order, F.posexplode(_identities("__paths")).alias("at", "path"))
    first_seen = uses.groupBy("path").agg(F.min(F.struct(order, "at")).alias("first"))
    numbers = global_rank(first_seen, "first", "number").select("path", "number")
    of_row = (
        uses.join(broadcast_if_small(numbers), "path")
        .groupBy(order)
        .agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("__numbers"))
        .select(order, F.transform("__numbers", lambda x: x["number"].cast("string")).alias("__numbers"))
    )
    final = _fill(F.col(column), lambda k: F.concat(F.lit(rd.SYNTHETIC), F.get(F.col("__numbers"), k - 1)))
    joined = marked.join(of_row, order, "left")
    text = F.when(F.col("__numbers").isNotNull(), final).otherwise(F.col(column))
    return joined.withColumn(column, text).select(*df.columns)
