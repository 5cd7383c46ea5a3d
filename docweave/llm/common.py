"""Shared plumbing of the training-data operators: the shared folder, lineage cuts, row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.lineage import cut, shared_folder
from docweave.sources.stores import open_store as open_fs

__all__ = ["SPACE", "cut", "numbered", "open_fs", "partitions", "scratch", "shared_dir", "stored"]

#: Bytes that count as white space wherever a contract writes ``[\x20\x09-\x0D]``.
SPACE = r"[\x20\x09-\x0D]"


shared_dir = shared_folder


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again (for wide rows)."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with global row numbers from 0 in ``order``, and the row count.

    Range partitions are sorted and cut; a row's number is the rows of the
    partitions before its own plus its place there. Only one count per
    partition reaches the driver. ``df`` should be narrow.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))
    placed = ranged.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33).cast("int")
    counts = dict(placed.groupBy(part.alias("p")).count().collect())
    base, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        base.append(total)
        total += counts.get(p, 0)
    offsets = F.array(*[F.lit(b).cast("long") for b in base]) if len(base) <= 4096 else None
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    if not base:
        return placed.withColumn(name, inside).drop("__at"), 0
    if offsets is not None:
        return placed.withColumn(name, F.element_at(offsets, part + 1) + inside).drop("__at"), total
    rows = spark.createDataFrame(list(enumerate(base)), "__p int, __b long")  # one row a partition
    placed = placed.withColumn("__p", part).join(F.broadcast(rows), "__p")
    return placed.withColumn(name, F.col("__b") + inside).drop("__at", "__p", "__b"), total
