"""Row order across a whole table without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise


def with_previous(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before, in ``order``, of the same key (null for a key's first).

    The table is range-partitioned by key and order, so rows of a busy key lie in many
    partitions; each looks back within itself, and only its first row asks the partition
    before, of which one row each is gathered.
    """
    cut = materialise(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()))
    at = F.struct(F.col(key).alias("k"), F.struct(*order).alias("o"), F.col(value).alias("v"))
    edges = sorted((r[0], r[1]) for r in cut.groupBy("_part").agg(F.max(at)).collect())
    spark = df.sparkSession
    shift = [(edges[i][0], edges[i - 1][1]) for i in range(1, len(edges))]
    ends = spark.createDataFrame(shift, f"_part int, _edge {cut.select(at.alias('e')).schema['e'].dataType.simpleString()}")
    w = Window.partitionBy("_part", key).orderBy(*order)
    got = cut.select("*", F.lag(value).over(w).alias("_lag"), F.row_number().over(w).alias("_rn")).join(F.broadcast(ends), "_part", "left")
    before = F.when((F.col("_rn") == 1) & F.col("_edge.k").eqNullSafe(F.col(key)), F.col("_edge.v")).otherwise(F.col("_lag"))
    return got.select(*df.columns, before.alias(out))


def with_number(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: each row's number from 1 in ``order`` over the whole table.

    The table is range-partitioned; a row's number is its place in its partition plus the
    rows of the partitions before, of which one count each is gathered.
    """
    cut = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in cut.groupBy("_part").count().collect()):
        before.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "_part int, _before bigint")
    w = Window.partitionBy("_part").orderBy(*order)
    got = cut.withColumn("_n", F.row_number().over(w)).join(F.broadcast(starts), "_part")
    return got.select(*df.columns, (F.col("_before") + F.col("_n")).alias(out))
