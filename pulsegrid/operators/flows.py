"""Flow tables: pair counts, node totals, node numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKETS = 4096


def flow_counts(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rows per (source, target) pair; rows lacking either end are left out."""
    return (
        df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
        .groupBy(source, target)
        .agg(F.count(F.lit(1)).alias("count"))
    )


def node_totals(flows: DataFrame, source: str, target: str) -> DataFrame:
    """Outgoing, incoming and total count of every node of a flow table."""
    ends = F.explode(
        F.array(
            F.struct(F.col(source).alias("node"), F.col("count").alias("outgoing"), F.lit(0).cast("bigint").alias("incoming")),
            F.struct(F.col(target).alias("node"), F.lit(0).cast("bigint").alias("outgoing"), F.col("count").alias("incoming")),
        )
    )
    return (
        flows.select(ends.alias("end"))
        .groupBy("end.node")
        .agg(F.sum("end.outgoing").alias("outgoing"), F.sum("end.incoming").alias("incoming"))
        .withColumn("total", F.col("outgoing") + F.col("incoming"))
    )


def number_nodes(nodes: DataFrame, node: str = "node", index: str = "index") -> DataFrame:
    """Give each distinct node a number from 0 without gaps.

    Nodes are numbered inside hash buckets and the buckets are offset by the
    running count of at most 4096 bucket sizes, so no task sees all nodes.
    """
    bucketed = nodes.withColumn("_bucket", F.pmod(F.xxhash64(node), F.lit(BUCKETS)))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(node)) - 1
    return (
        bucketed.withColumn("_place", place)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(index, F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_place", "_offset")
    )
