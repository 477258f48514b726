"""Heavy keys of a join and the salts that spread their rows.

A key is heavy when its rows would fill two shuffle partitions or more. Heavy keys are found by a mergeable
sketch over the key column, so at most one key for every two partitions is listed, and the list may be broadcast
whatever the table's size. The list only decides how rows travel: no result depends on what the sketch finds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys a sketch lists, and counters it holds for each of them.
MOST, COUNTERS = 4096, 8
#: Salts for each partition that a key's rows would fill: several, since salts fall on partitions by chance.
SALTS = 4


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """``_heavy`` and ``_pieces``: heavy non-null keys, and over how many salts their rows should be dealt."""
    parts = partitions(df.sparkSession)
    listed = min(max(parts, 16), MOST)
    top = F.call_function("approx_top_k", F.col(key), F.lit(listed), F.lit(listed * COUNTERS))
    found = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("_rows"), top.alias("_top"))
    share = F.col("count") * F.lit(parts) / F.col("_rows")
    return (
        found.select("_rows", F.inline("_top"))
        .where(share >= 2)
        .select(F.col("item").alias("_heavy"), F.ceil(share * SALTS).cast("int").alias("_pieces"))
    )


def spot(df: DataFrame, by: Sequence[str], pieces: Column) -> Column:
    """Number below ``pieces`` for a row, from the columns ``by`` that tell rows of one key apart (none: all columns).

    It follows the row's content, so a task that runs again deals its rows as before.
    """
    names = [c for c in by if c in df.columns] or [c for c, kind in df.dtypes if "map<" not in kind]
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), pieces).cast("int")
    return F.when(pieces > 1, dealt).otherwise(0)


def every(pieces: Column) -> Column:
    """All numbers below ``pieces``, for the copies of a row."""
    return F.sequence(F.lit(0), pieces - 1)
