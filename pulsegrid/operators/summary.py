"""Counts, shares, pivots and top-N tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid import vocab
from pulsegrid.functions import clean


def share(flag: Column) -> Column:
    """Percentage of all rows whose flag is true."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double")) * 100


def percent(part: Column, whole: Column) -> Column:
    """Percentage, 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def with_target(df: DataFrame, target: float = 100, value: str = "percent", name: str = "to_target") -> DataFrame:
    """Add the distance of a percentage to its target, negative below it."""
    return df.withColumn(name, F.col(value) - F.lit(float(target)))


def value_counts(df: DataFrame, value: str, keep_null: bool = False, name: str = "count") -> DataFrame:
    """Rows per value; null values count only with ``keep_null``."""
    rows = df if keep_null else df.where(F.col(value).isNotNull())
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias(name))


def top_values(df: DataFrame, value: str, n: int = 10, name: str = "count") -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return value_counts(df, value, name=name).orderBy(F.col(name).desc(), value).limit(n)


def failures_first(df: DataFrame, flag: str, tie: Sequence[str]) -> DataFrame:
    """Detail rows for reading: those that miss the flag first, then by the tie-breakers."""
    return df.orderBy(F.coalesce(F.col(flag), F.lit(False)), *tie)


def top_n_other(df: DataFrame, value: str, n: int = 10, other: str = vocab.OTHER) -> DataFrame:
    """The ``n`` most frequent values and one row with the sum of all others, if there are any.

    Only the counted table is ranked, by a top-N.
    """
    counts = value_counts(df, value)
    top = counts.orderBy(F.col("count").desc(), value).limit(n)
    rest = (
        counts.join(top.select(value), value, "left_anti")
        .agg(F.sum("count").alias("count"))
        .where(F.col("count") > 0)
        .select(F.lit(other).alias(value), "count")
    )
    return top.unionByName(rest)


def top_per_group(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of each group, ties by value, with their rank."""
    counts = (
        df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return top_counted(counts, group, value, n)


def top_counted(counts: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest counts of each group of a counted table.

    Spark keeps only n rows per group and map task before the shuffle.
    """
    order = W.partitionBy(group).orderBy(F.col("count").desc(), F.col(value))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def weekday_hour_table(df: DataFrame, ts: str) -> DataFrame:
    """Row counts, one row per weekday that occurs and one column per hour, ``h00`` to ``h23``.

    Order by ``weekday_number`` (Monday is 0) for display.
    """
    when = F.col(ts)
    per_hour = [F.count_if(F.hour(when) == h).alias(f"h{h:02d}") for h in range(24)]
    return (
        df.where(when.isNotNull())
        .groupBy(clean.weekday_number(when).alias("weekday_number"), clean.weekday_name(when).alias("weekday"))
        .agg(*per_hour)
    )


def period_counts(df: DataFrame, ts: str, by: str, period: str = "week") -> DataFrame:
    """Rows per week (Monday) or month and category; rows lacking either are left out."""
    start = {"week": clean.week_start, "month": clean.month_start}[period](F.col(ts))
    return (
        df.where(F.col(ts).isNotNull() & F.col(by).isNotNull())
        .groupBy(start.alias(period), by)
        .agg(F.count(F.lit(1)).alias("counts"))
    )


def category_table(df: DataFrame, row: str, column: str, categories: Sequence[str], total: str = "Gesamt") -> DataFrame:
    """Row counts by category as columns, with a row total."""
    counts = [F.count_if(F.col(column) == c).alias(c) for c in categories]
    return df.groupBy(row).agg(*counts, F.count(F.lit(1)).alias(total))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percentage of rows with an entry, one row per column, from one pass."""
    one = df.agg(*[percent(F.count(F.col(c)), F.count(F.lit(1))).alias(c) for c in columns])
    return to_long(one, [], columns, "field", "percent")


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Unpivot; rows without a value are left out."""
    return df.unpivot(list(ids), list(columns), name, value).where(F.col(value).isNotNull())


def to_table(long: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Statistics by interval: one row per ``row`` value, one column per listed ``column`` value."""
    return long.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def yes_no_table(df: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """Category, count of ``ja``, count of ``nein`` and their sum, from one pass."""
    named = df.select([F.col(c).alias(name) for name, c in categories.items()])
    return (
        named.unpivot([], list(categories), "category", "value")
        .groupBy("category")
        .agg(
            F.count_if(F.col("value") == "ja").alias("yes"),
            F.count_if(F.col("value") == "nein").alias("no"),
        )
        .withColumn("total", F.col("yes") + F.col("no"))
    )
