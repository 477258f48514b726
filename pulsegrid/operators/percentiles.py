"""Exact percentiles of whole numbers without collecting or sorting a group anywhere.

The built-in ``percentile`` keeps all distinct values of a group in one
buffer. Here rows are first reduced to counted values, map-side. A mergeable
quantile sketch of each group's distinct values gives ``PARTS - 1`` splitters, so
parts hold about equally many values however those are spread; running counts
over the parts name those that hold a wanted rank, and with ``cuts`` above 1 these
are split again by sketches of their own. What is left, at most two parts per
percentile of about 1 / PARTS ** cuts of a group's distinct values, is walked value
by value. The sketch only decides where to split: counts and results are exact.
Nothing is written: the counted values are one exchange, which Spark reuses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts a group is split into, a power of two, and how often that is repeated. Once leaves about a thousandth of
# the distinct values; further splits pay where a group has many billions of them.
PARTS = 1024
CUTS = 1
# Rank error of a splitter: this fraction of a part.
SHARPNESS = 4

PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def _with_wanted(level: DataFrame, group: str, order: str, *keep: str) -> DataFrame:
    """Rows of ``level`` that hold a wanted rank; ``at`` is the rank relative to the row."""
    running = level.selectExpr("*", f"sum(_n) OVER (PARTITION BY {group} ORDER BY {order}) - _n AS _before")
    inside = (
        "filter(transform(_wanted, w -> struct(w.rank AS rank, w.at - _before AS at)), "
        "w -> w.at >= 0 AND w.at < _n) AS _wanted"
    )
    return running.selectExpr("_k", order, *keep, "_total", inside).where("size(_wanted) > 0")


def value_table(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Counted values: ``_k`` (struct of the group columns), ``_v`` and ``_n``."""
    # One struct key: as a struct field a null compares equal to a null. Without groups it is always 0,
    # yet not a literal, since joins on a literal are planned without a key.
    key = F.struct(*by) if by else F.struct(F.pmod(F.col(value).cast("bigint"), F.lit(1)).alias("all"))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(key.alias("_k"), F.col(value).cast("bigint").alias("_v"))
        .agg(F.expr("count(1) AS _n"))
    )


def exact_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ps: Sequence[float] = PERCENTILES,
    unit: float = 1.0,
) -> DataFrame:
    """One row per group: ``n`` and an array ``percentiles`` in the order of ``ps``.

    ``value`` is a whole number; results interpolate linearly and are divided
    by ``unit``. Null values are left out, null groups are kept.
    """
    return percentiles_of(value_table(df, by, value), by, ps, unit)


def percentiles_of(counted: DataFrame, by: Sequence[str], ps: Sequence[float], unit: float = 1.0) -> DataFrame:
    """``exact_percentiles`` of a value table."""
    return keyed_percentiles(counted, ps, unit).select(*[F.col("_k")[b].alias(b) for b in by], "n", "percentiles")


def _splitters() -> Column:
    """Splitters of a part's distinct values, by rank."""
    sketch = F.percentile_approx("_v", [k / PARTS for k in range(1, PARTS)], PARTS * SHARPNESS)
    return F.sort_array(sketch).alias("_splits")


def first_parts(counted: DataFrame, ps: Sequence[float]) -> DataFrame:
    """Each group as one part, with its splitters, its size and the wanted ranks: _k, _part, _splits, _total, _wanted."""
    fractions = ", ".join(f"{float(p)!r}D" for p in ps)
    ranks = f"flatten(transform(array({fractions}), p -> array(floor((_total - 1) * p), ceil((_total - 1) * p))))"
    whole = counted.groupBy("_k").agg(F.expr("sum(_n) AS _total"), _splitters())
    return whole.selectExpr("_k", "0L AS _part", "_splits", "_total", f"transform(array_distinct({ranks}), r -> struct(r AS rank, r AS at)) AS _wanted")


def split_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The counted values of ``parts``, each in its smaller part: _k, _part, _v, _n, _whole (the part before), _total, _wanted."""
    placed = rows.join(parts, ["_k", "_part"]).selectExpr("*", "0 AS _at")
    step = PARTS // 2
    while step:
        # the number of splitters that are not above the value, by halving
        placed = placed.withColumn("_at", F.expr(f"_at + if(coalesce(try_element_at(_splits, _at + {step}) <= _v, false), {step}, 0)"))
        step //= 2
    return placed.selectExpr("_k", "_part AS _whole", f"_part * {PARTS} + _at AS _part", "_v", "_n", "_total", "_wanted")


def last_values(counted: DataFrame, ps: Sequence[float], cuts: int = CUTS) -> DataFrame:
    """The few counted values that hold the wanted ranks: _k, _part, _v, _n, _total, _wanted."""
    rows, parts = counted.withColumn("_part", F.lit(0).cast("bigint")), first_parts(counted, ps)
    for cut in range(cuts):
        if cut:
            parts = rows.groupBy("_k", "_part").agg(_splitters(), F.expr("first(_total) AS _total"), F.expr("first(_wanted) AS _wanted"))
        rows = rows.select("_k", "_part", "_v", "_n")
        level = split_parts(rows, parts).groupBy("_k", "_whole", "_part").agg(
            F.expr("sum(_n) AS _n"), F.expr("min(_v) AS _low"), F.expr("max(_v) AS _high"), F.expr("first(_total) AS _total"), F.expr("first(_wanted) AS _wanted")
        )
        found = _with_wanted(level, "_k, _whole", "_part", "_whole", "_low", "_high")
        inside = rows.withColumnRenamed("_part", "_whole").join(found, ["_k", "_whole"]).where("_v BETWEEN _low AND _high")
        rows = inside.select("_k", "_part", "_v", "_n", "_total", "_wanted")
        if cut + 1 < cuts:  # a small part of all is left and read three times: one exchange serves them
            rows = rows.repartition("_k", "_part")
    return rows


def keyed_percentiles(counted: DataFrame, ps: Sequence[float], unit: float = 1.0, cuts: int = CUTS) -> DataFrame:
    """Percentiles of a value table by its key ``_k``, to be joined with other aggregates of it."""
    fractions = ", ".join(f"{float(p)!r}D" for p in ps)
    found = _with_wanted(last_values(counted, ps, cuts), "_k, _part", "_v")

    # At most two values per percentile and group are left.
    per_group = (
        found.selectExpr("_k", "_total", "_v", "explode(_wanted.rank) AS _rank")
        .groupBy("_k")
        .agg(
            F.expr("first(_total) AS n"),
            F.expr("map_from_entries(collect_list(struct(_rank, CAST(_v AS DOUBLE)))) AS _at"),
        )
    )
    interpolate = (
        f"transform(array({fractions}), p -> (_at[floor((n - 1) * p)] + "
        "(_at[ceil((n - 1) * p)] - _at[floor((n - 1) * p)]) * ((n - 1) * p - floor((n - 1) * p)))"
        f" / {float(unit)!r}D) AS percentiles"
    )
    return per_group.selectExpr("_k", "n", interpolate)


def sketched_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ps: Sequence[float] = PERCENTILES,
    unit: float = 1.0,
    accuracy: int = 10_000,
) -> DataFrame:
    """Same shape from one aggregation with ``percentile_approx``; rank error 1/accuracy."""
    sketch = F.percentile_approx(F.col(value), [float(p) for p in ps], accuracy)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), sketch.alias("_p"))
        .select(*by, "n", F.transform("_p", lambda v: v / F.lit(float(unit))).alias("percentiles"))
    )


def named_percentiles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Spread the ``percentiles`` array into one column per name."""
    spread = [F.col("percentiles")[i].alias(name) for i, name in enumerate(names)]
    return df.select(*[c for c in df.columns if c != "percentiles"], *spread)
