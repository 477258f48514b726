"""One row per key, as aggregates with map-side combine.

A window would bring all rows of a key into one task; ``min_by``/``max_by``
keep a single candidate per key and map task, so a key that owns a third of
the table costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole_row(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Row with the smallest ``order`` per non-null key; ``order`` must end in a unique column."""
    return _one_per_key(df, keys, F.min_by(_whole_row(df, keys), F.struct(*order)))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As ``first_per_key`` for wide rows; the columns ``order`` must be unique within a key.

    The smallest order per key is found first, from these columns alone; then the rows that hold it are fetched
    through hash tables of one (key, order) a key. So no wide row is sorted or kept as a candidate.
    """
    rows = df.na.drop(subset=list(keys))
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_least")).select(*keys, "_least.*")
    a, b = rows.alias("a"), least.hint("shuffle_hash").alias("b")
    same = [F.col(f"a.`{c}`") == F.col(f"b.`{c}`") for c in keys]
    same += [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in order]
    return a.join(b, reduce(and_, same), "left_semi")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Row with the largest ``order`` per non-null key, nulls counting as smallest."""
    return _one_per_key(df, keys, F.max_by(_whole_row(df, keys), F.struct(*order)))


def _one_per_key(df: DataFrame, keys: Sequence[str], chosen: Column) -> DataFrame:
    return (
        df.na.drop(subset=list(keys))
        .groupBy(*keys)
        .agg(chosen.alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def newest(df: DataFrame, ts: str, tie: Sequence[str], limit: int | None = None) -> DataFrame:
    """Newest rows first; only a given ``limit`` sorts at all, as a top-N."""
    if limit is None:
        return df
    return df.orderBy(F.col(ts).desc_nulls_last(), *tie).limit(limit)


def largest(df: DataFrame, value: str, tie: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` rows with the largest non-null value."""
    return df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), *tie).limit(n)
