"""Cohorts chosen by terms, with the defaults a report starts from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import classify


def by_terms(df: DataFrame, column: str, any_of: Sequence[str], none_of: Sequence[str] = ()) -> DataFrame:
    """Rows whose text holds one of the terms and none of the others, any case."""
    return df.where(classify.term_match(F.col(column), any_of, none_of))


def _with_default(df: DataFrame, column: str, wanted: Column, among: DataFrame | None) -> DataFrame:
    """Wanted rows; if the table has none, the rows of the smallest value.

    The test over ``among``, by default ``df``, is one aggregate row used as a
    scalar subquery.
    """
    none = ~F.coalesce(F.bool_or(wanted), F.lit(False))
    default = (among or df).agg(F.when(none, F.min(column)).alias("default")).scalar()
    return df.where(wanted | F.coalesce(F.col(column) == default, F.lit(False)))


def default_by_terms(df: DataFrame, column: str, any_of: Sequence[str], among: DataFrame | None = None) -> DataFrame:
    """Cohort a diagnosis report starts with: term matches, else the first value in sort order."""
    return _with_default(df, column, classify.term_match(F.col(column), any_of), among)


def default_by_values(df: DataFrame, column: str, preferred: Sequence[str], among: DataFrame | None = None) -> DataFrame:
    """Preferred values that occur, else the first value in sort order."""
    return _with_default(df, column, F.coalesce(F.col(column).isin(list(preferred)), F.lit(False)), among)


def last_years(df: DataFrame, ts: str, n: int = 2, among: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``n`` distinct years of ``among``, by default ``df``.

    No row lies between those years, so a plain lower bound selects them; it
    comes from a top-N over the distinct years as a scalar subquery, and Spark
    hands its value to the scan.
    """
    years = (among or df).where(F.col(ts).isNotNull()).select(F.year(ts).alias("_year")).distinct()
    newest = years.orderBy(F.desc("_year")).limit(n)
    first_day = F.make_date(F.min("_year"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return df.where(F.col(ts) >= newest.agg(first_day).scalar())


def by_defaults(
    df: DataFrame, wanted: Mapping[str, Column], ts: str | None = None, n: int = 2, among: DataFrame | None = None
) -> DataFrame:
    """Several defaults at once: per column the wanted rows, or those of the smallest value if there are
    none; and of ``ts`` the last ``n`` distinct years. All come from one aggregate row over ``among``.
    """
    whole = among or df
    found = [
        F.when(~F.coalesce(F.bool_or(test), F.lit(False)), F.min(column)).alias(column) for column, test in wanted.items()
    ]
    if ts:
        # a few dozen distinct years at most
        years = F.reverse(F.array_sort(F.collect_set(F.year(ts))))
        found.append(F.make_date(F.array_min(F.slice(years, 1, n)), F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("_from"))
    if not found:
        return df
    defaults = whole.agg(F.struct(*found).alias("defaults")).scalar()
    for column, test in wanted.items():
        df = df.where(test | F.coalesce(F.col(column) == defaults[column], F.lit(False)))
    return df.where(F.col(ts) >= defaults["_from"]) if ts else df


def contains_or_exact(df: DataFrame, column: str, include: str, exclude: str, exact: str) -> DataFrame:
    """Rows whose value holds ``include`` and not ``exclude``; if there are none, rows equal to ``exact``."""
    wanted = classify.term_match(F.col(column), [include], [exclude])
    none = df.agg(~F.coalesce(F.bool_or(wanted), F.lit(False))).scalar()
    return df.where(wanted | (none & F.coalesce(F.col(column) == exact, F.lit(False))))


def cascade(df: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """Equality filters level by level; a level set to None means all."""
    for level, value in chosen.items():
        if value is not None:
            df = df.where(F.col(level) == value)
    return df


def cascade_options(df: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """Distinct values offered at each level under the choices above it, as (level, value) rows."""
    levels = list(chosen)
    offered = None
    for i, level in enumerate(levels):
        above = {name: chosen[name] for name in levels[:i]}
        part = (
            cascade(df, above)
            .where(F.col(level).isNotNull())
            .select(F.lit(level).alias("level"), F.col(level).cast("string").alias("value"))
            .distinct()
        )
        offered = part if offered is None else offered.unionByName(part)
    return offered


def null_or_non_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a negative value in any of the columns; nulls pass.

    One comparison with the smallest value instead of one per column, since
    each mention of a derived column in a filter recomputes it.
    """
    smallest = F.least(*columns) if len(columns) > 1 else F.col(columns[0])
    return df.where(F.coalesce(smallest, F.lit(0)) >= 0)


def score_range(df: DataFrame, low: float, high: float, kind: str) -> DataFrame:
    """Scores of one finding type within closed bounds."""
    return df.where((F.col("type") == kind) & F.col("value_num").between(low, high))
