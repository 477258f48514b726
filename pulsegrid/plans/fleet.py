"""Vehicle utilization, duration outliers, extended-measure comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import vocab
from pulsegrid.functions import classify, clean
from pulsegrid.operators import first, joins, percentiles, summary
from pulsegrid.sources import items, scans

DEFAULT_WEEKLY_HOURS = 168
HOUR = 3_600_000_000.0


def durations(df: DataFrame, start: str, end: str) -> DataFrame:
    """Add ``duration_micros`` and ``duration_hours``."""
    return df.withColumn("duration_micros", clean.micros_between(F.col(start), F.col(end))).withColumn(
        "duration_hours", clean.hours(F.col("duration_micros"))
    )


def group_days(spark: SparkSession, first_day: str, last_day: str) -> DataFrame:
    """Number of days of each weekday group in a date range."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day")
    )
    return days.groupBy(clean.weekday_group(F.col("day")).alias("weekday_group")).agg(F.count(F.lit(1)).alias("days"))


def _available(weekly_hours, days):
    return F.coalesce(weekly_hours, F.lit(DEFAULT_WEEKLY_HOURS)) / F.lit(7.0) * days


def utilization(
    missions: DataFrame,
    vehicle: str,
    start: str,
    end: str,
    schedule: DataFrame,
    first_day: str,
    last_day: str,
    vehicles: Sequence[str] | None = None,
) -> DataFrame:
    """Mission hours against scheduled hours per vehicle and weekday group, zero rows included.

    Vehicles are those with a row in ``missions`` (already cut to the date
    range); missions without a positive duration count neither hours nor
    missions. Vehicles without a schedule run around the clock.
    """
    rows = scans.select_values(missions, vehicle, vehicles).where(F.col(vehicle).isNotNull())
    timed = durations(rows, start, end)
    counted = F.col("duration_micros") > 0
    used = (
        timed.groupBy(F.col(vehicle).alias("vehicle"), clean.weekday_group(F.col(start)).alias("weekday_group"))
        .agg(
            # sums of microseconds outgrow 64 bits
            F.coalesce(F.sum(F.when(counted, F.col("duration_micros").cast("decimal(38,0)"))), F.lit(0)).cast("double").alias("micros"),
            F.count_if(counted).alias("missions"),
        )
    )
    grid = joins.dense_grid(
        used.select("vehicle").distinct(), {"weekday_group": clean.WEEKDAY_GROUPS}, used, ["micros", "missions"]
    )
    weekly = schedule.where(F.col("vehicle").isNotNull()).groupBy("vehicle").agg(
        F.max("weekly_hours").alias("weekly_hours")
    )
    days = group_days(missions.sparkSession, first_day, last_day)
    full = grid.join(weekly, "vehicle", "left").join(days, "weekday_group", "left")
    available = _available(F.col("weekly_hours"), F.coalesce("days", F.lit(0)))
    return full.select(
        "vehicle",
        "weekday_group",
        "missions",
        clean.hours(F.col("micros")).alias("actual_hours"),
        available.alias("available_hours"),
        summary.percent(clean.hours(F.col("micros")), available).alias("percent"),
    )


def total_utilization(by_group: DataFrame) -> DataFrame:
    """The same per vehicle over the whole range, for vehicles with a counted mission."""
    sums = by_group.groupBy("vehicle").agg(
        F.sum("missions").alias("missions"),
        F.sum("actual_hours").alias("actual_hours"),
        F.sum("available_hours").alias("available_hours"),
    )
    return sums.where(F.col("missions") > 0).withColumn(
        "percent", summary.percent(F.col("actual_hours"), F.col("available_hours"))
    )


def hour_profile(missions: DataFrame, vehicle: str, start: str, end: str) -> DataFrame:
    """Missions per vehicle and hour of day, all 24 hours."""
    timed = durations(missions, start, end).where((F.col("duration_micros") > 0) & F.col(vehicle).isNotNull())
    counts = timed.groupBy(F.col(vehicle).alias("vehicle"), F.hour(start).alias("hour")).agg(
        F.count(F.lit(1)).alias("missions")
    )
    return joins.dense_grid(counts.select("vehicle").distinct(), {"hour": list(range(24))}, counts, ["missions"])


def duration_statistics(timed: DataFrame, long_hours: float = 24) -> DataFrame:
    """Count, mean, median, maximum and minimum of positive durations in hours, and how many are very long."""
    counted = percentiles.value_table(timed.where(F.col("duration_micros") > 0), [], "duration_micros")
    total = F.sum(F.col("_v").cast("decimal(38,0)") * F.col("_n")).cast("double")
    plain = counted.groupBy("_k").agg(
        (clean.hours(total) / F.sum("_n")).alias("mean_hours"),
        clean.hours(F.max("_v")).alias("max_hours"),
        clean.hours(F.min("_v")).alias("min_hours"),
        F.sum(F.when(F.col("_v") > int(long_hours * HOUR), F.col("_n")).otherwise(0)).alias("very_long"),
    )
    both = percentiles.keyed_percentiles(counted, [0.5], HOUR).join(plain, "_k")
    median = F.col("percentiles")[0].alias("median_hours")
    return both.select("n", "mean_hours", median, "max_hours", "min_hours", "very_long")


def longest_missions(timed: DataFrame, tie: Sequence[str], n: int = 10) -> DataFrame:
    return first.largest(timed, "duration_micros", tie, n).withColumn(
        "duration_minutes", clean.minutes(F.col("duration_micros"))
    )


def vehicle_category_table(missions: DataFrame) -> DataFrame:
    """Patient-transport missions by vehicle type and mission category, with row totals."""
    rows = missions.where(classify.term_match(F.col("missionType"), ["s-ktw"]))
    typed = rows.select(
        classify.vehicle_type(F.col("callSign")).alias("vehicle_type"),
        classify.mission_category(F.col("missionType")).alias("mission_category"),
    )
    return summary.category_table(typed, "vehicle_type", "mission_category", vocab.MISSION_CATEGORIES)


def _has_measures(at_least_one: bool):
    return F.col("evmCount") > 0 if at_least_one else F.col("evmCount") >= 0


def missions_between(missions: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Missions dated, and alarmed, on the given days."""
    return missions.where(clean.within_days(F.col("missionDate"), first_day, last_day)).where(
        clean.within_days(F.col("alarmTime"), first_day, last_day)
    )


def measures_by_vehicle_type(
    missions: DataFrame,
    measures: DataFrame,
    types: Sequence[str] = ("RTW", "S-KTW"),
    n: int = 15,
    at_least_one: bool = True,
) -> DataFrame:
    """Most frequent extended measures per vehicle type, as percentage of that type's missions.

    ``missions`` is the table already cut to the date range.
    """
    typed = missions.select(
        "protocolId", "evmCount", classify.vehicle_type(F.col("callSign")).alias("vehicle_type")
    ).where(F.col("vehicle_type").isin(list(types)))
    totals = typed.groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("missions"))
    # Both sides are counted per protocol before they meet, so a protocol with
    # many items and many rows joins as counts.
    holders = (
        typed.where(_has_measures(at_least_one))
        .groupBy("protocolId", "vehicle_type")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    done = (
        items.extended_measures(measures)
        .where(F.col("description").isNotNull())
        .groupBy("protocolId", "description")
        .agg(F.count(F.lit(1)).alias("_items"))
    )
    counts = (
        done.join(holders, "protocolId")
        .groupBy("vehicle_type", "description")
        .agg(F.sum(F.col("_rows") * F.col("_items")).alias("count"))
    )
    top = summary.top_counted(counts, "vehicle_type", "description", n)
    return top.join(totals, "vehicle_type").select(
        "vehicle_type",
        "description",
        "rank",
        "count",
        summary.percent(F.col("count"), F.col("missions")).alias("percent"),
    )


def monthly_measure_rate(missions: DataFrame, at_least_one: bool = True) -> DataFrame:
    """Missions with extended measures per month and vehicle type, as percentage of all missions of the month.

    One aggregation counts both; the month totals are sums of its rows.
    """
    dated = missions.where(F.col("missionDate").isNotNull())
    counted = dated.groupBy(
        clean.month_start(F.col("missionDate")).alias("month"),
        classify.vehicle_type(F.col("callSign")).alias("vehicle_type"),
    ).agg(
        F.count_if(_has_measures(at_least_one)).alias("evm_count"),
        F.count("protocolId").alias("rows"),
    )
    totals = counted.groupBy("month").agg(F.sum("rows").alias("total_missions"))
    return (
        counted.where(F.col("evm_count") > 0)
        .join(totals, "month")
        .select(
            "month",
            clean.month_label(F.col("month")).alias("year_month"),
            clean.month_name(F.month("month")).alias("month_name"),
            "vehicle_type",
            "evm_count",
            "total_missions",
            summary.percent(F.col("evm_count"), F.col("total_missions")).alias("evm_percentage"),
        )
    )
