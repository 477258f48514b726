"""Mission mix of an address: totals, category mixes, weekly counts, weekday-hour table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import classify, clean
from pulsegrid.operators import cohort, summary

ADDRESS_LEVELS = ["patientCity", "patientStreet", "patientHouseNumber"]


def missions_at(
    index: DataFrame,
    city: str | None = None,
    street: str | None = None,
    house_number: str | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
) -> DataFrame:
    """Missions of an address with an alarm on the given days, the last day included."""
    rows = cohort.cascade(index, dict(zip(ADDRESS_LEVELS, (city, street, house_number))))
    if first_day and last_day:
        rows = rows.where(clean.within_days(F.col("alarmTime"), first_day, last_day))
    return rows


def address_options(index: DataFrame, city: str | None = None, street: str | None = None) -> DataFrame:
    return cohort.cascade_options(index, {"patientCity": city, "patientStreet": street, "patientHouseNumber": None})


def patient_transports(missions: DataFrame) -> DataFrame:
    return cohort.contains_or_exact(missions, "staticMissionType", "krankentransport", "rtw", "Krankentransport")


def type_mix(missions: DataFrame, n: int = 10) -> DataFrame:
    return summary.top_n_other(missions, "staticMissionType", n)


def diagnosis_mix(missions: DataFrame, n: int = 10) -> DataFrame:
    return summary.top_n_other(missions, "leadingDiagnosis", n)


def weekly_counts(missions: DataFrame, by: str) -> DataFrame:
    return summary.period_counts(missions, "missionDate", by, "week")


def weekday_hours(missions: DataFrame) -> DataFrame:
    return summary.weekday_hour_table(missions, "alarmTime")


def types_in_legend_order(missions: DataFrame, column: str = "missionType") -> DataFrame:
    """Distinct mission types with their legend keys and display group.

    Sort by class_rank, late, name; few rows, so the sort is the caller's.
    """
    types = missions.where(F.col(column).isNotNull()).select(column).distinct()
    key = classify.mission_sort_key(F.col(column))
    return types.select(
        F.col(column).alias("name"),
        key["class_rank"].alias("class_rank"),
        key["late"].alias("late"),
        classify.display_bucket(F.col(column)).alias("display_bucket"),
    )
