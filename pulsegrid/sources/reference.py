"""Reference tables: hospitals, holidays, vehicle schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import vocab


# Fixed value: the first column of the capability file.
HOSPITAL_NAME = "Name"


def read_hospitals(spark: SparkSession, path: str) -> DataFrame:
    """Capability file: ``;``-separated, first column a list of name variants in file order."""
    lines = spark.read.text(path).withColumn("row", F.monotonically_increasing_id())
    return hospital_rows(lines.where(~F.startswith("value", F.lit(f"{HOSPITAL_NAME};"))))


def hospital_rows(lines: DataFrame) -> DataFrame:
    """Rows of the capability file out of its lines (``row``, ``value``), header left out."""
    schema = ", ".join([f"`{HOSPITAL_NAME}` STRING"] + [f"`{c}` BOOLEAN" for c in vocab.CAPABILITIES])
    parsed = F.from_csv("value", schema, {"sep": ";", "quote": ""})
    rows = lines.where(F.trim("value") != "").select("row", parsed.alias("_line")).select("row", "_line.*")
    return rows.withColumn("names", F.from_json(HOSPITAL_NAME, "array<string>"))


def name_variants(hospitals: DataFrame, capabilities: list[str] = vocab.CAPABILITIES) -> DataFrame:
    """One row per lower-cased name variant: rank of its first mention, capabilities of its last.

    ``hospitals`` has ``row`` (order), ``names`` (array) and one boolean per capability.
    """
    granted = F.map_from_arrays(
        F.array(*[F.lit(c) for c in capabilities]),
        F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(False)) for c in capabilities]),
    )
    order = F.struct("row", "pos")
    return (
        hospitals.select("row", granted.alias("granted"), F.posexplode("names").alias("pos", "name"))
        .where(F.col("name").isNotNull())
        .groupBy(F.lower("name").alias("variant"))
        .agg(F.min(order).alias("rank"), F.max_by("granted", order).alias("granted"))
    )


def holidays(table: DataFrame) -> DataFrame:
    return table.select(F.col("date").cast("date").alias("date"), "name")


def mark_holidays(df: DataFrame, ts: str, table: DataFrame) -> DataFrame:
    """Add the holiday name of the row's day, null on other days."""
    days = holidays(table).groupBy("date").agg(F.min("name").alias("holiday"))
    return df.withColumn("_day", F.to_date(ts)).join(days, F.col("_day") == days["date"], "left").drop("_day", "date")


def parse_schedule(text: Column, prefix: str = "") -> Column:
    """Array of (vehicle, weekly_hours) out of ``name:hours,name:hours``; entries without colon are skipped."""
    entries = F.filter(F.split(text, ","), lambda e: F.contains(e, F.lit(":")))
    return F.transform(
        entries,
        lambda e: F.struct(
            F.concat(F.lit(prefix), F.trim(F.substring_index(e, ":", 1))).alias("vehicle"),
            F.trim(F.regexp_replace(e, r"^[^:]*:", "")).try_cast("int").alias("weekly_hours"),
        ),
    )


def schedule_table(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """One row per schedule entry of the configuration texts; a later entry of a vehicle is another row."""
    return df.select(F.inline(parse_schedule(F.col(text), prefix)))
