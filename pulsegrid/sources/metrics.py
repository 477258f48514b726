"""Metric registry: metric name to extract, with optional scope and materialisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import session, vocab
from pulsegrid.operators import first, joins
from pulsegrid.schemas import VITAL_CODES
from pulsegrid.sources import items, reference, scans
from pulsegrid.sources.collections import Tables

METRICS: dict[str, Callable[..., DataFrame]] = {
    "Index": lambda t: scans.mission_index(t["index"]),
    "Details": lambda t: scans.protocol_details(t["details"]),
    "Freetext": lambda t: t["freetexts"],
    "ETÜ": lambda t, **o: scans.dispatch_records(t["dispatch"], **o),
    "GCS": lambda t: items.scores(t["findings"], vocab.ITEM_SCORE),
    "Schmerzen": lambda t: items.scores(t["findings"], vocab.ITEM_PAIN),
    "Neurologische_Auffälligkeiten": lambda t: items.neurological_signs(t["findings"]),
    "Pupillenstatus": lambda t: items.pupil_status(t["findings"]),
    "NACA": lambda t: items.triage_score(t["results"]),
    "Symptombeginn": lambda t: items.symptom_onset(t["results"]),
    "Reanimation": lambda t: items.resuscitations(t["results"]),
    "Reanimation_mit_targetDestination": lambda t: items.resuscitations_with_destination(t["results"], t["index"]),
    "Medikamente": lambda t, med_name=None: items.medications(t["measures"], med_name),
    "Intubation": lambda t: items.intubations(t["measures"]),
    "12-Kanal-EKG": lambda t: items.twelve_lead_ecgs(t["measures"]),
    "EVM": lambda t: items.extended_measures(t["measures"]),
    "Feiertage": lambda t: reference.holidays(t["holidays"]),
    **{code: (lambda t, code=code: items.vitals(t[f"vitals_{code}"], code)) for code in VITAL_CODES},
}

# Metrics whose limit means the newest rows: time column and tie-breakers.
NEWEST_FIRST = {
    "Details": ("content_dateStatusAlarm", ["protocolId"]),
    "ETÜ": ("EINSATZBEGINN", ["EINSATZ_NR", "AUFTRAGS_NR"]),
}


def load_metric(
    tables: Tables,
    metric: str,
    years: tuple[int, int] | None = None,
    limit: int | None = None,
    **options,
) -> DataFrame:
    """A metric by name, optionally only of protocols with a mission in a year range.

    ``limit`` caps the rows of metrics without an order and the newest rows of those with one.
    """
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    if metric == "Index":
        return scans.mission_index(tables["index"], years=years, limit=limit)
    rows = METRICS[metric](tables, **options)
    if years:
        rows = joins.keep_ids(rows, scans.mission_index(tables["index"], years=years))
    if limit is None:
        return rows
    if metric in NEWEST_FIRST:
        return first.newest(rows, *NEWEST_FIRST[metric], limit)
    return rows.limit(limit)


def materialised_metric(tables: Tables, metric: str, path: str, **options) -> DataFrame:
    """The metric written to a Parquet table at ``path`` and read back, for many readers."""
    return session.materialise(load_metric(tables, metric, **options), path)


#: Partition column of stored metrics: year of the protocol's latest mission, null without one.
YEAR = "mission_year"


def _with_year(tables: Tables, rows: DataFrame) -> DataFrame:
    index = tables["index"].where(F.col("protocolId").isNotNull())
    years = index.groupBy("protocolId").agg(F.year(F.max("missionDate")).alias(YEAR))
    return joins.left_outer(rows, years)


def store_metric(tables: Tables, metric: str, name: str, buckets: int = 64, **options) -> DataFrame:
    """The metric as table ``name`` of the session's catalog, partitioned by year and bucketed by protocol.

    Tables with equally many buckets join on the protocol without a shuffle, and a year filter reads
    that year's files only. Each year has one file a bucket.
    """
    rows = _with_year(tables, load_metric(tables, metric, **options)).repartition(buckets, "protocolId")
    writer = rows.write.format("parquet").partitionBy(YEAR).bucketBy(buckets, "protocolId").sortBy("protocolId")
    writer.mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def replace_year(tables: Tables, metric: str, name: str, year: int, **options) -> DataFrame:
    """One year of a stored metric written anew from ``tables``; the files of other years stay as they are."""
    spark: SparkSession = tables["index"].sparkSession
    stored = spark.table(name)
    rows = _with_year(tables, load_metric(tables, metric, **options)).where(F.col(YEAR) == year)
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first().data_type)
    rows = rows.repartition(buckets, "protocolId").select([c for c in stored.columns if c != YEAR])
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({YEAR} = {int(year)}) SELECT * FROM {{rows}}", rows=rows)
    return spark.table(name)
