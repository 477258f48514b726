"""Scans of the flat and struct-shaped collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import clean
from pulsegrid.operators import first, joins
from pulsegrid.schemas import STATUS_CODES

BOOLEAN_FIELDS = ["flashingLights", "transportFlashingLights", "nachforderungNA"]


def mission_index(
    index: DataFrame,
    years: tuple[int, int] | None = None,
    ids: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Mission index, optionally of a year range or id set, or its newest ``limit`` rows."""
    rows = index
    if years:
        rows = rows.where(clean.within_years(F.col("missionDate"), *years))
    if ids is not None:
        rows = joins.keep_ids(rows, ids)
    return first.newest(rows, "missionDate", ["protocolId"], limit)


def protocol_details(details: DataFrame, limit: int | None = None) -> DataFrame:
    """Details with ``content_`` columns, one timestamp per status code and booleans as booleans."""
    content = details.schema["content"].dataType.fieldNames()
    flat = details.select("protocolId", *[F.col(f"content.{c}").alias(f"content_{c}") for c in content])
    statuses = {
        f"Status{code}": clean.to_status_time(
            F.col(f"content_dateStatus{code}"), F.col(f"content_timeStatus{code}")
        )
        for code in STATUS_CODES
        if f"dateStatus{code}" in content and f"timeStatus{code}" in content
    }
    flags = {f"content_{c}": clean.yes_no(F.col(f"content_{c}")) for c in BOOLEAN_FIELDS if c in content}
    typed = flat.withColumns({**statuses, **flags})
    if limit is None:
        return typed
    return first.newest(typed, "content_dateStatusAlarm", ["protocolId"], limit)


def status_times(details: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Protocol id and the named status timestamps (``Status4``, ``StatusAlarm`` ...), each text parsed once.

    What joins and shuffles above this carry is timestamps, not texts.
    """
    parsed = protocol_details(details).select("protocolId", *statuses)
    return joins.computed_once(parsed, list(statuses))


def dispatch_records(dispatch: DataFrame, district: str | None = None, limit: int | None = None) -> DataFrame:
    """Control-centre records of all districts or of one, or the newest ``limit`` of them."""
    rows = dispatch if district is None else dispatch.where(F.col("EO_LANDKREIS") == district)
    return first.newest(rows, "EINSATZBEGINN", ["EINSATZ_NR", "AUFTRAGS_NR"], limit)


def mission_table(index: DataFrame, details: DataFrame) -> DataFrame:
    """Index and details of all protocols of either side."""
    return joins.full_outer_once(index, details, by=(["missionNumber"], []))


def select_values(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose column holds one of ``values``; no values means no filter."""
    return df.where(F.col(column).isin(list(values))) if values else df
