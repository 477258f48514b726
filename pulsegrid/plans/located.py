"""Located missions: coordinates in degrees, alarm status, centre."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import classify, geo
from pulsegrid.sources import scans


def locate(
    dispatch: DataFrame,
    x: str = "EO_X_KOORD",
    y: str = "EO_Y_KOORD",
    codes: Sequence[str] | None = None,
    in_degrees: bool = False,
) -> DataFrame:
    """Records with coordinates: latitude, longitude and alarm-status group added.

    ``in_degrees`` takes x and y as longitude and latitude already; see ``coordinates_in_degrees``.
    """
    rows = scans.select_values(dispatch, "CEDUS_CODE", codes).na.drop(subset=[x, y])
    if in_degrees:
        latitude, longitude = F.col(y), F.col(x)
    else:
        latitude, longitude = geo.utm32_to_wgs84(F.col(x), F.col(y))
    return rows.withColumns(
        {
            "latitude": latitude,
            "longitude": longitude,
            "status_group": classify.alarm_status(F.col("STATUS_BEI_ALARMIERUNG")),
        }
    )


def coordinates_in_degrees(dispatch: DataFrame, x: str = "EO_X_KOORD", y: str = "EO_Y_KOORD") -> DataFrame:
    """One row: whether the coordinates look like degrees within Germany."""
    return dispatch.agg(F.coalesce(geo.looks_like_degrees(F.col(x), F.col(y)), F.lit(False)).alias("in_degrees"))


def centre(located: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return located.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"),
        F.avg("latitude").alias("center_lat"),
        F.avg("longitude").alias("center_lon"),
    )
