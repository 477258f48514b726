"""Vehicle utilization, durations, extended measures and located missions."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchset import views as v
from benchset.registry import query, rounded
from pulsegrid import vocab
from pulsegrid.functions import clean
from pulsegrid.operators import summary
from pulsegrid.plans import fleet, located
from pulsegrid.plans.intervals import missions as mission_rows
from pulsegrid.sources import scans

W = v.with_ctes

FIRST_DAY, LAST_DAY = "1996-01-01", "1999-12-31"

# Nations stand for vehicles of the schedule; some vehicles have none.
SCHEDULE_SQL = """sch AS (SELECT 'Ret SL 85-' || n_nationkey AS vehicle, n_nationkey * 10 + 40 AS weekly_hours
    FROM nation WHERE n_regionkey <> 2)"""


def schedule(spark, sf):
    return v.table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.expr("'Ret SL 85-' || n_nationkey").alias("vehicle"), F.expr("n_nationkey * 10 + 40").alias("weekly_hours")
    )


def dated_dispatch(spark, sf):
    return v.dispatch(spark, sf).where(clean.within_days(F.col("EINSATZDATUM"), FIRST_DAY, LAST_DAY))


def dispatch_utilization(spark, sf):
    return fleet.utilization(
        dated_dispatch(spark, sf), "EINSATZMITTEL", "EINSATZBEGINN", "EINSATZENDE", schedule(spark, sf), FIRST_DAY, LAST_DAY
    )


def _group(ts: str) -> str:
    return f"CASE WHEN isodow({ts}) <= 4 THEN 'Mon-Thu' WHEN isodow({ts}) = 5 THEN 'Fri' WHEN isodow({ts}) = 6 THEN 'Sat' ELSE 'Sun' END"


SQL_UTILIZATION = f"""days AS (SELECT {_group('d')} AS weekday_group, count(*) AS days
    FROM (SELECT unnest(generate_series(TIMESTAMP '{FIRST_DAY}', TIMESTAMP '{LAST_DAY}', INTERVAL 1 DAY)) AS d) GROUP BY 1),
m AS (SELECT *, epoch_us(EINSATZENDE) - epoch_us(EINSATZBEGINN) AS us, {_group('EINSATZBEGINN')} AS weekday_group FROM dsp
    WHERE EINSATZDATUM >= TIMESTAMP '{FIRST_DAY}' AND EINSATZDATUM < TIMESTAMP '{LAST_DAY}' + INTERVAL 1 DAY),
used AS (SELECT EINSATZMITTEL AS vehicle, weekday_group, count(*) AS missions, sum(us) AS us FROM m WHERE us > 0 GROUP BY 1, 2),
util AS (SELECT g.vehicle, days.weekday_group, coalesce(missions, 0) AS missions, coalesce(us, 0) / 3600000000.0 AS actual_hours,
    coalesce(weekly_hours, 168) / 7.0 * days AS available_hours
    FROM (SELECT DISTINCT EINSATZMITTEL AS vehicle FROM m) g CROSS JOIN days
    LEFT JOIN used ON used.vehicle = g.vehicle AND used.weekday_group = days.weekday_group
    LEFT JOIN sch ON sch.vehicle = g.vehicle)"""


@query(
    "fleet_utilization",
    W(v.SQL_DISPATCH, SCHEDULE_SQL, SQL_UTILIZATION)
    + """SELECT vehicle, weekday_group, missions, round(actual_hours, 6) AS actual_hours,
    round(available_hours, 6) AS available_hours, round(actual_hours * 100.0 / available_hours, 6) AS percent FROM util""",
)
def fleet_utilization(spark, sf):
    return rounded(dispatch_utilization(spark, sf))


@query(
    "fleet_utilization_total",
    W(v.SQL_DISPATCH, SCHEDULE_SQL, SQL_UTILIZATION)
    + """SELECT vehicle, CAST(sum(missions) AS BIGINT) AS missions, round(sum(actual_hours), 4) AS actual_hours,
    round(sum(available_hours), 4) AS available_hours, round(sum(actual_hours) * 100.0 / sum(available_hours), 4) AS percent
    FROM util GROUP BY vehicle HAVING sum(missions) > 0""",
)
def fleet_utilization_total(spark, sf):
    return rounded(fleet.total_utilization(dispatch_utilization(spark, sf)), 4)


SQL_PROTOCOL_MISSIONS = """pm AS (SELECT idx.protocolId, callSign, missionType, missionDate, alarmTime, evmCount, StatusAlarm, StatusEnd,
    epoch_us(StatusEnd) - epoch_us(StatusAlarm) AS us FROM idx FULL JOIN dtl USING (protocolId))"""


@query(
    "fleet_utilization_protocols",
    W(v.SQL_INDEX, v.SQL_DETAILS, SQL_PROTOCOL_MISSIONS)
    + f"""SELECT callSign AS vehicle, weekday_group, CAST(coalesce(n, 0) AS BIGINT) AS missions,
    round(coalesce(us, 0) / 3600000000.0, 6) AS actual_hours
    FROM (SELECT DISTINCT callSign FROM pm WHERE callSign IN ('12-83-1', '12-85-1', '12-85-2')
        AND missionDate >= TIMESTAMP '{FIRST_DAY}' AND missionDate < TIMESTAMP '{LAST_DAY}' + INTERVAL 1 DAY)
    CROSS JOIN (VALUES ('Mon-Thu'), ('Fri'), ('Sat'), ('Sun')) g(weekday_group)
    LEFT JOIN (SELECT callSign, {_group('StatusAlarm')} AS weekday_group, count(*) AS n, sum(us) AS us FROM pm
        WHERE us > 0 AND missionDate >= TIMESTAMP '{FIRST_DAY}' AND missionDate < TIMESTAMP '{LAST_DAY}' + INTERVAL 1 DAY
        GROUP BY 1, 2) USING (callSign, weekday_group)""",
)
def fleet_utilization_protocols(spark, sf):
    index = v.index(spark, sf).where(clean.within_days(F.col("missionDate"), FIRST_DAY, LAST_DAY))
    rows = mission_rows(index, v.details(spark, sf), ["StatusAlarm", "StatusEnd"]).where(F.col("missionDate").isNotNull())
    table = fleet.utilization(
        rows, "callSign", "StatusAlarm", "StatusEnd", schedule(spark, sf), FIRST_DAY, LAST_DAY, ["12-83-1", "12-85-1", "12-85-2"]
    )
    return rounded(table.select("vehicle", "weekday_group", "missions", "actual_hours"))


@query(
    "fleet_hour_profile",
    W(v.SQL_DISPATCH)
    + """, m AS (SELECT EINSATZMITTEL AS vehicle, CAST(hour(EINSATZBEGINN) AS INTEGER) AS hour, count(*) AS missions FROM dsp
        WHERE EINSATZENDE > EINSATZBEGINN GROUP BY 1, 2)
    SELECT g.vehicle, CAST(h.hour AS INTEGER) AS hour, coalesce(missions, 0) AS missions FROM (SELECT DISTINCT vehicle FROM m) g
    CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN m ON m.vehicle = g.vehicle AND m.hour = h.hour""",
)
def fleet_hour_profile(spark, sf):
    return fleet.hour_profile(v.dispatch(spark, sf), "EINSATZMITTEL", "EINSATZBEGINN", "EINSATZENDE")


@query(
    "event_utilization",
    f"""WITH m AS (SELECT event_type AS vehicle, {_group('ts')} AS weekday_group, count(*) AS missions,
        sum(CAST(round(value * 3600000000) AS BIGINT)) AS us FROM events WHERE value > 0 GROUP BY 1, 2)
    SELECT vehicle, weekday_group, missions, round(us / 3600000000.0, 6) AS actual_hours,
    round(us / 3600000000.0 * 100.0 / (168 / 7.0 * d.days), 6) AS percent
    FROM m JOIN (VALUES ('Mon-Thu', 19), ('Fri', 4), ('Sat', 4), ('Sun', 4)) d(weekday_group, days) USING (weekday_group)""",
)
def event_utilization(spark, sf):
    """Event types as vehicles, values as hours, no schedule: around the clock in January 2024."""
    seconds = F.round(F.col("value") * 3600, 6).cast("decimal(18,6)")
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    rows = v.table(spark, sf, "events").withColumn("end", end)
    table = fleet.utilization(
        rows, "event_type", "ts", "end", schedule(spark, sf), "2024-01-01", "2024-01-31"
    )
    return rounded(table.select("vehicle", "weekday_group", "missions", "actual_hours", "percent"))


@query(
    "duration_outliers",
    W(v.SQL_DETAILS)
    + """, d AS (SELECT epoch_us(StatusEnd) - epoch_us(StatusAlarm) AS us FROM dtl)
    SELECT count(*) AS n, round(avg(us) / 3600000000.0, 6) AS mean_hours, round(median(us / 3600000000.0), 6) AS median_hours,
    round(max(us) / 3600000000.0, 6) AS max_hours, round(min(us) / 3600000000.0, 6) AS min_hours,
    count(*) FILTER (WHERE us > 86400000000) AS very_long FROM d WHERE us > 0""",
)
def duration_outliers(spark, sf):
    details = scans.status_times(v.details(spark, sf), ["StatusAlarm", "StatusEnd"])
    return rounded(fleet.duration_statistics(fleet.durations(details, "StatusAlarm", "StatusEnd")))


@query(
    "longest_missions",
    W(v.SQL_DISPATCH)
    + """SELECT AUFTRAGS_NR, EINSATZMITTEL, round((epoch_us(EINSATZENDE) - epoch_us(EINSATZBEGINN)) / 3600000000.0, 6) AS duration_hours,
    round((epoch_us(EINSATZENDE) - epoch_us(EINSATZBEGINN)) / 60000000.0, 6) AS duration_minutes FROM dsp
    ORDER BY epoch_us(EINSATZENDE) - epoch_us(EINSATZBEGINN) DESC, AUFTRAGS_NR, EINSATZMITTEL LIMIT 10""",
)
def longest_missions(spark, sf):
    timed = fleet.durations(v.dispatch(spark, sf), "EINSATZBEGINN", "EINSATZENDE")
    rows = fleet.longest_missions(timed, ["AUFTRAGS_NR", "EINSATZMITTEL"])
    return rounded(rows.select("AUFTRAGS_NR", "EINSATZMITTEL", "duration_hours", "duration_minutes"))


_VEHICLE_TYPE = """CASE WHEN callSign IS NULL THEN 'Unbekannt' WHEN callSign LIKE '%-83-%' THEN 'RTW'
    WHEN callSign LIKE '%-85-1%' THEN 'S-KTW' ELSE callSign END"""


@query(
    "type_category_pivot",
    W(v.SQL_INDEX)
    + f""", t AS (SELECT {_VEHICLE_TYPE} AS vehicle_type, CASE WHEN lower(missionType) LIKE '%s-ktw - transport%' THEN 1
        WHEN lower(missionType) LIKE '%s-ktw - kein transport%' OR lower(missionType) LIKE '%kein-transport%' THEN 2 ELSE 3 END AS c
        FROM idx WHERE lower(missionType) LIKE '%s-ktw%')
    SELECT vehicle_type, count(*) FILTER (WHERE c = 1) AS "{vocab.MISSION_CATEGORIES[0]}",
    count(*) FILTER (WHERE c = 2) AS "{vocab.MISSION_CATEGORIES[1]}", count(*) FILTER (WHERE c = 3) AS "{vocab.MISSION_CATEGORIES[2]}",
    count(*) AS Gesamt FROM t GROUP BY 1""",
)
def type_category_pivot(spark, sf):
    return fleet.vehicle_category_table(v.index(spark, sf))


@query(
    "measure_top_by_type",
    W(v.SQL_INDEX, v.SQL_MEASURES)
    + f""", i AS (SELECT protocolId, evmCount, {_VEHICLE_TYPE} AS vehicle_type FROM idx
        WHERE missionDate >= TIMESTAMP '1996-01-01' AND missionDate < TIMESTAMP '2000-01-01'
        AND alarmTime >= TIMESTAMP '1996-01-01' AND alarmTime < TIMESTAMP '2000-01-01'),
    tot AS (SELECT vehicle_type, count(*) AS missions FROM i WHERE vehicle_type IN ('RTW', 'S-KTW') GROUP BY 1),
    c AS (SELECT vehicle_type, value_2 AS description, count(*) AS count FROM mea JOIN i USING (protocolId)
        WHERE value_11 = 'EVM' AND evmCount > 0 AND vehicle_type IN ('RTW', 'S-KTW') GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY vehicle_type ORDER BY count DESC, description) AS rank FROM c)
    SELECT vehicle_type, description, CAST(rank AS INTEGER) AS rank, count, round(count * 100.0 / missions, 6) AS percent
    FROM r JOIN tot USING (vehicle_type) WHERE rank <= 15""",
)
def measure_top_by_type(spark, sf):
    missions = fleet.missions_between(v.index(spark, sf), FIRST_DAY, LAST_DAY)
    return rounded(fleet.measures_by_vehicle_type(missions, v.measures(spark, sf)))


@query(
    "part_top_by_type",
    """WITH c AS (SELECT p_type, p_brand, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT p_type, p_brand, count, CAST(row_number() OVER (PARTITION BY p_type ORDER BY count DESC, p_brand) AS INTEGER) AS rank
    FROM c QUALIFY rank <= 5""",
)
def part_top_by_type(spark, sf):
    lines, parts = v.table(spark, sf, "lineitem"), v.table(spark, sf, "part")
    return summary.top_per_group(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "p_type", "p_brand", 5)


@query(
    "measure_monthly_rate",
    W(v.SQL_INDEX)
    + f""", t AS (SELECT date_trunc('month', missionDate) AS m, count(protocolId) AS total_missions FROM idx GROUP BY 1),
    e AS (SELECT date_trunc('month', missionDate) AS m, {_VEHICLE_TYPE} AS vehicle_type, count(*) AS evm_count FROM idx
        WHERE evmCount > 0 GROUP BY 1, 2)
    SELECT CAST(m AS TIMESTAMP) AS month, strftime(m, '%Y-%m') AS year_month,
    list_extract(['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober',
        'November', 'Dezember'], CAST(month(m) AS INTEGER)) AS month_name, vehicle_type, evm_count, total_missions,
    round(evm_count * 100.0 / total_missions, 6) AS evm_percentage FROM e JOIN t USING (m)""",
)
def measure_monthly_rate(spark, sf):
    return rounded(fleet.monthly_measure_rate(v.index(spark, sf)))


# The inverse projection once more, on the SQL side, from the same published constants.
def _sql_geo() -> str:
    from pulsegrid.functions import geo

    k = geo.SCALE * geo.RECTIFYING_RADIUS
    xi, eta = f"(EO_Y_KOORD / {k!r}::DOUBLE)", f"((EO_X_KOORD - 500000) / {k!r}::DOUBLE)"
    north = " ".join(
        f"- {b!r}::DOUBLE * sin({2 * j} * {xi}) * ((exp({2 * j} * {eta}) + exp(-{2 * j} * {eta})) / 2)"
        for j, b in enumerate(geo.BETA, start=1)
    )
    east = " ".join(
        f"- {b!r}::DOUBLE * cos({2 * j} * {xi}) * ((exp({2 * j} * {eta}) - exp(-{2 * j} * {eta})) / 2)"
        for j, b in enumerate(geo.BETA, start=1)
    )
    delta = " ".join(f"+ {d!r}::DOUBLE * sin({2 * j} * chi)" for j, d in enumerate(geo.DELTA, start=1))
    return f"""g1 AS (SELECT *, {xi} {north} AS x2, {eta} {east} AS e2 FROM dsp
        WHERE EO_X_KOORD IS NOT NULL AND EO_Y_KOORD IS NOT NULL),
    g2 AS (SELECT *, asin(sin(x2) / ((exp(e2) + exp(-e2)) / 2)) AS chi FROM g1),
    geo AS (SELECT *, degrees(chi {delta}) AS latitude,
        9.0 + degrees(atan2((exp(e2) - exp(-e2)) / 2, cos(x2))) AS longitude,
        CASE STATUS_BEI_ALARMIERUNG WHEN '1 Einsatzbereit Funk' THEN 'on_radio' WHEN '2 Einsatzbereit Wache' THEN 'at_station'
            ELSE 'other' END AS status_group FROM g2)"""


@query(
    "located_rows",
    W(v.SQL_DISPATCH, _sql_geo())
    + """SELECT AUFTRAGS_NR, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, status_group FROM geo
    WHERE CEDUS_CODE IN ('AF1', 'NO2', 'RF3')""",
)
def located_rows(spark, sf):
    rows = located.locate(v.dispatch(spark, sf), codes=["AF1", "NO2", "RF3"])
    return rounded(rows.select("AUFTRAGS_NR", "latitude", "longitude", "status_group"))


@query(
    "located_centre",
    W(v.SQL_DISPATCH, _sql_geo())
    + """SELECT EINSATZMITTEL, count(*) AS points, round(avg(latitude), 6) AS center_lat, round(avg(longitude), 6) AS center_lon
    FROM geo GROUP BY 1""",
)
def located_centre(spark, sf):
    return rounded(located.centre(located.locate(v.dispatch(spark, sf)), ["EINSATZMITTEL"]))


@query(
    "coordinates_in_degrees",
    W(v.SQL_DISPATCH)
    + """SELECT bool_or(EO_Y_KOORD BETWEEN 47 AND 55) AND bool_or(EO_X_KOORD BETWEEN 5 AND 16) AS in_degrees FROM dsp
    UNION ALL SELECT bool_or(c_nationkey + 40 BETWEEN 47 AND 55) AND bool_or(c_nationkey BETWEEN 5 AND 16) FROM customer""",
)
def coordinates_in_degrees(spark, sf):
    customers = v.table(spark, sf, "customer").selectExpr("c_nationkey AS x", "c_nationkey + 40 AS y")
    return located.coordinates_in_degrees(v.dispatch(spark, sf)).union(
        located.coordinates_in_degrees(customers, "x", "y")
    )
