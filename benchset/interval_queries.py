"""Interval reports over orders and lines and over the derived missions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchset import views as v
from benchset.cohort_queries import SQL_ORDER_LINES, order_lines
from benchset.registry import query, rounded
from pulsegrid import vocab
from pulsegrid.operators import percentiles
from pulsegrid.plans import intervals

W = v.with_ctes

SPAN = {"delivery": ("o_orderdate", "l_shipdate")}
BY = ["o_orderpriority"]
TARGET = 60 * 24 * 60

SQL_VALID = "valid AS (SELECT *, micros / 60000000.0 AS minutes FROM ol WHERE micros >= 0)"
PERCENTILES = ", ".join(
    f"round(quantile_cont({{0}}, {p}), 6) AS {n}"
    for n, p in zip(intervals.PERCENTILE_NAMES, (0.1, 0.25, 0.5, 0.75, 0.9))
)


def delivery(spark, sf) -> DataFrame:
    return intervals.interval_table(order_lines(spark, sf), SPAN)


@query(
    "interval_percentiles",
    W(SQL_ORDER_LINES, SQL_VALID)
    + f"""SELECT o_orderpriority, 'delivery' AS interval, count(*) AS n, {PERCENTILES.format('minutes')}
    FROM valid GROUP BY 1""",
)
def interval_percentiles(spark, sf):
    return rounded(intervals.percentile_table(delivery(spark, sf), ["delivery"], BY, "delivery"))


@query(
    "interval_share_target",
    W(SQL_ORDER_LINES, SQL_VALID)
    + f"""SELECT o_orderpriority, count(*) AS n, round(median(minutes), 6) AS median,
    round(median(minutes) - {TARGET}, 6) AS median_delta,
    round(avg(CASE WHEN minutes <= {TARGET} THEN 1.0 ELSE 0.0 END) * 100, 6) AS share_within FROM valid GROUP BY 1""",
)
def interval_share_target(spark, sf):
    return rounded(intervals.target_share(delivery(spark, sf), BY, "delivery", TARGET))


@query(
    "interval_monthly",
    W(SQL_ORDER_LINES, SQL_VALID)
    + """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n,
    round(quantile_cont(minutes, 0.25), 6) AS p25, round(quantile_cont(minutes, 0.5), 6) AS median,
    round(quantile_cont(minutes, 0.75), 6) AS p75 FROM valid GROUP BY 1""",
)
def interval_monthly(spark, sf):
    return rounded(intervals.monthly_trend(delivery(spark, sf), "o_orderdate", "delivery"))


# Missions and details by protocol, the default selection of a cohort, the four intervals.
SQL_MISSIONS = """mis AS (SELECT protocolId, missionType, leadingDiagnosis, missionDate, missionNumber,
    StatusAlarm, Status3, Status4, Status7, Status8 FROM idx FULL JOIN dtl USING (protocolId)),
years AS (SELECT DISTINCT year(missionDate) AS y FROM mis WHERE missionDate IS NOT NULL ORDER BY 1 DESC LIMIT 2),
chosen AS (SELECT * FROM mis WHERE missionType IN ('Pauschale RTW', 'RTW - Transport')
    AND year(missionDate) IN (SELECT y FROM years)),
iv AS (SELECT *, epoch_us(Status4) - epoch_us(StatusAlarm) AS r, epoch_us(Status7) - epoch_us(Status4) AS v,
    epoch_us(Status8) - epoch_us(Status7) AS t, epoch_us(Status8) - epoch_us(StatusAlarm) AS p FROM chosen),
ok AS (SELECT * FROM iv WHERE (r IS NULL OR r >= 0) AND (v IS NULL OR v >= 0) AND (t IS NULL OR t >= 0)
    AND p IS NOT NULL AND p >= 0),
long AS (SELECT protocolId, leadingDiagnosis, 'ReaktionsIntervall' AS interval, r / 60000000.0 AS minutes FROM ok WHERE r IS NOT NULL
    UNION ALL SELECT protocolId, leadingDiagnosis, 'VersorgungsIntervall', v / 60000000.0 FROM ok WHERE v IS NOT NULL
    UNION ALL SELECT protocolId, leadingDiagnosis, 'TransportIntervall', t / 60000000.0 FROM ok
    UNION ALL SELECT protocolId, leadingDiagnosis, 'PraehospitalIntervall', p / 60000000.0 FROM ok)"""

# The same over all mission types and years.
SQL_ALL = SQL_MISSIONS.replace(
    """SELECT * FROM mis WHERE missionType IN ('Pauschale RTW', 'RTW - Transport')
    AND year(missionDate) IN (SELECT y FROM years)""",
    "SELECT * FROM mis WHERE protocolId IN (SELECT protocolId FROM idx)",
)
EVERYTHING = {"mission_types": None, "years": None}

COHORTS = {
    "interval_polytrauma": ("polytrauma", "polytrauma"),
    "interval_stemi": ("stemi", "stemi|acs"),
    "interval_stroke": ("stroke", "schlaganfall"),
    "interval_sepsis": ("sepsis", "sepsis"),
}

for _name, (_cohort, _pattern) in COHORTS.items():

    for _suffix, _missions, _choices in (("", SQL_MISSIONS, {}), ("_all", SQL_ALL, EVERYTHING)):

        def _cohort_report(spark, sf, terms=vocab.COHORT_TERMS[_cohort], choices=_choices):
            rows = intervals.cohort_intervals(v.index(spark, sf), v.details(spark, sf), terms, **choices)
            return rounded(intervals.percentile_table(rows))

        query(
            _name + _suffix,
            W(v.SQL_INDEX, v.SQL_DETAILS, _missions)
            + f"""SELECT interval, count(*) AS n, {PERCENTILES.format('minutes')} FROM long
            WHERE regexp_matches(lower(leadingDiagnosis), '{_pattern}') GROUP BY 1""",
        )(_cohort_report)


CHOSEN = {"mission_types": ["KTW", "RTW - Transport"], "diagnoses": ["Sepsis", "Polytrauma"], "years": [1996, 1998]}


@query(
    "interval_chosen",
    W(v.SQL_INDEX, v.SQL_DETAILS, SQL_ALL)
    + f"""SELECT interval, count(*) AS n, {PERCENTILES.format('minutes')} FROM long JOIN idx USING (protocolId)
    WHERE idx.leadingDiagnosis IN ('Sepsis', 'Polytrauma') AND missionType IN ('KTW', 'RTW - Transport')
    AND year(missionDate) IN (1996, 1998) GROUP BY 1""",
)
def interval_chosen(spark, sf):
    """All three selections chosen by the reader."""
    rows = intervals.cohort_intervals(v.index(spark, sf), v.details(spark, sf), vocab.COHORT_TERMS["sepsis"], **CHOSEN)
    return rounded(intervals.percentile_table(rows))


@query(
    "interval_resuscitation",
    W(v.SQL_INDEX, v.SQL_DETAILS, v.SQL_RESULTS, SQL_MISSIONS)
    + f""", rea AS (SELECT protocolId FROM res
        WHERE (value_1 = 'NACA' AND value_2 = '6') OR (value_1 = 'Rea durchgeführt' AND value_2 = 'ja')),
    rmis AS (SELECT mis.* FROM mis JOIN rea USING (protocolId)),
    ryears AS (SELECT DISTINCT year(missionDate) AS y FROM rmis WHERE missionDate IS NOT NULL ORDER BY 1 DESC LIMIT 2),
    rp AS (SELECT protocolId, epoch_us(Status8) - epoch_us(StatusAlarm) AS p, epoch_us(Status4) - epoch_us(StatusAlarm) AS r,
        epoch_us(Status7) - epoch_us(Status4) AS v, epoch_us(Status8) - epoch_us(Status7) AS t FROM rmis
        WHERE missionType IN ('Pauschale RTW', 'RTW - Transport') AND year(missionDate) IN (SELECT y FROM ryears))
    SELECT 'PraehospitalIntervall' AS interval, count(*) AS n, {PERCENTILES.format('p / 60000000.0')} FROM rp
    WHERE p >= 0 AND (r IS NULL OR r >= 0) AND (v IS NULL OR v >= 0) AND (t IS NULL OR t >= 0) HAVING count(*) > 0""",
)
def interval_resuscitation(spark, sf):
    rows = intervals.resuscitation_intervals(v.index(spark, sf), v.details(spark, sf), v.results(spark, sf))
    return rounded(intervals.percentile_table(rows, [intervals.PREHOSPITAL]))


@query(
    "interval_resuscitation_all",
    W(v.SQL_INDEX, v.SQL_DETAILS, v.SQL_RESULTS, SQL_ALL)
    + f""", rea AS (SELECT protocolId FROM res
        WHERE (value_1 = 'NACA' AND value_2 = '6') OR (value_1 = 'Rea durchgeführt' AND value_2 = 'ja'))
    SELECT interval, count(*) AS n, {PERCENTILES.format('minutes')} FROM long JOIN rea USING (protocolId) GROUP BY 1""",
)
def interval_resuscitation_all(spark, sf):
    collections = v.index(spark, sf), v.details(spark, sf), v.results(spark, sf)
    return rounded(intervals.percentile_table(intervals.resuscitation_intervals(*collections, **EVERYTHING)))


for _suffix, _missions, _choices in (("", SQL_MISSIONS, {}), ("_all", SQL_ALL, EVERYTHING)):

    def _head_injury(spark, sf, choices=_choices):
        findings = v.findings(spark, sf, "event_id")
        rows = intervals.head_injury_intervals(v.index(spark, sf), v.details(spark, sf), findings, **choices)
        return rounded(intervals.percentile_table(rows))

    query(
        "interval_head_injury" + _suffix,
        W(v.SQL_INDEX, v.SQL_DETAILS, v.SQL_FINDINGS, _missions)
        + f"""SELECT interval, count(*) AS n, {PERCENTILES.format('minutes')} FROM long
        WHERE lower(leadingDiagnosis) LIKE '%schädel-hirn%' AND protocolId IN (SELECT CAST(event_id AS VARCHAR) FROM fnd
            WHERE description = 'GCS' AND type = 'eb_neuro' AND value_num BETWEEN 3 AND 8) GROUP BY 1""",
    )(_head_injury)


def polytrauma(spark, sf):
    """All mission types and years."""
    return intervals.cohort_intervals(v.index(spark, sf), v.details(spark, sf), vocab.COHORT_TERMS["polytrauma"], **EVERYTHING)


@query(
    "interval_long",
    W(v.SQL_INDEX, v.SQL_DETAILS, SQL_ALL)
    + """SELECT protocolId, interval, round(minutes, 6) AS minutes FROM long
    WHERE lower(leadingDiagnosis) LIKE '%polytrauma%'""",
)
def interval_long(spark, sf):
    return rounded(intervals.long_form(polytrauma(spark, sf), ["protocolId"]))


@query(
    "interval_process_shares",
    W(v.SQL_INDEX, v.SQL_DETAILS, SQL_ALL)
    + """, s AS (SELECT sum(r) AS r, sum(v) AS v, sum(t) AS t, count(*) AS n FROM ok
        WHERE r IS NOT NULL AND v IS NOT NULL AND lower(leadingDiagnosis) LIKE '%polytrauma%')
    SELECT 'ReaktionsIntervall' AS interval, round(r / 60000000.0 / n, 6) AS mean_minutes, round(r * 100.0 / (r + v + t), 6) AS share FROM s
    UNION ALL SELECT 'VersorgungsIntervall', round(v / 60000000.0 / n, 6), round(v * 100.0 / (r + v + t), 6) FROM s
    UNION ALL SELECT 'TransportIntervall', round(t / 60000000.0 / n, 6), round(t * 100.0 / (r + v + t), 6) FROM s""",
)
def interval_process_shares(spark, sf):
    return rounded(intervals.process_shares(polytrauma(spark, sf)))


@query(
    "interval_report",
    W(v.SQL_INDEX, v.SQL_DETAILS, SQL_ALL)
    + ", q AS (SELECT * FROM long WHERE lower(leadingDiagnosis) LIKE '%polytrauma%')\n"
    + " UNION ALL ".join(
        f"SELECT '{n}' AS statistic, "
        + ", ".join(
            f"round(quantile_cont(minutes, {p}) FILTER (WHERE interval = '{i}'), 1) AS {i}" for i in intervals.INTERVALS
        )
        + " FROM q"
        for n, p in zip(intervals.PERCENTILE_NAMES, (0.1, 0.25, 0.5, 0.75, 0.9))
    ),
)
def interval_report(spark, sf):
    return intervals.percentile_report(polytrauma(spark, sf))


@query(
    "interval_totals",
    W(v.SQL_INDEX, v.SQL_DETAILS, SQL_ALL)
    + """SELECT count(*) AS n, round(median(p / 60000000.0), 6) AS median, round(median(p / 60000000.0) - 60, 6) AS median_delta,
    round(avg(CASE WHEN p <= 3600000000 THEN 1.0 ELSE 0.0 END) * 100, 6) AS share_within FROM ok
    WHERE lower(leadingDiagnosis) LIKE '%polytrauma%'""",
)
def interval_totals(spark, sf):
    return rounded(intervals.target_share(polytrauma(spark, sf)))


DISCRETE = PERCENTILES.replace("quantile_cont", "quantile_disc")


@query(
    "interval_percentiles_approx",
    W(SQL_ORDER_LINES, SQL_VALID)
    + f"""SELECT o_orderpriority, 'delivery' AS interval, count(*) AS n, {DISCRETE.format('minutes')}
    FROM valid GROUP BY 1""",
)
def interval_percentiles_approx(spark, sf):
    """Sketched percentiles, fine enough to be values of the data; tests judge coarser ones by rank."""
    rows = intervals.valid(delivery(spark, sf), "delivery").withColumn("interval", F.lit("delivery"))
    table = percentiles.sketched_percentiles(rows, [*BY, "interval"], "delivery", unit=intervals.MINUTE, accuracy=1_000_000)
    return rounded(percentiles.named_percentiles(table, intervals.PERCENTILE_NAMES))


@query(
    "turn_out_interval",
    W(v.SQL_DETAILS)
    + f"""SELECT 'AusrueckIntervall' AS interval, count(*) AS n, {PERCENTILES.format('x')} FROM
    (SELECT (epoch_us(Status3) - epoch_us(StatusAlarm)) / 60000000.0 AS x FROM dtl) WHERE x >= 0""",
)
def turn_out_interval(spark, sf):
    name = "AusrueckIntervall"
    return rounded(intervals.percentile_table(intervals.turn_out(v.details(spark, sf)), [name], main=name))


@query(
    "approach_interval",
    W(v.SQL_INDEX, v.SQL_DETAILS, SQL_MISSIONS)
    + f""", f AS (SELECT * FROM mis WHERE Status4 IS NOT NULL AND missionNumber IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY missionNumber ORDER BY Status4, protocolId, Status3) = 1)
    SELECT 'AnfahrIntervall' AS interval, count(*) AS n, {PERCENTILES.format('x')} FROM
    (SELECT (epoch_us(Status4) - epoch_us(Status3)) / 60000000.0 AS x FROM f) WHERE x >= 0""",
)
def approach_interval(spark, sf):
    name = "AnfahrIntervall"
    rows = intervals.missions(v.index(spark, sf).select("protocolId", "missionNumber"), v.details(spark, sf), ["Status3", "Status4"])
    return rounded(intervals.percentile_table(intervals.approach(rows), [name], main=name))
