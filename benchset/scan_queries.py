"""Scans, item extracts, the metric registry and reference tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from benchset import views as v
from benchset.registry import query, rounded
from pulsegrid import vocab
from pulsegrid.functions import clean
from pulsegrid.operators import first, joins
from pulsegrid.session import shared_dir
from pulsegrid.sources import items, metrics, reference, scans
from pulsegrid.sources.collections import conform

W = v.with_ctes


@query(
    "index_year_newest",
    W(v.SQL_INDEX)
    + """SELECT protocolId, missionDate, missionType, leadingDiagnosis FROM idx
    WHERE missionDate >= TIMESTAMP '1997-01-01' AND missionDate < TIMESTAMP '1999-01-01'
    ORDER BY missionDate DESC, protocolId LIMIT 500""",
)
def index_year_newest(spark, sf):
    rows = scans.mission_index(v.index(spark, sf), years=(1997, 1998), limit=500)
    return rows.select("protocolId", "missionDate", "missionType", "leadingDiagnosis")


@query(
    "index_of_ids",
    W(v.SQL_INDEX)
    + """SELECT protocolId, missionNumber, alarmTime, callSign FROM idx
    WHERE protocolId IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)""",
)
def index_of_ids(spark, sf):
    ids = v.freetexts(spark, sf).select("protocolId")
    rows = scans.mission_index(v.index(spark, sf), ids=ids)
    return rows.select("protocolId", "missionNumber", "alarmTime", "callSign")


@query(
    "details_status_ts",
    W(v.SQL_DETAILS)
    + """SELECT protocolId, StatusAlarm, Status3, Status4, Status7, Status8, StatusEnd,
    flashingLights AS content_flashingLights, transportFlashingLights AS content_transportFlashingLights FROM dtl""",
)
def details_status_ts(spark, sf):
    return scans.protocol_details(v.details(spark, sf)).select(
        "protocolId", "StatusAlarm", "Status3", "Status4", "Status7", "Status8", "StatusEnd",
        "content_flashingLights", "content_transportFlashingLights",
    )


@query(
    "metric_extract",
    W(v.SQL_FINDINGS)
    + """SELECT protocolId, description AS metric, value_num, type, timestamp, source,
    'protocols_findings' AS collection FROM fnd WHERE description IN ('GCS', 'Schmerzen', 'Auffälligkeiten')""",
)
def metric_extract(spark, sf):
    findings = v.findings(spark, sf)
    return (
        items.scores(findings, "GCS")
        .unionByName(items.scores(findings, "Schmerzen"))
        .unionByName(items.neurological_signs(findings))
    )


@query(
    "triage_extract",
    W(v.SQL_RESULTS)
    + """SELECT protocolId, 'NACA' AS metric, value_2 AS "NACA-Score", 'tablet' AS source,
    'protocols_results' AS collection FROM res WHERE value_1 = 'NACA'""",
)
def triage_extract(spark, sf):
    return items.triage_score(v.results(spark, sf))


@query(
    "vitals_extract",
    W(v.SQL_VITALS)
    + """SELECT protocolId, metric, value, unit, CAST(NULL AS VARCHAR) AS o2Administration, description,
    timestamp, source, 'vitals_' || metric AS collection FROM vit""",
)
def vitals_extract(spark, sf):
    parts = [items.vitals(v.vitals(spark, sf, code), code) for code in v.VITAL_EVENTS]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@query(
    "medication_regex",
    W(v.SQL_MEASURES)
    + """SELECT protocolId, 'Medikamente' AS metric, value_2 AS med_name, value_3 AS route, dose,
    'mg' AS dose_unit, value_6 AS substance, timestamp, 'monitor' AS source, 'protocols_measures' AS collection
    FROM mea WHERE value_1 = 'Medikamente'
    AND (regexp_matches(lower(value_2), 'ring|#1[0-4]$') OR regexp_matches(lower(value_6), 'ring|#1[0-4]$'))""",
)
def medication_regex(spark, sf):
    return items.medications(v.measures(spark, sf), "RING|#1[0-4]$")


@query(
    "airway_extract",
    W(v.SQL_MEASURES)
    + """SELECT protocolId, 'Intubation' AS metric, value_3 AS type, value_4 AS size, value_8 AS applicant, timestamp,
    'monitor' AS source, 'protocols_measures' AS collection
    FROM mea WHERE value_1 = 'Atemweg' AND value_2 = 'Intubation' AND value_3 IS NOT NULL""",
)
def airway_extract(spark, sf):
    return items.intubations(v.measures(spark, sf))


@query(
    "ecg_extract",
    W(v.SQL_MEASURES)
    + """SELECT protocolId, '12-Kanal-EKG' AS metric, true AS performed, value_3 AS result, timestamp,
    'monitor' AS source, 'protocols_measures' AS collection
    FROM mea WHERE value_1 = 'Monitoring' AND value_2 = '12-Kanal-EKG'""",
)
def ecg_extract(spark, sf):
    return items.twelve_lead_ecgs(v.measures(spark, sf))


@query(
    "extended_measure_extract",
    W(v.SQL_MEASURES)
    + """SELECT protocolId, 'EVM' AS metric, value_1 AS type, value_2 AS description, value_10 AS applicant, timestamp,
    'monitor' AS source, 'protocols_measures' AS collection FROM mea WHERE value_11 = 'EVM'""",
)
def extended_measure_extract(spark, sf):
    return items.extended_measures(v.measures(spark, sf))


@query(
    "freetext_scan",
    W(v.SQL_TEXTS)
    + """SELECT protocolId, description, content FROM txt
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Übergabe', lang FROM documents""",
)
def freetext_scan(spark, sf):
    return items.texts(v.freetexts(spark, sf)).select("protocolId", "description", "content")


@query(
    "pair_first_full_outer",
    W(v.SQL_FINDINGS)
    + """, l AS (SELECT protocolId, arg_min(valueString, event_id) AS left_reaction,
        arg_min(timestamp, event_id) AS timestamp, min(event_id) AS e
        FROM fnd WHERE description = 'Lichtreaktion links' GROUP BY protocolId),
    r AS (SELECT protocolId, arg_min(valueString, event_id) AS right_reaction
        FROM fnd WHERE description = 'Lichtreaktion rechts' GROUP BY protocolId)
    SELECT protocolId, 'Pupillenstatus' AS metric, left_reaction, right_reaction, timestamp,
        CASE WHEN e IS NOT NULL THEN 'monitor' END AS source, 'protocols_findings' AS collection
    FROM l FULL JOIN r USING (protocolId)""",
)
def pair_first_full_outer(spark, sf):
    return items.pupil_status(v.findings(spark, sf))


@query(
    "onset_last_value",
    W(v.SQL_RESULTS)
    + """, o AS (SELECT protocolId,
        arg_max(value_2, event_id) FILTER (WHERE is_date) AS date,
        arg_max(value_2, event_id) FILTER (WHERE NOT is_date AND value_2 LIKE '%:%') AS time,
        arg_max(value_2, event_id) FILTER (WHERE NOT is_date AND value_2 NOT LIKE '%:%' AND value_2 <> '') AS other,
        arg_max(item_source, event_id) AS osource,
        arg_max(timestamp, event_id) FILTER (WHERE timestamp IS NOT NULL) AS ots
        FROM (SELECT *, regexp_matches(value_2, '[0-9]+[.][0-9]+[.][0-9]+') AS is_date FROM res)
        WHERE value_1 = 'Symptombeginn' GROUP BY protocolId),
    s AS (SELECT protocolId, max(event_id) AS e FROM res
        WHERE value_1 = 'Spezifikation Symptombeginn' AND value_2 <> '' GROUP BY protocolId),
    sp AS (SELECT res.protocolId, value_2, timestamp, item_source FROM s JOIN res ON res.event_id = s.e)
    SELECT protocolId, 'Symptombeginn' AS metric,
        CASE WHEN date IS NOT NULL AND time IS NOT NULL THEN date || ' ' || time ELSE coalesce(date, time, other) END AS onset_time,
        date, time, sp.value_2 AS specification, coalesce(ots, sp.timestamp) AS timestamp,
        coalesce(osource, sp.item_source) AS source, 'protocols_results' AS collection
    FROM o FULL JOIN sp USING (protocolId)""",
)
def onset_last_value(spark, sf):
    return items.symptom_onset(v.results(spark, sf))


@query(
    "flagged_union",
    W(v.SQL_RESULTS)
    + """SELECT protocolId, 'Reanimation' AS metric, true AS rea_status, 'NACA 6' AS source_metric, timestamp,
        'tablet' AS source, 'protocols_results' AS collection FROM res WHERE value_1 = 'NACA' AND value_2 = '6'
    UNION ALL
    SELECT protocolId, 'Reanimation', value_2 = 'ja', 'Reanimation field', timestamp, 'tablet', 'protocols_results'
    FROM res WHERE value_1 = 'Rea durchgeführt'""",
)
def flagged_union(spark, sf):
    return items.resuscitations(v.results(spark, sf))


SQL_LATEST_RESUSCITATION = """rea AS (SELECT event_id, protocolId, true AS rea_status, timestamp,
        CASE WHEN value_1 = 'NACA' THEN 'NACA 6' ELSE 'Reanimation field' END AS source_metric
        FROM res WHERE (value_1 = 'NACA' AND value_2 = '6') OR (value_1 = 'Rea durchgeführt' AND value_2 = 'ja')),
    latest AS (SELECT * FROM rea QUALIFY row_number() OVER
        (PARTITION BY protocolId ORDER BY timestamp DESC NULLS LAST, source_metric DESC) = 1)"""


@query(
    "latest_per_key_left_join",
    W(v.SQL_RESULTS, v.SQL_INDEX, SQL_LATEST_RESUSCITATION)
    + """SELECT protocolId, 'Reanimation' AS metric, rea_status, source_metric, timestamp, 'tablet' AS source,
    'protocols_results' AS collection, targetDestination FROM latest LEFT JOIN idx USING (protocolId)""",
)
def latest_per_key_left_join(spark, sf):
    return items.resuscitations_with_destination(v.results(spark, sf), v.index(spark, sf))


@query(
    "latest_line_per_order",
    """SELECT l_orderkey, l_shipdate, l_partkey, l_suppkey, l_linenumber FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) = 1""",
)
def latest_line_per_order(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    return first.latest_per_key(lines, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"])


@query(
    "year_scoped_metric",
    W(v.SQL_MEASURES, v.SQL_INDEX)
    + """SELECT protocolId, value_2 AS med_name, dose, value_6 AS substance FROM mea
    WHERE value_1 = 'Medikamente' AND protocolId IN (SELECT protocolId FROM idx
        WHERE missionDate >= TIMESTAMP '1998-01-01' AND missionDate < TIMESTAMP '2000-01-01')""",
)
def year_scoped_metric(spark, sf):
    tables = {"measures": v.measures(spark, sf), "index": v.index(spark, sf)}
    rows = metrics.load_metric(tables, "Medikamente", years=(1998, 1999))
    return rows.select("protocolId", "med_name", "dose", "substance")


@query(
    "metric_registry",
    W(v.SQL_INDEX, v.SQL_FINDINGS, v.SQL_RESULTS, v.SQL_MEASURES, v.SQL_DISPATCH, v.SQL_DETAILS, v.SQL_VITALS)
    + """SELECT 'Index' AS metric, count(*) AS n FROM idx UNION ALL SELECT 'Details', count(*) FROM dtl
    UNION ALL SELECT 'Freetext', count(*) FROM documents
    UNION ALL SELECT 'ETÜ', count(*) FROM dsp
    UNION ALL SELECT 'Pupillenstatus', count(DISTINCT protocolId) FROM fnd WHERE description LIKE 'Lichtreaktion%'
    UNION ALL SELECT 'Symptombeginn', count(DISTINCT protocolId) FROM res
        WHERE value_1 = 'Symptombeginn' OR (value_1 = 'Spezifikation Symptombeginn' AND value_2 <> '')
    UNION ALL SELECT 'Reanimation', count(*) FROM res WHERE (value_1 = 'NACA' AND value_2 = '6') OR value_1 = 'Rea durchgeführt'
    UNION ALL SELECT 'Reanimation_mit_targetDestination', count(DISTINCT protocolId) FROM res
        WHERE (value_1 = 'NACA' AND value_2 = '6') OR (value_1 = 'Rea durchgeführt' AND value_2 = 'ja')
    UNION ALL SELECT 'Intubation', count(*) FROM mea WHERE value_1 = 'Atemweg' AND value_2 = 'Intubation' AND value_3 IS NOT NULL
    UNION ALL SELECT '12-Kanal-EKG', count(*) FROM mea WHERE value_1 = 'Monitoring' AND value_2 = '12-Kanal-EKG'
    UNION ALL SELECT 'Feiertage', count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders
    UNION ALL SELECT 'GCS', count(*) FROM fnd WHERE description = 'GCS'
    UNION ALL SELECT 'Schmerzen', count(*) FROM fnd WHERE description = 'Schmerzen'
    UNION ALL SELECT 'Neurologische_Auffälligkeiten', count(*) FROM fnd WHERE description = 'Auffälligkeiten'
    UNION ALL SELECT 'NACA', count(*) FROM res WHERE value_1 = 'NACA'
    UNION ALL SELECT 'Medikamente', count(*) FROM mea WHERE value_1 = 'Medikamente'
    UNION ALL SELECT 'EVM', count(*) FROM mea WHERE value_11 = 'EVM'
    UNION ALL SELECT metric, count(*) FROM vit GROUP BY 1""",
)
def metric_registry(spark, sf):
    """Rows of all 27 metrics."""
    tables = v.collections(spark, sf)
    counts = None
    for name in metrics.METRICS:
        part = metrics.load_metric(tables, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query(
    "dispatch_region_newest",
    W(v.SQL_DISPATCH)
    + """SELECT EINSATZ_NR, AUFTRAGS_NR, EO_LANDKREIS, EINSATZBEGINN, EINSATZMITTEL FROM dsp
    WHERE EO_LANDKREIS = 'Schleswig-Flensburg' ORDER BY EINSATZBEGINN DESC, EINSATZ_NR, AUFTRAGS_NR LIMIT 1000""",
)
def dispatch_region_newest(spark, sf):
    rows = scans.dispatch_records(v.dispatch(spark, sf), vocab.DISTRICT, limit=1000)
    return rows.select("EINSATZ_NR", "AUFTRAGS_NR", "EO_LANDKREIS", "EINSATZBEGINN", "EINSATZMITTEL")


@query(
    "dispatch_all_districts",
    W(v.SQL_DISPATCH) + "SELECT EO_LANDKREIS, count(*) AS n, count(DISTINCT EINSATZ_NR) AS missions FROM dsp GROUP BY 1",
)
def dispatch_all_districts(spark, sf):
    rows = scans.dispatch_records(v.dispatch(spark, sf))
    return rows.groupBy("EO_LANDKREIS").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("EINSATZ_NR").alias("missions"))


@query(
    "metric_row_cap",
    W(v.SQL_FINDINGS) + "SELECT least(count(*), 100) AS n FROM fnd WHERE description = 'GCS'",
)
def metric_row_cap(spark, sf):
    """A row cap the caller asks for; which rows is left open, so only their number is told."""
    rows = metrics.load_metric({"findings": v.findings(spark, sf)}, "GCS", limit=100)
    return rows.agg(F.count(F.lit(1)).alias("n"))


_NAMES = """'["' || {n} || '", " KH ' || {n} || ' "]'"""
_FLAGS = ["s_suppkey % 2 = 0", "s_suppkey % 3 = 0", "s_suppkey % 5 = 0", "s_nationkey > 12"]


@query(
    "hospital_file_rows",
    f"""SELECT lower(name) AS variant, {", ".join(f"{flag} AS c{k}" for k, flag in enumerate(_FLAGS))}
    FROM (SELECT s_name AS name, * FROM supplier UNION ALL SELECT ' KH ' || s_name || ' ', * FROM supplier)""",
)
def hospital_file_rows(spark, sf):
    """Suppliers written as lines of the capability file, parsed as the file reader does."""
    fields = [_NAMES.format(n="s_name"), *(f"CASE WHEN {flag} THEN 'True' ELSE 'False' END" for flag in _FLAGS)]
    line = F.concat_ws(";", *(F.expr(f) for f in fields))
    rows = reference.hospital_rows(v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row"), line.alias("value")))
    variants = reference.name_variants(rows)
    return variants.select("variant", *[F.col("granted")[c].alias(f"c{k}") for k, c in enumerate(vocab.CAPABILITIES)])


HOLIDAYS = [
    ("1996-01-01", "Neujahr"), ("1996-12-25", "Weihnachten"), ("1998-05-01", "Tag der Arbeit"),
    ("1998-10-03", "Tag der Deutschen Einheit"), ("2000-01-01", "Neujahr"), ("2000-12-26", "Weihnachten"),
]


@query(
    "holiday_join",
    "WITH h(date, name) AS (VALUES "
    + ", ".join(f"(DATE '{d}', '{n}')" for d, n in HOLIDAYS)
    + """) SELECT o_orderkey, o_orderdate, name AS holiday
    FROM orders LEFT JOIN h ON CAST(o_orderdate AS DATE) = h.date""",
)
def holiday_join(spark, sf):
    entries = ", ".join(f"('{d}', '{n}')" for d, n in HOLIDAYS)
    table = spark.sql(f"SELECT * FROM VALUES {entries} AS t(date, name)")
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return reference.mark_holidays(orders, "o_orderdate", table)


@query(
    "schedule_parse",
    """SELECT 'Ret SL ' || c_name AS vehicle, CAST(c_nationkey * 7 AS INTEGER) AS weekly_hours FROM customer
    UNION ALL SELECT 'Ret SL ' || c_mktsegment, CAST(NULL AS INTEGER) FROM customer""",
)
def schedule_parse(spark, sf):
    config = F.expr(
        "c_name || ' : ' || CAST(c_nationkey * 7 AS STRING) || ' ,ohne Doppelpunkt, ' || c_mktsegment || ':offen'"
    )
    rows = v.table(spark, sf, "customer").select(config.alias("config"))
    return reference.schedule_table(rows, "config", "Ret SL ")


@query(
    "materialised_metric",
    W(v.SQL_FINDINGS)
    + """SELECT protocolId, count(*) AS n, round(avg(value_num), 6) AS mean_value FROM fnd
    WHERE description = 'GCS' GROUP BY protocolId""",
)
def materialised_metric(spark, sf):
    path = f"{shared_dir(spark)}/metric-gcs-{uuid.uuid4().hex}"
    stored = metrics.materialised_metric({"findings": v.findings(spark, sf)}, "GCS", path)
    return rounded(
        stored.groupBy("protocolId").agg(F.count(F.lit(1)).alias("n"), F.avg("value_num").alias("mean_value"))
    )


@query(
    "stored_metrics_join",
    W(v.SQL_INDEX, v.SQL_FINDINGS)
    + """, s AS (SELECT protocolId, count(*) AS n, sum(value_num) AS total FROM fnd WHERE description = 'GCS' GROUP BY 1),
    p AS (SELECT protocolId, count(*) AS n_pain, sum(value_num) AS pain FROM fnd WHERE description = 'Schmerzen' GROUP BY 1)
    SELECT protocolId, CAST(year(missionDate) AS BIGINT) AS mission_year, n, round(total, 6) AS total, n_pain, round(pain, 6) AS pain
    FROM s JOIN p USING (protocolId) LEFT JOIN idx USING (protocolId)""",
)
def stored_metrics_join(spark, sf):
    """Two stored metrics of the same buckets; one year of the first is written a second time."""
    tables = {"index": v.index(spark, sf), "findings": v.findings(spark, sf)}
    first_name, second_name = (f"metric_{kind}_{uuid.uuid4().hex}" for kind in ("gcs", "pain"))
    metrics.store_metric(tables, "GCS", first_name, buckets=8)
    pain = metrics.store_metric(tables, "Schmerzen", second_name, buckets=8)
    gcs = metrics.replace_year(tables, "GCS", first_name, 1997)
    keys = ["protocolId", metrics.YEAR]
    a = gcs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value_num").alias("total"))
    b = pain.groupBy("protocolId").agg(F.count(F.lit(1)).alias("n_pain"), F.sum("value_num").alias("pain"))
    return rounded(a.join(b, "protocolId").withColumn(metrics.YEAR, F.col(metrics.YEAR).cast("bigint")))


@query(
    "calendar_parts",
    """SELECT event_id, year(ts) AS year, month(ts) AS month, hour(ts) AS hour, dayname(ts) AS weekday,
    CASE WHEN isodow(ts) <= 4 THEN 'Mon-Thu' WHEN isodow(ts) = 5 THEN 'Fri' WHEN isodow(ts) = 6 THEN 'Sat' ELSE 'Sun' END AS weekday_group,
    CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_start,
    strftime(ts, '%Y-%m') AS year_month,
    list_extract(['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober',
        'November', 'Dezember'], CAST(month(ts) AS INTEGER)) AS month_name,
    CASE WHEN lower(event_type) = 'click' THEN 'Ja' WHEN lower(event_type) = 'view' THEN 'Nein' END AS flag
    FROM events""",
)
def calendar_parts(spark, sf):
    ts = F.col("ts")
    answer = F.expr("CASE event_type WHEN 'click' THEN 'JA' WHEN 'view' THEN 'no' ELSE 'vielleicht' END")
    return v.table(spark, sf, "events").select(
        "event_id",
        F.year(ts).cast("bigint").alias("year"),
        F.month(ts).cast("bigint").alias("month"),
        F.hour(ts).cast("bigint").alias("hour"),
        clean.weekday_name(ts).alias("weekday"),
        clean.weekday_group(ts).alias("weekday_group"),
        clean.week_start(ts).alias("week"),
        clean.month_start(ts).alias("month_start"),
        clean.month_label(ts).alias("year_month"),
        clean.month_name(F.month(ts)).alias("month_name"),
        clean.yes_no_label(clean.yes_no(answer)).alias("flag"),
    )


@query(
    "mission_details_full_outer",
    W(v.SQL_INDEX, v.SQL_DETAILS)
    + """, d AS (SELECT * EXCLUDE (protocolId), CASE WHEN transportFlashingLights THEN protocolId ELSE 'only-' || protocolId END
        AS protocolId FROM dtl)
    SELECT protocolId, missionType, missionDate, StatusAlarm, Status8 FROM idx FULL JOIN d USING (protocolId)""",
)
def mission_details_full_outer(spark, sf):
    """Half of the details get ids the index lacks, so both unmatched sides occur."""
    details = scans.protocol_details(v.details(spark, sf)).select(
        F.when(F.col("content_transportFlashingLights"), F.col("protocolId"))
        .otherwise(F.concat(F.lit("only-"), "protocolId"))
        .alias("protocolId"),
        "StatusAlarm",
        "Status8",
    )
    times = joins.computed_once(details, ["StatusAlarm", "Status8"])
    both = joins.full_outer_once(v.index(spark, sf), times, by=(["missionNumber"], []), counted=(None, details))
    return both.select("protocolId", "missionType", "missionDate", "StatusAlarm", "Status8")


@query(
    "absent_columns",
    """SELECT CAST(c_custkey AS VARCHAR) AS protocolId, c_name AS callSign,
    CAST(NULL AS VARCHAR) AS leadingDiagnosis, CAST(NULL AS TIMESTAMP) AS missionDate FROM customer""",
)
def absent_columns(spark, sf):
    """A collection that lacks most declared columns, read with its declared schema."""
    rows = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("protocolId"), F.col("c_name").alias("callSign"))
    return conform(rows, "index").select("protocolId", "callSign", "leadingDiagnosis", "missionDate")
