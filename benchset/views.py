"""Document collections derived row by row from the given tables.

Orders play the mission index, lineitems the details, measures and dispatch
records, events the findings, results and vital signs, documents the free
texts. Every row of a table becomes one document, so the collections grow with
the tables and no document is ever gathered from several rows. Collections are
plain projections: filters and column choices of a query reach the given tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.schemas import STATUS_CODES
from pulsegrid.sources.collections import conform

# Event type of each vital sign, and which of its events; every event has one sign.
FREQUENT, RARE = "event_id % 8 < 6", "event_id % 8 >= 6"
VITAL_EVENTS = {
    "af": ("click", FREQUENT), "bd": ("view", FREQUENT), "bz": ("purchase", FREQUENT), "hf": ("signup", FREQUENT),
    "spo2": ("error", FREQUENT), "co": ("click", RARE), "co2": ("view", RARE), "hb": ("purchase", RARE),
    "puls": ("signup", RARE), "temp": ("error", RARE),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _plus(ts: str, minutes: str = "0", seconds: str = "0") -> Column:
    return F.expr(
        f"{ts} + make_dt_interval(0, 0, CAST({minutes} AS INT), CAST({seconds} AS DECIMAL(18, 6)))"
    )


DIAGNOSIS = """CASE o_custkey % 12
    WHEN 0 THEN 'Polytrauma' WHEN 1 THEN 'STEMI Vorderwand' WHEN 2 THEN 'NSTEMI' WHEN 3 THEN 'V.a. ACS'
    WHEN 4 THEN 'Schlaganfall / TIA' WHEN 5 THEN 'Schädel-Hirn-Trauma' WHEN 6 THEN 'Sepsis'
    WHEN 7 THEN 'Reanimation' WHEN 8 THEN 'Angina pectoris, Brustschmerz'
    WHEN 9 THEN 'unklare Initialdiagnose' WHEN 10 THEN 'SCHWERVERLETZT' END"""
DESTINATION = """CASE o_custkey % 9
    WHEN 0 THEN 'Nordklinik' WHEN 1 THEN '  nordklinik ZNA ' WHEN 2 THEN 'KH West Notaufnahme' WHEN 3 THEN 'West'
    WHEN 5 THEN '  ' WHEN 6 THEN 'Hausarzt' WHEN 7 THEN 'Campus OST Haus 4' WHEN 8 THEN 'ost' END"""
MISSION_TYPE = """CASE
    WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'Pauschale NEF'
    WHEN o_orderpriority = '1-URGENT' THEN 'RTW - Transport'
    WHEN o_orderpriority = '2-HIGH' THEN 'Pauschale RTW'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'S-KTW - Transport'
    WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN 'KTW - kein Transport'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'KTW'
    WHEN o_orderstatus = 'P' THEN 'S-KTW Sonderfahrt'
    ELSE 'S-KTW - Kein Transport' END"""
STATIC_TYPE = """CASE o_orderstatus
    WHEN 'O' THEN 'Krankentransport' WHEN 'F' THEN 'Notfallrettung' ELSE 'Krankentransport mit RTW' END"""
CALL_SIGN = """CASE o_custkey % 7
    WHEN 0 THEN '12-83-1' WHEN 1 THEN '12-85-1' WHEN 2 THEN '12-85-2' WHEN 3 THEN '12-83-2'
    WHEN 4 THEN '12-82-1' WHEN 5 THEN '10-85-14' END"""


def index(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    rows = orders.select(
        F.expr("CAST(o_orderkey AS STRING)").alias("protocolId"),
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS STRING) END").alias("missionNumber"),
        F.col("o_orderdate").alias("missionDate"),
        _plus("o_orderdate", "o_custkey % 1440").alias("alarmTime"),
        F.expr(MISSION_TYPE).alias("missionType"),
        F.expr(STATIC_TYPE).alias("staticMissionType"),
        F.col("o_orderpriority").alias("emergencyCareType"),
        F.expr(DIAGNOSIS).alias("leadingDiagnosis"),
        F.expr(DESTINATION).alias("targetDestination"),
        F.expr("'City ' || (o_custkey % 5)").alias("patientCity"),
        F.expr("'Street ' || (o_custkey % 20)").alias("patientStreet"),
        F.expr("CAST(o_custkey % 60 AS STRING)").alias("patientHouseNumber"),
        F.expr(CALL_SIGN).alias("callSign"),
        F.expr("CAST(o_custkey % 3 AS INT)").alias("evmCount"),
    )
    return conform(rows, "index")


def details(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    day = F.to_date("l_shipdate")
    minute = "l_partkey % 1080 + 5"
    minutes = {
        "Alarm": minute,
        "3": f"{minute} + l_suppkey % 7",
        "4": f"{minute} + l_partkey % 23",
        "7": f"{minute} + l_partkey % 23 + l_suppkey % 45 - 4",
        "8": f"{minute} + l_partkey % 23 + l_suppkey % 45 - 4 + l_quantity",
        "End": f"{minute} + l_partkey % 23 + l_suppkey % 45 + l_quantity + 60",
    }
    unreadable = F.expr("l_returnflag = 'R' AND l_linestatus = 'F'")
    fields = []
    for code in STATUS_CODES:
        date_text = time_text = F.lit(None).cast("string")
        if code in minutes:
            on = F.date_add(day, F.when(F.col("l_linenumber") == 7, 2).otherwise(0)) if code == "End" else day
            date_text = F.when(F.col("l_returnflag") == "A", F.date_format(on, "dd.MM.yyyy")).otherwise(on.cast("string"))
            seconds = "l_linenumber * 7" if code == "4" else "0"
            time_text = F.expr(
                f"lpad(CAST(CAST({minutes[code]} AS INT) DIV 60 AS STRING), 2, '0') || ':' || "
                f"lpad(CAST(CAST({minutes[code]} AS INT) % 60 AS STRING), 2, '0') || ':' || "
                f"lpad(CAST({seconds} AS STRING), 2, '0')"
            )
            if code == "4":
                time_text = F.when(unreadable, "k.A.").otherwise(time_text)
        fields += [date_text.alias(f"dateStatus{code}"), time_text.alias(f"timeStatus{code}")]
    lights = F.expr("CASE l_returnflag WHEN 'A' THEN 'Ja' WHEN 'N' THEN 'NEIN' ELSE 'unbekannt' END")
    fields += [
        lights.alias("flashingLights"),
        F.expr("CASE l_linestatus WHEN 'O' THEN 'yes' ELSE 'no' END").alias("transportFlashingLights"),
        F.lit(None).cast("string").alias("nachforderungNA"),
    ]
    return conform(
        lines.select(F.expr("CAST(l_orderkey AS STRING)").alias("protocolId"), F.struct(*fields).alias("content")),
        "details",
    )


def _event_id() -> Column:
    return F.expr("lpad(CAST(event_id AS STRING), 18, '0')").alias("_id")


def findings(spark: SparkSession, sf: str, protocol: str = "user_id") -> DataFrame:
    item = F.expr(
        """named_struct(
            'description', CASE event_type WHEN 'click' THEN 'GCS' WHEN 'view' THEN 'Lichtreaktion links'
                WHEN 'purchase' THEN 'Lichtreaktion rechts' WHEN 'signup' THEN 'Schmerzen' ELSE 'Auffälligkeiten' END,
            'valueInteger', CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(CAST(floor(value) AS INT) % 17 AS STRING) END,
            'valueString', props,
            'type', CASE WHEN event_id % 2 = 0 THEN 'eb_neuro' ELSE 'ue_neuro' END,
            'timeStamp', ts,
            'source', 'monitor')"""
    )
    filler = F.expr(
        """named_struct('description', 'Haut', 'valueInteger', CAST(NULL AS STRING), 'valueString', event_type,
            'type', CAST(NULL AS STRING), 'timeStamp', ts, 'source', 'monitor')"""
    )
    data = F.when(F.expr("event_type = 'error' AND value < 10"), F.array().cast("array<struct<description:string,valueInteger:string,valueString:string,type:string,timeStamp:timestamp_ntz,source:string>>")).otherwise(F.array(filler, item))
    return conform(
        table(spark, sf, "events").select(
            _event_id(),
            F.col(protocol).cast("string").alias("protocolId"),
            F.expr("CASE WHEN event_id % 3 = 0 THEN 'tablet' END").alias("source"),
            data.alias("data"),
        ),
        "findings",
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    item = F.expr(
        """named_struct(
            'value_1', CASE event_type WHEN 'click' THEN 'NACA' WHEN 'purchase' THEN 'Symptombeginn'
                WHEN 'signup' THEN 'Spezifikation Symptombeginn' WHEN 'view' THEN 'Rea durchgeführt' ELSE 'Sonstiges' END,
            'value_2', CASE
                WHEN event_type = 'click' THEN CAST(CAST(floor(value) AS INT) % 8 AS STRING)
                WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN date_format(ts, 'dd.MM.yyyy')
                WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN date_format(ts, 'HH:mm:ss')
                WHEN event_type = 'purchase' THEN ''
                WHEN event_type = 'signup' AND event_id % 4 = 0 THEN ''
                WHEN event_type = 'view' THEN CASE event_id % 3 WHEN 0 THEN 'ja' WHEN 1 THEN 'nein' ELSE 'Ja' END
                ELSE props END,
            'timeStamp', CASE WHEN event_id % 5 <> 0 THEN ts END,
            'source', CASE WHEN event_id % 2 = 0 THEN 'monitor' END)"""
    )
    return conform(
        table(spark, sf, "events").select(
            _event_id(),
            F.expr("CAST(user_id AS STRING)").alias("protocolId"),
            F.lit("tablet").alias("source"),
            F.array(item).alias("data"),
        ),
        "results",
    )


def measures(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    parts = table(spark, sf, "part")
    item = F.expr(
        """named_struct(
            'value_1', CASE l_returnflag WHEN 'A' THEN 'Medikamente' WHEN 'N' THEN 'Atemweg' ELSE 'Monitoring' END,
            'value_2', CASE WHEN l_returnflag = 'A' THEN p_brand
                WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Intubation'
                WHEN l_returnflag = 'N' THEN 'Maske'
                WHEN l_linenumber % 2 = 0 THEN '12-Kanal-EKG' ELSE 'EKG' END,
            'value_3', CASE WHEN l_linenumber <> 3 THEN p_type END,
            'value_4', CASE WHEN l_linenumber = 4 THEN 'k.A.' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END,
            'value_5', 'mg',
            'value_6', p_name,
            'value_7', CAST(NULL AS STRING),
            'value_8', l_linestatus,
            'value_10', CAST(l_suppkey AS STRING),
            'value_11', CASE WHEN l_linestatus = 'F' THEN 'EVM' END,
            'timeStamp', l_shipdate,
            'source', 'monitor')"""
    )
    return conform(
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
            F.expr("CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)").alias("_id"),
            F.expr("CAST(l_orderkey AS STRING)").alias("protocolId"),
            F.array(item).alias("data"),
        ),
        "measures",
    )


def vitals(spark: SparkSession, sf: str, code: str, protocol: str = "user_id") -> DataFrame:
    """Even events hold the series nested, odd ones flat; the unit is in either of its two fields."""
    kind, which = VITAL_EVENTS[code]
    events = table(spark, sf, "events").where(F.col("event_type") == kind).where(which)
    value = "CASE WHEN event_id % 6 = 0 THEN -1.0 ELSE value END"
    unit = "CASE WHEN event_id % 4 < 2 THEN 'mmHg' END"
    alternative = "CASE WHEN event_id % 4 >= 2 THEN 'Prozent' END"
    nested = F.expr(
        f"""CASE WHEN event_id % 2 = 0 THEN array(named_struct('value', {value}, 'unit', {unit}, '%', {alternative},
            'o2Administration', CAST(NULL AS STRING), 'description', props, 'timeStamp', ts, 'source', 'monitor')) END"""
    )

    def flat(expression: str) -> Column:
        return F.expr(f"CASE WHEN event_id % 2 = 1 THEN {expression} END")

    return conform(
        events.select(
            F.col(protocol).cast("string").alias("protocolId"),
            nested.alias("data"),
            flat(value).alias("value"),
            flat(unit).alias("unit"),
            flat(alternative).alias("%"),
            flat("props").alias("description"),
            flat("ts").alias("timeStamp"),
            flat("'tablet'").alias("source"),
        ),
        f"vitals_{code}",
    )


def dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return conform(
        table(spark, sf, "lineitem").select(
            F.expr("CAST(l_orderkey AS STRING)").alias("EINSATZ_NR"),
            F.expr("CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)").alias("AUFTRAGS_NR"),
            F.expr("CASE WHEN l_returnflag = 'R' THEN 'Nordfriesland' ELSE 'Schleswig-Flensburg' END").alias("EO_LANDKREIS"),
            F.expr("'Ort ' || (l_suppkey % 5)").alias("EO_ORT"),
            F.expr("'Str ' || (l_suppkey % 20)").alias("EO_STRASSE"),
            F.expr("CAST(l_suppkey % 60 AS STRING)").alias("EO_STRASSE_ZUSATZ"),
            F.expr("CASE WHEN l_linenumber <> 7 THEN 400000 + (l_partkey % 5000) * CAST(40.25 AS DOUBLE) END").alias("EO_X_KOORD"),
            F.expr("5950000 + (l_suppkey % 1000) * CAST(100.5 AS DOUBLE) + l_linenumber").alias("EO_Y_KOORD"),
            _plus("l_shipdate", "l_partkey % 1440").alias("EINSATZBEGINN"),
            _plus("l_shipdate", "l_partkey % 1440 + l_quantity * 3 - 9").alias("EINSATZENDE"),
            F.col("l_shipdate").alias("EINSATZDATUM"),
            F.expr("'Ret SL 85-' || (l_suppkey % 10)").alias("EINSATZMITTEL"),
            F.expr("CASE WHEN l_linenumber < 6 THEN l_returnflag || l_linestatus || CAST(l_linenumber AS STRING) END").alias("CEDUS_CODE"),
            F.expr("CASE WHEN l_quantity >= 3 THEN 'S' || (CAST(l_quantity AS INT) % 12) END").alias("SZENARIO_BEGINN"),
            F.expr("'S' || ((l_linenumber * l_partkey) % 12)").alias("SZENARIO_ABSCHLUSS"),
            F.expr(
                """CASE l_returnflag WHEN 'A' THEN '1 Einsatzbereit Funk' WHEN 'N' THEN '2 Einsatzbereit Wache'
                ELSE '3 Einsatz übernommen' END"""
            ).alias("STATUS_BEI_ALARMIERUNG"),
        ),
        "dispatch",
    )


# Closing sentences put behind the document texts, so that the phrase groups occur.
PHRASE = """CASE doc_id % 9
    WHEN 0 THEN ' Es ist keine medizinische Betreuung notwendig geworden, sondern lediglich eine logistische Betreuung.'
    WHEN 1 THEN ' Ärztliche Betreuung notwendig. Beatmung notwendig.'
    WHEN 2 THEN ' Soziale Betreuung; eine Krankenfahrt ausreichend.'
    WHEN 3 THEN ' Keine besondere Ausstattung KTW. Nicht infektiös.'
    WHEN 4 THEN ' Hochinfektiös, Isolierung notwendig, Monitorüberwachung.'
    WHEN 5 THEN ' Normale Schutzmaßnahmen. Ärztliche Begleitung notwendig.'
    WHEN 6 THEN ' Auch bei genauer Anamnese ist keine Indikationen für einen Krankentransport oder eine Krankenfahrt erkennbar.'
    ELSE '' END"""


# The preferred text field: mostly absent, else blank or a short text.
OTHER_TEXT = "CASE doc_id % 10 WHEN 3 THEN '  ' WHEN 4 THEN 'Sturz' END"


def freetexts(spark: SparkSession, sf: str) -> DataFrame:
    item = F.expr(
        f"""named_struct('protocolId', CAST(doc_id AS STRING),
            'description', CASE WHEN doc_id % 10 = 9 THEN 'Eigenanamnese' ELSE 'Anamnese' END,
            'content', text || {PHRASE}, 'text', {OTHER_TEXT},
            'value', CAST(NULL AS STRING), 'data', CAST(NULL AS STRING), 'comment', CAST(NULL AS STRING))"""
    )
    other = F.expr(
        """named_struct('protocolId', CAST(doc_id AS STRING), 'description', 'Übergabe',
            'content', lang, 'text', CAST(NULL AS STRING),
            'value', CAST(NULL AS STRING), 'data', CAST(NULL AS STRING), 'comment', CAST(NULL AS STRING))"""
    )
    return conform(
        table(spark, sf, "documents").select(
            F.expr("lpad(CAST(doc_id AS STRING), 18, '0')").alias("_id"),
            F.expr("CAST(doc_id AS STRING)").alias("protocolId"),
            F.array(other, item).alias("data"),
        ),
        "freetexts",
    )


def collections(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "index": index(spark, sf),
        "details": details(spark, sf),
        "findings": findings(spark, sf),
        "results": results(spark, sf),
        "measures": measures(spark, sf),
        "freetexts": freetexts(spark, sf),
        "dispatch": dispatch(spark, sf),
        "holidays": holidays(spark, sf),
        **{f"vitals_{c}": vitals(spark, sf, c) for c in VITAL_EVENTS},
    }


def holidays(spark: SparkSession, sf: str) -> DataFrame:
    """Every order day as a day with a name."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return conform(days.withColumn("name", F.date_format("date", "D")), "holidays")


def hospitals(spark: SparkSession) -> DataFrame:
    """Small capability table in the file's shape: order, name variants, one boolean per capability."""
    return spark.sql(
        """SELECT * FROM VALUES
        (0L, array('Nordklinik', 'Nordklinik Flensbg', 'ZNA'), true, true, false, false),
        (1L, array('KH West', 'Westklinik'), true, false, true, true),
        (2L, array('Uniklinik Campus Ost', 'Campus Ost', 'KH West'), false, true, true, true)
        AS t(row, names, `TIA / Schlaganfall`, `ACS / STEMI /NSTEMI`, Reanimation, Polytrauma)"""
    )


# The same collections, flat, for the SQL side. ------------------------------------------------

SQL_INDEX = f"""idx AS (SELECT CAST(o_orderkey AS VARCHAR) AS protocolId,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS VARCHAR) END AS missionNumber,
    o_orderdate AS missionDate, o_orderdate + to_minutes(CAST(o_custkey % 1440 AS BIGINT)) AS alarmTime,
    {MISSION_TYPE} AS missionType, {STATIC_TYPE} AS staticMissionType, o_orderpriority AS emergencyCareType,
    {DIAGNOSIS} AS leadingDiagnosis, {DESTINATION} AS targetDestination,
    'City ' || (o_custkey % 5) AS patientCity, 'Street ' || (o_custkey % 20) AS patientStreet,
    CAST(o_custkey % 60 AS VARCHAR) AS patientHouseNumber,
    {CALL_SIGN} AS callSign, CAST(o_custkey % 3 AS INTEGER) AS evmCount FROM orders)"""

SQL_DETAILS = """dtl AS (SELECT CAST(l_orderkey AS VARCHAR) AS protocolId,
    l_shipdate + to_minutes(CAST(l_partkey % 1080 + 5 AS BIGINT)) AS StatusAlarm,
    l_shipdate + to_minutes(CAST(l_partkey % 1080 + 5 + l_suppkey % 7 AS BIGINT)) AS Status3,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL ELSE
        l_shipdate + to_minutes(CAST(l_partkey % 1080 + 5 + l_partkey % 23 AS BIGINT)) + to_seconds(CAST(l_linenumber * 7 AS BIGINT)) END AS Status4,
    l_shipdate + to_minutes(CAST(l_partkey % 1080 + 5 + l_partkey % 23 + l_suppkey % 45 - 4 AS BIGINT)) AS Status7,
    l_shipdate + to_minutes(CAST(l_partkey % 1080 + 5 + l_partkey % 23 + l_suppkey % 45 - 4 + l_quantity AS BIGINT)) AS Status8,
    l_shipdate + to_days(CASE WHEN l_linenumber = 7 THEN 2 ELSE 0 END)
        + to_minutes(CAST(l_partkey % 1080 + 5 + l_partkey % 23 + l_suppkey % 45 + l_quantity + 60 AS BIGINT)) AS StatusEnd,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS flashingLights,
    CASE l_linestatus WHEN 'O' THEN true ELSE false END AS transportFlashingLights FROM lineitem)"""

SQL_FINDINGS = """fnd AS (SELECT event_id, CAST(user_id AS VARCHAR) AS protocolId,
    CASE event_type WHEN 'click' THEN 'GCS' WHEN 'view' THEN 'Lichtreaktion links'
        WHEN 'purchase' THEN 'Lichtreaktion rechts' WHEN 'signup' THEN 'Schmerzen' ELSE 'Auffälligkeiten' END AS description,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS INTEGER) % 17 AS DOUBLE) END AS value_num,
    props AS valueString, CASE WHEN event_id % 2 = 0 THEN 'eb_neuro' ELSE 'ue_neuro' END AS type, ts AS timestamp,
    CASE WHEN event_id % 3 = 0 THEN 'tablet' ELSE 'monitor' END AS source
    FROM events WHERE NOT (event_type = 'error' AND value < 10))"""

SQL_RESULTS = """res AS (SELECT event_id, CAST(user_id AS VARCHAR) AS protocolId,
    CASE event_type WHEN 'click' THEN 'NACA' WHEN 'purchase' THEN 'Symptombeginn'
        WHEN 'signup' THEN 'Spezifikation Symptombeginn' WHEN 'view' THEN 'Rea durchgeführt' ELSE 'Sonstiges' END AS value_1,
    CASE WHEN event_type = 'click' THEN CAST(CAST(floor(value) AS INTEGER) % 8 AS VARCHAR)
        WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN strftime(ts, '%d.%m.%Y')
        WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN strftime(ts, '%H:%M:%S')
        WHEN event_type = 'purchase' THEN ''
        WHEN event_type = 'signup' AND event_id % 4 = 0 THEN ''
        WHEN event_type = 'view' THEN CASE event_id % 3 WHEN 0 THEN 'ja' WHEN 1 THEN 'nein' ELSE 'Ja' END
        ELSE props END AS value_2,
    CASE WHEN event_id % 5 <> 0 THEN ts END AS timestamp,
    CASE WHEN event_id % 2 = 0 THEN 'monitor' ELSE 'tablet' END AS item_source FROM events)"""

SQL_MEASURES = """mea AS (SELECT CAST(l_orderkey AS VARCHAR) AS protocolId,
    CASE l_returnflag WHEN 'A' THEN 'Medikamente' WHEN 'N' THEN 'Atemweg' ELSE 'Monitoring' END AS value_1,
    CASE WHEN l_returnflag = 'A' THEN p_brand WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Intubation'
        WHEN l_returnflag = 'N' THEN 'Maske' WHEN l_linenumber % 2 = 0 THEN '12-Kanal-EKG' ELSE 'EKG' END AS value_2,
    CASE WHEN l_linenumber <> 3 THEN p_type END AS value_3,
    CASE WHEN l_linenumber = 4 THEN NULL ELSE floor(l_quantity) END AS dose,
    CASE WHEN l_linenumber = 4 THEN 'k.A.' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS value_4,
    p_name AS value_6, l_linestatus AS value_8, CAST(l_suppkey AS VARCHAR) AS value_10,
    CASE WHEN l_linestatus = 'F' THEN 'EVM' END AS value_11, l_shipdate AS timestamp
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SQL_VITAL_CODE = (
    "CASE " + " ".join(f"WHEN event_type = '{kind}' AND {which} THEN '{code}'" for code, (kind, which) in VITAL_EVENTS.items()) + " END"
)

SQL_VITALS = f"""vit AS (SELECT event_id, CAST(user_id AS VARCHAR) AS protocolId,
    {SQL_VITAL_CODE} AS metric,
    CASE WHEN event_id % 6 = 0 THEN -1.0 ELSE value END AS value,
    CASE WHEN event_id % 4 < 2 THEN 'mmHg' ELSE 'Prozent' END AS unit, props AS description, ts AS timestamp,
    CASE WHEN event_id % 2 = 0 THEN 'monitor' ELSE 'tablet' END AS source FROM events)"""

SQL_DISPATCH = """dsp AS (SELECT CAST(l_orderkey AS VARCHAR) AS EINSATZ_NR,
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS AUFTRAGS_NR,
    CASE WHEN l_returnflag = 'R' THEN 'Nordfriesland' ELSE 'Schleswig-Flensburg' END AS EO_LANDKREIS,
    'Ort ' || (l_suppkey % 5) AS EO_ORT, 'Str ' || (l_suppkey % 20) AS EO_STRASSE, CAST(l_suppkey % 60 AS VARCHAR) AS EO_STRASSE_ZUSATZ,
    CASE WHEN l_linenumber <> 7 THEN 400000 + (l_partkey % 5000) * CAST(40.25 AS DOUBLE) END AS EO_X_KOORD,
    5950000 + (l_suppkey % 1000) * CAST(100.5 AS DOUBLE) + l_linenumber AS EO_Y_KOORD,
    l_shipdate + to_minutes(CAST(l_partkey % 1440 AS BIGINT)) AS EINSATZBEGINN,
    l_shipdate + to_minutes(CAST(l_partkey % 1440 + l_quantity * 3 - 9 AS BIGINT)) AS EINSATZENDE,
    l_shipdate AS EINSATZDATUM, 'Ret SL 85-' || (l_suppkey % 10) AS EINSATZMITTEL,
    CASE WHEN l_linenumber < 6 THEN l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) END AS CEDUS_CODE,
    CASE WHEN l_quantity >= 3 THEN 'S' || (CAST(l_quantity AS INTEGER) % 12) END AS SZENARIO_BEGINN,
    'S' || ((l_linenumber * l_partkey) % 12) AS SZENARIO_ABSCHLUSS,
    CASE l_returnflag WHEN 'A' THEN '1 Einsatzbereit Funk' WHEN 'N' THEN '2 Einsatzbereit Wache'
        ELSE '3 Einsatz übernommen' END AS STATUS_BEI_ALARMIERUNG FROM lineitem)"""

SQL_TEXTS = f"""txt AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS protocolId,
    CASE WHEN doc_id % 10 = 9 THEN 'Eigenanamnese' ELSE 'Anamnese' END AS description,
    text || {PHRASE} AS content, {OTHER_TEXT} AS other FROM documents)"""

SQL_VARIANTS = """caps(variant, rnk, stroke, cardiac, arrest, trauma) AS (VALUES
    ('nordklinik', 1, true, true, false, false), ('nordklinik flensbg', 2, true, true, false, false),
    ('zna', 3, true, true, false, false), ('kh west', 4, false, true, true, true),
    ('westklinik', 5, true, false, true, true), ('uniklinik campus ost', 6, false, true, true, true),
    ('campus ost', 7, false, true, true, true))"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
