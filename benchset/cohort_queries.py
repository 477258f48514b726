"""Cohorts, filters, address options and generic joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchset import views as v
from benchset.registry import query, rounded
from pulsegrid import vocab
from pulsegrid.functions import classify, clean
from pulsegrid.operators import cohort, joins, summary
from pulsegrid.plans import mission_mix
from pulsegrid.sources import scans

W = v.with_ctes


def customers_with_region(spark, sf):
    customer, nation, region = (v.table(spark, sf, t) for t in ("customer", "nation", "region"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )


SQL_CUSTOMERS = """cust AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""


@query(
    "address_options",
    W(SQL_CUSTOMERS)
    + """SELECT DISTINCT 'r_name' AS level, r_name AS value FROM cust WHERE r_name IS NOT NULL
    UNION ALL SELECT DISTINCT 'n_name', n_name FROM cust WHERE r_name = 'ASIA' AND n_name IS NOT NULL
    UNION ALL SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM cust WHERE r_name = 'ASIA' AND n_name = 'NATION_2'""",
)
def address_options(spark, sf):
    chosen = {"r_name": "ASIA", "n_name": "NATION_2", "c_mktsegment": None}
    return cohort.cascade_options(customers_with_region(spark, sf), chosen)


@query(
    "address_filter",
    W(SQL_CUSTOMERS)
    + """SELECT c_custkey, c_name, r_name, n_name, c_mktsegment FROM cust
    WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING'""",
)
def address_filter(spark, sf):
    chosen = {"r_name": "ASIA", "n_name": None, "c_mktsegment": "BUILDING"}
    rows = cohort.cascade(customers_with_region(spark, sf), chosen)
    return rows.select("c_custkey", "c_name", "r_name", "n_name", "c_mktsegment")


@query(
    "mission_address",
    W(v.SQL_INDEX)
    + """SELECT protocolId, patientCity, patientStreet, alarmTime FROM idx WHERE patientCity = 'City 3'
    AND patientStreet = 'Street 8' AND alarmTime >= TIMESTAMP '1997-01-01' AND alarmTime < TIMESTAMP '1999-01-01'""",
)
def mission_address(spark, sf):
    rows = mission_mix.missions_at(
        v.index(spark, sf), city="City 3", street="Street 8", first_day="1997-01-01", last_day="1998-12-31"
    )
    return rows.select("protocolId", "patientCity", "patientStreet", "alarmTime")


@query(
    "term_cohort",
    W(v.SQL_INDEX)
    + """SELECT protocolId, leadingDiagnosis, 'chest pain' AS cohort FROM idx
        WHERE regexp_matches(lower(leadingDiagnosis), 'acs|brustschmerz|thoraxschmerz|angina|herzinfarkt')
    UNION ALL SELECT protocolId, leadingDiagnosis, 'stemi' FROM idx
        WHERE lower(leadingDiagnosis) LIKE '%stemi%' AND lower(leadingDiagnosis) NOT LIKE '%nstemi%'
    UNION ALL SELECT protocolId, missionType, 'ktw' FROM idx
        WHERE missionType IN ('KTW', 'KTW - kein Transport')
    UNION ALL SELECT protocolId, missionType, 'primary' FROM idx
        WHERE missionType IN ('Pauschale RTW', 'RTW - Transport')""",
)
def term_cohort(spark, sf):
    index = v.index(spark, sf)

    def tagged(rows, column, name):
        return rows.select("protocolId", F.col(column).alias("leadingDiagnosis"), F.lit(name).alias("cohort"))

    ktw = classify.word_match(F.col("missionType"), "ktw", no_words=["rtw"], no_parts=["s-ktw"])
    return (
        tagged(cohort.by_terms(index, "leadingDiagnosis", vocab.CHEST_PAIN_TERMS), "leadingDiagnosis", "chest pain")
        .unionByName(tagged(cohort.by_terms(index, "leadingDiagnosis", ["stemi"], ["nstemi"]), "leadingDiagnosis", "stemi"))
        .unionByName(tagged(index.where(ktw), "missionType", "ktw"))
        .unionByName(
            tagged(scans.select_values(index, "missionType", vocab.PRIMARY_MISSION_TYPES), "missionType", "primary")
        )
    )


@query(
    "part_terms",
    """SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(lower(p_name), 'ring|widget')
    AND NOT regexp_matches(lower(p_name), 'red')""",
)
def part_terms(spark, sf):
    rows = cohort.by_terms(v.table(spark, sf, "part"), "p_name", ["RING", "widget"], ["Red"])
    return rows.select("p_partkey", "p_name", "p_type")


@query(
    "default_cohort",
    W(v.SQL_INDEX)
    + """SELECT protocolId, 'term' AS choice FROM idx WHERE lower(leadingDiagnosis) LIKE '%sepsis%'
    UNION ALL SELECT protocolId, 'first value' FROM idx
        WHERE leadingDiagnosis = (SELECT min(leadingDiagnosis) FROM idx)
    UNION ALL SELECT protocolId, 'preferred' FROM idx WHERE missionType IN ('Pauschale RTW', 'RTW - Transport')
    UNION ALL SELECT protocolId, 'first type' FROM idx WHERE missionType = (SELECT min(missionType) FROM idx)
    UNION ALL SELECT protocolId, 'last years' FROM idx
        WHERE year(missionDate) IN (SELECT DISTINCT year(missionDate) FROM idx ORDER BY 1 DESC LIMIT 2)""",
)
def default_cohort(spark, sf):
    index = v.index(spark, sf)
    chosen = {
        "term": cohort.default_by_terms(index, "leadingDiagnosis", ["sepsis"]),
        "first value": cohort.default_by_terms(index, "leadingDiagnosis", ["kommt nicht vor"]),
        "preferred": cohort.default_by_values(index, "missionType", vocab.PRIMARY_MISSION_TYPES),
        "first type": cohort.default_by_values(index, "missionType", ["kommt nicht vor"]),
        "last years": cohort.last_years(index, "missionDate"),
    }
    rows = None
    for name, part in chosen.items():
        part = part.select("protocolId", F.lit(name).alias("choice"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    "patient_transports",
    W(v.SQL_INDEX)
    + """SELECT protocolId, staticMissionType FROM idx WHERE lower(staticMissionType) LIKE '%krankentransport%'
    AND lower(staticMissionType) NOT LIKE '%rtw%'""",
)
def patient_transports(spark, sf):
    return mission_mix.patient_transports(v.index(spark, sf)).select("protocolId", "staticMissionType")


def order_lines(spark, sf):
    """Orders with their lines, all rows of both sides, and the span from order to shipping."""
    orders = v.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "key")
    lines = v.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "key")
    return joins.full_outer(orders, lines, "key")


SQL_ORDER_LINES = """ol AS (SELECT coalesce(o_orderkey, l_orderkey) AS key, * EXCLUDE (o_orderkey, l_orderkey),
    epoch_us(l_shipdate) - epoch_us(o_orderdate) AS micros
    FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey)"""


@query(
    "null_or_nonneg",
    W(SQL_ORDER_LINES) + "SELECT key, l_linenumber, l_partkey, micros FROM ol WHERE micros IS NULL OR micros >= 0",
)
def null_or_nonneg(spark, sf):
    timed = order_lines(spark, sf).withColumn("micros", clean.micros_between(F.col("o_orderdate"), F.col("l_shipdate")))
    return cohort.null_or_non_negative(timed, ["micros"]).select("key", "l_linenumber", "l_partkey", "micros")


@query(
    "positive_only",
    W(SQL_ORDER_LINES)
    + """SELECT key, l_linenumber, l_partkey, round(micros / 3600000000.0, 6) AS hours FROM ol
    WHERE micros > 0 AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
    AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
    AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IS NOT NULL""",
)
def positive_only(spark, sf):
    rows = order_lines(spark, sf).na.drop(subset=["o_custkey"])
    rows = rows.where(clean.within_days(F.col("l_shipdate"), "1996-01-01", "1998-12-31"))
    rows = rows.where(clean.within_days(F.col("o_orderdate"), "1996-01-01", "1998-12-31"))
    rows = scans.select_values(rows, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    rows = scans.select_values(rows, "o_orderstatus", [])
    hours = rows.withColumn("hours", clean.hours_between(F.col("o_orderdate"), F.col("l_shipdate")))
    return rounded(hours.where(F.col("hours") > 0).select("key", "l_linenumber", "l_partkey", "hours"))


@query("top_n_other", """WITH c AS (SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand),
    r AS (SELECT *, row_number() OVER (ORDER BY count DESC, p_brand) AS rn FROM c)
    SELECT p_brand, count FROM r WHERE rn <= 10
    UNION ALL SELECT 'Sonstige', CAST(sum(count) AS BIGINT) FROM r WHERE rn > 10""")
def top_n_other(spark, sf):
    return summary.top_n_other(v.table(spark, sf, "part"), "p_brand")


@query(
    "mission_mixes",
    W(v.SQL_INDEX)
    + """, kt AS (SELECT * FROM idx WHERE staticMissionType = 'Krankentransport'),
    d AS (SELECT leadingDiagnosis AS value, count(*) AS count FROM kt WHERE leadingDiagnosis IS NOT NULL GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS rn FROM d)
    SELECT 'type' AS mix, staticMissionType AS value, count(*) AS count FROM idx GROUP BY 2
    UNION ALL SELECT 'diagnosis', value, count FROM r WHERE rn <= 10
    UNION ALL SELECT 'diagnosis', 'Sonstige', CAST(sum(count) AS BIGINT) FROM r WHERE rn > 10 HAVING sum(count) > 0
    UNION ALL SELECT 'all', 'missions', count(*) FROM idx""",
)
def mission_mixes(spark, sf):
    index = v.index(spark, sf)
    types = mission_mix.type_mix(index).select(F.lit("type").alias("mix"), F.col("staticMissionType").alias("value"), "count")
    diagnoses = mission_mix.diagnosis_mix(mission_mix.patient_transports(index)).select(
        F.lit("diagnosis").alias("mix"), F.col("leadingDiagnosis").alias("value"), "count"
    )
    total = index.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("all").alias("mix"), F.lit("missions").alias("value"), "count"
    )
    return types.unionByName(diagnoses).unionByName(total)


@query(
    "weekly_by_type",
    """SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type, count(*) AS counts
    FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2""",
)
def weekly_by_type(spark, sf):
    return summary.period_counts(v.table(spark, sf, "events"), "ts", "event_type")


@query(
    "weekly_missions",
    W(v.SQL_INDEX)
    + """SELECT CAST(date_trunc('week', missionDate) AS TIMESTAMP) AS week, missionType, count(*) AS counts
    FROM idx GROUP BY 1, 2""",
)
def weekly_missions(spark, sf):
    return mission_mix.weekly_counts(v.index(spark, sf), "missionType")


_HOURS = ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h:02d}" for h in range(24))


@query(
    "weekday_hour_heat",
    f"""SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday_number, dayname(ts) AS weekday, {_HOURS}
    FROM events GROUP BY 1, 2""",
)
def weekday_hour_heat(spark, sf):
    return summary.weekday_hour_table(v.table(spark, sf, "events"), "ts")


@query(
    "mission_order",
    W(v.SQL_INDEX)
    + """SELECT DISTINCT missionType AS name,
    CASE WHEN lower(missionType) LIKE '%nef%' THEN 1
        WHEN lower(missionType) LIKE '%rtw%' AND lower(missionType) NOT LIKE '%s-ktw%' THEN 2
        WHEN lower(missionType) LIKE '%s-ktw%' OR lower(missionType) LIKE '%sktw%' THEN 3
        WHEN lower(missionType) LIKE '%ktw%' THEN 4 ELSE 5 END AS class_rank,
    (lower(missionType) LIKE '%kein%' OR lower(missionType) LIKE '%ohne%') AND lower(missionType) NOT LIKE '%s-ktw%' AS late,
    CASE WHEN lower(missionType) LIKE '%kein transport%' THEN
            CASE WHEN lower(missionType) LIKE '%nef%' THEN 'nef' WHEN lower(missionType) LIKE '%ktw%' THEN 'ktw'
                WHEN lower(missionType) LIKE '%rtw%' THEN 'rtw' ELSE 'other' END || ' (no transport)'
        WHEN lower(missionType) LIKE '%nef%' THEN 'nef' WHEN lower(missionType) LIKE '%rtw%' THEN 'rtw'
        WHEN lower(missionType) LIKE '%s-ktw%' THEN 's-ktw' WHEN lower(missionType) LIKE '%ktw%' THEN 'ktw'
        ELSE 'other' END AS display_bucket FROM idx""",
)
def mission_order(spark, sf):
    return mission_mix.types_in_legend_order(v.index(spark, sf))


@query("top_values", """SELECT p_type, count(*) AS count FROM part GROUP BY p_type ORDER BY count DESC, p_type LIMIT 3""")
def top_values(spark, sf):
    return summary.top_values(v.table(spark, sf, "part"), "p_type", 3)
