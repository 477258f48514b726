"""Coverage, therapy and destination indicators, linkage and flows."""

from __future__ import annotations

from pyspark.sql import Window as W_
from pyspark.sql import functions as F

from benchset import views as v
from benchset.registry import query, rounded
from pulsegrid import vocab
from pulsegrid.operators import cohort, flows, summary
from pulsegrid.operators.variants import match_names
from pulsegrid.plans import coverage, destination, linkage
from pulsegrid.sources import items, reference, scans

W = v.with_ctes


def monitored_index(spark, sf):
    """Customers as protocols; the market segment decides the mission type."""
    kind = F.expr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'RTW-Transport' WHEN 'AUTOMOBILE' THEN 'Pauschale RTW' ELSE 'KTW' END"
    )
    return v.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("protocolId"), kind.alias("missionType")
    )


def measured(spark, sf):
    return {
        "gcs": items.scores(v.findings(spark, sf), vocab.ITEM_SCORE),
        **{code: items.vitals(v.vitals(spark, sf, code), code) for code in ("bd", "hf", "spo2", "af")},
    }


SQL_COUNTS = """ids AS (SELECT CAST(c_custkey AS VARCHAR) AS protocolId FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')),
cnt AS (SELECT protocolId,
    (SELECT count(*) FROM fnd WHERE fnd.protocolId = ids.protocolId AND description = 'GCS') AS gcs_count,
    count(*) FILTER (WHERE metric = 'bd') AS bd_count, count(*) FILTER (WHERE metric = 'hf') AS hf_count,
    count(*) FILTER (WHERE metric = 'spo2') AS spo2_count, count(*) FILTER (WHERE metric = 'af') AS af_count
    FROM ids LEFT JOIN vit USING (protocolId) GROUP BY protocolId)"""


@query(
    "monitoring_coverage",
    W(v.SQL_FINDINGS, v.SQL_VITALS, SQL_COUNTS)
    + """, s AS (SELECT 'gcs' AS kind, round(avg(CASE WHEN gcs_count >= 2 THEN 100.0 ELSE 0 END), 6) AS percent FROM cnt
    UNION ALL SELECT 'bd', round(avg(CASE WHEN bd_count >= 2 THEN 100.0 ELSE 0 END), 6) FROM cnt
    UNION ALL SELECT 'hf', round(avg(CASE WHEN hf_count >= 2 THEN 100.0 ELSE 0 END), 6) FROM cnt
    UNION ALL SELECT 'spo2', round(avg(CASE WHEN spo2_count >= 2 THEN 100.0 ELSE 0 END), 6) FROM cnt
    UNION ALL SELECT 'af', round(avg(CASE WHEN af_count >= 2 THEN 100.0 ELSE 0 END), 6) FROM cnt
    UNION ALL SELECT 'all', round(avg(CASE WHEN least(gcs_count, bd_count, hf_count, spo2_count, af_count) >= 2
        THEN 100.0 ELSE 0 END), 6) FROM cnt)
    SELECT kind, percent, round(percent - 100, 6) AS to_target FROM s""",
)
def monitoring_coverage(spark, sf):
    return rounded(coverage.monitoring_coverage(monitored_index(spark, sf), measured(spark, sf)))


@query(
    "monitoring_failures_first",
    W(v.SQL_FINDINGS, v.SQL_VITALS, SQL_COUNTS)
    + """SELECT protocolId, least(gcs_count, bd_count, hf_count, spo2_count, af_count) >= 2 AS all_met,
    gcs_count + bd_count + hf_count + spo2_count + af_count AS measurements FROM cnt ORDER BY 2, 1""",
)
def monitoring_failures_first(spark, sf):
    """The detail table as it is read: protocols that miss a kind come first."""
    ids = scans.select_values(monitored_index(spark, sf), "missionType", vocab.MONITORED_MISSION_TYPES)
    counts = coverage.measurement_counts(ids, measured(spark, sf))
    total = sum((F.col(f"{k}_count") for k in ("bd", "hf", "spo2", "af")), F.col("gcs_count"))
    return summary.failures_first(counts, "all_met", ["protocolId"]).select("protocolId", "all_met", total.alias("measurements"))


@query(
    "monitoring_counts",
    W(v.SQL_FINDINGS, v.SQL_VITALS, SQL_COUNTS)
    + """SELECT protocolId, gcs_count, bd_count, hf_count, spo2_count, af_count,
    least(gcs_count, bd_count, hf_count, spo2_count, af_count) >= 2 AS all_met FROM cnt""",
)
def monitoring_counts(spark, sf):
    ids = scans.select_values(monitored_index(spark, sf), "missionType", vocab.MONITORED_MISSION_TYPES)
    counts = coverage.measurement_counts(ids, measured(spark, sf))
    return counts.select("protocolId", "gcs_count", "bd_count", "hf_count", "spo2_count", "af_count", "all_met")


SQL_REDUCED = """low AS (SELECT protocolId, value_num FROM fnd WHERE description = 'GCS' AND type = 'eb_neuro'
    AND value_num > 0 AND value_num < 15),
glucose AS (SELECT protocolId, value FROM vit WHERE metric = 'bz' AND value > 0)"""


@query(
    "conditional_measure_share",
    W(v.SQL_FINDINGS, v.SQL_VITALS, SQL_REDUCED)
    + """SELECT count(*) AS cases, count(g) AS with_measure, round(count(g) * 100.0 / count(*), 6) AS percent
    FROM (SELECT DISTINCT protocolId FROM low) LEFT JOIN (SELECT DISTINCT protocolId, 1 AS g FROM glucose) USING (protocolId)""",
)
def conditional_measure_share(spark, sf):
    scores = items.scores(v.findings(spark, sf), vocab.ITEM_SCORE)
    return rounded(coverage.glucose_when_unconscious(scores, items.vitals(v.vitals(spark, sf, "bz"), "bz")))


@query(
    "conditional_measure_detail",
    W(v.SQL_FINDINGS, v.SQL_VITALS, SQL_REDUCED)
    + """SELECT protocolId, value_num, count(*) AS n, count(value) AS with_value, round(sum(value), 4) AS bz_sum
    FROM low LEFT JOIN glucose USING (protocolId) GROUP BY 1, 2""",
)
def conditional_measure_detail(spark, sf):
    scores = items.scores(v.findings(spark, sf), vocab.ITEM_SCORE)
    detail = coverage.glucose_detail(scores, items.vitals(v.vitals(spark, sf, "bz"), "bz"))
    return rounded(
        detail.groupBy("protocolId", "value_num").agg(
            F.sum(F.greatest("bz_count", F.lit(1))).alias("n"),
            F.sum("bz_count").alias("with_value"),
            F.sum("bz_sum").cast("double").alias("bz_sum"),
        ),
        4,
    )


SQL_CHEST_PAIN = """cases AS (SELECT protocolId, leadingDiagnosis FROM idx
    WHERE missionType IN ('Pauschale RTW', 'RTW - Transport', 'Pauschale NEF')
    AND regexp_matches(lower(leadingDiagnosis), 'acs|brustschmerz|thoraxschmerz|angina|herzinfarkt')),
ecg AS (SELECT DISTINCT protocolId FROM mea WHERE value_1 = 'Monitoring' AND value_2 = '12-Kanal-EKG')"""


@query(
    "cohort_measure_share",
    W(v.SQL_INDEX, v.SQL_MEASURES, SQL_CHEST_PAIN)
    + """SELECT count(*) AS cases, count(*) FILTER (WHERE protocolId IN (SELECT protocolId FROM ecg)) AS with_measure,
    round(count(*) FILTER (WHERE protocolId IN (SELECT protocolId FROM ecg)) * 100.0 / count(*), 6) AS percent FROM cases""",
)
def cohort_measure_share(spark, sf):
    ecgs = items.twelve_lead_ecgs(v.measures(spark, sf))
    return rounded(coverage.ecg_in_chest_pain(v.index(spark, sf), ecgs))


@query(
    "cohort_measure_flags",
    W(v.SQL_INDEX, v.SQL_MEASURES, SQL_CHEST_PAIN)
    + """SELECT CASE WHEN protocolId IN (SELECT protocolId FROM ecg) THEN 'Ja' ELSE 'Nein' END AS label, count(*) AS count
    FROM (SELECT DISTINCT protocolId FROM cases) GROUP BY 1""",
)
def cohort_measure_flags(spark, sf):
    cases = coverage.chest_pain_cases(v.index(spark, sf))
    return coverage.flag_summary(coverage.cohort_flags(cases, items.twelve_lead_ecgs(v.measures(spark, sf))))


@query(
    "cohort_measure_detail",
    W(v.SQL_INDEX, v.SQL_MEASURES, SQL_CHEST_PAIN)
    + """SELECT protocolId, protocolId IN (SELECT protocolId FROM ecg) AS measured, leadingDiagnosis FROM cases""",
)
def cohort_measure_detail(spark, sf):
    cases = coverage.chest_pain_cases(v.index(spark, sf))
    return coverage.cohort_detail(cases, items.twelve_lead_ecgs(v.measures(spark, sf)))


SQL_STEMI = """cases AS (SELECT protocolId FROM idx WHERE lower(leadingDiagnosis) LIKE '%stemi%'
    AND lower(leadingDiagnosis) NOT LIKE '%nstemi%'),
med AS (SELECT * FROM mea WHERE value_1 = 'Medikamente' AND (lower(value_2) LIKE '%ring%' OR lower(value_6) LIKE '%ring%'))"""


@query(
    "therapy_share",
    W(v.SQL_INDEX, v.SQL_MEASURES, SQL_STEMI)
    + """SELECT count(*) AS cases, count(*) FILTER (WHERE protocolId IN (SELECT protocolId FROM med)) AS with_measure,
    round(count(*) FILTER (WHERE protocolId IN (SELECT protocolId FROM med)) * 100.0 / count(*), 6) AS percent FROM cases""",
)
def therapy_share(spark, sf):
    return rounded(coverage.aspirin_in_stemi(v.index(spark, sf), v.measures(spark, sf), "distinct", "Ring"))


@query(
    "therapy_doses",
    W(v.SQL_INDEX, v.SQL_MEASURES, SQL_STEMI)
    + """SELECT protocolId, value_2 AS med_name, dose, 'mg' AS dose_unit, value_3 AS route FROM med
    WHERE protocolId IN (SELECT protocolId FROM cases)""",
)
def therapy_doses(spark, sf):
    return coverage.aspirin_doses(v.index(spark, sf), v.measures(spark, sf), "Ring")


@query(
    "capnography_share",
    W(v.SQL_MEASURES)
    + """, tube AS (SELECT DISTINCT protocolId FROM mea WHERE value_1 = 'Atemweg' AND value_2 = 'Intubation'
        AND value_3 IN ('ECONOMY', 'PROMO')),
    co2 AS (SELECT DISTINCT CAST(event_id AS VARCHAR) AS protocolId FROM events
        WHERE event_type = 'view' AND event_id % 8 >= 6 AND event_id % 6 <> 0)
    SELECT count(*) AS cases, count(c.protocolId) AS with_measure, round(count(c.protocolId) * 100.0 / count(*), 6) AS percent
    FROM tube LEFT JOIN co2 c USING (protocolId)""",
)
def capnography_share(spark, sf):
    co2 = items.vitals(v.vitals(spark, sf, "co2", "event_id"), "co2")
    return rounded(
        coverage.capnography_after_airway(items.intubations(v.measures(spark, sf)), co2, ["ECONOMY", "PROMO"])
    )


@query(
    "documentation_bundle",
    W(v.SQL_FINDINGS, v.SQL_VITALS, v.SQL_RESULTS)
    + """, ids AS (SELECT CAST(c_custkey AS VARCHAR) AS protocolId FROM customer),
    n AS (SELECT protocolId,
        (SELECT count(*) FROM fnd WHERE fnd.protocolId = ids.protocolId AND description = 'GCS') AS score,
        (SELECT count(*) FROM vit WHERE vit.protocolId = ids.protocolId AND metric = 'bz') AS glucose,
        (SELECT count(*) FROM fnd WHERE fnd.protocolId = ids.protocolId AND description = 'Auffälligkeiten') AS neuro,
        (SELECT count(*) FROM res WHERE res.protocolId = ids.protocolId AND value_1 = 'Symptombeginn') AS onset FROM ids)
    , s AS (SELECT 'score' AS kind, round(avg(CASE WHEN score >= 2 THEN 100.0 ELSE 0 END), 6) AS percent FROM n
    UNION ALL SELECT 'glucose', round(avg(CASE WHEN glucose >= 1 THEN 100.0 ELSE 0 END), 6) FROM n
    UNION ALL SELECT 'neuro', round(avg(CASE WHEN neuro >= 1 THEN 100.0 ELSE 0 END), 6) FROM n
    UNION ALL SELECT 'onset', round(avg(CASE WHEN onset >= 1 THEN 100.0 ELSE 0 END), 6) FROM n
    UNION ALL SELECT 'all', round(avg(CASE WHEN score >= 2 AND glucose >= 1 AND neuro >= 1 AND onset >= 1
        THEN 100.0 ELSE 0 END), 6) FROM n)
    SELECT kind, percent, round(percent - 100, 6) AS to_target FROM s""",
)
def documentation_bundle(spark, sf):
    findings, results = v.findings(spark, sf), v.results(spark, sf)
    documented = {
        "score": (items.scores(findings, vocab.ITEM_SCORE), 2),
        "glucose": (items.vitals(v.vitals(spark, sf, "bz"), "bz"), 1),
        "neuro": (items.neurological_signs(findings), 1),
        "onset": (items.onsets(results), 1),
    }
    return rounded(coverage.documentation_bundle(monitored_index(spark, sf), documented))


def _sql_bundle(kinds: dict[str, tuple[str, int]]) -> str:
    """Shares of the cases ``c`` with enough entries of each kind; a kind is the SQL of its protocols."""
    counts = " ".join(
        f"LEFT JOIN (SELECT protocolId, count(*) AS {k} FROM ({rows}) GROUP BY 1) USING (protocolId)" for k, (rows, _) in kinds.items()
    )
    met = {k: f"coalesce({k}, 0) >= {least}" for k, (_, least) in kinds.items()}
    met["all"] = " AND ".join(met.values())
    return (
        f", n AS (SELECT * FROM c {counts}), s AS ("
        + " UNION ALL ".join(f"SELECT '{k}' AS kind, round(avg(CASE WHEN {test} THEN 100.0 ELSE 0 END), 6) AS percent FROM n" for k, test in met.items())
        + ") SELECT kind, percent, round(percent - 100, 6) AS to_target FROM s WHERE percent IS NOT NULL"
    )


SQL_PRIMARY = "missionType IN ('Pauschale RTW', 'RTW - Transport')"


@query(
    "stroke_bundle",
    W(v.SQL_INDEX, v.SQL_FINDINGS, v.SQL_RESULTS, v.SQL_MEASURES, v.SQL_VITALS)
    + f""", c AS (SELECT DISTINCT protocolId FROM idx WHERE {SQL_PRIMARY}
        AND regexp_matches(lower(leadingDiagnosis), '{"|".join(vocab.STROKE_TERMS)}'))"""
    + _sql_bundle({
        "score": ("SELECT protocolId FROM fnd WHERE description = 'GCS'", 2),
        "glucose": ("SELECT protocolId FROM vit WHERE metric = 'bz'", 1),
        "neuro": ("SELECT protocolId FROM fnd WHERE description = 'Auffälligkeiten'", 1),
        "temperature": ("SELECT protocolId FROM vit WHERE metric = 'temp'", 1),
        "rhythm": ("SELECT protocolId FROM mea WHERE value_1 = 'Monitoring' AND contains(value_2, 'EKG')", 1),
        "onset": ("SELECT protocolId FROM res WHERE value_1 = 'Symptombeginn'", 1),
    }),
)
def stroke_bundle(spark, sf):
    series = [items.vitals(v.vitals(spark, sf, code), code) for code in ("bz", "temp")]
    return rounded(
        coverage.stroke_bundle(v.index(spark, sf), v.findings(spark, sf), v.results(spark, sf), v.measures(spark, sf), *series)
    )


@query(
    "head_injury_bundle",
    W(v.SQL_INDEX, v.SQL_FINDINGS)
    + f""", c AS (SELECT DISTINCT protocolId FROM idx WHERE {SQL_PRIMARY} AND lower(leadingDiagnosis) LIKE '%schädel-hirn%')"""
    + _sql_bundle({
        "consciousness": ("SELECT protocolId FROM fnd WHERE description = 'GCS' AND value_num IS NOT NULL AND type = 'eb_neuro'", 1),
        "pupils": ("SELECT DISTINCT protocolId FROM fnd WHERE description LIKE 'Lichtreaktion%'", 1),
        "score": ("SELECT protocolId FROM fnd WHERE description = 'GCS' AND value_num IS NOT NULL", 2),
    }),
)
def head_injury_bundle(spark, sf):
    return rounded(coverage.head_injury_bundle(v.index(spark, sf), v.findings(spark, sf)))


@query(
    "pain_relief",
    W(v.SQL_FINDINGS)
    + """, p AS (SELECT protocolId, arg_min(value_num, (timestamp, value_num)) AS initial,
        arg_max(value_num, (timestamp, value_num)) AS handover FROM fnd
        WHERE description = 'Schmerzen' AND value_num IS NOT NULL GROUP BY 1)
    SELECT count(*) AS cases, count(*) FILTER (WHERE handover < 5 OR initial - handover >= 2) AS with_measure,
    round(count(*) FILTER (WHERE handover < 5 OR initial - handover >= 2) * 100.0 / count(*), 6) AS percent
    FROM p WHERE initial >= 5""",
)
def pain_relief(spark, sf):
    return rounded(coverage.pain_relief(items.scores(v.findings(spark, sf), vocab.ITEM_PAIN)))


@query(
    "airway_with_anaesthetic",
    W(v.SQL_INDEX, v.SQL_MEASURES)
    + """, sht AS (SELECT DISTINCT protocolId FROM idx WHERE lower(leadingDiagnosis) LIKE '%schädel-hirn%'),
    done AS (SELECT DISTINCT protocolId FROM mea WHERE value_1 = 'Atemweg' AND value_2 = 'Intubation' AND value_3 IS NOT NULL
        AND protocolId IN (SELECT protocolId FROM mea WHERE value_1 = 'Medikamente'
            AND (lower(value_6) LIKE '%ring%' OR lower(value_6) LIKE '%widget%')))
    SELECT count(*) AS cases, count(d.protocolId) AS with_measure, round(count(d.protocolId) * 100.0 / count(*), 6) AS percent
    FROM sht LEFT JOIN done d USING (protocolId)""",
)
def airway_with_anaesthetic(spark, sf):
    cases = cohort.by_terms(v.index(spark, sf), "leadingDiagnosis", vocab.COHORT_TERMS["head_injury"])
    measures = v.measures(spark, sf)
    return rounded(
        coverage.airway_with_anaesthetic(cases, items.intubations(measures), items.medications(measures), ["Ring", "Widget"])
    )


# Destination: capability of the first name variant either contained in the text or containing it.
SQL_MATCH = """tgt AS (SELECT DISTINCT lower(trim(targetDestination)) AS t FROM idx WHERE trim(targetDestination) <> ''),
best AS (SELECT t, arg_min(stroke, rnk) AS stroke, arg_min(cardiac, rnk) AS cardiac, arg_min(arrest, rnk) AS arrest,
    arg_min(trauma, rnk) AS trauma FROM tgt JOIN caps ON contains(t, variant) OR contains(variant, t) GROUP BY t)"""


def _sql_category(keywords) -> str:
    whens = " ".join(f"WHEN contains(lower(leadingDiagnosis), '{k.lower()}') THEN '{c}'" for k, c in keywords)
    return f"CASE {whens} END"


def _sql_eligible(keywords) -> str:
    return f"""coalesce(CASE {_sql_category(keywords)} WHEN '{vocab.CAP_STROKE}' THEN stroke
        WHEN '{vocab.CAP_CARDIAC}' THEN cardiac WHEN '{vocab.CAP_ARREST}' THEN arrest
        WHEN '{vocab.CAP_TRAUMA}' THEN trauma END, false)"""


def _sql_destination(keywords, any_of, none_of=()) -> str:
    excluded = f"AND NOT regexp_matches(lower(leadingDiagnosis), '{'|'.join(none_of)}')" if none_of else ""
    return (
        W(v.SQL_INDEX, v.SQL_VARIANTS, SQL_MATCH)
        + f"""SELECT protocolId, targetDestination, leadingDiagnosis, {_sql_eligible(keywords)} AS hospital_eligible
        FROM idx LEFT JOIN best ON lower(trim(targetDestination)) = t
        WHERE regexp_matches(lower(leadingDiagnosis), '{'|'.join(any_of)}') {excluded}"""
    )


def variants(spark):
    return reference.name_variants(v.hospitals(spark))


def _eligibility(rows):
    return rows.select("protocolId", "targetDestination", "leadingDiagnosis", "hospital_eligible")


@query(
    "destination_eligibility",
    W(v.SQL_INDEX, v.SQL_VARIANTS, SQL_MATCH)
    + f"""SELECT protocolId, targetDestination, leadingDiagnosis, {_sql_eligible(vocab.TRAUMA_KEYWORDS)} AS hospital_eligible
    FROM idx LEFT JOIN best ON lower(trim(targetDestination)) = t""",
)
def destination_eligibility(spark, sf):
    return _eligibility(destination.mark_eligible(v.index(spark, sf), variants(spark), vocab.TRAUMA_KEYWORDS))


@query("destination_trauma", _sql_destination(vocab.TRAUMA_KEYWORDS, vocab.TRAUMA_TERMS))
def destination_trauma(spark, sf):
    return _eligibility(destination.trauma_cases(v.index(spark, sf), variants(spark)))


@query("destination_cardiac", _sql_destination(vocab.CARDIAC_KEYWORDS, vocab.CARDIAC_TERMS, vocab.ARREST_TERMS))
def destination_cardiac(spark, sf):
    return _eligibility(destination.cardiac_cases(v.index(spark, sf), variants(spark)))


@query("destination_stroke", _sql_destination(vocab.STROKE_KEYWORDS, vocab.STROKE_TERMS))
def destination_stroke(spark, sf):
    return _eligibility(destination.stroke_cases(v.index(spark, sf), variants(spark)))


@query(
    "destination_share",
    "WITH c AS ("
    + _sql_destination(vocab.STROKE_KEYWORDS, vocab.STROKE_TERMS)
    + """) SELECT count(*) AS cases, count(*) FILTER (WHERE hospital_eligible) AS eligible,
    round(count(*) FILTER (WHERE hospital_eligible) * 100.0 / count(*), 6) AS percent,
    round(count(*) FILTER (WHERE hospital_eligible) * 100.0 / count(*) - 100, 6) AS to_target FROM c""",
)
def destination_share(spark, sf):
    return rounded(destination.eligibility_share(destination.stroke_cases(v.index(spark, sf), variants(spark))))


@query(
    "destination_resuscitation",
    W(v.SQL_RESULTS, v.SQL_INDEX, v.SQL_VARIANTS, SQL_MATCH)
    + """, rea AS (SELECT DISTINCT protocolId FROM res
        WHERE (value_1 = 'NACA' AND value_2 = '6') OR (value_1 = 'Rea durchgeführt' AND value_2 = 'ja'))
    SELECT protocolId, targetDestination, coalesce(arrest, false) AS hospital_eligible
    FROM rea LEFT JOIN idx USING (protocolId) LEFT JOIN best ON lower(trim(targetDestination)) = t""",
)
def destination_resuscitation(spark, sf):
    cases = items.resuscitations_with_destination(v.results(spark, sf), v.index(spark, sf))
    return destination.resuscitation_cases(cases, variants(spark)).select(
        "protocolId", "targetDestination", "hospital_eligible"
    )


@query(
    "variant_matching",
    """WITH names AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN lower(c_mktsegment) || ' of ' || lower(n_name)
        ELSE substr(lower(c_name), 10 + c_custkey % 3, 7) END AS name
        FROM customer JOIN nation ON c_nationkey = n_nationkey),
    vars AS (SELECT lower(n_name) AS variant, n_nationkey AS rnk FROM nation
        UNION ALL SELECT lower(c_name), 100 + c_custkey FROM customer)
    SELECT name, min(rnk) AS rank FROM names JOIN vars ON contains(name, variant) OR contains(variant, name) GROUP BY name""",
)
def variant_matching(spark, sf):
    """Texts and name lists that both grow with the tables."""
    customer, nation = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    text = F.expr(
        """CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN lower(c_mktsegment) || ' of ' || lower(n_name)
        ELSE substr(lower(c_name), CAST(10 + c_custkey % 3 AS INT), 7) END"""
    )
    names = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(text.alias("name"))
    listed = nation.select(F.lower("n_name").alias("variant"), F.col("n_nationkey").cast("bigint").alias("rank")).unionByName(
        customer.select(F.lower("c_name").alias("variant"), (F.col("c_custkey") + 100).alias("rank"))
    )
    return match_names(names, "name", listed.withColumn("granted", F.lit(True))).select("name", "rank")


@query(
    "linkage_quality",
    W(v.SQL_INDEX, v.SQL_DISPATCH)
    + """SELECT (SELECT count(*) FROM idx) AS missions, (SELECT count(*) FROM dsp) AS dispatch_records,
    (SELECT count(DISTINCT missionNumber) FROM idx JOIN dsp ON missionNumber = EINSATZ_NR) AS linked,
    (SELECT count(*) FROM idx) - (SELECT count(DISTINCT missionNumber) FROM idx JOIN dsp ON missionNumber = EINSATZ_NR) AS missing""",
)
def linkage_quality(spark, sf):
    return linkage.mission_match_quality(v.index(spark, sf), v.dispatch(spark, sf))


@query(
    "linkage_reverse",
    W(v.SQL_INDEX, v.SQL_DISPATCH)
    + """SELECT count(*) AS total, count(protocolId) AS matched, round(count(protocolId) * 100.0 / count(*), 6) AS percent
    FROM dsp LEFT JOIN idx ON EINSATZ_NR = missionNumber""",
)
def linkage_reverse(spark, sf):
    return rounded(linkage.dispatch_match_quality(v.dispatch(spark, sf), v.index(spark, sf)))


@query(
    "linkage_rows",
    W(v.SQL_INDEX, v.SQL_DISPATCH)
    + """SELECT protocolId, missionNumber, AUFTRAGS_NR, CEDUS_CODE FROM idx LEFT JOIN dsp ON missionNumber = EINSATZ_NR""",
)
def linkage_rows(spark, sf):
    rows = linkage.link_dispatch(v.index(spark, sf), v.dispatch(spark, sf))
    return rows.select("protocolId", "missionNumber", "AUFTRAGS_NR", "CEDUS_CODE")


@query(
    "linkage_texts",
    W(v.SQL_INDEX, v.SQL_DISPATCH)
    + """SELECT AUFTRAGS_NR, idx.protocolId, doc_id IS NOT NULL AS has_text FROM dsp LEFT JOIN idx ON EINSATZ_NR = missionNumber
    LEFT JOIN documents ON idx.protocolId = CAST(doc_id AS VARCHAR)""",
)
def linkage_texts(spark, sf):
    linked = linkage.link_protocols(v.dispatch(spark, sf), v.index(spark, sf))
    rows = linkage.add_texts(linked, v.freetexts(spark, sf))
    return rows.select("AUFTRAGS_NR", "protocolId", F.col("data").isNotNull().alias("has_text"))


@query(
    "flow_counts",
    W(v.SQL_INDEX, v.SQL_DISPATCH)
    + """SELECT CEDUS_CODE, leadingDiagnosis, count(*) AS count FROM idx JOIN dsp ON missionNumber = EINSATZ_NR
    WHERE CEDUS_CODE IS NOT NULL AND leadingDiagnosis IS NOT NULL GROUP BY 1, 2""",
)
def flow_counts(spark, sf):
    return linkage.diagnosis_flow(v.index(spark, sf), v.dispatch(spark, sf))


SQL_FLOWS = """fl AS (SELECT SZENARIO_BEGINN, SZENARIO_ABSCHLUSS, count(*) AS count FROM dsp
    WHERE SZENARIO_BEGINN IS NOT NULL AND SZENARIO_ABSCHLUSS IS NOT NULL GROUP BY 1, 2)"""


@query(
    "flow_nodes",
    W(v.SQL_DISPATCH, SQL_FLOWS)
    + """, ends AS (SELECT SZENARIO_BEGINN AS node, count AS o, 0 AS i FROM fl
        UNION ALL SELECT SZENARIO_ABSCHLUSS, 0, count FROM fl)
    SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming,
    CAST(sum(o) + sum(i) AS BIGINT) AS total FROM ends GROUP BY node""",
)
def flow_nodes(spark, sf):
    transitions = linkage.scenario_transitions(v.dispatch(spark, sf))
    return flows.node_totals(transitions, "SZENARIO_BEGINN", "SZENARIO_ABSCHLUSS")


@query(
    "flow_node_numbers",
    """WITH n AS (SELECT DISTINCT p_name AS node FROM part UNION SELECT DISTINCT c_name FROM customer)
    SELECT count(*) AS nodes, count(*) AS numbers, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last,
    CAST(0 AS BIGINT) AS unordered FROM n""",
)
def flow_node_numbers(spark, sf):
    """Each node has one number, numbers are dense, and within a bucket they follow the order of the nodes."""
    nodes = v.table(spark, sf, "part").select(F.col("p_name").alias("node")).union(
        v.table(spark, sf, "customer").select("c_name")
    ).distinct()
    bucket = W_.partitionBy(F.pmod(F.xxhash64("node"), F.lit(flows.BUCKETS))).orderBy("node")
    numbered = flows.number_nodes(nodes).withColumn("follows", F.lag("index").over(bucket) + 1 == F.col("index"))
    return numbered.agg(
        F.count_distinct("node").alias("nodes"),
        F.count_distinct("index").alias("numbers"),
        F.min("index").alias("first"),
        F.max("index").alias("last"),
        F.count_if(~F.col("follows")).alias("unordered"),
    )


@query(
    "flow_top",
    W(v.SQL_DISPATCH, SQL_FLOWS)
    + "SELECT * FROM fl ORDER BY count DESC, SZENARIO_BEGINN, SZENARIO_ABSCHLUSS LIMIT 10",
)
def flow_top(spark, sf):
    return linkage.top_transitions(v.dispatch(spark, sf))


@query(
    "flow_top_ends",
    W(v.SQL_DISPATCH, SQL_FLOWS)
    + """, b AS (SELECT 'begin' AS side, SZENARIO_BEGINN AS value, CAST(sum(count) AS BIGINT) AS count FROM fl GROUP BY 2
        ORDER BY 3 DESC, 2 LIMIT 10),
    e AS (SELECT 'end' AS side, SZENARIO_ABSCHLUSS AS value, CAST(sum(count) AS BIGINT) AS count FROM fl GROUP BY 2
        ORDER BY 3 DESC, 2 LIMIT 10)
    SELECT * FROM b UNION ALL SELECT * FROM e""",
)
def flow_top_ends(spark, sf):
    dispatch = v.dispatch(spark, sf)
    begin = linkage.top_scenarios(dispatch, "SZENARIO_BEGINN")
    end = linkage.top_scenarios(dispatch, "SZENARIO_ABSCHLUSS")
    return begin.select(F.lit("begin").alias("side"), F.col("SZENARIO_BEGINN").alias("value"), "count").unionByName(
        end.select(F.lit("end").alias("side"), F.col("SZENARIO_ABSCHLUSS").alias("value"), "count")
    )
