"""Protocol to dispatch linkage, match quality, and flows between codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import flows, joins, summary


def link_dispatch(missions: DataFrame, dispatch: DataFrame) -> DataFrame:
    """Every mission row with its dispatch records, one to many."""
    return joins.left_by(missions, dispatch, "missionNumber", "EINSATZ_NR", by=["protocolId"])


def link_protocols(dispatch: DataFrame, index: DataFrame) -> DataFrame:
    """Every dispatch record with its protocols."""
    return joins.left_by(dispatch, index, "EINSATZ_NR", "missionNumber", by=["AUFTRAGS_NR"])


def add_texts(linked: DataFrame, freetexts: DataFrame) -> DataFrame:
    """Free-text documents joined on, clashing columns with a suffix."""
    clashes = [c for c in freetexts.columns if c in linked.columns and c != "protocolId"]
    renamed = freetexts.withColumnsRenamed({c: f"{c}_Freetext" for c in clashes})
    texts = renamed.withColumnRenamed("protocolId", "_text_of")
    return joins.left_by(linked, texts, "protocolId", "_text_of", by=["AUFTRAGS_NR", "missionNumber"]).drop("_text_of")


def mission_match_quality(missions: DataFrame, dispatch: DataFrame) -> DataFrame:
    """Mission rows, dispatch records, distinct linked mission numbers, and rows minus those.

    Numbers are compared as distinct sets, so the one-to-many join is never built.
    """
    by_number = missions.groupBy("missionNumber").agg(F.count(F.lit(1)).alias("rows"))
    by_dispatch = dispatch.groupBy("EINSATZ_NR").agg(F.count(F.lit(1)).alias("records"))
    both = by_number.join(by_dispatch, F.col("missionNumber") == F.col("EINSATZ_NR"), "left")
    records = by_dispatch.agg(F.coalesce(F.sum("records"), F.lit(0))).scalar()
    counts = both.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("missions"), F.count("EINSATZ_NR").alias("linked"))
    return counts.select(
        "missions", records.alias("dispatch_records"), "linked", (F.col("missions") - F.col("linked")).alias("missing")
    )


def dispatch_match_quality(dispatch: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of the dispatch-to-protocol link, those with a protocol, and the percentage.

    Counted from the two pre-aggregated sides: a number with d records and p
    protocols stands for d * p linked rows, or d unlinked ones.
    """
    records = dispatch.groupBy("EINSATZ_NR").agg(F.count(F.lit(1)).alias("records"))
    protocols = (
        index.where(F.col("missionNumber").isNotNull())
        .groupBy("missionNumber")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("protocolId").alias("protocols"))
    )
    pair = records.join(protocols, F.col("EINSATZ_NR") == F.col("missionNumber"), "left")
    return pair.agg(
        F.coalesce(F.sum(F.col("records") * F.coalesce("rows", F.lit(1))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("records") * F.coalesce("protocols", F.lit(0))), F.lit(0)).alias("matched"),
    ).withColumn("percent", summary.percent(F.col("matched"), F.col("total")))


def diagnosis_flow(missions: DataFrame, dispatch: DataFrame) -> DataFrame:
    """Counts from dispatch code to final diagnosis over linked rows.

    Both sides are counted per mission number and label first: a number with
    many records on both sides joins as products of counts, not as all pairs.
    """
    codes = (
        dispatch.where(F.col("CEDUS_CODE").isNotNull() & F.col("EINSATZ_NR").isNotNull())
        .groupBy(F.col("EINSATZ_NR").alias("number"), "CEDUS_CODE")
        .agg(F.count(F.lit(1)).alias("_records"))
    )
    diagnoses = (
        missions.where(F.col("leadingDiagnosis").isNotNull() & F.col("missionNumber").isNotNull())
        .groupBy(F.col("missionNumber").alias("number"), "leadingDiagnosis")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    linked = codes.join(diagnoses, "number")
    return linked.groupBy("CEDUS_CODE", "leadingDiagnosis").agg(
        F.sum(F.col("_records") * F.col("_rows")).alias("count")
    )


def scenario_transitions(dispatch: DataFrame) -> DataFrame:
    return flows.flow_counts(dispatch, "SZENARIO_BEGINN", "SZENARIO_ABSCHLUSS")


def top_transitions(dispatch: DataFrame, n: int = 10) -> DataFrame:
    rows = scenario_transitions(dispatch)
    return rows.orderBy(F.desc("count"), "SZENARIO_BEGINN", "SZENARIO_ABSCHLUSS").limit(n)


def top_scenarios(dispatch: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent start or end scenarios of records that have both."""
    both = dispatch.where(F.col("SZENARIO_BEGINN").isNotNull() & F.col("SZENARIO_ABSCHLUSS").isNotNull())
    return summary.top_values(both, column, n)
