"""Destination-hospital suitability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab
from pulsegrid.functions import classify, clean
from pulsegrid.operators import cohort, joins, summary
from pulsegrid.operators.variants import match_names


def with_capabilities(df: DataFrame, target: str, variants: DataFrame) -> DataFrame:
    """Add ``granted``, the capabilities of the first name variant the destination text matches.

    Only distinct destination texts are matched. A blank destination matches nothing and takes no
    part in the join; a heavy one is spread over as many salts as its rows ask for.
    """
    named = df.withColumn("_target", clean.fold(F.col(target)))
    blank = F.coalesce(F.col("_target"), F.lit("")) == ""
    best = match_names(named.where(~blank), "_target", variants).drop("rank").withColumnRenamed("_target", "_matched")
    found = joins.left_by(named.where(~blank), best, "_target", "_matched", by=["protocolId"]).drop("_target", "_matched")
    return found.unionByName(named.where(blank).drop("_target"), allowMissingColumns=True)


def mark_eligible(
    index: DataFrame,
    variants: DataFrame,
    keywords: Sequence[tuple[str, str]],
    target: str = "targetDestination",
    diagnosis: str = "leadingDiagnosis",
) -> DataFrame:
    """Add ``hospital_eligible``: the destination has the capability the diagnosis asks for."""
    category = classify.first_category(F.col(diagnosis), keywords)
    matched = with_capabilities(index, target, variants)
    return matched.withColumn(
        "hospital_eligible", F.coalesce(F.try_element_at("granted", category), F.lit(False))
    ).drop("granted")


def eligibility_share(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("hospital_eligible").alias("eligible")
    ).transform(lambda d: summary.with_target(d.withColumn("percent", summary.percent(F.col("eligible"), F.col("cases")))))


def trauma_cases(index: DataFrame, variants: DataFrame) -> DataFrame:
    rows = cohort.by_terms(index, "leadingDiagnosis", vocab.TRAUMA_TERMS)
    return mark_eligible(rows, variants, vocab.TRAUMA_KEYWORDS)


def cardiac_cases(index: DataFrame, variants: DataFrame) -> DataFrame:
    """Heart attacks and acute coronary syndromes that did not need resuscitation."""
    rows = cohort.by_terms(index, "leadingDiagnosis", vocab.CARDIAC_TERMS, vocab.ARREST_TERMS)
    return mark_eligible(rows, variants, vocab.CARDIAC_KEYWORDS)


def stroke_cases(index: DataFrame, variants: DataFrame) -> DataFrame:
    rows = cohort.by_terms(index, "leadingDiagnosis", vocab.STROKE_TERMS)
    return mark_eligible(rows, variants, vocab.STROKE_KEYWORDS)


def resuscitation_cases(with_destination: DataFrame, variants: DataFrame) -> DataFrame:
    """Positive resuscitations with destination; the capability asked for is fixed."""
    matched = with_capabilities(with_destination.where("rea_status"), "targetDestination", variants)
    granted = F.try_element_at("granted", F.lit(vocab.CAP_ARREST))
    return matched.withColumn("hospital_eligible", F.coalesce(granted, F.lit(False))).drop("granted")
