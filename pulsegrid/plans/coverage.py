"""Documentation and therapy coverage indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab
from pulsegrid.functions import classify, clean
from pulsegrid.operators import cohort, joins, summary
from pulsegrid.sources import items

ALL_KINDS = "all"


def measurement_counts(ids: DataFrame, measured: Mapping[str, DataFrame], minimum: int = 2) -> DataFrame:
    """Per distinct protocol: count of each kind, a flag per kind with enough, and one for all kinds.

    All kinds are counted in a single aggregation and joined on once.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [df.select("protocolId", F.lit(kind).alias("kind")) for kind, df in measured.items()],
    )
    counts = (
        tagged.where(F.col("protocolId").isNotNull())
        .groupBy("protocolId")
        .agg(*[F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in measured])
    )
    rows = ids.select("protocolId").distinct().join(counts, "protocolId", "left")
    rows = rows.withColumns({f"{k}_count": F.coalesce(f"{k}_count", F.lit(0)) for k in measured})
    rows = rows.withColumns({f"{k}_met": F.col(f"{k}_count") >= minimum for k in measured})
    return rows.withColumn(f"{ALL_KINDS}_met", reduce(lambda a, b: a & b, [F.col(f"{k}_met") for k in measured]))


def coverage_shares(counts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Percentage of protocols per kind and for all kinds, one row each, with its distance to all of them."""
    names = [*kinds, ALL_KINDS]
    one = counts.agg(*[summary.share(F.col(f"{k}_met")).alias(k) for k in names])
    return summary.with_target(summary.to_long(one, [], names, "kind", "percent"))


def monitoring_coverage(index: DataFrame, measured: Mapping[str, DataFrame]) -> DataFrame:
    """At least two measurements of each kind in primary missions."""
    ids = index.where(F.col("missionType").isin(vocab.MONITORED_MISSION_TYPES))
    return coverage_shares(measurement_counts(ids, measured), list(measured))


def reduced_consciousness(scores: DataFrame, kind: str = vocab.FIRST_FINDING) -> DataFrame:
    """Scores strictly between 0 and 15 at the first finding."""
    value = F.col("value_num")
    return scores.where((value > 0) & (value < 15) & (F.col("type") == kind))


def conditional_share(cases: DataFrame, measured: DataFrame) -> DataFrame:
    """Distinct protocols among ``cases``, those that occur in ``measured``, and the percentage."""
    ids = cases.select("protocolId").distinct()
    flagged = joins.flag_members(ids, measured, "measured")
    return flagged.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("measured").alias("with_measure")
    ).withColumn("percent", summary.percent(F.col("with_measure"), F.col("cases")))


def glucose_when_unconscious(scores: DataFrame, glucose: DataFrame) -> DataFrame:
    return conditional_share(reduced_consciousness(scores), glucose.where(F.col("value") > 0))


def glucose_detail(scores: DataFrame, glucose: DataFrame) -> DataFrame:
    """Cases with the number, sum, smallest and largest of their valid glucose values.

    Values are reduced per protocol first, so many scores and many values of one protocol never multiply.
    """
    value = F.col("value").cast("decimal(20,4)")
    per_protocol = (
        glucose.where(F.col("value") > 0)
        .groupBy("protocolId")
        .agg(
            F.count(F.lit(1)).alias("bz_count"), F.sum(value).alias("bz_sum"), F.min("value").alias("bz_min"), F.max("value").alias("bz_max")
        )
    )
    joined = reduced_consciousness(scores).join(per_protocol, "protocolId", "left")
    return joined.withColumn("bz_count", F.coalesce("bz_count", F.lit(0)))


def cohort_flags(cases: DataFrame, measured: DataFrame, flag: str = "measured") -> DataFrame:
    """Distinct protocols of the cohort with a flag and the number of cohort rows behind each."""
    ids = cases.groupBy("protocolId").agg(F.count(F.lit(1)).alias("rows"))
    return joins.flag_members(ids, measured, flag)


def cohort_share(cases: DataFrame, measured: DataFrame, denominator: str = "rows") -> DataFrame:
    """Cases, distinct protocols with the measure, and the percentage of rows or of distinct protocols."""
    if denominator not in ("rows", "distinct"):
        raise ValueError(f"Unknown denominator: {denominator}")
    whole = F.sum("rows") if denominator == "rows" else F.count(F.lit(1))
    flags = cohort_flags(cases, measured)
    return flags.agg(
        F.coalesce(whole, F.lit(0)).alias("cases"), F.count_if("measured").alias("with_measure")
    ).withColumn("percent", summary.percent(F.col("with_measure"), F.col("cases")))


def flag_summary(flags: DataFrame, flag: str = "measured") -> DataFrame:
    """Counts of protocols with and without the measure, labelled Ja and Nein."""
    return summary.value_counts(flags.withColumn("label", clean.yes_no_label(F.col(flag))), "label")


def cohort_detail(cases: DataFrame, measured: DataFrame) -> DataFrame:
    """Flag of each protocol with the diagnosis of every one of its cohort rows."""
    flags = cohort_flags(cases, measured).drop("rows")
    return flags.join(cases.select("protocolId", "leadingDiagnosis"), "protocolId", "left")


def chest_pain_cases(index: DataFrame) -> DataFrame:
    primary = index.where(F.col("missionType").isin(vocab.PRIMARY_MISSION_TYPES_WITH_DOCTOR))
    return cohort.by_terms(primary, "leadingDiagnosis", vocab.CHEST_PAIN_TERMS)


def ecg_in_chest_pain(index: DataFrame, ecgs: DataFrame, denominator: str = "rows") -> DataFrame:
    return cohort_share(chest_pain_cases(index), ecgs.where("performed"), denominator)


def stemi_cases(index: DataFrame) -> DataFrame:
    return cohort.by_terms(index, "leadingDiagnosis", ["stemi"], ["nstemi"])


def aspirin_in_stemi(index: DataFrame, measures: DataFrame, denominator: str = "rows", name: str = vocab.ASPIRIN) -> DataFrame:
    return cohort_share(stemi_cases(index), items.medications(measures, name), denominator)


def aspirin_doses(index: DataFrame, measures: DataFrame, name: str = vocab.ASPIRIN) -> DataFrame:
    given = joins.keep_ids(items.medications(measures, name), stemi_cases(index))
    return given.select("protocolId", "med_name", "dose", "dose_unit", "route")


def capnography_after_airway(intubations: DataFrame, co2: DataFrame, devices: Sequence[str] = vocab.CAPNOGRAPHY_DEVICES) -> DataFrame:
    """Secured airways with a device that allows capnography, and those with a value above 0."""
    return conditional_share(intubations.where(F.col("type").isin(list(devices))), co2.where(F.col("value") > 0))


def documentation_bundle(cases: DataFrame, documented: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """Share of cases with the asked number of entries of each kind, and of all kinds."""
    counts = measurement_counts(cases, {kind: df for kind, (df, _) in documented.items()}, 1)
    met = {f"{k}_met": F.col(f"{k}_count") >= least for k, (_, least) in documented.items()}
    counts = counts.withColumns(met).withColumn(
        f"{ALL_KINDS}_met", reduce(lambda a, b: a & b, [F.col(c) for c in met])
    )
    return coverage_shares(counts, list(documented))


def stroke_bundle(index: DataFrame, findings: DataFrame, results: DataFrame, measures: DataFrame, glucose: DataFrame, temperature: DataFrame) -> DataFrame:
    """Two scores, glucose, neurological signs, temperature, rhythm and onset in primary missions for a stroke."""
    primary = index.where(F.col("missionType").isin(vocab.PRIMARY_MISSION_TYPES))
    cases = cohort.by_terms(primary, "leadingDiagnosis", vocab.STROKE_TERMS)
    return documentation_bundle(cases, {
        "score": (items.scores(findings, vocab.ITEM_SCORE), 2),
        "glucose": (glucose, 1),
        "neuro": (items.neurological_signs(findings), 1),
        "temperature": (temperature, 1),
        "rhythm": (items.rhythms(measures), 1),
        "onset": (items.onsets(results), 1),
    })


def head_injury_bundle(index: DataFrame, findings: DataFrame) -> DataFrame:
    """Consciousness at the first finding, pupils and two scores in primary missions for a head injury."""
    primary = index.where(F.col("missionType").isin(vocab.PRIMARY_MISSION_TYPES))
    cases = cohort.by_terms(primary, "leadingDiagnosis", vocab.COHORT_TERMS["head_injury"])
    scores = items.scores(findings, vocab.ITEM_SCORE).where(F.col("value_num").isNotNull())
    return documentation_bundle(cases, {
        "consciousness": (scores.where(F.col("type") == vocab.FIRST_FINDING), 1),
        "pupils": (items.pupil_status(findings), 1),
        "score": (scores, 2),
    })


def pain_relief(pain: DataFrame, start: float = 5, drop: float = 2) -> DataFrame:
    """Protocols with a first score of at least ``start`` and those whose last one is lower than that
    or dropped by ``drop``; first and last by time, each protocol reduced map-side."""
    scored = pain.where(F.col("value_num").isNotNull() & F.col("timestamp").isNotNull())
    order = F.struct("timestamp", "value_num")
    ends = scored.groupBy("protocolId").agg(
        F.min_by("value_num", order).alias("initial"), F.max_by("value_num", order).alias("handover")
    )
    relieved = (F.col("handover") < start) | (F.col("initial") - F.col("handover") >= drop)
    return (
        ends.where(F.col("protocolId").isNotNull() & (F.col("initial") >= start))
        .agg(F.count(F.lit(1)).alias("cases"), F.count_if(relieved).alias("with_measure"))
        .withColumn("percent", summary.percent(F.col("with_measure"), F.col("cases")))
    )


def airway_with_anaesthetic(cases: DataFrame, intubations: DataFrame, medications: DataFrame, drugs: Sequence[str] = vocab.ANAESTHETICS) -> DataFrame:
    """Cases that have both a secured airway and one of the drugs."""
    name = F.coalesce("med_name", F.lit(""))
    substance = F.coalesce("substance", F.lit(""))
    given = medications.where(classify.term_match(name, drugs) | classify.term_match(substance, drugs))
    return conditional_share(cases, joins.keep_ids(intubations, given))
