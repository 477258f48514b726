"""Pre-hospital interval report.

One interval table feeds all summaries. Intervals are whole microseconds up to
the last step, so sums and percentiles are exact and independent of task order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab
from pulsegrid.functions import classify, clean
from pulsegrid.operators import cohort, first, joins, percentiles, summary
from pulsegrid.sources import items, scans

# Interval name, first and last status.
PREHOSPITAL = "PraehospitalIntervall"
INTERVALS = {
    "ReaktionsIntervall": ("StatusAlarm", "Status4"),
    "VersorgungsIntervall": ("Status4", "Status7"),
    "TransportIntervall": ("Status7", "Status8"),
    "PraehospitalIntervall": ("StatusAlarm", "Status8"),
}
PARTS = ["ReaktionsIntervall", "VersorgungsIntervall", "TransportIntervall"]
TARGET_MINUTES = 60
PERCENTILE_NAMES = ["p10", "p25", "p50", "p75", "p90"]
MINUTE = 60_000_000.0

# A selection left as the report starts with; else a list of values, or None for all.
DEFAULT = "default"
Choice = Sequence | str | None


def interval_table(rows: DataFrame, spans: Mapping[str, tuple[str, str]] = INTERVALS) -> DataFrame:
    """Add each interval in microseconds; rows with a negative one are removed, null ones stay."""
    timed = rows.withColumns(
        {name: clean.micros_between(F.col(start), F.col(end)) for name, (start, end) in spans.items()}
    )
    return cohort.null_or_non_negative(timed, list(spans))


def _stops(spans: Mapping[str, tuple[str, str]]) -> list[str]:
    return sorted({status for span in spans.values() for status in span})


def missions(index: DataFrame, details: DataFrame, statuses: Sequence[str] = tuple(_stops(INTERVALS))) -> DataFrame:
    """All protocols of either collection with the named status timestamps."""
    times = scans.status_times(details, statuses)
    return joins.full_outer_once(index, times, by=(["missionNumber"], []), counted=(None, details))


def _with_details(selected: DataFrame, details: DataFrame) -> DataFrame:
    """Selected index rows with their status timestamps.

    A selection by mission type, diagnosis or year holds index rows only, so
    it is made before the join. Its ids reduce the details before their texts are
    parsed: only the texts of the cohort are, and no others move.
    """
    wanted = joins.keep_ids(details, selected)
    return joins.left_outer(selected, scans.status_times(wanted, _stops(INTERVALS)))


def select_missions(
    rows: DataFrame,
    mission_types: Sequence[str] | None = None,
    diagnoses: Sequence[str] | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """The report's three selections; an empty one filters nothing."""
    rows = scans.select_values(rows, "missionType", mission_types)
    rows = scans.select_values(rows, "leadingDiagnosis", diagnoses)
    return rows.where(F.year("missionDate").isin(list(years))) if years else rows


def selection(
    index: DataFrame,
    terms: Sequence[str] | None,
    mission_types: Choice = DEFAULT,
    diagnoses: Choice = DEFAULT,
    years: Choice = DEFAULT,
) -> DataFrame:
    """The report's three selections. Each is a list, ``None`` for all, or ``DEFAULT``: what the report
    shows before anything is chosen, which is primary missions, diagnoses with a term, the last two years.

    Defaults are derived from the whole table, all in one aggregate row used as a scalar subquery.
    """
    wanted = {}
    if mission_types == DEFAULT:
        wanted["missionType"] = F.coalesce(F.col("missionType").isin(vocab.PRIMARY_MISSION_TYPES), F.lit(False))
    if diagnoses == DEFAULT and terms:
        wanted["leadingDiagnosis"] = classify.term_match(F.col("leadingDiagnosis"), terms)
    rows = select_missions(
        index,
        None if mission_types == DEFAULT else mission_types,
        None if diagnoses == DEFAULT else diagnoses,
        None if years == DEFAULT else years,
    )
    return cohort.by_defaults(rows, wanted, "missionDate" if years == DEFAULT else None, among=index)


def cohort_intervals(index: DataFrame, details: DataFrame, terms: Sequence[str], **choices: Choice) -> DataFrame:
    """Interval table of the cohort of diagnosis ``terms``; ``choices`` as in ``selection``."""
    return interval_table(_with_details(selection(index, terms, **choices), details))


def resuscitation_intervals(index: DataFrame, details: DataFrame, results: DataFrame, **choices: Choice) -> DataFrame:
    """Interval table of missions with a confirmed resuscitation, one row per positive item."""
    positive = items.resuscitations(results).where("rea_status").select("protocolId", "rea_status")
    selected = selection(index.join(positive, "protocolId"), None, **choices)
    return interval_table(_with_details(selected, details))


def head_injury_intervals(
    index: DataFrame,
    details: DataFrame,
    findings: DataFrame,
    low: float = 3,
    high: float = 8,
    kind: str = vocab.FIRST_FINDING,
    **choices: Choice,
) -> DataFrame:
    """Interval table of head injuries whose consciousness score lies in the range."""
    scored = cohort.score_range(items.scores(findings, vocab.ITEM_SCORE), low, high, kind)
    selected = selection(index, vocab.COHORT_TERMS["head_injury"], **choices)
    return interval_table(_with_details(joins.keep_ids(selected, scored), details))


def valid(intervals: DataFrame, main: str = PREHOSPITAL) -> DataFrame:
    return intervals.where(F.col(main).isNotNull())


def percentile_table(
    intervals: DataFrame,
    names: Sequence[str] = tuple(INTERVALS),
    by: Sequence[str] = (),
    main: str = PREHOSPITAL,
    approx: bool = False,
) -> DataFrame:
    """10/25/50/75/90th percentile in minutes per interval (long form, one row per interval and group)."""
    long = summary.to_long(valid(intervals, main), by, names, "interval", "micros")
    compute = percentiles.sketched_percentiles if approx else percentiles.exact_percentiles
    table = compute(long, [*by, "interval"], "micros", percentiles.PERCENTILES, MINUTE)
    return percentiles.named_percentiles(table, PERCENTILE_NAMES)


def percentile_report(intervals: DataFrame, names: Sequence[str] = tuple(INTERVALS), **options) -> DataFrame:
    """Statistics by interval: a row per percentile, a column per interval, rounded to one decimal."""
    long = percentile_table(intervals, names, **options)
    rows = long.unpivot(["interval"], PERCENTILE_NAMES, "statistic", "minutes")
    return summary.to_table(rows.withColumn("minutes", F.round("minutes", 1)), "statistic", "interval", "minutes", names)


def target_share(
    intervals: DataFrame, by: Sequence[str] = (), main: str = PREHOSPITAL, target: float = TARGET_MINUTES
) -> DataFrame:
    """Missions, share within the target, median and its distance to the target, per group."""
    counted = percentiles.value_table(valid(intervals, main), by, main)
    within = F.sum(F.when(F.col("_v") <= int(target * MINUTE), F.col("_n")).otherwise(0))
    shares = counted.groupBy("_k").agg((within / F.sum("_n") * 100).alias("share_within"))
    median = F.col("percentiles")[0]
    return percentiles.keyed_percentiles(counted, [0.5], MINUTE).join(shares, "_k").select(
        *[F.col("_k")[b].alias(b) for b in by],
        "n",
        median.alias("median"),
        (median - F.lit(float(target))).alias("median_delta"),
        "share_within",
    )


def monthly_trend(
    intervals: DataFrame, ts: str = "missionDate", main: str = PREHOSPITAL, approx: bool = False
) -> DataFrame:
    """Median and quartiles per month."""
    rows = valid(intervals, main).where(F.col(ts).isNotNull()).withColumn("month", clean.month_start(F.col(ts)))
    compute = percentiles.sketched_percentiles if approx else percentiles.exact_percentiles
    table = compute(rows, ["month"], main, [0.25, 0.5, 0.75], MINUTE)
    return percentiles.named_percentiles(table, ["p25", "median", "p75"])


def process_shares(
    intervals: DataFrame, parts: Sequence[str] = tuple(PARTS), by: Sequence[str] = (), main: str = PREHOSPITAL
) -> DataFrame:
    """Mean minutes of each part over rows that have all parts, and its percentage of their sum."""
    whole = valid(intervals, main).na.drop(subset=list(parts))
    sums = whole.groupBy(*by).agg(
        # sums of microseconds outgrow 64 bits
        *[F.sum(F.col(p).cast("decimal(38,0)")).cast("double").alias(p) for p in parts], F.count(F.lit(1)).alias("_rows")
    ).where(F.col("_rows") > 0)
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    long = sums.withColumn("_total", total).unpivot([*by, "_rows", "_total"], list(parts), "interval", "_micros")
    return long.select(
        *by,
        "interval",
        (clean.minutes(F.col("_micros")) / F.col("_rows")).alias("mean_minutes"),
        summary.percent(F.col("_micros"), F.col("_total")).alias("share"),
    )


def long_form(intervals: DataFrame, ids: Sequence[str], names: Sequence[str] = tuple(INTERVALS), main: str = PREHOSPITAL) -> DataFrame:
    """(name, minutes) rows for the distribution chart, nulls left out."""
    long = summary.to_long(valid(intervals, main), ids, names, "interval", "micros")
    return long.select(*ids, "interval", clean.minutes(F.col("micros")).alias("minutes"))


def turn_out(details: DataFrame) -> DataFrame:
    """Interval from alarm to departure of the vehicle."""
    return interval_table(scans.status_times(details, ["StatusAlarm", "Status3"]), {"AusrueckIntervall": ("StatusAlarm", "Status3")})


def approach(rows: DataFrame, mission: str = "missionNumber") -> DataFrame:
    """Interval from departure to arrival of the first unit on scene per mission."""
    arrived = rows.where(F.col("Status4").isNotNull())
    on_scene = first.first_per_key(arrived, [mission], ["Status4", "protocolId", "Status3"])
    return interval_table(on_scene, {"AnfahrIntervall": ("Status3", "Status4")})
