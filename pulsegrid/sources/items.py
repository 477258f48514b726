"""Named metrics out of documents with a nested ``data`` array of items.

Every extract explodes the array once, keeps the wanted items and projects the
metric's columns, so the scan reads just the item fields in use. A field that
exists on the document and on the item is taken from the document first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab
from pulsegrid.functions import clean
from pulsegrid.operators import first

FINDINGS = "protocols_findings"
RESULTS = "protocols_results"
MEASURES = "protocols_measures"

# Text fields of a free-text item in order of preference; then its other text fields.
TEXT_FIELDS = ["text", "content", "value", "data"]
OTHER_TEXT_FIELDS = ["comment"]


def zipped(fields: Sequence[str]) -> Column:
    """The ``data`` array cut down to the given item fields, so that the scan reads no others."""
    return F.arrays_zip(*[F.col(f"data.`{f}`") for f in fields])


def exploded(documents: DataFrame, *fields: str) -> DataFrame:
    """One row per item: document id, protocol, document source, array position, item struct.

    Documents with an empty or null array have no item and give no row.
    """
    return documents.select(
        "_id", "protocolId", F.col("source").alias("doc_source"), F.posexplode(zipped(fields)).alias("pos", "item")
    )


def _source() -> Column:
    return F.coalesce("doc_source", "item.source").alias("source")


def scores(findings: DataFrame, name: str) -> DataFrame:
    """Numeric finding (consciousness score, pain) with finding type and time."""
    return (
        exploded(findings, "description", "valueInteger", "type", "timeStamp", "source")
        .where(F.col("item.description") == name)
        .select(
            "protocolId",
            F.lit(name).alias("metric"),
            clean.to_number(F.col("item.valueInteger")).alias("value_num"),
            F.col("item.type").alias("type"),
            F.col("item.timeStamp").alias("timestamp"),
            _source(),
            F.lit(FINDINGS).alias("collection"),
        )
    )


def neurological_signs(findings: DataFrame) -> DataFrame:
    return scores(findings, vocab.ITEM_NEURO)


def pupil_status(findings: DataFrame) -> DataFrame:
    """First left and first right reaction per protocol; time and source are the left item's."""
    item = F.col("item")
    is_left = item["description"] == vocab.ITEM_PUPIL_LEFT
    is_right = item["description"] == vocab.ITEM_PUPIL_RIGHT
    order = F.struct("_id", "pos")

    def earliest(side: Column, value: Column) -> Column:
        return F.min_by(F.when(side, value), F.when(side, order))

    left = F.struct(
        item["valueString"].alias("reaction"), item["timeStamp"].alias("timestamp"), item["source"].alias("source")
    )
    return (
        exploded(findings, "description", "valueString", "timeStamp", "source")
        .where((is_left | is_right) & F.col("protocolId").isNotNull())
        .groupBy("protocolId")
        .agg(
            earliest(is_left, left).alias("left"),
            earliest(is_right, F.struct(item["valueString"].alias("reaction"))).alias("right"),
        )
        .select(
            "protocolId",
            F.lit("Pupillenstatus").alias("metric"),
            F.col("left.reaction").alias("left_reaction"),
            F.col("right.reaction").alias("right_reaction"),
            F.col("left.timestamp").alias("timestamp"),
            F.col("left.source").alias("source"),
            F.lit(FINDINGS).alias("collection"),
        )
    )


def triage_score(results: DataFrame) -> DataFrame:
    return (
        exploded(results, "value_1", "value_2", "source")
        .where(F.col("item.value_1") == vocab.ITEM_TRIAGE)
        .select(
            "protocolId",
            F.lit(vocab.ITEM_TRIAGE).alias("metric"),
            F.col("item.value_2").alias("NACA-Score"),
            _source(),
            F.lit(RESULTS).alias("collection"),
        )
    )


def symptom_onset(results: DataFrame) -> DataFrame:
    """Last date, last time and last specification per protocol, from one aggregation.

    A value that is neither date nor time is the onset if there is no other. Source and time come
    from the last onset item that has them, else from the specification.
    """
    name, value = F.col("item.value_1"), F.col("item.value_2")
    is_onset = name == vocab.ITEM_ONSET
    is_spec = name == vocab.ITEM_ONSET_SPEC
    source = F.coalesce("item.source", "doc_source")
    filled = (value != "") & value.isNotNull()
    kind = clean.onset_kind(value)
    order = F.struct("_id", "pos")

    def last(result: Column, condition: Column) -> Column:
        return F.max_by(F.when(condition, result), F.when(condition, order))

    spec = F.struct(value.alias("text"), source.alias("source"), F.col("item.timeStamp").alias("timestamp"))
    per_protocol = (
        exploded(results, "value_1", "value_2", "timeStamp", "source")
        .where(is_onset | (is_spec & filled))
        .where(F.col("protocolId").isNotNull())
        .groupBy("protocolId")
        .agg(
            last(value, is_onset & (kind == "date")).alias("date"),
            last(value, is_onset & (kind == "time")).alias("time"),
            last(value, is_onset & (kind == "other")).alias("other"),
            last(source, is_onset & (source != "")).alias("onset_source"),
            last(F.col("item.timeStamp"), is_onset & F.col("item.timeStamp").isNotNull()).alias("onset_timestamp"),
            last(spec, is_spec).alias("spec"),
        )
    )
    return per_protocol.select(
        "protocolId",
        F.lit(vocab.ITEM_ONSET).alias("metric"),
        F.coalesce(F.nullif(F.concat_ws(" ", "date", "time"), F.lit("")), "other").alias("onset_time"),
        "date",
        "time",
        F.col("spec.text").alias("specification"),
        F.coalesce("onset_timestamp", "spec.timestamp").alias("timestamp"),
        F.coalesce("onset_source", "spec.source").alias("source"),
        F.lit(RESULTS).alias("collection"),
    )


def resuscitations(results: DataFrame) -> DataFrame:
    """Triage score 6 and answered resuscitation items, every item a row, status as boolean."""
    name, value = F.col("item.value_1"), F.col("item.value_2")
    origin = F.when((name == vocab.ITEM_TRIAGE) & (value == "6"), "NACA 6").when(
        name == vocab.ITEM_RESUSCITATION, "Reanimation field"
    )
    performed = (origin == "NACA 6") | F.coalesce(value == "ja", F.lit(False))
    columns = [
        "protocolId",
        F.lit("Reanimation").alias("metric"),
        performed.alias("rea_status"),
        origin.alias("source_metric"),
        F.col("item.timeStamp").alias("timestamp"),
        _source(),
        F.lit(RESULTS).alias("collection"),
    ]
    return exploded(results, "value_1", "value_2", "timeStamp", "source").where(origin.isNotNull()).select(*columns)


def resuscitations_with_destination(results: DataFrame, index: DataFrame) -> DataFrame:
    """Latest positive case per protocol with the destination of its newest index row."""
    positive = resuscitations(results).where("rea_status")
    latest = first.latest_per_key(positive, ["protocolId"], ["timestamp", "source_metric"])
    newest = first.latest_per_key(
        index.select("protocolId", "targetDestination", "missionDate"),
        ["protocolId"],
        ["missionDate", "targetDestination"],
    )
    return latest.join(newest.drop("missionDate"), "protocolId", "left")


def medications(measures: DataFrame, pattern: str | None = None) -> DataFrame:
    """Medication items; ``pattern`` is a regular expression on name or substance, any case."""
    wanted = F.col("item.value_1") == vocab.ITEM_MEDICATION
    if pattern:
        expression = f"(?iu){pattern}"
        wanted = wanted & (F.col("item.value_2").rlike(expression) | F.col("item.value_6").rlike(expression))
    return (
        exploded(measures, "value_1", "value_2", "value_3", "value_4", "value_5", "value_6", "timeStamp", "source")
        .where(wanted)
        .select(
            "protocolId",
            F.lit(vocab.ITEM_MEDICATION).alias("metric"),
            F.col("item.value_2").alias("med_name"),
            F.col("item.value_3").alias("route"),
            clean.to_number(F.col("item.value_4")).alias("dose"),
            F.col("item.value_5").alias("dose_unit"),
            F.col("item.value_6").alias("substance"),
            F.col("item.timeStamp").alias("timestamp"),
            _source(),
            F.lit(MEASURES).alias("collection"),
        )
    )


def intubations(measures: DataFrame) -> DataFrame:
    """Intubation items with a device, from documents that hold an airway item."""
    with_airway = measures.where(F.exists("data.value_1", lambda name: name == vocab.ITEM_AIRWAY))
    return (
        exploded(with_airway, "value_2", "value_3", "value_4", "value_8", "timeStamp", "source")
        .where((F.col("item.value_2") == vocab.ITEM_INTUBATION) & F.col("item.value_3").isNotNull())
        .select(
            "protocolId",
            F.lit(vocab.ITEM_INTUBATION).alias("metric"),
            F.col("item.value_3").alias("type"),
            F.col("item.value_4").alias("size"),
            F.col("item.value_8").alias("applicant"),
            F.col("item.timeStamp").alias("timestamp"),
            _source(),
            F.lit(MEASURES).alias("collection"),
        )
    )


def twelve_lead_ecgs(measures: DataFrame) -> DataFrame:
    """12-lead ECG items; a documented one counts as performed."""
    return (
        exploded(measures, "value_1", "value_2", "value_3", "timeStamp", "source")
        .where((F.col("item.value_1") == vocab.ITEM_MONITORING) & (F.col("item.value_2") == vocab.ITEM_ECG))
        .select(
            "protocolId",
            F.lit(vocab.ITEM_ECG).alias("metric"),
            F.lit(True).alias("performed"),
            F.col("item.value_3").alias("result"),
            F.col("item.timeStamp").alias("timestamp"),
            _source(),
            F.lit(MEASURES).alias("collection"),
        )
    )


def rhythms(measures: DataFrame) -> DataFrame:
    """Protocols of monitoring items that record the heart rhythm, 12-lead or not."""
    wanted = (F.col("item.value_1") == vocab.ITEM_MONITORING) & F.col("item.value_2").contains("EKG")
    return exploded(measures, "value_1", "value_2").where(wanted).select("protocolId")


def onsets(results: DataFrame) -> DataFrame:
    """Protocols of symptom-onset items, filled in or not."""
    return exploded(results, "value_1").where(F.col("item.value_1") == vocab.ITEM_ONSET).select("protocolId")


def extended_measures(measures: DataFrame) -> DataFrame:
    return (
        exploded(measures, "value_1", "value_2", "value_10", "value_11", "timeStamp", "source")
        .where(F.col("item.value_11") == vocab.ITEM_EXTENDED)
        .select(
            "protocolId",
            F.lit(vocab.ITEM_EXTENDED).alias("metric"),
            F.col("item.value_1").alias("type"),
            F.col("item.value_2").alias("description"),
            F.col("item.value_10").alias("applicant"),
            F.col("item.timeStamp").alias("timestamp"),
            _source(),
            F.lit(MEASURES).alias("collection"),
        )
    )


def vitals(documents: DataFrame, code: str) -> DataFrame:
    """Vital-sign series from nested or flat documents; an empty array keeps one null row."""
    fields = ["value", "unit", "%", "o2Administration", "description", "timeStamp", "source"]
    rows = documents.select("protocolId", *[f"`{f}`" for f in fields], F.explode_outer(zipped(fields)).alias("item"))

    def either(field: str) -> Column:
        return F.coalesce(F.col(f"`{field}`"), F.col(f"item.`{field}`"))

    return rows.select(
        "protocolId",
        F.lit(code).alias("metric"),
        either("value").alias("value"),
        F.coalesce(either("unit"), either("%")).alias("unit"),
        either("o2Administration").alias("o2Administration"),
        either("description").alias("description"),
        either("timeStamp").alias("timestamp"),
        either("source").alias("source"),
        F.lit(f"vitals_{code}").alias("collection"),
    )


def texts(documents: DataFrame) -> DataFrame:
    """Free-text items with the item's own protocol id, else the document's."""
    fields = [*TEXT_FIELDS, *OTHER_TEXT_FIELDS]
    items = F.posexplode(zipped(["protocolId", "description", *fields])).alias("pos", "item")
    return documents.select("_id", F.col("protocolId").alias("doc_protocol"), items).select(
        "_id",
        "pos",
        F.coalesce("item.protocolId", "doc_protocol").alias("protocolId"),
        F.col("item.description").alias("description"),
        *[F.col(f"item.{f}").alias(f) for f in fields],
    )
