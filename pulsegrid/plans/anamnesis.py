"""Structured extraction from anamnesis texts, run as a batch.

Each distinct text is prompted once; the answers come back as a table keyed by
``text_key`` and are fanned out to all protocols that share the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab
from pulsegrid.functions import text as txt
from pulsegrid.operators import first, joins, summary
from pulsegrid.sources import items


def protocol_texts(freetexts: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """First anamnesis item per protocol with its text, optionally only of linked protocols.

    The text is the first field that is not blank, in the order ``text``, ``content``, ``value``,
    ``data``, then any other text field of the item. Items without one are left out.
    """
    rows = items.texts(freetexts).where(F.col("description") == vocab.ITEM_ANAMNESIS)
    if linked is not None:
        rows = joins.keep_ids(rows, linked)
    chosen = txt.pick_text([F.col(c) for c in items.TEXT_FIELDS], [F.col(c) for c in items.OTHER_TEXT_FIELDS])
    rows = rows.where(F.col("protocolId") != "").select("protocolId", "_id", "pos", chosen.alias("text"))
    return (
        first.first_rows(rows, ["protocolId"], ["_id", "pos"])
        .where(F.col("text").isNotNull())
        .select("protocolId", "text", txt.text_key(F.col("text")).alias("text_key"))
    )


def distinct_texts(texts: DataFrame) -> DataFrame:
    """One row per text: its key, the first protocol that has it, and how many do.

    Copies of a text are combined map-side, so a text that fills a third of the
    table still shuffles once per map task.
    """
    return texts.groupBy("text_key").agg(
        F.min("protocolId").alias("protocolId"),
        F.first("text").alias("text"),
        F.count(F.lit(1)).alias("copies"),
    )


def prompts(texts: DataFrame, template: str = vocab.PROMPT) -> DataFrame:
    """Request text per distinct text, to be answered outside."""
    return distinct_texts(texts).select("text_key", "protocolId", txt.prompt(F.col("text"), template).alias("prompt"))


def parse_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Twelve field columns out of each answer text; the other columns stay."""
    paired = answers.withColumn("_pairs", F.reverse(txt.answer_pairs(F.col(column))))
    split = paired.withColumns({"_keys": F.col("_pairs.key"), "_values": F.col("_pairs.value")})
    split = joins.computed_once(split, ["_keys", "_values"])
    return split.withColumns(txt.answer_columns(F.col("_keys"), F.col("_values"))).drop("_pairs", "_keys", "_values", column)


def fan_out(texts: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every protocol with the parsed answer to its whole text, the text, and its beginning for display."""
    shown = texts.select(
        F.col("protocolId").alias("einsatz_id"),
        "text_key",
        F.col("text").alias("anamnesis_text"),
        txt.preview(F.col("text")).alias("anamnesis_preview"),
    )
    return shown.join(parsed, "text_key").drop("text_key")


def case_counts(results: DataFrame) -> DataFrame:
    """Cases, and those whose answers mention an assault, medical help or a refusal."""

    def mentions(field: str, word: str):
        return F.count_if(F.lower(field).contains(word))

    return results.agg(
        F.count(F.lit(1)).alias("cases"),
        mentions("übergriff_vorhanden", "ja").alias("assaults"),
        mentions("hilfebedarf_typ", "medizinisch").alias("medical_help"),
        mentions("verweigerung_vorhanden", "ja").alias("refusals"),
    )


def field_counts(results: DataFrame, field: str) -> DataFrame:
    return summary.value_counts(results, field)


def yes_no_summary(results: DataFrame) -> DataFrame:
    """Yes, no and their sum per category, with the percentage of all cases that say yes."""
    cases = results.agg(F.count(F.lit(1))).scalar()
    table = summary.yes_no_table(results, vocab.ANSWER_CATEGORIES)
    return table.withColumn("percent", summary.percent(F.col("yes"), cases))
