"""Transport-requirement analysis of anamnesis texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab
from pulsegrid.functions import classify, clean
from pulsegrid.operators import joins, summary
from pulsegrid.sources import items

NEEDS = ["medical_care", "ktw_equipment", "infectious_disease"]


def plain_transports(missions: DataFrame) -> DataFrame:
    """Patient transports proper: the word KTW, no S-KTW, no RTW."""
    return missions.where(classify.word_match(F.col("missionType"), "ktw", no_words=["rtw"], no_parts=["s-ktw"]))


def anamnesis_texts(freetexts: DataFrame, missions: DataFrame | None = None) -> DataFrame:
    """Items whose description mentions the anamnesis, optionally only of the given missions."""
    rows = items.texts(freetexts).where(classify.term_match(F.col("description"), [vocab.ITEM_ANAMNESIS]))
    return rows if missions is None else joins.keep_ids(rows, missions)


def classify_texts(
    texts: DataFrame,
    column: str = "content",
    fields: Mapping[str, Sequence[tuple[str, Sequence[str]]]] = vocab.REQUIREMENT_RULES,
    mention: tuple[str, str] = vocab.MENTION_RULE,
) -> DataFrame:
    """Add the label columns; the whole text is lower-cased once per row."""
    folded = texts.withColumn("_folded", F.lower(column))
    return folded.withColumns(classify.requirement_columns(F.col("_folded"), fields, mention)).drop("_folded")


def classify_texts_basic(texts: DataFrame, column: str = "content") -> DataFrame:
    return texts.withColumns(classify.basic_requirement_columns(F.col(column)))


def undocumented_share(labelled: DataFrame, fields: Sequence[str] = tuple(NEEDS)) -> DataFrame:
    """Texts that say nothing about any of the fields."""
    silent = F.col(fields[0]).isNull()
    for f in fields[1:]:
        silent = silent & F.col(f).isNull()
    return labelled.agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(silent).alias("undocumented")
    ).withColumn("percent", summary.percent(F.col("undocumented"), F.col("texts")))


def label_counts(labelled: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Texts per field and label, silent ones included, with display label; one pass over all fields."""
    long = labelled.select([F.col(f) for f in fields]).unpivot([], list(fields), "field", "code")
    counts = long.groupBy("field", "code").agg(F.count(F.lit(1)).alias("count"))
    shown = clean.relabel(F.col("code"), vocab.REQUIREMENT_LABELS, vocab.NO_ENTRY_LABEL)
    return counts.withColumn("label", F.concat(shown, F.lit(" ("), F.col("count").cast("string"), F.lit(")")))


def needs_per_text(labelled: DataFrame, fields: Sequence[str] = tuple(NEEDS), needed: str = "indiziert") -> DataFrame:
    """Number of texts by how many fields are indicated."""
    flags = [F.when(F.col(f) == needed, 1).otherwise(0) for f in fields]
    total = sum(flags[1:], flags[0])
    return labelled.groupBy(total.alias("categories_needed")).agg(F.count(F.lit(1)).alias("count"))


def indicated_totals(labelled: DataFrame, fields: Sequence[str] = tuple(NEEDS), needed: str = "indiziert") -> DataFrame:
    """Texts in which each field is indicated, one row per field."""
    one = labelled.agg(*[F.count_if(F.col(f) == needed).alias(f) for f in fields])
    return one.unpivot([], list(fields), "field", "indicated")


def overview(labelled: DataFrame, fields: Sequence[str] = tuple(NEEDS), needed: str = "indiziert") -> DataFrame:
    """All figures of the report as (measure, value), from one pass over the texts.

    Texts, silent ones with their percentage, documentation rate and indications per field, and texts
    by the number of fields indicated (numbers that occur).
    """
    silent = reduce(lambda a, b: a & b, [F.col(f).isNull() for f in fields])
    asked = sum((F.when(F.col(f) == needed, 1).otherwise(0) for f in fields), F.lit(0))
    texts = F.count(F.lit(1))
    figures = {"texts": texts, "undocumented": F.count_if(silent), "undocumented_percent": summary.percent(F.count_if(silent), texts)}
    figures |= {f"rate {f}": summary.percent(F.count(f), texts) for f in fields}
    figures |= {f"indicated {f}": F.count_if(F.col(f) == needed) for f in fields}
    figures |= {f"needs {n}": F.count_if(asked == n) for n in range(len(fields) + 1)}
    one = labelled.agg(*[c.cast("double").alias(name) for name, c in figures.items()])
    long = one.unpivot([], list(figures), "measure", "value")
    return long.where(~(F.startswith("measure", F.lit("needs ")) & (F.col("value") == 0)))


def documentation_rates(labelled: DataFrame, fields: Sequence[str] = tuple(NEEDS)) -> DataFrame:
    return summary.completeness(labelled, fields)
