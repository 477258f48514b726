"""Matching of free-text names against a table of name variants, first variant wins.

A variant matches a name when either contains the other, so matching is the search for contained texts, both
ways. A contained text is looked up under one of its pieces only, the one that the fewest of the searched texts
hold; a text whose rarest piece nobody holds is out at once. A piece is the text itself up to seven code points
and more than four fifths of a longer one, so what holds a piece mostly holds the text, however many texts there are.
Candidates pass the exact test. Only distinct names are cut; callers join the result back.

Cut texts are many times the table they come from, whose size is all that is known of them before they are cut.
Their joins are therefore merge joins: nothing that grows with the names or variants is sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _piece_size(text: Column) -> Column:
    """The number of code points with all but its three highest binary digits cleared: four sizes between powers of two."""
    length = F.char_length(text)
    cleared = F.greatest(F.length(F.bin(length)) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", length, cleared), cleared)


def _pieces(text: Column, sizes: Column) -> Column:
    """Hashes of the distinct pieces of the given sizes; equal pieces have equal hashes, and a false meeting only adds a candidate."""
    length = F.char_length(text)
    fitting = F.filter(sizes, lambda size: size <= length)
    return F.array_distinct(
        F.flatten(F.transform(fitting, lambda size: F.transform(F.sequence(F.lit(1), length - size + 1), lambda at: F.xxhash64(F.substring(text, at, size)))))
    )


def containment_candidates(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Pairs of which the hay holds the needle's rarest piece.

    ``needles`` has distinct non-empty ``needle``, ``hays`` distinct non-empty ``hay``; further columns are carried along.
    """
    sizes = needles.agg(F.collect_set(_piece_size(F.col("needle")))).scalar()
    held = hays.withColumn("_sizes", sizes)
    held = held.select(*hays.columns, F.explode(_pieces(F.col("hay"), F.col("_sizes"))).alias("piece"))
    frequency = held.groupBy("piece").agg(F.count(F.lit(1)).alias("_n"))
    own = needles.select("*", F.explode(_pieces(F.col("needle"), F.array(_piece_size(F.col("needle"))))).alias("piece"))
    counted = own.join(frequency.hint("merge"), "piece", "left").withColumn("_rarest", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "piece"))
    rarest = counted.groupBy(*needles.columns).agg(F.min("_rarest").alias("_rarest")).where("_rarest.n > 0")
    return rarest.select(*needles.columns, F.col("_rarest.piece").alias("piece")).join(held.hint("merge"), "piece").drop("piece")


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Pairs of which the hay contains the needle."""
    return containment_candidates(needles, hays).where(F.contains(F.col("hay"), F.col("needle")))


def match_names(names: DataFrame, name: str, variants: DataFrame) -> DataFrame:
    """Best variant for each distinct ``name``: columns ``name``, ``rank``, ``granted``.

    ``variants`` has unique non-empty ``variant`` plus ``rank`` and ``granted``;
    the smallest rank wins. Names without a match are absent.
    """
    variants = variants.where(F.char_length("variant") > 0)
    distinct = names.select(F.col(name)).where(F.char_length(name) > 0).distinct()
    listed = variants.select("variant", "rank")
    holds = contained(listed.withColumnRenamed("variant", "needle"), distinct.withColumnRenamed(name, "hay"))
    held = contained(distinct.withColumnRenamed(name, "needle"), listed.withColumnRenamed("variant", "hay"))
    pairs = holds.select(F.col("hay").alias(name), "rank", F.col("needle").alias("variant"))
    pairs = pairs.unionByName(held.select(F.col("needle").alias(name), "rank", F.col("hay").alias("variant")))
    best = pairs.groupBy(name).agg(F.min(F.struct("rank", "variant")).alias("_best"))
    best = best.select(name, F.col("_best.rank").alias("rank"), F.col("_best.variant").alias("variant"))
    return best.join(variants.select("variant", "granted").hint("merge"), "variant").select(name, "rank", "granted")
