"""Joins on plain equality; a null key links to nothing.

The only side with a broadcast hint is the list of heavy keys, whose length is bounded. Elsewhere Spark
broadcasts a side whose size it has measured to be below ``spark.sql.autoBroadcastJoinThreshold`` and
shuffles otherwise, and splits oversized partitions of left, semi, anti and inner joins at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import heavy


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "protocolId") -> DataFrame:
    """Rows of ``df`` whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def _suffixed(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    clashes = [c for c in right.columns if c in left.columns and c != key]
    return right.withColumnsRenamed({c: c + suffix for c in clashes})


def left_outer(left: DataFrame, right: DataFrame, key: str = "protocolId", suffix: str = "_y") -> DataFrame:
    """All left rows with their right rows; right columns that clash get ``suffix``."""
    return left.join(_suffixed(left, right, key, suffix), key, "left")


def left_by(left: DataFrame, right: DataFrame, left_key: str, right_key: str, by: Sequence[str] = ()) -> DataFrame:
    """All left rows with the right rows of an equal key; rows without a key take no part in the join.

    So the rows that link to nothing do not meet in one partition. Left rows of a heavy key are dealt over salts
    by the columns ``by`` (default: all), and its right rows are copied to each salt. No column name may occur on
    both sides.
    """
    pieces = F.coalesce("_pieces", F.lit(1))
    keys = F.broadcast(heavy.heavy_keys(left, left_key))
    keyed = left.where(F.col(left_key).isNotNull()).join(keys, F.col(left_key) == F.col("_heavy"), "left")
    keyed = keyed.withColumn("_salt", heavy.spot(left, by, pieces)).drop("_heavy", "_pieces")
    copies = right.join(keys, F.col(right_key) == F.col("_heavy"), "left")
    copies = copies.withColumn("_copy", F.explode(heavy.every(pieces))).drop("_heavy", "_pieces")
    same = (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_copy"))
    linked = keyed.join(copies, same, "left").drop("_salt", "_copy")
    return linked.unionByName(left.where(F.col(left_key).isNull()), allowMissingColumns=True)


def full_outer(left: DataFrame, right: DataFrame, key: str = "protocolId", suffix: str = "_y") -> DataFrame:
    """All rows of both sides on ``key``; right columns that clash get ``suffix``.

    Written as left join plus the unmatched right rows: unlike one full outer
    join, both halves can be split at run time when a key, or the null key,
    is oversized. A filter on left columns drops the second half altogether.
    Each input is read twice, the left one the second time for its key only;
    ``full_outer_once`` is for results that are wanted whole.
    """
    renamed = _suffixed(left, right, key, suffix)
    alone = renamed.join(left.select(key), key, "left_anti")
    return left.join(renamed, key, "left").unionByName(alone, allowMissingColumns=True)


def full_outer_once(
    left: DataFrame,
    right: DataFrame,
    key: str = "protocolId",
    suffix: str = "_y",
    by: tuple[Sequence[str], Sequence[str]] = ((), ()),
    counted: tuple[DataFrame | None, DataFrame | None] = (None, None),
) -> DataFrame:
    """The rows of ``full_outer`` from one full outer join: each input is read whole and shuffled once.

    Spark cannot split a key of such a join, so heavy keys are set apart before it. On the side that has more
    rows of such a key they are dealt over salts, on the other side its rows are copied to every salt. The key
    occurs on both sides then or on the dealt side alone, so a copy that meets nothing is dropped: it has met
    rows at another salt. Rows without a key are dealt over all partitions. ``by`` names the columns that tell
    rows of one key apart, left and right (default: all). Heavy keys come from a look at both key columns alone;
    ``counted`` gives frames to count them in where a side's key cannot be read without its costly columns.
    """
    renamed = _suffixed(left, right, key, suffix)
    one = F.lit(1)
    keys_of = [heavy.heavy_keys(c if c is not None else df, key) for c, df in zip(counted, (left, right))]
    sides = keys_of[0].select("_heavy", F.col("_pieces").alias("_own"), one.alias("_other"))
    sides = sides.unionByName(keys_of[1].select("_heavy", one.alias("_own"), F.col("_pieces").alias("_other")))
    larger = F.max_by(F.struct("_own", "_other"), F.greatest("_own", "_other"))
    keys = sides.groupBy("_heavy").agg(larger.alias("_larger")).select("_heavy", "_larger.*")
    everywhere = F.lit(heavy.partitions(left.sparkSession) * heavy.SALTS)

    def dealt(df: DataFrame, own: str, other: str, names: Sequence[str]) -> DataFrame:
        copies: Column = F.coalesce(other, one)
        pieces = F.when(F.col(key).isNull(), everywhere).otherwise(F.coalesce(own, one))
        salts = F.when(copies > 1, heavy.every(copies)).otherwise(F.array(heavy.spot(df, names, pieces)))
        rows = df.join(F.broadcast(keys), F.col(key) == F.col("_heavy"), "left")
        rows = rows.withColumns({"_copied": copies > 1, "_salts": salts}).drop("_heavy", "_own", "_other")
        return rows.withColumn("_salt", F.explode("_salts")).drop("_salts")

    a = dealt(left, "_own", "_other", by[0]).alias("a")
    b = dealt(renamed, "_other", "_own", by[1]).alias("b")
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._salt") == F.col("b._salt"))
    idle = (F.col("a._copied") & F.col("b._copied").isNull()) | (F.col("b._copied") & F.col("a._copied").isNull())
    joined = a.join(b, same, "full").where(~F.coalesce(idle, F.lit(False)))
    others = [F.col(f"{s}.`{c}`") for s, df in (("a", left), ("b", renamed)) for c in df.columns if c != key]
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *others)


def flag_members(df: DataFrame, members: DataFrame, flag: str, key: str = "protocolId") -> DataFrame:
    """Add a boolean column: the key occurs in ``members``."""
    ids = members.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(ids, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def dense_grid(keys: DataFrame, slots: dict[str, list], values: DataFrame, zero: list[str]) -> DataFrame:
    """Every key row times the fixed slots, ``values`` joined on, missing measures as zero."""
    grid = keys
    for name, entries in slots.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(e) for e in entries])))
    joined = grid.join(values, grid.columns, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def computed_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; the columns are computed before anything built on them.

    Filters on results of costly columns (parsed texts) are otherwise pushed
    down as copies of the whole expression, once per mention. A one-element
    ``inline`` is a step no filter passes.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns)))).select(*df.columns)
