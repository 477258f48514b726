"""Mixing sources to target sizes by certain whole copies and Pareto order sampling.

Documents of a source expect copies in proportion to their weight, ``MOST`` at the utmost, so that the
expected words are the source's target; ``mix_documents`` weighs by size, longer documents a little more,
since odds that follow size keep the words drawn close to the target. A document that expects e copies
is there floor(e) times for certain. The rest is a Pareto order sample: document i with inclusion
probability p_i = e - floor(e) draws a uniform u_i from a hash of its id and is ranked by
(u_i / (1 - u_i)) / (p_i / (1 - p_i)); the first ones are taken until their words reach what is left of
the target, with or without the one that passes it, whichever ends nearer. Only where both miss by more
than ``SLACK`` of the target, as in a small source with a very long document, is the order left: the long
one is passed over and the following ``NEXT`` are taken if they still fit. The cut is found on word sums of
2 ** DIGIT_BITS ranges of the rank, then of as many ranges within those: no source is sorted or gathered in
one task, and equal ranks and sizes are counted before they reach one.

Sources are ordered by code point, null last. Null and empty texts have size 0; long ones are counted
whole. Rows that repeat an id get one draw between them; of equal sizes among them, earlier rows are taken
first. An empty table gives an empty result. Only doc_id, source and text are read, so further columns
may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
KEY_BITS, DIGIT_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"
#: Share of its target that the words of a source may miss for the sake of the order.
SLACK = 0.001
#: Documents after the range of the cut, in rank order, that are tried for what is missing beyond that.
NEXT = 256
SEED = "mix-1"
#: Weights are rounded to this many steps per power of two, so that a source has a bounded number of them.
STEPS = 16


def word_count(text: Column) -> Column:
    """Number of words: starts of runs that are not white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target. ``sizes`` has one row per source (source, source_size).

    Sharing by weight with a ceiling, the excess shared again until nothing is above, ends where every
    target is min(ceiling, weight * level) with one level for all. Sources in order of ceiling / weight
    reach their ceiling first, which gives the level by running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("k", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("ceiling", (F.col("source_size") * most).cast("double"))
    filling = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("ceiling").over(below), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    # as long as sources are at their ceiling the level of the next one is higher, afterwards lower
    levelled = ranked.withColumn("level", level)
    target = F.least(F.col("ceiling"), F.col("weight") * F.max("level").over(everything))
    return levelled.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """60 bits of a hash of the seed and the id, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def rank_key(u: Column, p: Column) -> Column:
    """The Pareto rank u/(1-u) / (p/(1-p)) as 60 ordered bits: q / (1 + q) of it, so that equal ``p`` keeps the order of ``u``."""
    draw = (u.cast("double") + 0.5) / float(1 << KEY_BITS)
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    q = draw / (1 - draw) * ((1 - p) / p)
    return F.least(F.floor(q / (1 + q) * float(1 << KEY_BITS)), F.lit((1 << KEY_BITS) - 1)).cast("long")


def rounded(weight: Column) -> Column:
    """Null, negative and not finite weights are 0."""
    sound = (weight > 0) & (weight < float("inf"))
    return F.when(sound, F.pow(F.lit(2.0), F.round(F.log2(F.when(sound, weight)) * STEPS) / STEPS)).otherwise(0.0)


def size_weight(size: Column) -> Column:
    """From 1 for an empty text to about 2 for 65,536 words."""
    return 1 + F.log2(size + F.lit(1.0)) / 16


def levels(classes: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """source and level: with ``least(most, weight * level)`` copies of every document a source has its target.

    ``classes`` has source, weight and words of each weight. Heavier documents reach ``most`` first, so the
    level is found like that of ``targets``.
    """
    sized = classes.where("weight > 0 AND words > 0").alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
    heavier = Window.partitionBy("source").orderBy(F.col("weight").desc())
    full = F.coalesce(F.sum("words").over(heavier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum(F.col("weight") * F.col("words")).over(heavier.rowsBetween(0, Window.unboundedFollowing))
    return sized.select("c.*", "target").withColumn("level", (F.col("target") - full) / rest).groupBy("source").agg(F.max("level").alias("level"))


def digit(bits: int) -> Column:
    return F.shiftright("key", KEY_BITS - bits)


def near_cut(ranked: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """source, low, high, missing: ranges (first ``bits`` of the key) below ``low`` are taken whole, those from ``low`` to ``high`` hold the cut.

    ``ranked`` has source, size, key; ``wanted`` source and want. ``missing`` is what ``want`` lacks after
    the ranges below ``low``.
    """
    sums = ranked.groupBy("source", digit(bits).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    up_to = Window.partitionBy("source").orderBy("digit")
    sums = sums.withColumns({"end": F.sum("words").over(up_to), "seen": F.sum("n").over(up_to)})
    sums = sums.alias("d").join(wanted.alias("w"), F.col("d.source").eqNullSafe(F.col("w.source")))
    sums = sums.select("d.*", "want", (F.col("end") > F.col("want")).alias("passed"))
    cut = sums.groupBy("source").agg(
        F.min(F.when(F.col("passed"), F.col("digit"))).alias("low"),
        F.max(F.when(~F.col("passed"), F.col("end"))).alias("before"),
        F.coalesce(F.min(F.when(F.col("passed"), F.col("seen"))), F.lit(0)).alias("seen_low"),
        F.max("digit").alias("last"),
    )
    cut = cut.withColumn("low", F.coalesce("low", F.col("last") + 1))
    later = sums.select("source", "digit", "seen", "want").alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    enough = F.col("d.digit").between(F.col("low"), F.col("last")) & (F.col("d.seen") - F.col("seen_low") >= NEXT)
    return later.groupBy("c.source", "low").agg(
        F.coalesce(F.min(F.when(enough, F.col("d.digit"))), F.max("last")).alias("high"),
        (F.max("want") - F.coalesce(F.max("before"), F.lit(0))).alias("missing"),
    )


def fill(rows: pa.Table) -> pa.Table:
    """How many to take of each key and size near the cut of one source: in rank order up to the cut, see above."""
    missing, slack = (float(rows[c][0].as_py()) for c in ("missing", "slack"))
    groups = sorted(zip(*(rows[c].to_pylist() for c in ("key", "size", "n"))))
    taken = dict.fromkeys([g[:2] for g in groups], 0)
    nearer = None
    for key, size, n in groups:
        taken[key, size] = min(n, int(missing // size))
        missing -= taken[key, size] * size
        if nearer is None and taken[key, size] < n and min(missing, size - missing) <= slack:
            nearer = (key, size) if size < 2 * missing else ()
            break
    for key, size, n in groups:
        if nearer is None and taken[key, size] < n and size < 2 * missing:
            nearer = (key, size)
    if nearer:
        taken[nearer] += 1
    keys, sizes = zip(*taken)
    columns = [[rows["source"][0].as_py()] * len(taken), keys, sizes, list(taken.values())]
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("source", "key", "size", "take"), columns, (pa.string(), *[pa.int64()] * 3))})


def same(left: str, right: str, *columns: str) -> Column:
    """Rows of two aliased tables whose source, and further columns, are equal."""
    on = F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))
    for c in columns:
        on = on & (F.col(f"{left}.{c}") == F.col(f"{right}.{c}"))
    return on


def chosen(open_rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cut (source, bound: keys whose first bits are below it are taken) and the rows taken beyond it (source, row).

    ``open_rows`` has source, row, key and size, ``wanted`` source, want and slack.
    """
    first = written(near_cut(open_rows, wanted, DIGIT_BITS), "first-cut")
    near = open_rows.alias("r").join(first.alias("c"), same("r", "c"))
    near = near.where(digit(DIGIT_BITS).between(F.col("low"), F.col("high"))).select("r.*")
    second = written(near_cut(near, first.select("source", F.col("missing").alias("want")), 2 * DIGIT_BITS), "second-cut")
    bounds = first.alias("f").join(second.alias("s"), same("f", "s"), "left")
    bounds = bounds.select("f.source", F.coalesce("s.low", F.shiftleft("f.low", DIGIT_BITS)).alias("bound"))
    ends = second.alias("s").join(wanted.alias("w"), same("s", "w")).select("s.*", "slack")
    edge = near.alias("r").join(ends.alias("c"), same("r", "c"))
    edge = edge.where(digit(2 * DIGIT_BITS).between(F.col("low"), F.col("high"))).select("r.*", "missing", "slack")
    counted = edge.groupBy("source", "key", "size", "missing", "slack").agg(F.count("*").alias("n"))
    taken = counted.groupBy("source").applyInArrow(fill, "source string, key long, size long, take long").where("take > 0")
    sizes = written(counted.alias("n").join(taken.alias("t"), same("n", "t", "key", "size")).select("t.*", "n"), "edge")
    rows = edge.alias("r").join(sizes.alias("t"), same("r", "t", "key", "size")).select("r.source", "row", "r.key", "r.size", "n", "take")
    place = F.row_number().over(Window.partitionBy("source", "key", "size").orderBy("row"))
    partly = rows.where("take < n").withColumn("place", place).where("place <= take")
    return bounds, rows.where("take = n").select("row").unionByName(partly.select("row"))


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``rows`` (doc_id, source, size, optional weight, any others) with source_size, target and copies.

    With ``weight`` a document's expected copies follow it within its source, else they are equal.
    Documents without weight are taken only where the others do not suffice.
    """
    weight = rounded(F.col("weight").cast("double")) if "weight" in rows.columns else F.lit(1.0)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("_weight", weight), "sized")
    classes = written(rows.groupBy("source", F.col("_weight").alias("weight")).agg(F.sum("size").alias("words")), "classes")
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = written(goal, "targets")
    goal = goal.alias("g").join(levels(classes, goal, most).alias("l"), same("g", "l"), "left")
    goal = written(goal.select("g.*", F.coalesce("level", F.lit(0.0)).alias("level")), "levels")
    joined = rows.alias("r").join(goal.alias("g"), same("r", "g"))
    joined = joined.select("r.*", "source_size", "target", F.least(F.col("level") * F.col("_weight"), F.lit(float(most))).alias("expected"))
    # what rounding takes from a whole number is given back
    joined = joined.withColumn("certain", F.floor(F.col("expected") + 1e-9))
    ranked = joined.withColumn("key", rank_key(uniform(F.col("doc_id"), seed), F.col("expected") - F.col("certain")))
    certain = ranked.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("certain"))).alias("want"), (F.max("target") * SLACK).alias("slack"))
    is_open = (F.col("certain") < most) & (F.col("size") > 0)
    bounds, beyond = chosen(ranked.where(is_open).select("source", "row", "key", "size"), written(certain, "want"))
    near = ranked.alias("r").join(bounds.alias("b"), same("r", "b"), "left").select("r.*", "bound")
    out = near.join(written(beyond.withColumn("chosen", F.lit(1)), "beyond"), "row", "left")
    extra = F.when(is_open & (digit(2 * DIGIT_BITS) < F.col("bound")), 1).otherwise(F.coalesce("chosen", F.lit(0)))
    return out.select(*[c for c in rows.columns if c not in ("row", "_weight")], "source_size", "target", (F.col("certain") + extra).cast("int").alias("copies"))


def sized(documents: DataFrame, *kept: str) -> DataFrame:
    """doc_id, source, size and weight of every document."""
    read = documents.select(*kept, F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"))
    return read.withColumn("weight", size_weight(F.col("size")))


def mix_documents(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(sized(documents)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_rows(documents: DataFrame) -> DataFrame:
    """``documents`` with every row as often as the mix takes it."""
    numbered = written(documents.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    copies = mix(sized(numbered, "_row")).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"))
    return numbered.join(copies, "_row").select(*documents.columns)
