"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Everything is DataFrame expressions. The patterns find assignments, access keys and long hexadecimal
runs. For the models, the strings those patterns find are samples labelled random, the other words of
the same texts are samples labelled ordinary; each label gets counts of character pairs. A run of
``LEAST`` or more key characters whose log-likelihood ratio reaches ``RATIO`` is one more span, of
kind ``markov``, unless it overlaps a pattern's span.

The model of random strings learns from every string the patterns find in any document, each counted once;
that of identifiers from the words of the documents whose id hashes into the first ``SAMPLE`` or so of all
(a documented bound on the ordinary rows). Every document, however long, is scanned whole. Without any
labelled string both models are alike and add nothing. Null text is empty; a null doc_id is hashed like any
other; repeated rows are scanned each; an empty table gives an empty result. Only doc_id and text are read, so
further columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole maximal runs, so a least length gives what dropping the shorter ones gives.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST, RATIO = 20, 20.0
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
WORDS = r"[A-Za-z0-9+/_=-]{6,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Documents whose words are examples of ordinary ones, about.
SAMPLE = 5000
#: Counts spread over the characters after each one: evenly in the model of random strings, by their
#: share in the model of identifiers.
EVEN, BACK = 68.0, 10.0


def text_of(documents: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def spans(text: Column, kind: int, pattern: str, ok) -> Column:
    """(kind, k, gap, size, ok) of each match: code points since the last match, and of the match."""
    gaps = F.split(text, pattern, -1)
    found = F.transform(
        matches(text, pattern),
        lambda m, k: F.struct(
            F.lit(kind).alias("kind"),
            k.alias("k"),
            F.char_length(F.element_at(gaps, k + 1)).alias("gap"),
            F.char_length(m).alias("size"),
            ok(m, k).alias("ok"),
        ),
    )
    # most texts have no match: these are neither split nor searched again
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,ok:boolean>>"))


def labelled(documents: DataFrame) -> DataFrame:
    """Distinct strings with y: 1 found by the patterns in any document, 0 other words met twice or more in the sampled ones."""
    every = max(1, documents.count() // SAMPLE)
    read = documents.select("doc_id", text_of(documents).alias("text"))
    sample = read.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(every)) == 0)
    t = F.col("text")
    random = F.concat(matches(t, ASSIGN, 2), matches(t, ACCESS), matches(t, HEX))
    ordinary = matches(F.regexp_replace(t, f"{ASSIGN}|{ACCESS}|{HEX}", " "), WORDS, 0)
    strings = read.where(t.rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(F.explode(random).alias("s"), F.lit(1).alias("y")).where(F.char_length("s") >= 16)
    # a word met once only may be random itself
    words = sample.select(F.explode(ordinary).alias("s")).groupBy("s").count().where("count > 1")
    return strings.distinct().unionByName(words.select("s", F.lit(0).alias("y")))


def codes(s: Column) -> Column:
    """Place of each character in ALPHABET, from 1."""
    return F.transform(F.split(s, "", -1), lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def pair_ratios(documents: DataFrame) -> list[float]:
    """Log of the ratio of both models' probabilities for each (character before or none, character)."""
    n = len(ALPHABET) + 1
    strings = labelled(documents).withColumn("codes", codes(F.col("s")))
    before = F.concat(F.array(F.lit(0)), F.slice("codes", 1, F.greatest(F.size("codes") - 1, F.lit(0))))
    # a pair counts once per string, so that one long monotonous string does not outweigh the rest
    both = F.arrays_zip(before.alias("a"), F.col("codes").alias("b"))
    pairs = strings.select("y", F.explode(F.array_distinct(both)).alias("p"))
    # at most two counts for each pair of characters
    counted = pairs.groupBy("y", "p.a", "p.b").agg(F.count("*").alias("n")).collect()
    counts = {(r.y, r.a, r.b): r.n for r in counted}
    # a character's share among identifiers, whatever comes before it
    alone = [sum(counts.get((0, a, b), 0) for a in range(n)) + 0.5 for b in range(n)]
    alone = [x / sum(alone[1:]) for x in alone]
    out = []
    for a in range(n):
        random_total = sum(counts.get((1, a, b), 0) for b in range(1, n)) + EVEN
        ordinary_total = sum(counts.get((0, a, b), 0) for b in range(1, n)) + BACK
        out.append(0.0)  # no character has code 0
        for b in range(1, n):
            random = (counts.get((1, a, b), 0) + EVEN / (n - 1)) / random_total
            ordinary = (counts.get((0, a, b), 0) + BACK * alone[b]) / ordinary_total
            out.append(math.log(random / ordinary))
    return out if any(y == 1 for y, _, _ in counts) else [0.0] * (n * n)


def log_ratio(s: Column, ratios: list[float]) -> Column:
    n = len(ALPHABET) + 1
    table = F.expr(f"array({', '.join(f'{r:.6f}D' for r in ratios)})")
    own = codes(s)
    before = F.concat(F.array(F.lit(0)), F.slice(own, 1, F.size(own) - 1))
    steps = F.zip_with(before, own, lambda a, b: F.element_at(table, a * n + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    ratios = pair_ratios(documents)
    always = lambda m, k: F.lit(True)
    text = F.col("text")
    read = documents.select(F.col("doc_id").cast("long"), text_of(documents).alias("text"), F.monotonically_increasing_id().alias("row"))
    values = matches(text, ASSIGN, 2)
    found = F.concat(
        spans(text, 0, ASSIGN, lambda m, k: F.char_length(F.element_at(values, k + 1)) >= 6),
        spans(text, 1, ACCESS, always),
        spans(text, 2, HEX, always),
        spans(text, 3, RUN, lambda m, k: log_ratio(m, ratios) >= RATIO),
    )
    rows = read.select("row", "doc_id", F.explode_outer(found).alias("m")).select("row", "doc_id", "m.*").repartition("row")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("k"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    base = F.col("ok") & (F.col("kind") < 3)
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    reached = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    next_start = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    free = ~F.coalesce((reached > F.col("start")) | (next_start < F.col("end")), F.lit(False))
    rows = rows.withColumn("keep", F.coalesce(F.col("ok") & ((F.col("kind") < 3) | F.coalesce(free, F.lit(True))), F.lit(False)))
    kept = F.when(F.col("keep"), F.struct("start", "kind", "end"))
    grouped = rows.groupBy("row", "doc_id").agg(
        *(F.count(F.when(F.col("keep") & (F.col("kind") == k), 1)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sort_array(F.collect_list(kept)).alias("all"),
    )
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])
    written_base = F.array_join(F.transform(F.filter("all", lambda x: x["kind"] < 3), name), ",")
    return grouped.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written_base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("all", name), ",").alias("spans"))
