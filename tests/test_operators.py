import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import cohort, first, flows, heavy, joins, percentiles, summary
from pulsegrid.operators.variants import contained, containment_candidates, match_names


def test_first_and_latest_per_key(frame, rows):
    df = frame([("a", 2, "x"), ("a", 1, None), ("b", None, "n"), ("b", 3, "y"), (None, 1, "z")], "k string, o int, v string")
    assert rows(first.first_per_key(df.na.drop(subset=["o"]), ["k"], ["o"])) == [("a", 1, None), ("b", 3, "y")]
    assert rows(first.latest_per_key(df, ["k"], ["o"])) == [("a", 2, "x"), ("b", 3, "y")]


def test_full_outer_equals_the_built_in_join(spark, rows):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("c", 11), ("c", 12), (None, 13)], "k string, v int")
    got = joins.full_outer(left, right, "k")
    want = left.join(right.withColumnRenamed("v", "v_y"), "k", "full")
    assert got.columns == ["k", "v", "v_y"]
    assert rows(got) == rows(want)


def many_keys(spark, seed):
    """Two tables with a key that is heavy on the left, one on the right, one on both, null keys and lone keys."""
    rng = random.Random(seed)
    left = ["l"] * 40 + ["both"] * 9 + [None] * 15 + [f"k{rng.randrange(30)}" for _ in range(40)]
    right = ["r"] * 30 + ["l"] * 2 + ["both"] * 7 + [None] * 12 + [f"k{rng.randrange(40)}" for _ in range(30)] + ["r2"] * 12
    left += ["r"] * 3
    a = spark.createDataFrame([(k, n) for n, k in enumerate(left)], "k string, v int")
    return a, spark.createDataFrame([(k, n) for n, k in enumerate(right)], "k string, v int")


@pytest.mark.parametrize("seed", range(3))
def test_one_pass_full_outer_equals_the_built_in_join(spark, rows, seed):
    left, right = many_keys(spark, seed)
    assert {r["_heavy"] for r in heavy.heavy_keys(left, "k").collect()} >= {"l"}
    want = left.join(right.withColumnRenamed("v", "v_y"), "k", "full")
    for a, b in ((left, right), (left.limit(0), right), (left, right.limit(0))):
        got = joins.full_outer_once(a, b, "k")
        want = a.join(b.withColumnRenamed("v", "v_y"), "k", "full")
        assert got.columns == ["k", "v", "v_y"] and rows(got) == rows(want)
    assert rows(joins.full_outer_once(left, right, "k", by=(["v"], ["v_y"]))) == rows(joins.full_outer(left, right, "k"))


@pytest.mark.parametrize("seed", range(3))
def test_left_join_of_heavy_keys(spark, rows, seed):
    left, right = many_keys(spark, seed)
    right = right.toDF("k2", "w")
    assert rows(joins.left_by(left, right, "k", "k2")) == rows(left.join(right, left.k == right.k2, "left"))
    assert joins.left_by(left.limit(0), right, "k", "k2").count() == 0


def test_first_rows_equal_first_per_key(spark, rows):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", "c", None]), rng.choice([None, "x", "y"]), n, rng.choice([None, "text", ""])) for n in range(60)]
    df = spark.createDataFrame(data, "k string, o string, pos int, v string")
    assert rows(first.first_rows(df, ["k"], ["o", "pos"]), "k", "o", "pos", "v") == rows(first.first_per_key(df, ["k"], ["o", "pos"]))


def test_top_n_other_sums_to_the_total(frame):
    values = [f"v{i:02d}" for i in range(14) for _ in range(14 - i)] + ["tie1"] * 4 + ["tie0"] * 4 + [None] * 9
    df = frame([(v,) for v in values], "v string")
    got = summary.top_n_other(df, "v", 10).collect()
    assert len(got) == 11
    assert sum(r["count"] for r in got) == len(values) - 9
    assert [r["v"] for r in got][:10] == [f"v{i:02d}" for i in range(10)]
    assert summary.top_n_other(frame([("a",), ("b",)], "v string"), "v", 10).count() == 2


def test_value_counts_null(frame, rows):
    df = frame([("a",), (None,), (None,)], "v string")
    assert rows(summary.value_counts(df, "v")) == [("a", 1)]
    assert rows(summary.value_counts(df, "v", keep_null=True)) == sorted([("a", 1), (None, 2)], key=repr)


def test_completeness_and_yes_no(frame, rows):
    df = frame([("ja", "x"), ("nein", None), (None, None), ("Ja", "y")], "a string, b string")
    assert rows(summary.completeness(df, ["a", "b"])) == [("a", 75.0), ("b", 50.0)]
    assert rows(summary.yes_no_table(df, {"A": "a", "B": "b"})) == [("A", 1, 1, 2), ("B", 0, 0, 0)]


def test_weekday_hour_table_sums_to_the_rows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table = summary.weekday_hour_table(events, "ts").collect()
    assert sum(r[f"h{h:02d}"] for r in table for h in range(24)) == events.count()
    assert {r["weekday_number"] for r in table} <= set(range(7))


PS = [0.1, 0.25, 0.5, 0.75, 0.9]


@pytest.mark.parametrize("seed", range(3))
def test_exact_percentiles_equal_numpy(spark, seed):
    rng = random.Random(seed)
    groups = {
        "wide": [rng.randrange(-(2**50), 2**50) for _ in range(301)],
        "narrow": [rng.randrange(0, 5) * 60_000_000 for _ in range(250)],
        "one": [7],
        "two": [1, 2**42],
        None: [rng.randrange(10**9) for _ in range(20)],
        "mostly one value": [5] * 400 + [rng.randrange(2**45) for _ in range(3)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("empty", None)], "g string, v bigint")
    got = {r["g"]: (r["n"], r["percentiles"]) for r in percentiles.exact_percentiles(df, ["g"], "v", PS).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g][0] == len(values)
        assert got[g][1] == pytest.approx(list(np.percentile(values, [p * 100 for p in PS])), rel=1e-12, abs=1e-6)
        assert got[g][1] == sorted(got[g][1])


def test_exact_percentiles_without_groups(spark):
    values = [3, 1, 2, 10]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    row = percentiles.exact_percentiles(df, [], "v", [0.5], unit=2.0).first()
    assert (row["n"], row["percentiles"]) == (4, [1.25])
    assert percentiles.exact_percentiles(df.where("v > 99"), [], "v", [0.5]).count() == 0


def test_match_names_equals_brute_force(spark):
    rng = random.Random(5)
    letters = "abc "
    names = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(150)} | {"", "nordklinik"}
    variants = {}
    for i in range(40):
        variants.setdefault("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))), (i, {"x": i % 2 == 0}))
    variants["nord"] = (99, {"x": True})
    df = spark.createDataFrame([(n,) for n in names for _ in range(2)] + [(None,)], "name string")
    table = spark.createDataFrame([(v, *rest) for v, rest in variants.items()], "variant string, rank int, granted map<string,boolean>")
    got = {r["name"]: (r["rank"], r["granted"]) for r in match_names(df, "name", table).collect()}
    want = {}
    for n in names - {""}:
        hits = [rest for v, rest in variants.items() if v in n or n in v]
        if hits:
            want[n] = min(hits, key=lambda h: h[0])
    assert got == want


def test_dense_grid(frame, rows):
    keys = frame([("a",), ("b",)], "k string")
    values = frame([("a", "x", 5)], "k string, s string, n int")
    got = joins.dense_grid(keys, {"s": ["x", "y"]}, values, ["n"])
    assert rows(got) == [("a", "x", 5), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0)]


def test_flag_members(frame, rows):
    df = frame([("a",), ("b",), (None,)], "protocolId string")
    members = frame([("a",), ("a",), (None,)], "protocolId string")
    assert rows(joins.flag_members(df, members, "m")) == sorted([("a", True), ("b", False), (None, False)], key=repr)


def test_flow_totals_balance(frame):
    df = frame([("a", "b"), ("a", "b"), ("b", "c"), (None, "c"), ("c", None)], "s string, t string")
    flow = flows.flow_counts(df, "s", "t")
    nodes = {r["node"]: (r["outgoing"], r["incoming"], r["total"]) for r in flows.node_totals(flow, "s", "t").collect()}
    assert nodes == {"a": (2, 0, 2), "b": (1, 2, 3), "c": (0, 1, 1)}
    numbered = flows.number_nodes(flows.node_totals(flow, "s", "t"))
    assert sorted(r["index"] for r in numbered.collect()) == [0, 1, 2]


def test_default_cohorts(frame, rows):
    df = frame([("b",), ("a",), ("Polytrauma X",), (None,)], "v string")
    assert rows(cohort.default_by_terms(df, "v", ["polytrauma"])) == [("Polytrauma X",)]
    assert rows(cohort.default_by_terms(df, "v", ["sepsis"])) == [("Polytrauma X",)]  # smallest value
    assert rows(cohort.default_by_values(df, "v", ["b", "z"])) == [("b",)]
    assert rows(cohort.default_by_values(df, "v", ["z"])) == [("Polytrauma X",)]
    assert rows(cohort.contains_or_exact(df, "v", "trauma", "poly", "a")) == [("a",)]


def test_last_years(frame, rows):
    import datetime as dt

    df = frame([(dt.datetime(y, 5, 1),) for y in (2020, 2022, 2022, 2024)] + [(None,)], "ts timestamp_ntz")
    assert {r[0].year for r in cohort.last_years(df, "ts").collect()} == {2022, 2024}


def test_null_or_non_negative(frame, rows):
    df = frame([(1, 1), (None, 0), (-1, 5), (None, -2), (None, None)], "a int, b int")
    assert rows(cohort.null_or_non_negative(df, ["a", "b"])) == sorted([(1, 1), (None, 0), (None, None)], key=repr)


def test_top_per_group_ranks_ties_by_value(frame, rows):
    df = frame([("g", "b"), ("g", "a"), ("g", "c"), ("g", "c"), ("h", "x"), (None, "x"), ("h", None)], "g string, v string")
    got = summary.top_per_group(df, "g", "v", 2)
    assert rows(got, "g", "v", "count", "rank") == [("g", "a", 1, 2), ("g", "c", 2, 1), ("h", "x", 1, 1)]


def test_sketched_percentiles_close_to_exact(spark):
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    got = percentiles.sketched_percentiles(df, ["g"], "v", PS).first()["percentiles"]
    assert all(math.isclose(a, p * 100_000, abs_tol=25) for a, p in zip(got, PS))


def test_first_split_is_even(spark):
    """All values within minutes, one group, and one of them far out: parts go by rank, not by width."""
    values = spark.range(0, 200_000).select((F.col("id") * 27_000).alias("v"))
    for df in (values, values.union(spark.createDataFrame([(250_000_000_000_000_000,)], "v bigint"))):
        counted = percentiles.value_table(df, [], "v")
        split = percentiles.split_parts(counted.withColumn("_part", F.lit(0).cast("bigint")), percentiles.first_parts(counted, [0.5]))
        sizes = [r["count"] for r in split.groupBy("_part").count().collect()]
        assert sum(sizes) == df.count() and max(sizes) < 3 * 200_000 / percentiles.PARTS
        for cuts, most in ((1, 600), (2, 20)):
            walked = percentiles.last_values(counted, [0.1, 0.5, 0.9], cuts).groupBy("_k", "_part").count().agg(F.max("count")).first()[0]
            assert walked <= most


def test_percentiles_of_skewed_values_equal_numpy(spark):
    """Exponentially spread values, heavy repeats and an outlier, in two groups of unequal size."""
    rng = random.Random(9)
    groups = {"a": [int(2 ** rng.uniform(0, 61)) for _ in range(30_000)] + [-(2**62)], "b": [rng.choice([5, 5, 5, 6, 10**15]) for _ in range(5000)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v bigint")
    counted, ps = percentiles.value_table(df, ["g"], "v"), [0.0, *PS, 1.0]
    for cuts in (1, 2):
        got = {r["_k"]["g"]: r["percentiles"] for r in percentiles.keyed_percentiles(counted, ps, cuts=cuts).collect()}
        for g, values in groups.items():
            values.sort()
            for p, value in zip(ps, got[g]):
                at = (len(values) - 1) * p
                low, high = float(values[math.floor(at)]), float(values[math.ceil(at)])
                assert value == low + (high - low) * (at - math.floor(at))


def test_percentiles_of_a_range_wider_than_64_bits(spark):
    df = spark.createDataFrame([(-(2**63),), (0,), (2**63 - 1,)], "v bigint")
    assert percentiles.exact_percentiles(df, [], "v", [0.0, 0.5, 1.0]).first()["percentiles"] == [-float(2**63), 0.0, float(2**63)]


def test_sketch_ranks(spark):
    df = spark.range(0, 50_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"))
    values = sorted(r[0] for r in df.collect())
    got = percentiles.sketched_percentiles(df, [], "v", accuracy=1000).first()["percentiles"]
    for p, v in zip(percentiles.PERCENTILES, got):
        assert abs(sum(x <= v for x in values) / len(values) - p) <= 2 / 1000


def test_containment_candidates_stay_near_the_matches(spark):
    """A beginning that all variants share and one very short variant: the shared piece is never looked up."""
    variants = spark.range(0, 3000).select(F.format_string("customer number %06d ward", "id").alias("needle"))
    variants = variants.union(spark.createDataFrame([("q",)], "needle string"))
    names = spark.range(0, 3000, 7).select(F.format_string("customer number %06d ward east", "id").alias("hay"))
    for needles, hays in ((variants, names), (names.select(F.substring("hay", 1, 24).alias("needle")), variants.withColumnRenamed("needle", "hay"))):
        candidates, matches = containment_candidates(needles, hays).count(), contained(needles, hays).count()
        assert matches >= 429 and candidates <= 4 * matches


def test_match_names_of_very_different_lengths(spark):
    names = ["a", "ab" * 700, "b" * 63, "c", "é日本語 clinic"]
    variants = ["b", "ab" * 350, "xbbx" * 40, "b" * 64, "日本", "clinic é日本語 clinic west", "a" * 5]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    table = spark.createDataFrame([(v, i, {"x": True}) for i, v in enumerate(variants)], "variant string, rank int, granted map<string,boolean>")
    got = {r["name"]: r["rank"] for r in match_names(df, "name", table).collect()}
    want = {n: min(i for i, v in enumerate(variants) if v in n or n in v) for n in names if any(v in n or n in v for v in variants)}
    assert got == want


def test_containment_candidates_of_short_texts_stay_near_the_matches(spark):
    """Seven digits that fewer digits would not tell apart."""
    numbers = spark.range(0, 20000).select((F.col("id") * 7919 % 10000000).alias("n"))
    hays = numbers.select(F.format_string("customer#%09d", "n").alias("hay"))
    needles = numbers.select(F.format_string("%07d", "n").alias("needle"))
    candidates, matches = containment_candidates(needles, hays).count(), contained(needles, hays).count()
    assert matches >= 20000 and candidates <= 2 * matches


def test_names_and_their_pieces_are_not_broadcast(spark):
    names = spark.range(0, 300).select(F.format_string("house %03d", "id").alias("name"))
    table = spark.range(0, 300).select(F.format_string("%03d", "id").alias("variant"), F.col("id").alias("rank"), F.lit(True).alias("granted"))
    best = match_names(names, "name", table)
    assert {r["name"]: r["rank"] for r in best.collect()} == {f"house {k:03d}": k for k in range(300)}
    assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()
