"""The physical plans stay the ones that scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from benchset import registry, views
from pulsegrid.operators import joins, percentiles, summary
from pulsegrid.plans import anamnesis, intervals, requirements
from pulsegrid.sources import collections, items, scans

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_and_no_pair_products(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text, operator


def test_every_query_has_a_counterpart():
    assert set(registry.SQL) == set(registry.QUERIES) <= set(entry.queries())


def test_id_filter_is_a_semi_join(spark):
    index = views.index(spark, SF)
    assert "LeftSemi" in plan(scans.mission_index(index, ids=index.select("protocolId")))


def test_newest_rows_are_a_top_n(spark):
    text = plan(scans.mission_index(views.index(spark, SF), limit=5))
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text


def test_year_filter_and_columns_reach_the_scan(spark):
    rows = scans.mission_index(views.index(spark, SF), years=(1997, 1998)).select("protocolId")
    text = plan(rows)
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_item_extract_reads_only_its_item_fields(spark, tmp_path):
    views.results(spark, SF).write.parquet(str(tmp_path / "results"))
    text = plan(items.triage_score(collections.read_collection(spark, str(tmp_path), "results")))
    assert "value_2" in text and "timeStamp" not in text.split("ReadSchema")[1]


def test_building_a_query_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        for name in registry.QUERIES:
            if name not in ("materialised_metric", "stored_metrics_join"):  # these write tables
                registry.QUERIES[name](spark, SF)
        # reading a file's schema is the only job
        stages = [s for j in tracker.getJobIdsForGroup("building") for s in tracker.getJobInfo(j).stageIds]
        assert all(tracker.getStageInfo(s) is None or tracker.getStageInfo(s).name.startswith("parquet") for s in stages)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def scans_of(df) -> int:
    return plan(df).count("FileScan parquet")


def test_one_pass_over_the_texts(spark):
    labelled = requirements.classify_texts(requirements.anamnesis_texts(views.freetexts(spark, SF)))
    assert scans_of(requirements.overview(labelled)) == 1


def test_defaults_come_from_one_aggregate(spark):
    rows = intervals.selection(views.index(spark, SF), ["polytrauma"])
    rows.collect()
    final = plan(rows).split("== Initial Plan ==")[0]
    assert final.count("ReusedSubquery") >= 2


def test_percentiles_write_nothing_and_read_once(spark):
    lines = views.table(spark, SF, "lineitem").select(F.col("l_orderkey").alias("v"))
    found = percentiles.exact_percentiles(lines, [], "v")
    found.collect()
    text = plan(found)
    assert "ReusedExchange" in text and "/_shared" not in text


def test_top_per_group_limits_before_the_shuffle(spark):
    lines = views.table(spark, SF, "lineitem")
    assert "WindowGroupLimit" in plan(summary.top_per_group(lines, "l_returnflag", "l_suppkey", 5))


def test_interval_cohort_needs_no_full_outer_join(spark):
    text = plan(registry.QUERIES["interval_long"](spark, SF))
    assert "FullOuter" not in text and "LeftAnti" not in text


def test_hot_key_is_split_at_run_time(spark):
    """A third of all rows on one key: the oversized partition is read in pieces."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        left = spark.range(0, 300_000, 1, 8).select(key.alias("protocolId"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        right = spark.range(0, 3000, 1, 4).select(F.col("id").cast("string").alias("protocolId"), F.lit(1).alias("w"))
        right = right.union(spark.createDataFrame([("hot", 2), (None, 3)], "protocolId string, w int"))
        df = joins.full_outer(left, right)
        assert df.count() == 300_000 + 1 + 1000
        collected = joins.full_outer(left, right).agg(F.max("v"), F.max("w"))
        collected.collect()
        assert "skew=true" in plan(collected)
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def nodes(df):
    """All operators of the physical plan, planned without run-time changes."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        found.append(node)
        left += [node.children().apply(k) for k in range(node.children().size())]
    return found


@pytest.fixture
def static(spark):
    """Runtime re-planning and measured broadcasts off."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    yield
    for k, value in before.items():
        spark.conf.set(k, value)


def test_first_text_of_a_protocol_is_fetched_without_sorting_texts(spark, static):
    sorted_columns = {
        str(a) for n in nodes(anamnesis.protocol_texts(views.freetexts(spark, SF))) if n.nodeName().startswith("Sort")
        for a in str(n.output().mkString(",")).split(",")
    }
    assert not any(a.startswith(("text#", "content#", "value#", "data#", "comment#")) for a in sorted_columns)


def largest_share(df) -> float:
    """Share of all rows in the fullest partition."""
    sizes = df.groupBy(F.spark_partition_id()).count()
    return max(r["count"] for r in sizes.collect()) / df.count()


def test_heavy_keys_are_spread_without_run_time_splitting(spark, static):
    """A third of all rows on one key and a third without a key, on the left or on the right."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string"))
    many = spark.range(0, 60_000, 1, 8).select(key.alias("protocolId"), F.col("id").alias("v"))
    few = spark.range(0, 300, 1, 4).select(F.col("id").cast("string").alias("protocolId"), F.lit(1).alias("w"))
    few = few.union(spark.createDataFrame([("hot", 2), (None, 3)], "protocolId string, w int"))
    assert joins.full_outer_once(many, few).count() == 60_000 + 200 + 1
    for df in (joins.full_outer_once(many, few), joins.full_outer_once(few, many)):
        assert largest_share(df) < 0.25  # an even share is an eighth; unspread, the hot key and the null key hold a third each
    linked = joins.left_by(many, few.withColumnRenamed("protocolId", "other"), "protocolId", "other").where("protocolId = 'hot'")
    assert linked.count() == 20_000 and linked.where("w = 2").count() == 20_000 and largest_share(linked) < 0.4


def test_one_pass_full_outer_parses_each_side_once(spark, static):
    """Beside the join's two scans only the key columns are read, for the sketches of heavy keys."""
    df = registry.QUERIES["mission_details_full_outer"](spark, SF)
    joined = [n for n in nodes(df) if "Join" in n.nodeName() and "FullOuter" in n.toString().split("\n")[0]]
    assert len(joined) == 1
    scans = [str(n.output().mkString(",")) for n in nodes(df) if n.nodeName().startswith("Scan")]
    assert sum("l_shipdate" in s for s in scans) == 1 and sum("o_orderdate" in s for s in scans) == 1


def test_cohort_reduces_details_before_their_texts_are_parsed(spark):
    """Below every step that parses status texts, the details are first reduced to the cohort's ids."""
    steps = [line for line in plan(registry.QUERIES["interval_polytrauma"](spark, SF)).splitlines() if "Join" in line or "Generate" in line]
    parsed = [k for k, line in enumerate(steps) if "inline(array(struct(Status" in line]
    assert parsed and all("LeftSemi" in steps[k + 1] for k in parsed)
