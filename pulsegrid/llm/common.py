"""Helpers shared by the operators: tables, written intermediate results, connected components."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a session without the setting uses its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts lineage, survives lost executors, and fixes values that depend on the partitioning, such as
    row numbers. Clearing the folder is left to whoever owns it.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Spark jobs run inside hand Python workers at most ``most`` rows at once; whole texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a Python worker remembers from one task to the next, by the module that uses it.
KEPT: dict[str, dict] = {}


def forget(keeps: str | None = None) -> None:
    for name, memory in KEPT.items():
        if name != keeps:
            memory.clear()


def tidy(run, keeps: str | None = None):
    """``run`` over Arrow batches that forgets what other modules remember and gives memory back at the end.

    Python workers are kept for later tasks; what they and their allocators hold would add to those.
    """

    def inner(batches):
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


def text_bytes(column: pa.Array):
    """Each text as UTF-8 bytes; null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``nodes`` has distinct ``id``; ``edges`` has ``a`` and ``b``. Returns ``id`` and ``component_id``,
    the smallest id reachable. Every step is a minimum per node and a join back, so the neighbours of
    one node are never gathered; a step is a written table, so lineage stays short.
    """
    links = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = written(links, "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        links = written(small, "links")
        new = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    roots = links.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(roots, nodes.id == roots.u, "left").select("id", F.coalesce("m", "id").alias("component_id"))
