"""Session settings, the shared folder, and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning carries the skew handling: joins below are left, semi,
# anti or inner, the kinds whose oversized partitions Spark splits by itself.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def build_session(app: str = "pulsegrid", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the session's warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back, so later readers rescan the file only."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
