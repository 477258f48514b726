"""Reading collections with declared schemas."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.schemas import COLLECTIONS

Tables = Mapping[str, DataFrame]


def read_collection(spark: SparkSession, root: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """One collection under ``root`` with its declared schema; absent columns are null.

    The declared schema also lets the scan read only the nested fields a query uses.
    """
    schema = COLLECTIONS[name]
    return spark.read.schema(schema).format(fmt).options(**options).load(os.path.join(root, name))


def read_tables(spark: SparkSession, root: str, names: list[str] | None = None, fmt: str = "parquet") -> Tables:
    return {n: read_collection(spark, root, n, fmt) for n in names or COLLECTIONS}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Give an in-memory collection the declared columns and types, absent ones as null.

    A column that already has its type is passed through uncast, which keeps
    reads of single nested fields cheap.
    """
    declared = StructType.fromDDL(COLLECTIONS[name])
    have = {f.name.lower(): f.dataType.simpleString() for f in df.schema}
    columns = []
    for field in declared:
        column = F.col(f"`{field.name}`") if field.name.lower() in have else F.lit(None)
        if have.get(field.name.lower()) != field.dataType.simpleString():
            column = column.cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)
