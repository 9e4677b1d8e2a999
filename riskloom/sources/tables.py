"""Reading the driver tables and panel files."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of one driver table; selecting columns here lets the scan prune."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def load_panel(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None,
               **options) -> DataFrame:
    """Read a raw panel file (parquet by default, CSV with header as a fallback).

    A fixed ``schema`` avoids a schema-inference pass over the whole input.
    Excel and pickle inputs of the single-machine tool are not supported.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        options.setdefault("header", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(fmt).load(path)


def select_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep the listed columns that exist, in list order."""
    present = set(df.columns)
    return df.select(*[c for c in cols if c in present])
