"""Reading and writing the tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """CSV with a header and quoted JSON cells, under a declared schema.

    Quoted cells may span lines, which makes a file unsplittable: land big tables as
    Parquet, or as many CSV files.
    """
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def read_parquet(spark: SparkSession, path, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> None:
    """Whole-table or appending write. CSV quotes like the tables the readers expect."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
