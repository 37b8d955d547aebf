"""Reference tables: CSV to typed table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.sources.schemas import REFERENCE


def read_reference_csv(spark: SparkSession, path: str, table: str, *, schemas: Mapping[str, T.StructType] = REFERENCE) -> DataFrame:
    """CSV with a header, matched by column name and cast column by column to the declared type.

    Nothing is inferred: a month such as 2026-01 stays text. A column the file lacks is NULL.
    """
    raw = spark.read.csv(path, header=True)
    held = set(raw.columns)
    return raw.select(
        *[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) if f.name in held else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas[table]]
    )


def load_reference(spark: SparkSession, csv_dir: str, store: str, *, fmt: str = "parquet", schemas: Mapping[str, T.StructType] = REFERENCE) -> None:
    """Overwrite every reference table from its CSV file."""
    for table in schemas:
        df = read_reference_csv(spark, f"{csv_dir}/{table}.csv", table, schemas=schemas)
        df.write.mode("overwrite").format(fmt).save(f"{store}/{table}")
