"""Point layers as newline-delimited GeoJSON features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def features(df: DataFrame, *, lat: str = "latitude", lon: str = "longitude", properties: Sequence[str] | None = None) -> DataFrame:
    """One GeoJSON Feature per row in column ``value``; coordinates are longitude first."""
    props = list(properties) if properties is not None else [c for c in df.columns if c not in (lat, lon)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(feature).alias("value"))


def write_features(df: DataFrame, path: str, **kwargs) -> None:
    features(df, **kwargs).write.mode("overwrite").text(path)


LAYER = "layer"


def write_layers(layers: Mapping[str, DataFrame], path: str, **kwargs) -> None:
    """Every layer as files of features in a folder of its own; a rewrite replaces a layer whole. Rows without a position are no points."""
    for name, df in layers.items():
        write_features(df, f"{path}/{LAYER}={name}", **kwargs)


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """Rows (``layer``, ``value``) of all written layers."""
    return spark.read.schema(f"value string, {LAYER} string").text(path)
