"""Loading the six model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.sources import store
from tiffin.sources.schemas import KEYS, MODEL, fields

Model = dict[str, DataFrame]


def as_flag(value):
    """Boolean from 0/1, true/false or their text forms; NULL stays NULL."""
    return value.cast("string").try_cast("boolean")


def load_model(spark: SparkSession, folder: str) -> Model:
    """The published version of all six tables, read with declared schemas."""
    paths = store.table_paths(spark, folder)
    return {
        name: spark.read.schema(schema).parquet(paths.get(name, f"{folder}/{name}"))
        for name, schema in MODEL.items()
    }


def load_model_csv(spark: SparkSession, folder: str) -> Model:
    """Tables exported as CSV with a header; flags may be 0/1 or true/false."""
    model = {}
    for name, schema in MODEL.items():
        schema = fields(schema)
        flags = [field.name for field in schema if field.dataType.typeName() == "boolean"]
        ddl = ", ".join(
            f"{field.name} {'STRING' if field.name in flags else field.dataType.simpleString()}"
            for field in schema
        )
        rows = spark.read.schema(ddl).csv(f"{folder}/{name}", header=True)
        model[name] = rows.withColumns({flag: as_flag(F.col(flag)) for flag in flags})
    return model


def load_model_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str], bounds: dict[str, tuple[int, int]], partitions: int
) -> Model:
    """Tables read in parallel key ranges from the ordering database."""
    model = {}
    for name, schema in MODEL.items():
        low, high = bounds[name]
        rows = spark.read.jdbc(
            url,
            name,
            column=KEYS[name],
            lowerBound=low,
            upperBound=high,
            numPartitions=partitions,
            properties=properties,
        )
        model[name] = rows.select(
            *[
                (as_flag(F.col(f.name)) if f.dataType.typeName() == "boolean" else F.col(f.name).cast(f.dataType)).alias(
                    f.name
                )
                for f in fields(schema)
            ]
        )
    return model


def register_views(model: Model) -> None:
    """Make every table available to ``spark.sql``."""
    for name, df in model.items():
        df.createOrReplaceTempView(name)
