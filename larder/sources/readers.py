"""Sources and sinks (A1, A2, A22) and dataset manifests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.common import require_columns

DISH_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name_en", "name_hi", "region", "category", "serving_unit")]
    + [
        T.StructField("serving_grams_default", T.DoubleType()),
        T.StructField(
            "macros_per_100g",
            T.StructType([T.StructField(n, T.DoubleType()) for n in ("kcal", "protein_g", "carbs_g", "fat_g", "fiber_g")]),
        ),
        T.StructField("ingredients_summary", T.StringType()),
        T.StructField("veg", T.BooleanType()),
        T.StructField("jain", T.BooleanType()),
        T.StructField("satvik", T.BooleanType()),
        T.StructField("contains", T.ArrayType(T.StringType())),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.StringType()),
        T.StructField("last_verified", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)


def read_csv(spark: SparkSession, path: str, required: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; every field is text unless ``schema`` types it (A1).

    Nothing is inferred, a byte-order mark before the first name is dropped, and
    all missing required columns are named in one error.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    require_columns(raw, required, path)
    if schema is None:
        return raw
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name in raw.columns])


def read_dishes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested dish records flattened to one row each (A2)."""
    raw = spark.read.schema(DISH_SCHEMA).option("multiLine", multi_line).json(path)
    return flatten_dishes(raw)


def flatten_dishes(raw: DataFrame) -> DataFrame:
    macros = {"calories_kcal_100g": "kcal", "protein_g_100g": "protein_g", "carbs_g_100g": "carbs_g", "fat_g_100g": "fat_g", "fiber_g_100g": "fiber_g"}
    return raw.select(
        F.col("id").alias("recipe_id"),
        F.col("name_en").alias("recipe_name"),
        F.coalesce("name_hi", F.lit("")).alias("name_hi"),
        "region",
        "category",
        "serving_unit",
        F.col("serving_grams_default").alias("serving_grams"),
        *[F.col(f"macros_per_100g.{src}").alias(name) for name, src in macros.items()],
        F.coalesce("ingredients_summary", F.lit("")).alias("ingredients"),
        *[F.coalesce(src, F.lit(False)).alias(name) for name, src in (("vegetarian", "veg"), ("jain", "jain"), ("satvik", "satvik"))],
        F.coalesce(F.array_join("contains", ", "), F.lit("")).alias("contains"),
        F.coalesce(F.array_join("sources", "; "), F.lit("")).alias("source"),
        "confidence",
        "last_verified",
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def write_table(df: DataFrame, path: str, order: Sequence[str], fmt: str = "parquet") -> None:
    """Write in key order (A22): a range-partitioned sort, so the files follow the order."""
    writer = df.orderBy(*order).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-free 32-bit-per-row content sum."""
    row = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    word = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    return df.select(word.alias("_w")).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("_w"), F.lit(0)).alias("checksum"))


def manifest(datasets: dict[str, DataFrame], schema_version: str = "1.0.0") -> DataFrame:
    """One row per dataset: rows, columns, schema version, content sum."""
    parts = [
        content_hash(df).select(
            F.lit(name).alias("dataset"), "row_count", F.lit(len(df.columns)).alias("column_count"),
            F.lit(schema_version).alias("schema_version"), "checksum",
        )
        for name, df in datasets.items()
    ]
    return reduce(DataFrame.unionByName, parts)
