"""Scraped feeds, dictionaries and raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sofralytics import schemas
from sofralytics.functions import fixed_values as fv


def read_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON-lines feed of scraped ``venues`` or ``reviews`` under the permissive bronze schema."""
    schema = {"venues": schemas.BRONZE_VENUE, "reviews": schemas.BRONZE_REVIEW}[kind]
    return spark.read.schema(schema).json(path)


def write_feed(items: DataFrame, path: str) -> None:
    items.write.mode("append").json(path)


def read_dish_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dish dictionary (one JSON array per file) with its load position."""
    rows = spark.read.schema(schemas.DISH_DICTIONARY).option("multiLine", True).json(path)
    return rows.filter(F.coalesce("canonical", F.lit("")) != "").withColumn("load_position", F.monotonically_increasing_id())


def read_filter_lists(spark: SparkSession, path: str) -> DataFrame:
    """(kind, keyword) rows of a beverage / side item list file."""
    kinds = (fv.ITEM_BEVERAGE, fv.ITEM_SIDE)
    schema = ", ".join(f"{kind} array<string>" for kind in kinds)
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    parts = [doc.select(F.lit(kind).alias("kind"), F.explode(kind).alias("keyword")) for kind in kinds]
    return parts[0].unionByName(parts[1])


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw pages as (page_id, url, html) from Parquet, or from one HTML file each."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("page_id", "url", "html")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return files.select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html")
    )
