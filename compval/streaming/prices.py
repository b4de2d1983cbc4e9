"""Listings that arrive as a stream: cleaning and price levels are stateless, duplicates need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compval.functions.scalars import sqm_price
from compval.operators.cleaning import realistic
from compval.operators.normalizers import Handcrafted, Normalizer


def cleaned_stream(listings: DataFrame) -> DataFrame:
    return listings.where(realistic()).withColumn("sqm", sqm_price())


def normalised_stream(listings: DataFrame, normalizer: Normalizer | None = None) -> DataFrame:
    return (normalizer or Handcrafted()).normalise(listings)


def distinct_stream(listings: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Each id once within the delay; state is bounded by the watermark."""
    return listings.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def level_stream(listings: DataFrame, time: str, window: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Mean square-metre price by area and window."""
    rows = listings.withColumn("sqm", sqm_price()).withWatermark(time, delay)
    return rows.groupBy(F.window(time, window), "ags0").agg(F.avg("sqm").alias("sqm"), F.count("*").alias("n"))
