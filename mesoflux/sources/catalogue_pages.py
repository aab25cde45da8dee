"""Listings of archived days and links in HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_links(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """(page_id, link): the first group of every match."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("link"))


def catalog_days(pages: DataFrame, prefix: str = "sky", since: str | None = None, until: str | None = None) -> DataFrame:
    """(day, name): one row a day of ``prefix-YYYYMMDD.mp4`` names; impossible dates are skipped."""
    names = pages.select(F.explode(F.regexp_extract_all("html", F.lit(rf"({prefix}-\d{{8}}\.mp4)"), F.lit(1))).alias("name"))
    days = names.withColumn("day", F.expr("cast(try_to_timestamp(substring(name, -12, 8), 'yyyyMMdd') as date)")).where("day IS NOT NULL")
    if since is not None:
        days = days.where(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        days = days.where(F.col("day") <= F.lit(until).cast("date"))
    return days.groupBy("day").agg(F.min("name").alias("name"))
