"""The driver's tables in the roles of the archive's stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.exprs import html_title, url_domain
from lumenfold.operators import stats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    filename = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "pages").withColumn("domain", url_domain("url")).withColumn("filename", filename)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_title("html").alias("title")).where("title is not null")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where("page_id % 10 <> 3")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain, filename): most pages, some of them twice."""
    held = pages(spark, sf_dir)
    row = lambda mark: [F.concat(F.lit(mark), F.col("page_id").cast("string")).alias("id"), "domain", "filename"]
    return held.where("page_id % 7 <> 2").select(*row("d")).union(held.where("page_id % 11 = 0").select(*row("x")))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics table, with a stale source."""
    stale = spark.createDataFrame([("gone.example", 4)], "source string, file_count long")
    return stats.count_by_source(pages(spark, sf_dir).where("page_id % 5 <> 4")).union(stale)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "running").when(
        F.col("event_type") == "error", "failed"
    ).otherwise("success")
    url = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example/"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), url.alias("url"), status.alias("status"), F.col("ts").alias("created_at"))
