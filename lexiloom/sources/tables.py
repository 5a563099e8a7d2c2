"""Tables and the sections made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. One that's a single file has few row groups, and so few tasks: its rows are dealt out to all cores."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    df = table(spark, sf_dir, name)
    return df.repartition(spark.sparkContext.defaultParallelism) if one else df


def sections(docs: DataFrame) -> DataFrame:
    """One row per line of a document: doc_id, title, ordinal (from 0), text.

    The outer generator, as for the other one the optimizer adds a filter that evaluates its input once more below.
    """
    rows = docs.select("doc_id", F.col("source").alias("title"), F.posexplode_outer(F.split("text", "\n")).alias("ordinal", "text"))
    return rows.where("ordinal IS NOT NULL").withColumn("ordinal", F.col("ordinal").cast("long"))
