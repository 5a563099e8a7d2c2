"""Registered queries that run as streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from lexiloom.sources.tables import sections, table
from lexiloom.streaming.backfill import backfill, windowed

QUERIES: dict = {}
ORACLES: dict = {}


def _work(spark) -> str:
    """A folder that driver and executors share: where checkpoints go, or, locally, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lexiloom-stream-")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/backfill-{uuid.uuid4().hex}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return at.toString()


def backfill_available_now(spark, sf_dir):
    """The sections of documents, by a file stream that ends when all files are done."""
    source, work = f"{sf_dir}/documents.parquet", _work(spark)
    schema = spark.read.parquet(source).schema
    source = f"{sf_dir}/documents.parque[t]"  # a pattern may match a single file, too
    backfill(spark, source, schema, lambda df: sections(df).groupBy("doc_id").agg(F.count("*").alias("sections")), f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out").select("doc_id", "sections")


QUERIES["backfill_available_now"] = backfill_available_now
ORACLES["backfill_available_now"] = "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS sections FROM documents"


def event_windows(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events"), size="1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


QUERIES["event_windows"] = event_windows
ORACLES["event_windows"] = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
