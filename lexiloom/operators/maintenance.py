"""Upserts, deletions, queues of pending work, snapshots, and constraint checks as plans over plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def deletion(rows: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """deleted, freed (bytes), kept."""
    marked = rows.select(key, F.octet_length(text).alias("n")).join(gone.select(F.col(key).alias("g")).distinct(), F.col(key) == F.col("g"), "left")
    is_gone = F.col("g").isNotNull()
    return marked.agg(F.count_if(is_gone).alias("deleted"), F.coalesce(F.sum(F.when(is_gone, F.col("n"))), F.lit(0)).cast("long").alias("freed"), F.count_if(~is_gone).alias("kept"))


def pending(rows: DataFrame, done: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of rows with text that aren't done."""
    return rows.where(F.length(F.trim(text)) > 0).select(key).join(done.select(key), key, "left_anti")


def ready(rows: DataFrame, done: DataFrame, key: str = "doc_id") -> bool:
    """Whether nothing is pending."""
    return pending(rows, done, key).limit(1).count() == 0


def changes(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key, before, after (digests), change: what differs between two snapshots."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    a = before.select(F.col(key).alias("a"), digest(content).alias("before"))
    b = after.select(F.col(key).alias("b"), digest(content).alias("after"))
    rows = a.join(b, F.col("a") == F.col("b"), "full").where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").otherwise("update")
    return rows.select(F.coalesce("a", "b").alias(key), "before", "after", kind.alias("change"))


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, violations: how many rows break each rule; rules that hold aren't listed."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    return reduce(DataFrame.unionByName, parts).where("violations > 0")


def coverage(eligible: DataFrame, indexed: DataFrame, key: str = "doc_id") -> DataFrame:
    """eligible, indexed, status."""
    rows = eligible.select(key).distinct().join(indexed.select(F.col(key).alias("i")).distinct(), F.col(key) == F.col("i"), "left")
    out = rows.agg(F.count("*").alias("eligible"), F.count("i").alias("indexed"))
    return out.withColumn("status", F.when(F.col("indexed") == 0, "missing-index").when(F.col("indexed") < F.col("eligible"), "partial").otherwise("ready"))
