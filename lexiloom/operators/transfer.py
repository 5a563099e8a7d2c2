"""Library packages: a folder of Parquet with a manifest of sizes and hashes, checked before anything is taken in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

KIND, VERSION = "library-package", 5
#: Room that a transfer needs besides three times its documents.
RESERVE = 64 << 20


class BadPackage(ValueError):
    """The package's manifest or contents break a rule; the rules are its arguments."""


def manifest(documents: DataFrame) -> DataFrame:
    """id, bytes, sha256 of every document (id, title, text)."""
    return documents.select(F.col("id").cast("string").alias("id"), F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def written(documents: DataFrame, folders: DataFrame, placed: DataFrame, path: str) -> None:
    for name, df in (("documents", documents), ("folders", folders), ("placed", placed), ("manifest", manifest(documents))):
        df.write.parquet(f"{path}/{name}")
    spark = documents.sparkSession
    spark.createDataFrame([(json.dumps({"kind": KIND, "schemaVersion": VERSION}),)], "value string").coalesce(1).write.text(f"{path}/kind")


def estimate(documents: DataFrame) -> DataFrame:
    """documents, bytes, reserve."""
    n = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")
    return documents.agg(F.count("*").alias("documents"), n.alias("bytes"), (n * 3 + RESERVE).alias("reserve"))


def broken_rules(documents: DataFrame, listed: DataFrame, folders: DataFrame, placed: DataFrame) -> DataFrame:
    """rule, id: every document, folder or place that breaks a rule."""
    own = manifest(documents).select("id", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    both = own.join(listed, "id", "full")
    up = folders.select(F.col("id").alias("u"), F.col("depth").alias("above"))
    tree = folders.join(up, F.col("parent_id") == F.col("u"), "left")
    where = placed.join(folders.select(F.col("id").alias("f")), F.col("folder_id") == F.col("f"), "left")
    ids = F.col("id").cast("string")
    rules = {
        "listed": both.where(F.col("sha256").isNull()).select(ids.alias("id")),
        "present": both.where(F.col("s").isNull()).select(ids.alias("id")),
        "content": both.where((F.col("s") != F.col("sha256")) | (F.col("b") != F.col("bytes"))).select(ids.alias("id")),
        "hash": listed.where(~F.col("sha256").rlike("^[0-9a-f]{64}$")).select(ids.alias("id")),
        "once": listed.groupBy("id").count().where("count > 1").select(ids.alias("id")),
        "name": folders.where((F.trim("name") == "") | (F.length("name") > 80)).select(ids.alias("id")),
        "depth": tree.where((F.col("depth") < 0) | (F.col("depth") > 4) | (F.col("depth") != F.coalesce(F.col("above") + 1, F.lit(0)))).select(ids.alias("id")),
        "place": where.where(F.col("folder_id").isNotNull() & F.col("f").isNull()).select(F.col("document_id").cast("string").alias("id")),
    }
    out = None
    for name, df in rules.items():
        part = df.select(F.lit(name).alias("rule"), "id")
        out = part if out is None else out.unionAll(part)
    return out


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, folders, placed of a package that keeps all rules."""
    kind = json.loads(spark.read.text(f"{path}/kind").first()[0])
    if kind.get("kind") != KIND or not 1 <= kind.get("schemaVersion", 0) <= VERSION:
        raise BadPackage("kind")
    documents, folders, placed, listed = (spark.read.parquet(f"{path}/{n}") for n in ("documents", "folders", "placed", "manifest"))
    broken = sorted({r.rule for r in broken_rules(documents, listed, folders, placed).select("rule").distinct().collect()})  # as many as rules
    if broken:
        raise BadPackage(*broken)
    return documents, folders, placed


def deduplicated(documents: DataFrame, ours: DataFrame) -> DataFrame:
    """The package's documents that we don't have (by id)."""
    return documents.join(ours.select("id"), "id", "left_anti")
