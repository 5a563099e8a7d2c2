"""Exact deduplication over an extendible-hash index in shared files.

Every text is normalised (runs of [\\x20\\x09-\\x0D] become one space; null counts as empty) and gets a 64-bit key.
The index holds one entry per distinct key and digest, pre-aggregated, so a text with a billion copies is one entry.
Its directory starts with one bucket and doubles: a bucket of more than `capacity` keys splits on the next bit of the
key until none is overfull. Every key is placed by the directory, and everything after that happens in its bucket:

1. An owner task has whole buckets of the index, and so whole ranges of keys. It chains the entries of equal keys; chains of more
   than one row are written, by bucket.
2. The directory places the texts of chained keys in their buckets. Equal bytes are combined map-side, so that a bucket gets a text
   once a task, and its owner compares the texts of a chain byte by byte, and names the row that stays. Texts of other keys
   are never shuffled.
3. Rows find their bucket by the directory, and what their chain decided in it.

Defined results: null text = empty text, and all empty texts are copies of each other; rows without doc_id take part in
groups, but only stay if no row of the group has an id; rows that repeat both doc_id and text are all marked kept in the
decisions, and deduplicate() keeps one of them; an empty table gives an empty result; other columns are ignored here and
passed through by deduplicate().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import documents, small, without_rows, written

#: Keys of a bucket.
CAPACITY = 50_000

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def key_of(norm) -> Column:
    return F.xxhash64(norm)


def directory(index: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The directory's buckets: depth (bits), prefix (the bits), entries. index has a column __key."""
    keys = index.select("__key").distinct()
    bits = max(1, math.ceil(math.log2(max(2, keys.count() / capacity))) + 2)
    while True:
        cells = written(keys.groupBy(F.shiftrightunsigned("__key", 64 - bits).alias("cell")).agg(F.count("*").alias("n")), "cells")
        doubled = (
            cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
            .select("cell", "n", "depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix"))
        )
        sums = doubled.groupBy("depth", "prefix").agg(F.sum("n").alias("entries"))
        overfull = sums.where((F.col("depth") == bits) & (F.col("entries") > capacity)).limit(1).count()
        if not overfull or bits >= 60:
            break
        bits += 4
    # a bucket: within the capacity (or not to be split further), while the bucket that it was split from is overfull
    parent = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("half"), F.col("entries").alias("whole"))
    return (
        sums.withColumn("half", F.shiftright("prefix", 1))
        .join(parent, ["depth", "half"], "left")
        .where(((F.col("entries") <= capacity) | (F.col("depth") == bits)) & ((F.col("depth") == 0) | (F.col("whole") > capacity)))
        .select("depth", "prefix", "entries")
    )


def placed(df: DataFrame, buckets: DataFrame) -> DataFrame:
    """df with the bucket (depth and prefix) that the directory has for its __key: the one whose prefix the key has."""
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # 64 at most
    if not depths:
        return df.withColumns({"depth": F.lit(0), "prefix": F.lit(0).cast("long")}).limit(0)
    at = df.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])) if len(depths) > 1 else F.lit(depths[0]))
    at = at.withColumn("prefix", F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftrightunsigned(__key, 64 - depth) END"))
    own = buckets.select(F.col("depth").alias("__depth"), F.col("prefix").alias("__prefix"))
    return at.join(small(own), (F.col("depth") == F.col("__depth")) & (F.col("prefix") == F.col("__prefix"))).drop("__depth", "__prefix")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, buckets, chains): rows has doc_id, __key and __sha per document; buckets is the directory; chains has the entries
    of keys with more than one row, with their bucket."""
    norm = normalised(F.col("text"))
    rows = written(docs.select("doc_id", key_of(norm).alias("__key"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("__sha")), "rows")
    entries = written(rows.groupBy("__key", "__sha").agg(F.count("*").alias("n")), "entries")
    buckets = written(directory(entries, capacity), "directory")
    owner = placed(entries, buckets).repartition("depth", "prefix")
    chain = Window.partitionBy("depth", "prefix", "__key")
    chains = owner.withColumn("chained", F.sum("n").over(chain)).where("chained > 1").select("depth", "prefix", "__key", "__sha", "n")
    return rows, buckets, written(chains, "chains")


def resolved(docs: DataFrame, buckets: DataFrame, chains: DataFrame) -> DataFrame:
    """Of each chain's entries: depth, prefix, __key, __sha, keep_id, group_size, from a comparison of the texts' bytes in their buckets."""
    keys = chains.select("depth", "prefix", "__key").distinct()
    texts = docs.select("doc_id", normalised(F.col("text")).alias("__norm")).withColumn("__key", key_of(F.col("__norm")))
    # the directory places keys, and keys of chains are few beside texts, which pass by without a shuffle while these are small
    chained = texts.join(small(placed(keys.select("__key"), buckets).join(keys, ["depth", "prefix", "__key"])), "__key")
    same = chained.groupBy("depth", "prefix", "__key", "__norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return same.select("depth", "prefix", "__key", F.unhex(F.sha2(F.col("__norm").cast("binary"), 256)).alias("__sha"), "keep_id", "group_size")


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, buckets, chains = build_index(docs, capacity)
    same = small(written(resolved(docs, buckets, chains), "same"))
    out = placed(rows, buckets).join(same, ["depth", "prefix", "__key", "__sha"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = written(groups(docs, capacity), "groups")
    gone = found.where(~F.col("kept")).select("doc_id", F.unhex(F.substring("text_sha256", 1, 32)))  # as digest() of the normalised text
    out = without_rows(docs, gone, normalised(F.col("text")))
    kept = found.where("kept AND group_size > 1").groupBy("doc_id", "text_sha256").count()
    if kept.where("count > 1").limit(1).count():  # rows that repeat doc_id and text
        out = out.withColumn("__norm", normalised(F.col("text"))).dropDuplicates(["doc_id", "__norm"]).drop("__norm")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
