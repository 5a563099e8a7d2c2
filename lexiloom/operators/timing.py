"""Narration's timing: start times, contiguity, lookups, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TOLERANCE = 0.05


def timed(chunks: DataFrame, key: str, index: str, duration: str) -> DataFrame:
    """start: the durations of all chunks before."""
    w = W.partitionBy(key).orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum(duration).over(w), F.lit(0).cast("double")))


def contiguous(chunks: DataFrame, key: str, index: str) -> DataFrame:
    """key, ok: indices without gaps from 0, and starts that follow from the durations."""
    w = W.partitionBy(key).orderBy(index)
    rows = timed(chunks.withColumnRenamed("start", "said"), key, index, "duration").withColumn("n", F.row_number().over(w) - 1)
    return rows.groupBy(key).agg(F.bool_and((F.col(index) == F.col("n")) & (F.abs(F.col("said") - F.col("start")) <= TOLERANCE)).alias("ok"))


def playing(chunks: DataFrame, points: DataFrame, key: str, index: str) -> DataFrame:
    """points: key, at. The chunk that plays then: the last that has begun; before the first, the first.

    One sort per key instead of a join of ranges: points and starts are laid in one order, and the last start is carried on.
    """
    both = chunks.select(key, F.col("start").alias("at"), F.col(index).alias("own"), F.lit(0).alias("kind")).unionByName(points.select(key, "at", F.lit(None).cast("long").alias("own"), F.lit(1).alias("kind")))
    w = W.partitionBy(key).orderBy("at", "kind")
    rows = both.withColumn("found", F.last("own", ignorenulls=True).over(w)).withColumn("first", F.min("own").over(W.partitionBy(key)))
    return rows.where("kind = 1").select(key, "at", F.coalesce("found", "first").alias(index))


def wav_seconds(data_bytes: Column, rate: int = 24_000, channels: int = 1, sample_bytes: int = 2) -> Column:
    return data_bytes / F.lit(rate * channels * sample_bytes)


def playback_rate(rate: Column) -> Column:
    return F.round(F.greatest(F.lit(0.5), F.least(F.lit(3.0), rate)), 2)


def signature(chunks: DataFrame, key: str, index: str, id_: str, hashed: str) -> DataFrame:
    """key, signature input: ids and hashes of all chunks in order, to be hashed."""
    own = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.concat(F.col(id_), F.lit("\0"), F.col(hashed)).alias("s"))))
    return chunks.groupBy(key).agg(own.alias("own")).select(key, F.array_join(F.transform("own", lambda x: x["s"]), "\n").alias("signature"))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def located_parts(parts: DataFrame, points: DataFrame, key: str, index: str, size: str) -> DataFrame:
    """points: key, at (an offset in all parts' text). The part and the offset in it; empty parts hold nothing, nor what's outside."""
    rows = timed(parts.where(F.col(size) > 0).withColumn("duration", F.col(size).cast("double")), key, index, "duration")
    found = playing(rows, points.withColumn("at", F.col("at").cast("double")), key, index)
    sizes = rows.select(key, index, F.col("start").alias("s"), F.col(size).alias("z"))
    out = found.join(sizes, [key, index], "left").withColumn("offset", (F.col("at") - F.col("s")).cast("long"))
    return out.where((F.col("offset") >= 0) & (F.col("offset") < F.col("z"))).select(key, F.col("at").cast("long").alias("at"), index, "offset")


def narration_status(saved: DataFrame, chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """document_id, status, missing: whether a recording is whole.

    saved: document_id, signature, wanted (the signature of today's text). chunks: document_id, index, hash. cached: hash.
    """
    own = chunks.join(cached.select(F.col("hash").alias("c")).distinct(), F.col("hash") == F.col("c"), "left")
    per = own.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("c").isNull()).alias("missing"))
    rows = saved.join(per, "document_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    status = F.when(F.col("signature") != F.col("wanted"), "text-changed").when(F.coalesce("chunks", F.lit(0)) == 0, "no-index").when(F.col("missing") > 0, "incomplete").otherwise("complete")
    return rows.select("document_id", status.alias("status"), F.col("missing").cast("long").alias("missing"))


def orphans(cached: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cached pieces that no recording has."""
    return cached.join(chunks.select("hash").distinct(), "hash", "left_anti")
