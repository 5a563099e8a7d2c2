"""Exact phrases: verification over all sections of a document, counts, excerpts, concordance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from lexiloom.functions.text import normal_form, phrase_count


def normalised(sections: DataFrame) -> DataFrame:
    """Sections with their normal form; the generator keeps filters on it from evaluating it once more."""
    return sections.select("*", F.explode_outer(F.array(normal_form(F.col("text")))).alias("norm"))


def verified(sections: DataFrame, phrases: list[str]) -> DataFrame:
    """Documents in which every phrase stands, as a literal part of some section's normal form (not of one section for all).

    With occurrences that don't overlap, over phrases and sections, and the first section with the first phrase.
    """
    rows = normalised(sections)
    has = [F.col("norm").contains(p) for p in phrases]
    rows = rows.where(reduce(lambda a, b: a | b, has))
    per = rows.groupBy("doc_id").agg(
        *[F.bool_or(h).alias(f"p{i}") for i, h in enumerate(has)],
        F.sum(sum((phrase_count(F.col("norm"), p) for p in phrases), F.lit(0).cast("long"))).alias("match_count"),
        F.min(F.when(has[0], F.col("ordinal"))).alias("first_section"),
        F.min(F.when(has[0], F.struct("ordinal", "norm"))).alias("first"),
    )
    return per.where(reduce(lambda a, b: a & b, [F.col(f"p{i}") for i in range(len(phrases))])).select("doc_id", "match_count", "first_section", F.col("first.norm").alias("norm"))


def excerpted(found: DataFrame, phrase: str, around: int = 120) -> DataFrame:
    """The first occurrence with so many characters around it, marked."""
    at = F.locate(phrase, F.col("norm"))
    n = len(phrase)
    left, right = F.greatest(at - around, F.lit(1)), at + n
    return found.withColumn(
        "excerpt",
        F.concat(
            F.when(left > 1, "…").otherwise(""), F.substring(F.col("norm"), left, at - left), F.lit("<mark>"), F.substring(F.col("norm"), at, F.lit(n)), F.lit("</mark>"),
            F.substring(F.col("norm"), right, F.lit(around)), F.when(right + around <= F.length("norm"), "…").otherwise(""),
        ),
    )


def occurrences(sections: DataFrame, phrase: str, around: int = 40) -> DataFrame:
    """doc_id, ordinal, occurrence (from 0, in the section), position (from 1), before, after."""
    n = len(phrase)
    rows = normalised(sections).where(F.col("norm").contains(phrase))
    pieces = F.split(F.col("norm"), rf"\Q{phrase}\E", -1)
    rows = rows.select("doc_id", "ordinal", "norm", pieces.alias("pieces"))
    rows = rows.select("doc_id", "ordinal", "norm", F.posexplode(F.slice("pieces", 1, F.size("pieces") - 1)).alias("occurrence", "piece"))
    w = W.partitionBy("doc_id", "ordinal").orderBy("occurrence")
    rows = rows.withColumn("position", (F.sum(F.length("piece") + n).over(w) - n + 1).cast("long"))
    return rows.select(
        "doc_id", "ordinal", F.col("occurrence").cast("long").alias("occurrence"), "position",
        F.substring(F.col("norm"), F.greatest(F.col("position") - around, F.lit(1)).cast("int"), F.least(F.lit(around).cast("long"), F.col("position") - 1).cast("int")).alias("before"),
        F.substring(F.col("norm"), (F.col("position") + n).cast("int"), F.lit(around)).alias("after"),
    )


def concordance(sections: DataFrame, phrase: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of one document set's occurrences in reading order; with limit + offset rows numbered at most."""
    order = ["doc_id", "ordinal", "occurrence"]
    rows = occurrences(sections, phrase[:512]).orderBy(*order).limit(offset + min(limit, 100))
    rows = rows.withColumn("occurrence_index", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)) - 1).cast("long"))
    return rows.where(F.col("occurrence_index") >= offset)


def counts(sections: DataFrame, phrase: str) -> DataFrame:
    """Occurrences per section, where there are any."""
    rows = normalised(sections).select("doc_id", "ordinal", phrase_count(F.col("norm"), phrase[:512]).alias("match_count"))
    return rows.where("match_count > 0")
