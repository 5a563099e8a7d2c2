"""Places of texts in each other: locating chunks in segments, mapping folded matches back, counting through pages."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

_DROPPED = re.compile("[ـً-ٰٟ​-‏‪-‮⁠﻿]")
_FOLD = str.maketrans("آأإٱىیک", "ااااييك")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|[\w]+")


def folded(text: str) -> tuple[str, list[int]]:
    """A text in the tolerant form, and for each of its characters the place in the text."""
    out, at = [], []
    for i, c in enumerate(text):
        if _DROPPED.match(c):
            continue
        for x in unicodedata.normalize("NFKC", c).translate(_FOLD).lower():
            if x.isspace():
                if not out or out[-1] == " ":
                    continue
                x = " "
            out.append(x)
            at.append(i)
    return "".join(out), at


def equal(a: str, b: str) -> bool:
    """Equal as they are, or in the tolerant form unless that's empty."""
    return a == b or bool(folded(a)[0].strip()) and folded(a)[0].strip() == folded(b)[0].strip()


def located(text: str, needle: str, start: int = 0, strict: bool = False) -> tuple[int, int] | None:
    """Where a needle stands: exactly from start on, exactly anywhere (unless strict), or in the tolerant form."""
    at = text.find(needle, start)
    if at < 0 and not strict:
        at = text.find(needle)
    if at >= 0:
        return at, at + len(needle)
    form, places = folded(text)
    wanted = folded(needle)[0].strip()
    if not wanted:
        return None
    begin = next((k for k, p in enumerate(places) if p >= start), len(places))
    at = form.find(wanted, begin)
    if at < 0 and not strict:
        at = form.find(wanted)
    return None if at < 0 else (places[at], places[at + len(wanted) - 1] + 1)


def ordered(text: str, needles: list[str]) -> list[tuple[int, int] | None]:
    """Places of needles one after the other; one that isn't found doesn't move on."""
    out, at = [], 0
    for n in needles:
        found = located(text, n, at, strict=True)
        out.append(found)
        at = found[1] if found else at
    return out


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(_SPANS)
def spans_in_order(text: pd.Series, needles: pd.Series) -> pd.Series:
    """ordered() of columns; null where a needle isn't found."""
    return pd.Series([[s and {"start": s[0], "end": s[1]} for s in ordered(t or "", list(n) if n is not None else [])] for t, n in zip(text, needles, strict=True)])


@F.pandas_udf(_SPANS)
def word_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": m.start(), "end": m.end()} for m in _WORD.finditer(t or "")])


def segment_offsets(segments: DataFrame, key: str = "doc_id", index: str = "ordinal", text: str = "text") -> DataFrame:
    """Segments with their start in all of them joined by one space."""
    w = W.partitionBy(key).orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)).cast("long"))


def nth_match(counts: DataFrame, wanted: DataFrame, key: str = "doc_id", index: str = "ordinal") -> DataFrame:
    """wanted: key, n (from 0, through all pages). The page that holds the match, and its number there; none beyond the last."""
    w = W.partitionBy(key).orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    rows = counts.where("match_count > 0").withColumn("before", F.coalesce(F.sum("match_count").over(w), F.lit(0)))
    found = rows.join(wanted, key).where((F.col("n") >= F.col("before")) & (F.col("n") < F.col("before") + F.col("match_count")))
    return found.select(key, "n", index, (F.col("n") - F.col("before")).cast("long").alias("occurrence"))


def run_overlaps(chunks: DataFrame, runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks: key, chunk, segment, start, end; runs: key, segment, run, start, end. Overlaps [largest start, least end)."""
    r = runs.select(key, "segment", "run", F.col("start").alias("rs"), F.col("end").alias("re"))
    both = chunks.join(r, [key, "segment"]).withColumn("from", F.greatest("start", "rs")).withColumn("to", F.least("end", "re"))
    return both.where(F.col("from") < F.col("to")).select(key, "chunk", "segment", "run", "from", "to")


def grafted(chunks: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks (key, index, id, text) with spans (key, index, id, text, start, end), if all of a document's fit; else without any."""
    s = spans.select(F.col(key).alias("k"), F.col("index").alias("i"), F.col("id").alias("sid"), F.col("text").alias("st"), "start", "end")
    both = chunks.join(s, (F.col(key) == F.col("k")) & (F.col("index") == F.col("i")), "full")
    fits = F.coalesce((F.col("id") == F.col("sid")) & (F.col("text") == F.col("st")), F.lit(False))
    both = both.withColumn("doc", F.coalesce(key, "k")).withColumn("fits", F.min(fits.cast("int")).over(W.partitionBy("doc")) == 1)
    rows = both.where(F.col("id").isNotNull())
    return rows.select(key, "index", "id", "text", *[F.when(F.col("fits"), F.col(c)).alias(c) for c in ("start", "end")])
