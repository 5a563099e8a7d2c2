"""Dense retrieval over a plain exact scan: passage windows, identities and reuse, scoring, top documents, context."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from lexiloom.functions.vectors import dot, valid

#: A window's tokens and characters, and the tokens shared with the one before. Fixed values.
TOKENS, CHARS, OVERLAP = 320, 4096, 40
#: Most results, and the characters of context.
MOST, SPANS, PER_SPAN, PER_SIDE = 50, 5, 2048, 4096

_TOKEN = re.compile(r"\S+")
_STOP = re.compile(r"""(?:\.(?=["'”’»)\]」』）】]*(?:\s|$))|[!?؟。！？])["'”’»)\]」』）】]*|(?<![\r\n])(?=\r?\n\r?\n)""")


def _ended(text: str, at: int) -> int:
    """Where the text before a place ends, without white space."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def windows(text: str, tokens: int = TOKENS, chars: int = CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges of a text with so many tokens at most, ended at a sentence or paragraph in their second half where there's one."""
    spans = []
    for m in _TOKEN.finditer(text):  # tokens longer than a window are cut
        spans += [(a, min(a + chars, m.end())) for a in range(m.start(), m.end(), chars)]
    at_stop = {_ended(text, m.end()) for m in _STOP.finditer(text)}
    stops = sorted(at_stop)
    out: list[tuple[int, int]] = []
    first, n = 0, len(spans)
    while first < n:
        last = min(first + tokens, n)
        while last > first + 1 and spans[last - 1][1] - spans[first][0] > chars:
            last -= 1
        if last < n:
            half = spans[first + (last - first) // 2][1]
            near = bisect_right(stops, spans[last - 1][1]) - 1
            if near >= 0 and stops[near] >= half:
                while last > first + 1 and spans[last - 1][1] > stops[near]:
                    last -= 1
        out.append((spans[first][0], spans[last - 1][1]))
        if last == n:
            break
        back = min(overlap, (last - first) // 3)
        begins = [k for k in range(first + (last - first) // 2, last) if k > first and spans[k - 1][1] in at_stop]
        at = max((k for k in begins if k <= last - back), default=last - back)
        first = at if at > first else last
    return out


_RANGES = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(_RANGES)
def passage_ranges(t: pd.Series) -> pd.Series:
    return t.map(lambda x: [{"start": a, "end": b} for a, b in windows(x)] if x else [])


def passage_input(title: Column, heading: Column, text: Column) -> Column:
    """What's encoded and hashed."""
    return F.concat(F.lit("passage: "), F.concat_ws(". ", F.nullif(title, F.lit("")), F.nullif(heading, F.lit("")), text))


_REGIONS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("auxiliary", BooleanType())]))


def regions(text: str, body: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """A text's stretches of main content and what lies between them (auxiliary), in order; white space alone is none."""
    edges, out = 0, []
    for a, b in [*body, (len(text), len(text))]:
        out += [(edges, a, True), (a, b, False)]
        edges = b
    return [(a, b, aux) for a, b, aux in out if text[a:b].strip()]


@F.pandas_udf(_REGIONS)
def region_ranges(t: pd.Series, body: pd.Series) -> pd.Series:
    """Windows within regions: none bridges a border."""

    def one(x, ranges):
        own = regions(x, [(r["start"], r["end"]) for r in ranges]) if x else []
        return [{"start": a + c, "end": a + d, "auxiliary": aux} for a, b, aux in own for c, d in windows(x[a:b])]

    return pd.Series([one(x, r if r is not None else []) for x, r in zip(t, body, strict=True)])


def passages(sections: DataFrame) -> DataFrame:
    """doc_id, ordinal, start, end, content_hash of all windows of sections (with title, text); of sections with body ranges, by
    region, and with auxiliary."""
    apart = "body" in sections.columns
    ranges = region_ranges("text", "body") if apart else passage_ranges("text")
    rows = sections.select("doc_id", "ordinal", "title", "text", F.explode_outer(ranges).alias("r")).where("r IS NOT NULL")
    own = F.substring(F.col("text"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start"))
    hashed = F.sha2(passage_input(F.col("title"), F.lit(None).cast("string"), own).cast("binary"), 256).alias("content_hash")
    return rows.select("doc_id", "ordinal", "r.start", "r.end", hashed, *["r.auxiliary"] * apart)


def current(found: DataFrame, sections: DataFrame) -> DataFrame:
    """Of found passages (doc_id, content_hash) those that the live sections still have. Only the found documents are read."""
    live = passages(sections.join(found.select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id", "content_hash")
    return found.join(live, ["doc_id", "content_hash"], "left_semi")


def to_encode(passages: DataFrame, known: DataFrame) -> DataFrame:
    """Passages whose hash has no vector yet for the document."""
    return passages.join(known.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def reused(passages: DataFrame, known: DataFrame) -> DataFrame:
    return passages.join(known, ["doc_id", "content_hash"])


def scored(vectors: DataFrame, query: list[float], document: str = "document_id", passage: str = "passage") -> DataFrame:
    """Per document the passage nearest to the query: equal scores go to the first one."""
    rows = vectors.select(document, passage, F.round(dot(F.col("vector"), query), 9).alias("score"))
    return rows.groupBy(document).agg(F.max(F.struct(F.col("score"), (-F.col(passage)).alias("back"))).alias("best")).select(document, F.col("best.score").alias("score"), (-F.col("best.back")).alias(passage))


def top(vectors: DataFrame, query: list[float], k: int = MOST, scope: DataFrame | None = None, document: str = "document_id", passage: str = "passage") -> DataFrame:
    """The k nearest documents. scope None: all; an empty one: none."""
    if not 1 <= k <= MOST:
        raise ValueError("between 1 and 50 results")
    if scope is not None:
        vectors = vectors.join(scope.select(document), document, "left_semi")
    return scored(vectors, query, document, passage).orderBy(F.desc("score"), document).limit(k)


def checked(vectors: DataFrame, dims: int) -> DataFrame:
    """vectors with ok: finite, of unit length, of so many dimensions."""
    return vectors.withColumn("ok", F.coalesce(valid(F.col("vector"), dims), F.lit(False)))


def neighbours(sections: DataFrame, hits: DataFrame, around: int = 4) -> DataFrame:
    """doc_id, hit, ordinal, text: sections around each hit, within the limits of characters on either side.

    The text of each span and of each side is cut at its limit; with a column auxiliary, a side ends before the first section
    that is nothing else. Hits are few; sections are found by an equi-join on the document and a band of the ordinal.
    """
    aux = F.col("auxiliary") if "auxiliary" in sections.columns else F.lit(False)
    rows = hits.select("doc_id", F.col("ordinal").alias("hit")).join(sections.select("doc_id", "ordinal", "text", aux.alias("auxiliary")), "doc_id")
    rows = rows.where(F.abs(F.col("ordinal") - F.col("hit")) <= around)
    side = F.signum(F.col("ordinal") - F.col("hit")).cast("int")
    rows = rows.withColumn("side", side).withColumn("text", F.substring("text", 1, PER_SPAN))
    w = W.partitionBy("doc_id", "hit", "side").orderBy(F.abs(F.col("ordinal") - F.col("hit")))
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ended = F.max("auxiliary").over(w.rowsBetween(W.unboundedPreceding, 0)) & (F.col("side") != 0)
    rows = rows.withColumn("ended", ended).withColumn("room", PER_SIDE - before).withColumn("k", F.row_number().over(w))
    rows = rows.where(~F.col("ended") & (F.col("room") > 0) & ((F.col("side") == 0) | (F.col("k") <= SPANS - 1)))
    return rows.select("doc_id", "hit", "ordinal", F.substring(F.col("text"), F.lit(1), F.col("room").cast("int")).alias("text"))


def preview(text: Column, n: int = 400) -> Column:
    """The first characters to the end of a word."""
    cut = F.regexp_replace(F.substring(text, 1, n), r"\s+\S*$", "")
    return F.when(F.length(text) > n, F.concat(cut, F.lit("…"))).otherwise(text)
