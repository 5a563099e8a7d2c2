"""Evidence for results: passages, occurrence histograms, per-term coverage, spelling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .bm25 import Scored, clauses, scored

BINS = 12
#: Tokens of a snippet.
SNIPPET = 64
#: Candidates for a misspelt word, and how many of them are tried.
CANDIDATES, TRIED = 256, 8


def passages(s: Scored, n: int = 3) -> DataFrame:
    """The best sections of each document by the body's score."""
    w = W.partitionBy("doc_id").orderBy("body_score", "ordinal")
    rows = s.rows.where(s.matched("body") > 0).withColumn("passage", F.row_number().over(w).cast("long"))
    return rows.where(F.col("passage") <= n).select("doc_id", "passage", "ordinal", F.col("body_score").alias("score"))


def _bare(token: Column) -> Column:
    """A token as a word: its letters and digits, in lower case."""
    return F.regexp_replace(F.lower(token), r"[^\p{L}\p{N}]", "")


def snippet(text: Column, words: list[str], tokens: int = SNIPPET) -> Column:
    """So many tokens around the first that is one of the words, these marked; … where text is left out."""
    parts = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    first = F.array_position(F.transform(parts, lambda p: _bare(p).isin(words)), True).cast("int")
    begin = F.greatest(F.lit(1), F.least(first - tokens // 4, F.size(parts) - tokens + 1))
    shown = F.transform(F.slice(parts, begin, F.lit(tokens)), lambda p: F.when(_bare(p).isin(words), F.concat(F.lit("<mark>"), p, F.lit("</mark>"))).otherwise(p))
    before, after = F.when(begin > 1, "… ").otherwise(""), F.when(begin + tokens <= F.size(parts), " …").otherwise("")
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(before, F.array_join(shown, " "), after))


def main_content(rows: DataFrame, words: list[str]) -> DataFrame:
    """rows (with text, and body: its ranges of main content) with terms and part: the range with the most different words, the
    first of such; where no range has one, 0 and the whole text. A row's hits are then citations, and go behind others."""
    wanted = F.array(*[F.lit(w) for w in words])

    def one(r: Column) -> Column:
        part = F.substring(F.col("text"), r["start"] + 1, r["end"] - r["start"])
        own = F.transform(F.regexp_extract_all(part, F.lit(r"\S+"), F.lit(0)), _bare)
        return F.struct(F.size(F.array_intersect(wanted, own)).alias("terms"), (-r["start"]).alias("back"), part.alias("part"))

    rows = rows.withColumn("__best", F.array_max(F.transform("body", one)))
    found = F.coalesce(F.col("__best.terms"), F.lit(0))
    return rows.withColumn("terms", found).withColumn("part", F.when(found > 0, F.col("__best.part")).otherwise(F.col("text"))).drop("__best")


def excerpts(found: DataFrame, sections: DataFrame, words: list[str], tokens: int = SNIPPET) -> DataFrame:
    """found (doc_id, ordinal and what else it has) with in_body and a snippet of the section's main content; sections without body
    ranges are main content as a whole."""
    rows = sections if "body" in sections.columns else sections.withColumn("body", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))))
    own = main_content(found.join(rows.select("doc_id", "ordinal", "text", "body"), ["doc_id", "ordinal"]), words)
    return own.withColumn("in_body", F.col("terms") > 0).withColumn("snippet", snippet(F.col("part"), words, tokens)).drop("text", "body", "part")


def histogram(s: Scored, sizes: DataFrame) -> DataFrame:
    """Matching sections by twelfths of their document. sizes: doc_id, sections."""
    rows = s.rows.where(s.matched("body") > 0).select("doc_id", "ordinal").join(sizes, "doc_id")
    b = F.least(F.floor(F.col("ordinal") * BINS / F.greatest("sections", F.lit(1))), F.lit(BINS - 1)).cast("long")
    return rows.groupBy("doc_id", b.alias("bin")).agg(F.count("*").alias("match_count"), F.min("ordinal").alias("first_section"))


def coverage(s: Scored) -> DataFrame:
    """Per document and clause: matching sections and the first."""
    each = F.explode(F.array(*[F.when(F.col(f"body{i}"), F.lit(i)) for i in range(s.n)])).alias("term")
    rows = s.rows.select("doc_id", "ordinal", each).where("term IS NOT NULL")
    return rows.groupBy("doc_id", F.col("term").cast("long").alias("term")).agg(F.count("*").alias("sections"), F.min("ordinal").alias("first_section"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """doc_id, term, origin (0 title, 1 body): distinct ASCII words of 5 to 24 letters."""
    both = F.array(F.struct(F.lit(0).alias("origin"), F.col("source").alias("t")), F.struct(F.lit(1).alias("origin"), F.col("text").alias("t")))
    rows = docs.select("doc_id", F.explode_outer(both).alias("s")).select("doc_id", "s.origin", F.array_distinct(F.regexp_extract_all(F.lower("s.t"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    rows = rows.select("doc_id", "origin", F.explode_outer(F.filter("w", lambda x: F.length(x).between(5, 24))).alias("term")).where("term IS NOT NULL")
    return rows.select("doc_id", "term", F.col("origin").cast("long").alias("origin"))


def spelling_candidates(vocab: DataFrame, word: str, limit: int = CANDIDATES) -> DataFrame:
    """Words with the same first two letters and a length that differs by one at most, by documents."""
    near = vocab.where((F.substring("term", 1, 2) == word[:2]) & F.length("term").between(len(word) - 1, len(word) + 1))
    return near.groupBy("term").agg(F.countDistinct("doc_id").alias("documents")).orderBy(F.desc("documents"), "term").limit(limit)


def corrections(vocab: DataFrame, word: str, tried: int = TRIED) -> DataFrame:
    """Of the candidates, the first few one edit away."""
    rows = spelling_candidates(vocab, word)
    return rows.where(F.levenshtein("term", F.lit(word), 1) == 1).orderBy(F.desc("documents"), "term").limit(tried)


def found_by_scan(sections: DataFrame) -> Callable[[list[str]], bool]:
    """Whether some document has all of some words, without an index."""

    def finds(words: list[str]) -> bool:
        return together(scored(sections, clauses(" ".join(words))))

    return finds


def together(s: Scored) -> bool:
    """Whether a document has all clauses, in whatever sections."""
    per = s.rows.groupBy("doc_id").agg(*[F.bool_or(f"hit{i}").alias(f"h{i}") for i in range(s.n)])
    return per.where(" AND ".join(f"h{i}" for i in range(s.n))).limit(1).count() > 0


def suggestion(finds: Callable[[list[str]], bool], vocab: DataFrame, query: list[str]) -> str | None:
    """The query with one unknown word put right, if the result finds a document. Bounded: 4 words, TRIED corrections each."""
    if not 1 <= len(query) <= 4 or any(not w.isascii() or not w.isalpha() or w != w.lower() for w in query):
        return None
    for k, word in enumerate(query):
        if not 5 <= len(word) <= 24 or vocab.where(F.col("term") == word).limit(1).count():
            continue
        for r in corrections(vocab, word).collect():
            fixed = [*query[:k], r.term, *query[k + 1 :]]
            if finds(fixed):
                return " ".join(fixed)
    return None
