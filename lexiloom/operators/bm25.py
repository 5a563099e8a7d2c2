"""Ranked section search: weighted BM25 over title, heading and text, collapsed to documents.

A clause is a tuple of aliases, an alias a tuple of words that must stand one after the other. Frequencies of all
clauses come from one pass over the sections; what's shuffled are the rows with a hit, in narrow form.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexiloom.functions.text import phrase_count, terms

#: Weights of title and text, and BM25's constants.
TITLE, HEADING, TEXT = 5.0, 3.0, 1.0
K1, B = 1.2, 0.75
#: Parts of a section: the letter of their columns, and their words.
PARTS = (("t", "tw"), ("h", "hw"), ("b", "w"))
#: Digits of a score that ranks.
DIGITS = 9

Clause = tuple[tuple[str, ...], ...]


def clauses(query: str) -> list[Clause]:
    """One clause per word."""
    return [((w,),) for w in query.lower().split()]


def occurrences(words: Column, alias: tuple[str, ...]) -> Column:
    """How often the words stand one after the other."""
    if len(alias) == 1:
        return F.size(F.filter(words, lambda w: w == alias[0])).cast("long")
    line = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))  # each word with spaces of its own
    return phrase_count(line, " " + "  ".join(alias) + " ")


def matrix(sections: DataFrame, wanted: list[Clause]) -> DataFrame:
    """Per section: d (tokens), and for clause i its aliases' hits in title, heading and text (t, h and b{i}_{j}).

    Sections need no heading.

    The lambda binds the words, and the (outer) generator keeps filters from being pushed below it, so that each
    section is split into words once.
    """

    headed = "heading" in sections.columns

    def counts(x: Column) -> Column:
        cols = [(occurrences(x[c], a) if p != "h" or headed else F.lit(0).cast("long")).alias(f"{p}{i}_{j}") for i, clause in enumerate(wanted) for j, a in enumerate(clause) for p, c in PARTS]
        return F.struct((F.size(x["tw"]) + F.size(x["hw"]) + F.size(x["w"])).cast("long").alias("d"), *cols)

    heading = terms(F.coalesce("heading", F.lit(""))) if headed else F.array().cast("array<string>")
    words = F.array(F.struct(terms(F.col("title")).alias("tw"), heading.alias("hw"), terms(F.col("text")).alias("w")))
    return sections.select("doc_id", "ordinal", F.explode_outer(F.transform(words, counts)).alias("m")).select("doc_id", "ordinal", "m.*")


def _any(wanted: list[Clause], i: int, parts: str = "thb") -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"{p}{i}_{j}") > 0 for j in range(len(wanted[i])) for p in parts])


@dataclass
class Scored:
    """rows: doc_id, ordinal, hit{i} and body{i} (booleans per clause), score and body_score of sections with a hit."""

    rows: DataFrame
    wanted: list[Clause]

    @property
    def n(self) -> int:
        return len(self.wanted)

    def every(self, what: str = "hit") -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{what}{i}") for i in range(self.n)])

    def matched(self, what: str = "hit") -> Column:
        return sum((F.col(f"{what}{i}").cast("int") for i in range(self.n)), F.lit(0))


def scored(sections: DataFrame, wanted: list[Clause], title: float = TITLE, heading: float = HEADING, text: float = TEXT) -> Scored:
    """Scores by the whole collection's statistics; scope is for whoever filters the rows afterwards."""
    m = matrix(sections, wanted)
    return scored_matrix(m, wanted, m.agg(F.count("*").alias("all_rows"), F.sum("d").alias("all_tokens"), *frequencies(wanted)), title, heading, text)


def frequencies(wanted: list[Clause]) -> list[Column]:
    """Sections with each alias: n anywhere, m in the text."""
    phrases = [(i, j) for i, c in enumerate(wanted) for j in range(len(c))]
    return [F.count_if(_in(i, j)).alias(f"n{i}_{j}") for i, j in phrases] + [F.count_if(F.col(f"b{i}_{j}") > 0).alias(f"m{i}_{j}") for i, j in phrases]


def _in(i: int, j: int) -> Column:
    return (F.col(f"t{i}_{j}") > 0) | (F.col(f"h{i}_{j}") > 0) | (F.col(f"b{i}_{j}") > 0)


def scored_matrix(m: DataFrame, wanted: list[Clause], stats: DataFrame, title: float = TITLE, heading: float = HEADING, text: float = TEXT) -> Scored:
    """m: the rows of matrix(), at least those with a hit. stats: one row with all_rows, all_tokens and frequencies()."""
    phrases = [(i, j) for i, c in enumerate(wanted) for j in range(len(c))]
    found = [_in(i, j) for i, j in phrases]
    hits = m.where(reduce(lambda a, b: a | b, found)).crossJoin(F.broadcast(stats))  # one row

    def part(i: int, j: int, tf: Column, n: str) -> Column:
        idf = F.ln((F.col("all_rows") - F.col(n) + 0.5) / (F.col(n) + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("d") * F.col("all_rows") / F.col("all_tokens")))

    score = sum((part(i, j, F.col(f"t{i}_{j}") * title + F.col(f"h{i}_{j}") * heading + F.col(f"b{i}_{j}") * text, f"n{i}_{j}") for i, j in phrases), F.lit(0.0))
    body = sum((part(i, j, F.col(f"b{i}_{j}") * 1.0, f"m{i}_{j}") for i, j in phrases), F.lit(0.0))
    rows = hits.select(
        "doc_id", "ordinal", F.round(-score, DIGITS).alias("score"), F.round(-body, DIGITS).alias("body_score"),
        *[_any(wanted, i).alias(f"hit{i}") for i in range(len(wanted))], *[_any(wanted, i, "hb").alias(f"body{i}") for i in range(len(wanted))],
    )
    return Scored(rows, wanted)


def collapsed(s: Scored, keep: Column, body: Column) -> DataFrame:
    """Per document with a section that's kept: its best section (ties: the first), and how many sections match in the body."""
    best = F.min(F.when(keep, F.struct("score", "ordinal"))).alias("best")
    rows = s.rows.groupBy("doc_id").agg(best, F.count_if(body).alias("matching_sections")).where("best IS NOT NULL")
    return rows.select("doc_id", F.col("best.score").alias("score"), F.col("best.ordinal").alias("ordinal"), "matching_sections")


def ranked(docs: DataFrame, *before: Column) -> list[Column]:
    """The order of results: what's given, score, newest first (here: the larger id)."""
    return [*before, F.col("score").asc(), F.col("doc_id").desc()]


def numbered(docs: DataFrame, limit: int, *before: Column) -> DataFrame:
    """The first results with their rank. The limit comes first, so that only its rows are numbered."""
    top = docs.orderBy(*ranked(docs, *before)).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*ranked(top, *before))).cast("long"))


def _given(rows: DataFrame | Scored, query: list[Clause]) -> Scored:
    return rows if isinstance(rows, Scored) else scored(rows, query)


def search(sections: DataFrame | Scored, query: list[Clause]) -> DataFrame:
    """Documents with a section that has all clauses."""
    s = _given(sections, query)
    return collapsed(s, s.every(), s.every("body"))


def any_clause(sections: DataFrame | Scored, query: list[Clause]) -> DataFrame:
    """Documents with any clause."""
    s = _given(sections, query)
    return collapsed(s, F.lit(True), s.matched("body") > 0)


def document_scope(sections: DataFrame | Scored, query: list[Clause]) -> DataFrame:
    """Documents that have all clauses, but in no single section; ranked like any_clause()."""
    s = _given(sections, query)
    per = s.rows.groupBy("doc_id").agg(
        F.min(F.struct("score", "ordinal")).alias("best"), F.count_if(s.matched("body") > 0).alias("matching_sections"),
        F.bool_or(s.every()).alias("together"), *[F.bool_or(f"hit{i}").alias(f"has{i}") for i in range(s.n)],
    )
    every = reduce(lambda a, b: a & b, [F.col(f"has{i}") for i in range(s.n)])
    return per.where(every & ~F.col("together")).select("doc_id", F.col("best.score").alias("score"), F.col("best.ordinal").alias("ordinal"), "matching_sections")


def broader(sections: DataFrame | Scored, query: list[Clause]) -> DataFrame:
    """Documents with at least half of 3 to 12 clauses (two at least): with the number matched, more first."""
    least = max(-(-len(query) // 2), 2)
    s = _given(sections, query)
    per = s.rows.groupBy("doc_id").agg(F.min(F.struct("score", "ordinal")).alias("best"), *[F.bool_or(f"hit{i}").alias(f"has{i}") for i in range(s.n)])
    n = sum((F.col(f"has{i}").cast("long") for i in range(s.n)), F.lit(0).cast("long"))
    rows = per.select("doc_id", F.col("best.score").alias("score"), F.col("best.ordinal").alias("ordinal"), n.alias("matched"), *[f"has{i}" for i in range(s.n)])
    return rows.where(F.col("matched") >= least)
