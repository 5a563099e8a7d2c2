"""The engine as one object: a library's sections, its indexes, and the requests that it answers."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.functions.stemming import stems
from lexiloom.functions.text import normal_form
from lexiloom.operators import analysis, bm25, evidence, maintenance, phrases, semantic
from lexiloom.plans.index import Index

#: Most and usual results of a search.
MOST, USUAL = 100, 50
_ARABIC = range(0x600, 0x700)


@dataclass
class Result:
    """documents: doc_id, rank, scope (section, document), score, ordinal, matching_sections, and what the mode adds.

    passages, locations and coverage are about the documents shown, and None beside phrases.
    """

    documents: DataFrame
    total_documents: int
    total_sections: int
    passages: DataFrame | None = None
    locations: DataFrame | None = None
    coverage: DataFrame | None = None
    suggestion: str | None = None


class Library:
    """sections: doc_id, title, ordinal, text, and heading if there is one. Indexes live in a folder that all executors share."""

    def __init__(self, spark: SparkSession, sections: DataFrame, path: str):
        self.spark, self.sections, self.path = spark, sections, path.rstrip("/")
        self.index = Index(spark, f"{self.path}/main")
        self.form = Index(spark, f"{self.path}/form")

    @classmethod
    def create(cls, spark: SparkSession, sections: DataFrame, path: str) -> Library:
        path = path.rstrip("/")
        Index.build(sections, f"{path}/main", analyzer="porter")
        Index.build(sections.where(sections["text"].rlike("[؀-ۿ]")), f"{path}/form", analyzer="form")
        cls._vocabulary(sections, path)
        return cls(spark, sections, path)

    @staticmethod
    def _vocabulary(sections: DataFrame, path: str) -> None:
        """Words by their first two letters, so that a word's candidates are one folder."""
        words = evidence.vocabulary(sections.select("doc_id", F.col("title").alias("source"), "text")).select("doc_id", "term").distinct()
        words.withColumn("p2", F.substring("term", 1, 2)).repartition("p2").write.mode("append").partitionBy("p2").parquet(f"{path}/vocabulary")

    def _spelt(self, words: list[str]) -> str | None:
        """A suggestion. Words of documents that were replaced stay in the vocabulary; what's suggested finds a document."""
        vocab = self.spark.read.schema("doc_id long, term string, p2 string").parquet(f"{self.path}/vocabulary")
        near = vocab.where(F.col("p2").isin([w[:2] for w in words]))
        return evidence.suggestion(lambda w: evidence.together(self.index.scored(self._clauses(" ".join(w), []))), near, words)

    def add(self, sections: DataFrame) -> None:
        """Add or replace documents in the indexes. The caller's table of sections is replaced by its own means."""
        self.index.add(sections)
        self.form.add(sections.where(sections["text"].rlike("[؀-ۿ]")))
        self._vocabulary(sections, self.path)

    def _clauses(self, text: str, found: list[str]) -> list[bm25.Clause]:
        """The query's terms and phrases as the index has them: ways to write them, each in stems."""
        out = []
        for t in [*analysis.terms(text), *found]:
            ways = {tuple(s for w in a for s in stems(w)) for a in analysis.aliases(t)}
            clause = tuple(sorted(w for w in ways if w))
            if clause and clause not in out:
                out.append(clause)
        return out

    def search(self, query: str, mode: str = "all", limit: int = USUAL, scope: DataFrame | None = None, exact: list[str] = ()) -> Result:
        """Ranked documents. scope: doc_id of the documents that may be found; None: all. Scores are those of the whole collection."""
        q = analysis.parse(query)
        found = [*q.phrases, *exact]
        analysis.check_limits(query, list(exact))
        limit = max(1, min(limit, MOST))
        wanted = self._clauses(q.unquoted, found)
        if not wanted:
            none = self.spark.createDataFrame([], "doc_id long, rank long, scope string, score double, ordinal long, matching_sections long")
            return Result(none, 0, 0)
        arabic = any(ord(c) in _ARABIC for t in [query, *exact] for c in t)
        s = (self.form if arabic else self.index).scored(wanted)
        terms = analysis.comparison_terms(q, mode == "broader")
        order = []
        if mode == "broader" and not found and analysis.broader_minimum(len(terms)):
            rows = bm25.broader(s, wanted).withColumn("scope", F.lit("section")).withColumn("matching_sections", F.lit(None).cast("long"))
            order = [F.col("matched").desc()]
        else:
            one = bm25.search(s, wanted).withColumn("scope", F.lit("section"))
            rows = one
            if len(wanted) > 1:
                rows = one.unionByName(bm25.document_scope(s, wanted).withColumn("scope", F.lit("document")))
            order = [F.col("scope").desc()]  # section before document
            if not found and 2 <= len(wanted) <= 6 and all(len(a) == 1 for c in wanted for a in c):
                row = self.index.scored([(tuple(c[0][0] for c in wanted),)]).rows.where("body0").select("doc_id").distinct()
                rows = rows.join(row.withColumn("adjacent", F.lit(True)), "doc_id", "left").withColumn("adjacent", F.coalesce("adjacent", F.lit(False)))
                order.append(F.col("adjacent").desc())
        if scope is not None:
            rows = rows.join(scope.select("doc_id"), "doc_id", "left_semi")
        normal = [p for p in (self._normal(p) for p in found) if any(c.isalnum() for c in p)]
        if normal:
            checked = phrases.verified(self.sections.join(rows.select("doc_id"), "doc_id", "left_semi"), normal)
            rows = rows.join(phrases.excerpted(checked, normal[0]).drop("norm"), "doc_id")
        rows = rows.cache()
        total = rows.agg(F.count("*"), F.coalesce(F.sum("matching_sections"), F.lit(0))).first()
        shown = bm25.numbered(rows, limit, *order)
        out = Result(shown, total[0], total[1])
        weakref.finalize(out, rows.unpersist)  # the ranking is kept for as long as the result, which is shown later
        if total[0] and not normal:
            own = bm25.Scored(s.rows.join(F.broadcast(shown.select("doc_id")), "doc_id", "left_semi"), wanted)  # MOST rows at most
            sizes = self.sections.join(F.broadcast(shown.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("sections"))
            words = [w for t in analysis.terms(q.unquoted) for w in analysis.words(t)]
            out.passages, out.locations = evidence.excerpts(evidence.passages(own), self.sections, words), evidence.histogram(own, sizes)
            out.coverage = evidence.coverage(own) if terms else None
        elif not total[0] and not found and mode == "all":
            out.suggestion = self._spelt(analysis.terms(q.unquoted))
        return out

    def _normal(self, phrase: str) -> str:
        return self.spark.range(1).select(normal_form(F.lit(phrase))).first()[0]

    def concordance(self, phrase: str, offset: int = 0, limit: int = USUAL, scope: DataFrame | None = None) -> DataFrame:
        """A page of a phrase's occurrences."""
        rows = self.sections if scope is None else self.sections.join(scope.select("doc_id"), "doc_id", "left_semi")
        return phrases.concordance(rows, self._normal(phrase[:512]), offset, limit)

    def find(self, doc_id: int, phrase: str) -> DataFrame:
        """Occurrences by section of one document."""
        return phrases.counts(self.sections.where(F.col("doc_id") == doc_id), self._normal(phrase[:512]))

    def availability(self, vectors: DataFrame, dims: int | None = None) -> str:
        """empty: no documents; missing-index: none has vectors; incompatible: vectors of other dimensions; partial; ready."""
        row = maintenance.coverage(self.sections.select("doc_id"), vectors.select("doc_id")).first()
        if not row.eligible:
            return "empty"
        if row.indexed and dims is not None and vectors.where(F.size("vector") != dims).limit(1).count():
            return "incompatible"
        return row.status

    def conceptual(self, vectors: DataFrame, query: list[float] | Callable[[], list[float]], k: int = USUAL, scope: DataFrame | None = None, exact: list[str] = ()) -> DataFrame:
        """The nearest documents by their passages' vectors (doc_id, passage, vector); phrases must stand in them literally.

        query: a vector, or what encodes it, which is called once, and only if a document may be found. Vectors with a
        content_hash are held against the live sections: documents whose best passage has changed aren't shown. Lexical and
        conceptual rankings are never mixed.
        """
        if exact:
            held = phrases.verified(self.sections, [self._normal(p) for p in exact]).select("doc_id")
            scope = held if scope is None else held.join(scope.select("doc_id"), "doc_id", "left_semi")
        if callable(query):
            some = vectors if scope is None else vectors.join(scope.select("doc_id"), "doc_id", "left_semi")
            if not some.limit(1).count():
                return semantic.top(vectors.where("false"), [0.0], k, None, "doc_id", "passage")
            query = query()
        found = semantic.top(vectors, query, max(1, min(k, semantic.MOST)), scope, "doc_id", "passage")
        if "content_hash" not in vectors.columns:
            return found
        hashed = found.join(vectors.select("doc_id", "passage", "content_hash"), ["doc_id", "passage"])
        return semantic.current(hashed, self.sections).select(*found.columns).orderBy(F.desc("score"), "doc_id")
