"""Registered queries of ranked retrieval, with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.functions.text import TERM, normal_form, terms
from lexiloom.operators import bm25, evidence, phrases
from lexiloom.sources.tables import sections, table, texts

ONE, TWO, FOUR = "with", "with from", "only with from this"
PHRASES = ["of the", "with the"]
SCOPE = ("src1", "src2", "src3", "src5", "src8", "src13")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(_docs(spark, sf_dir))


# SQL

SECTIONS = """sec AS (
  SELECT doc_id, source AS title, unnest(range(len(p)))::BIGINT AS ordinal, unnest(p) AS text
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)
)"""


def hits_sql(query: str, title: float = bm25.TITLE) -> str:
    """Common table expressions up to `hits`: the rows of bm25.scored() for single words."""
    words = query.split()
    count = lambda c, w: f"len(list_filter({c}, lambda x: x = '{w}'))"
    tf = ", ".join(f"{count('tw', w)} AS t{i}, {count('w', w)} AS b{i}" for i, w in enumerate(words))
    stats = ", ".join(f"count(*) FILTER (t{i} > 0 OR b{i} > 0) AS n{i}, count(*) FILTER (b{i} > 0) AS m{i}" for i in range(len(words)))

    def part(tf: str, n: str) -> str:
        idf = f"CASE WHEN ln((N - {n} + 0.5) / ({n} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - {n} + 0.5) / ({n} + 0.5)) END"
        return f"({idf}) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * d * N / DD))"

    score = " + ".join(part(f"(t{i} * {title}::DOUBLE + b{i})", f"n{i}") for i in range(len(words)))
    body = " + ".join(part(f"(b{i}::DOUBLE)", f"m{i}") for i in range(len(words)))
    flags = ", ".join(f"(t{i} > 0 OR b{i} > 0) AS hit{i}, b{i} > 0 AS body{i}" for i in range(len(words)))
    some = " OR ".join(f"t{i} > 0 OR b{i} > 0" for i in range(len(words)))
    return f"""{SECTIONS}, words AS (
  SELECT doc_id, ordinal, regexp_extract_all(lower(title), '{TERM}') AS tw, regexp_extract_all(lower(text), '{TERM}') AS w FROM sec
), m AS (SELECT doc_id, ordinal, len(tw) + len(w) AS d, {tf} FROM words),
st AS (SELECT count(*)::DOUBLE AS N, sum(d)::DOUBLE AS DD, {stats} FROM m),
hits AS (SELECT doc_id, ordinal, round(-({score}), 9) AS score, round(-({body}), 9) AS body_score, {flags} FROM m, st WHERE {some})"""


def _all(n: int, what: str = "hit") -> str:
    return " AND ".join(f"{what}{i}" for i in range(n))


def _some(n: int, what: str = "body") -> str:
    return "(" + " OR ".join(f"{what}{i}" for i in range(n)) + ")"


def docs_sql(keep: str, body: str) -> str:
    """The rows of bm25.collapsed()."""
    return f"""SELECT doc_id, min(score) FILTER ({keep}) AS score, arg_min(ordinal, (score, ordinal)) FILTER ({keep}) AS ordinal,
  count(*) FILTER ({body}) AS matching_sections FROM hits GROUP BY doc_id HAVING count(*) FILTER ({keep}) > 0"""


def ranked_sql(rows: str, limit: int, before: str = "") -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {before} score, doc_id DESC) AS rank FROM ({rows}) QUALIFY rank <= {limit}"


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {SECTIONS} SELECT doc_id, title, ordinal, text FROM sec")
def sections_from_text(spark, sf_dir):
    return _sections(spark, sf_dir)


@query(f"WITH {hits_sql(ONE)} {ranked_sql(docs_sql('hit0', 'body0'), 50)}")
def search_single_term(spark, sf_dir):
    return bm25.numbered(bm25.search(_sections(spark, sf_dir), bm25.clauses(ONE)), 50)


@query(f"WITH {hits_sql(TWO)} {ranked_sql(docs_sql(_all(2), _all(2, 'body')), 50)}")
def search_all_two_terms(spark, sf_dir):
    return bm25.numbered(bm25.search(_sections(spark, sf_dir), bm25.clauses(TWO)), 50)


@query(f"WITH {hits_sql(TWO)} {ranked_sql(docs_sql('true', _some(2)), 100)}")
def search_or_candidates(spark, sf_dir):
    return bm25.numbered(bm25.any_clause(_sections(spark, sf_dir), bm25.clauses(TWO)), 100)


_SCOPE_SQL = f"""SELECT doc_id, min(score) AS score, arg_min(ordinal, (score, ordinal)) AS ordinal, count(*) FILTER ({_some(2)}) AS matching_sections
FROM hits GROUP BY doc_id HAVING bool_or(hit0) AND bool_or(hit1) AND NOT bool_or({_all(2)})"""


@query(f"WITH {hits_sql(TWO)} {_SCOPE_SQL}")
def search_document_scope(spark, sf_dir):
    return bm25.document_scope(_sections(spark, sf_dir), bm25.clauses(TWO))


@query(f"""WITH {hits_sql(TWO)} {ranked_sql(f"SELECT *, 0::BIGINT AS band FROM ({docs_sql(_all(2), _all(2, 'body'))}) UNION ALL SELECT *, 1::BIGINT FROM ({_SCOPE_SQL})", 100, "band,")}""")
def search_combined_two_band(spark, sf_dir):
    """Documents with a section that has all terms, then those that have them in several."""
    s, q = _sections(spark, sf_dir), bm25.clauses(TWO)
    both = bm25.search(s, q).withColumn("band", F.lit(0).cast("long")).unionByName(bm25.document_scope(s, q).withColumn("band", F.lit(1).cast("long")))
    return bm25.numbered(both, 100, F.col("band").asc())


@query(f"""WITH {hits_sql(FOUR)}, per AS (SELECT doc_id, min(score) AS score, arg_min(ordinal, (score, ordinal)) AS ordinal,
  {", ".join(f"bool_or(hit{i}) AS has{i}" for i in range(4))} FROM hits GROUP BY doc_id),
b AS (SELECT *, {" + ".join(f"has{i}::BIGINT" for i in range(4))} AS matched FROM per)
SELECT doc_id, score, ordinal, matched, has0, has1, has2, has3, row_number() OVER (ORDER BY matched DESC, score, doc_id DESC) AS rank FROM b WHERE matched >= 2 QUALIFY rank <= 50""")
def search_broader_coverage(spark, sf_dir):
    return bm25.numbered(bm25.broader(_sections(spark, sf_dir), bm25.clauses(FOUR)), 50, F.col("matched").desc())


_NEXT = TWO.split()


@query(f"""WITH {hits_sql(TWO)}, adj AS (SELECT DISTINCT doc_id FROM words WHERE len(list_filter(range(len(w) - 1), lambda i: w[i + 1] = '{_NEXT[0]}' AND w[i + 2] = '{_NEXT[1]}')) > 0)
{ranked_sql(f"SELECT d.*, a.doc_id IS NOT NULL AS adjacent FROM ({docs_sql(_all(2), _all(2, 'body'))}) d LEFT JOIN adj a USING (doc_id)", 50, "adjacent DESC,")}""")
def search_adjacency_tier(spark, sf_dir):
    """Documents whose text has the query as a phrase come first."""
    s = _sections(spark, sf_dir)
    found = bm25.search(s, bm25.clauses(TWO))
    near = bm25.matrix(s, [(tuple(_NEXT),)]).where("b0_0 > 0").select("doc_id").distinct().withColumn("adjacent", F.lit(True))
    rows = found.join(near, "doc_id", "left").withColumn("adjacent", F.coalesce("adjacent", F.lit(False)))
    return bm25.numbered(rows, 50, F.col("adjacent").desc())


_IN = ", ".join(f"'{s}'" for s in SCOPE)


def _scoped(spark, sf_dir, how):
    docs = _docs(spark, sf_dir)
    found = bm25.search(sections(docs), bm25.clauses(TWO))
    return bm25.numbered(found.join(docs.where(F.col("source").isin(*SCOPE)).select("doc_id"), "doc_id", how), 50)


@query(f"WITH {hits_sql(TWO)} {ranked_sql(docs_sql(_all(2), _all(2, 'body')) + f' AND doc_id IN (SELECT doc_id FROM documents WHERE source IN ({_IN}))', 50)}")
def search_scoped_include(spark, sf_dir):
    """Scope limits the results before the limit; the scores are those of the whole collection."""
    return _scoped(spark, sf_dir, "left_semi")


@query(f"WITH {hits_sql(TWO)} {ranked_sql(docs_sql(_all(2), _all(2, 'body')) + f' AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source IN ({_IN}))', 50)}")
def search_scoped_exclude(spark, sf_dir):
    return _scoped(spark, sf_dir, "left_anti")


@query(f"WITH {hits_sql(TWO)} SELECT count(*) AS total_documents, coalesce(sum(matching_sections), 0)::BIGINT AS total_sections FROM ({docs_sql(_all(2), _all(2, 'body'))})")
def search_totals_before_limit(spark, sf_dir):
    found = bm25.search(_sections(spark, sf_dir), bm25.clauses(TWO))
    return found.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("matching_sections"), F.lit(0).cast("long")).alias("total_sections"))


@query(f"WITH {hits_sql('src1 with')} {ranked_sql(docs_sql('hit0', 'body0'), 50)}")
def search_title_weighting(spark, sf_dir):
    """A hit in the title makes every section a candidate, and counts no section as matching."""
    s = bm25.scored(_sections(spark, sf_dir), bm25.clauses("src1 with"))
    return bm25.numbered(bm25.collapsed(s, F.col("hit0"), F.col("body0")), 50)


# hyphens: RE2 has no look-behind, so a letter is captured and two passes are made
_L = r"\p{L}\p{M}"
NORMAL = (
    "lower(trim(regexp_replace(" + "regexp_replace(regexp_replace(" + "regexp_replace(regexp_replace("
    + "translate({t}, '‘’“”‐‑‒–—―', '''''\"\"------'), '([\\p{L}])-\\s+([\\p{L}])', '\\1-\\2', 'g'), '([\\p{L}])-\\s+([\\p{L}])', '\\1-\\2', 'g')"
    + ", '([\\p{L}])-([\\p{L}])', '\\1\\2', 'g'), '([\\p{L}])-([\\p{L}])', '\\1\\2', 'g'), '\\s+', ' ', 'g')))"
)


def normal_sql(t: str) -> str:
    return NORMAL.replace("{t}", t)


_NORM = f"{SECTIONS}, n AS (SELECT doc_id, ordinal, {normal_sql('text')} AS norm FROM sec)"
_COUNT = lambda p, t="norm": f"((length({t}) - length(replace({t}, '{p}', ''))) // {len(p)})"


@query(f"WITH {_NORM} SELECT doc_id, ordinal, norm FROM n")
def normal_forms(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "ordinal", normal_form(F.col("text")).alias("norm"))


_HAS = [f"contains(norm, '{p}')" for p in PHRASES]
_VERIFIED = f"""SELECT doc_id, sum({_COUNT(PHRASES[0])} + {_COUNT(PHRASES[1])})::BIGINT AS match_count, min(ordinal) FILTER ({_HAS[0]}) AS first_section
FROM n WHERE {_HAS[0]} OR {_HAS[1]} GROUP BY doc_id HAVING bool_or({_HAS[0]}) AND bool_or({_HAS[1]})"""


@query(f"WITH {_NORM} SELECT doc_id FROM ({_VERIFIED})")
def phrase_verify_all(spark, sf_dir):
    return phrases.verified(_sections(spark, sf_dir), PHRASES).select("doc_id")


@query(f"WITH {_NORM}, one AS (SELECT DISTINCT doc_id FROM n WHERE {_HAS[0]} AND {_HAS[1]}) SELECT doc_id, first_section FROM ({_VERIFIED}) WHERE doc_id NOT IN (SELECT doc_id FROM one)")
def phrase_cross_section(spark, sf_dir):
    """Documents that have both phrases, but in no single section."""
    s = _sections(spark, sf_dir)
    one = phrases.normalised(s).where(F.col("norm").contains(PHRASES[0]) & F.col("norm").contains(PHRASES[1])).select("doc_id").distinct()
    return phrases.verified(s, PHRASES).join(one, "doc_id", "left_anti").select("doc_id", "first_section")


@query(f"WITH {_NORM} {_VERIFIED}")
def phrase_counts_evidence(spark, sf_dir):
    return phrases.verified(_sections(spark, sf_dir), PHRASES).drop("norm")


@query(f"""WITH {_NORM}, v AS ({_VERIFIED}), f AS (SELECT v.doc_id, norm, instr(norm, '{PHRASES[0]}') AS pos FROM v JOIN n ON n.doc_id = v.doc_id AND n.ordinal = v.first_section)
SELECT doc_id, CASE WHEN greatest(pos - 120, 1) > 1 THEN '…' ELSE '' END || substr(norm, greatest(pos - 120, 1), pos - greatest(pos - 120, 1)) || '<mark>' || '{PHRASES[0]}' || '</mark>'
  || substr(norm, pos + {len(PHRASES[0])}, 120) || CASE WHEN pos + {len(PHRASES[0])} + 120 <= length(norm) THEN '…' ELSE '' END AS excerpt FROM f""")
def phrase_excerpt(spark, sf_dir):
    return phrases.excerpted(phrases.verified(_sections(spark, sf_dir), PHRASES), PHRASES[0]).select("doc_id", "excerpt")


_WORD = "from the"


@query(f"""WITH {_NORM}, h AS (SELECT doc_id, ordinal, norm, string_split(norm, '{_WORD}') AS p FROM n WHERE contains(norm, '{_WORD}')),
e AS (SELECT doc_id, ordinal, norm, unnest(range(len(p) - 1))::BIGINT AS occurrence, p FROM h),
o AS (SELECT doc_id, ordinal, norm, occurrence, (list_sum(list_transform(p[1:occurrence + 1], lambda x: length(x))) + occurrence * {len(_WORD)} + 1)::BIGINT AS position FROM e)
SELECT doc_id, ordinal, occurrence, position, substr(norm, greatest(position - 40, 1), least(40, position - 1)) AS before, substr(norm, position + {len(_WORD)}, 40) AS after,
  row_number() OVER (ORDER BY doc_id, ordinal, occurrence) - 1 AS occurrence_index FROM o QUALIFY occurrence_index >= 20 AND occurrence_index < 70""")
def concordance_page(spark, sf_dir):
    return phrases.concordance(_sections(spark, sf_dir), _WORD, offset=20, limit=50)


@query(f"WITH {_NORM} SELECT doc_id, ordinal, {_COUNT(_WORD)}::BIGINT AS match_count FROM n WHERE contains(norm, '{_WORD}')")
def find_counts_per_section(spark, sf_dir):
    return phrases.counts(_sections(spark, sf_dir), _WORD)


@query(f"""WITH {hits_sql(TWO)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY body_score, ordinal) AS passage, ordinal, body_score AS score
FROM hits WHERE {_some(2)} QUALIFY passage <= 3""")
def evidence_top3(spark, sf_dir):
    return evidence.passages(bm25.scored(_sections(spark, sf_dir), bm25.clauses(TWO)))


@query(f"""WITH {hits_sql(ONE)}, z AS (SELECT doc_id, count(*) AS sections FROM sec GROUP BY doc_id)
SELECT doc_id, least(ordinal * 12 // greatest(sections, 1), 11)::BIGINT AS bin, count(*) AS match_count, min(ordinal) AS first_section FROM hits JOIN z USING (doc_id) WHERE body0 GROUP BY 1, 2""")
def occurrence_histogram(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    sizes = docs.select("doc_id", F.size(F.split("text", "\n")).alias("sections"))
    return evidence.histogram(bm25.scored(sections(docs), bm25.clauses(ONE)), sizes)


@query(f"""WITH {hits_sql(FOUR)} """ + " UNION ALL ".join(f"SELECT doc_id, {i}::BIGINT AS term, count(*) AS sections, min(ordinal) AS first_section FROM hits WHERE body{i} GROUP BY doc_id" for i in range(4)))
def term_coverage(spark, sf_dir):
    return evidence.coverage(bm25.scored(_sections(spark, sf_dir), bm25.clauses(FOUR)))


_VOCAB = """v AS (SELECT DISTINCT doc_id, term, origin FROM (
  SELECT doc_id, 0::BIGINT AS origin, unnest(regexp_extract_all(lower(source), '[a-z]+')) AS term FROM documents
  UNION ALL SELECT doc_id, 1::BIGINT, unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents) WHERE length(term) BETWEEN 5 AND 24)"""
MISSPELT = "einxeit"


@query(f"WITH {_VOCAB} SELECT doc_id, term, origin FROM v")
def vocabulary_build(spark, sf_dir):
    return evidence.vocabulary(_docs(spark, sf_dir))


_NEAR = f"""SELECT term, count(DISTINCT doc_id) AS documents FROM v WHERE substr(term, 1, 2) = '{MISSPELT[:2]}' AND length(term) BETWEEN {len(MISSPELT) - 1} AND {len(MISSPELT) + 1}
GROUP BY term ORDER BY documents DESC, term LIMIT 256"""


@query(f"WITH {_VOCAB} SELECT term, documents FROM ({_NEAR})")
def spelling_candidates(spark, sf_dir):
    return evidence.spelling_candidates(evidence.vocabulary(_docs(spark, sf_dir)), MISSPELT)


@query(f"WITH {_VOCAB} SELECT term, documents FROM ({_NEAR}) WHERE levenshtein(term, '{MISSPELT}') = 1 ORDER BY documents DESC, term LIMIT 8")
def spelling_corrections(spark, sf_dir):
    return evidence.corrections(evidence.vocabulary(_docs(spark, sf_dir)), MISSPELT)


@query(f"""WITH {_VOCAB}, {SECTIONS}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text) || ' ' || lower(title), '{TERM}')) AS word FROM sec),
c AS (SELECT term, documents FROM ({_NEAR}) WHERE levenshtein(term, '{MISSPELT}') = 1 ORDER BY documents DESC, term LIMIT 8)
SELECT '{MISSPELT}' AS query, (SELECT term FROM c WHERE term IN (SELECT word FROM w) ORDER BY documents DESC, term LIMIT 1) AS suggestion""")
def spelling_suggestion(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = evidence.suggestion(evidence.found_by_scan(sections(docs)), evidence.vocabulary(docs), [MISSPELT])
    return spark.createDataFrame([(MISSPELT, found)], "query string, suggestion string")


@query(f"""WITH {SECTIONS}, w AS (SELECT doc_id, ordinal, regexp_extract_all(lower(text), '{TERM}') AS w FROM sec),
t AS (SELECT doc_id, ordinal, unnest(list_distinct(w)) AS term FROM w)
SELECT term, count(*) AS sections, count(DISTINCT doc_id) AS documents FROM t GROUP BY term""")
def term_statistics(spark, sf_dir):
    """Document frequencies of all terms, as the index keeps them."""
    rows = _sections(spark, sf_dir).select("doc_id", F.explode_outer(F.array_distinct(terms(F.col("text")))).alias("term")).where("term IS NOT NULL")
    per = rows.groupBy("term", "doc_id").agg(F.count("*").alias("n"))  # combined before the second shuffle
    return per.groupBy("term").agg(F.sum("n").alias("sections"), F.count("*").alias("documents"))


@query(f"""WITH {SECTIONS}, w AS (SELECT doc_id, ordinal, regexp_extract_all(lower(text), '{TERM}') AS w FROM sec),
h AS (SELECT doc_id, ordinal, list_contains(w, 'withfrom') OR len(list_filter(range(len(w) - 1), lambda i: w[i + 1] = 'with' AND w[i + 2] = 'from')) > 0 AS hit FROM w)
SELECT doc_id, ordinal FROM h WHERE hit""")
def hyphen_alias_match(spark, sf_dir):
    """Sections with `with-from`: as two words in a row, or joined."""
    from lexiloom.operators.analysis import aliases

    m = bm25.matrix(_sections(spark, sf_dir), [tuple(aliases("with-from"))])
    return m.where("b0_0 > 0 OR b0_1 > 0").select("doc_id", "ordinal")


_GRADES = "(SELECT doc_id, max(quality + toxic)::BIGINT AS grade FROM labels GROUP BY doc_id)"


@query(f"""WITH {hits_sql(TWO)}, r AS ({ranked_sql(docs_sql(_all(2), _all(2, 'body')), 10)}),
j AS (SELECT rank, coalesce(grade, 0) AS g FROM r LEFT JOIN {_GRADES} USING (doc_id)),
i AS (SELECT grade AS g, row_number() OVER (ORDER BY grade DESC, doc_id) AS rank FROM {_GRADES} WHERE grade > 0),
a AS (SELECT count(*) AS relevant, coalesce(sum((pow(2, g) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS ideal FROM i)
SELECT round(count(*) FILTER (g > 0) / max(relevant)::DOUBLE, 6) AS recall_at_10, round(coalesce(1.0::DOUBLE / min(rank) FILTER (g > 0), 0), 6) AS mrr_at_10,
  round(sum((pow(2, g) - 1) / log2(rank + 1)) / max(ideal), 6) AS ndcg_at_10 FROM j, a""")
def retrieval_metrics(spark, sf_dir):
    from lexiloom.operators.evaluation import ranking_metrics

    grades = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") + F.col("toxic")).cast("long")).alias("grade"))
    return ranking_metrics(bm25.numbered(bm25.search(_sections(spark, sf_dir), bm25.clauses(TWO)), 10), grades)


_WORDS = "['" + "', '".join(TWO.split()) + "']"
_OWN = "regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g')"


@query(f"""WITH {SECTIONS}, p AS (SELECT doc_id, ordinal, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS parts FROM sec),
h AS (SELECT *, list_position(list_transform(parts, lambda x: {_OWN} IN ('with', 'from')), true) AS first FROM p),
b AS (SELECT *, greatest(1, least(first - 4, len(parts) - 15)) AS b FROM h WHERE first IS NOT NULL AND first > 0)
SELECT doc_id, ordinal, len(list_intersect({_WORDS}, list_transform(parts, lambda x: {_OWN})))::INTEGER AS terms,
  (CASE WHEN b > 1 THEN '… ' ELSE '' END) || array_to_string(list_transform(parts[b:b + 15], lambda x: CASE WHEN {_OWN} IN ('with', 'from') THEN '<mark>' || x || '</mark>' ELSE x END), ' ') || (CASE WHEN b + 16 <= len(parts) THEN ' …' ELSE '' END) AS snippet
FROM b""")
def hit_snippets(spark, sf_dir):
    """Snippets of all sections that have a term, with how many different ones they have."""
    rows = _sections(spark, sf_dir)
    words = TWO.split()
    out = evidence.excerpts(rows.select("doc_id", "ordinal"), rows, words, 16)
    return out.where("in_body").select("doc_id", "ordinal", "terms", "snippet")


# The same searches over an index that's built once per session and table.

_INDEXES: dict = {}


def _index(spark, sf_dir):
    from lexiloom.plans.index import Index

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lexiloom-index-")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/index-{uuid.uuid4().hex}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        _INDEXES[key] = Index.build(_docs(spark, sf_dir), at.toString())
    return _INDEXES[key]


def _indexed(spark, sf_dir, text):
    q = bm25.clauses(text)
    return _index(spark, sf_dir).scored(q), q


@query(ORACLES["search_single_term"])
def indexed_single_term(spark, sf_dir):
    return bm25.numbered(bm25.search(*_indexed(spark, sf_dir, ONE)), 50)


@query(ORACLES["search_all_two_terms"])
def indexed_all_two_terms(spark, sf_dir):
    return bm25.numbered(bm25.search(*_indexed(spark, sf_dir, TWO)), 50)


@query(ORACLES["search_combined_two_band"])
def indexed_combined_two_band(spark, sf_dir):
    s, q = _indexed(spark, sf_dir, TWO)
    both = bm25.search(s, q).withColumn("band", F.lit(0).cast("long")).unionByName(bm25.document_scope(s, q).withColumn("band", F.lit(1).cast("long")))
    return bm25.numbered(both, 100, F.col("band").asc())


@query(ORACLES["search_broader_coverage"])
def indexed_broader_coverage(spark, sf_dir):
    return bm25.numbered(bm25.broader(*_indexed(spark, sf_dir, FOUR)), 50, F.col("matched").desc())


@query(ORACLES["evidence_top3"])
def indexed_evidence_top3(spark, sf_dir):
    return evidence.passages(_indexed(spark, sf_dir, TWO)[0])


@query(ORACLES["term_coverage"])
def indexed_term_coverage(spark, sf_dir):
    return evidence.coverage(_indexed(spark, sf_dir, FOUR)[0])


@query(ORACLES["hyphen_alias_match"])
def indexed_hyphen_alias_match(spark, sf_dir):
    from lexiloom.operators.analysis import aliases

    return _index(spark, sf_dir).scored([tuple(aliases("with-from"))]).rows.where("body0").select("doc_id", "ordinal")
