"""Registered queries over pages, texts, vectors and narration."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lexiloom.functions import speech, stemming, text as T
from lexiloom.operators import alignment, layout, maintenance, semantic, timing
from lexiloom.sources import html, importer
from lexiloom.sources.files import paragraphs, text_as_html
from lexiloom.sources.tables import sections, table, texts

from .retrieval import SECTIONS

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark, sf_dir):
    return texts(spark, sf_dir, "documents")


# pages

_ENT = lambda t: f"replace(replace(replace(replace(replace(replace({t}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
_TITLE = _ENT("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@query(f"SELECT page_id, coalesce(nullif(trim(regexp_replace({_TITLE}, '[ \\t\\n\\r\\f]+', ' ', 'g')), ''), 'Imported HTML Document') AS title FROM pages")
def html_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


_BARE = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g')"
_BARE = f"regexp_replace(regexp_replace({_BARE}, '(?i)</?({T.PARTING})([ /][^>]*)?>', ' ', 'g'), '<[a-zA-Z/!][^>]*>', '', 'g')"


@query(f"SELECT page_id, trim(regexp_replace({_ENT(_BARE)}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def html_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.without_tags(F.col("html")).alias("text"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents")
def html_escaped(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.escaped(F.col("text")).alias("html"))


@query()
def html_sections(spark, sf_dir):
    return html.html_sections(texts(spark, sf_dir, "pages")).select("page_id", "ordinal", "is_heading", "heading", "text", "auxiliary")


@query(f"""WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id AS ordinal, (1 + page_id % 6)::INTEGER AS rank, {_TITLE} AS title FROM pages), n AS (SELECT *, count(*) OVER (PARTITION BY host) AS n FROM h)
SELECT host, ordinal, substr(trim(regexp_replace(title, '[ \t\n\r\f]+', ' ', 'g')), 1, 512) AS label, rank, (SELECT max(b.ordinal) FROM h b WHERE b.host = n.host AND b.ordinal < n.ordinal AND b.rank < n.rank) AS parent FROM n WHERE n >= 2""")
def outline_links(spark, sf_dir):
    """An outline of each host's pages, with ranks by number; pages of the tables have one heading, and so none of their own."""
    pages = texts(spark, sf_dir, "pages")
    titles = pages.select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.col("page_id").alias("ordinal"), (F.col("page_id") % 6 + 1).cast("int").alias("rank"), T.html_title(F.col("html")).alias("text"))
    return html.outline(titles, "host")


@query(f"""WITH {SECTIONS}, h AS (SELECT doc_id, ordinal, text, (length(text) < 60 AND NOT contains(text, '.')) AS heading FROM sec)
SELECT doc_id, ordinal, coalesce(last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING), '') AS heading FROM h""")
def heading_propagation(spark, sf_dir):
    """Each section with the last heading before it (here: a short line without a full stop)."""
    t = F.col("text")
    is_heading = (F.length(t) < 60) & ~t.contains(".")
    w = W.partitionBy("doc_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    return sections(_docs(spark, sf_dir)).select("doc_id", "ordinal", F.coalesce(F.last(F.when(is_heading, t), ignorenulls=True).over(w), F.lit("")).alias("heading"))


_PARA = """p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\\r\\n?', chr(10), 'g'), '\\n(?:[ \\t]*\\n)+')) AS t FROM documents)"""


@query(f"WITH {_PARA}, q AS (SELECT doc_id, regexp_replace(t, '^\\n+|\\n+$', '', 'g') AS t FROM p WHERE trim(t) <> '') SELECT doc_id, count(*) AS paragraphs, sum(length(t))::BIGINT AS chars FROM q GROUP BY doc_id")
def text_paragraphs(spark, sf_dir):
    """Paragraphs of plain text; the documents' lines are set apart by blank ones."""
    own = paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return _docs(spark, sf_dir).select("doc_id", F.explode_outer(own).alias("t")).where("t IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("t")).cast("long").alias("chars"))


@query("""SELECT doc_id, '<p>' || replace(replace(replace(replace(replace(replace(regexp_replace(text, '\\n+$', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), chr(10), '<br>') || '</p>' AS html
FROM documents WHERE NOT contains(text, chr(10) || chr(10)) AND trim(text) <> ''""")
def text_html(spark, sf_dir):
    return _docs(spark, sf_dir).where(~F.col("text").contains("\n\n") & (F.trim("text") != "")).select("doc_id", text_as_html(F.col("text")).alias("html"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, coalesce(try_cast(nullif(regexp_extract(url, '[?&]page=([0-9]{1,9})', 1), '') AS INTEGER), 1) AS page FROM pages")
def url_projection(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.coalesce(F.nullif(F.regexp_extract("url", "[?&]page=([0-9]{1,9})", 1), F.lit("")).cast("int"), F.lit(1)).alias("page"))


# places

@query(f"""WITH {SECTIONS}, c AS (SELECT doc_id, ordinal, (length(text) - length(replace(text, 'the', ''))) // 3 AS k FROM sec WHERE contains(text, 'the')),
b AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
w AS (SELECT DISTINCT doc_id, unnest([0, 3, 50])::BIGINT AS n FROM documents)
SELECT b.doc_id, n, ordinal, (n - before)::BIGINT AS occurrence FROM b JOIN w USING (doc_id) WHERE n >= before AND n < before + k""")
def find_index_to_section(spark, sf_dir):
    """Which section holds the first, fourth and fifty-first match of a document."""
    docs = _docs(spark, sf_dir)
    counts = sections(docs).select("doc_id", "ordinal", T.phrase_count(F.col("text"), "the").alias("match_count"))
    wanted = docs.select("doc_id").distinct().withColumn("n", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 3, 50)])))
    return alignment.nth_match(counts, wanted)


@query(f"""WITH {SECTIONS} SELECT doc_id, ordinal, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sec""")
def segment_offsets(spark, sf_dir):
    return alignment.segment_offsets(sections(_docs(spark, sf_dir))).select("doc_id", "ordinal", "start")


@query("""WITH d AS (SELECT text, doc_id % 50 = 0 OR trim(text) = '' AS failed FROM documents)
SELECT (SELECT count(*) FROM pages) + count(*) AS selected, (SELECT count(DISTINCT html) FROM pages) + count(DISTINCT text) FILTER (NOT failed) AS imported,
  (SELECT count(*) - count(DISTINCT html) FROM pages) + count(*) FILTER (NOT failed) - count(DISTINCT text) FILTER (NOT failed) AS existing, count(*) FILTER (failed) AS failed FROM d""")
def import_outcomes(spark, sf_dir):
    """Pages and documents as files of a folder, imported together; some are broken."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.lit("pages").alias("folder"), F.encode("html", "UTF-8").alias("content"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 50 == 0, F.lit(".epub")).otherwise(F.lit(".txt"))).alias("name"), F.lit("texts").alias("folder"), F.encode("text", "UTF-8").alias("content"))
    return importer.summary(importer.imported(pages.unionByName(docs)).outcomes)


# running lines

@query(f"""WITH {SECTIONS}, e AS (SELECT doc_id, title, text, ordinal, max(ordinal) OVER (PARTITION BY doc_id) AS last FROM sec),
k AS (SELECT title, doc_id, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS key FROM e WHERE ordinal = 0 OR ordinal = last)
SELECT title, key, count(DISTINCT doc_id) AS pages FROM k WHERE key <> '' GROUP BY title, key HAVING count(DISTINCT doc_id) >= 3""")
def repeated_edge_lines(spark, sf_dir):
    """Lines at the edges of pages that stand on three or more (a source is a book here, a document a page)."""
    t = F.split("text", "\n")
    edges = _docs(spark, sf_dir).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_index"), F.explode(F.array_distinct(F.array(F.get(t, F.lit(0)), F.element_at(t, -1)))).alias("text"))
    return layout.running_lines(edges).withColumnRenamed("document_id", "title")


# narration

_SENT = T.SENTENCE.replace("'", "''")
_CLAUSE = T.CLAUSE.replace("'", "''")


def _split_sql(pattern: str, clean: str) -> str:
    return f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{pattern}'), lambda s: {clean}), lambda s: s <> '') AS l FROM documents)
SELECT doc_id, unnest(range(len(l)))::BIGINT AS ordinal, unnest(l) AS text FROM s"""


@query(_split_sql(_SENT, "trim(regexp_replace(s, '[ \\t\\n\\r]+', ' ', 'g'))"))
def sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("ordinal", "text")).where("ordinal IS NOT NULL").withColumn("ordinal", F.col("ordinal").cast("long"))


@query(_split_sql(_CLAUSE, "trim(s)"))
def clauses(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode_outer(T.clauses(F.col("text"))).alias("ordinal", "text")).where("ordinal IS NOT NULL").withColumn("ordinal", F.col("ordinal").cast("long"))


@query()
def narration_chunks(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode_outer(speech.speech_chunks(F.split("text", "\n"))).alias("index", "c")).where("index IS NOT NULL")
    return rows.select("doc_id", "index", "c.text", "c.start_segment", "c.start_offset", "c.end_segment", "c.end_offset")


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(translate(text, '‘’‚‛“”„‟‐‑‒–—―−', '''''''''""""-------'), '…', '...'), '[\\x{10000}-\\x{10FFFF}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g')) AS text FROM documents""")
def tts_sanitize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.speakable(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text || ' 3. 14 1. 2', '([0-9])\\. ([0-9])', '\\1.\\2', 'g'), '^$', '') AS text FROM documents")
def decimal_repair(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.repaired_decimals(F.concat("text", F.lit(" 3. 14 1. 2"))).alias("text"))


@query()
def speech_normalize_en(spark, sf_dir):
    return _docs(spark, sf_dir).where("lang = 'en'").select("doc_id", speech.speech_english(T.speakable(F.col("text"))).alias("text"))


_CLASSES = {"arabic": r"\x{0600}-\x{06FF}", "han": r"\x{4E00}-\x{9FFF}", "kana": r"\x{3040}-\x{30FF}", "latin": r"A-Za-z\x{00C0}-\x{024F}"}


@query("""WITH c AS (SELECT source, """ + ", ".join(f"sum(length(regexp_replace(text, '[^{c}]', '', 'g')))::BIGINT AS {n}" for n, c in _CLASSES.items()) + """ FROM documents GROUP BY source)
SELECT source, arabic, han, kana, latin, coalesce(CASE WHEN han > latin AND han > arabic AND han >= 20 AND kana < 5 THEN 'zh' WHEN arabic > latin AND arabic >= 20 THEN 'ar' END, 'none') AS script FROM c""")
def dominant_script(spark, sf_dir):
    rows = _docs(spark, sf_dir).groupBy("source").agg(*[F.sum(T.chars(F.col("text"), c)).alias(n) for n, c in _CLASSES.items()])
    return rows.withColumn("script", F.coalesce(T.script(F.col("arabic"), F.col("han"), F.col("kana"), F.col("latin")), F.lit("none")))


@query("""SELECT conv_id, turn, round(length(text) * 0.06::DOUBLE, 6) AS duration, round(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.06::DOUBLE, 6) AS start FROM conversations""")
def timing_index(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("chars"))
    rows = timing.timed(c, "conv_id", "turn", "chars")
    return rows.select("conv_id", "turn", F.round(F.col("chars") * 0.06, 6).alias("duration"), F.round(F.col("start") * 0.06, 6).alias("start"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start FROM conversations),
p AS (SELECT DISTINCT conv_id, unnest([-1.0, 0.0, 137.0, 500.0, 1000000.0])::DOUBLE AS at FROM conversations)
SELECT p.conv_id, p.at, coalesce((SELECT max(turn) FROM c WHERE c.conv_id = p.conv_id AND c.start <= p.at), (SELECT min(turn) FROM c WHERE c.conv_id = p.conv_id)) AS turn FROM p""")
def timing_lookup(spark, sf_dir):
    """Which turn plays at given times."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("duration"))
    points = c.select("conv_id").distinct().withColumn("at", F.explode(F.array(*[F.lit(x) for x in (-1.0, 0.0, 137.0, 500.0, 1000000.0)])))
    return timing.playing(timing.timed(c, "conv_id", "turn", "duration"), points, "conv_id", "turn")


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS z, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations WHERE length(text) > 0),
p AS (SELECT DISTINCT conv_id, unnest([-1, 0, 37, 250, 900])::BIGINT AS at FROM conversations)
SELECT p.conv_id, p.at, c.turn, (p.at - c.s)::BIGINT AS "offset" FROM p JOIN c ON c.conv_id = p.conv_id AND p.at >= c.s AND p.at < c.s + c.z""")
def text_offset_lookup(spark, sf_dir):
    """Which turn holds a character of a conversation, and where."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    points = c.select("conv_id").distinct().withColumn("at", F.explode(F.array(*[F.lit(x).cast("long") for x in (-1, 0, 37, 250, 900)])))
    return timing.located_parts(c, points, "conv_id", "turn", "chars")


@query("""SELECT conv_id, sha256(string_agg(turn || chr(1) || sha256(text), chr(10) ORDER BY turn)) AS signature, count(*) AS chunks FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def chunk_signatures(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    own = F.array_sort(F.collect_list(F.struct("turn", F.sha2(F.col("text").cast("binary"), 256).alias("h"))))
    rows = c.groupBy("conv_id").agg(own.alias("own"))
    line = F.array_join(F.transform("own", lambda x: F.concat(x["turn"].cast("string"), F.lit("\x01"), x["h"])), "\n")
    return rows.select("conv_id", F.sha2(line.cast("binary"), 256).alias("signature"), F.size("own").cast("long").alias("chunks"))


@query()
def stable_hashes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", speech.text_hash("text").alias("hash"))


@query()
def lexical_stemmed_terms(spark, sf_dir):
    """Stems and the sections that have them."""
    rows = sections(_docs(spark, sf_dir)).select("doc_id", F.explode_outer(F.array_distinct(stemming.stemmed("text"))).alias("term")).where("term IS NOT NULL")
    return rows.groupBy("term").agg(F.count("*").alias("sections"))


# Arabic form, over fixed words

_ARABIC = [(1, "الْكِتَاب"), (2, "أحمد إبراهيم آدم"), (3, "محـــمد"), (4, "مدرسة علي على"), (5, "plain"), (6, "")]


@query("""SELECT id, translate(regexp_replace(word, '[\\x{0640}\\x{064B}-\\x{065F}\\x{0670}]', '', 'g'), 'آأإ', 'ااا') AS form FROM (VALUES """ + ", ".join(f"({i}::BIGINT, '{w}')" for i, w in _ARABIC) + ") t(id, word)")
def arabic_form_projection(spark, sf_dir):
    return spark.createDataFrame(_ARABIC, "id long, word string").select("id", T.arabic_form(F.col("word")).alias("form"))


# vectors

def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("document_id"), F.col("vec_id").cast("long").alias("passage"), F.col("embedding").alias("vector"))


def _probe(spark, sf_dir) -> list[float]:
    return [float(x) for x in _vectors(spark, sf_dir).where("passage = 7").first().vector]


_VEC = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
v AS (SELECT label::BIGINT AS document_id, vec_id::BIGINT AS passage, round(greatest(-1.0, least(1.0, list_inner_product(embedding::DOUBLE[], q))), 9) AS score FROM embeddings, q)"""
_BEST = "SELECT document_id, max(score) AS score, arg_max(passage, (score, -passage)) AS passage FROM {v} GROUP BY document_id"


@query(f"WITH {_VEC} {_BEST.format(v='v')} ORDER BY score DESC, document_id LIMIT 50")
def vector_topk_docs(spark, sf_dir):
    return semantic.top(_vectors(spark, sf_dir), _probe(spark, sf_dir))


@query(f"WITH {_VEC}, w AS (SELECT * FROM v WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1)) {_BEST.format(v='w')} ORDER BY score DESC, document_id LIMIT 5")
def vector_scoped_topk(spark, sf_dir):
    """The scope is a table: documents labelled as of quality."""
    scope = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("long").alias("document_id"))
    return semantic.top(_vectors(spark, sf_dir), _probe(spark, sf_dir), 5, scope)


@query("""SELECT vec_id::BIGINT AS passage, len(embedding) = 64 AND abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-4 AS ok FROM embeddings""")
def vector_validation(spark, sf_dir):
    return semantic.checked(_vectors(spark, sf_dir), 64).select("passage", "ok")


@query("""SELECT count(*) AS eligible, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS indexed,
  CASE WHEN count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) = 0 THEN 'missing-index' WHEN count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) < count(*) THEN 'partial' ELSE 'ready' END AS status
FROM (SELECT DISTINCT doc_id FROM documents WHERE length(trim(text)) > 0)""")
def vector_coverage(spark, sf_dir):
    return maintenance.coverage(_docs(spark, sf_dir).where(F.length(F.trim("text")) > 0), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")))


_HASH = "sha256('passage: ' || source || '. ' || text)"


@query(f"""WITH p AS (SELECT doc_id, {_HASH} AS content_hash FROM documents), k AS (SELECT doc_id, content_hash FROM p WHERE doc_id % 3 <> 0)
SELECT count(*) FILTER ((doc_id, content_hash) IN (SELECT doc_id, content_hash FROM k)) AS reused, count(*) FILTER ((doc_id, content_hash) NOT IN (SELECT doc_id, content_hash FROM k)) AS encoded FROM p""")
def passage_hash_reuse(spark, sf_dir):
    text = semantic.passage_input(F.col("source"), F.lit(None).cast("string"), F.col("text"))
    p = _docs(spark, sf_dir).select("doc_id", F.sha2(text.cast("binary"), 256).alias("content_hash"))
    known = p.where("doc_id % 3 <> 0")
    return semantic.reused(p, known).agg(F.count("*").alias("reused")).crossJoin(semantic.to_encode(p, known).agg(F.count("*").alias("encoded")))


@query()
def semantic_passages(spark, sf_dir):
    return semantic.passages(sections(_docs(spark, sf_dir)))


@query(f"""WITH {SECTIONS}, h AS (SELECT doc_id, ordinal AS hit FROM sec WHERE contains(text, 'idiot')),
r AS (SELECT s.doc_id, hit, ordinal, substr(text, 1, 2048) AS t, sign(ordinal - hit) AS side FROM h JOIN sec s ON s.doc_id = h.doc_id AND abs(ordinal - hit) <= 4),
b AS (SELECT *, 4096 - coalesce(sum(length(t)) OVER (PARTITION BY doc_id, hit, side ORDER BY abs(ordinal - hit) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r)
SELECT doc_id, hit, ordinal, substr(t, 1, room::BIGINT) AS text FROM b WHERE room > 0""")
def context_neighbours(spark, sf_dir):
    s = sections(_docs(spark, sf_dir))
    return semantic.neighbours(s, s.where(F.col("text").contains("idiot")).select("doc_id", "ordinal"))
