"""Registered queries over the catalogue: lists, folder trees, ordering, scopes, transfers, maintenance.

The folder tree is made of region, nation and customer: a region is a folder at depth 0, a nation one at depth 1, and
a customer is a document placed in its nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import evaluation, library, maintenance
from lexiloom.sources.files import format_of
from lexiloom.sources.tables import sections, table

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


def folders(spark, sf_dir):
    """id, parent_id, name, depth, sort_order."""
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.trim("r_name").alias("name"), F.lit(0).cast("long").alias("depth"), (F.col("r_regionkey") * 1000).cast("long").alias("sort_order"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.trim("n_name").alias("name"), F.lit(1).cast("long").alias("depth"), (F.col("n_nationkey") * 1000).cast("long").alias("sort_order"))
    return region.unionByName(nation)


def placed(spark, sf_dir):
    """document_id, folder_id, sort_order."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("document_id"), F.col("c_nationkey").cast("long").alias("folder_id"), (F.col("c_custkey") * 1000).cast("long").alias("sort_order"))


FOLDERS = """folders AS (
  SELECT (r_regionkey + 1000)::BIGINT AS id, NULL::BIGINT AS parent_id, trim(r_name) AS name, 0::BIGINT AS depth, (r_regionkey * 1000)::BIGINT AS sort_order FROM region
  UNION ALL SELECT n_nationkey::BIGINT, (n_regionkey + 1000)::BIGINT, trim(n_name), 1::BIGINT, (n_nationkey * 1000)::BIGINT FROM nation),
placed AS (SELECT c_custkey::BIGINT AS document_id, c_nationkey::BIGINT AS folder_id, (c_custkey * 1000)::BIGINT AS sort_order FROM customer)"""


@query("SELECT doc_id, source, lang, n_chars FROM documents ORDER BY doc_id DESC LIMIT 100")
def documents_newest_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").orderBy(F.desc("doc_id")).limit(100)


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 42")
def document_point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == 42).select("doc_id", "source", "n_chars")


@query("SELECT sha256(text) AS id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_content_hash(spark, sf_dir):
    """Import of contents by their hash: the first of equal ones is kept."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_FORMAT = """CASE WHEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm', 'xhtml') THEN 'html'
  WHEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) = 'epub' THEN 'epub' WHEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) = 'pdf' THEN 'pdf'
  WHEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) IN ('md', 'markdown') THEN 'markdown' WHEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) = 'txt' THEN 'txt'
  WHEN starts_with(head, 'PK') THEN 'epub' WHEN starts_with(head, '%PDF-') THEN 'pdf' WHEN starts_with(ltrim(head), '<') THEN 'html'
  WHEN head = '' OR regexp_matches(head, '[\\x00-\\x08\\x0e-\\x1f]') THEN 'unknown' ELSE 'txt' END"""


@query(f"""WITH f AS (SELECT 'p' || page_id AS id, url, substr(html, 1, 512) AS head FROM pages UNION ALL SELECT 'd' || doc_id, source, substr(text, 1, 512) FROM documents)
SELECT id, {_FORMAT} AS format FROM f""")
def format_sniff(spark, sf_dir):
    """Formats by extension, else by the first characters."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url", F.substring("html", 1, 512).alias("head"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("url"), F.substring("text", 1, 512).alias("head"))
    return pages.unionByName(docs).select("id", format_of(F.col("url"), F.col("head")).alias("format"))


@query("""WITH t AS (SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) AS solid, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS words,
  length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS alnum, length(regexp_replace(text, '[^�]', '', 'g')) AS bad FROM documents)
SELECT doc_id, solid >= 32 AND words >= 4 AND alnum * 2 >= solid AND bad * 10 <= solid AS usable, CASE WHEN solid = 0 THEN 'recognition-required' ELSE 'ready' END AS text_status FROM t""")
def usable_text_flags(spark, sf_dir):
    t = F.col("text")
    status = F.when(F.length(F.regexp_replace(t, r"[ \t\n\r]", "")) == 0, "recognition-required").otherwise("ready")
    return table(spark, sf_dir, "documents").select("doc_id", T.usable_text(t).alias("usable"), status.alias("text_status"))


# folder trees

_TREE = f"""WITH RECURSIVE {FOLDERS}, tree AS (SELECT id, parent_id, name, depth, id AS root, name AS path, 0::BIGINT AS level FROM folders
  UNION ALL SELECT f.id, f.parent_id, f.name, f.depth, t.root, t.path || ' / ' || f.name, t.level + 1 FROM tree t JOIN folders f ON f.parent_id = t.id)"""


@query(f"{_TREE} SELECT id, level FROM tree WHERE root = 1001")
def folder_subtree(spark, sf_dir):
    return library.subtree(folders(spark, sf_dir), 1001)


@query(f"{_TREE} SELECT root AS id, count(p.document_id) AS documents, count(DISTINCT t.id) - 1 AS folders FROM tree t LEFT JOIN placed p ON p.folder_id = t.id GROUP BY root")
def folder_counts(spark, sf_dir):
    return library.counts(folders(spark, sf_dir), placed(spark, sf_dir))


@query(f"{_TREE} SELECT id, path FROM tree JOIN folders f USING (id) WHERE root IN (SELECT id FROM folders WHERE parent_id IS NULL)")
def folder_paths(spark, sf_dir):
    return library.paths(folders(spark, sf_dir)).select("id", "path")


@query(f"{_TREE} SELECT root AS id, max(level) AS height, max(depth) AS deepest FROM tree GROUP BY root")
def folder_depths(spark, sf_dir):
    return library.heights(folders(spark, sf_dir))


@query(f"{_TREE} SELECT p.document_id, p.folder_id, p.sort_order FROM tree t JOIN placed p ON p.folder_id = t.id WHERE t.root = 1002 ORDER BY folder_id, sort_order, document_id")
def subtree_documents(spark, sf_dir):
    return library.documents_below(folders(spark, sf_dir), placed(spark, sf_dir), 1002).orderBy("folder_id", "sort_order", "document_id")


_MOVES = [(1001, 1002), (1001, 5), (3, 1003), (1003, 1003), (2, 2), (4, None), (99999, 1001), (7, 99999)]
_MOVES_SQL = ", ".join(f"({a}::BIGINT, {'NULL' if b is None else b}::BIGINT)" for a, b in _MOVES)


@query(f"""{_TREE}, mv(id, target) AS (VALUES {_MOVES_SQL}), h AS (SELECT root AS id, max(level) AS height FROM tree GROUP BY root)
SELECT mv.id, coalesce(mv.target, -1) AS target, CASE WHEN f.id IS NULL THEN 'missing' WHEN mv.target IS NOT NULL AND t.id IS NULL THEN 'no-target'
  WHEN EXISTS (SELECT 1 FROM tree x WHERE x.root = mv.id AND x.id = mv.target) THEN 'into-itself'
  WHEN coalesce(t.depth + 1, 0) + h.height > 4 THEN 'too-deep' ELSE 'ok' END AS verdict
FROM mv LEFT JOIN folders f ON f.id = mv.id LEFT JOIN folders t ON t.id = mv.target LEFT JOIN h ON h.id = mv.id""")
def move_validation(spark, sf_dir):
    moves = spark.createDataFrame(_MOVES, "id long, target long")
    return library.checked_moves(folders(spark, sf_dir), moves).withColumn("target", F.coalesce("target", F.lit(-1).cast("long")))


@query(f"""WITH {FOLDERS}, want AS (SELECT n_nationkey::BIGINT AS id, (n_regionkey + 1000)::BIGINT AS parent_id FROM nation WHERE n_nationkey <> 3),
j AS (SELECT coalesce(f.parent_id, w.parent_id) AS parent_id, f.id IS NULL OR w.id IS NULL AS wrong FROM (SELECT * FROM folders WHERE parent_id IS NOT NULL) f FULL JOIN want w ON f.id = w.id AND f.parent_id = w.parent_id)
SELECT parent_id, NOT bool_or(wrong) AS complete FROM j GROUP BY parent_id""")
def reorder_validation(spark, sf_dir):
    """A new order must name exactly the siblings that are there."""
    want = table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"))
    return library.complete_orders(folders(spark, sf_dir).where("parent_id IS NOT NULL"), want)


@query(f"""WITH {FOLDERS} SELECT id, parent_id, (row_number() OVER (PARTITION BY parent_id ORDER BY name) - 1) * 1000 AS sort_order FROM folders WHERE parent_id IS NOT NULL""")
def reordered_siblings(spark, sf_dir):
    return library.renumbered(folders(spark, sf_dir).where("parent_id IS NOT NULL"), "parent_id", "name")


@query(f"""WITH {FOLDERS} SELECT coalesce(parent_id, -1) AS parent_id, (max(sort_order) + 1000)::BIGINT AS next_order FROM (SELECT parent_id, sort_order FROM folders UNION ALL SELECT folder_id, sort_order FROM placed) GROUP BY parent_id""")
def next_sort_order(spark, sf_dir):
    return library.next_orders(folders(spark, sf_dir), placed(spark, sf_dir)).withColumn("parent_id", F.coalesce("parent_id", F.lit(-1).cast("long")))


@query(f"WITH {FOLDERS} SELECT id, coalesce(parent_id, -1) AS parent_id, sort_order, name FROM folders ORDER BY parent_id IS NOT NULL, parent_id, sort_order, name")
def organization_listing(spark, sf_dir):
    f = folders(spark, sf_dir).select("id", "parent_id", "sort_order", "name")
    return f.orderBy(F.col("parent_id").isNotNull(), "parent_id", "sort_order", "name").withColumn("parent_id", F.coalesce("parent_id", F.lit(-1).cast("long")))


@query("""WITH a AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ''), 'Uncategorized') AS author, url FROM pages)
SELECT author, count(*) AS documents, string_agg(page_id::VARCHAR, ',' ORDER BY url, page_id) AS pages FROM a GROUP BY author ORDER BY author = 'Uncategorized', author""")
def group_by_author_sorted(spark, sf_dir):
    author = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("Uncategorized"))
    return library.grouped(table(spark, sf_dir, "pages").select("page_id", "url", author.alias("author")))


@query(f"""{_TREE}, picked AS (SELECT document_id, folder_id FROM placed WHERE document_id % 97 = 5 UNION SELECT document_id, folder_id FROM placed JOIN orders ON o_custkey = document_id WHERE o_orderkey % 501 = 7)
SELECT 'document' AS kind, document_id AS id FROM picked UNION SELECT 'folder', root FROM tree WHERE id IN (SELECT folder_id FROM picked)""")
def transfer_closure(spark, sf_dir):
    """Selected documents, those that selected recordings (orders) need, and the folders above them."""
    p = placed(spark, sf_dir)
    needed = table(spark, sf_dir, "orders").where("o_orderkey % 501 = 7").select(F.col("o_custkey").cast("long").alias("document_id")).distinct()
    return library.transfer_closure(folders(spark, sf_dir), p, p.where("document_id % 97 = 5").select("document_id"), needed)


@query("SELECT count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, (sum(strlen(text)) * 3 + 67108864)::BIGINT AS reserve, count(DISTINCT sha256(text)) AS contents FROM documents")
def transfer_checksums(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("documents"), F.sum(F.octet_length(t)).cast("long").alias("bytes"), (F.sum(F.octet_length(t)) * 3 + 67108864).cast("long").alias("reserve"), F.countDistinct(F.sha2(t.cast("binary"), 256)).alias("contents")
    )


@query("""WITH m AS (SELECT 'path' AS rule, source AS id FROM documents WHERE NOT regexp_matches(source, '^[a-z0-9]+$')
  UNION ALL SELECT 'size', doc_id::VARCHAR FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'duplicate', sha256(text) FROM documents GROUP BY text HAVING count(*) > 1)
SELECT rule, count(*) AS violations FROM m GROUP BY rule""")
def manifest_violations(spark, sf_dir):
    """Rules that a transfer's manifest breaks, with how often."""
    d = table(spark, sf_dir, "documents")
    return maintenance.violations(
        {
            "path": d.where(~F.col("source").rlike("^[a-z0-9]+$")),
            "size": d.where(F.col("n_chars") != F.length("text")),
            "duplicate": d.groupBy(F.sha2(F.col("text").cast("binary"), 256)).count().where("count > 1"),
        }
    )


# maintenance

@query("""SELECT user_id, count(*) AS selected, count(*) FILTER (event_type IN ('purchase', 'signup')) AS imported, count(*) FILTER (event_type = 'view') AS existing,
  count(*) FILTER (event_type NOT IN ('purchase', 'signup', 'view')) AS failed FROM events GROUP BY user_id""")
def job_outcome_counts(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("selected"), F.count_if(e.isin("purchase", "signup")).alias("imported"), F.count_if(e == "view").alias("existing"), F.count_if(~e.isin("purchase", "signup", "view")).alias("failed"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return evaluation.nearest_rank(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def event_log_newest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND length(trim(text)) > 0")
def backfill_pending(spark, sf_dir):
    """Documents with text that aren't indexed yet (here: labelled)."""
    return maintenance.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""WITH fresh AS (SELECT doc_id, text || '+' AS text, source FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT doc_id + 10000000, text, 'new' FROM documents WHERE doc_id % 50 = 1)
SELECT doc_id, sha256(text) AS content, source FROM fresh UNION ALL SELECT doc_id, sha256(text), source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fresh)""")
def upsert_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    fresh = d.where("doc_id % 10 = 3").withColumn("text", F.concat("text", F.lit("+"))).unionByName(d.where("doc_id % 50 = 1").withColumn("doc_id", F.col("doc_id") + 10000000).withColumn("source", F.lit("new")))
    return maintenance.upserted(d, fresh, "doc_id").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content"), "source")


@query("""WITH gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM gone)) AS deleted, coalesce(sum(strlen(text)) FILTER (doc_id IN (SELECT doc_id FROM gone)), 0)::BIGINT AS freed,
  count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM gone)) AS kept FROM documents""")
def batch_delete_outcome(spark, sf_dir):
    return maintenance.deletion(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))


@query("""SELECT s.doc_id, s.content AS before, t.content AS after, CASE WHEN s.doc_id IS NULL THEN 'insert' WHEN t.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change
FROM (SELECT doc_id, sha256(text) AS content FROM documents WHERE doc_id % 7 <> 1) s FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 2 THEN text || '!' ELSE text END) AS content FROM documents WHERE doc_id % 7 <> 2) t USING (doc_id)
WHERE s.content IS DISTINCT FROM t.content""".replace("SELECT s.doc_id,", "SELECT doc_id,"))
def snapshot_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = d.where("doc_id % 7 <> 2").withColumn("text", F.when(F.expr("doc_id % 11 = 2"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return maintenance.changes(d.where("doc_id % 7 <> 1"), now, "doc_id", "text")


@query("SELECT doc_id, 'upload:lexical:' || doc_id || ':0' AS result_id, CASE WHEN n_chars >= 1073741824 THEN 'large' ELSE greatest(1, ceil(n_chars / 1048576.0))::BIGINT || ' MB' END AS size FROM documents")
def result_projection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("upload:lexical:"), F.col("doc_id").cast("string"), F.lit(":0")).alias("result_id"), T.storage_size(F.col("n_chars")).alias("size"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(lang), 'es')")
def catalogue_filter(spark, sf_dir):
    return library.matching(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "SRC1", "source").unionByName(library.matching(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "es", "lang")).dropDuplicates(["doc_id"]).select("doc_id", "source")


@query(f"""WITH {SECTIONS} SELECT doc_id, count(*) AS sections, count(*) FILTER (trim(text) = '') AS blank, max(length(text))::BIGINT AS longest FROM sec GROUP BY doc_id""")
def section_summary(spark, sf_dir):
    t = F.col("text")
    return sections(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("sections"), F.count_if(F.trim(t) == "").alias("blank"), F.max(F.length(t)).cast("long").alias("longest"))
