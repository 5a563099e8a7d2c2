"""Pages of positioned text: lines, running headers and footers, notes, quality of recognition.

blocks: document_id, page_index, order, text, x, y, w, h, confidence (null for born-digital text). Geometry has its origin at
the top left, y growing downwards; height: the page's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Centres within this share of the height are on one line.
SAME_LINE = 0.45
#: Pages on which a line must stand to be a running one.
RUNNING = 3


def lines(blocks: DataFrame) -> DataFrame:
    """document_id, page_index, line, text, x, y, w, h, confidence: blocks of one line joined by a space, in order.

    A line ends where a block ends in a newline or where the next block's centre is off by more than SAME_LINE of the height.
    """
    page = W.partitionBy("document_id", "page_index").orderBy("order")
    centre = F.col("y") + F.col("h") / 2
    rows = blocks.withColumn("centre", centre)
    last = lambda c: F.lag(c).over(page)
    far = F.abs(F.col("centre") - last("centre")) > SAME_LINE * F.greatest("h", last("h"))
    rows = rows.withColumn("new", F.coalesce(last("text").endswith("\n") | far, F.lit(False)).cast("long"))
    rows = rows.withColumn("line", F.sum("new").over(page.rowsBetween(W.unboundedPreceding, 0)))
    per = rows.groupBy("document_id", "page_index", "line").agg(
        F.array_sort(F.collect_list(F.struct("order", "text"))).alias("own"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        (F.sum(F.col("confidence") * F.length("text")) / F.sum(F.when(F.col("confidence").isNotNull(), F.length("text")))).alias("confidence"),
    )
    text = F.trim(F.array_join(F.filter(F.transform("own", lambda o: F.trim(F.replace(o["text"], F.lit("\n"), F.lit(" ")))), lambda t: t != ""), " "))
    return per.select("document_id", "page_index", "line", text.alias("text"), "x", "y", "w", "h", "confidence")


def edge_key(text: Column) -> Column:
    """A line without its numbers, by which running headers are recognised."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"\s+", " "))


def running_lines(edges: DataFrame, least: int = RUNNING) -> DataFrame:
    """edges: document_id, page_index, text of first and last lines. document_id, key, pages of those on many pages."""
    rows = edges.select("document_id", "page_index", edge_key(F.col("text")).alias("key")).where("key != ''")
    return rows.groupBy("document_id", "key").agg(F.countDistinct("page_index").alias("pages")).where(F.col("pages") >= least)


def dehyphenated(t: Column) -> Column:
    """Words wrapped at a hyphen joined: small letters, or a capital before a letter."""
    t = F.regexp_replace(t, r"(?<=\p{Ll})[-‐‑­]\n(?=\p{Ll})", "")
    return F.regexp_replace(t, r"(?<=\p{Lu})[-‐‑­]\n(?=\p{L})", "")


def without_furniture(rows: DataFrame, running: DataFrame, heights: DataFrame) -> DataFrame:
    """Lines without running headers and footers, bare page numbers at the edge, and small notes at the foot.

    heights: document_id, page_index, height. The note test is against the upper median of the page's line heights.
    """
    page = W.partitionBy("document_id", "page_index")
    rows = rows.join(heights, ["document_id", "page_index"])
    n = F.count("*").over(page)
    rows = rows.withColumn("n", n).withColumn("at", F.row_number().over(page.orderBy("line")))
    rows = rows.withColumn("sizes", F.sort_array(F.collect_list("h").over(page)))
    rows = rows.withColumn("median", F.element_at("sizes", (F.size("sizes") / 2).cast("int") + 1))
    rows = rows.withColumn("key", edge_key(F.col("text"))).join(running.select("document_id", "key", "pages"), ["document_id", "key"], "left")
    edge = (F.col("at") <= 2) | (F.col("at") > F.col("n") - 2)
    furniture = edge & (F.col("pages").isNotNull() | F.col("text").rlike(r"^[0-9ivxlc]+$"))
    note = (F.col("y") > 0.7 * F.col("height")) & (F.col("h") < 0.85 * F.col("median"))
    return rows.where(~furniture & ~note).drop("n", "at", "sizes", "median", "key", "pages", "height")


def quality(blocks: DataFrame) -> DataFrame:
    """document_id, page_index, chars, confidence (weighted by length)."""
    size = F.length("text")
    return blocks.groupBy("document_id", "page_index").agg(F.sum(size).alias("chars"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))


def contents_page(rows: DataFrame) -> DataFrame:
    """document_id, page_index of pages that list contents: 8 lines or more that end in a number, half of all, two with leaders."""
    t = F.col("text")
    numbered, led = t.rlike(r"[0-9]+\s*$"), t.rlike(r"(\.\s?){3,}")
    per = rows.groupBy("document_id", "page_index").agg(F.count("*").alias("n"), F.count_if(numbered).alias("numbered"), F.count_if(led).alias("led"))
    return per.where("numbered >= 8 AND numbered * 2 >= n AND led >= 2").select("document_id", "page_index")


def paragraphs(rows: DataFrame) -> DataFrame:
    """document_id, paragraph, text, first_page, last_page: lines joined while the gap stays small and the text goes on.

    A paragraph ends at a gap of more than 0.8 lines, an indented line, or a line that ends a sentence well before the margin.
    """
    w = W.partitionBy("document_id").orderBy("page_index", "line")
    last = lambda c: F.lag(c).over(w)
    right = F.max(F.col("x") + F.col("w")).over(W.partitionBy("document_id", "page_index"))
    rows = rows.withColumn("right", right)
    same = F.col("page_index") == last("page_index")
    gap = F.col("y") - (last("y") + last("h")) > 0.8 * F.greatest("h", last("h"))
    indent = F.col("x") - last("x") > F.col("h")
    short = (last("right") - (last("x") + last("w")) > 2 * F.col("h")) & last("text").rlike(r"[.!?:][\"'”’)\]]*$")
    seam = ~same & last("text").rlike(r"[.!?][\"'”’)\]]*$")
    rows = rows.withColumn("new", F.coalesce((same & (gap | indent)) | short | seam, F.lit(False)).cast("long"))
    rows = rows.withColumn("paragraph", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    per = rows.groupBy("document_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page_index", "line", "text"))).alias("own"), F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"))
    text = dehyphenated(F.array_join(F.transform("own", lambda o: o["text"]), "\n"))
    return per.select("document_id", "paragraph", F.regexp_replace(text, "\n", " ").alias("text"), "first_page", "last_page")


def compounds(sections: DataFrame) -> DataFrame:
    """doc_id, word: distinct words with an inner hyphen, in lower case; evidence that a wrapped word keeps its hyphen."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}-])\p{L}+(?:-\p{L}+)+(?![\p{L}-])"), F.lit(0))
    return sections.select("doc_id", F.explode_outer(found).alias("word")).where("word IS NOT NULL").distinct()


def reference_lists(rows: DataFrame, least: int = 3) -> DataFrame:
    """document_id, page_index of pages with numbered references: lines that begin with [n] or n., each one more than the last."""
    n = F.regexp_extract("text", r"^\s*\[?([0-9]{1,3})[\].]\s+\S", 1)
    own = rows.select("document_id", "page_index", "line", F.nullif(n, F.lit("")).cast("int").alias("n")).where("n IS NOT NULL")
    w = W.partitionBy("document_id", "page_index").orderBy("line")
    own = own.withColumn("next", F.lead("n").over(w))
    per = own.groupBy("document_id", "page_index").agg(F.count("*").alias("lines"), F.bool_and(F.coalesce(F.col("next") == F.col("n") + 1, F.lit(True))).alias("sequential"))
    return per.where((F.col("lines") >= least) & F.col("sequential")).select("document_id", "page_index")


def index_entry(text: Column) -> Column:
    """Whether a line is an entry of a subject index: words, then page numbers or ranges; or a reference to another entry."""
    return text.rlike(r"^\s*\p{L}[^0-9.]{0,80}?,?\s+[0-9]{1,4}(?:[-–][0-9]{1,4})?(?:,\s*[0-9]{1,4}(?:[-–][0-9]{1,4})?)*\.?\s*$") | text.rlike(r"(?i)^\s*\p{L}.{0,80}[,.;]\s+see(?: also)?\s+\p{L}")


def page_reference(text: Column) -> Column:
    """The page number that a line of contents names, else null."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[\s.…])([0-9]{1,4})\s*$", 1), F.lit("")).cast("int")


def document_title(metadata: Column, fallback: Column) -> Column:
    return F.substring(F.coalesce(F.nullif(F.trim(metadata), F.lit("")), fallback), 1, 512)


def fitted(width: Column, height: Column, most_width: int = 480, most_height: int = 720) -> Column:
    """The scale at which a picture fits; never enlarged."""
    return F.least(F.lit(1.0), F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)


def render_scale(width: Column, height: Column, pixels: float = 9e6, dpi: float = 300.0) -> Column:
    """The scale at which a page is rendered for recognition."""
    return F.least(F.lit(dpi / 72), F.sqrt(F.lit(pixels) / (width * height)))
