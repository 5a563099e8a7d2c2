"""Registered queries over small given inputs, for operators whose inputs the tables don't have: files, books, page layouts, trees of
folders, recordings, requests. Their SQL states the rows that the definitions demand."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.engine import Library
from lexiloom.functions import speech, stemming, text as T
from lexiloom.operators import alignment, analysis, evidence, layout, library, maintenance, semantic, timing, transfer
from lexiloom.plans.index import Conflict, Index
from lexiloom.sources import epub, files, html, importer, markdown

from .streams import _work

QUERIES: dict = {}
ORACLES: dict = {}

_SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _sql(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def case(ddl: str, *rows: tuple):
    """Registers a query of (spark) that must give the rows, of the ddl's columns."""
    fields = [f.split() for f in ddl.split(", ")]
    values = ", ".join("(" + ", ".join(_sql(x) for x in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(c{i} AS {_SQL_TYPES[kind]}) AS {name}" for i, (name, kind) in enumerate(fields))
    sql = f"SELECT {cols} FROM (VALUES {values}) v({', '.join(f'c{i}' for i in range(len(fields)))})"

    def add(f: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark)
            if isinstance(out, list):
                out = spark.createDataFrame(out, ddl)
            return out.select(*[F.col(name).cast({"long": "bigint"}.get(kind, kind)).alias(name) for name, kind in fields])

        run.__doc__ = f.__doc__
        QUERIES[f"case_{f.__name__}"] = run
        ORACLES[f"case_{f.__name__}"] = sql
        return f

    return add


def _column(spark: SparkSession, ddl: str, rows: list[tuple], **columns) -> DataFrame:
    return spark.createDataFrame(rows, ddl).withColumns(columns)


# files and books


def _book(nav: bool = True, kind: bytes = b"application/epub+zip") -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("mimetype", kind)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="B/b.opf"/></rootfiles></container>')
        z.writestr(
            "B/b.opf",
            '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Tides</dc:title></metadata><manifest>'
            f'<item id="n" href="n.xhtml" media-type="application/xhtml+xml"{" properties=\"nav\"" if nav else ""}/><item id="t" href="t.ncx" media-type="application/x-dtbncx+xml"/>'
            '<item id="one" href="one.xhtml" media-type="application/xhtml+xml"/><item id="two" href="two%20b.xhtml" media-type="application/xhtml+xml"/></manifest>'
            '<spine toc="t"><itemref idref="one"/><itemref idref="two"/></spine></package>',
        )
        z.writestr("B/n.xhtml", '<html xmlns:epub="e"><body><nav epub:type="toc"><ol><li><a href="one.xhtml">Ebb</a><ol><li><a href="two%20b.xhtml#s">Flow</a></li></ol></li></ol></nav></body></html>')
        z.writestr("B/t.ncx", '<ncx><navMap><navPoint><navLabel><text>By NCX</text></navLabel><content src="one.xhtml"/></navPoint></navMap></ncx>')
        z.writestr("B/one.xhtml", '<html><body><h1>Ebb</h1><p>Low <a href="two%20b.xhtml#s">see</a> <a href="../../out">out</a><script>x()</script></p></body></html>')
        z.writestr("B/two b.xhtml", '<html><body><p id="s">High water</p></body></html>')
    return data.getvalue()


_FILES = [
    ("page.html", "in", b"<title>Moor</title><p>heath"), ("again.html", "in", b"<title>Moor</title><p>heath"), ("plain.txt", "", b"first\n\nsecond"), ("notes.md", "", b"# Reed\n\nmarsh"),
    ("wide.txt", "", "sé".encode("utf-16")), ("guess.txt", "", b"caf\xe9"), ("nothing.html", "", b""), ("odd.bin", "", b"\x00\x01\x02"), ("scan.pdf", "", b"%PDF-1.4"), ("fake.pdf", "", b"no pdf"), ("known.txt", "", b"had before"),
]


def _import(spark: SparkSession) -> importer.Imported:
    rows = [*_FILES, ("tides.epub", "in", _book()), ("broken.epub", "in", b"PK broken")]
    known = spark.createDataFrame([(importer.document_id(b"had before", "txt"),)], "id string")
    return importer.imported(spark.createDataFrame(rows, "name string, folder string, content binary"), known)


@case(
    "name string, status string",
    ("again.html", "imported"), ("page.html", "already-in-library"), ("plain.txt", "imported"), ("notes.md", "imported"), ("wide.txt", "imported"), ("guess.txt", "failed"), ("nothing.html", "failed"),
    ("odd.bin", "failed"), ("scan.pdf", "imported"), ("fake.pdf", "failed"), ("known.txt", "already-in-library"), ("tides.epub", "imported"), ("broken.epub", "failed"),
)
def import_statuses(spark):
    """SRC-1, 3, 7, 10, 12, 13, 14, 16: what becomes of each file of a batch."""
    return _import(spark).outcomes


@case("title string, format string, sections long, text_status string", ("Moor", "html", 1, "ready"), ("plain", "txt", 2, "ready"), ("notes", "markdown", 2, "ready"), ("wide", "txt", 1, "ready"), ("scan", "pdf", 0, "processing"), ("Tides", "epub", 3, "ready"))
def import_documents(spark):
    """SRC-1, 3, 7, 10, 12: the documents that a batch makes."""
    return _import(spark).documents


@case("k long, text string, error string", (0, "café", None), (1, "é", None), (2, None, "encoding"), (3, "<meta charset=latin-1>é", None), (4, None, "missing"))
def decoded_bytes(spark):
    """SRC-2, 10: bytes to text, never guessed for plain text."""
    rows = [(0, b"\xef\xbb\xbfcaf\xc3\xa9", "txt"), (1, "é".encode("utf-16"), "txt"), (2, b"\xe9", "txt"), (3, b"<meta charset=latin-1>\xe9", "html"), (4, None, "txt")]
    out = spark.createDataFrame(rows, "k long, content binary, format string").select("k", files.decode("content", "format").alias("d"))
    return out.select("k", F.col("d.*")).toDF("k", "text", "error")


@case("id string, text_status string", ("whole", "ready"), ("part", "processing"), ("blank", "recognition-required"), ("none", "processing"))
def staged_pages(spark):
    """SRC-7, 9: a staged document is published when all its pages are there."""
    docs = spark.createDataFrame([("whole", 2), ("part", 3), ("blank", 1), ("none", 1)], "id string, pages int")
    pages = [("whole", 0, "a"), ("whole", 1, ""), ("part", 0, "a"), ("part", 2, "c"), ("blank", 0, " \n")]
    return importer.finalized(docs, spark.createDataFrame(pages, "id string, page_index int, text string"))


@case("id string, ordinal long, text string", ("good", 0, "Ebb"), ("good", 1, "Low see out"), ("good", 2, "High water"))
def book_sections(spark):
    """SRC-3: the sections of a book in the order of its spine; books that aren't ones give none."""
    rows = [("good", _book()), ("kind", _book(kind=b"text/plain")), ("bytes", b"PK")]
    out = epub.epub_sections(spark.createDataFrame(rows, "id string, content binary")).where("error IS NULL")
    return out.withColumn("ordinal", F.col("ordinal").cast("long"))


@case("book string, depth long, label string, path string, fragment string", ("nav", 0, "Ebb", "B/one.xhtml", None), ("nav", 1, "Flow", "B/two b.xhtml", "s"), ("ncx", 0, "By NCX", "B/one.xhtml", None))
def book_outlines(spark):
    """SRC-5: the navigation document's outline, else the NCX's."""
    return [(name, r["depth"], r["label"], r["path"], r["fragment"]) for name, nav in (("nav", True), ("ncx", False)) for r in epub.Book(_book(nav)).outline()]


@case("href string, path string, fragment string", ("c.xhtml", "B/x/c.xhtml", ""), ("../c%20d.xhtml#p", "B/c d.xhtml", "p"), ("../../../c", None, None), ("/c", None, None), ("http://e.org/c", None, None), ("a\\b", None, None))
def book_paths(spark):
    """SRC-4: references in a book; what leaves it is refused."""
    out = []
    for href in ("c.xhtml", "../c%20d.xhtml#p", "../../../c", "/c", "http://e.org/c", "a\\b"):
        try:
            path, fragment = epub.resolved("B/x/y.xhtml", href)
            out.append((href, path, fragment or ""))
        except epub.BadBook:
            out.append((href, None, None))
    return out


@case("inner boolean, outer boolean, script boolean", (True, True, False))
def book_links(spark):
    """SRC-6: links within the book become fragments, others outside lose their target, and nothing acts."""
    out = epub.rewritten(epub.Book(_book()), 0)
    return [('<a href="#c1-s">see</a>' in out, "<a>out</a>" in out, "script" in out)]


@case(
    "source string, html string",
    ("# Reed\n\nmarsh *and* **fen**", "<h1>Reed</h1>\n<p>marsh <em>and</em> <strong>fen</strong></p>"), ("- one\n- two", "<ul><li>one</li><li>two</li></ul>"), ("> said", "<blockquote><p>said</p></blockquote>"),
    ("```\na < b\n```", "<pre><code>a &lt; b</code></pre>"), ("[go](http://e.org) `x<y`", '<p><a href="http://e.org">go</a> <code>x&lt;y</code></p>'),
)
def markdown_html(spark):
    """SRC-12: Markdown to HTML."""
    rows = ["# Reed\n\nmarsh *and* **fen**", "- one\n- two", "> said", "```\na < b\n```", "[go](http://e.org) `x<y`"]
    return spark.createDataFrame([(r,) for r in rows], "source string").withColumn("html", markdown.markdown_html("source"))


# pages

_PAGE = """<html><head><title>T</title></head><body><nav><p>menu</p></nav><h2 id=a>Head</h2><p onclick="x()">Body <span role="doc-footnote">note</span> end
<a href="javascript:y()">bad</a><p>Next<script>z()</script></body></html>"""


@case("ordinal long, is_heading boolean, heading string, text string, auxiliary boolean", (0, False, None, "menu", True), (1, True, "Head", "Head", False), (2, False, "Head", "Body note end bad", False), (3, False, "Head", "Next", False))
def page_blocks(spark):
    """STR-8, FLT-11: the readable blocks of a page, and which are auxiliary."""
    return html.html_sections(spark.createDataFrame([(1, _PAGE)], "page_id long, html string"))


@case("ordinal long, part string", (2, "Body"), (2, "end bad"), (3, "Next"))
def page_body_ranges(spark):
    """STR-9: the ranges of a block that are its body; headings are none."""
    return [(i, s["text"][r["start"] : r["end"]].strip()) for i, s in enumerate(html.sections_of(_PAGE)) for r in s["body"]]


@case("kept_id boolean, acts boolean, complete boolean, incomplete boolean", (True, False, True, False))
def page_sanitised(spark):
    """STR-3, 10: allowed markup stays, nothing acts; every section has its locator."""
    out, marked, n = html.sanitised(_PAGE), html.with_locators(_PAGE), len(html.sections_of(_PAGE))
    return [('<h2 id="a">Head</h2>' in out, any(x in out for x in ("onclick", "script", "z()")), html.complete_locators(marked, n), html.complete_locators(marked, n + 1))]


@case("page_id long, label string, parent long", (1, "A", None), (1, "B", 0), (1, "C", 2), (1, "D", 0), (1, "E", None))
def page_outline(spark):
    """WIN-9: the outline by ranks; a page with one heading has none."""
    rows = [(1, 0, 1, "A"), (1, 2, 3, "B"), (1, 4, 5, "C"), (1, 6, 2, "D"), (1, 8, 1, "E"), (2, 0, 1, "alone")]
    return html.outline(spark.createDataFrame(rows, "page_id long, ordinal int, rank int, text string"))


# requests


@case("query string, outcome string", ("a few words", "ok"), ("4096 characters", "ok"), ("4097 characters", "too long"), ("too many words", "too long"))
def query_limits(spark):
    """FLT-1, 2: requests that are too long are refused, not cut."""
    out = []
    for name, q in (("a few words", "a few words"), ("4096 characters", "x" * 4096), ("4097 characters", "x" * 4097), ("too many words", "x " * (analysis.MAX_TERMS + 1))):
        try:
            analysis.check_limits(q)
            out.append((name, "ok"))
        except analysis.QueryTooLong:
            out.append((name, "too long"))
    return out


@case("query string, phrases string, rest string", ('tide "low water" mark', "low water", "tide mark"), ("“one “two” three” x", "one “two” three", "x"), ('"..." y', "", "y"), ('"open', None, None), ("shut”", None, None))
def query_quotes(spark):
    """FLT-3: straight and curly quotes; curly ones nest; an open one is an error."""
    out = []
    for q in ('tide "low water" mark', "“one “two” three” x", '"..." y', '"open', "shut”"):
        try:
            p = analysis.parse(q)
            out.append((q, "|".join(p.phrases), p.unquoted))
        except analysis.UnbalancedQuotes:
            out.append((q, None, None))
    return out


@case("query string, terms string", ("High- lights of the e‐mail!", "High-lights of the e-mail"), ("(a) ’b c_d", "a b c_d"), ("!!", ""))
def query_terms(spark):
    """FTS-2, 4: terms of a request, inner hyphens kept."""
    return [(q, " ".join(analysis.terms(q))) for q in ("High- lights of the e‐mail!", "(a) ’b c_d", "!!")]


@case("term string, written string", ("e-mail", "e mail|email"), ("plain", "plain"), ("a-b-c", "a b c|a bc|ab c|abc"))
def query_aliases(spark):
    """FTS-3: the ways to write a term with hyphens."""
    return [(t, "|".join(sorted(" ".join(a) for a in analysis.aliases(t)))) for t in ("e-mail", "plain", "a-b-c")]


@case("query string, usual long, broader long", ("one", 0, 0), ("one two", 2, 2), ("a a b", 2, 2), ("a b c d e f g", 0, 7), ('"p q" a b', 0, 2))
def query_comparison(spark):
    """FTS-21: distinct terms whose coverage is compared."""
    return [(q, len(analysis.comparison_terms(p)), len(analysis.comparison_terms(p, True))) for q in ("one", "one two", "a a b", "a b c d e f g", '"p q" a b') for p in [analysis.parse(q)]]


@case("excerpt string, safe string", ("a <mark>b</mark> <i>c</i>", "a <mark>b</mark> &lt;i&gt;c&lt;/i&gt;"), ("x & y", "x &amp; y"))
def safe_excerpts(spark):
    """FTS-29: all markup but marks is escaped."""
    return _column(spark, "excerpt string", [("a <mark>b</mark> <i>c</i>",), ("x & y",)], safe=T.safe_excerpt(F.col("excerpt")))


@case("t string, first string, bare string", ("a <mark>b</mark> c <mark>d</mark>", "b", "a b c d"), ("none", "", "none"))
def marks(spark):
    """STR-11: the first marked text; texts without marks."""
    return _column(spark, "t string", [("a <mark>b</mark> c <mark>d</mark>",), ("none",)], first=F.coalesce(T.first_mark(F.col("t")), F.lit("")), bare=T.without_marks(F.col("t")))


@case("word string, stem string", ("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("relational", "relat"), ("hopefulness", "hope"), ("sky", "sky"), ("naïve", "naiv"))
def stems(spark):
    """FTS-1: Porter's stems of folded words."""
    rows = [("caresses",), ("ponies",), ("running",), ("relational",), ("hopefulness",), ("sky",), ("naïve",)]
    return _column(spark, "word string", rows, stem=F.array_join(stemming.stemmed("word"), " "))


# layout

_BLOCK = "document_id long, page_index int, order int, text string, x double, y double, w double, h double, confidence double"


def _blocks(spark: SparkSession) -> DataFrame:
    rows = []
    for p in range(3):
        page = [("River Book 4", 5, 10), ("The cur-\n", 30, 10), ("rent runs", 42, 10), ("Slow and deep here", 54, 10), ("to the sea.", 66, 10), ("small print", 180, 5)]
        rows += [(1, p, i, t, 10.0, float(y), 90.0, float(h), 0.8 if i else 0.9) for i, (t, y, h) in enumerate(page)]
    return spark.createDataFrame(rows, _BLOCK)


def _body(spark: SparkSession) -> DataFrame:
    found = layout.lines(_blocks(spark))
    heights = found.select("document_id", "page_index").distinct().withColumn("height", F.lit(200.0))
    return layout.without_furniture(found, layout.running_lines(found.where("line = 0")), heights)


@case("line long, text string", (0, "River Book 4"), (1, "The cur-"), (2, "rent runs"), (3, "Slow and deep here"), (4, "to the sea."), (5, "small print"))
def layout_lines(spark):
    """STR-14, ALN-11: blocks on one height are a line."""
    return layout.lines(_blocks(spark)).where("page_index = 0")


@case("page_index long, text string", *[(p, t) for p in range(3) for t in ("The cur-", "rent runs", "Slow and deep here", "to the sea.")])
def layout_body(spark):
    """STR-16, AGG-17: running heads and small print at the foot go."""
    return _body(spark)


@case("text string", *[("The current runs Slow and deep here to the sea.",)] * 3)
def layout_paragraphs(spark):
    """STR-15, 18, WIN-8: lines to paragraphs, wrapped words joined."""
    return layout.paragraphs(_body(spark))


@case("document_id long, page_index long", (1, 0))
def reference_pages(spark):
    """WIN-10, STR-17: numbered references that count on by one."""
    rows = [(1, 0, 0, "[4] One."), (1, 0, 1, "[5] Two."), (1, 0, 2, "[6] Three."), (1, 1, 0, "4. a"), (1, 1, 1, "6. b"), (1, 1, 2, "7. c")]
    return layout.reference_lists(spark.createDataFrame(rows, "document_id long, page_index int, line int, text string"))


@case("t string, entry boolean, page long", ("salt, 4, 9-12", True, None), ("Waves, see also Tides", True, None), ("A plain sentence.", False, None), ("On tides ....... 31", False, 31))
def index_entries(spark):
    """STR-17, 39: entries of an index and lines of a table of contents."""
    rows = [("salt, 4, 9-12",), ("Waves, see also Tides",), ("A plain sentence.",), ("On tides ....... 31",)]
    return _column(spark, "t string", rows, entry=layout.index_entry(F.col("t")), page=layout.page_reference(F.col("t")))


@case("title string", ("Given",), ("file",), ("file",))
def document_titles(spark):
    """STR-40: a document's own title, else its file's."""
    return _column(spark, "m string, f string", [(" Given ", "file"), ("  ", "file"), (None, "file")], title=F.trim(layout.document_title(F.col("m"), F.col("f"))))


@case("doc_id long, word string", (1, "low-lying"), (1, "re-enter"))
def compounds(spark):
    """AGG-18: the hyphenated words of a document, each once."""
    return layout.compounds(spark.createDataFrame([(1, "Low-lying, low-lying; re-enter - x-"), (2, "plain")], "doc_id long, text string"))


@case("page_index long, pages_apart boolean, fair boolean", (0, True, True), (1, True, True), (2, True, True))
def page_quality(spark):
    """AGG-19: confidence by page, weighted by length."""
    q = layout.quality(_blocks(spark))
    return q.select("page_index", F.lit(True).alias("pages_apart"), F.col("confidence").between(0.8, 0.9).alias("fair"))


@case("w double, h double, thumb double", (960.0, 720.0, 0.5), (480.0, 1440.0, 0.5), (100.0, 100.0, 1.0))
def thumbnail_scale(spark):
    """MTH-5: pages fit into 480 by 720, and are never enlarged."""
    return _column(spark, "w double, h double", [(960.0, 720.0), (480.0, 1440.0), (100.0, 100.0)], thumb=layout.fitted(F.col("w"), F.col("h")))


# texts


@case("t string, form string", ("مُـعلم", "معلم"), ("plain", "plain"))
def arabic_locators(spark):
    """STR-26: vowel signs and stretching go."""
    return _column(spark, "t string", [("مُـعلم",), ("plain",)], form=T.arabic_folded(F.col("t")))


@case("t string, nfc string, nfkc string", ("é", "é", "é"), ("ﬁn", "ﬁn", "fin"))
def unicode_forms(spark):
    """STR-19: normal forms."""
    return _column(spark, "t string", [("é",), ("ﬁn",)], nfc=speech.nfc("t"), nfkc=speech.nfkc("t"))


@case("t string, spoken string", ("a b  c \n\n\n\nd", "a b c\n\nd"))
def speech_texts(spark):
    """STR-20: blanks and newlines evened out."""
    return _column(spark, "t string", [("a b  c \n\n\n\nd",)], spoken=T.speech_text(F.col("t")))


@case(
    "t string, spoken string",
    ("Chapter IV begins.", "Chapter 4 begins."), ("At 9:05 we met Dr. Lane.", "At nine oh five we met Doctor Lane."), ("Pi is 3. 14 or so.", "Pi is 3.14 or so."),
    ("In 1984 it rose.", "In nineteen eighty-four it rose."), ("It cost $5 million.", "It cost 5 million dollars."), ("He paid €3.50.", "He paid three euros and fifty cents."),
)
def english_spoken(spark):
    """STR-28..33, 34: numerals, abbreviations, times, decimals, years and money in words."""
    rows = ["Chapter IV begins.", "At 9:05 we met Dr. Lane.", "Pi is 3. 14 or so.", "In 1984 it rose.", "It cost $5 million.", "He paid €3.50."]
    return _column(spark, "t string", [(r,) for r in rows], spoken=speech.speech_english("t"))


@case("text string, start_segment long, start_offset long, end_segment long, end_offset long", ("One two. Three four. Next part.", 0, 0, 1, 10))
def spoken_chunks(spark):
    """STR-23, 24: short neighbours are one chunk, which knows where it stands."""
    rows = spark.createDataFrame([(["One two. Three four.", "Next part."],)], "segments array<string>")
    return rows.select(F.explode(speech.speech_chunks("segments")).alias("c")).select("c.*")


@case("word string", ("it's",), ("well-known",), ("no",))
def word_tokens(spark):
    """STR-25, ALN-8: words with their offsets."""
    text = "it's well-known, no?"
    rows = spark.createDataFrame([(text,)], "t string").select("t", F.explode(alignment.word_spans("t")).alias("w"))
    return rows.select(F.expr("substring(t, w.start + 1, w.end - w.start)").alias("word"))


@case("t string, short string", ("abcdef", "abc…"), ("ab", "ab"), ("ab cdef", "ab…"))
def previews(spark):
    """STR-36: the first characters."""
    return _column(spark, "t string", [("abcdef",), ("ab",), ("ab cdef",)], short=T.preview(F.col("t"), 3))


@case("t string, file string", ("a/b: c?", "a b c"), ("..", "untitled"), ("x\ty.", "x y"))
def file_names(spark):
    """STR-37: names for exported files."""
    return _column(spark, "t string", [("a/b: c?",), ("..",), ("x\ty.",)], file=T.file_name(F.col("t")))


@case("t string, hash string", ("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8"))
def fnv_hashes(spark):
    """HSH-2: FNV-1a of 64 bits, with the published test values."""
    return _column(spark, "t string", [("",), ("a",), ("foobar",)], hash=speech.text_hash("t"))


@case("ordinal long, t string", (0, "file 2"), (1, "File 10"), (2, "file 10b"))
def natural_order(spark):
    """SRT-8: numbers in names count as numbers."""
    rows = _column(spark, "t string", [("file 10b",), ("File 10",), ("file 2",)], k=speech.natural_key("t")).orderBy("k").collect()
    return [(i, r.t) for i, r in enumerate(rows)]


@case("n long, size string", (1, "1 MB"), (1048577, "2 MB"), (1610612736, "1.50 GB"), (21474836480, "20.0 GB"))
def storage_sizes(spark):
    """PRJ-7: bytes for people."""
    return _column(spark, "n long", [(1,), (1048577,), (1610612736,), (21474836480,)], size=T.storage_size(F.col("n")))


@case("url string, author string, page long", ("/uploads/x.pdf#page-12", "Uploaded", 12), ("/documents/Ann%20Ray/x.html", "Ann Ray", 1), ("/other/x", "Uncategorized", 1))
def url_authors(spark):
    """PRJ-1, 4, 6: author and page of a document's address."""
    return _column(spark, "url string", [("/uploads/x.pdf#page-12",), ("/documents/Ann%20Ray/x.html",), ("/other/x",)], author=T.author_of(F.col("url")), page=T.page_of(F.col("url")))


@case("k long, ok boolean", (0, True), (1, False), (2, False), (3, False), (4, True))
def range_rules(spark):
    """FLT-15: body ranges are ordered, apart, not empty and within the text."""
    rows = [(0, "abcdef", [(0, 2), (2, 4)]), (1, "abcdef", [(0, 3), (2, 4)]), (2, "abcdef", [(3, 3)]), (3, "abcdef", [(4, 9)]), (4, "abcdef", [])]
    return _column(spark, "k long, t string, r array<struct<start:int,end:int>>", rows, ok=T.valid_ranges(F.col("t"), F.col("r")))


@case("name string, checked string", (" A  b ", "A  b"), ("", None), ("   ", None), ("x" * 81, None))
def name_rules(spark):
    """FLT-16: names are trimmed, not empty, and 80 characters at most."""
    out = []
    for name in (" A  b ", "", "   ", "x" * 81):
        try:
            out.append((name, library.checked_name(name)))
        except library.InvalidName:
            out.append((name, None))
    return out


# places


@case("text string, needle string, start long, end long", ("one two one", "one", 8, 11), ("Ab c", "ab  C", 0, 4), ("no", "not", None, None), ("مُعلم x", "معلم", 0, 5))
def located_texts(spark):
    """ALN-2, 4, FTS-20: a text's place: as written from the hint on, else with folded letters."""
    cases = [("one two one", "one", 1), ("Ab c", "ab  C", 0), ("no", "not", 0), ("مُعلم x", "معلم", 0)]
    return [(t, n, *(alignment.located(t, n, at) or (None, None))) for t, n, at in cases]


@case("i long, start long, end long", (0, 0, 1), (1, None, None), (2, 4, 5), (3, 6, 7))
def ordered_places(spark):
    """ALN-3: each piece is looked for behind the one before."""
    return [(i, *(s or (None, None))) for i, s in enumerate(alignment.ordered("a b a c", ["a", "x", "a", "c"]))]


@case("doc_id long, index long, start long, end long", (1, 0, 4, 5), (2, 0, None, None), (2, 1, None, None))
def grafted_spans(spark):
    """ALN-5: spans move over if all pieces are the same."""
    own = spark.createDataFrame([(1, 0, "i", "t"), (2, 0, "i", "t"), (2, 1, "j", "u")], "doc_id long, index int, id string, text string")
    spans = [(1, 0, "i", "t", 4, 5), (2, 0, "i", "t", 0, 1), (2, 1, "j", "changed", 1, 2)]
    return alignment.grafted(own, spark.createDataFrame(spans, "doc_id long, index int, id string, text string, start int, end int"))


@case("run long, from long, to long", (0, 2, 3), (1, 3, 5))
def overlapping_runs(spark):
    """ALN-6: the source runs that a chunk overlaps."""
    chunks = spark.createDataFrame([(1, 0, 0, 2, 6)], "doc_id long, chunk int, segment int, start int, end int")
    runs = spark.createDataFrame([(1, 0, 0, 0, 3), (1, 0, 1, 3, 5), (1, 0, 2, 6, 9)], "doc_id long, segment int, run int, start int, end int")
    return alignment.run_overlaps(chunks, runs)


@case("at long, part long, offset long", (0, 0, 0), (2, 0, 2), (3, 2, 0), (4, 2, 1))
def part_offsets(spark):
    """JN-14, ALN-7, 9: the part that holds an offset, and the offset in it; empty parts hold nothing."""
    parts = spark.createDataFrame([(1, 0, 3), (1, 1, 0), (1, 2, 2)], "k long, part int, size int")
    return timing.located_parts(parts, spark.createDataFrame([(1, x) for x in (-1, 0, 2, 3, 4, 5)], "k long, at long"), "k", "part", "size")


# recordings


@case("document_id long, status string, missing long", (1, "complete", 0), (2, "incomplete", 1), (3, "text-changed", 0), (4, "no-index", 0))
def recording_status(spark):
    """LIB-14, AGG-20: whether recordings are whole."""
    saved = spark.createDataFrame([(1, "s", "s"), (2, "s", "s"), (3, "s", "t"), (4, "s", "s")], "document_id long, signature string, wanted string")
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (3, 0, "a")], "document_id long, index int, hash string")
    return timing.narration_status(saved, chunks, spark.createDataFrame([("a",), ("b",)], "hash string"))


@case("hash string", ("old",))
def orphaned_chunks(spark):
    """LIB-15: cached pieces that no recording has."""
    return timing.orphans(spark.createDataFrame([("a",), ("old",)], "hash string"), spark.createDataFrame([(1, "a")], "document_id long, hash string"))


@case("key string, seconds double, slow double, fast double", ("m|2|f16|v", 2.5, 0.5, 3.0))
def recording_numbers(spark):
    """HSH-4, MTH-2, 3: a recording's key, its length, and rates within their limits."""
    rows = [("m", "2", "f16", "v", 120000, 0.1, 9.0)]
    key = timing.cache_key(*[F.col(c) for c in "abcd"])
    return _column(spark, "a string, b string, c string, d string, n long, x double, y double", rows, key=key, seconds=timing.wav_seconds(F.col("n")), slow=timing.playback_rate(F.col("x")), fast=timing.playback_rate(F.col("y")))


# folders

_FOLDER = "id long, parent_id long, name string, depth long, sort_order long"


def _folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, None, "Sea", 0, 0), (2, 1, "Salt", 1, 0), (3, 2, "Pans", 2, 0), (4, None, "Land", 0, 1000)], _FOLDER)


def _placed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(10, 3, 0), (11, 1, 0), (12, None, 5000)], "document_id long, folder_id long, sort_order long")


@case("id long, depth long, sort_order long", (1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 0, 1000), (9, 1, 1000))
def folder_created(spark):
    """LIB-1: a new folder stands behind its siblings."""
    return library.with_folder(_folders(spark), 9, 1, " Sand ")


@case("what string, outcome string", ("name taken", "refused"), ("no parent", "refused"), ("not empty", "refused"), ("empty", "done"))
def folder_rules(spark):
    """LIB-1, 4: what isn't allowed."""
    f, p = _folders(spark), _placed(spark)
    tries = {
        "name taken": lambda: library.with_folder(f, 9, 1, "salt"), "no parent": lambda: library.with_folder(f, 9, 77, "x"), "not empty": lambda: library.without_empty(f, p, 1),
        "empty": lambda: library.without_empty(f, p, 4),
    }
    out = []
    for what, act in tries.items():
        try:
            act()
            out.append((what, "done"))
        except ValueError:
            out.append((what, "refused"))
    return out


@case("id long, name string", (1, "Sea"), (2, "Brine"), (3, "Pans"), (4, "Land"))
def folder_renamed(spark):
    """LIB-2."""
    return library.renamed(_folders(spark), 2, "Brine")


@case("id long", (1,), (2,), (3,))
def folder_deleted(spark):
    """LIB-4: an empty subtree goes."""
    return library.without_empty(_folders(spark), _placed(spark), 4)


@case("document_id long, folder_id long, sort_order long", (10, 3, 0), (12, 3, 1000), (11, 3, 2000))
def documents_moved(spark):
    """LIB-5: moved documents stand behind the others, in the order asked for."""
    return library.moved_documents(_placed(spark), spark.createDataFrame([(12, 1), (11, 2)], "document_id long, place int"), 3)


@case("id long, parent_id long, depth long", (1, None, 0), (2, 4, 1), (3, 2, 2), (4, None, 0))
def folder_moved(spark):
    """LIB-6: a folder moves with all below it."""
    return library.moved(_folders(spark), 2, 4)


@case("path string, parent string, depth long", ("Sea (2)", None, 0), ("Sea (2)/a", "Sea (2)", 1), ("Sea (2)/a/b", "Sea (2)/a", 2))
def folders_imported(spark):
    """LIB-8: an import makes a fresh root and the folders below."""
    return library.imported_folders(spark.createDataFrame([("",), ("a/b",), ("a",)], "folder string"), _folders(spark), "Sea")


@case("their_id long, our_id long", (7, 1), (8, 2), (9, None), (5, None))
def folders_merged(spark):
    """JN-15: folders of a package meet those of the same name in the same place."""
    theirs = spark.createDataFrame([(7, None, "sea", 0, 0), (8, 7, "SALT", 1, 0), (9, 7, "new", 1, 0), (5, 9, "Pans", 2, 0)], _FOLDER)
    return library.merged_folders(theirs, _folders(spark))


@case("id long, path string, documents long, folders long", (1, "Sea", 2, 2), (2, "Sea / Salt", 1, 1), (3, "Sea / Salt / Pans", 1, 0), (4, "Land", 0, 0))
def folder_tree(spark):
    """JN-10, LIB-9: the tree's labels and counts."""
    f = _folders(spark)
    return library.paths(f).select("id", "path").join(library.counts(f, _placed(spark)).select("id", "documents", "folders"), "id")


@case("u string, names string", ("http://h/a%20b/c/d.html?x", "a b|c"), ("/d.html", ""))
def address_folders(spark):
    """LIB-10, PRJ-5: the folders of an address."""
    return _column(spark, "u string", [("http://h/a%20b/c/d.html?x",), ("/d.html",)], names=F.array_join(library.folder_names(F.col("u")), "|"))


@case("added string, taken string", ("1,2,3", "1"))
def bulk_selection(spark):
    """LIB-19: a bulk selection leaves what's hidden as it was."""
    cols = {k: F.array_join(library.selection(F.col("c"), F.col("s"), on), ",") for k, on in (("added", True), ("taken", False))}
    return _column(spark, "c array<int>, s array<int>", [([1, 2], [2, 3])], **cols)


@case("doc_id long, change string", (1, "delete"), (2, "update"), (4, "insert"))
def content_changes(spark):
    """VEC-7, STM-5: what changed between two states."""
    before = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "doc_id long, text string")
    return maintenance.changes(before, spark.createDataFrame([(2, "z"), (4, "w"), (3, None)], "doc_id long, text string"), "doc_id", "text")


@case("eligible string, status string", ("all", "ready"), ("some", "partial"), ("none", "missing-index"))
def index_readiness(spark):
    """FLT-8, JN-4, LIB-13: how much of what can be indexed is."""
    docs = spark.range(4).toDF("doc_id")
    return [(name, maintenance.coverage(docs, docs.where(some)).first().status) for name, some in (("all", "true"), ("some", "doc_id < 2"), ("none", "false"))]


@case("documents long, bytes long, more_than_twice boolean", (2, 7, True))
def package_estimate(spark):
    """AGG-24, LIB-12: what a package takes."""
    docs = spark.createDataFrame([("d", "T", "abcé"), ("e", "U", "fg")], "id string, title string, text string")
    return transfer.estimate(docs).withColumn("more_than_twice", F.col("reserve") > 2 * F.col("bytes"))


# vectors


@case("start long, end long", (0, 4096), (4096, 5000))
def window_limits(spark):
    """VEC-1: a text without a boundary is cut at the limit."""
    return semantic.windows("x" * 5000)


@case("k long, whole boolean, in_order boolean, at_stops boolean, within boolean", (0, True, True, True, True))
def window_boundaries(spark):
    """VEC-1, 2: windows cover the text, overlap, and end with sentences."""
    text = " ".join(f"Sentence {i} has some words here." for i in range(300))
    w = semantic.windows(text)
    pairs = list(zip(w, w[1:], strict=False))
    return [(0, w[0][0] == 0 and w[-1][1] == len(text), all(a < c <= b < d for (a, b), (c, d) in pairs), all(text[b - 1] == "." for _, b in w), all(len(text[a:b].split()) <= 320 for a, b in w))]


@case("t string, short string", ("one two three", "one two…"), ("one", "one"))
def context_previews(spark):
    """VEC-14: a preview ends with a word."""
    return _column(spark, "t string", [("one two three",), ("one",)], short=semantic.preview(F.col("t"), 9))


@case("title string, heading string, text string, input string", ("T", "H", "x", "passage: T. H. x"), ("T", None, "x", "passage: T. x"))
def passage_inputs(spark):
    """VEC-4, 5: what an encoder gets."""
    rows = [("T", "H", "x"), ("T", None, "x")]
    return _column(spark, "title string, heading string, text string", rows, input=semantic.passage_input(F.col("title"), F.col("heading"), F.col("text")))


_RANGED = "doc_id long, ordinal long, title string, text string, body array<struct<start:int,end:int>>"


@case("start long, end long, auxiliary boolean", (0, 10, False), (11, 21, True), (22, 33, False))
def passage_regions(spark):
    """VEC-1, 3: windows stay within main content or what lies between."""
    rows = [(1, 0, "T", "Main part. See [1] p. More of it.", [(0, 10), (22, 33)])]
    return semantic.passages(spark.createDataFrame(rows, _RANGED))


@case("doc_id long, terms long, part string", (1, 2, "tide and moon"), (2, 0, "only cited: tide"), (3, 1, "a Tide."))
def main_content_parts(spark):
    """FTS-16: the range with the most different words; hits outside of all ranges are citations."""
    rows = [(1, 0, "t", "tide here. tide and moon", [(0, 10), (11, 24)]), (2, 0, "t", "only cited: tide", [(0, 10)]), (3, 0, "t", "a Tide.", [(0, 7)])]
    return evidence.main_content(spark.createDataFrame(rows, _RANGED), ["tide", "moon"])


@case("t string, shown string", ("one two three four", "… <mark>two</mark> three four"), ("a b c d Two!", "… c d <mark>Two!</mark>"), ("none of it at all", "none of it …"), ("", ""))
def snippets(spark):
    """FTS-14: a window of tokens around the first hit."""
    rows = [("one two three four",), ("a b c d Two!",), ("none of it at all",), ("",)]
    return _column(spark, "t string", rows, shown=evidence.snippet(F.col("t"), ["two"], 3))


@case("ordinal long", (2,), (3,), (4,), (5,), (6,))
def context_stops(spark):
    """WIN-6: context ends before a section that is auxiliary."""
    rows = spark.createDataFrame([(1, i, f"s{i}", i in (1, 7)) for i in range(10)], "doc_id long, ordinal long, text string, auxiliary boolean")
    return semantic.neighbours(rows, spark.createDataFrame([(1, 4)], "doc_id long, ordinal long"))


@case("doc_id long", (1,))
def passages_verified(spark):
    """VEC-11: found passages whose text has changed are left out."""
    s = spark.createDataFrame([(1, 0, "T", "same text"), (2, 0, "T", "old text"), (3, 0, "T", "gone")], "doc_id long, ordinal long, title string, text string")
    live = spark.createDataFrame([(1, 0, "T", "same text"), (2, 0, "T", "new text")], s.schema)
    return semantic.current(semantic.passages(s).select("doc_id", "content_hash"), live)


# requests to a small library

_LIBRARIES: dict = {}
_SHELF = "doc_id long, title string, ordinal long, heading string, text string"
_BOOKS = [
    (1, "Tides", 0, None, "The slow tide turns"), (1, "Tides", 1, None, "and the moon pulls"), (2, "Harbour", 0, None, "A marble statue by the quay"), (3, "Garden", 0, None, "A marble statue of a heron"),
    (4, "Museum", 0, None, "marble statue"), (5, "Script", 0, None, "هذا الكِتاب هنا"), (6, "River", 0, None, "the quiet old river"),
]


def _shelf(spark: SparkSession) -> Library:
    key = spark.sparkContext.applicationId
    if key not in _LIBRARIES:
        _LIBRARIES[key] = Library.create(spark, spark.createDataFrame(_BOOKS, _SHELF), f"{_work(spark)}/shelf")
    return _LIBRARIES[key]


@case("request string, found string, total long", ("all", "4,3,2", 3), ("limit", "4", 3), ("scope", "3,2", 2), ("nothing in scope", "", 0))
def library_requests(spark):
    """FLT-5, JN-2, SRT-9, 12, AGG-5: equal scores newest first; totals are those before the limit, and within the scope."""
    shelf, ids = _shelf(spark), spark.createDataFrame([(2,), (3,)], "doc_id long")
    asked = {"all": {}, "limit": {"limit": 1}, "scope": {"scope": ids}, "nothing in scope": {"scope": ids.where("false")}}
    out = []
    for name, options in asked.items():
        r = shelf.search("marble statue", **options)
        shown = [d.doc_id for d in r.documents.orderBy("rank").collect()]
        # the shortest section scores best, the others differ in length by one token
        out.append((name, ",".join(str(d) for d in sorted(shown, reverse=True)), r.total_documents))
    return out


@case("request string, found string", ("slow pulls", "1:document"), ("الكتاب", "5:section"), ('"quiet old" river', "6:section"), ('"quiet river"', ""))
def library_modes(spark):
    """FTS-10, 12, 19: terms in different sections, the index of Arabic forms, phrases as they're written."""
    return [(q, ",".join(f"{d.doc_id}:{d.scope}" for d in _shelf(spark).search(q).documents.collect())) for q in ("slow pulls", "الكتاب", '"quiet old" river', '"quiet river"')]


@case("word string, before string, after string", ("harbour", "2", ""), ("quayside", "", "2"), ("sundial", "", "7"))
def library_titles(spark):
    """SNK-1, 2, 3: an update changes the title everywhere, and new documents are found."""
    own = Library.create(spark, spark.createDataFrame(_BOOKS, _SHELF), f"{_work(spark)}/titles")
    found = lambda w: ",".join(str(d.doc_id) for d in own.search(w).documents.collect())
    words = ("harbour", "quayside", "sundial")
    before = [found(w) for w in words]
    own.add(spark.createDataFrame([(2, "Quayside", 0, None, "A marble statue by the quay"), (7, "Sundial", 0, None, "")], _SHELF))
    return [(w, b, found(w)) for w, b in zip(words, before, strict=True)]


@case("writer string, outcome string", ("first", "published"), ("second", "conflict"), ("second, opened again", "published"))
def index_writers(spark):
    """JN-9: of two writers of one generation one publishes."""
    path = f"{_work(spark)}/writers"
    rows = spark.createDataFrame(_BOOKS, _SHELF)
    Index.build(rows, path, 2)
    first, second = Index(spark, path), Index(spark, path)
    out = []
    for name, writer in (("first", lambda: first), ("second", lambda: second), ("second, opened again", lambda: Index(spark, path))):
        try:
            writer().remove(rows.where("doc_id = 2"))
            out.append((name, "published"))
        except Conflict:
            out.append((name, "conflict"))
    return out


def _vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(2, 0, [1.0, 0.0]), (3, 0, [0.8, 0.6]), (6, 0, [0.0, 1.0])], "doc_id long, passage long, vector array<float>")


@case("request string, found string", ("all", "2,3,6"), ("two", "2,3"), ("with a phrase", "6"), ("none in scope", ""))
def conceptual_requests(spark):
    """VEC-8, 9, 13: nearest first, with phrases that must stand in the text, and scopes."""
    shelf, v = _shelf(spark), _vectors(spark)
    asked = {"all": {}, "two": {"k": 2}, "with a phrase": {"exact": ["quiet old"]}, "none in scope": {"scope": v.where("false").select("doc_id")}}
    return [(name, ",".join(str(d.doc_id) for d in shelf.conceptual(v, [1.0, 0.0], **options).collect())) for name, options in asked.items()]


@case("scope string, encoded long", ("some", 1), ("none", 0))
def conceptual_encoding(spark):
    """VEC-10: a request is encoded once, and only if a document may be found."""
    out = []
    for name, where in (("some", "true"), ("none", "false")):
        calls: list[int] = []
        _shelf(spark).conceptual(_vectors(spark), lambda calls=calls: calls.append(1) or [1.0, 0.0], scope=_vectors(spark).where(where).select("doc_id")).collect()
        out.append((name, len(calls)))
    return out


@case("vectors string, state string", ("some", "partial"), ("none", "missing-index"), ("of other dimensions", "incompatible"), ("all", "ready"))
def conceptual_availability(spark):
    """VEC-12: whether conceptual requests can be answered."""
    shelf, v = _shelf(spark), _vectors(spark)
    every = shelf.sections.select("doc_id").distinct().withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    return [("some", shelf.availability(v, 2)), ("none", shelf.availability(v.where("false"), 2)), ("of other dimensions", shelf.availability(v, 3)), ("all", shelf.availability(every, 2))]


@case("folder string, files long, bytes long", ("", 1, 4), ("a", 1, 4), ("a/b", 1, 4))
def folder_walk(spark):
    """SRC-15, 17: the files of a folder with their folders, four levels deep at most; hidden ones are left out."""
    root = f"{_work(spark)}/walk"
    line = spark.createDataFrame([("one",)], "value string").coalesce(1)
    for at in ("", "/a", "/a/b", "/a/b/c/d/e/f", "/.hidden"):
        line.write.mode("append").text(f"{root}{at}")
    return files.files(spark, root.removeprefix("file://")).groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@case("scope string, candidates string", ("all", "harbor,harbour"), ("one", "harbor"))
def vocabulary_in_scope(spark):
    """JN-11, AGG-11: a misspelt word's candidates come from the documents in scope."""
    docs = spark.createDataFrame([(1, "t", "harbour"), (2, "t", "harbor")], "doc_id long, source string, text string")
    out = []
    for name, where in (("all", "true"), ("one", "doc_id = 2")):
        vocab = evidence.vocabulary(library.scoped(docs, docs.where(where), None))
        out.append((name, ",".join(sorted(r.term for r in evidence.spelling_candidates(vocab, "harbuor").collect()))))
    return out


@case("doc_id long", (2,), (3,))
def bookmarked(spark):
    """FLT-10, 7: of the bookmarked documents those whose title or author has the text, in any case."""
    rows = spark.createDataFrame([(1, "Tides", "Ann"), (2, "On TIDES", "Bo"), (3, "Moon", "M. Tide"), (4, "Tide", "Bo")], "doc_id long, title string, author string")
    marked = spark.createDataFrame([(2,), (3,)], "doc_id long")
    return library.matching(library.scoped(rows, marked, None), "tide", "title", "author")


@case("name string, json string", ("body", '[{"start":0,"end":4}]'), ("none", "[]"))
def range_json(spark):
    """JSN-1: body ranges as JSON and back."""
    kind = "array<struct<start:int,end:int>>"
    rows = spark.createDataFrame([("body", [(0, 4)]), ("none", [])], f"name string, r {kind}")
    return rows.withColumn("json", F.to_json("r")).withColumn("back", F.from_json("json", kind)).where(F.col("back").eqNullSafe(F.col("r")))


@case("doc_id long, sections string", (1, "The slow tide turns|and the moon pulls"), (6, "the quiet old river"))
def embedding_corpus(spark):
    """SNK-9: documents with their sections in order, for encoders."""
    rows = spark.createDataFrame(_BOOKS, _SHELF).where("doc_id IN (1, 6)")
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("s"))
    whole = own.where(F.forall(F.transform("s", lambda x, i: x["ordinal"] == i), lambda x: x))
    return whole.select("doc_id", F.array_join(F.transform("s", lambda x: x["text"]), "|").alias("sections"))
