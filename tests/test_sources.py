import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiloom.sources import epub, files, html, markdown

PAGE = """<!DOCTYPE html><html lang=en><head><title> A &amp; B </title><style>p{}</style></head><body><nav><ul><li><a href="#x">Go</a></li></ul></nav>
<h1>Top</h1><p>First <b>bold</b> text.<p>Second<br>line <span role="doc-footnote">note</span> end.</p><div><h2 id=s>Sub</h2><div>leaf</div></div>
<script>alert(1)</script><a href="javascript:x()" onclick="y">bad</a><img src=x.png onerror=z><ul><li>one<li>two</ul></body></html>"""


def test_sections_have_headings_and_auxiliary_ranges():
    got = html.sections_of(PAGE)
    assert [(s["text"], s["heading"], s["is_heading"]) for s in got] == [
        ("Go", None, False), ("Top", "Top", True), ("First bold text.", "Top", False), ("Second line note end.", "Top", False), ("Sub", "Sub", True), ("leaf", "Sub", False), ("one", "Sub", False), ("two", "Sub", False),
    ]
    assert got[0]["auxiliary"] and got[0]["body"] == []
    text = got[3]["text"]
    assert [text[r["start"] : r["end"]].strip() for r in got[3]["body"]] == ["Second line", "end."]
    assert html.sections_of("just text")[0]["text"] == "just text" and html.sections_of("") == []
    assert html.title_of(PAGE) == "A & B" and html.title_of("") == "Imported HTML Document"


def test_sanitised_markup_has_nothing_that_acts():
    out = html.sanitised(PAGE)
    assert "script" not in out and "onclick" not in out and "javascript" not in out and "onerror" not in out
    assert '<h2 id="s">Sub</h2>' in out and '<img src="x.png">' in out
    marked = html.with_locators(PAGE)
    n = len(html.sections_of(PAGE))
    assert html.complete_locators(marked, n) and not html.complete_locators(marked, n + 1)


def test_outline(spark):
    rows = [(1, 0, 1, "A"), (1, 2, 2, "B"), (1, 4, 3, "C"), (1, 6, 2, "D"), (1, 8, 1, "E"), (2, 0, 1, "only")]
    got = html.outline(spark.createDataFrame(rows, "page_id long, ordinal int, rank int, text string")).collect()
    assert {r.label: r.parent for r in got} == {"A": None, "B": 0, "C": 2, "D": 0, "E": None}


def test_decoding(spark):
    assert files.decoded("﻿hé".encode(), "txt") == ("hé", None)
    assert files.decoded("hé".encode("utf-16"), "txt") == ("hé", None)
    assert files.decoded("é".encode("latin-1"), "txt") == (None, "encoding")
    assert files.decoded('<meta charset="latin-1">é'.encode("latin-1"), "html") == ('<meta charset="latin-1">é', None)
    assert files.decoded(b"x" * (26 << 20), "txt") == (None, "too-large")
    df = spark.createDataFrame([(b"ok", "txt"), (b"\xff", "txt"), (None, "txt")], "c binary, f string")
    assert [tuple(r.d) for r in df.select(files.decode("c", "f").alias("d")).collect()] == [("ok", None), (None, "encoding"), (None, "missing")]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "lib" / "sub" / ".hidden").mkdir(parents=True)
    (tmp_path / "lib" / "a.txt").write_bytes(b"one")
    (tmp_path / "lib" / "sub" / "b.html").write_bytes(b"<p>two")
    (tmp_path / "lib" / "sub" / ".hidden" / "c.txt").write_bytes(b"three")
    got = sorted((r.folder, r.name, r.bytes, len(r.id)) for r in files.files(spark, str(tmp_path / "lib")).collect())
    assert got == [("", "a.txt", 3, 64), ("sub", "b.html", 6, 64)]


def test_text_to_html(spark):
    df = spark.createDataFrame([("one <b>\r\ntwo\r\n\r\n \r\nthree",), ("",)], "t string")
    assert [r[0] for r in df.select(files.text_as_html(F.col("t"))).collect()] == ["<p>one &lt;b&gt;<br>two</p>\n<p>three</p>", ""]


@pytest.mark.parametrize("source,want", [
    ("# Head\n\ntext *em* **st** `c<d`", "<h1>Head</h1>\n<p>text <em>em</em> <strong>st</strong> <code>c&lt;d</code></p>"),
    ("Two\n===\nlines\nhere", "<h1>Two</h1>\n<p>lines\nhere</p>"),
    ("- a\n- b\n  more\n\n1. x", "<ul><li>a</li><li>b\nmore</li></ul>\n<ol><li>x</li></ol>"),
    ("> quote\n> on\n\n---\n[l](http://x.y) ![i](a.png)", '<blockquote><p>quote\non</p></blockquote>\n<hr>\n<p><a href="http://x.y">l</a> <img src="a.png" alt="i"></p>'),
    ("```py\na < b\n```\n\n    code", "<pre><code>a &lt; b</code></pre>\n<pre><code>code</code></pre>"),
    ("a  \nb \\* c_d_e", "<p>a<br>\nb * c_d_e</p>"),
])
def test_markdown(source, want):
    assert markdown.to_html(source) == want


def book(nav=True, mimetype=b"application/epub+zip"):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("mimetype", mimetype)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        props = ' properties="nav"' if nav else ""
        z.writestr("O/p.opf", f"""<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>My  Book</dc:title></metadata>
<manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml"{props}/><item id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="c%201.xhtml" media-type="application/xhtml+xml"/><item id="b" href="c2.xhtml" media-type="application/xhtml+xml"/><item id="x" href="../../etc" media-type="x"/></manifest>
<spine toc="t"><itemref idref="b"/><itemref idref="a"/></spine></package>""")
        z.writestr("O/nav.xhtml", '<html xmlns:epub="x"><body><nav epub:type="toc"><ol><li><a href="c2.xhtml">Two</a><ol><li><a href="c%201.xhtml#s">One</a></li></ol></li><li><a href="http://x.y">Out</a></li></ol></nav></body></html>')
        z.writestr("O/toc.ncx", '<ncx><navMap><navPoint><navLabel><text>N2</text></navLabel><content src="c2.xhtml"/></navPoint></navMap></ncx>')
        z.writestr("O/c 1.xhtml", "<html><body><h1 id='s'>One</h1><p>first</p></body></html>")
        z.writestr("O/c2.xhtml", "<html><body><p>second</p></body></html>")
    return data.getvalue()


def test_epub(spark):
    b = epub.Book(book())
    assert b.title == "My Book" and [s["text"] for s in b.sections()] == ["second", "One", "first"]
    assert [(r["depth"], r["label"], r["path"], r["fragment"]) for r in b.outline()] == [(0, "Two", "O/c2.xhtml", None), (1, "One", "O/c 1.xhtml", "s"), (0, "Out", None, None)]
    assert [r["label"] for r in epub.Book(book(nav=False)).outline()] == ["N2"]
    rows = [("good", book()), ("bad", b"PK nothing"), ("other", book(mimetype=b"text/plain")), ("none", None)]
    got = epub.epub_sections(spark.createDataFrame(rows, "id string, content binary")).collect()
    assert [(r.id, r.text) for r in got if not r.error] == [("good", "second"), ("good", "One"), ("good", "first")]
    assert {r.id for r in got if r.error} == {"bad", "other", "none"}
    for bad in ("../../x", "/abs", "http://x", "a\\b"):
        with pytest.raises(epub.BadBook):
            epub.resolved("O/p.opf", bad)
