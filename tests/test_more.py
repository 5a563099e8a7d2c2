import pytest
from pyspark.sql import functions as F
from test_sources import book

from lexiloom.operators import alignment, layout, transfer
from lexiloom.sources import epub, importer


def test_import_of_a_batch(spark):
    rows = [("a.html", "x", b"<title>T</title><p>one"), ("copy.html", "y", b"<title>T</title><p>one"), ("b.txt", "x", b"p1\n\np2"), ("c.md", "x", b"# H\n\ntext"), ("d.epub", "x", book()), ("e.pdf", "x", b"%PDF-1.7"),
            ("bad.epub", "x", b"PK"), ("bad.txt", "x", b"\xff\xfe\xff"), ("empty.html", "x", b""), ("unknown", "x", b"\x00\x01"), ("sniffed", "x", b"  <p>html"), ("old.txt", "x", b"known")]
    files = spark.createDataFrame(rows, "name string, folder string, content binary")
    known = spark.createDataFrame([(importer.document_id(b"known", "txt"),)], "id string")
    r = importer.imported(files, known)
    got = {o.name: (o.status, o.error) for o in r.outcomes.collect()}
    assert {n for n, (s, _) in got.items() if s == "imported"} == {"a.html", "b.txt", "c.md", "d.epub", "e.pdf", "sniffed"}
    assert {n for n, (s, _) in got.items() if s == "already-in-library"} == {"copy.html", "old.txt"}
    assert got["bad.txt"] == ("failed", "encoding") and got["empty.html"] == ("failed", "empty") and got["unknown"] == ("failed", "unsupported")
    assert tuple(importer.summary(r.outcomes).first()) == (12, 6, 2, 4)
    docs = {d.title: (d.format, d.sections, d.text_status) for d in r.documents.collect()}
    assert docs["T"] == ("html", 1, "ready") and docs["b"] == ("txt", 2, "ready") and docs["e"] == ("pdf", 0, "processing") and docs["My Book"][1] == 3
    assert r.sections.where("heading = 'H'").count() == 2


def test_staged_pages_are_published_when_complete(spark):
    docs = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 1)], "id string, pages int")
    pages = spark.createDataFrame([("a", 0, "x"), ("a", 1, ""), ("b", 0, "x"), ("c", 0, " ")], "id string, page_index int, text string")
    assert {r.id: r.text_status for r in importer.finalized(docs, pages).collect()} == {"a": "ready", "b": "processing", "c": "recognition-required", "d": "processing"}


def test_links_of_a_book_stay_in_it():
    import io
    import zipfile

    data = io.BytesIO(book())
    with zipfile.ZipFile(data, "a") as z:
        z.writestr("O/c2.xhtml", '<body><p id="q">x <a href="c%201.xhtml#s">in</a> <a href="../../x">out</a> <a href="https://e.org/">web</a> <a href="javascript:x">js</a><img src="no.png"></p></body>')
    out = epub.rewritten(epub.Book(data.getvalue()), 0)
    assert '<p id="c0-q">' in out and '<a href="#c1-s">in</a>' in out and "<a>out</a>" in out and 'href="https://e.org/"' in out and "javascript" not in out and "img" not in out


def test_packages_are_checked(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "T", "text é"), ("d2", "U", "more")], "id string, title string, text string")
    folders = spark.createDataFrame([(1, None, "A", 0, 0), (2, 1, "B", 1, 0)], "id long, parent_id long, name string, depth long, sort_order long")
    placed = spark.createDataFrame([("d1", 2, 0), ("d2", None, 0)], "document_id string, folder_id long, sort_order long")
    path = f"file://{tmp_path}/package"
    transfer.written(docs, folders, placed, path)
    got = transfer.read(spark, path)
    assert [df.count() for df in got] == [2, 2, 2]
    assert tuple(transfer.estimate(docs).first()) == (2, 11, 33 + transfer.RESERVE)
    assert {r.id for r in transfer.deduplicated(docs, docs.where("id = 'd1'")).collect()} == {"d2"}
    listed = transfer.manifest(docs)
    rules = lambda d, m, f, p: {(r.rule, r.id) for r in transfer.broken_rules(d, m, f, p).collect()}
    assert rules(docs, listed, folders, placed) == set()
    changed = docs.withColumn("text", F.when(F.col("id") == "d1", "other").otherwise(F.col("text")))
    assert rules(changed, listed, folders, placed) == {("content", "d1")}
    assert rules(docs.where("id = 'd1'"), listed, folders, placed) == {("present", "d2")}
    assert rules(docs, listed.where("id = 'd1'").unionAll(listed.where("id = 'd1'")), folders, placed) == {("listed", "d2"), ("once", "d1")}
    assert rules(docs, listed, folders.withColumn("depth", F.lit(3)), placed.withColumn("folder_id", F.lit(9))) == {("depth", "1"), ("depth", "2"), ("place", "d1"), ("place", "d2")}
    (tmp_path / "package" / "kind").rename(tmp_path / "kind")
    spark.createDataFrame([('{"kind": "other", "schemaVersion": 1}',)], "value string").write.text(f"{path}/kind")
    with pytest.raises(transfer.BadPackage):
        transfer.read(spark, path)


def test_alignment(spark):
    assert alignment.located("one two one", "one", 1) == (8, 11) and alignment.located("abc", "a", 1) == (0, 1) and alignment.located("abc", "a", 1, strict=True) is None
    text = "قال الْكِتَابُ هنا"
    a, b = alignment.located(text, "الكتاب")
    assert alignment.folded(text[a:b])[0] == "الكتاب" and alignment.equal("ﬁn", "fin") and not alignment.equal("", "‏") and not alignment.equal("a", "b")
    assert alignment.ordered("a b a c", ["a", "x", "a", "c"]) == [(0, 1), None, (4, 5), (6, 7)]
    df = spark.createDataFrame([("a b a", ["a", "a", "z"]), (None, None)], "t string, n array<string>")
    got = [r[0] for r in df.select(alignment.spans_in_order("t", "n")).collect()]
    assert [s and tuple(s) for s in got[0]] == [(0, 1), (4, 5), None] and got[1] == []
    w = spark.createDataFrame([("it's well-known, no?",)], "t string").select(alignment.word_spans("t")).first()[0]
    assert [tuple(x) for x in w] == [(0, 4), (5, 15), (17, 19)]
    chunks = spark.createDataFrame([(1, 0, 0, 2, 6)], "doc_id long, chunk int, segment int, start int, end int")
    runs = spark.createDataFrame([(1, 0, 0, 0, 3), (1, 0, 1, 3, 5), (1, 0, 2, 6, 9)], "doc_id long, segment int, run int, start int, end int")
    assert sorted((r.run, r["from"], r["to"]) for r in alignment.run_overlaps(chunks, runs).collect()) == [(0, 2, 3), (1, 3, 5)]
    own = spark.createDataFrame([(1, 0, "i", "t"), (2, 0, "i", "t"), (2, 1, "j", "u")], "doc_id long, index int, id string, text string")
    spans = spark.createDataFrame([(1, 0, "i", "t", 4, 5), (2, 0, "i", "t", 0, 1), (2, 1, "j", "changed", 1, 2)], "doc_id long, index int, id string, text string, start int, end int")
    assert {(r.doc_id, r["index"]): (r.start, r.end) for r in alignment.grafted(own, spans).collect()} == {(1, 0): (4, 5), (2, 0): (None, None), (2, 1): (None, None)}


def test_page_texts(spark):
    rows = [(1, 0, 0, "[1] First."), (1, 0, 1, "[2] Second."), (1, 0, 2, "[3] Third."), (1, 1, 0, "1. a"), (1, 1, 1, "7. b"), (1, 1, 2, "8. c")]
    lines = spark.createDataFrame(rows, "document_id long, page_index int, line int, text string")
    assert [(r.document_id, r.page_index) for r in layout.reference_lists(lines).collect()] == [(1, 0)]
    df = spark.createDataFrame([("apples, 3, 5-7",), ("Birds, see also Wings",), ("An ordinary sentence.",), ("Chapter one ..... 12",)], "t string")
    assert [r[0] for r in df.select(layout.index_entry(F.col("t"))).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(layout.page_reference(F.col("t"))).collect()] == [None, None, None, 12]
    s = spark.createDataFrame([(1, "Well-known and well-known, re-entry - x-"), (2, "none")], "doc_id long, text string")
    assert {(r.doc_id, r.word) for r in layout.compounds(s).collect()} == {(1, "well-known"), (1, "re-entry")}
    t = spark.createDataFrame([(" ", "f"), ("T", "f")], "m string, f string")
    assert [r[0] for r in t.select(layout.document_title(F.col("m"), F.col("f"))).collect()] == ["f", "T"]
    p = spark.createDataFrame([(960.0, 720.0), (100.0, 100.0)], "w double, h double")
    assert [r[0] for r in p.select(layout.fitted(F.col("w"), F.col("h"))).collect()] == [0.5, 1.0]
    assert p.select(layout.render_scale(F.col("w"), F.col("h"))).first()[0] == pytest.approx((9e6 / (960 * 720)) ** 0.5)


def test_functions_have_sql_names(spark):
    from lexiloom.functions.register import SCALARS, TABLES, register

    register(spark)
    assert spark.sql("SELECT tokenize('Running rivers') t, fnv1a('a') h, natural_key('File10') n").first().t == ["run", "river"]
    assert [r.text for r in spark.sql("SELECT * FROM html_sections('<h1>A</h1><p>b')").collect()] == ["A", "b"]
    assert spark.sql("SELECT * FROM speech_chunk_rows('One. Two.', 'playback')").count() == 1
    assert [(r.start, r.end) for r in spark.sql("SELECT * FROM passages('a b')").collect()] == [(0, 3)]
    assert len(SCALARS) == 10 and len(TABLES) == 3


def test_imported_folders_and_selections(spark):
    from lexiloom.operators import library

    folders = spark.createDataFrame([(1, None, "Books", 0, 0)], "id long, parent_id long, name string, depth long, sort_order long")
    paths = spark.createDataFrame([("",), ("a/b",), ("a",)], "folder string")
    got = {(r.path, r.parent, r.depth) for r in library.imported_folders(paths, folders, "books").collect()}
    assert got == {("books (2)", None, 0), ("books (2)/a", "books (2)", 1), ("books (2)/a/b", "books (2)/a", 2)}
    with pytest.raises(ValueError):
        library.imported_folders(spark.createDataFrame([("a/b/c/d/e",)], "folder string"), folders, "x")
    df = spark.createDataFrame([("http://h/a%20b/c/d.html?x", [1, 2], [2, 3])], "u string, c array<int>, s array<int>")
    r = df.select(library.folder_names(F.col("u")), library.selection(F.col("c"), F.col("s"), True), library.selection(F.col("c"), F.col("s"), False)).first()
    assert tuple(r) == (["a b", "c"], [1, 2, 3], [1])


def test_recordings(spark):
    from lexiloom.operators import timing

    saved = spark.createDataFrame([(1, "s", "s"), (2, "s", "s"), (3, "s", "t"), (4, "s", "s")], "document_id long, signature string, wanted string")
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (3, 0, "a")], "document_id long, index int, hash string")
    cached = spark.createDataFrame([("a",), ("b",), ("old",)], "hash string")
    assert {r.document_id: (r.status, r.missing) for r in timing.narration_status(saved, chunks, cached).collect()} == {1: ("complete", 0), 2: ("incomplete", 1), 3: ("text-changed", 0), 4: ("no-index", 0)}
    assert [r.hash for r in timing.orphans(cached, chunks).collect()] == ["old"]
