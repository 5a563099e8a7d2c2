import pytest
from pyspark.sql import functions as F

from lexiloom.operators import evaluation, evidence, layout, library, maintenance, phrases, semantic, timing

FOLDERS = "id long, parent_id long, name string, depth long, sort_order long"


@pytest.fixture
def folders(spark):
    return spark.createDataFrame([(1, None, "A", 0, 0), (2, 1, "B", 1, 0), (3, 2, "C", 2, 0), (4, None, "D", 0, 1000)], FOLDERS)


@pytest.fixture
def placed(spark):
    return spark.createDataFrame([(10, 3, 0), (11, 1, 0), (12, None, 5000), (13, 3, 1000)], "document_id long, folder_id long, sort_order long")


def test_tree_operations(spark, folders, placed):
    assert {r.id: r.path for r in library.paths(folders).collect()} == {1: "A", 2: "A / B", 3: "A / B / C", 4: "D"}
    assert {r.id: (r.documents, r.folders) for r in library.counts(folders, placed).collect()} == {1: (3, 2), 2: (2, 1), 3: (2, 0), 4: (0, 0)}
    after = {r.id: (r.parent_id, r.depth, r.sort_order) for r in library.moved(folders, 2, 4).collect()}
    assert after == {1: (None, 0, 0), 2: (4, 1, 0), 3: (2, 2, 0), 4: (None, 0, 1000)}
    top = {r.id: (r.parent_id, r.depth, r.sort_order) for r in library.moved(folders, 2, None).collect()}
    assert top[2] == (None, 0, 2000) and top[3][1] == 1
    new = {r.id: (r.depth, r.sort_order) for r in library.with_folder(folders, 9, 1, " New ").collect()}
    assert new[9] == (1, 1000)
    for bad in (lambda: library.with_folder(folders, 9, 1, "b"), lambda: library.with_folder(folders, 9, 77, "x"), lambda: library.checked_name("  "), lambda: library.without_empty(folders, placed, 1)):
        with pytest.raises(ValueError):
            bad()
    assert {r.id for r in library.without_empty(folders, placed, 4).collect()} == {1, 2, 3}
    assert [r.name for r in library.renamed(folders, 4, "E").where("id = 4").collect()] == ["E"]
    moved = library.moved_documents(placed, spark.createDataFrame([(12, 1), (11, 2)], "document_id long, place int"), 3)
    assert {r.document_id: (r.folder_id, r.sort_order) for r in moved.collect()} == {10: (3, 0), 13: (3, 1000), 12: (3, 2000), 11: (3, 3000)}


def test_transfer_merges_folders_by_name(spark, folders):
    theirs = spark.createDataFrame([(7, None, "a", 0, 0), (8, 7, "b", 1, 0), (9, 7, "new", 1, 0), (5, 9, "C", 2, 0)], FOLDERS)
    got = {r.their_id: r.our_id for r in library.merged_folders(theirs, folders).collect()}
    assert got == {7: 1, 8: 2, 9: None, 5: None}


def test_scopes(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    some, none = rows.where("doc_id < 2"), rows.where("false")
    assert library.scoped(rows, None, some).count() == 3 and library.scoped(rows, none, None).count() == 0 and library.scoped(rows, some, None).count() == 2


def test_maintenance(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(2, "z"), (4, "w")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in maintenance.upserted(a, b, "doc_id").where("text is not null").collect()) == [(1, "x"), (2, "z"), (4, "w")]
    assert {(r.doc_id, r.change) for r in maintenance.changes(a, b, "doc_id", "text").collect()} == {(1, "delete"), (2, "update"), (4, "insert")}
    assert tuple(maintenance.deletion(a, b).first()) == (1, 1, 2)
    assert {r.doc_id for r in maintenance.pending(a, b).collect()} == {1} and not maintenance.ready(a, b) and maintenance.ready(a, a)
    assert maintenance.coverage(a, a.where("false")).first().status == "missing-index"


SECTIONS = "doc_id long, title string, ordinal long, text string"


def test_phrases_are_literal_and_may_lie_apart(spark):
    s = spark.createDataFrame([(1, "t", 0, "The quick Brown fox"), (1, "t", 1, "lazy dog; lazy  dog"), (2, "t", 0, "quick brownie"), (3, "t", 0, "brown quick")], SECTIONS)
    got = {r.doc_id: (r.match_count, r.first_section) for r in phrases.verified(s, ["quick brown"]).collect()}
    assert got == {1: (1, 0), 2: (1, 0)}  # part of a word counts
    assert {r.doc_id: r.match_count for r in phrases.verified(s, ["lazy dog", "quick"]).collect()} == {1: 3}
    line = phrases.excerpted(phrases.verified(s, ["brown"]), "brown", 4).where("doc_id = 1").first().excerpt
    assert line == "…ick <mark>brown</mark> fox"
    page = phrases.concordance(s, "lazy dog", 1, 5).collect()
    assert [(r.doc_id, r.ordinal, r.occurrence, r.position, r.before, r.after, r.occurrence_index) for r in page] == [(1, 1, 1, 11, "lazy dog; ", "", 1)]


def test_spelling(spark):
    s = spark.createDataFrame([(i, "t", 0, "retrieval engine") for i in range(3)] + [(9, "t", 0, "retrieving")], SECTIONS)
    vocab = evidence.vocabulary(s.select("doc_id", F.col("title").alias("source"), "text"))
    assert evidence.suggestion(evidence.found_by_scan(s), vocab, ["retrievak", "engine"]) == "retrieval engine"
    assert evidence.suggestion(evidence.found_by_scan(s), vocab, ["retrieval"]) is None and evidence.suggestion(evidence.found_by_scan(s), vocab, ["Upper"]) is None
    assert [r.term for r in evidence.spelling_candidates(vocab, "retrievak").collect()] == ["retrieval", "retrieving"]


def test_timing(spark):
    c = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (1, 2, 1.0)], "k long, i long, duration double")
    t = timing.timed(c, "k", "i", "duration")
    assert [r.start for r in t.orderBy("i").collect()] == [0.0, 2.0, 5.0]
    assert timing.contiguous(t, "k", "i").first().ok and not timing.contiguous(t.withColumn("start", F.col("start") + 1), "k", "i").first().ok
    points = spark.createDataFrame([(1, x) for x in (-1.0, 0.0, 2.0, 4.9, 99.0)], "k long, at double")
    assert [r.i for r in timing.playing(t, points, "k", "i").orderBy("at").collect()] == [0, 0, 1, 1, 2]


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "doc_id long, rank long")
    grades = spark.createDataFrame([(2, 2), (9, 1), (1, 0)], "doc_id long, grade long")
    r = evaluation.ranking_metrics(results, grades).first()
    import math

    ideal = 3 / math.log2(2) + 1 / math.log2(3)
    assert r.recall_at_10 == 0.5 and r.mrr_at_10 == 0.5 and r.ndcg_at_10 == round(3 / math.log2(3) / ideal, 6)


def test_windows_cover_the_text_and_overlap():
    text = " ".join(f"Sentence {i} has some words here." for i in range(300))
    got = semantic.windows(text)
    assert got[0][0] == 0 and got[-1][1] == len(text) and len(got) > 3
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and text[b - 1] == "." and len(text[a:b].split()) <= 320
    assert semantic.windows("") == [] and semantic.windows("x" * 5000) == [(0, 4096), (4096, 5000)]


def test_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [0.6, 0.8]), (3, 0, [0.0, 1.0]), (3, 1, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "document_id long, passage long, vector array<float>")
    got = [(r.document_id, r.passage, round(r.score, 3)) for r in semantic.top(v, [0.0, 1.0], 3).collect()]
    assert got == [(1, 1, 1.0), (3, 0, 1.0), (2, 0, 0.8)]
    assert semantic.top(v, [0.0, 1.0], 3, v.where("false")).count() == 0
    bad = spark.createDataFrame([([1.0, 1.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([1.0, 0.0],)], "vector array<float>")
    assert [r.ok for r in semantic.checked(bad, 2).collect()] == [False, False, False, False, True]


BLOCKS = "document_id long, page_index int, order int, text string, x double, y double, w double, h double, confidence double"


def test_layout(spark):
    rows = []
    for p in range(3):
        rows += [(1, p, 0, "Book Title 7", 10, 5, 80, 10, 0.9), (1, p, 1, "Some wrap-\n", 10, 30, 90, 10, 0.8), (1, p, 2, "ped words", 10, 42, 50, 10, 0.8), (1, p, 3, "end.", 62, 43, 20, 10, 0.8),
                 (1, p, 4, "More text goes on here", 10, 54, 90, 10, 0.8), (1, p, 5, "and here", 10, 66, 90, 10, 0.8), (1, p, 6, "tiny note", 10, 180, 40, 5, 0.8), (1, p, 7, str(p + 1), 50, 190, 5, 10, 0.8)]
    blocks = spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], BLOCKS)
    found = layout.lines(blocks)
    assert [r.text for r in found.where("page_index = 0").orderBy("line").collect()] == ["Book Title 7", "Some wrap-", "ped words end.", "More text goes on here", "and here", "tiny note", "1"]
    running = layout.running_lines(found.where("line = 0"))
    assert [(r.key, r.pages) for r in running.collect()] == [("book title #", 3)]
    heights = blocks.select("document_id", "page_index").distinct().withColumn("height", F.lit(200.0))
    body = layout.without_furniture(found, running, heights)
    assert [r.text for r in body.where("page_index = 1").orderBy("line").collect()] == ["Some wrap-", "ped words end.", "More text goes on here", "and here"]
    first = layout.paragraphs(body).orderBy("paragraph").first()
    assert first.text.startswith("Some wrapped words end.")
    q = layout.quality(blocks).where("page_index = 0").first()
    assert 0.8 < q.confidence < 0.9
    listing = spark.createDataFrame([(1, 0, i, f"Part {i} ..... {i}") for i in range(9)], "document_id long, page_index int, line int, text string")
    assert layout.contents_page(listing).count() == 1
