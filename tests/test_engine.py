import pytest
from pyspark.sql import Window, functions as F

from lexiloom.engine import Library
from lexiloom.operators.analysis import QueryTooLong

ROWS = (
    [(1, "Harbour notes", i, None, f"The lantern number {i} burns") for i in range(24)]
    + [(2, "Lantern almanac", 0, None, "Nothing to see here")]
    + [(3, "Split", 0, None, "A copper kettle"), (3, "Split", 1, None, "and a velvet curtain")]
    + [(4, "Phrase", 0, None, "the quiet river bends"), (5, "Phrase", 0, None, "the quiet old river bends")]
    + [(6, "Stem", 0, None, "running rivers and river banks"), (7, "Dash", 0, "On well-being", "well—being, high- lights and AB-123")]
    + [(i, "Same", 0, None, "identical marble statue") for i in (8, 9, 10)]
    + [(11, "عنوان", 0, None, "قرأت الْكِتَاب في المكتبة"), (12, "Emoji", 0, None, "a 🦉 owl retrieval"), (13, "Empty", 0, None, "")]
    + [(14, "Order", 0, None, "velvet is not near copper"), (15, "Order", 0, None, "copper velvet together")]
)


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    s = spark.createDataFrame(ROWS, "doc_id long, title string, ordinal long, heading string, text string")
    return Library.create(spark, s, f"file://{tmp_path_factory.mktemp('library')}")


def ids(result):
    return [r.doc_id for r in result.documents.orderBy("rank").collect()]


def test_terms_titles_and_evidence(library):
    r = library.search("lantern")
    assert set(ids(r)) == {1, 2} and r.total_documents == 2 and r.total_sections == 24
    by = {x.doc_id: x.matching_sections for x in r.documents.collect()}
    assert by == {1: 24, 2: 0}  # a title makes a document a result, but no section a match
    assert [x.passage for x in r.passages.where("doc_id = 1").orderBy("passage").collect()] == [1, 2, 3]
    bins = r.locations.where("doc_id = 1").collect()
    assert sum(b.match_count for b in bins) == 24 and {b.bin for b in bins} == set(range(12))


def test_terms_in_different_sections_come_after_those_together(library):
    r = library.search("copper velvet")
    assert ids(r)[0] == 15 and set(ids(r)) == {3, 14, 15}
    scopes = {x.doc_id: x.scope for x in r.documents.collect()}
    assert scopes == {15: "section", 14: "section", 3: "document"} and ids(r)[-1] == 3
    assert {(c.doc_id, c.term) for c in r.coverage.where("doc_id = 3").collect()} == {(3, 0), (3, 1)}


def test_phrases_are_literal(library):
    assert ids(library.search('"quiet river"')) == [4]
    assert set(ids(library.search("quiet river"))) == {4, 5}
    assert ids(library.search('"river bank"')) == [6]  # part of a word
    assert ids(library.search('"running river bank"')) == []  # stems alone don't do
    r = library.search("", exact=["quiet river"]).documents.first()
    assert (r.match_count, r.first_section) == (1, 0) and "<mark>quiet river</mark>" in r.excerpt


def test_hyphens_headings_identifiers_and_stems(library):
    assert ids(library.search("wellbeing")) == []
    assert ids(library.search("well-being")) == [7]
    assert ids(library.search("highlights")) == [] and ids(library.search('"highlights"')) == []
    assert ids(library.search("high- lights")) == [7] and ids(library.search("AB-123")) == [7]
    assert set(ids(library.search("run"))) == {6}


def test_ties_newest_first_limits_and_scope(spark, library):
    assert ids(library.search("marble statue")) == [10, 9, 8]
    r = library.search("marble statue", limit=1)
    assert ids(r) == [10] and r.total_documents == 3
    scope = spark.createDataFrame([(8,), (9,)], "doc_id long")
    assert ids(library.search("marble statue", scope=scope)) == [9, 8]
    assert ids(library.search("marble statue", scope=scope.where("false"))) == []


def test_arabic_form(library):
    assert ids(library.search("الكتاب")) == [11]


def test_broader_mode(library):
    r = library.search("copper velvet lantern zebra", mode="broader")
    assert set(ids(r)) == {3, 14, 15} and {x.matched for x in r.documents.collect()} == {2}
    assert ids(library.search("copper velvet lantern zebra")) == []


def test_suggestion_and_limits(library):
    assert library.search("retrieva1 x").suggestion is None
    assert library.search("retrievel").suggestion == "retrieval"
    with pytest.raises(QueryTooLong):
        library.search("x " * 200)
    assert library.search("...").total_documents == 0


def test_concordance_find_and_conceptual(spark, library):
    page = library.concordance("lantern", 2, 3).collect()
    assert [r.occurrence_index for r in page] == [2, 3, 4] and page[0].before.endswith("the ")
    assert [r.match_count for r in library.find(6, "river").collect()] == [2]
    v = spark.createDataFrame([(4, 0, [1.0, 0.0]), (5, 0, [0.8, 0.6]), (6, 0, [0.0, 1.0])], "doc_id long, passage long, vector array<float>")
    assert [r.doc_id for r in library.conceptual(v, [1.0, 0.0], 2).collect()] == [4, 5]
    assert [r.doc_id for r in library.conceptual(v, [1.0, 0.0], 2, exact=["old river"]).collect()] == [5]


def test_conceptual_requests_encode_late_and_hold_passages_against_the_text(spark, library):
    from lexiloom.operators import semantic

    own = semantic.passages(library.sections.where("doc_id IN (4, 5)")).withColumn("passage", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "start")) - 1)
    v = own.select("doc_id", "passage", F.when(F.col("doc_id") == 4, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.8), F.lit(0.6))).alias("vector"), "content_hash")
    asked = []
    encode = lambda: asked.append(1) or [1.0, 0.0]
    assert [r.doc_id for r in library.conceptual(v, encode).collect()] == [4, 5] and asked == [1]
    assert library.conceptual(v, encode, scope=v.where("false").select("doc_id")).count() == 0 and asked == [1]
    stale = v.withColumn("content_hash", F.when(F.col("doc_id") == 4, "other").otherwise(F.col("content_hash")))
    assert [r.doc_id for r in library.conceptual(stale, [1.0, 0.0]).collect()] == [5]
    assert library.availability(v, 2) == "partial" and library.availability(v, 3) == "incompatible" and library.availability(v.where("false")) == "missing-index"
    every = library.sections.select("doc_id", F.array(F.lit(1.0)).alias("vector"))
    assert library.availability(every, 1) == "ready"


def test_passages_have_snippets(library):
    rows = library.search("marble statue").passages.collect()
    assert rows and all("<mark>" in r.snippet and r.in_body for r in rows)


def test_documents_can_be_added(spark, library, tmp_path):
    s = spark.createDataFrame(ROWS, library.sections.schema)
    own = Library.create(spark, s, f"file://{tmp_path}/more")
    new = spark.createDataFrame([(20, "New", 0, None, "a marble lantern")], library.sections.schema)
    own.add(new)
    assert set(ids(Library(spark, s.unionByName(new), own.path).search("marble lantern"))) == {20}
