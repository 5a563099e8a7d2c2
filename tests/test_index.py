import json

import pytest

from lexiloom.operators import bm25
from lexiloom.plans import index

DOCS = "doc_id long, source string, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


ROWS = [(1, "alpha", "one two\nthree two"), (2, "two", "one\nfour one two one two"), (3, "x", "none here\n"), (4, "y", None)]
QUERY = [(("two",),), (("one", "two"), ("onetwo",))]


def same(i, d):
    from lexiloom.sources.tables import sections

    key = lambda s: sorted(tuple(r) for r in s.rows.collect())
    assert key(i.scored(QUERY)) == key(bm25.scored(sections(d), QUERY))
    assert key(i.scored(bm25.clauses("two zzz"))) == key(bm25.scored(sections(d), bm25.clauses("two zzz")))


def test_the_index_scores_like_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    i = index.Index.build(docs(spark, ROWS), path, 4)
    same(i, docs(spark, ROWS))
    i.add(docs(spark, [(2, "two", "two two one"), (9, "new", "one two")]))
    now = [r for r in ROWS if r[0] != 2] + [(2, "two", "two two one"), (9, "new", "one two")]
    same(i, docs(spark, now))
    i.remove(docs(spark, [(1, "", ""), (77, "", "")]))
    now = [r for r in now if r[0] != 1]
    same(index.Index(spark, path), docs(spark, now))
    i.add(docs(spark, [(1, "back", "two again")]))
    now.append((1, "back", "two again"))
    same(i, docs(spark, now))
    i.compact()
    again = index.Index(spark, path)
    assert len(again.m.segments) == 1 and not again.m.tombstones and again.m.generation == 4
    same(again, docs(spark, now))


def test_other_versions_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(index.IncompatibleIndex):
        index.Index(spark, path)
    index.Index.build(docs(spark, ROWS), path, 2)
    at = tmp_path / "index" / "manifest-0.json"
    (at.parent / ".manifest-0.json.crc").unlink()
    for change in ({"schema_version": 99}, {"identity": "other"}):
        at.write_text(json.dumps({**json.loads(at.read_text()), **change}))
        with pytest.raises(index.IncompatibleIndex):
            index.Index(spark, path)


def test_buckets_are_those_of_the_postings(spark, tmp_path, monkeypatch):
    import sys

    i = index.Index.build(docs(spark, ROWS), f"file://{tmp_path}/index", 7)
    words = ["two", "one", "é", "日本", "x" * 100]
    fast = i._buckets(words)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert sorted(i._buckets(words)) == fast


def test_terms_prune_folders_and_row_groups(spark, tmp_path):
    i = index.Index.build(docs(spark, ROWS), f"file://{tmp_path}/index", 4)
    plan = i.postings(["two"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:200]
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1][:200]


def test_of_two_writers_one_wins(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index.Index.build(docs(spark, ROWS), path, 2)
    a, b = index.Index(spark, path), index.Index(spark, path)
    a.add(docs(spark, [(5, "a", "two one")]))
    before = b.m
    with pytest.raises(index.Conflict):
        b.add(docs(spark, [(6, "b", "two one")]))
    assert b.m is before and before.generation == 0
    same(index.Index(spark, path), docs(spark, [*ROWS, (5, "a", "two one")]))
    b = index.Index(spark, path)
    b.add(docs(spark, [(6, "b", "two one")]))
    same(b, docs(spark, [*ROWS, (5, "a", "two one"), (6, "b", "two one")]))


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    i = index.Index.build(docs(spark, ROWS), path, 2)

    def dies(*_):
        raise OSError

    with monkeypatch.context() as m:
        m.setattr(index, "write_manifest", dies)
        for change in (lambda: i.add(docs(spark, [(1, "a", "new two")])), lambda: i.remove(docs(spark, [(2, "", "")])), i.compact):
            with pytest.raises(OSError):
                change()
    same(i, docs(spark, ROWS))
    (tmp_path / "index" / "manifest-1.json").write_text('{"schema_ver')
    again = index.Index(spark, path)
    same(again, docs(spark, ROWS))
    with pytest.raises(index.Conflict):
        again.remove(docs(spark, [(2, "", "")]))
