"""Odd rows for every operator that gives a row per document: null ids and texts, repeats, clashing columns, a long text."""

import pytest

from lexiloom.llm import bpe, decontaminate, exact_dedup, license_scan, ngram, pii, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, fp long, rank string, n_tokens string, score string, found string, item_id string, `select` string"
ROWS = [
    (None, "a row without an id", 1, None, "", None, "f", None, None), (None, None, None, None, None, None, None, None, None), (1, None, 1, "r", "n", "s", "f", "i", "x"), (2, "", 1, "r", "n", "s", "f", "i", "x"),
    (3, "same words here", 1, "r", "n", "s", "f", "i", "x"), (3, "same words here", 1, "r", "n", "s", "f", "i", "x"), (-5, " \t\n", 1, "r", "n", "s", "f", "i", "x"),
    (1 << 40, "long " * 60_000, 1, "r", "n", "s", "f", "i", "x"), (7, "\x00 🦉 é́   ﷽", 1, "r", "n", "s", "f", "i", "x"), (8, "x" * 50_000, 1, "r", "n", "s", "f", "i", "x"),
]


def labels(spark):
    return spark.createDataFrame([(3, 1, 1), (7, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


PER_DOCUMENT = {
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels(d.sparkSession))),
    "exact": exact_dedup.groups,
    "simhash": simhash.near_components,
    "ngram": lambda d: ngram.score(d, ngram.train(d.select("text"))),
    "pii": pii.digests,
    "suffix": suffix_dedup.removed,
    "bpe": bpe.digests,
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, name):
    key = lambda ids: sorted(ids, key=lambda x: (x is not None, x))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert key([r.doc_id for r in PER_DOCUMENT[name](docs).collect()]) == key([r[0] for r in ROWS])
    assert PER_DOCUMENT[name](docs.where("false")).count() == 0


def test_repeated_rows_get_equal_results(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, f in PER_DOCUMENT.items():
        same = [tuple(r) for r in f(docs).where("doc_id = 3").collect()]
        assert len(same) == 2 and same[0] == same[1], name


def test_filters_keep_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    bench = spark.createDataFrame([(1, "same words here"), (None, "x"), (2, None)], "item_id long, text string")
    for f in (lambda d: toxicity.reject(d, labels(spark)), exact_dedup.deduplicate, simhash.deduplicate, lambda d: decontaminate.decontaminate(d, bench)):
        out = f(docs)
        assert out.dtypes == docs.dtypes
        assert f(docs.where("false")).count() == 0
    assert decontaminate.decontaminate(docs, bench).where("doc_id = 3").count() == 0
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == {3}
    assert license_scan.matches(docs).count() == 0
