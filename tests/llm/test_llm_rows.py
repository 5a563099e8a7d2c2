"""Filters decide by id and text: ids may repeat with other texts, or be missing."""

from pyspark.sql import Row
from test_llm_text import corpus

from lexiloom.llm import decontaminate, exact_dedup, simhash, toxicity


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_exact_copies(spark):
    rows = [(1, "a"), (2, " a"), (2, "a"), (2, "only here"), (None, "a"), (None, "b"), (None, "b"), (None, "c"), (3, None), (None, "")]
    got = left(exact_dedup.deduplicate(frame(spark, rows)))
    assert got == sorted([(1, "a"), (2, " a"), (2, "only here"), (None, "b"), (None, "c"), (3, None)], key=str)


def test_near_copies(spark):
    long = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"thing{i}" for i in range(300))
    third = " ".join(f"some{i}" for i in range(300))
    rows = [(1, long), (2, long.upper()), (2, other), (None, long + "\n"), (None, third), (None, third + " "), (4, "x y z")]
    got = left(simhash.deduplicate(frame(spark, rows)))
    assert [x for x in got if "some" not in x[1]] == sorted([(1, long), (2, other), (4, "x y z")], key=str)
    assert len(got) == 4


def test_leaks(spark):
    item = "seven words that nobody else would say"
    rows = [(1, f"so {item} here"), (1, "a clean text"), (None, item), (None, "another clean text"), (None, None), (2, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = left(decontaminate.decontaminate(frame(spark, rows), bench))
    assert got == sorted([(1, "a clean text"), (None, "another clean text"), (None, None), (2, None)], key=str)


def test_toxic(spark):
    rows, labels = corpus(300, 5)
    marked = spark.createDataFrame(labels, "doc_id long, quality long, toxic int")
    told = {i: t for i, _, t in labels}
    bad = next(r[1] for r in rows if told.get(r[0]) and r[1])
    good = next(r[1] for r in rows if told.get(r[0]) == 0 and r[1])
    more = [(900_001, bad), (900_001, good), (None, bad), (None, good)]
    got = left(toxicity.reject(frame(spark, [(r[0], r[1]) for r in rows] + more), marked))
    assert (900_001, good) in got and (None, good) in got
    assert (900_001, bad) not in got and (None, bad) not in got


def test_very_long_texts_leave_the_sample_its_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100_000)
    rows, labels = corpus(300, 7)
    docs = frame(spark, rows + [(1000 + i, "w1 w2 " * 40_000) for i in range(60)])
    marked = spark.createDataFrame(labels + [(1000 + i, 1, i % 2) for i in range(60)], "doc_id long, quality long, toxic int")
    told = {i: t for i, _, t in labels}
    scores = [r for r in toxicity.score(docs, toxicity.train(docs, marked)).collect() if r.doc_id < 1000]
    assert sum((r.score >= 0.5) == told[r.doc_id] for r in scores) >= 0.97 * len(scores)


def test_bounded_sample():
    row = lambda toxic, n: Row(toxic=toxic, n_chars=n)
    rows = [row(0, 900), row(1, 2000), row(0, None), row(1, 10), row(0, 200), row(1, 5000)]
    assert toxicity.bounded(rows, 10_000) == rows
    assert toxicity.bounded(rows, 1000) == [rows[2], rows[3], rows[4]]
    assert toxicity.bounded([row(0, 5)] * 9 + [row(1, 70), row(1, 60)], 50) == [row(0, 5)] * 9 + [row(1, 60)]
    assert toxicity.bounded([], 10) == []
