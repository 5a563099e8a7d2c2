import re

import pytest
from test_llm_dedup import closure, fingerprint, plain

import corpus_pipeline
from lexiloom.llm import decontaminate, toxicity
from lexiloom.llm.common import documents, read_table


def test_stages_have_the_asked_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontaminate", "bpe"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's rows, written and read again."""
    from lexiloom.llm.common import written

    out = [documents(spark, sf_dir)]
    for name, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def test_each_stage_against_a_plain_version(spark, sf_dir, stages):
    docs = {r.doc_id: r.text for r in stages[0].collect()}
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    model = toxicity.train(stages[0], read_table(spark, sf_dir, "labels"))
    clean = {r.doc_id for r in toxicity.score(stages[0], model).collect() if r.score < 0.5}
    assert {r.doc_id for r in stages[1].collect()} == clean
    first = {}
    for i in sorted(clean):
        first.setdefault(plain(docs[i]), i)
    assert {r.doc_id for r in stages[2].collect()} == set(first.values())
    ids = sorted(first.values())
    roots = closure([fingerprint(docs[i]) for i in ids])
    near = {ids[r] for r in roots}
    assert {r.doc_id for r in stages[3].collect()} == near
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [words(r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    joined = {i: " " + " ".join(words(docs[i])) + " " for i in near}
    whole = {i for i, t in joined.items() if any(" " + " ".join(w) + " " in t for w in items if w)}
    left = {r.doc_id for r in stages[4].collect()}
    assert left <= near and not left & whole
    gone = {r.doc_id for r in decontaminate.leaks(stages[3], read_table(spark, sf_dir, "benchmark")).collect()}
    assert left == near - gone
    assert {r.doc_id for r in stages[5].collect()} == left


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[-1])


def test_empty_and_odd_tables(spark, sf_dir):
    schema = stages_schema = documents(spark, sf_dir).schema
    assert stages_schema is schema
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)], schema)
    for docs in (none, odd):
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, sf_dir)
        docs.collect()
