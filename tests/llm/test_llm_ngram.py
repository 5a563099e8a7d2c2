import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lexiloom.llm import ngram

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def brute(train, score, order):
    """Interpolated modified Kneser-Ney with dictionaries."""
    counts = Counter()
    words = Counter()
    for t in train:
        seq = ["<s>"] * (order - 1) + tokens(t)
        words.update(tokens(t))
        for i in range(order - 1, len(seq)):
            counts[tuple(seq[i - order + 1 : i + 1])] += 1
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    info = {}
    for k, c in levels.items():
        n = Counter(c.values())
        info[k] = ngram._discounts({"a": n[1], "b": n[2], "c": n[3], "d": n[4]})
    D = lambda k, c: 0 if not c else info[k][min(c, 3) - 1]
    after = {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)
    N, V = sum(words.values()), len(words)

    def p(k, g):
        if not k:
            return 1 / (V + 1)
        ns = after[k].get(g[:-1])
        if not ns:
            return p(k - 1, g[1:])
        c = levels[k][g]
        return max(c - D(k, c), 0) / sum(ns) + sum(D(k, n) for n in ns) / sum(ns) * p(k - 1, g[1:])

    out = []
    for t in score:
        seq = ["<s>"] * (order - 1) + tokens(t)
        own = tokens(t)
        out.append((len(own), sum(w in words for w in own), sum(math.log10((words[w] + 1) / (N + V + 1)) for w in own),
                    sum(math.log10(p(order, tuple(seq[i - order + 1 : i + 1]))) for i in range(order - 1, len(seq)))))
    return N, out


@pytest.mark.parametrize("order,shard_bytes,hot", [(2, 1 << 20, 1 << 30), (2, 500, 20), (3, 700, 20)])
def test_against_dictionaries(spark, order, shard_bytes, hot):
    rng = random.Random(order)
    vocab = ["the", "The", "a", "é", "x", *[f"w{i}" for i in range(40)]]
    make = lambda: " ".join(rng.choice(vocab[: rng.choice((5, 45))]) for _ in range(rng.randrange(30))) + rng.choice(["", "\n", "\t z"])
    train = [make() for _ in range(120)] + [None, "", "the the the the"]
    test = train[:20] + [make() + " unseen word" for _ in range(20)] + [None, "", "Ünseen"]
    model = ngram.train(spark.createDataFrame([(t,) for t in train], "text string"), order, shard_bytes, hot)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(test)], "doc_id long, text string, words string")
    got = {r.doc_id: r for r in ngram.score(docs, model).collect()}
    N, want = brute(train, test, order)
    assert model["tokens"] == N
    for i, (n, known, base, total) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, abs=1e-9)
        assert r.score == pytest.approx(total, abs=1e-9)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "text string")
    model = ngram.train(none)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.score) for r in ngram.score(docs, model).collect()) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
    assert ngram.score(docs.where("doc_id > 5"), model).count() == 0


def test_query_looks_at_two_words_before(spark):
    train = ["a b c", "d b e"] * 5
    model = ngram.train(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = spark.createDataFrame([(0, "a b c"), (1, "a b e")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ngram.score(docs, model).collect()}
    for order in (2, 3):
        want = [x[3] for x in brute(train, ["a b c", "a b e"], order)[1]]
        assert (want[0] > want[1] + 0.01) == (order > 2)
    assert [got[0], got[1]] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("most", [1, 255, 256, (1 << 32) - 1, 1 << 32])
def test_tables_of_any_size(most):
    np, U = ngram.np, ngram.U
    rng = np.random.default_rng(most)
    for size in (0, 1, 7, 1000, 40_000):
        keys = np.unique(rng.integers(0, 1 << 63, size).astype(U))
        values = rng.integers(1, 4, (len(keys), 2))
        values[::7, 0] = np.arange(len(values[::7]))  # more than there are codes
        values[:1] = most
        data = np.frombuffer(ngram.laid_out([ngram.table(keys, values[:, :1]), ngram.table(keys, values)]), np.uint8)
        found = ngram.arrays(data, 12)
        q = np.concatenate((keys, rng.integers(0, 1 << 63, 500).astype(U)))
        for width, some in ((1, found[:6]), (2, found[6:])):
            got = ngram.look_up(some, q, width, lambda v: 2 * v + 1)
            assert (got[: len(keys)] == 2 * values[:, :width] + 1).all() and (got[len(keys) :] == 1).all()
        if size > 1:
            with pytest.raises(ValueError):
                ngram.arrays(data[:-8], 12)


def test_packed_columns():
    np, U = ngram.np, ngram.U
    rng = np.random.default_rng(4)
    for top in (3, 300, 1 << 40, 1 << 62):
        for size in (1, 500):
            raw = [rng.integers(0, top, size).astype(U) for _ in range(3)]
            cols, n = ngram.summed(raw)
            again, m = ngram.summed(raw, np.full(size, 2))
            assert all((a == b).all() for a, b in zip(again, cols, strict=True)) and (m == 2 * n).all()
            assert list(zip(*cols, strict=True)) == sorted(set(zip(*cols, strict=True))) and n.sum() == size
            back, m = ngram.unpack(ngram.pack(cols, n))
            assert all((a == b).all() for a, b in zip(back, cols, strict=True)) and (m == n).all()


def test_groups_of_shards_and_a_lost_shard(spark, monkeypatch):
    import os

    rng = random.Random(9)
    train = [" ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randrange(40))) for _ in range(200)]
    texts = spark.createDataFrame([(t,) for t in train], "text string")
    docs = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    monkeypatch.setattr(ngram, "COARSE", 2)
    monkeypatch.setattr(ngram, "WRITERS", 3)
    model = ngram.train(texts, 3, 400, 50)
    assert model["bits"] > 3
    got = {r.doc_id: r.score for r in ngram.score(docs, model).collect()}
    want = [x[3] for x in brute(train, train, 3)[1]]
    assert [got[i] for i in range(len(train))] == pytest.approx(want, abs=1e-9)
    os.remove(f"{model['folder'].removeprefix('file://')}/order3-1")
    with pytest.raises(Exception, match="order3-1"):
        ngram.score(docs, model).collect()
