import hashlib
import random

from lexiloom.llm import suffix_dedup

SCHEMA = "doc_id long, text string, h string"


def brute(texts, length):
    """Per text: n_bytes, n_removed, n_spans, kept."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def check(spark, texts, length):
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.removed(spark.createDataFrame(rows, SCHEMA), length, texts=True).collect()}
    want = dict(enumerate(brute(texts, length)))
    assert got == want


def test_random_texts_of_few_letters(spark):
    rng = random.Random(5)
    for letters, length in (("ab", 16), ("abcdé", 8), ("a", 8)):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(60)]
        base = "".join(rng.choice("abcdefgh") for _ in range(120))
        for _ in range(20):
            a = rng.randrange(100)
            t = list(base[a : a + rng.randrange(60)])
            if t and rng.random() < 0.7:
                t[rng.randrange(len(t))] = "X"
            texts.append("".join(rng.choice("xyz") for _ in range(rng.randrange(9))) + "".join(t))
        check(spark, [None, "", *texts], length)


def test_passages_by_words(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4)))
    shared = [word() for _ in range(12)]
    texts = [None, "", " \n", *[" ".join([*[word() for _ in range(rng.randrange(9))], *shared[rng.randrange(6) : rng.randrange(6, 13)], *[word() for _ in range(rng.randrange(9))]]) for _ in range(60)]]
    texts += ["x " * 20, "\t".join(shared)]
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    for passage in (4, 7):
        seen = {}
        seqs = [[w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w] for t in texts]
        for q in seqs:
            for p in range(len(q) - passage + 1):
                seen[tuple(q[p : p + passage])] = seen.get(tuple(q[p : p + passage]), 0) + 1
        want = {}
        for i, q in enumerate(seqs):
            gone = [False] * len(q)
            for p in range(len(q) - passage + 1):
                if seen[tuple(q[p : p + passage])] > 1:
                    gone[p : p + passage] = [True] * passage
            want[i] = (sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)))
        got = {r.doc_id: (r.n_repeated_words, r.n_passages) for r in suffix_dedup.removed(spark.createDataFrame(rows, SCHEMA), 40, passage=passage).collect()}
        assert got == want and any(n for n, _ in want.values()) and not all(n for n, _ in want.values())


def test_production_length_copies_and_near_copies(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = " ".join(word() for _ in range(300))
    other = base[:900] + "#" + base[901:]
    texts = [base, base, other, "start " + base[300:800] + " end", base[100:499], base[100:500], "x" * 401, None, "", "y" * 400]
    check(spark, texts, 400)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh") for _ in range(300))
    data = [(0, base + "Q" + base[40:120]), (1, "Z" + base[100:180])]
    import numpy as np
    import pyarrow as pa

    # the functions that run on the workers, in this process
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([data[0][1]])], names=["doc_id", "text"])
    windows = set()
    for _, buf, offsets, k in suffix_dedup.parts([batch], 16):
        r = suffix_dedup.Ranks(buf, offsets, 16)
        at, _ = r.windows(np.arange(len(r.anchor)))
        new = {(k * 64 if k else 0) + int(x) for x in at}
        assert not windows & new
        windows |= new
    assert windows == set(range(len(data[0][1]) - 15))


def test_lengths_and_ranks():
    import numpy as np

    assert suffix_dedup.lengths(400) == [50, 100, 200, 400]
    assert suffix_dedup.lengths(7) == [1, 2, 4, 7]
    rng = random.Random(8)
    for length in (7, 16, 40):
        data = "".join(rng.choice("ab") for _ in range(3000)).encode()
        r = suffix_dedup.Ranks(np.frombuffer(data, np.uint8), np.array([0, len(data)]), length)
        for level, size in enumerate(r.lengths):
            at = np.arange(len(data) - size + 1)
            for k in (0, 1):
                assert len(set(r.rank(at, level, k).tolist())) == len({data[p : p + size] for p in at.tolist()})


def test_a_missing_or_short_shard_fails(spark, monkeypatch):
    import os

    import numpy as np
    import pytest
    from lexiloom.llm import store

    monkeypatch.setattr(store, "SHARD_ROWS", 100)
    rows = [(int(x), int(x) % 7) for x in np.random.default_rng(1).integers(-(1 << 63), 1 << 63 - 1, 1000)]
    folder, bits = store.write_set(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], "pairs")
    a, b = (np.array(x, np.int64).view(np.uint64) for x in zip(*rows, strict=True))
    assert bits and store.Sets(folder, bits).has(a, b).all() and not store.Sets(folder, bits).has(a, b + np.uint64(1)).any()
    path = f"{folder.removeprefix('file://')}/3.u8"
    whole = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(whole[:-8])
    with pytest.raises(ValueError):
        store.Sets(folder, bits).has(a, b)
    os.remove(path)
    with pytest.raises(FileNotFoundError):
        store.Sets(folder, bits).has(a, b)


def test_pairs_that_share_their_first_number(spark):
    import numpy as np
    from lexiloom.llm import store

    found = store.Sets(*store.write_set(spark.createDataFrame([(5, k) for k in range(0, 20, 2)] + [(9, 1)], "a long, b long"), ["a", "b"], "pairs"))
    assert found.has(np.full(20, 5, np.uint64), np.arange(20).astype(np.uint64)).tolist() == [k % 2 == 0 for k in range(20)]


def test_empty_table_and_digest(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], SCHEMA)).count() == 0
    row = suffix_dedup.removed(spark.createDataFrame([(1, "abc", "")], SCHEMA)).first()
    assert row.kept_sha256 == hashlib.sha256(b"abc").hexdigest()
