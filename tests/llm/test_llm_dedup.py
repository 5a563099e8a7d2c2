import hashlib
import random
import re

import numpy as np
import xxhash

from lexiloom.llm import components, exact_dedup, simhash

SCHEMA = "doc_id long, text string, __key string, n int, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(spark):
    rows = [(5, "a b"), (3, "a\n\t b"), (9, "a  b "), (1, None), (2, ""), (4, " "), (7, "\x1ca"), (8, "a\xa0b"), (3, "a b"), (None, "a b"), (None, "solo"), (6, "long " * 40000), (10, "long\n" * 40000)]
    got = sorted((tuple(r) for r in exact_dedup.groups(frame(spark, rows), 2).collect()), key=str)
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if plain(u) == plain(t)]
        known = [j for j in ids if j is not None]
        keep = min(known) if known else None
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(plain(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_deduplicate_keeps_columns(spark):
    rows = [(2, "a"), (1, "a"), (1, "a"), (3, "b"), (None, "c")]
    out = exact_dedup.deduplicate(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "__key", "n", "fp"]
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "a"), ("3", "b"), ("None", "c")]
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0


def test_directory_splits_overfull_buckets_only(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [(0x55 << 56) + i for i in range(100)]
    buckets = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "__key long"), 16).collect()
    found = {}
    for b in buckets:
        own = [k for k in keys if (k % (1 << 64)) >> (64 - b.depth) == b.prefix] if b.depth else keys
        assert len(own) == b.entries <= 16
        for k in own:
            assert k not in found
            found[k] = b
    assert len(found) == len(set(keys))


def groups_of(spark, rows):
    return sorted((tuple(r)[:4] for r in exact_dedup.groups(frame(spark, rows), 4).collect()), key=str)


def test_different_texts_of_one_key_are_chained_and_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, "ab"[i % 2] * (i % 5) + "c" * (i % 3)) for i in range(90)]
    right = groups_of(spark, rows)
    monkeypatch.setattr(exact_dedup, "key_of", lambda norm: F.shiftleft(F.length(norm).cast("long") % 4, 61))
    assert groups_of(spark, rows) == right


def test_a_wrong_directory_changes_the_result(spark, monkeypatch):
    rows = [(i, f"text {i % 40}") for i in range(80)]
    right = groups_of(spark, rows)
    assert len(right) == 80
    build = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: (d := build(*a)).where(d.prefix != d.agg({"prefix": "max"}).first()[0]))
    assert groups_of(spark, rows) != right


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def closure(fps):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    bases = [[word() for _ in range(rng.choice((1, 2, 3, 40, 200)))] for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\t\n"), (3, "One"), (4, "one two"), (5, "É x")]
    for b in bases:
        for _ in range(rng.randrange(1, 6)):
            t = list(b)
            if len(t) > 30 and rng.random() < 0.8:
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), (" " if rng.random() < 0.5 else "\n").join(t).upper() if rng.random() < 0.3 else " ".join(t)))
    fps = [fingerprint(t) for _, t in rows]
    roots = closure(fps)
    got = {r.doc_id: r for r in simhash.near_components(frame(spark, rows)).collect()}
    for k, (i, _) in enumerate(rows):
        assert got[i].fingerprint == f"{fps[k]:016x}"
        assert got[i].component_id == roots[k]
    assert len(set(roots)) < len(rows) - 5
    kept = {r.doc_id for r in simhash.deduplicate(frame(spark, rows)).collect()}
    assert kept == set(roots)


def test_fingerprints_of_long_texts_in_parts():
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 4, 50):
        t = "".join(rng.choice(["Word ", "x\n", "  ", "\té "]) for _ in range(n)) + "end" * (n % 2)
        for part in (1, 2, 7, 30, 1 << 20):
            assert simhash.fingerprint(t.encode(), part) == fingerprint(t)


def test_covering_masks_find_every_pair_within_the_radius():
    masks = simhash.masks(3)
    assert len(masks) == 15
    rng = random.Random(3)
    for _ in range(3000):
        d = sum({1 << rng.randrange(64) for _ in range(3)})
        assert any(not d & m for m in masks)


def test_buckets_of_any_size_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 3).astype(np.uint64)
    fps = np.unique(np.array([int(centres[rng.integers(3)]) ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 8))}) for _ in range(300)], np.uint64))
    want = closure([int(f) for f in fps])
    for large in (4096, 10):
        assert simhash.link_bucket(fps, 3, large).tolist() == want


def test_simhash_nulls_repeats_and_empty(spark):
    rows = [(None, "alone here now"), (7, "same text is here"), (7, "same text is here"), (None, "same text is here")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None), (7, 7), (7, 7), (None, 7)], key=str)
    base = [f"word{i}" for i in range(300)]
    near = next(t for i in range(300) for t in [" ".join([*base[:i], "changed", *base[i + 1 :]])] if 0 < bin(fingerprint(t) ^ fingerprint(" ".join(base))).count("1") <= 3)
    linked = simhash.near_components(frame(spark, [(5, " ".join(base)), (None, near)])).collect()
    assert {r.component_id for r in linked} == {5}
    assert simhash.near_components(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (3, 1), *[(100 + i, 101 + i) for i in range(40)], *[(i, 1000) for i in range(2000, 2050)]]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got[2] == got[3] == 1 and got[5] == 4 and 9 not in got
    assert all(got[i] == 100 for i in range(101, 141)) and all(got[i] == 1000 for i in range(2000, 2050))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
