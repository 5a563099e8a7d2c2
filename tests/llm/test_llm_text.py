import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import bpe, decontaminate, license_scan, toxicity
from lexiloom.llm.common import documents, text_bytes

SCHEMA = "doc_id long, text string, ids string, score string, item_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


# BPE

ODD = [
    None, "", "   \n", "aaaa aaaaaaaa aaaaa", "I'm don't WE'LL 123 ½ ﷽ é é İstanbul ΑΣ Σ ßẞ <|startoftext|>x<|endoftext|> <|START|>",
    "日本語 テスト🙂🙂 a\x1cb\x85c x\x00y ̈ ' ́s", "!!!??..'' ''s 's's", "heheheen atndheheheshou. anananwh, " * 3, "w" * 30000, "가각 가 ﬁ   x",
]


def test_bpe_against_the_library(spark, sf_dir):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    docs = documents(spark, sf_dir).select("doc_id", "text").collect()
    rows = [(i, t) for i, t in enumerate([*ODD, *[r.text for r in docs]])]
    got = {r.doc_id: r for r in bpe.digests(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_random_unicode():
    rng = random.Random(1)
    tokenizer = Tokenizer.from_file(bpe.default_path())
    codec = bpe.Codec(bpe.default_path())
    pool = [*range(1, 0x250), *range(0x300, 0x380), *range(0x1E00, 0x2100), *range(0xAC00, 0xAC40), *range(0x1F600, 0x1F620)]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randrange(40))) for _ in range(2000)]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    for t, ids, e in zip(texts, codec.encode(texts), want, strict=True):
        assert ids.tolist() == e.ids, repr(t)
        assert codec.decode(ids) == tokenizer.decode(e.ids, skip_special_tokens=False)


def test_bpe_long_texts_in_parts(monkeypatch):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    codec = bpe.Codec(bpe.default_path())
    text = "Some words, é <|endoftext|> don't\t\n stop " * 20 + "z" * 300
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    for size in (1, 7, 50, 10_000):
        assert "".join(bpe.parts(text, size)) == text
        monkeypatch.setattr(bpe.parts, "__defaults__", (size,))
        assert bpe._told(codec, text) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_hashes_in_blocks(monkeypatch):
    from lexiloom.llm import texthash

    rng = np.random.default_rng(1)
    buf = rng.integers(97, 101, 5000).astype(np.uint8)
    buf[rng.integers(0, 5000, 900)] = 32
    starts, ends, _ = texthash.spans(buf, np.array([0, 5000]), texthash.WHITE)
    whole = texthash.span_hashes(buf, starts, ends)
    for size in (1, 3, 100, 4999):
        monkeypatch.setattr(texthash, "BLOCK", size)
        assert (texthash.span_hashes(buf, starts, ends) == whole).all()


def test_bpe_empty_table_and_ids(spark):
    assert bpe.digests(frame(spark, [])).count() == 0
    row = bpe.encode(frame(spark, [(1, "Hello hello")])).first()
    assert row.ids[0] == row.ids[1] and row.decoded == "hello</w> hello</w>"


# toxicity

def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        t = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["Idiot,", "scum", "MORON!"]))
        rows.append((i, " ".join(t)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus(600, 2)
    rows += [(10_000, None), (10_001, ""), (None, "w1 w2"), (3, rows[3][1])]
    docs, marked = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marked)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    truth = {i: t for i, _, t in labels}
    import zlib

    held = [r for r in scores if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len(model[0]) < 2000  # L1 leaves few weights
    kept = {r.doc_id for r in toxicity.reject(docs, marked).collect()}
    assert None in kept and 10_001 in kept and len(kept) < 520


def test_toxicity_never_learns_from_held_out_labels(spark):
    rows, labels = corpus(200, 3)
    import zlib

    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = frame(spark, rows)
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.5, 0.5]
    nulls = spark.createDataFrame([(1, 1, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(frame(spark, []), toxicity.train(docs, nulls)).count() == 0


# decontamination

def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def tiling(item, doc, n):
    """Greedy string tiling from its definition: tokens of the item that are marked."""
    p, t = words(item), words(doc)
    n = min(n, len(p))
    if not n:
        return 0
    mp, mt = [False] * len(p), [False] * len(t)
    while True:
        best, found = n - 1, []
        for a in range(len(p)):
            for b in range(len(t)):
                j = 0
                while a + j < len(p) and b + j < len(t) and p[a + j] == t[b + j] and not mp[a + j] and not mt[b + j]:
                    j += 1
                if j > best:
                    best, found = j, [(a, b)]
                elif j == best and j >= n:
                    found.append((a, b))
        if not found:
            return sum(mp)
        for a, b in found:
            if not any(mp[a : a + best]) and not any(mt[b : b + best]):
                mp[a : a + best] = mt[b : b + best] = [True] * best


def test_tiling_against_its_definition(spark):
    rng = random.Random(4)
    vocab = ["a", "b", "c", "D", "é"]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30))) for _ in range(12)] + [None, "", "one two", "Same! text, twice (over) again", "Same! text, twice (over) again"]
    docs = [None, "", "xx one, two yy"]
    for _ in range(25):
        t = [rng.choice(vocab) for _ in range(rng.randrange(40))]
        item = words(rng.choice(items[:12]))
        if item:
            cut = rng.randrange(len(item))
            t[5:5] = [*item[cut:], "#x", *item[:cut]]
        docs.append(" ".join(t))
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    rows = frame(spark, list(enumerate(docs)))
    for block in (4_000_000, 40):
        got = {(r.doc_id, r.item_id): (r.item_tokens, r.covered) for r in decontaminate.matches(rows, bench, block_chars=block).collect()}
        for i, d in enumerate(docs):
            for k, item in enumerate(items[:-1]):
                want = tiling(item, d, 5)
                assert got.get((i, k), (0, 0))[1] == want, (item, d)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, bench).collect()}
    assert (2, 14) in found
    assert {r.doc_id for r in decontaminate.decontaminate(rows, bench).collect()} == set(range(len(docs))) - {i for i, _ in found}


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, [(1, "a")]), none).count() == 0
    assert decontaminate.decontaminate(frame(spark, [(1, "a")]), none).count() == 1
    assert decontaminate.leaks(frame(spark, []), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


# licenses

def test_license_bands_find_what_all_windows_find():
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        t = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            body = rng.choice(license_scan.TEMPLATES)[1].split()
            if rng.random() < 0.5:
                body[rng.randrange(len(body))] = "changed"
            at = rng.randrange(len(t) + 1)
            t[at:at] = body
        texts.append(" ".join(t))
    cat = license_scan.Catalogue(license_scan.TEMPLATES)
    h, cuts = decontaminate.tokens(*text_bytes(pa.array(texts)))
    got = {(r, k) for r, k, *_ in license_scan.scan(h, cuts, cat)}
    # every run of as many shingles as the class has lies in a window
    want = set()
    for r in range(len(texts)):
        for (n, size), ks in cat.groups.items():
            w = decontaminate.windows(h[cuts[r] : cuts[r + 1]], n)
            for k in ks:
                for a in range(max(1, len(w) - size + 1)):
                    if len(np.intersect1d(w[a : a + size], cat.sets[k])) >= 0.8 * len(cat.sets[k]):
                        want.add((r, k))
                        break
    assert want and want <= got
    for r, k in got - want:  # windows are a little longer
        (n, size), = [g for g, ks in cat.groups.items() if k in ks]
        w = decontaminate.windows(h[cuts[r] : cuts[r + 1]], n)
        assert len(np.intersect1d(w, cat.sets[k])) >= 0.8 * len(cat.sets[k])


def test_license_places_and_edges(spark):
    text = "é intro.\nReleased under the MIT License. More.\nLicensed under the Apache License, Version 2.0."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "unlicensed"), (None, "x " * 20000 + "Licensed under CC BY-NC 4.0. " + "y " * 20000)]
    got = sorted(((r.doc_id, r.license_id, r.first_char, r.end_char) for r in license_scan.matches(frame(spark, rows)).collect()), key=str)
    a, b = text.index("Released"), text.index("Licensed")
    mit, apache = (1, "MIT", a, a + len("Released under the MIT License")), (1, "Apache-2.0", b, b + len("Licensed under the Apache License, Version 2.0"))
    assert got == sorted([mit, mit, apache, apache, (None, "CC-BY-NC-4.0", 40000, 40000 + len("Licensed under CC BY-NC 4.0"))], key=str)
    assert license_scan.matches(frame(spark, [])).count() == 0
    assert license_scan.matches(frame(spark, rows), []).count() == 0


@pytest.mark.parametrize("size", [1, 2, 4, 16, 64])
def test_license_windows_hold_every_run(size):
    step = license_scan.step_of(size)
    for n in (size, size + 1, size + step, 3 * size + 1):
        for a in range(n - size + 1):
            last = max(0, -(-(n - size - step) // step))
            assert any(g * step <= a and a + size <= min(n, g * step + size + step) for g in range(last + 1))
