import hashlib
import re

from lexiloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "no data", "a@b.c%d@e.f x@y", "x..y@z.com.", "mail me: some.one+tag@mail-1.example.org, or 1.2.3.4 and 256.1.1.1 then 1.2.3.4.5.6.7.8",
    "01.002.0003.255 1..2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34", "é€😀 call +1 (988) 555-2485. or +44.20.7946.0958- and +12 34",
    "@" * 50 + "a@b.c", "1" * 30000 + "." + "2" * 10, "a" * 30000 + "@b.c", "1.2.3.4@host.org", "+" + "1(" * 2000, "4111111111111111" * 3,
    "password=a9ce335683f9772ddc and ssn 123-45-6789, Mr. Smith (030) 1234 5678 jane(at)site(dot)org", "a@b.c" * 600,
]


def test_base_against_re(spark):
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(TEXTS)], "doc_id long, text string, found string")
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = brute(t)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (t or "")[:50]
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]
        assert set(told.split(",")) <= set(got[i].spans.split(","))


def test_whole_table_against_re(spark, sf_dir):
    from lexiloom.llm.common import documents

    docs = documents(spark, sf_dir)
    got = {r.doc_id: r.base_sha256 for r in pii.digests(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(r.text)).encode()).hexdigest()


def test_em_finds_the_unreliable_labeler():
    rows = []
    for n, base, check, gaz, ctx in ((500, 1, 1, 1, 1), (400, 1, 1, 1, 0), (300, 0, 0, 0, 0), (20, 1, 1, 0, 0), (10, 0, 0, 1, 0)):
        rows.append({"k": 2, "n": n, "base": base, "len": 2, "digits": 3, "seps": 0, "before": 1, "after": 1, "check": check, "gaz": gaz, "ctx": ctx, "against": 0})
    label, rates = pii.reliabilities(rows)
    assert label[0] > 0.9 and label[2] < 0.1
    assert rates[1][0] > 0.9 and rates[1][1] > 0.9  # checksum
    assert rates[5][1] < 0.5  # "stands alone" never speaks against
    w = pii.classifier(rows)
    margin = lambda r: sum(w.get(k, 0) for k in pii._keys(r))
    assert margin(rows[0]) > 0 > margin(rows[2])


def test_empty_table(spark):
    assert pii.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_addresses_with_parts_of_zeros(spark):
    texts = ["10.0.0.1", "0.0.0.0", "at 192.168.0.5, 8.8.0.8 or 00.000.0000.1", "0.0.0.256 and 000.1.2.0255", "0" * 4000 + ".1.2.3", "0" * 4000 + "999.1.2.3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (got[i].n_ip, got[i].base_sha256) == (sum(x[0] == "ip" for x in want), hashlib.sha256(told.encode()).hexdigest()), t[:50]
        assert set(told.split(",")) <= set(got[i].spans.split(","))


def test_very_many_spans_take_linear_time(spark):
    import time

    def took(n):
        text = " ".join(f"1.2.3.{i % 256} u{i}@b.org pwd=x{i:08d}" for i in range(n))
        began = time.time()
        row = pii.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert (row.n_ip, row.n_email) == (n, n) and row.n_spans >= 2 * n
        return time.time() - began

    took(10)
    assert took(40_000) < 60  # some 7e9 comparisons of spans if each were held against each


def test_spans_that_touch_earlier_ones_go(spark):
    from pyspark.sql import functions as F

    import random

    rng = random.Random(3)
    rows = []
    for i in range(8):
        spans = []
        for k in (0, 1, 4, 5, 8):
            at = 0
            for _ in range(rng.randrange(700) if i else 0):
                at += rng.randrange(1, 30)
                spans.append((k, at, at + rng.randrange(1, 12), int(k < 4), *[0] * 9))
                at = spans[-1][2]
        rows.append((i, spans))
    found = spark.createDataFrame(rows, f"doc_id long, found {pii._TYPE}")
    got = {r.doc_id: [(s.start, s.end, s.k) for s in r.every] for r in pii.spans(found, {}).collect()}
    for i, spans in rows:
        base = [s for s in spans if s[3]]
        touch = lambda a, b: a[1] < b[2] and b[1] < a[2]
        more = [s for s in spans if not s[3] and not any(touch(s, b) for b in base)]
        more = [a for a in more if not any((b[1], b[0]) < (a[1], a[0]) and touch(a, b) for b in more)]
        assert sorted(got[i]) == sorted((s[1], s[2], s[0]) for s in base + more)


def test_secrets_by_format(spark):
    keys = ["AKIA" + "A1B2" * 4, "ghp_" + "a1B2" * 9, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"]
    found = pii.candidates(spark.createDataFrame([(i, f"so {k} there") for i, k in enumerate([*keys, "AKIAshort", "xAKIA" + "A1B2" * 4])], "doc_id long, text string"))
    got = {r.doc_id: [(s.start, s.end) for s in r.found if pii.PATTERNS[s.k][0] == "secret"] for r in found.collect()}
    assert got == {**{i: [(3, 3 + len(k))] for i, k in enumerate(keys)}, 4: [], 5: []}
