import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import speech, stemming, text as T
from lexiloom.operators import analysis, bm25


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def test_normal_form(spark):
    texts = ["high- lights", "well—being", "AB-123", "a-b-c", " Two\n\tspaces ", "‘quoted’ “text”", "é- É", None, ""]
    assert values(spark, T.normal_form, texts) == ["highlights", "wellbeing", "ab-123", "abc", "two spaces", "'quoted' \"text\"", "éé", None, ""]


def test_escape_and_excerpts(spark):
    assert values(spark, T.escaped, ["<a href='x'>&\""]) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]
    assert values(spark, T.safe_excerpt, ["<b>a</b> <mark>b</mark>"]) == ["&lt;b&gt;a&lt;/b&gt; <mark>b</mark>"]
    assert values(spark, T.first_mark, ["x <mark>one</mark> <mark>two</mark>", "none"]) == ["one", ""]
    assert values(spark, T.without_marks, ["x <mark>one</mark>"]) == ["x one"]


def test_sentences_and_clauses(spark):
    assert values(spark, T.sentences, ['He said "No." Then? Pi is 3.14! 你好。再见', ""])[0] == ['He said "No."', "Then?", "Pi is 3.", "14!", "你好。", "再见"]
    assert values(spark, T.clauses, ["one, two; three：four"])[0] == ["one,", "two;", "three：", "four"]


def test_sentences_are_those_of_the_plain_pattern(spark):
    import re

    rng = random.Random(8)
    pool = "ab é.!?؟。！？।॥,;:،؛，；：、\"'”’)] \n日本🙂\xff\u0100"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(300)]
    plain = lambda p, clean: [[s for s in (clean(m[0]) for m in re.finditer(p, t)) if s] for t in texts]
    assert values(spark, T.sentences, texts) == plain(T.SENTENCE, lambda s: re.sub("[ \t\n\r]+", " ", s).strip(" "))
    assert values(spark, T.clauses, texts) == plain(T.CLAUSE, lambda s: s.strip(" "))


def test_arabic(spark):
    assert values(spark, T.arabic_form, ["الْكِتَاب", "محـــمد", "أحمد", "على"]) == ["الكتاب", "محمد", "احمد", "على"]
    assert values(spark, T.arabic_folded, ["على‏"]) == ["علي"]


def test_small_functions(spark):
    assert values(spark, T.speakable, ["“Hi”…  you—​🙂 there\x07"]) == ['"Hi"... you- there']
    assert values(spark, T.speech_text, ["a b  c \n\n\n\nd "]) == ["a b c\n\nd"]
    assert values(spark, T.file_name, ['a/b:c*?"<d>', "...", ""]) == ["a b c d", "untitled", "untitled"]
    assert values(spark, T.preview, ["x" * 150])[0] == "x" * 140 + "…"
    assert values(spark, T.page_of, ["/a#page-12", "/a"]) == [12, 1]
    assert values(spark, T.author_of, ["/uploads/1.html", "/documents/Jane%20Doe/x.html", "/x"]) == ["Uploaded", "Jane Doe", "Uncategorized"]
    sizes = spark.createDataFrame([(1,), (5 << 20,), (3 << 30,), (25 << 30,)], "n long").select(T.storage_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["1 MB", "5 MB", "3.00 GB", "25.0 GB"]
    ranges = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([("abcdef", [(0, 2), (2, 6)]), ("abc", [(0, 2), (1, 3)]), ("abc", [(0, 9)]), ("abc", [])], f"t string, r {ranges}")
    assert [r[0] for r in df.select(T.valid_ranges(F.col("t"), F.col("r"))).collect()] == [True, False, False, True]
    assert values(spark, T.usable_text, ["four words are here but it is long enough for the test", "short", "�" * 40]) == [True, False, False]


def test_queries_are_parsed():
    q = analysis.parse('alpha "exact  phrase" beta “curly “inner” one”')
    assert q.phrases == ["exact phrase", "curly “inner” one"] and q.unquoted == "alpha beta"
    for bad in ('"open', "x ”"):
        with pytest.raises(analysis.UnbalancedQuotes):
            analysis.parse(bad)
    with pytest.raises(analysis.QueryTooLong):
        analysis.check_limits("x" * 4097)
    with pytest.raises(analysis.QueryTooLong):
        analysis.check_limits("a " * 129)
    assert analysis.terms("(high- lights), “AB-123” - x_y") == ["high-lights", "AB-123", "-", "x_y"]
    assert analysis.aliases("well-being") == [("well", "being"), ("wellbeing",)]
    assert len(analysis.aliases("a-b-c-d-e-f")) == 17
    assert analysis.aliases("AB-123") == [("ab", "123")]
    assert [analysis.broader_minimum(n) for n in (2, 3, 5, 12, 13)] == [None, 2, 3, 6, None]
    assert len(analysis.comparison_terms(analysis.parse("a b a c"))) == 3
    assert analysis.comparison_terms(analysis.parse('a b "c"')) == []


def fts5():
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61 remove_diacritics 1')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    return c


def test_stems_are_those_of_fts5():
    c = fts5()
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    words = "caresses ponies cats feed agreed plastered motoring sing conflated sized hopping falling filing happy sky relational conditional rational digitizer operator hopefulness formalize revival adoption adjustment rate cease controll roll Éclair naïve Straße don't AB-123 x_y generalizations oscillators 日本語 word1".split()
    rng = random.Random(1)
    ends = ["", "s", "es", "ed", "ing", "ly", "ness", "ful", "ational", "ization", "ive", "al", "er", "ies", "e", "ion", "ment", "able"]
    words += ["".join(rng.choice("abcdeilmnorstuv") for _ in range(rng.randrange(2, 6))) + rng.choice(ends) + rng.choice(ends) for _ in range(2000)]
    c.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(words)))
    got = {}
    for term, doc in c.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        got.setdefault(doc, []).append(term)
    assert [(w, stemming.stems(w)) for i, w in enumerate(words) if stemming.stems(w) != got.get(i, [])] == []


def test_scores_are_those_of_fts5(spark):
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE f USING fts5(title, text, tokenize='unicode61 remove_diacritics 0')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 4))), " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    c.executemany("INSERT INTO f(rowid, title, text) VALUES (?, ?, ?)", rows)
    want = dict(c.execute("SELECT rowid, bm25(f, 5.0, 1.0) FROM f WHERE f MATCH 'w1 OR w2'"))
    sections = spark.createDataFrame([(i, a, 0, b) for i, a, b in rows], "doc_id long, title string, ordinal long, text string")
    got = {r.doc_id: r.score for r in bm25.scored(sections, bm25.clauses("w1 w2")).rows.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_english_for_speech():
    say = speech.normalised_english
    assert say("Chapter IV and the book I read") == "Chapter 4 and the book I read"
    assert say("Dr. Smith met Mrs. Jones at St. John on Main St.") == "Doctor Smith met Missus Jones at Saint John on Main Street"
    assert say("at 9:00. Then 9:05 or 10:45 but 2:1") == "at nine o'clock. Then nine oh five or ten forty-five but 2:1"
    assert say("in 1984, not 1984,000 nor x1984") == "in nineteen eighty-four, not 1984,000 nor x1984"
    assert say("$5.50 and $5 million. then ¥3") == "five dollars and fifty cents and 5 million dollars. then 3 yen"
    assert say("the U.S.A. at 3 a.m. etc. And more, etc.") == "the USA at 3 am et cetera. And more, et cetera."
    assert say("one - two; three (four) five... six") == "one, two, three, four, five, six"
    assert say("pi is 3. 14 now") == "pi is 3.14 now"
    assert [speech.year(n) for n in (1000, 1066, 1900, 1905, 2000, 2005, 2026)] == ["one thousand", "ten sixty-six", "nineteen hundred", "nineteen oh-five", "two thousand", "two thousand and five", "twenty twenty-six"]


def test_chunks_hold_the_text_and_its_places():
    text = "First sentence here. Second, with a clause; and more! " * 30
    for profile, (most, _) in speech.PROFILES.items():
        out = speech.chunks([text, "", "Short."], profile=profile)
        assert all(0 < len(c["text"]) <= most for c in out)
        assert "".join(" ".join(c["text"] for c in out).split()) == "".join((text + "Short.").split())
        whole = [speech.evened(text), "", "Short."]
        for c in out:
            if c["start_segment"] == c["end_segment"] is not None:
                assert whole[c["start_segment"]][c["start_offset"] : c["end_offset"]].split() == c["text"].split()
    merged = speech.chunks(["Tiny.", "Small.", "Head", "x"], ["paragraph", "paragraph", "heading", "listItem"])
    assert [c["text"] for c in merged] == ["Tiny. Small.", "Head", "x"]
    assert [len(c["text"]) for c in speech.chunks(["x" * 2000])] == [900, 900, 200]


def test_hash_and_natural_order():
    assert speech.fnv1a(b"") == "cbf29ce484222325" and speech.fnv1a(b"a") == "af63dc4c8601ec8c"
    names = ["file10", "File2", "éclair", "eclipse", "file02b"]
    assert sorted(names, key=speech.natural) == ["éclair", "eclipse", "File2", "file02b", "file10"]
