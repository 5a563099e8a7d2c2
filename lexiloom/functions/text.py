"""Text functions as column expressions (no Python on the executors)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Characters that stand for quotes and hyphens, and what they become. Fixed values.
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}
DASHES = "‐‑‒–—―"
#: Terms are runs of letters and digits.
TERM = r"[\p{L}\p{N}]+"


def canonical(t: Column) -> Column:
    """Curly quotes and the Unicode hyphens and dashes as ASCII."""
    return F.translate(t, "".join(QUOTES) + DASHES, "".join(QUOTES.values()) + "-" * len(DASHES))


def collapsed(t: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def joined_hyphens(t: Column) -> Column:
    """`high- lights` as `high-lights`: white space after a hyphen between letters goes."""
    return F.regexp_replace(t, r"(?<=\p{IsAlphabetic})-\s+(?=\p{IsAlphabetic})", "-")


def without_hyphens(t: Column) -> Column:
    """Hyphens between letters removed."""
    return F.regexp_replace(t, r"(?<=\p{IsAlphabetic})-(?=\p{IsAlphabetic})", "")


def normal_form(t: Column) -> Column:
    """The form in which exact phrases are compared."""
    return F.lower(collapsed(without_hyphens(joined_hyphens(canonical(t)))))


def terms(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(TERM), F.lit(0))


def count_in(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word)).cast("long")


def phrase_count(t: Column, phrase: str | Column) -> Column:
    """Occurrences that don't overlap."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    return ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("long")


def adjacent(words: Column, phrase: list[str]) -> Column:
    """Whether the words hold the phrase's words one after the other."""
    n = len(phrase)
    return F.exists(
        F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))),
        lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(phrase)]),
    )


def arabic_form(t: Column) -> Column:
    """The forgiving search form: vowel signs and stretching dropped, alef variants folded."""
    return F.translate(F.regexp_replace(t, "[ـً-ٰٟ]", ""), "آأإ", "ااا")


def arabic_folded(t: Column) -> Column:
    """The wider folding for locating text: also wasla, yeh and kaf variants; marks of direction and width dropped."""
    bare = F.regexp_replace(t, "[ـً-ٰٟ​-‏‪-‮⁠﻿]", "")
    return F.translate(bare, "آأإٱىیک", "ااااييك")


def escaped(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def unescaped(t: Column) -> Column:
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def safe_excerpt(t: Column) -> Column:
    """Escaped, with <mark> restored."""
    t = escaped(t)
    return F.replace(F.replace(t, F.lit("&lt;mark&gt;"), F.lit("<mark>")), F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


#: Elements whose tags part words.
PARTING = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"


def without_tags(t: Column) -> Column:
    """Scripts, styles and comments dropped, block tags as spaces, other tags removed, white space collapsed."""
    t = F.regexp_replace(t, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?i)</?({PARTING})([ /][^>]*)?>", " ")
    t = F.regexp_replace(t, r"<[a-zA-Z/!][^>]*>", "")
    return F.trim(F.regexp_replace(unescaped(t), r"[ \t\n\r\f]+", " "))


def html_title(t: Column, fallback: str = "Imported HTML Document") -> Column:
    title = F.trim(F.regexp_replace(unescaped(F.regexp_extract(t, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"[ \t\n\r\f]+", " "))
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(fallback))


def first_mark(t: Column) -> Column:
    return F.regexp_extract(t, "(?s)<mark>(.*?)</mark>", 1)


def without_marks(t: Column) -> Column:
    return F.regexp_replace(t, "</?mark>", "")


#: Sentence and clause ends, and what may close a quotation after them.
SENTENCE = r"""[^.!?؟。！？।॥]+[.!?؟。！？।॥]*["'”’)\]]*|[.!?؟。！？।॥]+"""
CLAUSE = r"[^,;:،؛，；：、]+[,;:،؛，；：、]*|[,;:،؛，；：、]+"


#: The same for Java, whose classes are slow beyond Latin-1: runs of Latin-1 characters are matched by a class of their own.
_FAST_SENTENCE = r"""(?:[^.!?\x{100}-\x{10FFFF}]++|[^\x00-\x{FF}؟。！？।॥])++[.!?؟。！？।॥]*+["'”’)\]]*+|[.!?؟。！？।॥]++"""
_FAST_CLAUSE = r"(?:[^,;:\x{100}-\x{10FFFF}]++|[^\x00-\x{FF}،؛，；：、])++[,;:،؛，；：、]*+|[,;:،؛，；：、]++"


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(_FAST_SENTENCE), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"[ \t\n\r]+", " "))), lambda s: s != "")


def clauses(t: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(_FAST_CLAUSE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def speech_text(t: Column) -> Column:
    """No-break spaces, trailing blanks, three or more newlines and runs of blanks evened out."""
    t = F.replace(t, F.lit(" "), F.lit(" "))
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(t, r"[ \t]{2,}", " "))


def speakable(t: Column) -> Column:
    """What a voice can read: plain quotes, dashes and spaces; no zero-width, control or non-BMP characters."""
    t = F.translate(t, "‘’‚‛“”„‟‐‑‒–—―     　", "''''" + '""""' + "------" + "      ")
    t = F.replace(t, F.lit("…"), F.lit("..."))
    t = F.regexp_replace(t, r"[\x{10000}-\x{10FFFF}]|[​-‏⁠﻿]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


def repaired_decimals(t: Column) -> Column:
    return F.regexp_replace(t, r"([0-9])\. ([0-9])", "$1.$2")


def preview(t: Column, n: int = 140) -> Column:
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("…"))).otherwise(t)


def file_name(t: Column, fallback: str = "untitled", n: int = 80) -> Column:
    """A name for exported files."""
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r'[\x00-\x1f<>:"/\\|?*]+', " "), r"\s+", " "))
    t = F.regexp_replace(t, r"^[. ]+|[. ]+$", "")
    return F.coalesce(F.nullif(F.substring(t, 1, n), F.lit("")), F.lit(fallback))


def storage_size(n: Column) -> Column:
    """Bytes for people: GB with one or two digits, MB rounded up and 1 at least."""
    gb = n / F.lit(1024.0**3)
    return (
        F.when(gb >= 10, F.format_string("%.1f GB", gb)).when(gb >= 1, F.format_string("%.2f GB", gb))
        .otherwise(F.format_string("%d MB", F.greatest(F.lit(1), F.ceil(n / F.lit(1024.0**2))).cast("long")))
    )


def chars(t: Column, cls: str) -> Column:
    """Characters of a class."""
    return F.length(F.regexp_replace(t, f"[^{cls}]", "")).cast("long")


def usable_text(t: Column) -> Column:
    """Recognised text worth keeping: 32 characters besides spaces, 4 words, half of them letters or digits, a tenth unreadable at most."""
    solid = F.length(F.regexp_replace(t, r"[ \t\n\r]", ""))
    words = F.size(F.filter(F.split(t, r"[ \t\n\r]+"), lambda w: w != ""))
    return (solid >= 32) & (words >= 4) & (chars(t, r"\p{L}\p{N}") * 2 >= solid) & (chars(t, "�") * 10 <= solid)


def script(arabic: Column, han: Column, kana: Column, latin: Column) -> Column:
    """The dominant script's language, from counts."""
    return F.when((han > latin) & (han > arabic) & (han >= 20) & (kana < 5), "zh").when((arabic > latin) & (arabic >= 20), "ar")


def valid_ranges(t: Column, ranges: Column) -> Column:
    """Whether ranges (start, end) are ordered, apart, not empty and within the text."""
    ok = F.forall(ranges, lambda r: (r["start"] >= 0) & (r["end"] > r["start"]) & (r["end"] <= F.length(t)))
    n = F.size(ranges)
    apart = F.when(n < 2, True).otherwise(F.forall(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.get(ranges, i)["end"] <= F.get(ranges, i + 1)["start"]))
    return ok & apart


def author_of(url: Column, uploaded: str = "Uploaded") -> Column:
    """The first folder under /documents/, a label for uploads, else Uncategorized."""
    folder = F.regexp_extract(url, r"/documents/([^/]+)/", 1)
    return F.when(url.startswith("/uploads/"), uploaded).otherwise(F.coalesce(F.nullif(F.try_url_decode(folder), F.lit("")), F.lit("Uncategorized")))


def page_of(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"#page-([0-9]{1,9})", 1), F.lit("")).cast("int"), F.lit(1))
