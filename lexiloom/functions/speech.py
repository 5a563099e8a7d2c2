"""Text for narration: chunks, English normalisation, identities. Vectorised functions where column expressions don't reach."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .text import CLAUSE, SENTENCE

#: Longest and shortest chunks by profile. Fixed values.
PROFILES = {"playback": (900, 120), "save": (360, 80), "short": (80, 50)}

_SENTENCE, _CLAUSE = re.compile(SENTENCE), re.compile(CLAUSE)


def evened(t: str) -> str:
    """No-break spaces, trailing blanks, runs of blanks and of newlines evened out."""
    t = re.sub(r"[ \t]+\n", "\n", (t or "").replace(" ", " "))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", t)).strip()


def _pack(parts: list[str], most: int) -> list[str]:
    """Neighbours joined by a space while they fit."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + 1 + len(p) <= most:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def _wrapped(t: str, most: int) -> list[str]:
    out = []
    while len(t) > most:
        at = t.rfind(" ", 0, most + 1)
        at = at if at > 0 else most
        out.append(t[:at].strip())
        t = t[at:].strip()
    return [*out, t] if t else out


def _found(pattern: re.Pattern, t: str) -> list[str]:
    return [s for s in (evened(m[0]) for m in pattern.finditer(t)) if s]


def segment_chunks(t: str, most: int) -> list[str]:
    """A segment's chunks: whole sentences packed; long ones cut at clauses, then at words."""
    out: list[str] = []
    run: list[str] = []
    for s in _found(_SENTENCE, evened(t)):
        if len(s) <= most:
            run.append(s)
            continue
        out += _pack(run, most)
        run = []
        out += _pack([p for c in _found(_CLAUSE, s) for p in _wrapped(c, most)], most)
    return out + _pack(run, most)


def _mergeable(a: str, b: str) -> bool:
    if "heading" in (a, b):
        return False
    return a == b if "listItem" in (a, b) else True


def located(paragraph: str, chunk: str, start: int) -> tuple[int, int] | None:
    """Where the chunk's words stand, from start on: the first one's begin and the last one's end."""
    first = None
    for word in chunk.split():
        at = paragraph.find(word, start)
        if at >= 0:
            first, start = at if first is None else first, at + len(word)
    return None if first is None else (first, start)


def chunks(texts: list[str], kinds: list[str] | None = None, profile: str = "playback") -> list[dict]:
    """text, start_segment, start_offset, end_segment, end_offset of a document's chunks; short neighbours are joined."""
    most, least = PROFILES[profile]
    out: list[dict] = []
    for k, t in enumerate(texts):
        kind, whole, cursor = kinds[k] if kinds else "paragraph", evened(t), 0
        for c in segment_chunks(t, most):
            span = located(whole, c, cursor)
            cursor = span[1] if span else cursor
            new = {"text": c, "kind": kind, "start_segment": k if span else None, "start_offset": span and span[0], "end_segment": k if span else None, "end_offset": span and span[1]}
            last = out[-1] if out else None
            if last and len(last["text"]) < least and len(last["text"]) + 1 + len(c) <= most and _mergeable(last["kind"], kind):
                both = last["end_segment"] is not None and span is not None
                last["text"] += " " + c
                for f in ("end_segment", "end_offset"):
                    last[f] = new[f] if both else None
                if not both:
                    last["start_segment"] = last["start_offset"] = None
            else:
                out.append(new)
    return out


_FIELDS = ("text", "start_segment", "start_offset", "end_segment", "end_offset")
_CHUNK = ArrayType(StructType([StructField("text", StringType()), *[StructField(f, IntegerType()) for f in _FIELDS[1:]]]))


@F.pandas_udf(_CHUNK)
def speech_chunks(segments: pd.Series) -> pd.Series:
    """Chunks of arrays of segments."""
    return segments.map(lambda s: [{f: c[f] for f in _FIELDS} for c in chunks([x or "" for x in (s if s is not None else [])])])


# numbers in words

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = "thousand million billion trillion quadrillion quintillion".split()


def cardinal(n: int) -> str:
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10 - 2] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{_ONES[n // 100]} hundred" + (f" and {cardinal(n % 100)}" if n % 100 else "")
    for k in reversed(range(len(_SCALES))):
        unit = 1000 ** (k + 1)
        if n >= unit:
            rest = n % unit
            joint = " and " if 0 < rest < 100 else " " if rest else ""
            return f"{cardinal(n // unit)} {_SCALES[k]}{joint}{cardinal(rest) if rest else ''}"
    return str(n)


def year(n: int) -> str:
    """A year between 1000 and 2099 as it's spoken."""
    high, low = divmod(n, 100)
    if n % 1000 == 0:
        return f"{_ONES[n // 1000]} thousand"
    if high == 20 and low < 10:
        return f"two thousand and {_ONES[low]}"
    if not low:
        return f"{cardinal(high)} hundred"
    return f"{cardinal(high)} {'oh-' + _ONES[low] if low < 10 else cardinal(low)}"


# English normalisation. Fixed values.

SECTION_WORDS = "Chapter Part Section Book Act Volume Appendix Article Canto Scene".split()
SPOKEN = {
    "Mr.": "Mister", "Mrs.": "Missus", "Ms.": "Miss", "Dr.": "Doctor", "Drs.": "Doctors", "Prof.": "Professor", "Jr.": "Junior", "Sr.": "Senior", "Mt.": "Mount", "Ave.": "Avenue",
    "vs.": "versus", "e.g.": "for example", "i.e.": "that is", "mph": "miles per hour", "km/h": "kilometers per hour", "kmh": "kilometers per hour", "kph": "kilometers per hour",
}
UNITS = {"$": ("dollar", "dollars"), "€": ("euro", "euros"), "£": ("pound", "pounds"), "¥": ("yen", "yen"), "¢": ("cent", "cents")}
PARTS = {"$": ("cent", "cents"), "€": ("cent", "cents"), "£": ("penny", "pence")}
MAGNITUDES = "hundred|thousand|million|billion|trillion"

_OPEN, _CLOSE = r"(?:(?<=^)|(?<= ))([(\[{\"']*)", r"([,;:)\]}\"']*)(?= |$)"
_ROMAN = re.compile(rf"((?:^| )[^A-Za-z0-9 ]*(?i:{'|'.join(SECTION_WORDS)})[^A-Za-z0-9 ]* [^A-Za-z0-9 ]*)([IVXLCDM]+)(?=[^A-Za-z0-9 ]*(?: |$))")
_SHORT = re.compile(_OPEN + "(" + "|".join(re.escape(k) for k in SPOKEN) + ")" + _CLOSE)
_ETC = re.compile(_OPEN + r"etc\." + r"([,;:)\]}\"']*)(?= ([(\[{\"']*)([^ ])| |$)")
_SAINT = re.compile(_OPEN + r"St\." + r"([,;:)\]}\"']*)(?=( [(\[{\"']*[A-Z])?)(?= |$)")
_INITIALS = re.compile(_OPEN + r"((?:[A-Za-z]\.){2,}[A-Za-z]?)" + _CLOSE)
_CLOCK = re.compile(_OPEN + r"([01]?[0-9]|2[0-3]):([0-5][0-9])([.!?]*)" + _CLOSE)
_YEAR = re.compile(r"(?:(?<=^)|(?<=[\s(\[{\"']))(1[0-9]{3}|20[0-9]{2})(?=$|[\s)\]}\"';:!?]|[.,](?![0-9]))")
_MONEY = re.compile(_OPEN + r"([$€£¥¢])([0-9][0-9,.]*?)(?=[.,]*(?:[;:)\]}\"',.]* |[;:)\]}\"',.]*$))" + rf"(?:( (?i:{MAGNITUDES}))(?=[.!?,;:)\]}}\"']*(?: |$)))?")
_VALUE = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(s: str) -> int:
    total, highest = 0, 0
    for c in reversed(s):
        v = _VALUE[c]
        total += v if v >= highest else -v
        highest = max(highest, v)
    return total


def _numeral(m: re.Match) -> str:
    word = re.search(r"[A-Za-z]+", m[1])[0]
    n = roman(m[2])
    return m[1] + str(n) if word[0].isupper() and n > 0 else m[0]


def _clock(m: re.Match) -> str:
    hour, minute = int(m[2]), int(m[3])
    said = "o'clock" if not minute else f"oh {cardinal(minute)}" if minute < 10 else cardinal(minute)
    return f"{m[1]}{cardinal(hour)} {said}{m[4]}{m[5]}"


def _money(m: re.Match) -> str:
    lead, sign, amount, magnitude = m[1], m[2], m[3], m[4]
    one, many = UNITS[sign]
    if magnitude:
        return f"{lead}{amount}{magnitude} {many}"
    if sign in PARTS and re.fullmatch(r"[0-9][0-9,]*(\.[0-9]{1,2})?", amount):
        whole, _, rest = amount.replace(",", "").partition(".")
        part = int(rest.ljust(2, "0")) if rest else 0
        said = f"{cardinal(int(whole))} {one if int(whole) == 1 else many}"
        return lead + said + (f" and {cardinal(part)} {PARTS[sign][part != 1]}" if part else "")
    return f"{lead}{amount} {one if amount in ('1', '1.0', '1.00') else many}"


def _paused(t: str) -> str:
    """Punctuation that's read too fast, as commas."""
    t = re.sub(r" *\.{2,}", ",", t)
    t = re.sub(r" *(?:(?<![0-9])[;:]|[;:](?![0-9]))", ",", t)
    t = re.sub(r" +- ", ", ", t)
    t = re.sub(r" *[(\[]", ", ", t)
    t = re.sub(r" *[)\]]", ",", t)
    t = re.sub(r",(?:\s*,)+", ",", t)
    return re.sub(r"^[, ]+", "", t)


def normalised_english(t: str) -> str:
    """Numerals, abbreviations, clock times, split decimals, years, money and pauses, in this order."""
    t = _ROMAN.sub(_numeral, t)
    t = _SHORT.sub(lambda m: m[1] + SPOKEN[m[2]] + m[3], t)
    t = _ETC.sub(lambda m: f"{m[1]}et cetera{'.' if not m[2] and (m[4] is None or 'A' <= m[4] <= 'Z') else ''}{m[2]}", t)
    t = _SAINT.sub(lambda m: f"{m[1]}{'Saint' if m[3] else 'Street'}{m[2]}", t)
    t = _INITIALS.sub(lambda m: m[1] + m[2].replace(".", "") + m[3], t)
    t = _CLOCK.sub(_clock, t)
    t = re.sub(r"([0-9])\. (?=[0-9])", r"\1.", t)
    t = _YEAR.sub(lambda m: year(int(m[1])), t)
    return _paused(_MONEY.sub(_money, t))


@F.pandas_udf(StringType())
def speech_english(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else normalised_english(x))


def fnv1a(data: bytes) -> str:
    """FNV-1a of 64 bits, in hex."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@F.pandas_udf(StringType())
def text_hash(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else fnv1a(x.encode()))


@F.pandas_udf(StringType())
def nfc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def natural(t: str) -> str:
    """A key by which numbers in names sort by value, and letters without case or accents."""
    bare = "".join(c for c in unicodedata.normalize("NFD", t.casefold()) if not unicodedata.combining(c))
    return re.sub(r"[0-9]+", lambda m: f"{len(m[0].lstrip('0')):04d}{m[0].lstrip('0')}", bare)


@F.pandas_udf(StringType())
def natural_key(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else natural(x))
