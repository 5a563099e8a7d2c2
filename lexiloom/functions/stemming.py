"""The index's tokenizer: words folded to lower case without accents, stemmed by Porter's rules (Porter, 1980)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_WORD = re.compile(r"[^\W_]+")


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    return c != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(1 << 17)
def stem(w: str) -> str:
    """The stem of a word; one character is one byte."""
    if not 3 <= len(w) <= 64:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        e = _longest(w, ("ed", "ing"))
        if e and _vowel(w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        e = _longest(w, rules)
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + rules[e]
    e = _longest(w, _STEP4)
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _double(w) and w.endswith("l") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def folded(t: str) -> str:
    """Lower case; accents dropped from Latin letters."""
    out = []
    for c in t.casefold() if t.isascii() else "".join(x.lower() for x in t):
        if c < "À":
            out.append(c)
            continue
        d = unicodedata.normalize("NFD", c)
        out.append(d[0] if len(d) == 2 and "a" <= d[0] <= "z" else c)
    return "".join(c for c in out if unicodedata.category(c) != "Mn" or c >= "Ͱ")


def stems(t: str) -> list[str]:
    return [stem(w) if w.isascii() else stem(w.encode().decode("latin-1")).encode("latin-1").decode() for w in _WORD.findall(folded(t))]


@F.pandas_udf(ArrayType(StringType()))
def stemmed(t: pd.Series) -> pd.Series:
    return t.map(lambda x: [] if x is None else stems(x))
