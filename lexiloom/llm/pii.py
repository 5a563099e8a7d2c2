"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the matches of the four base patterns (email, ip, card, phone) and of looser ones (masked addresses, local
phone numbers, social security and bank account numbers, secrets by their name or format, names). Every candidate is described by a few small
numbers: its pattern, whether it passes the base rules, length, digits, separators, neighbours, and what the labelers
look at: a checksum, gazetteers (domains, card issuers, country codes, first names), words of the context. Labelers vote for or against
a candidate, or abstain. The table of descriptions with their counts over all documents (bounded by DESCRIPTIONS) is
all that reaches the driver. There, expectation-maximisation estimates the labelers' reliabilities and a label for each
description, and a logistic classifier over one-hot descriptions per pattern is fitted to those labels, each weighing as
often as it occurs. The classifier goes back as a map of coefficients and is applied by the same plan.

Positions count code points. They come from the lengths of what lies between matches: split() and regexp_extract_all()
with one pattern see the same matches. Patterns use possessive loops, so that long runs neither overflow the stack nor
take quadratic time: a match can only begin where a run of its first class begins, or where the last match ended.

Defined results: null and empty texts have no spans; base spans always stay; an added span goes if it touches a base span
or an added one that begins earlier; repeated rows repeat and count twice in the fit; an empty table gives an empty result and no fit;
very long texts are searched whole; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, written

_MAIL = "A-Za-z0-9._%+-"

#: Kind of the spans, pattern. The first four are the base patterns; the order is the order of spans.
EMAIL = rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = [
    ("email", EMAIL),
    ("ip", IP),
    ("card", CARD),
    ("phone", PHONE),
    ("email", rf"(?<![{_MAIL}])[A-Za-z][{_MAIL}]{{0,63}}+\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{{dot\}}|\.)\x20?[A-Za-z]{{2,24}}+)+"),
    ("phone", r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9A-Za-z]|[.-][0-9])"),
    ("ssn", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])(?:password|passwd|pwd|passphrase|secret|secret_?key|api_?key|access_?key|access_?token|auth_?token|token|PASSWORD|SECRET|SECRET_KEY|API_?KEY|ACCESS_KEY|TOKEN)\x20?[=:]\x20?[^\x20\x09-\x0D,;]{4,128}+"),
    ("secret", r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+|glpat-[A-Za-z0-9_-]{20,64}+|xox[abeoprs]-[A-Za-z0-9-]{10,250}+|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{16,128}+|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8,4096}+\.eyJ[A-Za-z0-9_-]{8,4096}+\.[A-Za-z0-9_-]{8,4096}+|-----BEGIN\x20(?:[A-Z]{2,10}\x20)?PRIVATE\x20KEY-----)(?![A-Za-z0-9_])"),
    ("name", r"(?<![\p{L}\p{N}])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20\p{Lu}\p{Ll}{1,30}+(?:\x20\p{Lu}\p{Ll}{1,30}+)?|(?:FIRST)\x20\p{Lu}\p{Ll}{1,30}+)(?![\p{L}\p{N}])"),
]
BASE = ("email", "ip", "card", "phone")
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret", "name")

#: What a text with a match of the pattern must contain, by pattern: others aren't searched.
NEEDS = {0: ["@"], 3: ["+"], 4: ["(at)", "[at]", "{at}"], 6: ["-"], 8: ["=", ":"], 9: ["AKIA", "ASIA", "gh", "glpat-", "xox", "AIza", "k_live_", "npm_", "eyJ", "PRIVATE"]}

#: Gazetteers.
FIRST_NAMES = "James John Robert Michael William David Richard Joseph Thomas Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Hans Peter Wolfgang Klaus Ursula Monika Petra Sabine Jean Pierre Michel Marie Nathalie Isabelle Antonio Manuel Francisco Carmen Josefa Dolores".split()
TOP_DOMAINS = "com org net edu gov mil int info biz io co me de fr es it nl be at ch uk us ca au eu pl se no dk fi pt br mx ar jp cn in ru".split()
COUNTRY_CODES = r"^\+(1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[01]|5[09][0-9]|6[789][0-9]|8[05-8][0-9]|9[679][0-9])"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[4-9]|6[0245])"
#: Words of the context before a span that speak for it, by kind, and before any that speak against it.
CONTEXT = {
    "email": "e-?mail|contact|write|mailto|reach",
    "ip": r"\bip\b|address|host|server|login",
    "card": "card|visa|master|amex|credit|debit|pay",
    "phone": "phone|tel|call|mobile|fax|sms|whatsapp",
    "ssn": r"ssn|social|security|\bsin\b",
    "iban": r"iban|bank|account|konto|transfer",
    "secret": r"pass|log-?in|user|config|export|\benv|auth|credential|secret|key|connect",
    "name": "name|sign|regards|dear|contact|by",
}
AGAINST = r"version|release|build|\bv$|isbn|page|section|chapter|serial|part no|order no|invoice|sku|figure"

#: Most different descriptions that can occur: the product of the sizes of their parts.
DESCRIPTIONS = len(PATTERNS) * 2 * 5 * 5 * 4 * 3 * 3 * 3 * 2 * 2 * 2
PARTS = ("base", "len", "digits", "seps", "before", "after", "check", "gaz", "ctx", "against")
BLOCK = 256


def _pattern(k: int) -> str:
    return PATTERNS[k][1].replace("FIRST", "|".join(FIRST_NAMES))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    worth = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(i % 2 == 0, F.substring(digits, n - i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, n - i, F.lit(1)).cast("int") + 1)
        ),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


def _base_ok(k: int, value: Column, digits: Column) -> Column:
    kind = PATTERNS[k][0]
    if k >= 4:
        return F.lit(False)
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _bucket(x: Column, *bounds: int) -> Column:
    out = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        out = F.when(x <= bounds[i], i).otherwise(out)
    return out


def _side(c: Column) -> Column:
    """0 none, 1 white space or punctuation, 2 other."""
    return F.when(c == "", 0).when(c.rlike(r"^[\x20\x09-\x0D.,;:!?()'\"-]$"), 1).otherwise(2)


def _check(k: int, value: Column, digits: Column) -> Column:
    """0 against, 1 for, 2 no check."""
    kind = PATTERNS[k][0]
    if kind == "card":
        return F.when(F.length(digits).between(12, 20), F.when(_luhn(digits), 1).otherwise(0)).otherwise(0)
    if kind == "ip":
        return F.when(_octets(value), 1).otherwise(0)
    if kind == "phone":
        return F.when(F.length(digits).between(9, 15), 1).otherwise(0)
    if kind == "ssn":
        return F.when(value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), 1).otherwise(0)
    if kind == "secret":  # letters and digits mixed, as generated ones have them; words don't speak for it
        part = F.regexp_replace(value, r"^[A-Za-z_]+\x20?[=:]\x20?", "")
        return F.when(part.rlike("[0-9]") & part.rlike("[A-Za-z]") & (F.length(part) >= 8), 1).when(part.rlike("PRIVATE|[0-9]|[^A-Za-z0-9]"), 2).otherwise(0)
    return F.lit(2)


def _gazetteer(k: int, value: Column) -> Column:
    """0 not listed, 1 listed."""
    kind = PATTERNS[k][0]
    if kind == "email":
        return F.when(F.lower(value).rlike(r"[.)\]}]\x20?(?:" + "|".join(TOP_DOMAINS) + ")$"), 1).otherwise(0)
    if kind == "card":
        return F.when(value.rlike(ISSUERS), 1).otherwise(0)
    if kind == "phone":
        return F.when(value.rlike(COUNTRY_CODES if k < 4 else r"^[(0]"), 1).otherwise(0)
    if kind == "ip":
        return F.when(value.rlike(r"^(?:0|127|224|239|255)\."), 0).otherwise(1)
    if kind == "name":
        return F.when(value.rlike(r"(?:^|\x20)(?:" + "|".join(FIRST_NAMES) + r")(?:\x20|$)"), 1).otherwise(0)
    return F.lit(1)


def _spans(k: int, m: Column, g: Column, lens: Column, blocks: Column) -> Column:
    """The matches of a pattern with positions and descriptions. lens: of each gap with the match after it."""
    kind = PATTERNS[k][0]
    add = lambda a, x: a + x

    def one(i: Column) -> Column:
        value, gap, rest = F.get(m, i), F.get(g, i), F.get(g, i + 1)
        b = F.floor(i / BLOCK).cast("int")
        before = F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0).cast("long"), add) + F.aggregate(F.slice(lens, b * BLOCK + 1, i - b * BLOCK), F.lit(0).cast("long"), add)
        start = before + F.length(gap)
        digits = F.regexp_replace(value, "[^0-9]", "")
        context = F.lower(F.right(gap, F.lit(40)))
        return F.struct(
            F.lit(k).alias("k"),
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            F.when(_base_ok(k, value, digits), 1).otherwise(0).alias("base"),
            _bucket(F.length(value), 8, 12, 16, 24).alias("len"),
            _bucket(F.length(digits), 0, 8, 12, 16).alias("digits"),
            _bucket(F.length(F.regexp_replace(value, r"[\p{L}\p{N}]", "")), 0, 1, 3).alias("seps"),
            _side(F.right(gap, F.lit(1))).alias("before"),
            _side(F.left(rest, F.lit(1))).alias("after"),
            _check(k, value, digits).alias("check"),
            _gazetteer(k, value).alias("gaz"),
            F.when(context.rlike(CONTEXT[kind]), 1).otherwise(0).alias("ctx"),
            F.when(context.rlike(AGAINST), 1).otherwise(0).alias("against"),
        )

    out = F.transform(F.sequence(F.lit(0), F.size(m) - 1), one)
    if kind == "card":  # any number of two digits matches
        out = F.filter(out, lambda s: (s["base"] == 1) | (s["digits"] >= 3))
    return out


_TYPE = "array<struct<k:int,start:bigint,end:bigint," + ",".join(f"{p}:int" for p in PARTS) + ">>"


def _lens(k: int) -> Column:
    """The lengths of each gap with the match after it."""
    return F.transform(F.sequence(F.lit(0), F.size(f"m{k}") - 1), lambda i: (F.length(F.get(f"g{k}", i)) + F.length(F.get(f"m{k}", i))).cast("long"))


def _blocks(k: int) -> Column:
    """The lengths' sums by BLOCK."""
    add = lambda a, x: a + x
    last = F.floor((F.size(f"m{k}") - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(F.col(f"l{k}"), b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("long"), add))


def _of_kind(column: str, k: int) -> Column:
    return F.filter(column, lambda s: s["k"] == k)


def _matches(k: int) -> Column:
    every = F.regexp_extract_all("t", F.lit(_pattern(k)), F.lit(0))
    if k not in NEEDS:
        return every
    some = F.lit(False)
    for part in NEEDS[k]:
        some = some | F.contains(F.col("t"), F.lit(part))
    return F.when(some, every).otherwise(F.array().cast("array<string>"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and found: every candidate of each document, by pattern and start."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    n = range(len(PATTERNS))
    rows = rows.select("doc_id", "t", *[_matches(k).alias(f"m{k}") for k in n])
    some = lambda k: F.size(f"m{k}") > 0
    rows = rows.select("doc_id", *[f"m{k}" for k in n], *[F.when(some(k), F.split("t", _pattern(k), -1)).alias(f"g{k}") for k in n])
    rows = rows.select("doc_id", *[f"m{k}" for k in n], *[f"g{k}" for k in n], *[F.when(some(k), _lens(k)).alias(f"l{k}") for k in n])
    rows = rows.select("*", *[F.when(some(k), _blocks(k)).alias(f"b{k}") for k in n])
    none = F.array().cast(_TYPE)
    found = [F.when(some(k), _spans(k, F.col(f"m{k}"), F.col(f"g{k}"), F.col(f"l{k}"), F.col(f"b{k}")).cast(_TYPE)).otherwise(none) for k in n]
    return rows.select("doc_id", F.concat(*found).alias("found"))


def votes(d: dict) -> tuple[int, ...]:
    """What the labelers say of a description: 1 for, -1 against, 0 nothing."""
    base_kind = d["k"] < 4
    return (
        1 if d["base"] else -1 if base_kind else 0,  # regex
        (-1, 1, 0)[d["check"]],  # checksum
        1 if d["gaz"] else -1,  # gazetteer
        1 if d["ctx"] else 0,  # context
        -1 if d["against"] else 0,  # context against
        1 if d["before"] < 2 and d["after"] < 2 else -1,  # stands alone
    )


def reliabilities(rows: list[dict], rounds: int = 40) -> tuple[list[float], list[tuple[float, float]]]:
    """EM over descriptions with counts: a label between 0 and 1 for each, and each labeler's (sensitivity, specificity)."""
    said = [votes(r) for r in rows]
    label = [min(0.95, max(0.05, 0.5 + 0.5 * sum(v) / max(1, sum(map(abs, v))))) for v in said]
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        prior: dict[int, list[float]] = {}
        for r, q in zip(rows, label, strict=True):
            p = prior.setdefault(r["k"], [1.0, 2.0])
            p[0] += q * r["n"]
            p[1] += r["n"]
        rates = []
        for j in range(len(said[0]) if said else 0):
            hit, yes, miss, no = 4.0, 5.0, 4.0, 5.0  # labelers are better than chance to begin with
            for v, r, q in zip(said, rows, label, strict=True):
                if v[j]:
                    yes += q * r["n"]
                    no += (1 - q) * r["n"]
                    hit += q * r["n"] * (v[j] > 0)
                    miss += (1 - q) * r["n"] * (v[j] < 0)
            rates.append((min(0.99, max(0.05, hit / yes)), min(0.99, max(0.05, miss / no))))
        for i, (v, r) in enumerate(zip(said, rows, strict=True)):
            p = prior[r["k"]][0] / prior[r["k"]][1]
            odds = math.log(p / (1 - p))
            for x, (a, b) in zip(v, rates, strict=True):
                odds += math.log(a / (1 - b)) if x > 0 else math.log((1 - a) / b) if x < 0 else 0
            label[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return label, rates


def _keys(d: dict) -> list[str]:
    return [f"{d['k']}", *[f"{d['k']}|{p}|{d[p]}" for p in PARTS]]


def classifier(rows: list[dict], rounds: int = 60) -> dict[str, float]:
    """Coefficients of one-hot descriptions, fitted to the labels of EM."""
    label, _ = reliabilities(rows)
    w: dict[str, float] = {}
    square: dict[str, float] = {}
    total = sum(r["n"] for r in rows) or 1
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for r, q in zip(rows, label, strict=True):
            keys = _keys(r)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.get(k, 0.0) for k in keys)))))
            for k in keys:
                grad[k] = grad.get(k, 0.0) + (p - q) * r["n"] / total
        for k, g in grad.items():
            g += 1e-5 * w.get(k, 0.0)
            square[k] = square.get(k, 0.0) + g * g
            w[k] = w.get(k, 0.0) - 0.5 * g / math.sqrt(square[k] + 1e-18)
    return w


def fitted(found: DataFrame) -> dict[str, float]:
    """The classifier of a table of candidates."""
    rows = found.select(F.explode("found").alias("s")).select("s.*").groupBy("k", *PARTS).agg(F.count("*").alias("n")).orderBy("k", *PARTS).collect()  # DESCRIPTIONS at most
    return classifier([r.asDict() for r in rows])


def _told(spans: Column) -> Column:
    """kind:start:end of spans, joined."""
    kinds = F.array(*[F.lit(p[0]) for p in PATTERNS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(found: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """doc_id, base and every (both arrays of candidates): base ones, and all that stay, by kind and start."""
    weights = F.create_map(*[x for k, v in sorted(coefficients.items()) for x in (F.lit(k), F.lit(float(v)))]) if coefficients else F.create_map(F.lit(""), F.lit(0.0))

    def margin(s: Column) -> Column:
        k = s["k"].cast("string")
        keys = [k, *[F.concat(k, F.lit(f"|{p}|"), s[p].cast("string")) for p in PARTS]]
        return sum((F.coalesce(F.element_at(weights, x), F.lit(0.0)) for x in keys[1:]), F.coalesce(F.element_at(weights, keys[0]), F.lit(0.0)))

    flat = lambda column: F.array_sort(F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    rows = found.select("doc_id", flat(F.filter("found", lambda s: s["base"] == 1)).alias("base"), flat(F.filter("found", lambda s: (s["base"] == 0) & (margin(s) >= 0))).alias("more"))
    rows = rows.withColumn("blocks", _reach("base"))
    rows = rows.withColumn("more", _held("blocks", F.filter("more", lambda a: ~_touched("base", "blocks", a))))
    rows = rows.withColumn("blocks", _reach("more"))
    rows = rows.withColumn("more", _held("blocks", F.filter("more", lambda a: ~_touched("more", "blocks", a, earlier=True))))
    kinds = F.array(*[F.lit(KINDS.index(p[0])) for p in PATTERNS])
    rank = lambda s: F.struct(F.get(kinds, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))
    ordered = lambda column: F.array_sort(F.transform(column, rank))
    return rows.select("doc_id", ordered("base").alias("base"), F.array_sort(F.concat(F.transform("base", rank), F.transform("more", rank))).alias("every"))


def _reach(column: str) -> Column:
    """Of each BLOCK of spans sorted by start: its number, first start and last end."""
    last = F.floor((F.size(column) - 1) / BLOCK).cast("int")

    def one(b: Column) -> Column:
        own = F.slice(F.col(column), b * BLOCK + 1, F.lit(BLOCK))
        return F.struct(b.alias("b"), F.get(own, F.lit(0))["start"].alias("start"), F.array_max(F.transform(own, lambda s: s["end"])).alias("end"))

    return F.when(F.size(column) > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<struct<b:int,start:bigint,end:bigint>>"))


def _held(blocks: str, value: Column) -> Column:
    """The value. That blocks occur twice keeps the optimizer from working them out anew for every span."""
    return F.when(F.size(blocks) >= 0, value)


def _touched(column: str, blocks: str, a: Column, earlier: bool = False) -> Column:
    """Whether a span of the column (sorted by start, with its blocks) touches a; earlier: one that begins earlier, or there with a
    pattern that comes first."""
    touch = lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    first = lambda b: (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["k"] < a["k"]))
    each = (lambda b: first(b) & touch(b)) if earlier else touch
    return F.exists(blocks, lambda x: touch(x) & F.exists(F.slice(F.col(column), x["b"] * BLOCK + 1, F.lit(BLOCK)), each))


def digests(docs: DataFrame) -> DataFrame:
    found = written(candidates(docs), "candidates")
    rows = spans(found, fitted(found))
    count = [F.size(_of_kind("base", k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return rows.select("doc_id", *count, F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"), _told(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
