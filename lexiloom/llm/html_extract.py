"""Main text of pages by deducing each host's template from equivalence classes of tokens.

Tokens of a page are its block elements, told apart by their path of names, classes and ids, and its texts, told apart by
path. A token's occurrence vector says how often it occurs on each page of its host. Spark sums a hash of (page,
occurrences) per host and token, map-side first, so that tokens of equal vectors get equal sums: an equivalence class. Classes that
occur on at least half of the host's pages (LEAST_SHARE) are frequent; there can be no more of their tokens than two pages'
worth, so a host's template is small however many pages it has. A frequent class is valid if it has two tokens or more, or
is nested in a valid one; classes are nested by the paths of their tokens. Texts that belong to the template are fixed, and go;
paths that hold other text are slots. Roles of the elements around them (menus, headers, footers, asides, forms,
notices, adverts, comments) and the share of link text rule slots out. Of the other slots' varying text, article elements
hold at least half (CONTENT_SHARE), and then they are the article, or else it's the deepest template node that holds most of it.

The article's blocks are read from each page with its host's template: character references are decoded, white space in a block becomes
one space, blocks are trimmed and joined by one newline, empty ones are left out. Texts within article elements are fixed
if nearly all pages with that element (ALWAYS) have them, so what some copies share stays; a page that would keep less than LEAST_LEFT of its article's characters is a copy of others, and keeps them all.

Defined results: null html and pages without text give an empty text; a null url is a host of its own ("" with all such
pages); a host's only page is judged by roles alone; unclosed, crossing and cut off elements are read as far as they go; repeated
rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BROADCAST_ROWS, pieces, read_table, written

LEAST_SHARE = 0.5
#: Link text's share from which a slot is a menu.
LINK_SHARE = 0.6
#: Share of the varying text from which article elements hold the article; with less they are teasers.
CONTENT_SHARE = 0.5
#: Share of an article element's pages from which a text within it is fixed.
ALWAYS = 0.9
#: Share of an article that isn't fixed, below which the page is a copy.
LEAST_LEFT = 0.1

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg select button noframes head-raw".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "thead tbody tr td th", "tfoot": "thead tbody tr td th"}
SCOPES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table", "option": "select", "tbody": "table", "tfoot": "table"}

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|/?[a-zA-Z!?][^<>]*+>)", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")

BOILER_TAGS = frozenset("nav aside footer form menu dialog head".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu nav navbar"
    " navigation breadcrumb breadcrumbs sidebar sidebars aside footer foot header masthead topbar toolbar comment comments disqus reply replies respond share sharing social"
    " related recommended newsletter subscribe signup login popup modal overlay widget widgets pagination pager tagcloud copyright legal search skip rail teaser paywall".split()
)
#: Of these, the ones that name parts of an article inside one.
OWN_WORDS = frozenset("header head masthead legal search text".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())

CONTENT, NEUTRAL, BOILER = 2, 1, 0


class Block:
    __slots__ = ("path", "text", "links", "role")

    def __init__(self, path: str, text: str, links: int, role: int):
        self.path, self.text, self.links, self.role = path, text, links, role


def element(name: str, attrs: str, inside: bool = False) -> tuple[str, int]:
    """An element's part of a path, and its role; inside: within an article, where a header is the article's own."""
    if not attrs:
        return name, BOILER if name in BOILER_TAGS else CONTENT if name in CONTENT_TAGS else BOILER if name == "header" and not inside else NEUTRAL
    said = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in NAMED.finditer(attrs)}
    marks = re.sub(r"\d+", "0", " ".join(f"{k}={' '.join(sorted(said[k].split()))}" for k in ("class", "id", "role") if said.get(k)))
    words = set(WORDS.findall(" ".join(said.values())))
    if inside:
        words -= OWN_WORDS
    if name in ("html", "body"):
        role = NEUTRAL
    elif name in BOILER_TAGS or words & BOILER_WORDS and name not in CONTENT_TAGS:
        role = BOILER
    elif name in CONTENT_TAGS or said.get("role") in ("main", "article"):
        role = CONTENT
    elif name == "header" and not inside:
        role = BOILER
    elif name in ("div", "section", "td") and words & CONTENT_WORDS:
        role = CONTENT
    else:
        role = NEUTRAL
    return f"{name}[{marks}]" if marks else name, role


def parse(html: str, opened: Counter | None = None) -> list[Block]:
    """The page's blocks in order. opened counts the paths of block elements."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = [("", "", NEUTRAL)]  # name, path, role
    texts: list[str] = []
    links, in_link, at, end = 0, 0, 0, len(html)

    def flush():
        nonlocal texts, links
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(stack[-1][1], text, links, stack[-1][2]))
            texts, links = [], 0

    def add(part: str):
        nonlocal links
        part = unescape(part) if "&" in part else part
        texts.append(part)
        if in_link:
            links += len(part)

    def pop_to(names: str, scopes: str = "") -> None:
        nonlocal stack
        wanted, scope = names.split(), scopes.split()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in scope:
                break
            if stack[i][0] in wanted:
                del stack[i:]
                return

    while at < end:
        m = TAG.search(html, at)
        if m is None:
            tail = html[at:]
            cut = re.compile(r"<[a-zA-Z/!?]").search(tail, tail.rfind(">") + 1)  # a tag that was cut off
            add(tail[: cut.start()] if cut else tail)
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCKS:
                flush()
                if any(s[0] == name for s in stack):
                    while stack[-1][0] != name:
                        stack.pop()
                    stack.pop()
                    in_link = 0
            continue
        attrs = m[3]
        if name in RAW:
            if not attrs.endswith("/"):
                closing = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = closing.end() if closing else end if name != "title" else at
            if name in BLOCKS:
                flush()
            continue
        if name == "br":
            texts.append(" ")
        elif name == "a":
            in_link = 0 if attrs.endswith("/") else 1
        elif name in BLOCKS:
            flush()
            in_link = 0
            if any(s[0] == "p" for s in stack):
                pop_to("p")
            if name in CLOSES:
                pop_to(CLOSES[name], SCOPES[name])
            _, above, held = stack[-1]
            part, role = element(name, attrs, held == CONTENT)
            role = BOILER if BOILER in (role, held) else max(role, held)
            path = f"{above}>{part}"
            if opened is not None:
                opened[path] += 1
            if name not in VOID and not attrs.endswith("/"):
                stack.append((name, path, role))
        elif name in ("td", "img", "input"):
            texts.append(" ")
    flush()
    return out


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


#: Kinds of tokens.
PAGE, ELEMENT, TEXT = 0, 1, 2
_TOKENS = "host string, kind int, token long, path string, role int, page long, n long, chars long, links long"


def _tokens(batches):
    names = [x.split()[0] for x in _TOKENS.split(", ")]
    for batch in pieces(batches, "html"):
        rows: list[tuple] = []
        for host, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            page = _hash(url or "", html or "")
            opened: Counter = Counter()
            blocks = parse(html or "", opened)
            rows.append((host, PAGE, 0, "", 0, page, 1, 0, 0))
            size: Counter = Counter()
            links: Counter = Counter()
            role: dict[str, int] = {}
            texts: Counter = Counter()
            for b in blocks:
                size[b.path] += len(b.text)
                links[b.path] += min(b.links, len(b.text))
                role[b.path] = b.role
                texts[(b.path, b.text)] += 1
            for path in opened.keys() | size.keys():
                rows.append((host, ELEMENT, _hash(path), path, role.get(path, NEUTRAL), page, opened[path], size[path], links[path]))
            for (path, text), n in texts.items():
                rows.append((host, TEXT, _hash(path, text), path, role[path], page, n, n * len(text), 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=names)


_ARROW = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def article(path: str) -> str:
    """The path of the outermost article element around a path that has one."""
    parts = path.split(">")
    for i, part in enumerate(parts):
        name, _, marks = part.partition("[")
        if name in CONTENT_TAGS or re.search(r"role=(?:main|article)\b", marks) or name in ("div", "section", "td") and set(WORDS.findall(marks)) & CONTENT_WORDS:
            return ">".join(parts[: i + 1])
    return path


def template(tokens: list[dict], pages: int) -> tuple[list[int], str]:
    """Of a host's frequent tokens: the fixed texts' hashes, and the path of the article ("" where roles say it)."""
    by_class: dict[tuple, list[dict]] = {}
    for t in tokens:
        by_class.setdefault((t["sig"], t["pages"], t["n"]), []).append(t)
    paths = {t["path"]: key for key, ts in by_class.items() for t in ts if t["kind"] == ELEMENT}

    def parent(path: str):
        """The class that the path is nested in."""
        while ">" in path:
            path = path.rpartition(">")[0]
            if path in paths:
                return paths[path]
        return None

    valid: dict[tuple, bool] = {}

    def ok(key) -> bool:
        if key not in valid:
            valid[key] = False  # while it's being decided
            own = by_class[key]
            valid[key] = len(own) > 1 or any((up := (paths.get(t["path"]) if t["kind"] == TEXT else parent(t["path"]))) is not None and up != key and ok(up) for t in own)
        return valid[key]

    def always(t: dict) -> bool:
        around = paths.get(article(t["path"]))
        return around is not None and t["pages"] > 2 and t["pages"] >= ALWAYS * around[1]

    fixed = [t["token"] for key, ts in by_class.items() for t in ts if t["kind"] == TEXT and pages > 2 and ok(key) and (t["role"] != CONTENT or always(t))]
    constant: Counter = Counter()
    gone = set(fixed)
    for t in tokens:
        if t["kind"] == TEXT and t["token"] in gone:
            constant[t["path"]] += t["chars"]
    # the deepest node that holds most of the varying text of slots that aren't menus
    mass: Counter = Counter()
    total = content = 0
    for t in tokens:
        if t["kind"] == ELEMENT and t["chars"] and (t["role"] == CONTENT or t["role"] == NEUTRAL and t["links"] < LINK_SHARE * t["chars"]):
            varying, path = max(0, t["chars"] - constant[t["path"]]), t["path"].rpartition(">")[0]
            total += varying
            content += varying if t["role"] == CONTENT else 0
            while path:
                mass[path] += varying
                path = path.rpartition(">")[0]
    if any(t["kind"] == ELEMENT and t["role"] == CONTENT and t["chars"] for t in tokens) and content >= CONTENT_SHARE * total:
        return fixed, ""
    if not mass:
        return fixed, ""
    most = max(mass.values())
    best = max((p for p in mass if mass[p] >= 0.8 * most), key=lambda p: (p.count(">"), mass[p], p))
    return fixed, best


def _templates(batches):
    for batch in batches:
        out = [template(tokens, pages) for tokens, pages in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in out], pa.list_(pa.int64())), pa.array([b for _, b in out], pa.string())], names=["host", "fixed", "best"])


def main_text(html: str, fixed: set[int] = frozenset(), best: str = "") -> str:
    """The page's main text, given its host's template."""
    slots = [b for b in parse(html) if b.role == CONTENT or b.role == NEUTRAL and b.links < LINK_SHARE * len(b.text)]
    inside = [b for b in slots if b.path == best or b.path.startswith(best + ">")] if best else []
    good = inside or [b for b in slots if b.role == CONTENT] or slots
    if fixed:
        left = [b for b in good if _hash(b.path, b.text) not in fixed]
        if left and sum(len(b.text) for b in left) >= LEAST_LEFT * sum(len(b.text) for b in good):
            good = left
    return "\n".join(b.text for b in good)


def _extract(batches):
    for batch in pieces(batches, "html"):
        fixed: dict[tuple, set] = {}
        out = []
        for html, own, best in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            key = tuple(own or ())
            out.append(main_text(html or "", fixed.setdefault(key, set(key)), best or ""))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """host, fixed (hashes of texts), best (path of the article)."""
    tokens = pages.select(host(F.col("url")).alias("host"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_tokens, _TOKENS)
    vector = F.xxhash64("page", "n").cast("decimal(20,0)")
    sums = written(
        tokens.groupBy("host", "kind", "token").agg(
            F.min("path").alias("path"), F.max("role").alias("role"), F.count("*").alias("pages"), F.sum("n").alias("n"),
            F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum(vector).cast("string").alias("sig"),
        ).where("pages > 1"),
        "tokens",
    )
    totals = sums.where(f"kind = {PAGE}").select(F.col("host").alias("h"), F.col("pages").alias("of"))
    frequent = sums.where(f"kind != {PAGE}").join(totals, F.col("host") == F.col("h")).where(F.col("pages") >= LEAST_SHARE * F.col("of"))
    each = F.struct("kind", "token", "path", "role", "pages", "n", "chars", "links", "sig")
    return frequent.groupBy("host", "of").agg(F.collect_list(each).alias("tokens")).mapInArrow(_templates, "host string, fixed array<long>, best string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = written(templates(pages).where("best != '' OR size(fixed) > 0"), "templates").withColumnRenamed("host", "h")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS // 100 else found
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    joined = rows.join(side, host(F.col("url")) == F.col("h"), "left").select("page_id", "url", "html", "fixed", "best")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
