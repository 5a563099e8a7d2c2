"""HTML documents: sanitised markup, ordered sections with their headings, auxiliary text, and outlines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: Elements that make sections, and those that are left out with all they hold. Fixed values.
READABLE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote div section article main".split())
DROPPED = frozenset("script style noscript template iframe object embed svg math form button select textarea input head".split())
ALLOWED = READABLE | frozenset("a abbr aside b br caption cite code dd dl dt em figcaption figure footer header hr i img nav ol pre q s small span strong sub sup table tbody td tfoot th thead tr u ul".split())
ATTRIBUTES = {"a": ("href", "title", "id"), "img": ("src", "alt", "title"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
COMMON = ("id", "title", "lang", "dir", "role")
SCHEMES = re.compile(r"(?i)^(?:data|https?|mailto|tel):|^[^:]*$|^[/#?.]")
VOID = frozenset("br hr img input embed".split())
AUXILIARY = frozenset("footnote footnotes endnote endnotes rearnote rearnotes bibliography toc index navigation doc-footnote doc-endnote doc-endnotes doc-bibliography doc-toc doc-index doc-noteref landmarks page-list".split())


class Node:
    __slots__ = ("name", "attrs", "children", "aux")

    def __init__(self, name: str, attrs: dict, aux: bool):
        self.name, self.attrs, self.children, self.aux = name, attrs, [], aux


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, False)
        self.stack = [self.root]
        self.dropped = 0
        self.title: list[str] | None = None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title, self.title = True, [] if self.title is None else self.title
            return
        if tag == "body":
            self.dropped = 0
            return
        if tag in DROPPED and tag not in VOID:
            self.dropped += 1
        if self.dropped:
            return
        own = {k: v or "" for k, v in attrs}
        marks = set(f"{own.get('role', '')} {own.get('epub:type', '')}".lower().split())
        node = Node(tag, own, self.stack[-1].aux or tag == "nav" or bool(marks & AUXILIARY))
        if tag in READABLE or tag in ("ul", "ol", "table"):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name == "p":
                    del self.stack[i:]
                    break
        if tag == "li":
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name in ("ul", "ol"):
                    break
                if self.stack[i].name == "li":
                    del self.stack[i:]
                    break
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
            return
        if tag in DROPPED and tag not in VOID:
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.dropped:
            self.stack[-1].children.append(data)


def tree(html: str) -> _Tree:
    t = _Tree()
    t.feed(html)
    t.close()
    return t


def _text(node: Node | str) -> str:
    if isinstance(node, str):
        return node
    if node.name == "br":
        return " "
    inner = "".join(_text(c) for c in node.children)
    return f" {inner} " if node.name in READABLE or node.name in ("td", "th", "tr", "dd", "dt", "figcaption") else inner


def _blocks(node: Node) -> Iterator[Node]:
    """Readable elements without readable ones in them."""
    for c in node.children:
        if isinstance(c, Node):
            found = False
            for b in _blocks(c):
                found = True
                yield b
            if not found and c.name in READABLE:
                yield c


def _pieces(node: Node | str, aux: bool) -> Iterator[tuple[str, bool]]:
    if isinstance(node, str):
        yield node, aux
        return
    aux = aux or node.aux
    if node.name == "br":
        yield " ", aux
    for c in node.children:
        yield from _pieces(c, aux)


def body_ranges(node: Node) -> tuple[str, list[tuple[int, int]]]:
    """A block's text, white space collapsed, and the ranges (code points) that aren't auxiliary."""
    out, ranges, gap = "", [], False
    for text, aux in _pieces(node, False):
        for word in re.findall(r"\s+|\S+", text):
            if word.isspace():
                gap = bool(out)
                continue
            if gap:
                out += " "
            if not aux:
                if ranges and ranges[-1][1] >= len(out) - 1:
                    ranges[-1] = (ranges[-1][0], len(out) + len(word))
                else:
                    ranges.append((len(out), len(out) + len(word)))
            out += word
            gap = False
    return out, ranges


def sections_of(html: str) -> list[dict]:
    """ordinal, is_heading, rank, heading, text, auxiliary, body of a page's blocks; with none, the whole body is one."""
    t = tree(html)
    out: list[dict] = []
    heading = None
    for node in _blocks(t.root):
        text, ranges = body_ranges(node)
        is_heading = re.fullmatch("h[1-6]", node.name) is not None
        if is_heading and text and not node.aux:
            heading = text
        if text:
            out.append({"ordinal": len(out), "is_heading": is_heading, "rank": int(node.name[1]) if is_heading else None, "heading": heading, "text": text, "auxiliary": node.aux, "body": [] if is_heading else [{"start": a, "end": b} for a, b in ranges]})
    if not out and (whole := " ".join(_text(t.root).split())):
        out.append({"ordinal": 0, "is_heading": False, "rank": None, "heading": None, "text": whole, "auxiliary": False, "body": [{"start": 0, "end": len(whole)}]})
    return out


def title_of(html: str, fallback: str = "Imported HTML Document") -> str:
    t = tree(html)
    return " ".join("".join(t.title or []).split())[:512] or fallback


def sanitised(html: str) -> str:
    """Only allowed elements, attributes and URL schemes; other elements give way to what they hold."""

    def write(node) -> str:
        if isinstance(node, str):
            return escape(node, quote=False)
        inner = "".join(write(c) for c in node.children)
        if node.name not in ALLOWED:
            return inner
        own = ""
        for k in (*COMMON, *ATTRIBUTES.get(node.name, ())):
            v = node.attrs.get(k)
            if v is None or k in ("href", "src") and not SCHEMES.match(re.sub(r"[\x00-\x20]+", "", v)) or f" {k}=" in own:
                continue
            own += f' {k}="{escape(v)}"'
        return f"<{node.name}{own}>" if node.name in VOID else f"<{node.name}{own}>{inner}</{node.name}>"

    return "".join(write(c) for c in tree(html).root.children)


def with_locators(html: str, attribute: str = "data-section") -> str:
    """Sanitised markup whose blocks carry their ordinal."""
    t = tree(sanitised(html))
    ordinal = {id(n): i for i, n in enumerate(b for b in _blocks(t.root) if body_ranges(b)[0])}

    def write(node) -> str:
        if isinstance(node, str):
            return escape(node, quote=False)
        own = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
        if id(node) in ordinal:
            own += f' {attribute}="{ordinal[id(node)]}"'
        inner = "".join(write(c) for c in node.children)
        return f"<{node.name}{own}>" if node.name in VOID else f"<{node.name}{own}>{inner}</{node.name}>"

    return "".join(write(c) for c in t.root.children)


def complete_locators(html: str, n: int, attribute: str = "data-section") -> bool:
    return re.findall(rf'{attribute}="([0-9]+)"', html) == [str(i) for i in range(n)]


_ROW = "ordinal int, is_heading boolean, rank int, heading string, text string, auxiliary boolean, body array<struct<start:int,end:int>>"


def html_sections(pages: DataFrame) -> DataFrame:
    """page_id and the sections of every page."""

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sections_of(html or "")
                ids += [i] * len(own)
                rows += own
            cols = {
                "page_id": pa.array(ids, pa.int64()), **{k: pa.array([r[k] for r in rows], t) for k, t in (("ordinal", pa.int32()), ("is_heading", pa.bool_()), ("rank", pa.int32()), ("heading", pa.string()), ("text", pa.string()), ("auxiliary", pa.bool_()))},
                "body": pa.array([r["body"] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, " + _ROW)


def outline(headings: DataFrame, key: str = "page_id") -> DataFrame:
    """key, ordinal, label, rank, parent: a heading's parent is the last one before it of a lower rank.

    Ranks are six at most, so the last heading of each rank is a running column, and no row is joined with another.
    Documents with fewer than two headings have no outline.
    """
    w = W.partitionBy(key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    rows = headings
    for r in range(1, 7):
        rows = rows.withColumn(f"last{r}", F.last(F.when(F.col("rank") == r, F.col("ordinal")), ignorenulls=True).over(w))
    above = F.greatest(F.lit(None).cast("int"), *[F.when(F.col("rank") > r, F.col(f"last{r}")) for r in range(1, 7)])
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy(key)))
    return rows.where("n >= 2").select(key, "ordinal", F.substring("text", 1, 512).alias("label"), "rank", above.alias("parent"))
