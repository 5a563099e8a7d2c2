"""EPUB books: chapters in reading order, their sections, cover and outline."""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .html import sections_of, tree

CHAPTER_BYTES, BOOK_BYTES = 20 << 20, 120 << 20
OUTLINE_ENTRIES, OUTLINE_DEPTH, LABEL = 10_000, 32, 4096


class BadBook(ValueError):
    """The file isn't a book that can be read."""


def resolved(base: str, href: str) -> tuple[str, str]:
    """(path in the archive, fragment) of a reference from a file; what leads out of the archive is refused."""
    path, _, fragment = href.partition("#")
    path = unquote(path)
    if "://" in href or path.startswith("/") or "\\" in path or "\0" in path:
        raise BadBook(href)
    out = posixpath.normpath(posixpath.join(posixpath.dirname(base), path)) if path else base
    if out.startswith(".."):
        raise BadBook(href)
    return out, unquote(fragment)


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _find(root, name: str):
    return [e for e in root.iter() if _local(e.tag) == name]


class Book:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise BadBook("zip") from e
        names = {i.filename: i for i in self.zip.infolist()}
        if sum(i.file_size for i in names.values()) > BOOK_BYTES:
            raise BadBook("too large")
        if "mimetype" in names and self.zip.read("mimetype").strip() != b"application/epub+zip":
            raise BadBook("mimetype")
        container = self._xml("META-INF/container.xml")
        roots = [e.get("full-path") for e in _find(container, "rootfile") if e.get("full-path")]
        if not roots:
            raise BadBook("container")
        self.opf = roots[0]
        package = self._xml(self.opf)
        self.items = {}
        for e in _find(package, "item"):
            try:
                self.items[e.get("id")] = (resolved(self.opf, e.get("href", ""))[0], e.get("media-type", ""), (e.get("properties") or "").split())
            except BadBook:
                continue
        self.spine = [self.items[e.get("idref")][0] for e in _find(package, "itemref") if e.get("idref") in self.items and e.get("linear") != "no"]
        self.toc = next((e.get("toc") for e in _find(package, "spine")), None)
        title = next((e.text for e in _find(package, "title") if e.text and e.text.strip()), None)
        self.title = " ".join(title.split())[:512] if title else "Imported EPUB"

    def _read(self, name: str) -> bytes:
        try:
            info = self.zip.getinfo(name)
        except KeyError as e:
            raise BadBook(name) from e
        if info.file_size > CHAPTER_BYTES:
            raise BadBook(name)
        return self.zip.read(info)

    def _xml(self, name: str):
        data = self._read(name)
        if b"<!ENTITY" in data:
            raise BadBook("entities")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise BadBook(name) from e

    def sections(self) -> list[dict]:
        out = []
        for chapter, path in enumerate(self.spine):
            for s in sections_of(self._read(path).decode("utf-8", "replace")):
                out.append({**s, "ordinal": len(out), "chapter": chapter, "path": path})
        return out

    def outline(self) -> list[dict]:
        """depth, label, path, fragment: from the navigation document, else the NCX; only places in the book."""
        rows: list[dict] = []
        known = set(self.spine)

        def add(base: str, depth: int, label: str, href: str | None) -> None:
            if len(rows) >= OUTLINE_ENTRIES or depth >= OUTLINE_DEPTH or not label:
                return
            path = fragment = None
            if href:
                try:
                    path, fragment = resolved(base, href)
                except BadBook:
                    path = None
                if path not in known:
                    path = fragment = None
            rows.append({"depth": depth, "label": label[:LABEL], "path": path, "fragment": fragment or None})

        nav = next((p for p, _, props in self.items.values() if "nav" in props), None)
        if nav:
            def walk(node, depth):
                for c in node.children:
                    if isinstance(c, str):
                        continue
                    if c.name == "li":
                        link = next((x for x in c.children if not isinstance(x, str) and x.name in ("a", "span")), None)
                        if link is not None:
                            from .html import _text

                            add(nav, depth, " ".join(_text(link).split()), link.attrs.get("href") if link.name == "a" else None)
                        walk(c, depth + 1)
                    else:
                        walk(c, depth)

            root = tree(self._read(nav).decode("utf-8", "replace")).root

            def navs(node):
                for c in node.children:
                    if not isinstance(c, str):
                        if c.name == "nav" and "toc" in (c.attrs.get("epub:type", "") + " " + c.attrs.get("role", "")):
                            yield c
                        yield from navs(c)

            for n in navs(root):
                walk(n, 0)
                break
        if not rows and self.toc in self.items:
            ncx = self.items[self.toc][0]

            def points(node, depth):
                for p in node:
                    if _local(p.tag) == "navPoint":
                        label = next((e.text for e in p if _local(e.tag) == "navLabel" for e in e if e.text), "")
                        src = next((e.get("src") for e in p if _local(e.tag) == "content"), None)
                        add(ncx, depth, " ".join(label.split()), src)
                        points(p, depth + 1)

            for m in _find(self._xml(ncx), "navMap"):
                points(m, 0)
        return rows


_ROW = "id string, title string, chapter int, ordinal int, is_heading boolean, heading string, text string, error string"


def epub_sections(files: DataFrame) -> DataFrame:
    """files: id, content. The sections of every book; a book that can't be read is one row with its error."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    book = Book(data or b"")
                    rows += [{"id": i, "title": book.title, "error": None, **{k: s[k] for k in ("chapter", "ordinal", "is_heading", "heading", "text")}} for s in book.sections()]
                except BadBook as e:
                    rows.append({"id": i, "title": None, "chapter": None, "ordinal": None, "is_heading": None, "heading": None, "text": None, "error": str(e)})
            types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
            cols = [(x.split()[0], types[x.split()[1]]) for x in _ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in cols], names=[c for c, _ in cols])

    return files.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(run, _ROW)


def rewritten(book: Book, chapter: int) -> str:
    """A chapter's markup with links that stay in the book: anchors carry the chapter's number, links out of the book keep
    only safe schemes, pictures of the book point to its assets, other ones go."""
    from .html import Node, sanitised, tree

    path = book.spine[chapter]
    number = {p: i for i, p in enumerate(book.spine)}
    pictures = {p for p, kind, _ in book.items.values() if kind.startswith("image/")}
    root = tree(sanitised(book._read(path).decode("utf-8", "replace"))).root

    def walk(node: Node) -> None:
        for c in list(node.children):
            if isinstance(c, str):
                continue
            if "id" in c.attrs:
                c.attrs["id"] = f"c{chapter}-{c.attrs['id']}"
            if c.name == "a" and "href" in c.attrs and ":" not in c.attrs["href"].split("#")[0]:
                try:
                    to, fragment = resolved(path, c.attrs["href"])
                    c.attrs["href"] = f"#c{number[to]}" + (f"-{fragment}" if fragment else "")
                except (BadBook, KeyError):
                    del c.attrs["href"]
            if c.name == "img":
                try:
                    to, _ = resolved(path, c.attrs.get("src", ""))
                except BadBook:
                    to = ""
                if to in pictures:
                    c.attrs["src"] = f"assets/{to}"
                elif not c.attrs.get("src", "").startswith("data:"):
                    node.children.remove(c)
            walk(c)

    def write(node) -> str:
        from html import escape

        if isinstance(node, str):
            return escape(node, quote=False)
        own = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
        inner = "".join(write(c) for c in node.children)
        return f"<{node.name}{own}>" if node.name in ("br", "hr", "img") else f"<{node.name}{own}>{inner}</{node.name}>"

    walk(root)
    return "".join(write(c) for c in root.children)
