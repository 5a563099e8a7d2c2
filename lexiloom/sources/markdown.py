"""Markdown as HTML: headings, paragraphs, lists, quotes, code, rules, emphasis, links and images."""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)\s*([^`]*)$")
_ITEM = re.compile(r"^( {0,3})([-*+]|[0-9]{1,9}[.)])\s+(.*)$")


def inline(t: str) -> str:
    held: list[str] = []

    def keep(html: str) -> str:
        held.append(html)
        return f"\x00{len(held) - 1}\x00"

    t = re.sub(r"(`+)(.+?)\1(?!`)", lambda m: keep(f"<code>{escape(m[2].strip(), quote=False)}</code>"), t)
    t = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(escape(m[1])), t)
    t = re.sub(r"!\[([^\]]*)\]\(\s*<?([^\s)>]+)>?(?:\s+\"([^\"]*)\")?\s*\)", lambda m: keep(f'<img src="{escape(m[2])}" alt="{escape(m[1])}">'), t)
    t = re.sub(r"\[([^\]]*)\]\(\s*<?([^\s)>]*)>?(?:\s+\"([^\"]*)\")?\s*\)", lambda m: keep(f'<a href="{escape(m[2])}">') + m[1] + keep("</a>"), t)
    t = re.sub(r"<(https?://[^\s>]+)>", lambda m: keep(f'<a href="{escape(m[1])}">{escape(m[1])}</a>'), t)
    t = escape(t, quote=False)
    t = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"<strong>\2</strong>", t, flags=re.S)
    t = re.sub(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?![\w*])|(?<![\w_])_(?=\S)(.+?)(?<=\S)_(?![\w_])", lambda m: f"<em>{m[1] or m[2]}</em>", t, flags=re.S)
    t = re.sub(r"(?: {2,}|\\)\n", "<br>\n", t)
    while "\x00" in t:
        t = re.sub("\x00([0-9]+)\x00", lambda m: held[int(m[1])], t)
    return t


def to_html(source: str) -> str:
    lines = re.sub("\r\n?", "\n", source).replace("\x00", "�").expandtabs(4).split("\n")
    out: list[str] = []
    para: list[str] = []

    def flush():
        if para:
            out.append(f"<p>{inline(chr(10).join(p.lstrip() for p in para).rstrip())}</p>")
            para.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            flush()
            body, i = [], i + 1
            while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            out.append(f"<pre><code>{escape(chr(10).join(body), quote=False)}</code></pre>")
        elif not line.strip():
            flush()
        elif m := re.match(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
            flush()
            out.append(f"<h{len(m[1])}>{inline(m[2] or '')}</h{len(m[1])}>")
        elif para and re.match(r"^ {0,3}(=+|-+)\s*$", line):
            n = 1 if "=" in line else 2
            out.append(f"<h{n}>{inline(chr(10).join(p.strip() for p in para))}</h{n}>")
            para.clear()
        elif re.match(r"^ {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$", line):
            flush()
            out.append("<hr>")
        elif re.match(r"^ {0,3}>", line):
            flush()
            quoted = []
            while i < len(lines) and lines[i].strip() and (re.match(r"^ {0,3}>", lines[i]) or quoted):
                quoted.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(f"<blockquote>{to_html(chr(10).join(quoted))}</blockquote>")
            continue
        elif (m := _ITEM.match(line)) and (not para or not m[2][0].isdigit() or m[2][:-1] == "1"):
            flush()
            ordered = m[2][0].isdigit()
            items: list[list[str]] = []
            while i < len(lines):
                m = _ITEM.match(lines[i])
                if m and m[2][0].isdigit() == ordered:
                    items.append([m[3]])
                    width = len(lines[i]) - len(m[3])
                elif items and (lines[i].startswith(" " * width) or lines[i].strip() and items[-1][-1].strip() and not _ITEM.match(lines[i])):
                    items[-1].append(lines[i].removeprefix(" " * width))
                elif items and not lines[i].strip() and i + 1 < len(lines) and (lines[i + 1].startswith(" " * width) or _ITEM.match(lines[i + 1])):
                    items[-1].append("")
                else:
                    break
                i += 1
            body = [to_html("\n".join(x)) for x in items]
            body = [b[3:-4] if b.startswith("<p>") and b.count("<p>") == 1 and b.endswith("</p>") else b for b in body]
            tag = "ol" if ordered else "ul"
            out.append(f"<{tag}>" + "".join(f"<li>{b}</li>" for b in body) + f"</{tag}>")
            continue
        elif not para and line.startswith("    "):
            body = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            out.append(f"<pre><code>{escape(chr(10).join(body).rstrip(), quote=False)}</code></pre>")
            continue
        else:
            para.append(line)
        i += 1
    flush()
    return "\n".join(out)


@F.pandas_udf(StringType())
def markdown_html(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else to_html(x))
