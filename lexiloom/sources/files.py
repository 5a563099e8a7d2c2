"""Files as sources: bytes of documents, their formats, decoding, and sections of text, Markdown and HTML."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Largest files that are read, by format.
LIMITS = {"html": 25 << 20, "txt": 25 << 20, "markdown": 25 << 20, "epub": 100 << 20, "pdf": 250 << 20}


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))


def format_of(url: Column, head: Column) -> Column:
    """By extension, else by the first 512 characters."""
    e = extension(url)
    return (
        F.when(e.isin("html", "htm", "xhtml"), "html").when(e == "epub", "epub").when(e == "pdf", "pdf").when(e.isin("md", "markdown"), "markdown").when(e == "txt", "txt")
        .when(head.startswith("PK"), "epub").when(head.startswith("%PDF-"), "pdf").when(F.ltrim(head).startswith("<"), "html")
        .when((head == "") | head.rlike(r"[\x00-\x08\x0e-\x1f]"), "unknown").otherwise("txt")
    )


def files(spark: SparkSession, path: str, depth: int = 4) -> DataFrame:
    """path, folder, name, content, bytes, id (SHA-256) of the files below a folder, hidden ones left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rest = F.regexp_replace(F.col("path"), "^.*?" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    rows = rows.withColumn("rest", rest).withColumn("parts", F.split("rest", "/"))
    rows = rows.where((F.size("parts") <= depth + 1) & ~F.exists("parts", lambda p: p.startswith(".")))
    return rows.select("path", F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("folder"), F.element_at("parts", -1).alias("name"), "content", F.col("length").alias("bytes"), F.sha2("content", 256).alias("id"))


def text_id(fmt: Column, content: Column) -> Column:
    """The id of text and Markdown files: their format counts too."""
    return F.sha2(F.concat(fmt.cast("binary"), F.unhex(F.lit("00")), content), 256)


_CHARSET = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)


def decoded(data: bytes, fmt: str) -> tuple[str | None, str | None]:
    """(text, error). Text files: UTF-8, or UTF-16 with a mark. HTML: UTF-8, a mark, or a charset named in the first 64 KiB."""
    if data is None:
        return None, "missing"
    if len(data) > LIMITS.get(fmt, 25 << 20):
        return None, "too-large"
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(name), None
            except UnicodeDecodeError:
                return None, "encoding"
    try:
        return data.decode("utf-8"), None
    except UnicodeDecodeError:
        pass
    named = _CHARSET.search(data[: 64 << 10]) if fmt == "html" else None
    if named:
        try:
            return data.decode(named[1].decode("ascii")), None
        except (LookupError, UnicodeDecodeError):
            pass
    return None, "encoding"


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def decode(data: pd.Series, fmt: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decoded(d, f) for d, f in zip(data, fmt, strict=True)], columns=["text", "error"])


def paragraphs(t: Column) -> Column:
    """Plain text's paragraphs: parted by blank lines."""
    even = F.regexp_replace(t, "\r\n?", "\n")
    return F.filter(F.transform(F.split(even, r"\n(?:[ \t]*\n)+"), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), lambda p: F.trim(p) != "")


def text_as_html(t: Column) -> Column:
    """Plain text as HTML: paragraphs, lines as <br>."""
    from lexiloom.functions.text import escaped

    return F.array_join(F.transform(paragraphs(t), lambda p: F.concat(F.lit("<p>"), F.replace(escaped(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "\n")
