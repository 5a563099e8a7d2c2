"""The engine's functions under SQL names: scalar functions and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from lexiloom.operators.alignment import word_spans
from lexiloom.operators.semantic import passage_ranges
from lexiloom.sources.html import sections_of
from lexiloom.sources.markdown import markdown_html

from . import speech, stemming

SCALARS = {
    "tokenize": stemming.stemmed, "speech_chunks": speech.speech_chunks, "normalize_speech": speech.speech_english, "fnv1a": speech.text_hash, "nfc": speech.nfc, "nfkc": speech.nfkc,
    "natural_key": speech.natural_key, "passage_ranges": passage_ranges, "word_spans": word_spans, "markdown_html": markdown_html,
}


class HtmlSections:
    """ordinal, heading, text, auxiliary of a page."""

    def eval(self, html: str):
        for s in sections_of(html or ""):
            yield s["ordinal"], s["heading"], s["text"], s["auxiliary"]


class SpeechChunks:
    """index, text, start_segment, start_offset of a text's chunks; its lines are segments."""

    def eval(self, text: str, profile: str):
        for i, c in enumerate(speech.chunks((text or "").split("\n"), profile=profile)):
            yield i, c["text"], c["start_segment"], c["start_offset"]


class Passages:
    """index, start, end of a text's windows."""

    def eval(self, text: str):
        from lexiloom.operators.semantic import windows

        for i, (a, b) in enumerate(windows(text) if text else []):
            yield i, a, b


TABLES = {
    "html_sections": (HtmlSections, "ordinal int, heading string, text string, auxiliary boolean"),
    "speech_chunk_rows": (SpeechChunks, "index int, text string, start_segment int, start_offset int"),
    "passages": (Passages, "index int, start int, end int"),
}


def register(spark: SparkSession) -> None:
    """Make all functions known to a session's SQL."""
    for name, f in SCALARS.items():
        spark.udf.register(name, f)
    for name, (cls, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
