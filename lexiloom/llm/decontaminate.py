"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Texts are tokens: runs of ASCII letters, digits and other non-ASCII characters, A-Z in lower case. Documents and
benchmark items are joined on shared seeds, the hashes of MIN_MATCH tokens in a row; the benchmark, the stated query set, is
broadcast in blocks of bounded size, and every document is held against each block. For each document and item with
seeds in common, the longest matches that don't overlap tokens already marked are marked, longest first, down to MIN_MATCH
tokens; equally long ones are taken in the order of the item, then of the document. An item whose marked tokens reach THRESHOLD of
all of its tokens is found in the document, also if its parts stand there in another order.

Items of fewer than MIN_MATCH tokens are one seed as a whole. Defined results: null and empty texts contain nothing, items
without tokens are found nowhere; repeated items count once (the least id); repeated documents repeat; rows without
doc_id are searched like others; empty tables give an empty result; other columns are ignored here and passed through
by decontaminate().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import digest, documents, pieces, read_table, text_bytes, without_rows, written
from .texthash import LOWER, PUNCT, chain, span_hashes, spans

MIN_MATCH = 5
THRESHOLD = 0.8
#: Characters of benchmark items that are broadcast at once.
BLOCK_CHARS = 4_000_000


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' tokens, and where each row's begin (with the end)."""
    low = LOWER[buf]
    starts, ends, upto = spans(low, offsets, PUNCT)
    return span_hashes(low, starts, ends), np.concatenate(([0], upto))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n tokens in a row, by their start."""
    return chain(*[h[i : len(h) - n + 1 + i] for i in range(n)]) if len(h) >= n else h[:0]


class Items:
    """A block of the benchmark: the items' tokens and the seeds, sorted."""

    def __init__(self, ids: list[int], texts: list[str], min_match: int):
        buf, offsets = text_bytes(pa.array(texts, pa.string()))
        h, cuts = tokens(buf, offsets)
        self.n, self.ids = min_match, ids
        self.tokens = [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.by_length: dict[int, tuple] = {}
        for n in range(1, min_match + 1):
            seeds, owners, places = [], [], []
            for k, t in enumerate(self.tokens):
                if len(t) and min(len(t), min_match) == n:
                    w = windows(t, n)
                    seeds.append(w)
                    owners.append(np.full(len(w), k))
                    places.append(np.arange(len(w)))
            if seeds:
                seed, owner, place = np.concatenate(seeds), np.concatenate(owners), np.concatenate(places)
                order = np.argsort(seed, kind="stable")
                flags = np.zeros(1 << 16, bool)
                flags[(seed >> np.uint64(48)).astype(np.int64)] = True
                self.by_length[n] = (seed[order], owner[order], place[order], flags)


def tile(item: np.ndarray, doc: np.ndarray, p: np.ndarray, t: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in the item, place in the document, tokens). p, t: places of the seeds that both share."""
    free_p, free_t = np.ones(len(item), bool), np.ones(len(doc), bool)
    out = []
    # seeds in a row on one diagonal are one match; a match is as long as its run and the seed
    order = np.lexsort((p, t - p))
    p, t = p[order], t[order]
    new = np.concatenate(([True], (t[1:] - p[1:] != t[:-1] - p[:-1]) | (p[1:] != p[:-1] + 1)))
    begin = np.flatnonzero(new)
    found = [(int(n) + min_match - 1, int(p[b]), int(t[b])) for b, n in zip(begin, np.diff(np.append(begin, len(p))), strict=True)]
    buckets: dict[int, list[tuple[int, int]]] = {}
    for n, a, b in found:
        buckets.setdefault(n, []).append((a, b))
    left = len(item)
    while buckets and left:
        n = max(buckets)
        for a, b in sorted(buckets.pop(n)):
            fp, ft = free_p[a : a + n], free_t[b : b + n]
            ok = fp & ft
            if ok.all():
                fp[:] = ft[:] = False
                left -= n
                out.append((a, b, n))
                continue
            # what's still free of it goes back as shorter matches
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= min_match:
                    buckets.setdefault(e - s, []).append((a + s, b + s))
    return out


def search(h: np.ndarray, cuts: np.ndarray, items: Items, least: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, tokens of the item, tokens marked, tiles) for every row and item with shared seeds.

    Pairs whose seeds can't cover the share `least` of the item, even if no two overlapped, aren't tiled.
    """
    out = []
    for n, (seed, owner, place, flags) in items.by_length.items():
        w = windows(h, n)
        at = np.flatnonzero(flags[(w >> np.uint64(48)).astype(np.int64)])
        lo = np.searchsorted(seed, w[at])
        lo_ok = lo < len(seed)
        at, lo = at[lo_ok], lo[lo_ok]
        hit = seed[lo] == w[at]
        at, lo = at[hit], lo[hit]
        row = np.searchsorted(cuts, at, side="right") - 1
        inside = at + n <= cuts[row + 1]
        at, lo, row = at[inside], lo[inside], row[inside]
        if not len(at):
            continue
        times = np.searchsorted(seed, w[at], side="right") - lo
        src = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at, row = np.repeat(at, times), np.repeat(row, times)
        who, p = owner[src], place[src]
        order = np.lexsort((who, row))
        at, row, who, p = at[order], row[order], who[order], p[order]
        begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (who[1:] != who[:-1]))))
        for s, e in zip(begin.tolist(), np.append(begin[1:], len(row)).tolist(), strict=True):
            r, k = int(row[s]), int(who[s])
            item = items.tokens[k]
            if least and len(np.unique(p[s:e])) * n < least * len(item):
                continue
            tiles = tile(item, h[cuts[r] : cuts[r + 1]], p[s:e], at[s:e] - cuts[r], n)
            out.append((r, k, len(item), sum(x[2] for x in tiles), len(tiles)))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, block_chars: int = BLOCK_CHARS, least: float = 0.0, digests: bool = False) -> DataFrame:
    """doc_id, item_id, item_tokens, covered, tiles for every document and item with shared seeds, or only where they can
    cover the share `least` of the item."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_tokens long, covered long, tiles long" + ", digest binary" * digests
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[digest(F.col("text")).alias("digest")] * digests)
    out = None
    for block in blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            items = Items(*held.value, min_match)
            for batch in pieces(batches):
                h, cuts = tokens(*text_bytes(batch.column(1)))
                found = search(h, cuts, items, least)
                at = pa.array([x[0] for x in found], pa.int64())
                ids, own = batch.column(0).take(at), [c.take(at) for c in batch.columns[2:]]
                more = [pa.array([items.ids[x[1]] for x in found], pa.int64()), *[pa.array([x[i] for x in found], pa.int64()) for i in (2, 3, 4)]]
                yield pa.RecordBatch.from_arrays([ids, *more, *own], names=["doc_id", "item_id", "item_tokens", "covered", "tiles", "digest"][: 5 + len(own)])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """(ids, texts) of the distinct items, in blocks of bounded size."""
    distinct = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in distinct.orderBy("item_id").toLocalIterator():  # the stated query set, one block at a time
        if ids and size + len(r.text) > block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, digests: bool = False) -> DataFrame:
    """doc_id, item_id, item_tokens, covered, tiles, coverage of the items that documents contain; digests: and digest."""
    share = F.col("covered") / F.col("item_tokens")
    return matches(docs, benchmark, least=threshold, digests=digests).withColumn("coverage", share).where(F.col("coverage") >= threshold)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    found = written(leaks(docs, benchmark, threshold, True).select("doc_id", "digest").distinct(), "leaks")
    return without_rows(docs, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
