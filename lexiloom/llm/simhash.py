"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case, 3-word shingles with repeats, XXH64 (seed 42)
of each; a bit is set if it is set in over half the hashes. Two texts link at RADIUS or fewer differing bits.

Covering masks: every bit i has a vector m(i) of GF(2)^(RADIUS+1); the mask of v != 0 holds the bits with <m(i), v> = 1.
The vectors of up to RADIUS differing bits span no more than RADIUS dimensions, so some v is orthogonal to them all, and
the pair agrees under that mask: 15 tables find every pair for a radius of 3, for certain. Tables hold distinct
fingerprints only. A bucket never emits its pairs: it's reduced in place to a spanning forest of its own links. Small
buckets compare neighbours by offset; larger ones search breadth-first; the largest link x and y at distance 3 or less through
a word z within 1 bit of one and 2 of the other, which takes time and rows in proportion to the bucket. The forests meet
in components().

Defined results: null and empty texts have fingerprint zero and link like any other; texts of one or two words are one
shingle; rows without doc_id get a fingerprint, and component null if nothing with an id is linked (ids are below 2**62); repeated rows repeat;
an empty table gives an empty result; other columns are ignored here and passed through by deduplicate().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import digest, documents, pieces, small, text_bytes, without_rows, written
from .components import components

RADIUS = 3
BITS = 64
#: Buckets of more rows are searched breadth-first, and of more than the second number through words between.
SMALL, LARGE = 32, 4096
#: Bytes of a long text that are split into words at once.
PART = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as unsigned numbers."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if bin((1 + i % vectors) & v).count("1") % 2) for v in range(1, vectors + 1)]


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every three words in a row."""
    if len(words) < 3:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-3])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[2:] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, part: int = PART) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned number. Long texts are split into words a part at a time."""
    total, n, last, at = np.zeros(BITS, np.int64), 0, [], 0
    while at < len(text):
        to = len(text)
        if to - at > part and (gap := _GAP.search(text, at + part)):
            to = gap.start()
        words = last + text[at:to].lower().split()  # bytes: ASCII only, in both
        hashes = shingle_hashes(words)
        for k in range(0, len(hashes), 1 << 16):
            total += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n, last, at = n + len(hashes), words[-2:], to
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(last), 42) if last else 0
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in pieces(batches):
        buf, offsets = text_bytes(batch.column(1))
        raw = buf.tobytes()
        out = np.array([fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", "digest"][: batch.num_columns])


def fingerprints(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, fp (long) of every row; digests: and digest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[digest(F.col("text")).alias("digest")] * digests)
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long" + ", digest binary" * digests)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all rows that the links a-b join the least of their labels; a label is a row's number."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        low = np.minimum(x, y)
        np.minimum.at(labels, np.maximum(x, y), low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def link_bucket(fps: np.ndarray, radius: int = RADIUS, large: int = LARGE) -> np.ndarray:
    """For the distinct fingerprints of a bucket: the number of the first one that links lead to."""
    n = len(fps)
    labels = np.arange(n)
    if n <= large:
        left = np.arange(n)
        while len(left):
            root, left = left[0], left[1:]
            queue = [root]
            while queue and len(left):
                near = _near(fps[left], fps[queue.pop()], radius)
                if near.any():
                    labels[left[near]] = root
                    queue.extend(left[near].tolist())
                    left = left[~near]
        return labels
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    ones = [1 << i for i in range(BITS) if free >> i & 1]
    close, far = radius // 2, radius - radius // 2  # 1 and 2: any pair within 3 has a word between
    flips = [[0]]
    for _ in range(far):
        flips.append(sorted({f ^ o for f in flips[-1] for o in ones} | set(flips[-1])))
    table = np.concatenate([fps ^ np.uint64(f) for f in flips[close]])
    owner = np.tile(np.arange(n), len(flips[close]))
    order = np.argsort(table, kind="stable")
    table, owner = table[order], owner[order]
    first = np.concatenate(([True], table[1:] != table[:-1]))
    table, owner = table[first], owner[first]
    for f in flips[far]:
        z = fps ^ np.uint64(f)
        at = np.minimum(np.searchsorted(table, z), len(table) - 1)
        hit = np.flatnonzero(table[at] == z)
        _merge(labels, hit, owner[at[hit]])
    return labels


def _forest(v: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the buckets in these sorted rows join, one per row at most."""
    n = len(v)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (key[1:] != key[:-1])))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [n])))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    labels = np.arange(n)
    most = min(int(sizes.max()), SMALL)
    for k in range(1, most):
        a = np.arange(n - k)
        a = a[(bucket[a] == bucket[a + k]) & (sizes[bucket[a]] <= SMALL)]
        a = a[_near(fp[a], fp[a + k], radius)]
        _merge(labels, a, a + k)
    for g in np.flatnonzero(sizes > SMALL):
        s, e = starts[g], starts[g] + sizes[g]
        labels[s:e] = s + link_bucket(fp[s:e], radius)
    linked = np.flatnonzero(labels != np.arange(n))
    return rep[linked], rep[labels[linked]]


def _links(radius: int):
    def run(batches):
        kept = None  # the last bucket may go on in the next batch
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            n = len(cols[0])
            if not n:
                continue
            last = n - 1 - int(np.argmax((cols[0][::-1] != cols[0][-1]) | (cols[1][::-1] != cols[1][-1])) or n) + 1
            kept = [c[max(last, 0) :].copy() for c in cols]
            if last > 0:
                yield out(*[c[:last] for c in cols])
        if kept is not None:
            yield out(*kept)

    def out(v, key, fp, rep):
        a, b = _forest(v, key, fp.view(np.uint64), rep, radius)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def near_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """classes: fp, rep (long). Links u, v between representatives that join what pairs within the radius join."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("t")
    rows = classes.select("fp", "rep", tables).select("t.v", "t.key", "fp", "rep")
    return rows.repartition("v", "key").sortWithinPartitions("v", "key").mapInArrow(_links(radius), "u long, v long")


#: From here on: components of classes without any id, so that ids are always less.
NONE = 1 << 62


def linked(docs: DataFrame, radius: int = RADIUS, digests: bool = False) -> DataFrame:
    """The fingerprints with their component."""
    fps = written(fingerprints(docs, digests), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NONE) + F.xxhash64("fp").bitwiseAND(F.lit(NONE - 1))).alias("rep")), "classes")
    roots = components(near_links(classes, radius))
    found = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(found, "fp")


def near_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (hex), component_id (the least doc_id that links lead to)."""
    return linked(docs, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") < NONE, F.col("component_id")).alias("component_id"),
    )


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates, the one of the least doc_id and digest, with all its columns; rows without id
    only stay if no row of the group has one. Rows that repeat both doc_id and text stay together."""
    found = written(linked(docs, radius, True).select(F.struct(F.col("doc_id").isNull(), "doc_id", "digest").alias("row"), "component_id"), "near")
    least = found.groupBy("component_id").agg(F.min("row").alias("kept"), F.count("*").alias("n")).where("n > 1").select("component_id", "kept")
    gone = found.join(small(written(least, "least")), "component_id").where(~F.col("row").eqNullSafe(F.col("kept"))).select("row.doc_id", "row.digest")
    return without_rows(docs, written(gone, "gone"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))
