"""Removal of repeated byte strings by distributed prefix doubling.

A position's rank at a length names the bytes from there on: positions have equal ranks if that many bytes are equal. The first
ranks are hashes of START = LENGTH / 8 bytes. Each round doubles the length: position p's new rank is the name of the pair
(rank at p, rank at p + k), Spark groups and sorts the pairs, and positions of unique pairs drop out. Names are hashes of the bytes
instead of dense numbers, so that copies meet as one row a task and reranking needs no global order. Rounds, with LENGTH 400:

1. k = 50 and 2. k = 100, for anchors: of each window of LENGTH bytes one position, the leftmost with the least hash of
   LENGTH / 2 bytes of those that fit in. Equal windows have equal anchors, so a window whose anchor dropped out is
   unique. About one position in a hundred is an anchor. The second round also counts an anchor's surroundings, the bytes
   of all its windows: where they occur again as a whole, so do all of the windows, and no position of them is ranked singly.
3. k = 200, for all windows of the anchors whose rank occurs with different surroundings.

Every text is then read once more, and windows of repeated surroundings or pairs are removed. What decides that is compared as
128 bits of two independent hashes; the rounds before use 64, where equal hashes only mean that a position isn't dropped yet.
The sets of ranks that stay are sorted arrays in shared files, memory-mapped by the workers.

How many words LENGTH bytes hold depends on the language, so passages that repeat are also found by words, with the same rounds over
sequences of words ([^\\x20\\x09-\\x0D]+): every run of PASSAGE words that also begins anywhere else. Words are few beside
bytes, and go without the first round. Nothing is removed for them.

Defined results: null counts as empty; texts of fewer than LENGTH bytes lose nothing; overlapping occurrences in one text
count, so a run of one byte longer than LENGTH loses all; repeated rows are different documents and so repeat each other;
an empty table gives an empty result; long texts are handled in overlapping parts; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, drop_path, pieces, text_bytes, written
from .store import Sets, write_set
from .texthash import WHITE, U, chain, mix, span_hashes, spans

LENGTH = 400
#: Words of a passage: over 50.
PASSAGE = 51
#: Bytes of a text that are handled at once, besides an overlap.
PART = 4 << 20
#: Bytes of short texts that are handled at once.
PIECE = 1 << 19

#: Bases of the two hashes.
_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 16)
        _tables.clear()
        for base in _BASES:
            for b in (base, pow(base, -1, 1 << 64)):
                t = np.full(size, b, U)
                t[0] = 1
                _tables.append(np.cumprod(t, dtype=U))
    return [t[:n] for t in _tables]


def lengths(length: int) -> list[int]:
    """The lengths of the ranks, each half of the next one (rounded up)."""
    out = [length]
    while len(out) < 4 and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w in a row."""
    n = len(h)
    if n < w:
        return h[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(h.dtype).max, h.dtype)
    padded[:n] = h
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Ranks:
    """The texts laid end to end in buf: ranks of positions, and the windows' anchors."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, words: bool = False):
        self.length, self.lengths = length, lengths(length)
        #: The level of the anchors' ranks; those of words are shorter, so that there are fewer of them.
        self.level = min(1, len(self.lengths) - 2) if words else len(self.lengths) - 2
        self.buf = buf
        self.sums: list[np.ndarray | None] = [None, None]
        size, n = self.lengths[self.level], len(buf)
        sums, inverse = self._sum(0)
        self.least = mix((sums[size:] - sums[: n + 1 - size]) * inverse[: n + 1 - size]) if n >= size else np.zeros(0, U)
        # windows that lie within a text
        sizes = np.diff(offsets)
        fit = np.maximum(sizes - length + 1, 0)
        self.valid = np.flatnonzero(fit)
        self.lo, self.hi = offsets[:-1][self.valid], offsets[:-1][self.valid] + fit[self.valid]  # starts of windows: [lo, hi)
        self._find(length - size + 1)

    def _sum(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the k-th hash, and the powers of its inverse."""
        n = len(self.buf)
        powers = _powers(n + 1)
        if self.sums[k] is None:
            self.sums[k] = np.zeros(n + 1, U)
            np.cumsum((self.buf + U(1)) * powers[2 * k][:n], out=self.sums[k][1:])
        return self.sums[k], powers[2 * k + 1]

    def _find(self, w: int) -> None:
        """anchor, first, last: windows from first to last have that anchor, one of the w positions from a window's start on."""
        least = sliding_min(self.least, w)
        if not len(self.lo):
            self.anchor = self.first = self.last = np.zeros(0, np.int64)
            return
        inside = np.zeros(len(least) + 1, np.int8)
        np.add.at(inside, self.lo, 1)
        np.add.at(inside, self.hi, -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        new = inside.copy()
        new[1:] &= least[1:] != least[:-1]
        new[self.lo] = True
        first = np.flatnonzero(new)
        stop = inside.copy()
        stop[:-1] &= new[1:] | ~inside[1:]
        last = np.flatnonzero(stop)
        # where the least gets less within a text, it's the position that has just come in
        entered = least[first] < least[np.maximum(first - 1, 0)]
        entered[np.searchsorted(first, self.lo)] = False
        anchor = first + w - 1
        found = []
        while len(first):
            search = np.flatnonzero(~entered)
            for at in range(0, len(search), 4096):
                rows = first[search[at : at + 4096]]
                anchor[search[at : at + 4096]] = rows + self.least[rows[:, None] + np.arange(w)].argmin(axis=1)
            found.append((anchor, first, np.minimum(last, anchor)))
            more = last > anchor  # the same rank again further right
            first, last = anchor[more] + 1, last[more]
            entered, anchor = np.zeros(len(first), bool), np.zeros(len(first), np.int64)
        self.anchor, self.first, self.last = (np.concatenate(x) for x in zip(*found, strict=True))

    def hashes(self, begin: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """The k-th hash of the bytes from begin to end."""
        sums, inverse = self._sum(k)
        return mix((sums[end] - sums[begin]) * inverse[begin])

    def rank(self, at: np.ndarray, level: int, k: int = 0) -> np.ndarray:
        """The positions' ranks at a level of the lengths: names of the pairs of ranks at the level below, these being hashes
        of their bytes."""
        if not level:
            return self.hashes(at, at + self.lengths[0], k)
        below = self.lengths[level - 1]
        second = at + self.lengths[level] - below
        return chain(self.hashes(at, at + below, k), self.hashes(second, second + below, k))

    def classes(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name these anchors with the bytes of all their windows."""
        first, end = self.first[some], self.last[some] + self.length
        shape = ((end - first) << 20 | (self.anchor[some] - first)).astype(U)
        return tuple(chain(self.hashes(first, end, k), shape) for k in (0, 1))

    def doubled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name the pairs of ranks at the last offset."""
        return tuple(self.rank(at, len(self.lengths) - 1, k) for k in (0, 1))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the chosen anchors, and the place of each one's anchor in chosen."""
        first, sizes = self.first[chosen], self.last[chosen] - self.first[chosen] + 1
        of = np.repeat(np.arange(len(sizes)), sizes)
        return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(of)), of


def word_sequence(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' words laid end to end, and the offsets of the texts in them."""
    starts, ends, upto = spans(buf, offsets, WHITE)
    return span_hashes(buf, starts, ends), np.concatenate(([0], upto))


def parts(batches, length: int, words: bool = False):
    """(batch, buf, offsets, skip) of pieces, buf of bytes or words; a long text comes alone, in parts that share length - 1 of
    them, with its own number of the part as skip (None for pieces of whole texts)."""
    for batch in pieces(batches, limit=PIECE):
        buf, offsets = text_bytes(batch.column(1))
        if words:
            buf, offsets = word_sequence(buf, offsets)
        for part, cuts, k in _cut(buf, offsets, length):
            yield batch, part, cuts, k


def _cut(buf: np.ndarray, offsets: np.ndarray, length: int):
    if len(buf) <= 2 * PART or len(offsets) > 2:
        yield buf, offsets, None
        return
    for k, at in enumerate(range(0, len(buf) - length + 1, PART)):
        part = buf[at : at + PART + length - 1]
        yield part, np.array([0, len(part)]), k


def _counted(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (the place of one of each, and which one each pair is) and how often they occur."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    begin = np.flatnonzero(new)
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[begin], which, np.bincount(which, weights=weight, minlength=len(begin)).astype(np.int64)


def _record(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=names.split())


def _first(length: int):
    """Round 1: the anchors' pairs."""

    def run(batches):
        for _, buf, offsets, _ in parts(batches, length):
            r = Ranks(buf, offsets, length)
            u, n = np.unique(r.rank(r.anchor, min(1, len(r.lengths) - 2)), return_counts=True)
            yield _record("rank n", u, n)

    return run


def _left(r: Ranks, ranks: Sets | None) -> np.ndarray:
    """The anchors that round 1 left; all without one."""
    if ranks is None:
        return np.arange(len(r.anchor))
    return np.flatnonzero(ranks.has(r.rank(r.anchor, min(1, len(r.lengths) - 2))))


def _second(length: int, first: tuple | None, words: bool):
    """Round 2: the pairs of the anchors that are left, with their surroundings."""

    def run(batches):
        ranks = Sets(*first) if first else None
        for _, buf, offsets, _ in parts(batches, length, words):
            r = Ranks(buf, offsets, length, words)
            some = _left(r, ranks)
            c1, c2 = r.classes(some)
            at, _, n = _counted(c1, c2)
            yield _record("rank c1 c2 n", r.rank(r.anchor[some[at]], r.level), c1[at], c2[at], n)

    return run


def _third(length: int, again: tuple, whole: tuple, words: bool):
    """Round 3: the pairs of all windows of the anchors that are left."""

    def run(batches):
        ranks, classes = Sets(*again), Sets(*whole)
        for _, buf, offsets, _ in parts(batches, length, words):
            r = Ranks(buf, offsets, length, words)
            chosen = np.flatnonzero(ranks.has(r.rank(r.anchor, r.level)))
            c1, c2 = r.classes(chosen)
            full = classes.has(c1, c2)
            # surroundings that occur again are ranked once a piece, and count as two
            at, _, _ = _counted(c1, c2)
            single = np.zeros(len(c1), bool)
            single[at] = True
            take = ~full | single
            chosen, full = chosen[take], full[take]
            for k in range(0, len(chosen), 8192):
                p, of = r.windows(chosen[k : k + 8192])
                h1, h2 = r.doubled(p)
                at, _, n = _counted(h1, h2, full[k : k + 8192][of] + 1.0)
                yield _record("p1 p2 n", h1[at], h2[at], n)

    return run


def _covered(r: Ranks, n: int, first: Sets | None, ranks: Sets, classes: Sets, doubles: Sets) -> np.ndarray:
    """For each byte: how many repeated windows begin there, less those that ended."""
    change = np.zeros(n + 1, np.int32)
    some = _left(r, first)
    full = classes.has(*r.classes(some))
    np.add.at(change, r.first[some[full]], 1)
    np.add.at(change, r.last[some[full]] + r.length, -1)
    rest = some[~full]
    rest = rest[ranks.has(r.rank(r.anchor[rest], r.level))]
    for k in range(0, len(rest), 8192):
        p, _ = r.windows(rest[k : k + 8192])
        p = p[doubles.has(*r.doubled(p))]
        np.add.at(change, p, 1)
        np.add.at(change, p + r.length, -1)
    return change


def _gone(buf: np.ndarray, offsets: np.ndarray, length: int, sets: list, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes or words repeated windows cover, and of each text how many and in how many runs."""
    change = np.zeros(len(buf) + 1, np.int32)
    for part, cuts, k in _cut(buf, offsets, length):
        at = (k or 0) * PART
        change[at : at + len(part) + 1] += _covered(Ranks(part, cuts, length, words), len(part), *sets)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begin = gone.copy()
    begin[1:] &= ~gone[:-1] | edge[1 : len(buf)]
    return gone, _per_text(gone, offsets), _per_text(begin, offsets)


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks each text has."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(marks.view(np.int8), offsets[some], dtype=np.int32)
    return out


def _removal(length: int, found: tuple, passage: int, found_words: tuple | None, texts: bool):
    def run(batches):
        sets, of_words = ([x and Sets(*x) for x in f or ()] for f in (found, found_words))
        for batch in pieces(batches, limit=PIECE):
            buf, offsets = text_bytes(batch.column(1))
            gone, n, runs = _gone(buf, offsets, length, sets)
            kept = [(buf[a:b][~gone[a:b]] if k else buf[a:b]).tobytes() for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n.tolist(), strict=True)]
            cols = [batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(runs)]
            cols.append(pa.array(kept, pa.binary()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"]
            if found_words:
                _, n, runs = _gone(*word_sequence(buf, offsets), passage, of_words, True)
                cols, names = [*cols, pa.array(n), pa.array(runs)], [*names, "n_repeated_words", "n_passages"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _repeated(rows: DataFrame, length: int, words: bool) -> tuple:
    """The sets of the rounds: of the first (None for words), ranks with different surroundings, repeated surroundings, repeated pairs."""
    spark, first = rows.sparkSession, None
    if not words:
        pairs = rows.mapInArrow(_first(length), "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).where("n > 1")
        pairs = written(pairs.select("rank"), "pairs")
        first = write_set(pairs, ["rank"], "round1")
        drop_path(spark, pairs._lexiloom_path)
    # an anchor's rank and its surroundings, with how often these occur
    seen = written(rows.mapInArrow(_second(length, first, words), "rank long, c1 long, c2 long, n long").groupBy("rank", "c1", "c2").agg(F.sum("n").alias("n")), "anchors")
    again = write_set(seen.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1"), ["rank"], "round2")
    whole = write_set(seen.where("n > 1").select("c1", "c2").distinct(), ["c1", "c2"], "surroundings")
    drop_path(spark, seen._lexiloom_path)
    pairs = rows.mapInArrow(_third(length, again, whole, words), "p1 long, p2 long, n long").groupBy("p1", "p2").agg(F.sum("n").alias("n")).where("n > 1")
    pairs = written(pairs.select("p1", "p2"), "pairs")
    twice = write_set(pairs, ["p1", "p2"], "round3")
    drop_path(spark, pairs._lexiloom_path)
    return first, again, whole, twice


def removed(docs: DataFrame, length: int = LENGTH, texts: bool = False, passage: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary, with texts) or kept_sha256 of every document; with a passage's number of
    words, also n_repeated_words and n_passages (runs of such words)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _repeated(rows, length, False)
    found_words = _repeated(rows, passage, True) if passage else None
    last = ("kept binary" if texts else "kept_sha256 string") + (", n_repeated_words long, n_passages long" if passage else "")
    return rows.mapInArrow(_removal(length, found, passage, found_words, texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir), passage=PASSAGE)
