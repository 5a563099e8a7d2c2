"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays that workers memory-map.

Tokens of a text: its words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one end. Words are counted first, and get numbers, small
ones for frequent words. N-grams are counted as sequences of numbers, from the highest order down to single words. At each
order a task sorts and sums what it has read, and sends per shard one packed row (columns of numbers, by byte planes,
compressed). A shard's task merges those rows, writes the order's arrays to the shared folder, and sends on, packed likewise, how many
different words stand before what remains without the first word: the continuation counts of the next lower order. Shards go by
a hash of the context, except that the following words of contexts that are very frequent words (at most HOT_LIMIT of
them) are spread over all shards, and those contexts' totals are summed after that. Beyond 2**COARSE shards tasks send to groups
of shards first, and these deal out to their shards, so that packed rows don't become many and tiny.

An order's arrays in a shard: sorted hashes of n-grams with their counts, and sorted hashes of contexts with what the counts after
them sum up to and how many of these are 1, 2 and more. A directory by the hashes' first bits, some PER_BUCKET to an entry, leaves
32 bits of each to store; the shard's CODES - 1 most frequent values are a byte each, others a list beside. Words have all 64
bits. Each shard has all its files, also if they're empty: a missing one fails.

The discounts D1, D2, D3+ come from the counts of counts of each order (Chen and Goodman, 1999), 0.5, 1 and 1.5 where
those are zero. Single words interpolate with 1 / (V + 1). What the model gathers grows with the distinct n-grams.

Defined results: null and empty texts are one end token; an empty training set scores every token 1 / (V + 1) with
V = 0, that is 0; rows without doc_id train like others (crc32 of the empty text); repeated rows count as often as they
stand there; an empty table gives an empty result; long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, drop_path, pieces, shared_path, text_bytes, written
from .store import map_file, write_file
from .texthash import LOWER, U, WHITE, chain, mix, span_hashes, spans

ORDER = 3
#: Bytes of text per shard of the counts.
SHARD_BYTES = 8 << 20
#: Shards up to which tasks send to each, as a power of two; and tasks that write shards.
COARSE = 12
WRITERS = 16
#: A word is spread over the shards if it occurs so often, or so great a share's worth of times.
HOT_COUNT = 200_000
HOT_LIMIT = 20_000
#: Tokens that a task sorts at once.
FLUSH = 1_000_000
#: Hashes to an entry of a directory, and codes of values.
PER_BUCKET = 8
CODES = 256
#: Bits of each number of a value that may get a code, by how many numbers a value has.
SMALL = {1: (14,), 2: (7, 7), 4: (4, 4, 3, 3)}

END = U(0x656E642D6F662D74)
#: Numbers of what stands before a text, and of unknown words; words have 1 and more.
BEGIN, UNKNOWN = U(0), U((1 << 64) - 1)
_SALT = U(0x6C6578696C6F6F6D)


def sequences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of all rows, ends included, and where each row's begin (with the end)."""
    low = LOWER[buf]
    starts, ends, upto = spans(low, offsets, WHITE)
    h = span_hashes(low, starts, ends)
    rows = len(upto)
    out = np.empty(len(h) + rows, U)
    cuts = np.concatenate(([0], upto)) + np.arange(rows + 1)
    last = cuts[1:] - 1
    words = np.ones(len(out), bool)
    words[last] = False
    out[words] = h
    out[last] = END
    return out, cuts


def before(numbers: np.ndarray, cuts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the numbers of the order - 1 tokens before it, the farthest first."""
    place = np.arange(len(numbers)) - np.repeat(cuts[:-1], np.diff(cuts))
    back = []
    for k in range(order - 1, 0, -1):
        b = np.zeros_like(numbers)
        b[k:] = numbers[:-k] if k < len(numbers) else numbers[:0]
        b[place < k] = BEGIN
        back.append(b)
    return back


def context(numbers: list[np.ndarray]) -> np.ndarray:
    """A hash of the context that consists of these words."""
    return chain(mix(numbers[0] + _SALT), *numbers[1:])


def shards(ctx: np.ndarray, word: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(ctx), np.int64)
    by = ctx
    if len(hot):
        spread = hot[np.minimum(np.searchsorted(hot, ctx), len(hot) - 1)] == ctx
        by = np.where(spread, chain(ctx, word), ctx)
    return (by >> U(64 - bits)).astype(np.int64)


# columns of numbers


def summed(cols: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns as one row, in order; n (or 1 for each) summed."""
    if not len(cols[0]):
        return cols, np.zeros(0, np.int64)
    sizes = [int(c.max()).bit_length() for c in cols]
    keys: list[np.ndarray] = []
    room = 0
    for c, size in zip(cols, sizes, strict=True):  # as many columns in one number as fit
        if keys and size <= room:
            keys[-1] <<= U(size)
            keys[-1] |= c
            room -= size
        else:
            keys.append(c.astype(U))
            room = 64 - size
    if n is None and len(keys) == 1:
        (key,) = keys
        key.sort()
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n, key = np.diff(np.append(at, len(key))), key[at]
        out = []
        for size in sizes[::-1]:
            out.append(key & U((1 << size) - 1))
            key = key >> U(size) if size < 64 else key
        return out[::-1], n
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    total = np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at)
    return [c[order[at]].astype(U) for c in cols], total


def squeeze(x: np.ndarray) -> bytes:
    """The numbers by byte planes, compressed."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(x), width], "<u4").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expand(data: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(data, "<u4", 2))
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack(cols: list[np.ndarray], n: np.ndarray) -> list[bytes]:
    """Columns of rows in order, the first one's differences, and the counts that aren't 1."""
    more = np.flatnonzero(n > 1)
    return [squeeze(x) for x in (np.diff(cols[0], prepend=U(0)), *cols[1:], np.diff(more, prepend=0), n[more])]


def unpack(data: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    first, *cols = (expand(x) for x in data)
    more, many = cols[-2:]
    n = np.ones(len(first), np.int64)
    n[np.cumsum(more).astype(np.int64)] = many
    return [np.cumsum(first, dtype=U), *cols[:-2]], n


PACKED = "kind string, shard int, cols array<binary>, a long, b long, c long, d long, e long"
_SCHEMA = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("cols", pa.list_(pa.binary())), *[(x, pa.int64()) for x in "abcde"]])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{k: r.get(k) for k in _SCHEMA.names} for r in rows], _SCHEMA)


def _send(kind: str, cols: list[np.ndarray], n: np.ndarray, of: np.ndarray):
    """Packed rows of summed counts, one for each of the shards that the rows are of."""
    order = np.argsort(of.astype(np.uint16) if len(of) and of.max() < 1 << 16 else of, kind="stable")
    of = of[order]
    cols, n = [c[order] for c in cols], n[order]
    edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    rows = [{"kind": kind, "shard": int(of[a]), "cols": pack([c[a:b] for c in cols], n[a:b])} for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    if rows:
        yield _batch(rows)


class Deal:
    """How rows go to shards: words by their hash, grams by their context, numbers of words to the shard of the word."""

    def __init__(self, kind: str, bits: int, hot: np.ndarray | None = None):
        self.kind, self.bits, self.hot = kind, bits, np.zeros(0, U) if hot is None else hot
        self.coarse = min(bits, COARSE)

    def send(self, cols: list[np.ndarray], n: np.ndarray, coarse: bool = True):
        bits = self.bits
        if self.kind == "word":
            of = (cols[0] >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(n), np.int64)
        elif self.kind == "number":
            of = ((cols[0] - U(1)) & U((1 << bits) - 1)).astype(np.int64)
        else:
            of = shards(context(cols[:-1]), cols[-1], bits, self.hot)
        return _send("next", cols, n, of >> (bits - self.coarse) if coarse else of)

    def refine(self, batches):
        """From groups of shards to shards."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.column(2).to_pylist():
                held.append(unpack(row))
                size += len(held[-1][1])
                if size >= FLUSH:
                    yield from self.send(*_merged(held), coarse=False)
                    held, size = [], 0
        if held:
            yield from self.send(*_merged(held), coarse=False)


def _merged(parts: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    return summed([np.concatenate(x) for x in zip(*[c for c, _ in parts], strict=True)], np.concatenate([n for _, n in parts]))


def _few(bits: int) -> int:
    """Tasks that write shards, as a power of two: some shards each, so that tables have fewer files."""
    return min(max(0, bits - 2), WRITERS)


def _at_writers(df: DataFrame, bits: int) -> DataFrame:
    """Rows at the task that writes their shard, in order."""
    few = _few(bits)
    return df.repartitionById(1 << few, F.shiftright("shard", bits - few)).sortWithinPartitions("shard")


def _by_shard(df: DataFrame, deal: Deal, write) -> DataFrame:
    """write(shard, columns, n) gives the batches of each shard; shards without rows have their turn too."""
    bits = deal.bits
    if bits > deal.coarse:
        df = df.select("kind", "shard", "cols").repartitionById(1 << deal.coarse, F.col("shard")).mapInArrow(deal.refine, PACKED)
    few = _few(bits)

    def run(batches):
        task = TaskContext.get().partitionId()
        now, last = task << (bits - few), (task + 1) << (bits - few)
        held: list[tuple] = []

        def done(upto: int):
            nonlocal now, held
            while now < upto:
                cols, n = _merged(held) if held else ([], np.zeros(0, np.int64))
                held = []
                yield from write(now, cols, n)
                now += 1

        for batch in batches:
            for shard, cols in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield from done(shard)
                held.append(unpack(cols))
        yield from done(last)

    return _at_writers(df, bits).mapInArrow(run, PACKED)


# files


def least(x: np.ndarray) -> np.ndarray:
    """The numbers in as few bytes as hold each."""
    most = int(x.max(initial=0))
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * np.dtype(t).itemsize))


def laid_out(tables: list[list[np.ndarray]]) -> bytes:
    """Tables of arrays as a file: for each array its place, length and bytes a number; then the arrays."""
    flat = [x for t in tables for x in t]
    head = np.zeros((len(flat), 3), "<u8")
    at = head.nbytes
    body = []
    for i, x in enumerate(flat):
        head[i] = at, x.size, x.itemsize
        body += [x.tobytes(), b"\0" * (-x.nbytes % 8)]
        at += x.nbytes + -x.nbytes % 8
    return b"".join([head.tobytes(), *body])


def arrays(data: np.ndarray, count: int) -> list[np.ndarray]:
    """The file's arrays, which must be there to the end."""
    name = getattr(data, "filename", "a file")
    data = data.view(np.ndarray)
    head = data[: 24 * count].view("<u8").reshape(count, 3)
    out = []
    for at, size, width in head.tolist():
        if at + size * width > len(data):
            raise ValueError(f"{name} is cut off")
        out.append(data[at : at + size * width].view(f"<u{width}"))
    return out


def table(hashes: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """A sorted array of hashes as directory and what's left of each; the values (some numbers for each) as codes, what the codes
    mean, and places and values of those without a code."""
    h = mix(hashes ^ _SALT)
    order = np.argsort(h)
    h, values = h[order], values[order]
    bits = max(0, (len(h) // PER_BUCKET).bit_length())
    ends = np.searchsorted(h >> U(64 - bits), np.arange(1 << bits, dtype=U), side="right") if bits else np.array([len(h)])
    rest = np.append(h << U(bits) >> U(32), U(0)).astype("<u4")  # and one more, so that looking behind the last is allowed
    # values whose numbers fit in a few bits, in one number; the most frequent of these get codes
    sizes = SMALL[values.shape[1]]
    small, which = np.ones(len(h), bool), np.zeros(len(h), np.int64)
    for c, size in zip(values.T, sizes, strict=True):
        small &= c < 1 << size
        which = which << size | c
    which[~small] = 0
    often = np.bincount(which[small], minlength=1 << sum(sizes))
    most = np.argsort(-often, kind="stable")[: CODES - 1]
    most = most[often[most] > 0]
    code = np.full(len(often), CODES - 1, np.uint8)
    code[most] = np.arange(len(most))
    codes = np.where(small, code[which], np.uint8(CODES - 1))
    others = np.flatnonzero(codes == CODES - 1)
    means = [most >> sum(sizes[i + 1 :]) & (1 << size) - 1 for i, size in enumerate(sizes)]
    return [least(np.concatenate(([0], ends))), rest, codes, least(np.stack(means, axis=1).ravel()), least(others), least(values[others].ravel())]


def look_up(found: list[np.ndarray], hashes: np.ndarray, width: int, derive) -> np.ndarray:
    """What derive makes of the hashes' values (rows of width numbers), or of a row of zeros for hashes that aren't there."""
    ends, rest, codes, meaning, others, other_values = found
    means = np.zeros((CODES, width))
    means[: len(meaning) // width] = meaning.reshape(-1, width)
    means = derive(means)
    if len(rest) < 2:
        return np.repeat(means[-1:], len(hashes), axis=0)
    h = mix(hashes ^ _SALT)
    bits = (len(ends) - 1).bit_length() - 1
    bucket = (h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    q = (h << U(bits) >> U(32)).astype("<u4")
    index = np.int32 if len(rest) < 1 << 31 else np.int64
    lo, hi = ends[bucket].astype(index), ends[bucket + 1].astype(index)
    end = hi
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (rest[mid] < q) & (lo < hi)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    hit = (rest[lo] == q) & (lo < end)
    lo[~hit] = 0
    code = codes[lo]
    code[~hit] = CODES - 1  # zeros, also for what has no code, until that is looked up
    got = means[code]
    if len(others) and len(some := np.flatnonzero(hit & (codes[lo] == CODES - 1))):
        got[some] = derive(other_values.reshape(-1, width)[np.searchsorted(others, lo[some])].astype(float))
    return got


class Vocabulary:
    """Words' numbers, counts and continuation counts."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.words: dict[int, list[np.ndarray]] = {}
        self.following: dict[int, np.ndarray] = {}

    def find(self, hashes: np.ndarray, following: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Numbers and counts of words, whose hashes are sorted; following: and continuation counts."""
        number, n = np.full(len(hashes), UNKNOWN), np.zeros(len(hashes), np.int64)
        after = np.zeros(len(hashes), np.int64) if following else None
        of = (hashes >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            shard = int(of[a])
            if shard not in self.words:
                self.words[shard] = arrays(map_file(f"{self.folder}/word-{shard}", np.uint8), 3)
            keys, counts, ranks = self.words[shard]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
            some = np.flatnonzero(keys[at] == hashes[a:b])
            at = at[some]
            n[a + some] = counts[at]
            rank = ranks[at].astype(U)
            number[a + some] = (rank << U(self.bits) | U(shard)) + U(1)
            if following:
                if shard not in self.following:
                    (self.following[shard],) = arrays(map_file(f"{self.folder}/next-{shard}", np.uint8), 1)
                after[a + some] = self.following[shard][rank.astype(np.int64)]
        return number, n, after


# counting


def _count_words(deal: Deal):
    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for batch in pieces(batches):
            tokens, _ = sequences(*text_bytes(batch.column(0)))
            held.append(tokens)
            size += len(tokens)
            if size >= FLUSH:
                yield from deal.send(*summed([np.concatenate(held)]))
                held, size = [], 0
        if size:
            yield from deal.send(*summed([np.concatenate(held)]))

    return run


def _count_grams(order: int, folder: str, deal: Deal):
    def counted(words: Vocabulary, parts: list[tuple]):
        u, inverse = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        number, by = np.unique(words.find(u)[0], return_inverse=True)
        local = (by + 1).astype(np.uint32)[inverse]  # numbers within these texts
        del inverse
        ends = np.concatenate([c[1:] + x for (_, c), x in zip(parts, np.cumsum([0, *[len(t) for t, _ in parts[:-1]]]), strict=True)])
        cuts = np.concatenate(([0], ends))
        cols, n = summed([*before(local, cuts, order), local])
        number = np.concatenate(([BEGIN], number))
        return deal.send([number[c.astype(np.int64)] for c in cols], n)

    def run(batches):
        words = Vocabulary(folder, deal.bits)
        held: list[tuple] = []
        size = 0
        for batch in pieces(batches):
            held.append(sequences(*text_bytes(batch.column(0))))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield from counted(words, held)
                held, size = [], 0
        if size:
            yield from counted(words, held)

    return run


def _tallies(n: np.ndarray) -> dict:
    """How many counts are 1, 2, 3 and 4, and the counts' sum."""
    low = np.bincount(np.minimum(n, 5), minlength=6)
    return {"a": int(low[1]), "b": int(low[2]), "c": int(low[3]), "d": int(low[4]), "e": int(n.sum())}


def _write_words(folder: str, bits: int, hot_from: int):
    def write(shard: int, cols: list[np.ndarray], n: np.ndarray):
        words = cols[0] if cols else np.zeros(0, U)
        rank = np.empty(len(n), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
        write_file(f"{folder}/word-{shard}", laid_out([[words, least(n), least(rank)]]))
        often = np.flatnonzero(n >= hot_from)
        yield _batch([{"kind": "tally", "shard": len(words), **_tallies(n)}, *[{"kind": "hot", "a": (int(r) << bits | shard) + 1} for r in rank[often]]])

    return write


def _write_next(folder: str, bits: int):
    def write(shard: int, cols: list[np.ndarray], n: np.ndarray):
        words = arrays(map_file(f"{folder}/word-{shard}", np.uint8), 3)[0]
        by_rank = np.zeros(len(words), np.int64)
        if cols:
            by_rank[((cols[0] - U(1)) >> U(bits)).astype(np.int64)] = n
        write_file(f"{folder}/next-{shard}", laid_out([[least(by_rank)]]))
        yield _batch([{"kind": "tally", "shard": len(n), **_tallies(n)}])

    return write


#: Tables of an order's file.
GRAM, CTX = range(2)


def _write_grams(folder: str, level: int, hot: np.ndarray, below: Deal):
    def write(shard: int, cols: list[np.ndarray], n: np.ndarray):
        if not cols:
            none = [table(np.zeros(0, U), np.zeros((0, width), np.int64)) for width in (1, 4)]
            write_file(f"{folder}/order{level}-{shard}", laid_out(none))
            return
        # rows in order have equal contexts together
        new = np.zeros(len(n), bool)
        new[0] = True
        for c in cols[:-1]:
            new[1:] |= c[1:] != c[:-1]
        begin = np.flatnonzero(new)
        ctx = context([c[begin] for c in cols[:-1]])
        key = chain(np.repeat(ctx, np.diff(np.append(begin, len(n)))), cols[-1])
        stats = np.stack([np.add.reduceat(x, begin) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))], axis=1)
        spread = np.isin(ctx, hot) if level == 2 else np.zeros(len(ctx), bool)
        write_file(f"{folder}/order{level}-{shard}", laid_out([table(key, n[:, None]), table(ctx[~spread], stats[~spread])]))
        del key
        yield _batch([{"kind": "tally", **_tallies(n)}, *[{"kind": "hot", "a": int(c), "b": int(s[0]), "c": int(s[1]), "d": int(s[2]), "e": int(s[3])} for c, s in zip(ctx[spread].view(np.int64), stats[spread], strict=True)]])
        yield from below.send(*summed(cols[1:]))

    return write


def _freed(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what's no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _discounts(tally: dict) -> tuple[float, float, float]:
    n1, n2, n3, n4 = tally["a"], tally["b"], tally["c"], tally["d"]
    out = [0.5, 1.0, 1.5]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        out[0] = 1 - 2 * y * n2 / n1
        out[1] = min(2.0, max(0.0, 2 - 3 * y * n3 / n2))
        if n3:
            out[2] = min(3.0, max(0.0, 3 - 4 * y * n4 / n3))
    return tuple(out)


def train(texts: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES, hot_count: int = HOT_COUNT) -> dict:
    """The model of a column of texts: where its arrays are, and its totals."""
    if order < 2:
        raise ValueError("an order of 2 or more")
    spark = texts.sparkSession
    texts = texts.select(F.col(texts.columns[0]).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / shard_bytes))))
    folder = shared_path(spark, "ngram")
    hot_from = max(hot_count, size // (4 * HOT_LIMIT))  # a token takes two bytes, so there are HOT_LIMIT * 2 at most
    empty = {"shard": 0, "a": 0, "b": 0, "c": 0, "d": 0, "e": 0}

    def tally(df: DataFrame) -> dict:
        row = df.where("kind = 'tally'").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in empty]).first()
        return {**empty, **row.asDict()}

    model = {"folder": folder, "bits": bits, "order": order, "tokens": 0, "types": 0, "hot": np.zeros(0, U), "levels": {}, "spread": None, "single": (0, 1.0)}
    by_hash, by_number = Deal("word", bits), Deal("number", bits)
    words = written(_by_shard(texts.mapInArrow(_count_words(by_hash), PACKED), by_hash, _write_words(folder, bits, hot_from)), "words")
    total = tally(words)
    model["tokens"], model["types"] = int(total["e"]), int(total["shard"])
    if not model["tokens"]:  # no rows, and so no tasks either
        return model
    hot = [r.a for r in words.where("kind = 'hot'").select("a").collect()]  # bounded by hot_from
    hot = np.unique(context([np.array([int(BEGIN), *hot], U)]))
    drop_path(spark, words._lexiloom_path)
    _freed(spark)
    model["hot"] = hot
    deals = {level: Deal("gram", bits, hot if level == 2 else None) for level in range(2, order + 1)} | {1: by_number}
    grams, above = texts.mapInArrow(_count_grams(order, folder, deals[order]), PACKED), None
    for level in range(order, 0, -1):
        write = _write_grams(folder, level, hot, deals[level - 1]) if level > 1 else _write_next(folder, bits)
        done = written(_by_shard(grams, deals[level], write), f"order{level}")
        single = tally(done)
        model["levels"][level] = _discounts(single)
        if level == 2:
            sums = done.where("kind = 'hot'").groupBy("a").agg(*[F.sum(x).alias(x) for x in ("b", "c", "d", "e")])
            rows = sums.collect()  # one per word in hot
            ctx = np.array([r.a for r in rows], np.int64).view(U)
            by = np.argsort(ctx)
            model["spread"] = (ctx[by], np.array([[r.b, r.c, r.d, r.e] for r in rows], np.int64).reshape(-1, 4)[by])
        if above is not None:
            drop_path(spark, above._lexiloom_path)
        grams, above = done.where("kind = 'next'"), done
        _freed(spark)
    drop_path(spark, above._lexiloom_path)
    d = model["levels"][1]
    many = single["shard"] - single["a"] - single["b"]
    model["single"] = (int(single["e"]), (d[0] * single["a"] + d[1] * single["b"] + d[2] * many) / single["e"] if single["e"] else 1.0)
    return model


class Scorer:
    """The model as a worker sees it."""

    def __init__(self, model: dict):
        self.m = model
        self.words = Vocabulary(model["folder"], model["bits"])
        self.files: dict[tuple, list[np.ndarray]] = {}

    def find(self, level: int, which: int, q: np.ndarray, shard: np.ndarray, derive) -> np.ndarray:
        """What derive makes of the values in a table of that order."""
        width = 4 if which == CTX else 1
        got = np.empty((len(q), derive(np.zeros((1, width))).shape[1]))
        order = np.argsort(shard.astype(np.uint16) if self.m["bits"] <= 16 else shard, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(q)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b == a:
                continue
            at = order[a:b]
            k = int(shard[at[0]])
            if (level, k) not in self.files:
                self.files[level, k] = arrays(map_file(f"{self.m['folder']}/order{level}-{k}", np.uint8), 12)
            got[at] = look_up(self.files[level, k][6 * which : 6 * which + 6], q[at], width, derive)
        return got

    def single(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, counts and probabilities of single tokens."""
        u, inverse = np.unique(tokens, return_inverse=True)
        if not self.m["tokens"]:
            return np.full(len(tokens), UNKNOWN), np.zeros(len(tokens), np.int64), np.ones(len(tokens))
        number, n, k = self.words.find(u, following=True)
        total, rest = self.m["single"]
        p = np.maximum(k - self.discount(1, k), 0) / max(total, 1) + rest / (self.m["types"] + 1)
        return number[inverse], n[inverse], p[inverse]

    def discount(self, level: int, c: np.ndarray) -> np.ndarray:
        d = self.m["levels"][level]
        return np.where(c == 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))

    def contexts(self, level: int, ctx: np.ndarray) -> np.ndarray:
        """One over the sum of the counts after each context, and the share that goes to the lower order."""
        d = self.m["levels"][level]

        def derive(v: np.ndarray) -> np.ndarray:
            one = np.where(v[:, 0] > 0, 1 / np.maximum(v[:, 0], 1), 0.0)
            return np.stack([one, np.where(v[:, 0] > 0, (v[:, 1] * d[0] + v[:, 2] * d[1] + v[:, 3] * d[2]) * one, 1.0)], axis=1)

        found = self.find(level, CTX, ctx, shards(ctx, ctx, self.m["bits"], np.zeros(0, U)), derive)
        if level == 2 and len(self.m["spread"][0]):
            known, sums = self.m["spread"]
            at = np.minimum(np.searchsorted(known, ctx), len(known) - 1)
            spread = known[at] == ctx
            found[spread] = derive(sums[at[spread]])
        return found

    def step(self, level: int, ctx: np.ndarray, numbers: np.ndarray, p: np.ndarray) -> np.ndarray:
        """p interpolated with the counts after the contexts."""
        if level == 2:  # words, many of which occur often
            u, inverse = np.unique(ctx, return_inverse=True)
            found = self.contexts(level, u)[inverse]
        else:
            found = self.contexts(level, ctx)
        shard = shards(ctx, numbers, self.m["bits"], self.m["hot"] if level == 2 else np.zeros(0, U))
        c = self.find(level, GRAM, chain(ctx, numbers), shard, lambda v: v - self.discount(level, v))[:, 0]
        return c * found[:, 0] + found[:, 1] * p

    def score(self, buf: np.ndarray, offsets: np.ndarray):
        """Per row: tokens, known tokens, base score, score."""
        tokens, cuts = sequences(buf, offsets)
        numbers, n, p = self.single(tokens)
        if self.m["tokens"]:
            back = before(numbers, cuts, self.m["order"])
            for level in range(2, self.m["order"] + 1):
                p = self.step(level, context(back[-(level - 1) :]), numbers, p)
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        base = np.log10((n + 1) / (self.m["tokens"] + self.m["types"] + 1))
        total = lambda x: np.bincount(row, weights=x, minlength=len(cuts) - 1)
        return np.diff(cuts), total(n > 0).astype(np.int64), total(base), total(np.log10(p))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) and perplexity of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # totals and the spread contexts only

    def run(batches):
        scorer = Scorer(held.value)
        for batch in pieces(batches):
            cols = scorer.score(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in cols]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )
