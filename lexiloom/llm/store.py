"""Sorted arrays of 64-bit hashes in shared files, memory-mapped by the workers.

A set is a folder of shards; a hash's shard is its top bits. Each shard is written by one task under a name of its own
attempt and then moved into place, so that a repeated or speculative task changes nothing. Workers map the files where the
shared folder is a mounted file system; from other stores that Arrow reaches they fetch a shard into their temporary folder
once, map that copy and unlink it at once. A manifest says how many rows each shard has, and reading a shard that is missing or
shorter fails: a lost file is never taken for an empty one.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import shared_path, written

#: Hashes that a shard is to hold.
SHARD_ROWS = 500_000


def _local(uri: str) -> str | None:
    at = urlparse(uri)
    return at.path if at.scheme in ("", "file") else None


def _arrow(uri: str):
    """Arrow's file system for a URI, and the path in it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_file(uri: str, data) -> None:
    """Write bytes under the name, all or nothing."""
    part = f"{uri}.{uuid.uuid4().hex}.part"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(part), "wb") as f:
            f.write(data)
        os.replace(_local(part), path)
        return
    store, path = _arrow(part)
    with store.open_output_stream(path) as f:
        f.write(data)
    store.move(path, path.removesuffix(part[len(uri) :]))


def map_file(uri: str, dtype) -> np.ndarray:
    """The file's numbers, mapped."""
    if path := _local(uri):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    store, path = _arrow(uri)
    with tempfile.NamedTemporaryFile() as copy:
        with store.open_input_stream(path) as f:
            while block := f.read(1 << 22):
                copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype, "r") if copy.tell() else np.zeros(0, dtype)


def shard_bits(rows: int) -> int:
    return max(0, math.ceil(math.log2(max(1, rows / SHARD_ROWS))))


def write_set(df: DataFrame, columns: list[str], name: str) -> tuple[str, int]:
    """Write the distinct rows of one or two long columns as a set; gives (folder, bits). The folder's manifest has each shard's rows."""
    parts = ["h", "g"][: len(columns)]
    rows = df.select(*[F.col(c).alias(p) for c, p in zip(columns, parts, strict=True)])
    bits = shard_bits(rows.count())
    folder = shared_path(df.sparkSession, name)
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def put(batches):
        # a task may get several shards, sorted by shard and numbers, these as unsigned ones
        now, held, done = None, [], []

        def flush():
            whole = np.concatenate(held, axis=1)
            write_file(f"{folder}/{now}.u8", whole.tobytes())
            done.append((now, whole.shape[1]))

        for batch in batches:
            s = batch.column(0).to_numpy()
            h = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]])
            cut = np.flatnonzero(np.diff(s)) + 1
            for part_s, part_h in zip(np.split(s, cut), np.split(h, cut, axis=1), strict=True):
                if not len(part_s):
                    continue
                if now is not None and part_s[0] != now:
                    flush()
                    held = []
                now = int(part_s[0])
                held.append(part_h)
        if now is not None:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int32()), pa.array([n for _, n in done], pa.int64())], names=["shard", "n"])

    # flipping the sign bit puts signed numbers into the order of unsigned ones
    order = [F.col(p).bitwiseXOR(F.lit(-(1 << 63))) for p in parts]
    dealt = rows.select(shard.alias("shard"), *parts).repartition(max(1, min(1 << bits, 4096)), "shard").sortWithinPartitions("shard", *order)
    write_manifest(folder, dealt.mapInArrow(put, "shard int, n long").collect(), bits)
    return folder, bits


def write_manifest(folder: str, rows: list, bits: int) -> None:
    """The shards' numbers of rows, from (shard, n); one number per SHARD_ROWS rows of the set."""
    sizes = np.zeros(1 << bits, np.uint64)
    for k, n in rows:
        sizes[k] = n
    write_file(f"{folder}/manifest.u8", sizes.tobytes())


def checked(uri: str, dtype, items: int) -> np.ndarray:
    """The file's numbers, mapped; raises if it's missing or isn't as long as its manifest says."""
    if not items:
        return np.zeros(0, dtype)
    found = map_file(uri, dtype)
    if len(found) != items:
        raise ValueError(f"{uri}: {len(found)} numbers, and not {items}")
    return found


class Sets:
    """A worker's view of a set: membership of many numbers, or pairs of them, at once."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.shards: dict[int, np.ndarray] = {}
        self.sizes = checked(f"{folder}/manifest.u8", np.uint64, 1 << bits)

    def shard(self, k: int, width: int) -> np.ndarray:
        if k not in self.shards:
            self.shards[k] = checked(f"{self.folder}/{k}.u8", np.uint64, width * int(self.sizes[k])).reshape(width, -1)
        return self.shards[k]

    def has(self, *h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h[0]), bool)
        if not len(out):
            return out
        order = np.argsort(h[0])
        q = h[0][order]
        found = np.zeros(len(q), bool)
        edges = [0, len(q)]
        if self.bits:
            tops = (q >> np.uint64(64 - self.bits)).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(tops)) + 1).tolist(), len(q)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            s = self.shard(int(q[a] >> np.uint64(64 - self.bits)) if self.bits else 0, len(h))
            n = s.shape[1]
            if not n:
                continue
            at = np.minimum(np.searchsorted(s[0], q[a:b]), n - 1)
            same = s[0, at] == q[a:b]
            if len(h) > 1:
                second = h[1][order[a:b]]
                hit = same & (s[1, at] == second)
                open_ = np.flatnonzero(same & ~hit)  # others with this first number
                while len(open_):
                    at[open_] += 1
                    open_ = open_[at[open_] < n]
                    open_ = open_[s[0, at[open_]] == q[a:b][open_]]
                    now = s[1, at[open_]] == second[open_]
                    hit[open_[now]] = True
                    open_ = open_[~now]
                same = hit
            found[a:b] = same
        out[order] = found
        return out
