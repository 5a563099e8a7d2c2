"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words, pairs of adjacent words, and pairs with one word between, hashed to
2**BITS places. FTRL-proximal (McMahan et al., 2013) keeps a rate per coordinate, and its L1 term leaves most weights at
exactly zero, so that the model is a short list of places and weights (at most 2**BITS), broadcast to the scorers.

The model is fitted on a bounded sample of the labelled rows: those with the least hash of doc_id, SAMPLE_ROWS rows and
SAMPLE_CHARS characters at most. Statistics of the fit are the sample's; scoring covers every row and whole texts.

Defined results: null and empty texts have no features and score the bias; labels that are null don't count as labels;
rows without doc_id count as held out (crc32 of the empty text is 0) and are scored; a table without labelled rows, or with one class,
gives the smoothed share of toxic rows (0.5 with no labels) as every score; repeated rows repeat; an empty table gives an
empty result; other columns are ignored here and passed through by reject().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import digest, documents, pieces, read_table, text_bytes, without_rows, written
from .texthash import LOWER, PUNCT, chain, span_hashes, spans

#: Places of features, as a power of two.
BITS = 20
#: Bound of the sample on which the classifier is fitted.
SAMPLE_ROWS = 20_000
SAMPLE_CHARS = 48_000_000
#: FTRL's rates and regularisation, passes over the sample, and the weight of a toxic row against a clean one.
ALPHA, BETA, L1, L2 = 8.0, 1.0, 10.0, 0.01
EPOCHS = 8
THRESHOLD = 0.5

U = np.uint64


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of features of the rows laid end to end in buf, and the row of each (repeats included)."""
    low = LOWER[buf]
    starts, ends, upto = spans(low, offsets, PUNCT)
    h = span_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0))
    shift = U(64 - BITS)
    out, rows = [h >> shift], [row]
    for gap, salt in ((1, 0x51), (2, 0xA7)):
        same = row[:-gap] == row[gap:]
        out.append(chain(h[:-gap] + U(salt), h[gap:])[same] >> shift)
        rows.append(row[:-gap][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(rows)


def _sparse(batches):
    """toxic, at, places: the distinct features of each row."""
    for batch in pieces(batches):
        buf, offsets = text_bytes(batch.column(1))
        place, row = features(buf, offsets)
        keys = np.unique(row << BITS | place)
        cuts = np.searchsorted(keys, np.arange(batch.num_rows + 1) << BITS)
        places = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((keys & ((1 << BITS) - 1)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), places], names=["toxic", "at", "places"])


def _fit(batches):
    """The non-zero weights, of all rows of the sample in the order of `at`; place -1 is the bias."""
    rows: list[tuple[int, int, np.ndarray]] = []
    for batch in batches:
        ys, ats, places = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        flat, cuts = places.flatten().to_numpy(), places.offsets.to_numpy()
        cuts = cuts - cuts[0]
        rows += [(at, y, flat[a:b].copy()) for at, y, a, b in zip(ats, ys, cuts[:-1], cuts[1:], strict=True)]
    rows.sort(key=lambda r: r[0])
    place, weight = fit([(x, y) for _, y, x in rows])
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(weight)], names=["place", "weight"])


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over rows of distinct places and a label. The bias, place -1, has no L1 term."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    positive = sum(y for _, y in rows)
    share = (positive + 1) / (len(rows) + 2)
    bias, bias_n = math.log(share / (1 - share)), 0.0
    if not 0 < positive < len(rows):
        return np.array([-1], np.int64), np.array([bias])
    # the rarer class counts for more
    weigh = min(8.0, math.sqrt((len(rows) - positive) / positive))

    def weights(at):
        zi = z[at]
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0
        return w

    for _ in range(epochs):
        for at, y in rows:
            w = weights(at)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + float(w.sum())))))
            g = (p - y) * (weigh if y else 1.0)
            if abs(g) < 1e-6:
                continue
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = n_new
            bias_n += g * g
            bias -= ALPHA * g / (BETA + math.sqrt(bias_n))
    every = np.arange(size)
    w = weights(every)
    some = np.flatnonzero(w)
    return np.concatenate(([-1], some)).astype(np.int64), np.concatenate(([bias], w[some]))


def held_in(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def bounded(rows: list, limit: int) -> list:
    """The rows (toxic, n_chars) that have so many characters together, in their order: each label's within its share of the rows, short ones
    first, then what else fits. A label that nothing of fits has its shortest row."""
    size = [r.n_chars or 0 for r in rows]
    taken: set[int] = set()

    def take(some: list[int], room: int) -> int:
        for i in some:
            if i not in taken and size[i] <= room:
                taken.add(i)
                room -= size[i]
        return room

    by_label: dict = {}
    for i, r in enumerate(rows):
        by_label.setdefault(r.toxic, []).append(i)
    left = 0
    for own in by_label.values():
        short = [i for i in own if size[i] <= limit // 1000]
        left += take(own, take(short, limit * len(own) // len(rows)))
    take(sorted(range(len(rows)), key=lambda i: size[i] > limit // 1000), left)
    for own in by_label.values():
        if taken.isdisjoint(own):
            taken.add(min(own, key=size.__getitem__))
    return [rows[i] for i in sorted(taken)]


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the non-zero weights. Labels of rows that are held out are never read."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & held_in(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sized = docs.select("doc_id", F.length("text").alias("n_chars")).join(known, "doc_id")
    picked = sized.select("doc_id", "toxic", "n_chars", F.xxhash64("doc_id").alias("at")).orderBy("at", "n_chars").limit(SAMPLE_ROWS).collect()
    ids = [(r.doc_id, r.toxic, r["at"]) for r in bounded(picked, SAMPLE_CHARS)]  # SAMPLE_ROWS at most
    if not ids:
        return fit([])
    chosen = spark.createDataFrame(list({i[0]: i for i in ids}.values()), "id long, toxic int, at long")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    sample = written(texts.select("id", "text", "toxic", "at").mapInArrow(_sparse, "toxic int, at long, places array<int>"), "sample")
    model = sample.coalesce(1).mapInArrow(_fit, "place long, weight double").toPandas()  # 2**BITS + 1 rows at most
    return model["place"].to_numpy(), model["weight"].to_numpy()


def score_rows(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The probabilities of the rows laid end to end in buf; table: every place's weight."""
    place, row = features(buf, offsets)
    some = table[place] != 0
    keys = np.unique(row[some] << BITS | place[some])
    margin = np.bincount(keys >> BITS, weights=table[keys & ((1 << BITS) - 1)], minlength=len(offsets) - 1) + bias
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], digests: bool = False) -> DataFrame:
    """doc_id, score of every row; digests: and digest."""
    places, weights = model
    bias = float(weights[places == -1].sum())
    held = docs.sparkSession.sparkContext.broadcast((places[places >= 0].astype(np.int32), weights[places >= 0].astype(np.float32)))

    def run(batches):
        table = np.zeros(1 << BITS, np.float32)
        at, w = held.value
        table[at] = w
        for batch in pieces(batches):
            p = score_rows(*text_bytes(batch.column(1)), table, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.astype(np.float64)), *batch.columns[2:]], names=["doc_id", "score", "digest"][: batch.num_columns])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[digest(F.col("text")).alias("digest")] * digests)
    return rows.mapInArrow(run, "doc_id long, score double" + ", digest binary" * digests)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    scored = written(score(docs, train(docs, labels), True), "scores")
    return without_rows(docs, scored.where(F.col("score") >= threshold).select("doc_id", "digest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", (~held_in(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
