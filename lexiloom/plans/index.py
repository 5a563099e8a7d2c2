"""The inverted index: postings in Parquet, read by term.

A segment is a folder of postings, partitioned by a hash of the term and sorted by term, so that a query's terms prune
folders first and row groups next; its cost follows its terms' postings, not the collection. Each posting carries the section's
length, so that scoring needs no join; frequencies are counts of the postings read. Each generation has a manifest that names
the live segments and the totals; one writer at most can publish a generation. Added documents make a new segment; those that they replace, and removed ones,
are tombstones until compact() writes all that lives as one segment again.
"""

from __future__ import annotations

import json
import re
import uuid
from copy import deepcopy
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom.functions.stemming import stemmed
from lexiloom.functions.text import arabic_form, terms
from lexiloom.operators import bm25
from lexiloom.sources.tables import sections

SCHEMA_VERSION = 1
#: What the terms are, by name; an index of another version isn't read. form: for queries with Arabic letters.
ANALYZERS = {
    "words": terms,
    "porter": lambda t: stemmed(t),
    "form": lambda t: stemmed(arabic_form(t)),
}
VERSION = "1"
BUCKETS = 32
#: Postings that a file is to hold; an index of very many tokens has more buckets, too.
FILE_POSTINGS = 1_000_000

POSTING = "term string, doc_id long, ordinal long, d long, t long, h long, b long, positions array<int>, bucket int"
SIZES = "doc_id long, sections long, tokens long"


class Conflict(RuntimeError):
    """Another writer published first: open the index again, and repeat the change."""


class IncompatibleIndex(ValueError):
    """The index is of another version or identity, or there's none."""


@dataclass
class Manifest:
    schema_version: int = SCHEMA_VERSION
    identity: str = f"words-{VERSION}"
    buckets: int = BUCKETS
    generation: int = 0
    rows: int = 0
    tokens: int = 0
    segments: list[str] = field(default_factory=list)
    #: For each segment, the generation's tombstones that hold for it.
    tombstones: dict[str, list[str]] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The generations that have a manifest, begun or complete, in order."""
    fs, at = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))


def _manifest(spark: SparkSession, path: str, generation: int) -> dict | None:
    """A generation's manifest; None if its writer didn't finish it."""
    try:
        return json.loads(spark.read.text(f"{path}/manifest-{generation}.json", wholetext=True).first()[0])
    except (TypeError, ValueError):
        return None


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest complete one."""
    found = next((m for g in reversed(_manifests(spark, path)) if (m := _manifest(spark, path, g))), None)
    if found is None:
        raise IncompatibleIndex("no index")
    if found.get("schema_version") != SCHEMA_VERSION or found.get("identity") not in {f"{a}-{VERSION}" for a in ANALYZERS}:
        raise IncompatibleIndex(f"{found.get('schema_version')} {found.get('identity')}")
    return Manifest(**found)


def write_manifest(spark: SparkSession, path: str, m: Manifest) -> None:
    """Publish a generation, if nobody else has: a compare-and-swap, as a file that exists isn't created again.

    A writer that dies while it writes leaves a manifest that readers pass over and writers don't: to go on, remove it.
    """
    there = _manifests(spark, path)
    if there and there[-1] >= m.generation:
        raise Conflict(f"generation {there[-1]} is there already")
    fs, at = _fs(spark, f"{path}/manifest-{m.generation}.json")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        raise Conflict(f"generation {m.generation} is there already") from e
    out.write(bytearray(json.dumps(asdict(m)).encode()))
    out.close()


def _sections(docs: DataFrame) -> DataFrame:
    """Sections as they are, or those of documents."""
    rows = docs if "ordinal" in docs.columns else sections(docs)
    return rows if "heading" in rows.columns else rows.withColumn("heading", F.lit(None).cast("string"))


def _words(docs: DataFrame, analyzer: str) -> DataFrame:
    own = ANALYZERS[analyzer]
    rows = _sections(docs).select("doc_id", "ordinal", *[own(F.coalesce(c, F.lit(""))).alias(a) for c, a in (("title", "tw"), ("heading", "hw"), ("text", "w"))])
    return rows.withColumn("d", (F.size("tw") + F.size("hw") + F.size("w")).cast("long"))


def postings(docs: DataFrame, buckets: int = BUCKETS, analyzer: str = "words") -> DataFrame:
    """The postings of documents or sections: per term the hits in title, heading and text, and the places in the text."""
    rows = _words(docs, analyzer)
    title = F.transform("tw", lambda x: F.struct(x.alias("term"), F.lit(-1).alias("at")))
    heading = F.transform("hw", lambda x: F.struct(x.alias("term"), F.lit(-2).alias("at")))
    text = F.transform("w", lambda x, i: F.struct(x.alias("term"), i.alias("at")))
    each = rows.select("doc_id", "ordinal", "d", F.explode_outer(F.concat(title, heading, text)).alias("p")).where("p IS NOT NULL").select("doc_id", "ordinal", "d", "p.term", "p.at")
    body = F.col("at") >= 0
    per = each.groupBy("term", "doc_id", "ordinal", "d").agg(F.count_if(F.col("at") == -1).alias("t"), F.count_if(F.col("at") == -2).alias("h"), F.count_if(body).alias("b"), F.array_sort(F.collect_list(F.when(body, F.col("at")))).alias("positions"))
    return per.withColumn("bucket", bucket_of(F.col("term"), buckets)).select(*[x.split()[0] for x in POSTING.split(", ")])


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.m = read_manifest(spark, self.path)
        self._rows: tuple[int, DataFrame] | None = None

    @classmethod
    def build(cls, docs: DataFrame, path: str, buckets: int = BUCKETS, analyzer: str = "words") -> Index:
        path = path.rstrip("/")
        m = Manifest(buckets=buckets, identity=f"{analyzer}-{VERSION}")
        cls._segment(docs, path, m)
        write_manifest(docs.sparkSession, path, m)
        return cls(docs.sparkSession, path)

    @staticmethod
    def _segment(docs: DataFrame, path: str, m: Manifest) -> None:
        name = f"segment-{m.generation}-{uuid.uuid4().hex[:8]}"
        spark = docs.sparkSession
        analyzer = m.identity.rpartition("-")[0]
        own = _words(docs, analyzer).select("doc_id", "d")
        own.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum("d").alias("tokens")).write.parquet(f"{path}/{name}/sizes")
        total = spark.read.schema(SIZES).parquet(f"{path}/{name}/sizes").agg(F.coalesce(F.sum("sections"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        Index._write(postings(docs, m.buckets, analyzer), f"{path}/{name}/postings", m.buckets, total[1])
        m.rows, m.tokens = m.rows + total[0], m.tokens + total[1]
        m.segments.append(name)

    @staticmethod
    def _write(rows: DataFrame, path: str, buckets: int, tokens: int) -> None:
        """Postings by bucket, each bucket in as many files as its share of the tokens takes, by document: a frequent term's
        postings are spread over all files of its bucket."""
        files = max(1, -(-tokens // (buckets * FILE_POSTINGS)))
        dealt = rows.repartition(buckets * files, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(files)))
        dealt.sortWithinPartitions("bucket", "term", "doc_id", "ordinal").write.partitionBy("bucket").parquet(path)

    def _tombs(self, segment: str) -> DataFrame | None:
        names = self.m.tombstones.get(segment, [])
        return self.spark.read.schema("doc_id long").parquet(*[f"{self.path}/{n}" for n in names]) if names else None

    def _live(self, kind: str, schema: str) -> DataFrame:
        parts = []
        for s in self.m.segments:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{kind}")
            gone = self._tombs(s)
            parts.append(rows if gone is None else rows.join(gone, "doc_id", "left_anti"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _bury(self, ids: DataFrame, m: Manifest) -> None:
        """Mark documents as gone from all segments there are."""
        name = f"tombstones-{m.generation}-{uuid.uuid4().hex[:8]}"
        gone = self._live("sizes", SIZES).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        gone.write.parquet(f"{self.path}/{name}")
        total = self.spark.read.schema(SIZES).parquet(f"{self.path}/{name}").agg(F.coalesce(F.sum("sections"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
        if total[2]:
            m.rows, m.tokens = m.rows - total[0], m.tokens - total[1]
            for s in m.segments:
                m.tombstones.setdefault(s, []).append(name)

    def _next(self) -> Manifest:
        m = deepcopy(self.m)
        m.generation += 1
        return m

    def _publish(self, m: Manifest) -> None:
        write_manifest(self.spark, self.path, m)
        self.m = m  # only now: what failed has changed nothing here either

    def add(self, docs: DataFrame) -> None:
        """Add documents, in place of those with the same ids."""
        m = self._next()
        self._bury(docs, m)
        self._segment(docs, self.path, m)
        self._publish(m)

    def remove(self, ids: DataFrame) -> None:
        m = self._next()
        self._bury(ids, m)
        self._publish(m)

    def compact(self) -> None:
        """All that lives as one segment."""
        m = self._next()
        name = f"segment-{m.generation}-{uuid.uuid4().hex[:8]}"
        self._write(self._live("postings", POSTING), f"{self.path}/{name}/postings", m.buckets, m.tokens)
        self._live("sizes", SIZES).write.parquet(f"{self.path}/{name}/sizes")
        m.segments, m.tombstones = [name], {}
        self._publish(m)

    def postings(self, words: list[str]) -> DataFrame:
        """The live postings of some words; their buckets are worked out here, so that folders are pruned.

        The relation is kept until the index changes, as listing a segment's folders costs more than reading a word.
        """
        if self._rows is None or self._rows[0] != self.m.generation:
            self._rows = (self.m.generation, self._live("postings", POSTING))
        return self._rows[1].where(F.col("bucket").isin(self._buckets(words)) & F.col("term").isin(words))

    def _buckets(self, words: list[str]) -> list[int]:
        try:
            import xxhash
        except ImportError:  # Spark's own function, at the price of a job
            return [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "term string").select(bucket_of(F.col("term"), self.m.buckets)).distinct().collect()]
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) % self.m.buckets for w in words})

    def scored(self, wanted: list[bm25.Clause], title: float = bm25.TITLE, heading: float = bm25.HEADING, text: float = bm25.TEXT) -> bm25.Scored:
        """What bm25.scored() gives, from the postings of the query's words."""
        words = sorted({w for c in wanted for a in c for w in a})
        rows = self.postings(words)
        own = [F.max(F.when(F.col("term") == w, F.struct("t", "h", "b", "positions"))).alias(f"w{k}") for k, w in enumerate(words)]
        per = rows.groupBy("doc_id", "ordinal").agg(F.max("d").alias("d"), *own)
        number = {w: k for k, w in enumerate(words)}

        def hits(alias: tuple[str, ...], part: str) -> Column:
            if len(alias) == 1:
                return F.coalesce(F.col(f"w{number[alias[0]]}.{part}"), F.lit(0).cast("long"))
            if part != "b":
                return F.lit(0).cast("long")  # titles and headings keep no places
            others = [F.col(f"w{number[w]}.positions") for w in alias[1:]]
            found = F.filter(F.col(f"w{number[alias[0]]}.positions"), lambda p: reduce(lambda x, y: x & y, [F.array_contains(o, p + k + 1) for k, o in enumerate(others)]))
            return F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0)).cast("long")

        m = per.select("doc_id", "ordinal", "d", *[hits(a, p).alias(f"{p}{i}_{j}") for i, c in enumerate(wanted) for j, a in enumerate(c) for p in "thb"])
        stats = m.agg(F.lit(self.m.rows).cast("long").alias("all_rows"), F.lit(self.m.tokens).cast("long").alias("all_tokens"), *bm25.frequencies(wanted))
        return bm25.scored_matrix(m, wanted, stats, title, heading, text)
