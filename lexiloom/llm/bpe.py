"""BPE encoding and decoding with a pair occurrence index.

The distinct words (after normalising and pre-splitting) of a piece of a partition are laid out as one array of symbols with links to neighbours. An index maps each adjacent pair that has a merge rank to
all its positions. Ranks that occur are taken in ascending order from a heap; one step merges all positions of a pair in
the piece at once, left to right without overlap, and puts the pairs that arise into the lists of their ranks.
Stale positions are recognised by the symbols that stand there now. Each distinct word is merged once per piece, and a
bounded cache keeps words from piece to piece.

The vocabulary file's path is a parameter. Supported: BPE models with byte-level symbols, an end-of-word suffix or none,
normalisers NFC, Lowercase and Replace of \\s+, a Split pre-tokeniser with ByteLevel, no decoder (tokens joined by a space).

Defined results: null and empty texts have no tokens and decode to the empty text; repeated rows repeat; an empty table
gives an empty result; long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, pieces

#: Words that the cache holds before it's emptied.
CACHE_WORDS = 200_000
#: Characters of a long text that are encoded at once.
PART = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(extra)
            extra += 1
    return out


class Codec:
    """A vocabulary file as arrays, with the encoder and decoder."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = [(t["content"], t["id"]) for t in spec.get("added_tokens") or ()]
        self.tokens = [""] * (1 + max([*vocab.values(), *(i for _, i in self.added)]))
        for t, i in vocab.items():
            self.tokens[i] = t
        for t, i in self.added:
            self.tokens[i] = t
        self.size = len(self.tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order
        self.left, self.right = left, right
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], np.int64)
        self.byte_end = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t, _ in self.added) + ")") if self.added else None
        self.special_id = dict(self.added)
        # in ASCII and lower case the usual pattern needs no tables
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+") if split["pattern"]["Regex"] == known and "Lowercase" in self.steps else None
        self.assigned: dict[str, bool] = {}
        self.reset()

    def normal(self, text: str) -> str:
        if "NFC" in self.steps and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" not in self.steps:
            return text
        # lower() looks at the neighbours of one character only
        return text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)

    def pre(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if text.isascii():
            low = self.normal(text)
            return self.ascii.findall(low) if self.ascii else self.split.findall(low)
        unknown = False
        for c in set(text):
            if c not in self.assigned:
                self.assigned[c] = unicodedata.category(c) != "Cn"
            unknown |= not self.assigned[c]
        return self.newer(text) if unknown else self.split.findall(self.normal(text))

    def words(self, text: str) -> list:
        """The text's words, added tokens as ids."""
        if self.special is None or not self.special.search(text):
            return self.pre(text)
        out: list = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(self.special_id[part])
            elif part:
                out += self.pre(part)
        return out

    def newer(self, text: str) -> list[str]:
        """The words of a text with characters that Python's tables don't know: normalised and split by the library, whose
        tables are of other versions. Merging is ours for them too."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte_of = {s: b for b, s in enumerate(byte_symbols())}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte_of[s] for s in w).decode() for w, _ in found]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of pairs, -1 where there's none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words laid end to end, and how many ids each has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lens.sum())
        if not n:
            return np.zeros(0, np.int64), lens
        data = np.frombuffer(b"".join(words), np.uint8)
        sym = self.byte_id[data]
        last = np.cumsum(lens)[lens > 0] - 1
        sym[last] = self.byte_end[data[last]]
        ends = np.zeros(n, bool)
        ends[last] = True
        nxt = np.where(ends, n, np.arange(1, n + 1))  # n: none
        nxt = np.append(nxt, n)
        prv = np.full(n + 1, n)
        prv[nxt[:n]] = np.arange(n)
        prv[n] = n
        sym = np.append(sym, -1)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the lists of their ranks."""
            at = at[nxt[at] < n]
            if not len(at):
                return
            rank = self.ranks(sym[at], sym[nxt[at]])
            some = rank >= 0
            at, rank = at[some], rank[some]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(part)

        note(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            parts = lists.pop(r)
            at = np.unique(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at) > 1:  # runs of one symbol: every other position
                follows = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
                start = np.flatnonzero(~follows)
                place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.merged[r], -1
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            before = prv[at]
            before = before[before < n]
            note(np.concatenate((before, at)))
        live = sym[:n] >= 0
        of = np.repeat(np.arange(len(words)), lens)
        return sym[:n][live], np.bincount(of[live], minlength=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        split = [self.words(t) for t in texts]
        index = self.index
        old = len(index)
        for words in split:
            for w in words:
                if w not in index:
                    index[w] = len(index)
        if len(index) > old:
            fresh = list(islice(index, old, None))
            plain = [b"" if isinstance(w, int) else w.encode() for w in fresh]
            ids, counts = self.merge(plain)
            added = [k for k, w in enumerate(fresh) if isinstance(w, int)]
            if added:
                at = np.cumsum(counts)[added] - counts[added]
                ids = np.insert(ids, at, [fresh[k] for k in added])
                counts[added] = 1
            self.begins = np.concatenate((self.begins, len(self.ids) + np.cumsum(counts) - counts))
            self.counts = np.concatenate((self.counts, counts))
            self.ids = np.concatenate((self.ids, ids.astype("<u4")))
        out = []
        for words in split:
            k = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            n = self.counts[k]
            upto = np.cumsum(n)
            total = int(upto[-1]) if len(n) else 0
            out.append(self.ids[np.repeat(self.begins[k] - upto + n, n) + np.arange(total)])
        return out

    def reset(self) -> None:
        """Empty the cache: words (added tokens: their ids) by number, and where their ids lie."""
        self.index: dict = {}
        self.begins, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the tokens, joined by a space, as the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


_GAP = re.compile(r"[\x20\x09-\x0D]")


def parts(text: str, limit: int = PART):
    """A long text in parts, cut at ASCII white space, which no word or added token crosses."""
    at = 0
    while len(text) - at > limit:
        gap = _GAP.search(text, at + limit)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def _told(c: Codec, text: str) -> tuple[int, str, str]:
    """n_tokens and the digests of a long text, a part at a time."""
    n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for part in parts(text):
        x = c.encode([part])[0]
        if len(x):
            decoded.update((" " if n else "").encode() + c.decode(x).encode())
            ids.update(x.tobytes())
            n += len(x)
    return n, ids.hexdigest(), decoded.hexdigest()


def _digests(path: str):
    def run(batches):
        c = codec(path)
        for batch in pieces(batches):
            texts = batch.column(1).fill_null("").to_pylist()
            if len(texts) == 1 and len(texts[0]) > PART:
                told = [_told(c, texts[0])]
            else:
                found = c.encode(texts)
                told = [(len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(c.decode(x).encode()).hexdigest()) for x in found]
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([t[i] for t in told], types[i]) for i in range(3)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches):
        c = codec(path)
        for batch in pieces(batches):
            found = c.encode(batch.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([c.decode(x) for x in found], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of every document."""
    return _two(docs).mapInArrow(_ids(path or default_path()), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return _two(docs).mapInArrow(_digests(path or default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
