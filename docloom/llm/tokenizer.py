"""Byte-pair encoding of whole partitions by an index of pair occurrences.

The distinct words of a stretch of texts (a partition's, up to some millions of characters) are laid out as one array of symbols, and every pair that has a rank
is mapped to all places where it stands. Ranks that occur are then applied in ascending order, each to all its places
at once; the pairs that arise at the joints are entered under their own ranks, which are always higher than the
one being applied. Words are joined back to texts by their offsets.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import spread

DEFAULT = "byte_bpe_50k.json"
#: Setting of the session, and variable of the driver's environment, that name the folder of the vocabulary files.
SETTING, VARIABLE = "spark.docloom.vocabularies", "DOCLOOM_VOCABULARIES"
#: Where the public vocabularies lie if none of these says otherwise and their package isn't installed.
PUBLIC = "/opt/tokenizers"
#: The pattern that byte-level vocabularies split text into words with, unless their file has one; a fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are encoded together; bounds the memory of a task.
STRETCH = 6_000_000
SHIFT = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def vocabulary(path: str | None = None, folder: str | None = None) -> str:
    """The place of a vocabulary file: `path`, else DEFAULT in a folder (given, of VARIABLE, or of the package of public tokenizers)."""
    if path:
        return path
    folder = folder or os.environ.get(VARIABLE)
    if folder:
        return f"{folder.rstrip('/')}/{DEFAULT}"
    try:
        import public_tokenizers

        return public_tokenizers.path(DEFAULT)
    except ImportError:
        if os.path.exists(f"{PUBLIC}/{DEFAULT}"):
            return f"{PUBLIC}/{DEFAULT}"
    raise FileNotFoundError(f"{SETTING} or {VARIABLE} must name the folder of {DEFAULT}")


def word_pattern(file: dict) -> regex.Pattern:
    """How a vocabulary file splits text into words; ValueError if that, or how it merges, isn't what is built here."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd or file.get("normalizer"):
        raise ValueError(f"a plain byte-level BPE vocabulary is needed: {odd or file.get('normalizer') or model.get('type')}")
    steps = pre.get("pretokenizers", [pre])
    last, first = steps[-1], steps[:-1]
    if last.get("type") != "ByteLevel" or last.get("add_prefix_space") or len(first) > 1:
        raise ValueError(f"unknown pre-tokenizer {pre}")
    if not first:
        if not last.get("use_regex", True):
            raise ValueError("a vocabulary without words")
        return regex.compile(WORDS)
    cut = first[0]
    text = cut.get("pattern", {}).get("Regex")
    if cut.get("type") != "Split" or last.get("use_regex", True) or not text or cut.get("behavior") != "Isolated" or cut.get("invert"):
        raise ValueError(f"unknown pre-tokenizer {pre}")
    return regex.compile(f"{text}|(?:(?!{text}).)+", regex.S)  # what lies between matches is a word as well


class PairIndexEncoder:
    """Encodes with the merges of a byte-level vocabulary file (json)."""

    def __init__(self, path: str | None = None):
        with open(vocabulary(path), encoding="utf-8") as f:
            file = json.load(f)
        self.split = word_pattern(file)
        model = file["model"]
        ids = model["vocab"]
        self.base = np.array([ids[s] for s in byte_symbols()], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for i, (a, b) in enumerate(pairs):
            if max(made.get(a, -1), made.get(b, -1)) >= i:
                raise ValueError("a merge precedes one of its parts")
            made.setdefault(a + b, i)
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.result = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = left * SHIFT + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        k = a.astype(np.int64) * SHIFT + b
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.ranks[at], -1)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and the offset of each word in it (one more than words)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym = self.base[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        some = sizes > 0
        after[ends[some] - 1] = -1
        before[(ends - sizes)[some]] = -1
        places: dict[int, list[np.ndarray]] = defaultdict(list)

        def enter(at: np.ndarray) -> None:
            r = self.rank(sym[at], sym[after[at]])
            known = r >= 0
            at, r = at[known], r[known]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for k, part in zip(r[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                places[k].append(part)

        enter(np.flatnonzero(after >= 0).astype(np.int32))
        for k in range(len(self.result)):
            found = places.pop(k, None)
            if found is None:
                continue
            a, b, new = self.left[k], self.right[k], self.result[k]
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            then = after[at]
            at = at[(sym[at] == a) & (then >= 0) & (sym[then] == b)]
            if a == b and len(at) > 1:
                at = self.apart(np.unique(at), after)
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            sym[at], sym[gone] = new, -1
            after[at] = then
            inner = then >= 0
            before[then[inner]] = at[inner]
            was = before[at]
            enter(np.concatenate([was[was >= 0], at[inner]]))
        alive = sym >= 0
        upto = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=upto[1:])
        return sym[alive], upto[np.r_[0, ends]]

    @staticmethod
    def apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of places of a pair of equal symbols those to merge from left to right: every other one of a chain."""
        starts = np.r_[True, after[at[:-1]] != at[1:]]
        index = np.arange(len(at))
        first = np.maximum.accumulate(np.where(starts, index, 0))
        return at[(index - first) % 2 == 0]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array and the offset of each text; null and empty texts have none."""
        index: dict[str, int] = defaultdict()
        index.default_factory = index.__len__
        at: list[int] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                at.extend([index[w] for w in self.split.findall(t)])
            counts[i + 1] = len(at)
        ids, offsets = self.words([w.encode("utf-8", "replace") for w in index])
        word = np.array(at, np.int64)
        sizes = np.diff(offsets)[word]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(offsets[word] - (ends - sizes), sizes) + np.arange(total)
        return ids[take], np.r_[0, ends][counts]


def stretches(texts: list[str | None], most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters, each at least one text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_encoders: dict[str, PairIndexEncoder] = {}


def encoder(name: str) -> PairIndexEncoder:
    """The encoder of a vocabulary file that was shipped with the job, read once by each worker process."""
    if name not in _encoders:
        _encoders[name] = PairIndexEncoder(SparkFiles.get(name))
    return _encoders[name]


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which a file of the driver is sent to all executors, once a session."""
    name = f"{hashlib.sha256(path.encode()).hexdigest()[:12]}-{os.path.basename(path)}"
    if not os.path.exists(SparkFiles.get(name)):
        folder = tempfile.mkdtemp()  # of the driver, from which addFile takes the copy
        spark.sparkContext.addFile(shutil.copyfile(path, f"{folder}/{name}"))
    return name


def joined(batches: Iterator[pa.RecordBatch], most: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about `most` bytes of text, so that one index serves them."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(0).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]


def encode_column(docs: DataFrame, key: str, text: str, path: str | None = None, counts_only: bool = False, keep: list[str] | None = None) -> DataFrame:
    """key and ids (array of integers) of each text, or key and n_tokens (bigint), and the columns `keep` as they are.

    Null and empty texts have the empty list (0). Text that looks like a special token is ordinary text. Repeated
    rows stay repeated; an empty table gives none. path: a vocabulary file of the driver, which is shipped to the executors. Columns of docs that aren't named are not read.
    """
    names = [key, *(keep or [])]
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    src = docs.select(docs[text].alias("text"), *[docs[c].alias(f"k{i}") for i, c in enumerate(names)])

    spark = docs.sparkSession
    name = shipped(spark, vocabulary(path, spark.conf.get(SETTING, None)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for b in joined(batches):
            for lo, hi in stretches(b.column(0).to_pylist()):
                part = b.slice(lo, hi - lo)
                ids, offsets = enc.texts(part.column(0).to_pylist())
                value = pa.array(np.diff(offsets)) if counts_only else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([value, *part.columns[1:]], ["value", *(f"k{i}" for i in range(len(names)))])

    got = spread(src).mapInArrow(work, f"value {'bigint' if counts_only else 'array<int>'}, {kinds}")
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], F.col("value").alias("n_tokens" if counts_only else "ids"))
