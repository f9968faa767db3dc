"""Quality rules by distribution divergence from language references.

A document is compared with the reference of its language in two histograms: character classes (``CLASSES``) and common words
(lower-cased, without outer ASCII punctuation; every other word is one more class). The measure is the Jensen-Shannon
distance in bits. A short text differs from any reference by chance alone: the divergence that a sample of n
draws from the reference itself is expected to have, (classes - 1) / (8 n ln 2), is taken off first, and texts
with fewer than ``LEAST_CHARS`` characters or ``LEAST_WORDS`` words are not judged by the respective histogram.

*References* come from all documents with at least ``LEAST_WORDS`` words, in one pass of counts per task. So that a text copied
into a third of the rows can't become its language's reference, documents are dealt into ``FOLDS`` by the smallest hash of their
longer words, which sends copies and most near copies to the same fold, and a reference is the median of the folds'
shares. Words whose median share reaches ``LEAST_SHARE`` are the common ones; that bounds them to 2 / LEAST_SHARE a language.
A language with fewer than ``LEAST_DOCS`` such documents has no reference, and its documents are judged by the base rules alone.

Base rules: fewer than 50 words, or more than half of the words inside three-word windows that occur twice or more.

Defined cases: null and empty texts have no words and fail the base rules; a null language is a language of its own; texts of any
length are read whole; repeated rows are judged alike; of ties in the median the lower middle counts; columns other than the identifier, text and language are
ignored, whatever their names; an empty table gives no rows.
"""
from __future__ import annotations

import json
import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenetdq.functions.lookup import attach
from tenetdq.llm.common import bounded_batches, settled

FOLDS = 5
LEAST_DOCS = 20                # documents behind a reference
LEAST_WORDS = 50               # words of a document that is judged by words, or counted for a reference
LEAST_CHARS = 200              # characters of a document that is judged by character classes
LEAST_SHARE = 0.002
LONG_WORD = 8                  # bytes of the words that choose a fold
CHAR_DISTANCE = 0.28
WORD_DISTANCE = 0.32
MOST_REPEATED = 50             # per cent of the words
FLUSH_WORDS = 200_000
CLASSES = ["lower", "lower beyond ASCII", "upper", "upper beyond ASCII", "other letter", "mark", "number", "space", "line break",
           "sentence mark", "other punctuation", "symbol", "other"]
SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@cache
def _classes() -> np.ndarray:
    """Class of each code point, from its Unicode category."""
    def of(point: int) -> int:
        char, ascii_ = chr(point), point < 128
        kind = unicodedata.category(char)
        if kind == "Ll":
            return 0 if ascii_ else 1
        if kind == "Lu":
            return 2 if ascii_ else 3
        if char in " \n.,;:!?":
            return 7 if char == " " else 8 if char == "\n" else 9
        return {"L": 4, "M": 5, "N": 6, "P": 10, "S": 11}.get(kind[0], 12)

    return np.fromiter(map(of, range(0x110000)), np.uint8, 0x110000)


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount(_classes()[points], minlength=len(CLASSES))


def core(word: bytes) -> str:
    """A word as the histogram of common words names it."""
    return word.decode().lower().strip(OUTER)


def repeated_words(codes: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more, the first time included."""
    n = len(codes) - 2
    if n < 2:
        return 0
    most = np.int64(codes.max()) + 1
    pairs = codes[:n] * most + codes[1:n + 1]
    if most >= 1 << 21:                                     # three codes don't fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, times = np.unique(pairs * most + codes[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    inside = np.zeros(len(codes), bool)
    for k in range(3):
        inside[k:k + n] |= again
    return int(inside.sum())


def base_counts(text: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the distinct words and each word's place among them."""
    raw = text.encode()
    place: dict[bytes, int] = {}
    words = raw.split()
    codes = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    white = len(raw) - len(raw.translate(None, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (np.array([len(words), len(text) - white, symbols, len(lines) - len(set(lines)), repeated_words(codes)]),
            list(place), codes)


def fold_of(words: list[bytes]) -> int:
    return min(map(zlib.crc32, [w for w in words if len(w) >= LONG_WORD] or words)) % FOLDS


class _Counts:
    """Counts of one task by language, fold and class or word."""

    def __init__(self):
        self.docs, self.chars, self.words = Counter(), {}, {}

    def add(self, lang: str, text: str) -> None:
        words = text.encode().split()
        if len(words) < LEAST_WORDS:
            return
        own = Counter(words)
        key = lang, fold_of(list(own))
        self.docs[key] += 1
        self.chars[key] = self.chars.get(key, 0) + class_counts(text)
        self.words.setdefault(key, Counter()).update(own)

    def size(self) -> int:
        return sum(map(len, self.words.values()))

    def rows(self) -> pa.RecordBatch:
        out: list[tuple] = [(*key, "d", n) for key, n in self.docs.items()]
        for key, counts in self.chars.items():
            out += [(*key, f"c{i}", n) for i, n in enumerate(counts.tolist()) if n]
        for key, counts in self.words.items():
            merged: Counter = Counter()
            for word, n in counts.items():
                merged[core(word)] += n
            out += [(*key, "w" + word, n) for word, n in merged.items()]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()),
             pa.array(cols[3], pa.int64())], ["g", "fold", "key", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for b in batches:
        for lang, text in zip(b.column("g").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts.add(lang, text or "")
            if counts.size() >= FLUSH_WORDS:
                yield counts.rows()
                counts = _Counts()
    yield counts.rows()


def references(rows: DataFrame) -> DataFrame:
    """(g, n, ref): per language its documents and, as JSON, the median shares of classes and common words; rows has g and text."""
    counts = settled(rows.mapInArrow(_count, "g string, fold int, key string, n long")
                     .groupBy("g", "fold", "key").agg(F.sum("n").alias("n")).withColumn("kind", F.substring("key", 1, 1)),
                     "quality-counts")
    whole = counts.groupBy("g", "fold", "kind").agg(F.sum("n").alias("total"))
    folds = counts.where("kind = 'd'").groupBy("g").agg(F.count("*").alias("folds"), F.sum("n").alias("n"))
    whole = settled(whole.join(folds.where(F.col("n") >= LEAST_DOCS).select("g", "folds"), "g"), "quality-folds")
    share = attach(counts.where("kind <> 'd'"), whole, ["g", "fold", "kind"], how="inner").groupBy("g", "kind", "key").agg(
        F.sort_array(F.collect_list(F.col("n") / F.col("total"))).alias("shares"), F.first("folds").alias("folds"))
    # folds without the key count as zero shares before the others
    at = F.floor((F.col("folds") - 1) / 2).cast("int") - (F.col("folds") - F.size("shares")).cast("int")
    median = F.when(at >= 0, F.get("shares", at)).otherwise(F.lit(0.0))
    kept = share.select("g", "kind", F.substring("key", 2, 1 << 30).alias("key"), median.alias("share")).where(
        (F.col("kind") == "c") | (F.col("share") >= LEAST_SHARE))
    listed = kept.groupBy("g").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "c", F.struct("key", "share")))).alias("chars"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "w", F.struct("key", "share")))).alias("words"))
    return listed.join(folds.select("g", "n"), "g").select("g", "n", F.to_json(F.struct("chars", "words")).alias("ref"))


def distance(counts: np.ndarray, shares: np.ndarray) -> float:
    """Jensen-Shannon distance of a histogram from a reference, less what a sample of that size has by chance."""
    def bits(x: np.ndarray) -> float:
        x = x[x > 0]
        return -float((x * np.log2(x)).sum())

    n = counts.sum()
    p = counts / n
    found = bits((p + shares) / 2) - (bits(p) + bits(shares)) / 2
    return math.sqrt(max(0.0, found - ((shares > 0).sum() - 1) / (8 * n * math.log(2))))


class _Reference:
    def __init__(self, ref: str):
        told = json.loads(ref)
        self.chars = np.zeros(len(CLASSES))
        for x in told["chars"]:
            self.chars[int(x["key"])] = x["share"]
        self.chars /= self.chars.sum()
        shares = np.array([x["share"] for x in told["words"]])
        self.words = np.append(shares, max(0.0, 1 - shares.sum()))
        self.words /= self.words.sum()
        self.place = {x["key"]: i for i, x in enumerate(told["words"])}
        self.known: dict[bytes, int] = {}

    def places(self, words: list[bytes]) -> np.ndarray:
        """Class of each word: its place among the common ones, or the last."""
        known, rest = self.known, len(self.place)
        if len(known) > FLUSH_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.place.get(core(w), rest)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


RESULT = ("doc_id {}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, char_distance double, word_distance double")


def _judge(most_chars: float, most_words: float):
    refs: dict[str, _Reference] = {}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, failed, kept, chars, words = [], [], [], [], []
            for text, told in zip(b.column("text").to_pylist(), b.column("ref").to_pylist(), strict=True):
                text = text or ""
                base, own, codes = base_counts(text)
                dc = dw = None
                if told is not None:
                    if told not in refs:
                        if len(refs) >= 100:
                            refs.clear()
                        refs[told] = _Reference(told)
                    ref = refs[told]
                    if len(text) >= LEAST_CHARS:
                        dc = distance(class_counts(text), ref.chars)
                    if len(codes) >= LEAST_WORDS:
                        dw = distance(np.bincount(ref.places(own)[codes], minlength=len(ref.words)), ref.words)
                bad = bool(base[0] < 50 or 100 * base[4] > MOST_REPEATED * base[0])
                counts.append(base)
                failed.append(bad)
                kept.append(not bad and (dc or 0) <= most_chars and (dw or 0) <= most_words)
                chars.append(dc)
                words.append(dw)
            columns = np.array(counts, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(failed, pa.bool_()),
                 pa.array(kept, pa.bool_()), pa.array(chars, pa.float64()), pa.array(words, pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                 "char_distance", "word_distance"])

    return judge


def judge(docs: DataFrame, lang: str = "lang", most_chars: float = CHAR_DISTANCE, most_words: float = WORD_DISTANCE) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, and both distances (null where not judged)."""
    bounded_batches(docs.sparkSession)
    named = F.coalesce(F.concat(F.lit("1"), F.col(f"`{lang}`").cast("string")), F.lit("0"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), named.alias("g"))
    refs = settled(references(rows.select("g", "text")), "quality-references")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return attach(rows, refs, ["g"], weight="n").select("doc_id", "text", "ref").mapInArrow(
        _judge(most_chars, most_words), RESULT.format(kind))
