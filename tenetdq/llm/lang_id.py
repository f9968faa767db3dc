"""Language identification by language-bitmask n-gram filters.

*Learning.* Letter trigrams (words framed by spaces) of labelled texts are counted per language. A
trigram belongs to every language in which its share reaches ``MIN_SHARE`` and at least ``TOLERANCE`` of
its share in the language that uses it most. Shares of at least 1e-6 bound a language's
trigrams by a million, so the model's size has a proven bound. The trigrams go into one bit-sliced Bloom
filter: row p of the filter holds one bit per language, in as many 64-bit words as ``WORD`` languages each need, so ``PROBES`` row
reads, joined by AND, return the mask of all languages that contain a trigram. Rows are built by a bitwise-or
aggregate. Their number is a power of two, eight times the trigrams of the language with most (``LEAST_ROWS`` at least, 2 ** 23 at most,
by the bound above), and so many words reach the driver.

*Prediction.* A text's masks are popcounted per language over all its trigrams. With a filter whose bits
for a language are set in a share f of the rows, a foreign trigram hits with chance f ** PROBES, which
the counts are corrected for; the largest corrected count wins, ties go to the first name.

Defined cases: a letter is a character of Unicode category L; null text, or text without a letter, is ``und`` with score 0;
without labelled rows every text is ``und`` but none is rejected for it; texts of any length are read whole, in slices;
repeated rows are counted and judged alike; other columns travel in a struct, whatever their names; an empty table gives no rows.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenetdq.llm.common import bounded_batches, own_cache, settled, windows, wrapped

MIN_SHARE = 1e-6
TOLERANCE = 0.25
LEAST_ROWS = 1 << 18
WORD = 63                      # languages of one filter word
PROBES = 3
SLICE = 400_000                # characters looked at together
LEAST_SHARE = 0.05             # of trigrams that a language must explain for a text to be accepted
LETTERS = re.compile(r"[^\W\d_]+")
# What that class holds besides letters: number signs of categories Nl and No. Those beyond the basic plane have a set of
# their own, since the others alone compile to a table.
_SIGNS = [c for c in map(chr, range(0x110000)) if c.isalnum() and unicodedata.category(c)[0] != "L" and not c.isdecimal()]
NUMERALS = re.compile("[" + "".join(c for c in _SIGNS if c <= "\uffff") + "]")
ASTRAL, ASTRAL_NUMERALS = re.compile("[\U00010000-\U0010ffff]"), re.compile("[" + "".join(c for c in _SIGNS if c > "\uffff") + "]")


def _framed(text: str | None) -> str:
    if text and not text.isascii():
        text = NUMERALS.sub(" ", text)
        if ASTRAL.search(text):
            text = ASTRAL_NUMERALS.sub(" ", text)
    words = LETTERS.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (row of the text, trigram packed in 63 bits), over whole texts."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        framed = _framed(text)
        for at in range(0, max(len(framed) - 2, 0), SLICE):
            part = framed[at:at + SLICE + 2]
            rows.append(i)
            parts.append(part)
            size += len(part)
            if size >= SLICE:
                yield _packed(rows, parts)
                rows, parts, size = [], [], 0
    if parts:
        yield _packed(rows, parts)


def _packed(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.array(rows), [len(p) for p in parts])
    ends = np.cumsum([len(p) for p in parts])
    inside = np.ones(len(c), bool)
    inside[ends - 1] = inside[np.maximum(ends - 2, 0)] = False          # would reach into the next part
    inside = inside[:-2] & (c[1:-1] != 32)
    codes = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return owner[:-2][inside], codes[inside].astype(np.int64)


def _places(codes: np.ndarray, size: int) -> np.ndarray:
    """Filter rows (of ``size``) of each trigram, one line per probe."""
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.stack([(h >> np.uint64(k * 18 + 5)) & np.uint64(size - 1) for k in range(PROBES)]).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_cache("lang_id")                                     # nothing is kept; what others kept goes
    for win in windows(batches, 16 << 20, 50_000):
        langs = np.array(win["lang"].to_pylist(), object)
        held: dict[str, list] = {}
        for rows, codes in trigrams(win["text"].to_pylist()):
            for lang in set(langs[np.unique(rows)]):
                got = np.unique(codes[langs[rows] == lang], return_counts=True)
                held.setdefault(lang, []).append(got)
        for lang, got in held.items():
            codes, place = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
            n = np.bincount(place, np.concatenate([k for _, k in got])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes),
                                              pa.array(n)], ["lang", "code", "n"])


def _sliced(size: int):
    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b.column("code").to_numpy(), size)
            words, masks = (np.tile(b.column(c).to_numpy(), PROBES) for c in ("word", "mask"))
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(words), pa.array(masks)], ["place", "word", "mask"])

    return sliced


def learn(labelled: DataFrame) -> dict:
    """Model of rows (text, lang): language names, and the filter's words by row."""
    bounded_batches(labelled.sparkSession)
    src = labelled.where("text is not null and lang is not null").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = src.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(
        F.sum("n").alias("n"))
    counts = settled(counts, "trigram-counts")
    found = {r["lang"]: r for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("codes")).collect()}
    names, size = sorted(found), LEAST_ROWS
    most = max((min(r["codes"], round(1 / MIN_SHARE)) for r in found.values()), default=0)
    while size < 8 * most:
        size *= 2
    filled = np.zeros((-(-len(names) // WORD) or 1, size), np.int64)
    if names:
        # the languages as a small table: no expression grows with their number
        known = labelled.sparkSession.createDataFrame(
            [(n, float(found[n]["n"]), i // WORD, 1 << i % WORD) for i, n in enumerate(names)],
            "lang string, total double, word int, bit long")
        shares = counts.join(F.broadcast(known), "lang").select(
            "code", (F.col("n") / F.col("total")).alias("share"), "word", "bit").where(F.col("share") >= MIN_SHARE)
        top = shares.groupBy("code").agg(F.max("share").alias("top"))
        masks = (shares.join(top, "code").where(F.col("share") >= TOLERANCE * F.col("top"))
                 .groupBy("code", "word").agg(F.bit_or("bit").alias("mask")))
        rows = masks.mapInArrow(_sliced(size), "place long, word int, mask long").groupBy("place", "word").agg(
            F.bit_or("mask").alias("mask"))
        got = rows.toArrow()
        filled[got["word"].to_numpy(), got["place"].to_numpy()] = got["mask"].to_numpy()
    return {"names": names, "filter": filled}


def _judged(model: dict):
    names, shape, packed = model["names"], model["filter"].shape, model["filter"].tobytes()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("lang_id")
        words = np.frombuffer(packed, np.int64).reshape(shape)
        places = [divmod(i, WORD) for i in range(len(names))]
        wrong = np.array([float((words[w] >> b & 1).mean()) ** PROBES for w, b in places])
        for b in batches:
            texts = b.column("text").to_pylist()
            seen = np.zeros(len(texts), np.int64)
            hits = np.zeros((len(names), len(texts)))
            for rows, codes in trigrams(texts):
                seen += np.bincount(rows, minlength=len(texts))
                at = _places(codes, shape[1])
                masks = [np.bitwise_and.reduce([row[at[k]] for k in range(PROBES)]) for row in words]
                for i, (w, bit) in enumerate(places):
                    hits[i] += np.bincount(rows[(masks[w] >> bit & 1) == 1], minlength=len(texts))
            lang, score, share = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if names:
                true = np.maximum((hits - seen * wrong[:, None]) / (1 - wrong[:, None]), 0)
                best, total = true.argmax(axis=0), true.sum(axis=0)
                for i in np.flatnonzero(seen).tolist():
                    lang[i] = names[best[i]]
                    score[i] = true[best[i], i] / total[i] if total[i] else 1 / len(names)
                    share[i] = min(true[best[i], i] / seen[i], 1)
            accepted = (seen > 0) & ((share >= LEAST_SHARE) | (not names))
            out = pa.Table.from_batches([b])
            for name, values in (("lang_pred", pa.array(lang, pa.string())), ("score", pa.array(score)),
                                 ("share", pa.array(share)), ("accepted", pa.array(accepted))):
                out = out.append_column(name, values)
            yield from out.combine_chunks().to_batches()

    return judge


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``row`` (all columns of docs in a struct), text, lang_pred, score, share, accepted; one map pass."""
    bounded_batches(docs.sparkSession)
    src = wrapped(docs).select("row", F.col("row.text").cast("string").alias("text"))
    out = T.StructType([*src.schema.fields]).add("lang_pred", "string").add("score", "double").add(
        "share", "double").add("accepted", "boolean")
    return src.mapInArrow(_judged(model), out)


def keep_accepted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which some learned language explains at least ``LEAST_SHARE`` of the trigrams."""
    return predict(docs, learn(docs)).where("accepted").select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
