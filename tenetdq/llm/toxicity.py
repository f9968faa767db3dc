"""Toxicity by maximum-scoring segments of token log-odds.

*Learning.* For every token the number of labelled texts of either class that hold it gives a log-odds
ratio with an informative Dirichlet prior (weight ``PRIOR``, spread as the token's overall use). Tokens are
words and the first ``STEM`` letters of longer words; a word without odds of its own takes its stem's. A token
scores its log-odds if these are at least ``LEAST_Z`` standard deviations above zero and the
token is in a share of at least ``MIN_SHARE`` of texts-with-tokens, which bounds the dictionary; all other
tokens score ``-DRIFT``. Equal texts count once. The fit reads at most ``MOST_LABELS`` labelled rows, chosen by a
hash of their id; the chosen ids are therefore small enough to broadcast, and texts are not shuffled.

*Scoring.* One linear scan finds all maximal scoring segments of a text. Under the token frequencies of the
clean class the best segment of n tokens exceeds S by chance about K n exp(-lambda S) times, where
lambda solves E[exp(lambda score)] = 1 and K is fitted on clean training texts. Segments beyond that
chance are passages; a text's evidence is the sum of their lambda S - ln(K n), and a logistic curve, fitted
on the training rows' evidence in bins, turns it into a probability.

Defined cases: null and empty texts have no passage and score as texts without evidence; without
labelled rows of both classes every text scores the base rate (0 if there are none).
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetdq.llm.common import bounded_batches, settled, windows

MOST_LABELS = 200_000          # documented bound of the labelled rows used for fitting
PRIOR = 0.1                    # the prior's weight as a share of all counts
LEAST_Z = 3.0
LEAST_ODDS = 1.0
STEM = 6                       # a longer word also counts by its first letters
MIN_SHARE = 1e-6
DRIFT = 0.25
WORDS = re.compile(r"[^\W_]+")


def word_spans(text: str) -> list[re.Match]:
    return list(WORDS.finditer(text))


def _words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _tokens(words: list[str]) -> set[str]:
    return {*words, *[w[:STEM] + "-" for w in words if len(w) > STEM]}


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text in which the tokens at the given
    places score positively and every other one ``-drift``; linear in the number of places."""
    found: list[tuple[int, int, float, float]] = []          # first, last, sum before, sum after
    total, last = 0.0, -1
    for at, gain in scores:
        before = total - drift * (at - last - 1)
        total, last = before + gain, at
        first, low, high = at, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
        found.append((first, at, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for win in windows(batches, 16 << 20, 50_000):
        counts = (Counter(), Counter())
        for text, toxic in zip(win["text"].to_pylist(), win["toxic"].to_pylist(), strict=True):
            counts[toxic].update(_tokens(_words(text)))
        tokens = list(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens, pa.string()), pa.array([counts[1][t] for t in tokens], pa.int64()),
             pa.array([counts[0][t] for t in tokens], pa.int64())], ["token", "pos", "neg"])


def labelled_rows(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """Distinct labelled texts (text, toxic) of at most :data:`MOST_LABELS` labelled rows."""
    marks = labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marks.count()
    if n > MOST_LABELS:                                      # 5 % below the bound: a hash share only tends to it
        share = 0.95 * MOST_LABELS / n
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    marks = F.broadcast(marks.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("toxic")))
    texts = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    found = texts.join(marks, "__id").select("text", "toxic")
    once = found.groupBy(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return settled(once.select("text", "toxic"), "toxic-labelled")


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> dict:
    """Fit the dictionary, the chance constants and the curve. ``train`` chooses labels by doc_id."""
    bounded_batches(docs.sparkSession)
    rows = labelled_rows(docs, labels, train)
    n_texts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = n_texts.get(1, 0) / max(sum(n_texts.values()), 1)
    model = {"odds": {}, "lam": 1.0, "log_k": 0.0, "curve": (_logit(base), 0.0)}
    if not (n_texts.get(0) and n_texts.get(1)):
        return model
    counts = settled(rows.mapInArrow(_counted, "token string, pos long, neg long").groupBy("token").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-counts")
    t = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    total = t["pos"] + t["neg"]
    weight = PRIOR * total
    prior = PRIOR * (F.col("pos") + F.col("neg"))
    p, q = F.col("pos") + prior, F.col("neg") + prior
    odds = F.log(p / (t["pos"] + weight - p)) - F.log(q / (t["neg"] + weight - q))
    kept = counts.where((F.col("pos") + F.col("neg") >= MIN_SHARE * total) & (F.col("pos") > 1)).select(
        "token", "neg", odds.alias("odds"), (odds / F.sqrt(1 / p + 1 / q)).alias("z")).where(
        (F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).collect()
    if not kept:
        return model
    model["odds"] = {r["token"]: r["odds"] for r in kept}
    model["lam"] = _rate([(r["odds"], (r["neg"] + 0.5) / (t["neg"] + 1)) for r in kept])
    # K so that clean training texts' best segments meet their expected number
    best = rows.mapInArrow(_best(model), "toxic int, expected double, bin long").groupBy("toxic").agg(
        F.sum("expected").alias("expected"), F.count("*").alias("n")).where("toxic = 0").first()
    model["log_k"] = -math.log(max(best["expected"] / best["n"], 1e-12))
    bins = rows.mapInArrow(_best(model), "toxic int, expected double, bin long").groupBy("bin").agg(
        F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect()
    model["curve"] = _logistic([(r["bin"] / 4, r["pos"], r["n"]) for r in bins])
    return model


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _rate(scores: list[tuple[float, float]]) -> float:
    """lambda: the positive root of E[exp(lambda score)] = 1 for background token rates."""
    rest = max(1 - sum(p for _, p in scores), 1e-9)

    def excess(x: float) -> float:
        return sum(p * math.exp(min(x * s, 700)) for s, p in scores) + rest * math.exp(-x * DRIFT) - 1

    low, high = 1e-6, 1e-3
    while excess(high) < 0:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Weighted logistic curve by Newton steps with a small ridge; the slope stays positive."""
    x, k, n = (np.array(v, float) for v in zip(*points, strict=True))
    w = np.array([_logit(k.sum() / n.sum()), 0.1])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (k - n * p) - 1e-3 * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _gains(words: list[str], odds: dict[str, float]) -> list[tuple[int, float]]:
    known = {}
    for w in set(words):
        gain = odds.get(w)
        if gain is None and len(w) > STEM:
            gain = odds.get(w[:STEM] + "-")
        if gain is not None:
            known[w] = gain
    return [(i, known[w]) for i, w in enumerate(words) if w in known] if known else []


def segments_of(words: list[str], odds: dict[str, float]) -> list[tuple[int, int, float]]:
    return maximal_segments(_gains(words, odds), DRIFT)


def evidence(words: list[str], model: dict) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed evidence and the passages that chance does not explain."""
    if not words:
        return 0.0, []
    chance = model["log_k"] + math.log(len(words))
    kept = [(a, b, model["lam"] * s - chance) for a, b, s in segments_of(words, model["odds"])]
    kept = [x for x in kept if x[2] > 0]
    return sum(x[2] for x in kept), kept


def _best(model: dict):
    lam = model["lam"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            expected, bins = [], []
            for text in b.column("text").to_pylist():
                words = _words(text)
                top = max((s for *_, s in segments_of(words, model["odds"])), default=0.0)
                expected.append(max(len(words), 1) * math.exp(-lam * top) if top else 1.0)
                bins.append(round(4 * min(evidence(words, model)[0], 250.0)))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(expected), pa.array(bins, pa.int64())],
                                             ["toxic", "expected", "bin"])

    return best


def probability(x: float, model: dict) -> float:
    a, b = model["curve"]
    return 1 / (1 + math.exp(-max(min(a + b * min(x, 250.0), 30), -30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of docs: doc_id, score, n_passages and passages (start, end, text, evidence)."""
    bounded_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()),
                                   ("evidence", pa.float64())]))
        for b in batches:
            scores, passages = [], []
            for text in b.column("text").to_pylist():
                total, kept = evidence(_words(text), model)
                scores.append(probability(total, model))
                found = []
                if kept:
                    spans = [m.span() for m in word_spans(text.lower())]
                    same = len(text.lower()) == len(text)
                    for first, last, x in kept:
                        s, e = spans[first][0], spans[last][1]
                        found.append({"start": s, "end": e, "text": (text if same else text.lower())[s:e], "evidence": x})
                passages.append(found)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([len(p) for p in passages], pa.int32()),
                 pa.array(passages, kind)], ["doc_id", "score", "n_passages", "passages"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(judge, "doc_id long, score double, n_passages int, "
                                 "passages array<struct<start: int, end: int, text: string, evidence: double>>")
