import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tenetdq.llm import components, exact_dedup, near_dedup
from tests.llm.helpers import ODD, corpus, docs_of, edited, empty, texts, words


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return {body: (min(g)[2] if not min(g)[1] else None, len(g)) for body, g in groups.items()}


@pytest.mark.parametrize("window", [exact_dedup.WINDOW_ROWS, 3])
def test_exact_dedup_matches_brute_force(spark, monkeypatch, window):
    rng = random.Random(3)
    values = ODD + [rng.choice(["a b", "ab", "a\tb ", "long text here", "longtext here", "z"]) for _ in range(200)]
    rows = list(enumerate(values))
    monkeypatch.setattr(exact_dedup, "WINDOW_ROWS", window)
    got = exact_dedup.exact_dedup(texts(spark, values).repartition(3)).collect()
    by_hand = exact_by_hand(rows)
    assert len(got) == len(rows)
    for r in got:
        body = re.sub("[\x20\x09-\x0d]", "", values[r.doc_id] or "")
        assert (r.keep_id, r.group_size) == by_hand[body]
        assert r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_exact_stage_keeps_one_of_repeated_rows_and_all_columns(spark):
    schema = "doc_id long, text string, kept string, hash int, row double, rest string"
    rows = [(1, "a b", "x", 1, 0.5, None)] * 3 + [(None, "ab", "y", None, None, "r"), (2, None, None, 2, None, "q"),
                                                   (None, None, None, 3, None, None)]
    docs = docs_of(spark, rows, schema)
    kept = exact_dedup.keep_owners(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], (2, None, None, 2, None, "q")], key=str)


def test_empty_tables(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    assert exact_dedup.keep_owners(empty(spark)).count() == 0
    assert near_dedup.near_dedup(empty(spark)).count() == 0
    assert near_dedup.keep_one(empty(spark)).count() == 0


def test_trie_numbers_distinct_strings():
    rng = random.Random(5)
    trie, seen = exact_dedup.RadixTrie(), {}
    for _ in range(3000):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))
        assert trie.insert(s) == seen.setdefault(s, len(seen))


def near_by_hand(values, size, percent):
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    sets = []
    for t in values:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set())
    above = list(range(len(values)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                above[max(a, b)] = min(a, b)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 4])
def test_near_dedup_matches_brute_force(spark, monkeypatch, block):
    rng = random.Random(9)
    base = " ".join(words(rng, 80))
    values = corpus() + [edited(rng, base, 2) for _ in range(40)] + [base.upper()] + ODD
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = near_dedup.near_dedup(texts(spark, values).repartition(3), shingle=3, threshold=0.85)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    assert rows == near_by_hand(values, 3, 85)
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def test_near_stage_keeps_one_of_each_component(spark):
    values = corpus(seed=4, groups=5) + ["", None, "a b c d e f g"] * 2
    docs = texts(spark, values).withColumn("key", F.lit(1)).withColumn("sig", F.lit("x"))
    docs = docs.unionByName(docs)                            # every row twice
    kept = near_dedup.keep_one(docs, 5, 0.8)
    heads = {r for i, n, r in near_by_hand(values, 5, 80) if n}
    ids = [r.doc_id for r in kept.where("trim(coalesce(text, '')) <> ''").collect()]
    assert sorted(ids) == sorted(heads)
    assert kept.columns == docs.columns
    assert kept.where("trim(coalesce(text, '')) = ''").count() == 8


def test_pruning_bounds_keep_pairs_at_the_threshold():
    least = near_dedup.least_matches(0.85)
    assert len(least) == near_dedup.HASHES // near_dedup.BATCH
    assert all(a < b for a, b in zip(least, least[1:], strict=False))
    assert least[-1] < 0.85 * near_dedup.HASHES


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 150)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    names = list({x for p in links for x in p})
    shuffled = dict(zip(names, rng.sample(names, len(names)), strict=True))
    got = components.components(spark.createDataFrame([(shuffled[a], shuffled[b]) for a, b in links], "a long, b long"))
    found = {r.node: r.label for r in got.collect()}
    for part in (range(61), range(100, 150), range(200, 203)):
        assert {found[shuffled[x]] for x in part} == {min(shuffled[x] for x in part)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
