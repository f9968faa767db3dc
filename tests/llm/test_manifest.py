import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tenetdq.llm import merkle
from tests.llm.helpers import ODD, docs_of, empty

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """The root, and for each leaf its (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            low = a - a % 3
            run = nodes[low:low + 3]
            paths[i].append(("".join(run[:a - low]), "".join(run[a - low + 1:])))
        nodes = [h(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
        at = [a // 3 for a in at]
    return nodes[0], paths


def by_hand(rows):
    """doc_id, leaf, subroot, root, proof, path of each row."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf_by_hand(r)), r[0]) for r in rows if r[1] == s)
        leaves = [k[2] for k, _ in own]
        inner[s] = ([d for _, d in own], leaves, *tree(leaves))
    root, outer = tree([inner[s][2] for s in sources])
    out = []
    for s, above in zip(sources, outer):
        docs, leaves, subroot, paths = inner[s]
        for d, leaf, path in zip(docs, leaves, paths):
            whole = path + above
            out.append((d, s, leaf, subroot, root, h(*[x + y for x, y in whole]), [(x, y) for x, y in whole]))
    return out


def manifest(docs):
    leaves = docs.select("doc_id", "source", merkle.leaf(*[F.col(c) for c in FIELDS]).alias("leaf"))
    return merkle.manifest(leaves)


def key(row):
    return str(row[1]), row[0] is not None, row[0] or 0, row[2]


def check(docs):
    got = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, r.proof, [tuple(s) for s in r.path]) for r in
           manifest(docs).withColumn("proof", merkle.proof(F.col("path"))).collect()]
    want = by_hand([tuple(r) for r in docs.select(*FIELDS).collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


@pytest.mark.parametrize("levels,small", [(6, True), (2, True), (1, False)])
def test_manifest_equals_the_tree_by_hand(spark, monkeypatch, levels, small):
    rng = random.Random(levels)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "WIDTH", 3 ** levels)
    if not small:                                           # the tiers are joined by a shuffle
        monkeypatch.setattr("tenetdq.functions.lookup.BROADCAST_ROWS", 0)
    rows = []
    for source, n in (("hot", 100), ("é", 28), ("a", 27), ("Z", 9), ("b", 3), ("c", 1), (None, 4), ("", 2), ("0", 1), ("1", 2)):
        rows += [(rng.randrange(200), f"t{rng.random()}\n", "en", source, rng.choice([None, 3])) for _ in range(n)]
    rows += [(7, "same", "en", "b", 1)] * 3 + [(None, None, None, None, None)] * 2 + [(None, "x", "en", "hot", 1)]
    rows += [(1000 + i, t, "en", "odd", i) for i, t in enumerate(ODD)]
    check(docs_of(spark, rows).repartition(3))


def test_tampered_rows_fold_to_another_root(spark):
    rows = [(i, f"a\nb{i}" if i % 2 else f"ab{i}", "en", f"s{i % 3}", 4) for i in range(40)]
    docs = docs_of(spark, rows)
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    leaves = docs.select("doc_id", "source", merkle.leaf(*[F.col(c) for c in FIELDS]).alias("leaf"),
                         merkle.leaf(*[F.col(c) for c in FIELDS[:-1]], F.coalesce(cut, F.col("text"))).alias("claimed"))
    for r in merkle.manifest(leaves, keep=["claimed"]).withColumn("up", merkle.fold(F.col("claimed"), F.col("path"))).collect():
        tampered = r.doc_id % 2 == 1 and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        assert (r.up == r.root) == (not tampered) and (r.claimed == r.leaf) == (not tampered)


def test_no_rows_one_row_and_other_columns(spark):
    assert manifest(empty(spark)).count() == 0
    one = check(docs_of(spark, [(5, "x", "en", "s", 1)]))[0]
    assert one[2] == one[3] == one[4] and one[5] == h() and one[6] == []
    clash = docs_of(spark, [("b", "x", "en", "s", 1, 2, 3, 4), ("a", "y", "en", "s", 1, 2, 3, 4)],
                    "doc_id string, text string, lang string, source string, n_chars long, g long, pos long, node long")
    got = manifest(clash).orderBy("pos").collect()
    assert [r.doc_id for r in got] == ["a", "b"]
