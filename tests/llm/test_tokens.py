import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tenetdq.llm import orc_tokens, packing
from tenetdq.llm.tokens import Encoder, encoder
from tenetdq.session import scratch_path
from tests.llm.helpers import ODD, empty, texts, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
STRANGE = ["a  b", "a \n b", " x", "x ", "", " ", "a<|endoftext|>b c", "  x  y", "it's we'll 'don't--x", "½ ² x² 12ab",
           "é   x  y 　z", "tab\t\tq  \n\n z", "no.\nThe end!!! ***a$$$ b_c _d", "日本語 テキスト 🙂 x", "a\x00b \x1f"]


TOKENIZER = Tokenizer.from_file(PATH)


def library(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    rng = random.Random(1)
    alphabet = "ab Z.,'\n\té1 _-$"
    samples = STRANGE + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    enc = Encoder(PATH, pieces=50)                           # several cache generations
    tok = Tokenizer.from_file(PATH)
    for _ in range(2):
        for s, raw in zip(samples, enc.encode(samples), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids, s


def test_orc_round_trip(spark):
    values = STRANGE + ODD
    docs = texts(spark, values).repartition(4)
    path = scratch_path(spark, "test-orc")
    orc_tokens.write_ids(docs, path, PATH, end_id=2)
    got = sorted(map(tuple, orc_tokens.digests(spark, path).collect()))
    start = 0
    for i, text in enumerate(values):
        ids = [*library(text), 2]
        assert got[i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = orc_tokens.read_ids(spark, path, "doc_id = 5")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in one._jdf.queryExecution().toString()
    assert one.first().ids == [*library(values[5]), 2]


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_places_every_piece_and_fills_sequences(spark):
    rng = random.Random(6)
    values = STRANGE + ODD + [" ".join(words(rng, rng.randrange(1, 300))) for _ in range(400)]
    docs = texts(spark, values).repartition(24)
    pieces = packing.cut_pieces(docs, PATH, end_id=0, capacity=256)
    rows = packing.pack(pieces, 256).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, text in enumerate(values):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        ids = [*library(text), 0]
        assert [x for r in parts for x in r.ids] == ids
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert all(r.length == 256 for r in parts[1:]) and (len(ids) > 256 or len(parts) == 1)
    total = sum(r.length for r in rows)
    assert check_packing(rows, 256) <= 1.03 * total / 256 + 1


def test_packing_merges_small_parts_over_levels(spark):
    pieces = spark.range(0, 300, 1, 100).selectExpr("id as doc_id", "cast(1 as bigint) as length", "id as slot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        rows = packing.pack(pieces, 100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == 300 and check_packing(rows, 100) <= 5


def test_best_fit_takes_the_tightest_room():
    where, offset, fill = packing.best_fit([60, 50, 40, 40, 10], 100)
    assert sorted(fill) == [100, 100] and where[0] == where[2]


def test_a_worker_holds_the_cache_of_one_operator():
    """Workers are reused by all stages: whoever comes next gives up what the operator before kept."""
    from tenetdq.llm import common, decontaminate, near_dedup
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = encoder(path)
    assert encoder(path) is first
    near_dedup.shingle_set([b"a"] * 9, 5)
    assert list(common._caches) == ["near_dedup"]
    words, hashes, kinds, starts = decontaminate.words_of("One two. Three 4 kg")
    assert list(common._caches) == ["decontaminate"] and len(words) == 5
    assert starts.tolist() == [True, False, True, False, False]
    assert encoder(path) is not first


def test_empty(spark):
    path = scratch_path(spark, "test-orc")
    orc_tokens.write_ids(empty(spark), path, PATH, end_id=2)
    assert orc_tokens.digests(spark, path).count() == 0
    assert packing.pack(packing.cut_pieces(empty(spark), PATH, 0, 2048), 2048).count() == 0
