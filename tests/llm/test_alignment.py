import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tenetdq.llm import alignment
from tenetdq.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES
from tests.llm.helpers import ODD, docs_of, empty, texts

A = Tokenizer.from_file(BYTE_BPE)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=PIECE_BPE)


def byte_of():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in kept}
    for i, b in enumerate(x for x in range(256) if x not in kept):
        table[chr(256 + i)] = b
    return table


BYTES = byte_of()
STRANGE = [*ODD, "a  b", "a \n b", " x", "x ", " ", "  ", "a<|endoftext|>b c", "<s> x </s> <0x41><unk>", "  x  y", "\nfoo a \nfoo", "it's we'll",
           "½ ² x² 12ab", "é   x  y 　z", "tab\t\tq  \n\n z", "日本語 テキスト 🙂 x", "a\x00b \x1f c", "low ▁ line", "a▁b", "x  b", "\x1c y \x85 z",
           "日本語テキスト" * 40, "a b " * 300, "word, " * 200 + "  end  ", "🙂" * 90]


def tokens(text):
    """By the libraries, over the whole text: ids and end offsets of both, or None."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(BYTES[c] for c in t) for t in a.tokens]
    b = B.encode(text)
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    raw = (" " + text).encode()
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    ends = [[sum(map(len, x[:i + 1])) for i in range(len(x))] if len(x) < 500 else list(running(x)) for x in (a_bytes, b_bytes)]
    return a.ids, ends[0], b, ends[1]


def running(parts):
    at = 0
    for p in parts:
        at += len(p)
        yield at


def by_hand(values):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of each text, by comparing byte ranges."""
    found, corpus = [], Counter()
    for text in values:
        t = tokens(text)
        if t is None:
            found.append(None)
            continue
        a, a_ends, b, b_ends = t
        owner = {}
        for j, (s, e) in enumerate(zip([0, *b_ends], b_ends)):
            for x in range(s, e):
                owner[x] = j
        links = [(a[i], b[j]) for i, (s, e) in enumerate(zip([0, *a_ends], a_ends)) for j in sorted({owner[x] for x in range(s, e)})]
        cuts = sorted(set(a_ends) & set(b_ends))
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append(",".join(str(i) for i, e in zip(a, a_ends) if low < e <= high) + "|"
                          + ",".join(str(i) for i, e in zip(b, b_ends) if low < e <= high)) if len(a) < 2000 else None
        if len(a) >= 2000:
            groups = linear_groups(a, a_ends, b, b_ends, cuts)
        corpus.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (*f[:3], len(f[3]), sum(corpus[k] == top[k[1]] for k in f[3]), sum(corpus[k] for k in f[3]), f[4]) for f in found]


def linear_groups(a, a_ends, b, b_ends, cuts):
    place = {c: k for k, c in enumerate(cuts)}
    out = [([], []) for _ in cuts]
    for ids, ends, side in ((a, a_ends, 0), (b, b_ends, 1)):
        k = 0
        for i, e in zip(ids, ends):
            out[k][side].append(i)
            k += e in place
    return [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in out]


def rows(df):
    return sorted((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


@pytest.mark.parametrize("size,most", [(32 << 10, 6_000_000), (32 << 10, 0), (40, 6_000_000), (7, 0)])
def test_alignment_equals_the_libraries_on_whole_texts(spark, size, most):
    rng = random.Random(3)
    alphabet = "ab cZ. ,'\n\té1 _-$日  "
    values = STRANGE + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    docs = texts(spark, values).repartition(3)
    assert rows(alignment.align(docs, BYTE_BPE, PIECE_BPE, size, most)) == list(enumerate(by_hand(values)))


def test_small_caches_and_long_texts_keep_the_counts(spark, monkeypatch):
    rng = random.Random(5)
    values = [" ".join(f"word{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 9000]))) for _ in range(25)]
    monkeypatch.setattr(alignment, "CACHE_PIECES", 20)
    assert rows(alignment.align(texts(spark, values), BYTE_BPE, PIECE_BPE)) == list(enumerate(by_hand(values)))


def test_query_on_its_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = by_hand([r.text for r in docs])
    assert rows(QUERIES["op11_tokenizer_alignment"](spark, sf)) == [(r.doc_id, w) for r, w in zip(docs, want)]


def test_empty_and_other_columns(spark):
    assert alignment.align(empty(spark), BYTE_BPE, PIECE_BPE).count() == 0
    clash = docs_of(spark, [(None, "a b", 1, 2, 3), (None, "a b", 1, 2, 3)], "doc_id string, text string, ref long, n_a long, raw long")
    got = alignment.align(clash, BYTE_BPE, PIECE_BPE, size=1).collect()
    assert [(r.doc_id, r.n_a) for r in got] == [(None, 2)] * 2


tokens_of = st.lists(st.integers(1, 4), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(tokens_of, tokens_of, st.lists(st.integers(0, 40), max_size=5))
def test_fragments_are_an_associative_monoid(a, b, bounds):
    total = sum(a)
    b = [*b, total - sum(b)] if sum(b) < total else [total]          # both cover the same bytes
    part = alignment.Part(list(range(len(a))), list(running([b"x" * n for n in a])), list(range(len(b))),
                          list(running([b"x" * n for n in b])))
    cuts = [0, *sorted({x for x in bounds if 0 < x < total}), total]
    parts = [alignment.fragment(part.between(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    left = parts[0]
    for f in parts[1:]:
        left = alignment.compose(left, f)
    right = parts[-1]
    for f in reversed(parts[:-1]):
        right = alignment.compose(f, right)
    want = alignment.close(part)
    assert alignment.whole(left) == alignment.whole(right) == want
    nothing = alignment.fragment(alignment.Part())
    assert alignment.compose(nothing, left) == alignment.compose(left, nothing) == left
