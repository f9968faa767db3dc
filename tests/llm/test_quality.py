import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tenetdq.llm import quality_rules
from tenetdq.llm.queries import QUERIES
from tests.llm.helpers import ODD, docs_of, empty

SF = "/root/testdata/sf0.001"
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def base_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def char_class(c):
    k = unicodedata.category(c)
    if k in ("Ll", "Lu"):
        return 2 * (k == "Lu") + (not c.isascii())
    if c in " \n.,;:!?":
        return 7 if c == " " else 8 if c == "\n" else 9
    return {"L": 4, "M": 5, "N": 6, "P": 10, "S": 11}.get(k[0], 12)


def middle(shares, folds):
    return sorted([0.0] * (folds - len(shares)) + shares)[(folds - 1) // 2]


def distance(counts, ref):
    n = sum(counts.values())
    found = 0.0
    for k in set(counts) | set(ref):
        p, q = counts.get(k, 0) / n, ref.get(k, 0.0)
        for x in (p, q):
            if x:
                found += x / 2 * math.log2(2 * x / (p + q))
    return math.sqrt(max(0.0, found - (sum(q > 0 for q in ref.values()) - 1) / (8 * n * math.log(2))))


def by_hand(rows, least_docs=20):
    """Both distances of each (text, lang), or None."""
    shares = defaultdict(lambda: defaultdict(Counter))
    docs = defaultdict(Counter)
    for text, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) < 50:
            continue
        fold = min(zlib.crc32(w.encode()) for w in ([w for w in words if len(w.encode()) >= 8] or words)) % 5
        docs[lang][fold] += 1
        shares[lang, "c"][fold].update(map(char_class, text))
        shares[lang, "w"][fold].update(w.lower().strip(OUTER) for w in words)
    refs = {}
    for lang, folds in docs.items():
        if sum(folds.values()) < least_docs:
            continue
        for kind in "cw":
            own = shares[lang, kind]
            ref = {k: middle([c[k] / sum(c.values()) for c in own.values() if k in c], len(folds)) for k in set().union(*own.values())}
            if kind == "c":
                ref = {k: v / sum(ref.values()) for k, v in ref.items() if v}
            else:
                ref = {k: v for k, v in ref.items() if v >= 0.002}
                ref[None] = max(0.0, 1 - sum(ref.values()))
                ref = {k: v / sum(ref.values()) for k, v in ref.items()}
            refs[lang, kind] = ref
    out = []
    for text, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        dc = dw = None
        if (lang, "c") in refs:
            if len(text or "") >= 200:
                dc = distance(Counter(map(char_class, text)), refs[lang, "c"])
            if len(words) >= 50:
                ref = refs[lang, "w"]
                cores = (w.lower().strip(OUTER) for w in words)
                dw = distance(Counter(c if c in ref else None for c in cores), ref)
        out.append((dc, dw))
    return out


def close(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)


def compare(spark, rows, docs, got):
    for r, (text, lang), (dc, dw) in zip(got, rows, by_hand(rows)):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_by_hand(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert close(r.char_distance, dc) and close(r.word_distance, dw)
        assert r.kept == (not r.base_failed and (dc or 0) <= quality_rules.CHAR_DISTANCE and (dw or 0) <= quality_rules.WORD_DISTANCE)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(QUERIES["op12_quality_rules"](spark, SF).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [r.doc_id for r in docs]
    compare(spark, [(r.text, r.lang) for r in docs], docs, got)
    assert any(r.kept for r in got) and any(not r.kept and not r.base_failed for r in got)


def prose(rng, n, common=("the", "of", "and", "to")):
    return " ".join(rng.choice(common) if rng.random() < 0.4 else f"{rng.choice('bcdfg')}{rng.randrange(900)}word".capitalize()
                    for _ in range(n)) + "."


def test_odd_rows_and_hot_copies(spark, monkeypatch):
    rng = random.Random(2)
    copied = " | ".join("x" * rng.randrange(4, 9) for _ in range(80))     # a third of the rows: not their language's reference
    rows = [(prose(rng, rng.randrange(60, 200)), rng.choice(["en", None])) for _ in range(120)]
    rows += [(copied, "en")] * 60 + [(t, "en") for t in ODD] + [(prose(rng, 80), "rare"), ("a\n\na\n b\na\x0b", "en")]
    rows += [("é　x 日本 &|<>#\n" * 30, "en")]
    docs = docs_of(spark, [(i, t, lang, "s", i) for i, (t, lang) in enumerate(rows)]).repartition(3)
    monkeypatch.setattr(quality_rules, "FLUSH_WORDS", 500)
    got = sorted(quality_rules.judge(docs).collect(), key=lambda r: r.doc_id)
    compare(spark, rows, docs, got)
    assert all(r.kept for r in got[:120]) and not any(r.kept for r in got[120:180])
    monkeypatch.setattr("tenetdq.functions.lookup.BROADCAST_ROWS", 0)
    shuffled = sorted(quality_rules.judge(docs).collect(), key=lambda r: r.doc_id)
    assert shuffled == got


def test_empty_and_other_columns(spark):
    assert quality_rules.judge(empty(spark)).count() == 0
    clash = docs_of(spark, [("i", "x y", "en", 1, 2, 3), (None, None, None, 1, 2, 3)],
                    "doc_id string, text string, lang string, g long, ref long, n_words long")
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in quality_rules.judge(clash).collect()) == [("None", 0, False), ("i", 2, False)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab #|\n\t\x0b　é"), max_size=120))
def test_base_counts_equal_brute_force(text):
    assert tuple(quality_rules.base_counts(text)[0].tolist()) == base_by_hand(text)
