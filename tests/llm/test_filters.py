import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tenetdq.llm import chat_format, decontaminate, lang_id, secret_scan, toxicity, url_filter
from tenetdq.llm.common import table
from tenetdq.llm.queries import ORACLES, QUERIES, URL_RULES
from tenetdq.suite.check import compare
from tests.llm.helpers import ODD, docs_of, empty, texts, words

SF = "/root/testdata/sf0.01"


def test_urls_take_the_longest_rule_and_aliases_the_component(spark):
    canonical = '<html><LINK href="{}" rel="canonical"></html>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.example.com/en/x", None), (2, "http://a.WWW.example.com/en/x?q#f", ""), (3, "https://x.net/es/1", ""),
        (4, "http://x.org/a", canonical.format("http://y.net/fr/1")),          # alias of a blocked target
        (5, "http://x.org/b", canonical.format("/a")),                          # chain: b -> a -> blocked
        (6, "http://x.org/c?p=1", refresh.format("http://z.net/es/2")),
        (7, "http://z.net/es/2", canonical.format("http://ok.com/q")),          # explicit allow in the component
        (8, "http://x.org/lonely", ""), (9, None, canonical.format("http://y.net/fr/1")), (10, "no scheme", None),
        (11, "http://com", ""), (12, "http://x.org/a#frag", ""), (12, "http://x.org/a#frag", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.by) for r in url_filter.judge(
        spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block", "rule")
    assert got[2] == ("a.www.example.com", "/en/x", "www.example.com/en/", "allow", "rule")
    assert got[3][2:] == ("net/es/", "block", "rule")
    assert got[4][3:] == got[5][3:] == got[12][3:] == ("block", "alias")
    assert got[6][3:] == ("allow", "alias") and got[7][3:] == ("block", "rule")
    assert got[8][3:] == ("allow", "default")
    assert got[9] == ("", "", None, "allow", "default") and got[10] == ("", "", None, "allow", "default")
    assert got[11] == ("com", "", None, "allow", "default")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_all_links_of_a_page_are_aliases(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    pages = [(1, "http://x.org/a", canonical.format("http://x.org/other") + canonical.format("http://y.net/fr/1")),
             (2, "http://x.org/b", refresh.format("/other2") + "text" + refresh.format("http://z.net/es/2")),
             (3, "http://x.org/other", None), (4, "http://x.org/other2", ""), (5, "http://x.org/lonely", "canonical")]
    got = {r.page_id: (r.verdict, r.by) for r in url_filter.judge(
        spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {i: ("block", "alias") for i in range(1, 5)} | {5: ("allow", "default")}


RELATIVE = [
    ("http://h.org/a/b.html", "#top", None, None), ("http://h.org/a/b.html", "?p=2", None, "h.org/a/b.html?p=2"),
    ("http://h.org/a/b.html?x=1", "?p=2&amp;q=3#f", None, "h.org/a/b.html?p=2&q=3"), ("http://h.org/a/b/c", "../x", None, "h.org/a/x"),
    ("http://h.org/a/b", "../../../x/./y/..", None, "h.org/x/"), ("http://h.org", "x", None, "h.org/x"), ("http://h.org/a/b", "/c/../d", None, "h.org/d"),
    ("http://h.org/a/b", "//Other.org/q/../r", None, "other.org/r"), ("https://h.org/a/b", "mailto:x@y.z", None, None),
    ("http://h.org/a/b", "x", "/base/dir/", "h.org/base/dir/x"), ("http://h.org/a/b", "x", "http://cdn.net/es/..", "cdn.net/x"),
    ("http://h.org/a/b", "", "http://cdn.net/", None), ("http://h.org/a/../e", "f", None, "h.org/f"), ("http://h.org/a/b", "HTTP://H.org/z#q", None, "h.org/z"),
    ("http://h.org/a/b", "y:1/z", None, None), ("http://h.org/a/b", "./y:1/z", None, "h.org/a/y:1/z")]


def html_of(link, base=None):
    return (f"<base target=x href='{base}'>" if base else "") + f'<link href="{link}" rel="canonical">'


def test_links_resolve_as_rfc_3986_says(spark):
    pages = spark.createDataFrame([(i, u, html_of(t, b)) for i, (u, t, b, _) in enumerate(RELATIVE)], "page_id long, url string, html string")
    got = {tuple(r) for r in url_filter.alias_links(pages).collect()}
    own = lambda u: "h.org/e" if ".." in u else u.split("://")[1]
    assert got == {(own(u), want) for u, _, _, want in RELATIVE if want}


def test_planted_pages_equal_the_sql(spark, tmp_path):
    rng = random.Random(6)
    hosts, paths = ["x.org", "a.net", "www.example.com", "b.example.com"], ["", "/", "/es/1", "/fr/2", "/en/x", "/en/../es/z", "/q?k=1", "/d/e/f"]
    links = ["#t", "?k=1", "../es/1", "/fr/2", "http://a.net/es/1", "//x.org/q?k=1", "d/./e", "mailto:a@b.c", "https://www.example.com/en/x"]
    rows = [(i, "http://" + rng.choice(hosts) + rng.choice(paths), "".join(
        [html_of(rng.choice(links), rng.choice([None, None, "/d/", "http://a.net/fr/.."]))]
        + [f'<link rel=canonical href={rng.choice(links)}>'] * rng.randrange(2)
        + [f"<meta http-equiv='refresh' content='1; url={rng.choice(links)}'>"] * rng.randrange(2))) for i in range(80)]
    rows += [(*r, None) for r in [(900, None), (901, "http://lonely.org/")]]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    ok, message, _ = compare(spark, "op3", QUERIES["op3_url_filter"], ORACLES["op3_url_filter"], str(tmp_path))
    assert ok, message
    got = QUERIES["op3_url_filter"](spark, str(tmp_path)).groupBy("by", "verdict").count().collect()
    assert {(r["by"], r["verdict"]) for r in got} >= {("alias", "allow"), ("rule", "block"), ("default", "allow")}


CHATS = ["plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant<|im_sep|>x", "a\\b <\\s>", "<<SYS>> <</SYS>>",
         "<\\\\|im_end|>", "<<|im_end|>", "<<s>", "<", "[INST]", "é🙂\n", "", None, "<|im_start|>", "x<|im_sep|>y", "<|im_end|>"]


def test_chats_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a<|im_sep|>b"]), rng.choice(CHATS))
            for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.digests(chats).collect()}
    lengths = {r.conv_id: (len(r.formatted), sum(m.before + m.inside + m.after for m in r["mask"])) for r in chats.collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        d = got[c]
        assert (d.n_turns, d.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert lengths[c] == (d.formatted_chars, d.formatted_chars)


def test_escaping_leaves_ordinary_text_and_hides_control_strings(spark):
    df = spark.createDataFrame([(c or "",) for c in CHATS], "t string")
    for r in df.select("t", chat_format.escape(F.col("t")).alias("e"),
                       chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "<|im_sep|>"))


ITEM = ("Maria buys 12 apples and gives 5 apples to her brother while Maria keeps the rest in a basket that weighs 3 kg before "
        "walking home along the river with 12 stones")


def benchmark(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_decontamination_finds_reparameterised_items(spark):
    other = ITEM.replace("Maria", "Peter").replace("12", "40").replace(" 5 ", " 9 ").replace("3 kg", "7 pounds")
    broken = ITEM.replace("gives 5", "gives 6").replace("12 stones", "99 stones").replace("Maria keeps", "Paul keeps")
    rng = random.Random(8)
    noise = " ".join(words(rng, 300))
    values = [noise, f"{noise}. {ITEM}. {noise}", f"intro. {other} end", f"{noise}. {broken}", " ".join(ITEM.split()[:9]), *ODD]
    got = decontaminate.matches(texts(spark, values), benchmark(spark, ITEM, "", None, ITEM, "w1")).collect()
    assert {(r.doc_id, tuple(r.item_ids), r.reparameterised) for r in got} == {(1, (0, 3), False), (2, (0, 3), True)}
    kept = decontaminate.keep_clean(texts(spark, values), benchmark(spark, ITEM))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(values)) if i not in (1, 2)]
    assert kept.columns == texts(spark, ["x"]).columns
    assert decontaminate.matches(empty(spark), benchmark(spark, ITEM)).count() == 0
    assert decontaminate.matches(texts(spark, values), benchmark(spark)).count() == 0


def test_decontamination_finds_planted_items(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r.doc_id, i) for r in QUERIES["op6_benchmark_decontamination"](spark, SF).collect() for i in r.item_ids}
    true = {(r.doc_id, r.item_id) for r in docs.join(items.withColumnRenamed("text", "item"), F.expr("contains(text, item)")).collect()}
    assert true <= got and len(got - true) <= 0.02 * len(true) + 1


def test_decontamination_finds_edited_items(spark):
    plain = ("the old miller carries heavy sacks of brown flour across the narrow bridge every morning before "
             "his neighbours wake up")
    middle = plain.replace("flour across", "flour slowly across")
    left_out, changed = plain.replace(" the narrow", " narrow"), plain.replace("narrow", "little")
    named = "Boston has a wide river and people from Boston walk along it with their dogs when Boston gets warm"
    moved = named.replace("Boston", "New York")
    values = [middle, left_out, changed, moved, f"a b c. {moved} d e", plain.replace("of brown flour across the narrow bridge", "and")]
    got = {(r.doc_id, tuple(r.item_ids), r.reparameterised)
           for r in decontaminate.matches(texts(spark, values), benchmark(spark, plain, named)).collect()}
    assert got == {(0, (0,), False), (1, (0,), False), (2, (0,), False), (3, (1,), True), (4, (1,), True)}


def test_decontamination_judges_slots_by_each_item_of_a_template(spark):
    form = "a farmer puts {} apples in one basket and then {} pears in another one and sells {} of them later"
    items = [form.format(5, 5, 9), form.format(5, 7, 9)]
    values = [items[1], items[0], form.format(1, 1, 2), form.format(1, 3, 2)]
    got = {(r.doc_id, i, r.reparameterised)
           for r in decontaminate.matches(texts(spark, values), benchmark(spark, *items)).collect() for i in r.item_ids}
    assert {d for d, _, _ in got} == {0, 1, 2, 3}
    assert {(0, 1, False), (1, 0, False)} <= got and (0, 0, False) not in got
    assert not {(0, 0, True), (3, 0, True)} & got


def test_decontamination_finds_short_and_wordless_items(spark):
    items = ["how do magnets pull iron", "12 + 30 = 42 and 7 x 8 = 56 so 9", "Anna Bella Carla Dora Emma Frida Greta Hanna Ida", "yes"]
    noise = "some other words that stand before it and after"
    values = [f"{noise} {i} {noise}" for i in items] + ["yes", noise]
    got = {(r.doc_id, tuple(r.item_ids)) for r in decontaminate.matches(texts(spark, values), benchmark(spark, *items)).collect()}
    assert got == {(0, (0,)), (1, (1,)), (2, (2,)), (4, (3,))}


def test_languages_on_held_out_documents(spark):
    got = QUERIES["op7_language_id"](spark, SF)
    judged = got.join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = judged.where("lang = lang_pred").count(), judged.count()
    assert got.count() == 1000 and n > 250 and right >= 0.98 * n
    assert got.where("score < 0 or score > 1").count() == 0


def test_number_signs_are_no_letters_and_sets_agree(spark):
    """Number signs have no language; predictions equal those of exact sets of trigrams, also beyond one filter word of languages."""
    rng = random.Random(7)
    names = [f"l{i:03d}" for i in range(70)]
    alphabet = {n: [chr(0x4E00 + 40 * i + k) for k in range(30)] for i, n in enumerate(names)}
    said = lambda n: " ".join("".join(rng.choices(alphabet[n], k=6)) for _ in range(40))
    model = lang_id.learn(spark.createDataFrame([(said(n), n) for n in names for _ in range(3)], "text string, lang string"))
    assert model["filter"].shape[0] == 2
    rows = [(i, said(n), None, None, None) for i, n in enumerate(names)] + [(100 + i, t, None, None, None) for i, t in enumerate(
        ["\u00b2", "\u00bd \u2460", "\u2167 \u2170", "12 3", "_"])]
    got = {r["row"].doc_id: r for r in lang_id.predict(docs_of(spark, rows), model).collect()}
    assert [got[i].lang_pred for i in range(70)] == names
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in range(100, 105))


def test_language_rejects_only_what_has_no_language(spark):
    model = lang_id.learn(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"),
                                                 ("x", None)], "text string, lang string"))
    assert model["names"] == ["de", "en"]
    values = ["the dog and the cat", "die katze und der hund", None, "", "1234 !!", "日本語のテキスト", "a" * 300_000 + " the cat"]
    docs = texts(spark, values).withColumn("share", F.lit("x"))
    got = {r["row"].doc_id: r for r in lang_id.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "de", "und", "und", "und"]
    assert [got[i].accepted for i in range(6)] == [True, True, False, False, False, False]
    nothing = lang_id.learn(empty(spark).select("text", "lang"))
    plain = {r["row"].doc_id: (r.lang_pred, r.accepted) for r in lang_id.predict(docs, nothing).collect()}
    assert plain[0] == ("und", True) and plain[2] == ("und", False)
    assert lang_id.keep_accepted(empty(spark)).count() == 0


def segments_by_hand(scores):
    """All maximal scoring segments by their recursive definition."""
    best, at = 0, None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    return (segments_by_hand(scores[:i]) + [(i, j, best)]
            + [(a + j + 1, b + j + 1, s) for a, b, s in segments_by_hand(scores[j + 1:])])


def test_maximal_segments_match_their_definition():
    rng = random.Random(12)
    for _ in range(200):
        scores = [rng.choice([-0.25] * 4 + [0.37, 1.013, 2.0101]) for _ in range(rng.randrange(1, 30))]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.25)
        assert [(a, b, pytest.approx(s)) for a, b, s in segments_by_hand(scores)] == got


def test_toxicity_on_held_out_documents(spark):
    got = QUERIES["op10_toxicity"](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    ranks, toxic = got.score.rank(), got.toxic == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.8 and (got.predicted == got.toxic).mean() > 0.9


def test_toxicity_passages_and_odd_rows(spark):
    rng = random.Random(5)
    bad = [" ".join(words(rng, 30)) + " you stupid idiot " + " ".join(words(rng, 30)) for _ in range(60)]
    good = [" ".join(words(rng, 60)) for _ in range(240)]
    docs = texts(spark, bad + good)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    values = ["w1 w2 W3 Stupid IDIOT w4 w5", None, "", "w1 w2 w3", "stupid idiot " * 30_000]
    got = {r.doc_id: r for r in toxicity.score(texts(spark, values), model).collect()}
    assert got[0].score > 0.5 > got[3].score and got[1].score == got[2].score < 0.5
    assert [p.text for p in got[0].passages] == ["Stupid IDIOT"]
    assert got[4].score > 0.5 and got[4].n_passages == 1
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r.score < 0.01 for r in toxicity.score(docs, none).collect()} == {True}
    assert toxicity.score(empty(spark), model).count() == 0


def test_secrets_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    values = [f'some text token = "{h}" and more words here' for h in hexes] + ["averyveryverylongword in between " * 3] * 40 + ODD
    got = secret_scan.scan(texts(spark, values)).collect()
    assert {(r.doc_id, r.value) for r in got} == set(enumerate(hexes))
    assert all(values[r.doc_id][r.start - 1:r.start - 1 + len(r.value)] == r.value for r in got)
    assert secret_scan.scan(empty(spark)).count() == 0
    alone = secret_scan.scan(texts(spark, ["only anotherratherlongword here"])).collect()
    assert [(r.value, r.probability) for r in alone] == [("anotherratherlongword", None)]
    assert secret_scan.scan(docs_of(spark, [(None, None, None, None, None)])).count() == 0


def test_secrets_are_judged_by_their_likeliest_neighbourhood(spark):
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    bare = [f"x{h} and {h} stands here. token = \"{h}\" then." if i % 2 else f"a line with token = \"{h}\" and no more"
            for i, h in enumerate(hexes)]
    digests = [f"file {''.join(rng.choice('0123456789abcdef') for _ in range(40))} has changed" for _ in range(40)]
    labelled = secret_scan.findings(texts(spark, bare + digests)).withColumn(
        "label", F.regexp_like("before", F.lit("token = .$")).cast("int"))
    got = {(r.doc_id, r.value): r for r in secret_scan.scan(texts(spark, bare + digests), labelled=labelled).collect()}
    assert set(got) == set(enumerate(hexes))
    for (d, h), r in got.items():
        at = [k + 1 for k in range(len(bare[d])) if bare[d].startswith(h, k) and bare[d][k - 1] != "x"]
        assert (r.start, r.starts, r.n_times) == (at[0], at, len(at))


def test_secrets_in_unquoted_assignments_come_without_their_name(spark):
    rng = random.Random(6)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    forms = ["export API_KEY={}\n", "see http://x.org/a?token={}&b=1 there", "MY_SERVICE_API_KEY={}", "password: {}=="]
    values = [forms[i % 4].format(h) for i, h in enumerate(hexes)] + ["averyveryverylongword in between " * 3] * 40
    got = {(r.doc_id, r.value) for r in secret_scan.scan(texts(spark, values)).collect()}
    assert {(i, h + "==" * (i % 4 == 3)) for i, h in enumerate(hexes)} <= got
    assert {v for _, v in got} - {h + p for h in hexes for p in ("", "==")} <= {"MY_SERVICE_API_KEY"}
    found = {r.value: r for r in secret_scan.findings(texts(spark, ["a=b0123456789abcd==x 0123456789abcd== k==0123456789abcdef"])).collect()}
    assert set(found) == {"0123456789abcd==", "0123456789abcdef"} and found["0123456789abcdef"].before.endswith("k==")
