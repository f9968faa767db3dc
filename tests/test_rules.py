import random

import pytest

from helpers import countries, frame_of, monotone, rows_of, sums
from tenetdq.functions.running import average_rank, running, weighted_median
from tenetdq.operators import contract as ct
from tenetdq.operators import decompose as dn
from tenetdq.operators import monitors as mo
from tenetdq.operators import repair as rp
from tenetdq.operators.scoring import score_rows, summarize, top_rows
from tenetdq.plans import algebra as al
from tenetdq.plans.constraints import DenialConstraint, FunctionalDependency as FD, LinearConstraint, Predicate as P

GEO = FD(("country",), "continent", 0.995)


def brute(rows, dc):
    """Rows that satisfy all predicates with some other row."""
    num = lambda v: float(v)
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: num(a) < num(b),
           "<=": lambda a, b: num(a) <= num(b), ">": lambda a, b: num(a) > num(b), ">=": lambda a, b: num(a) >= num(b)}
    return sorted(a["row_id"] for a in rows
                  if any(all(ops[p.op](a[p.left], b[p.right]) for p in dc.predicates) for b in rows))


@pytest.mark.parametrize("preds", [
    [P("g", "=", "g"), P("x", ">", "x"), P("y", "<", "y")],
    [P("g", "=", "g"), P("x", "<=", "y"), P("y", ">=", "x")],
    [P("x", ">=", "x"), P("y", "!=", "y"), P("g", "=", "g")],
    [P("g", "=", "g"), P("x", "!=", "x")],
    [P("g", "=", "g"), P("x", ">", "y")],
    [P("x", "<", "x"), P("y", "<", "y")],
    [P("g", "=", "g"), P("x", "=", "y")],
    [P("g", "=", "g"), P("x", "!=", "x"), P("y", "!=", "y")],
    [P("x", "!=", "y"), P("y", "!=", "y"), P("z", "!=", "z"), P("g", "=", "g")],
    [P("g", "=", "g"), P("x", "<", "x"), P("y", "<", "y"), P("z", ">", "z")],
    [P("x", ">", "x"), P("y", "<=", "y"), P("z", ">", "z")],
    [P("x", ">=", "y"), P("y", "<", "x"), P("z", "<=", "z"), P("g", "!=", "g")],
    [P("x", "!=", "x"), P("y", "!=", "y"), P("z", "<", "z"), P("g", "!=", "g")],
    [P("x", ">", "x"), P("y", ">", "y"), P("z", ">=", "z"), P("x", "<=", "y"), P("g", "=", "g")],
    [P("x", ">", "y")],
])
def test_denial_constraints_match_brute_force(spark, preds):
    rnd = random.Random(len(preds) * 7 + len(preds[0].left))
    frame = frame_of(spark, {"g": [rnd.choice("ab") for _ in range(60)], "x": [rnd.randint(0, 9) for _ in range(60)],
                             "y": [rnd.randint(0, 9) for _ in range(60)], "z": [rnd.randint(0, 3) for _ in range(60)]})
    dc = DenialConstraint(tuple(preds))
    got = sorted(r["row_id"] for r in mo.dc_monitor(frame, dc).select("row_id").collect())
    assert got == brute(frame.df.collect(), dc)


@pytest.mark.parametrize("front, preds", [
    (256, [P("x", ">", "x"), P("y", "<", "y"), P("z", ">=", "z"), P("g", "!=", "g")]),
    (3, [P("g", "=", "g"), P("x", ">", "x"), P("y", "<=", "y"), P("z", "<", "z")]),
])
def test_a_front_of_strong_members_leaves_little_to_the_nodes(spark, monkeypatch, front, preds):
    """Random rows: few probes and members are left for n log n rows a comparison, and the result stays that of all pairs."""
    rnd, n, left = random.Random(5), 1500, []
    frame = frame_of(spark, {"g": [rnd.choice("ab") for _ in range(n)], **{c: [rnd.randint(0, 999) for _ in range(n)] for c in "xyz"}})
    nodes = mo._by_nodes
    monkeypatch.setattr("tenetdq.functions.dominance.FRONT", front)
    monkeypatch.setattr(mo, "_by_nodes", lambda a, b, *rest: left.extend([a.count(), b.count()]) or nodes(a, b, *rest))
    dc = DenialConstraint(tuple(preds))
    got = sorted(r["row_id"] for r in mo.dc_monitor(frame, dc).select("row_id").collect())
    assert got == brute(frame.df.collect(), dc) and 0 < len(got) < n
    assert sum(left) < n if front > 100 else 0 < sum(left) < 2 * n


def test_running_spans_partitions(spark):
    rows = [(g, i, i % 7) for g in ("a", "b") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(4)
    got = running(df, ["g"], ["i"], {"s": ("sum", "v"), "hi": ("max", "v")}).collect()
    assert len(got) == 1000
    for r in got:
        assert r["s"] == sum(k % 7 for k in range(r["i"]))
        assert r["hi"] == (max((k % 7 for k in range(r["i"])), default=None))


def test_ranks_and_medians_agree_on_both_paths(spark):
    rows = [("c", float(v), n) for v, n in [(1, 2), (2, 1), (5, 3), (9, 4)]]
    h = spark.createDataFrame(rows, "c string, v double, n long")
    want = [(1.0, 0.15), (2.0, 0.3), (5.0, 0.5), (9.0, 0.85)]
    for small in (True, False):
        assert rows_of(average_rank(h, ["c"], "v", "n", small=small), "v", "rank01") == want
        assert weighted_median(h, ["c"], "v", "n", small=small).first()["median"] == 5.0
    even = spark.createDataFrame([("c", 1.0, 1), ("c", 4.0, 1)], "c string, v double, n long")
    assert {weighted_median(even, ["c"], "v", "n", small=s).first()["median"] for s in (True, False)} == {2.5}


def test_large_histograms_rank_the_same(spark, monkeypatch):
    """With the one-task bound at zero every rank and median takes the distributed route."""
    import tenetdq.operators.linear as lin
    import tenetdq.operators.marginal as mar
    import tenetdq.operators.ranking as rank
    from tenetdq.functions import running as run
    from tenetdq.operators.routed import FdLearner, RoutedLearner
    from tenetdq.operators.linear import LinearLearner
    frame, nums = countries(spark), sums(spark)
    score = lambda: (RoutedLearner([FdLearner()]).fit(frame).score(frame).orderBy("row_id").collect(),
                     LinearLearner().fit(nums).score(nums).orderBy("row_id").collect(),
                     run.rank_columns(frame.df.selectExpr("row_id", "row_id % 7 as s"), ["s"]).orderBy("row_id").collect())
    want = score()
    for module in (lin, mar, rank, run):
        monkeypatch.setattr(module, "SMALL_HISTOGRAM", 0)
    assert score() == want


def test_whole_table_scoring(spark):
    country = [str(i % 10) for i in range(1000)]
    bad = set(range(5, 1000, 34))
    frame = frame_of(spark, {"country": country, "continent": ["WRONG" if i in bad else f"c{c}" for i, c in enumerate(country)]})
    scored = score_rows(frame, [GEO])
    s = summarize(scored).first()
    assert (s["rows"], s["flagged"]) == (1000, len(bad)) and s["max_score"] > 0.9
    assert {r["row_id"] for r in top_rows(scored, len(bad)).collect()} == bad
    assert top_rows(scored, 5).first()["rule"] == "country -> continent"


def test_large_tables_take_the_shuffle_path(spark, monkeypatch):
    """Statistics too large to broadcast: hot keys by broadcast, the rest by shuffle."""
    import tenetdq.functions.lookup as lk
    frame = frame_of(spark, {"k": ["hot"] * 500 + [str(i // 2) for i in range(500)],
                             "v": ["x"] * 499 + ["y"] + [str(i % 3) for i in range(500)]})
    fd = FD(("k",), "v")
    want = rows_of(score_rows(frame, [fd]), "row_id", "score", "rule")
    monkeypatch.setattr(lk, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lk, "HOT_SHARE", 10)
    assert rows_of(score_rows(frame, [fd]), "row_id", "score", "rule") == want


def test_gate_symmetric(spark):
    stored = frame_of(spark, {"x": [1, 5], "y": [10, 50]})
    batch = frame_of(spark, {"x": [3, 3, 3], "y": [5, 60, 20]})
    rule = mo.order_constraint("x", "y")
    assert [r["accepted"] for r in mo.gate(batch, stored, [rule]).orderBy("row_id").collect()] == [False, True, True]
    both = mo.gate(batch, stored, [rule], symmetric=True).orderBy("row_id").collect()
    assert [r["accepted"] for r in both] == [False, False, True]
    assert mo.mirrored(mo.mirrored(rule)) == rule


def test_contract_cycle(spark, tmp_path):
    frame = countries(spark, bad=(), noise=False)
    contract = ct.freeze(spark, "t", [GEO], [["country"]])
    assert all(r.ok for r in ct.check(frame, contract))
    broken = countries(spark, bad=(7,), noise=False)
    res = {r.kind: r for r in ct.check(broken, contract)}
    assert res["fd"].violations == 1 and res["key"].violations == 1 and res["fd"].groups == 1
    with pytest.raises(ct.ContractViolation):
        ct.enforce(broken, contract)
    path = str(tmp_path / "c.json")
    ct.dump(contract, path)
    assert rows_of(ct.load(spark, path), "id", "kind") == rows_of(contract, "id", "kind")
    assert ct.as_rules(ct.load(spark, path)) == [GEO]
    spark.createDataFrame([(1,)], "a int").write.json(str(tmp_path / "x.json"))
    with pytest.raises(ValueError):
        ct.load(spark, str(tmp_path / "x.json"))


def test_unevaluable_records(spark):
    frame = frame_of(spark, {"x": ["1", "n/a"], "y": ["2", "3"]})
    lin = LinearConstraint((("y", 1.0), ("x", -1.0)), 1.0, 0.0)
    c = ct.freeze(spark, "t", [FD(("gone",), "x"), lin])
    odd = spark.createDataFrame([(1, "t", 9, "odd", "shape")], "version int, table string, ord int, id string, kind string")
    res = ct.check(frame, c.unionByName(odd, allowMissingColumns=True))
    assert [(r.kind, r.violations) for r in res] == [("fd", -1), ("linear", 0), ("shape", -1)]
    s = ct.check_summary(ct.check_frame(spark, res), True).first()
    assert (s["satisfied"], s["total"], s["violations"], s["failed"]) == (1, 3, 0, True)


def test_missing_numbers_score_as_zero_but_do_not_break_contracts(spark):
    frame = frame_of(spark, {"x": ["5", "?"], "y": ["5", "7"]})
    lin = LinearConstraint((("y", 1.0), ("x", -1.0)), 0.0, 0.5)
    assert [r["score"] for r in score_rows(frame, [lin]).orderBy("row_id").collect()] == [0.0, 1.0]
    assert mo.linear_monitor(frame, lin).count() == 0


def test_fd_repair_audit_and_gates(spark):
    frame = countries(spark)
    kinds = {"continent": "categorical"}
    done = rp.repair_table(frame, [GEO], kinds=kinds)
    edit = done.edits.collect()
    assert [(e["row_id"], e["column"], e["old"], e["new"], e["rule"], e["kind"]) for e in edit] == [
        (7, "continent", "Oceania", "Asia", "country -> continent", "FD")]
    assert done.repaired.df.where("row_id = 7").first()["continent"] == "Asia"
    assert rows_of(rp.undo(done.repaired, done.edits).df, "row_id", "continent") == rows_of(frame.df, "row_id", "continent")
    assert rp.repair_table(frame, [FD(("country",), "continent", 0.5)], kinds=kinds).edits.count() == 0
    assert rp.repair_table(frame, [GEO], rp.RepairConfig(max_rarity=0.001), kinds).edits.count() == 0


def test_last_rule_wins(spark):
    frame = frame_of(spark, {"a": ["1"] * 6, "b": ["2"] * 6, "v": ["x"] * 5 + ["q"], "w": ["10"] * 6})
    rules = [FD(("a",), "v"), LinearConstraint((("v", 1.0), ("w", -1.0)), 0.0, 0.0), FD(("b",), "v")]
    edits = rp.propose(frame, rules, rp.RepairConfig(max_rarity=1.0))
    assert rows_of(edits, "row_id", "ord") == [(5, 0), (5, 2)]
    assert rows_of(rp.final_edits(edits), "row_id", "new") == [(5, "x")]


def test_linear_and_order_repair(spark):
    frame = frame_of(spark, {"x": [1, 2, 3, 4], "y": [1, 1, 1, 1], "z": [2, 3, 40, 5]})
    lin = LinearConstraint((("z", 1.0), ("x", -1.0), ("y", -1.0)))
    assert rows_of(rp.linear_edits(frame, lin), "row_id", "old", "new") == [(2, "40", "4")]
    short = rp.linear_edits(frame_of(spark, {"x": [123456.7], "z": [0.0]}),
                            LinearConstraint((("z", 1.0), ("x", -1.0))), rp.RepairConfig(short_numbers=True))
    assert short.first()["new"] == "123500"
    table = monotone(spark)
    dc = mo.order_constraint("x", "y", "ctx", True, 0.98)
    hit = rp.order_edits(table, dc).where("row_id = 5").first()
    assert hit is not None and float(hit["new"]) > float(hit["old"])


@pytest.mark.parametrize("seed", range(6))
def test_decomposition_properties(spark, seed):
    rnd = random.Random(seed)
    attrs = [f"A{i}" for i in range(rnd.randint(4, 6))]
    sources = attrs[:2]
    maps = {a: (rnd.choice(sources), {str(v): str(rnd.randint(0, 3)) for v in range(4)}) for a in attrs[2:]}
    rows = []
    for _ in range(40):
        r = {s: str(rnd.randint(0, 3)) for s in sources}
        r.update({a: m[r[s]] for a, (s, m) in maps.items()})
        rows.append(r)
    frame = frame_of(spark, rows)
    schema = dn.Schema([FD((s,), a) for a, (s, _) in maps.items()])
    full = frozenset(schema.attributes)
    assert all(al.closure(k, schema.cover) >= full for k in schema.keys)
    for rels in (schema.relations_bcnf, schema.relations_3nf):
        assert frozenset().union(*[r.attributes for r in rels]) == full
    kept = [(l, r) for l, r in schema.cover if any(l | {r} <= x.attributes for x in schema.relations_3nf)]
    assert all(r in al.closure(l, kept) for l, r in schema.cover)
    if len(schema.relations_bcnf) > 1:
        out = dn.lossless(frame.df, dn.materialize(frame.df, schema.relations_bcnf)).first()
        assert (out["lost"], out["spurious"]) == (0, 0)


def test_join_size_without_joining(spark):
    """Lossy relations: counted and joined sizes agree, for a tree and for a cycle."""
    rnd = random.Random(5)
    frame = frame_of(spark, [{c: str(rnd.randint(0, 3)) for c in "abcd"} for _ in range(25)])
    for parts in (["ab", "bc", "cd"], ["ab", "bc", "ca"], ["abc", "bcd"]):
        rels = dn.explicit_relations([(p, list(p), list(p)) for p in parts])
        tables = dn.materialize(frame.df, rels)
        joined = dn.reconstruct(tables).distinct()
        attrs = joined.columns
        got = dn.lossless(frame.df, tables).first()
        whole = frame.df.select(*attrs).distinct()
        assert got["rebuilt"] == joined.count() and got["original"] == whole.count() and got["lost"] == 0
        assert got["spurious"] == joined.exceptAll(whole).count()
    cut = {"ab": frame.df.where("a <> '0'").select("a", "b").distinct(), "bc": frame.df.select("b", "c").distinct()}
    got, whole = dn.lossless(frame.df, cut).first(), frame.df.select("a", "b", "c").distinct()
    assert got["lost"] == whole.where("a = '0'").count() > 0


def test_disconnected_relations_are_refused(spark):
    frame = frame_of(spark, {"a": [1], "b": [2]})
    rels = dn.explicit_relations([("l", ["a"], ["a"]), ("r", ["b"], ["b"])])
    with pytest.raises(ValueError):
        dn.reconstruct(dn.materialize(frame.df, rels))


def test_key_load_and_links(spark):
    frame = frame_of(spark, {"k": ["1", "1", "2"], "v": ["first", "second", "third"]})
    rel = al.RelationSpec("R1", frozenset("kv"), frozenset("k"))
    assert rows_of(dn.first_per_key(frame.df, rel), "k", "v") == [("1", "first"), ("2", "third")]


def test_monitors_on_sums(spark):
    frame = sums(spark)
    lin = LinearConstraint((("z", 1.0), ("x", -1.0), ("y", -1.0)), 0.0, 0.01)
    assert [r["row_id"] for r in mo.linear_monitor(frame, lin).collect()] == [4]


@pytest.mark.parametrize("kind,make", [("long", lambda r: r.choice([None, r.randrange(-5, 99)])), ("double", lambda r: r.choice([None, r.random()])),
                                       ("string", lambda r: r.choice([None, r.choice("abcxyz")]))])
def test_running_equals_a_window_for_every_kind(spark, monkeypatch, kind, make):
    """Groups of one row and groups over all partitions, nulls in values, groups and order, several batches a partition."""
    rnd = random.Random(len(kind))
    rows = [(rnd.choice([None, "hot", "hot", "hot", f"g{rnd.randrange(40)}"]), None if i == 7 else i, make(rnd)) for i in range(700)]
    df = spark.createDataFrame(rows, f"g string, i int, v {kind}").repartition(3)
    aggs = {"hi": ("max", "v"), "lo": ("min", "v")} | ({"s": ("sum", "v")} if kind != "string" else {})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = running(df, ["g"], ["i"], aggs)
        want = running(df, ["g"], ["i"], aggs, small=True)
        key = lambda r: (r["g"] or "", -1 if r["i"] is None else r["i"])
        for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
            assert (a["g"], a["i"], a["hi"], a["lo"]) == (b["g"], b["i"], b["hi"], b["lo"])
            if kind != "string":
                assert a["s"] == pytest.approx(b["s"] or 0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert running(df.where("false"), ["g"], ["i"], aggs).count() == 0


def test_ranks_of_columns_agree_on_all_paths(spark, monkeypatch):
    from tenetdq.functions import lookup, running as run
    rnd = random.Random(9)
    rows = [(i % 50, float(rnd.randrange(30)), rnd.choice([None, 1.0, 2.0]), 3.0) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    want = rows_of(run.rank_columns(df, ["a", "b", "c"]).fillna(-1.0), "k", "a", "b", "c")
    monkeypatch.setattr(run, "SMALL_HISTOGRAM", 0)
    assert rows_of(run.rank_columns(df, ["a", "b", "c"]).fillna(-1.0), "k", "a", "b", "c") == want
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    assert rows_of(run.rank_columns(df, ["a", "b", "c"]).fillna(-1.0), "k", "a", "b", "c") == want
