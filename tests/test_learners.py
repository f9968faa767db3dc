import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import countries, frame_of, monotone, rows_of, sums
from tenetdq.operators.fd import learn_simple, mine
from tenetdq.operators.gated import GatedLearner
from tenetdq.operators.linear import LinearLearner
from tenetdq.functions import inversions as inv
from tenetdq.functions import isotonic as iso
from tenetdq.operators.order import OrderLearner, isotonic_fit
from tenetdq.operators.report import analyze
from tenetdq.operators.routed import EnsembleLearner, FdLearner, RoutedLearner
from tenetdq.plans.constraints import FunctionalDependency as FD


def worst(scores, column):
    return scores.orderBy(scores[column].desc(), "row_id").first()["row_id"]


def test_fd_learner_finds_rule_and_error(spark):
    frame = countries(spark)
    learner = FdLearner(max_lhs=1).fit(frame)
    assert "country -> continent" in map(str, learner.rules())
    assert worst(learner.score(frame), "continent") == 7


def test_simple_learner_equals_miner(spark):
    frame = countries(spark, bad=(7, 21, 90))
    assert learn_simple(frame) == mine(frame, max_lhs=1)
    assert learn_simple(frame, max_pair_entries=3) == []


def test_wide_tables_are_counted_on_grids(spark, monkeypatch):
    """Eight columns whose combinations are too many to fold: both counting routes agree."""
    from tenetdq.functions.counting import grid_pair_stats, pair_stats
    rng = np.random.default_rng(2)
    data = {f"c{i}": rng.integers(0, 20 + i, 1500) for i in range(7)}
    data["d"] = data["c0"] % 7
    frame = frame_of(spark, data)
    cols = frame.profile.modeling()
    values = frame.known_values(cols)
    assert frame._folded is None and values is not None
    keys = ["l", "r", "covered", "combos", "rows"]
    grid = rows_of(grid_pair_stats(frame.df, cols, values), *keys)
    assert grid == rows_of(pair_stats(frame.weighted(cols), cols), *keys) and len(grid) == 56
    want = mine(frame)
    assert "c0 -> d" in map(str, want)
    for step in (1, 3, 50):
        monkeypatch.setattr("tenetdq.operators.fd.CANDIDATES", step)
        assert mine(frame) == want


def test_pairs_of_an_identifier_are_counted_as_well(spark):
    """A column that the profile left out as an identifier: its pairs are counted on grids too, or exploded where it is too large."""
    from tenetdq.functions.counting import pair_stats
    from tenetdq.operators.fd import pair_table
    rng = np.random.default_rng(3)
    frame = frame_of(spark, {**{f"c{i}": rng.integers(0, 20 + i, 3000) for i in range(6)}, "key": rng.integers(0, 1000, 3000)})
    keys = ["l", "r", "covered", "combos", "rows"]
    want = rows_of(pair_stats(frame.weighted(frame.columns), frame.columns), *keys)
    assert "key" not in frame.profile.modeling() and frame._folded is None and len(want) == 42
    assert len(frame.known_values(frame.columns)["key"]) == len({r["key"] for r in frame.df.collect()})
    assert rows_of(pair_table(frame, frame.columns), *keys) == want
    assert frame.known_values(frame.columns, limit=4000) is None


def test_three_attribute_rule(spark):
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 3, 2000) for _ in range(3))
    target = a * 9 + b * 3 + c * 100 + a * b * c
    frame = frame_of(spark, {"a": a, "b": b, "c": c, "t": target})
    assert FD(("a", "b", "c"), "t") in [FD(tuple(sorted(r.lhs)), r.rhs) for r in mine(frame, max_lhs=3)]
    assert not [r for r in mine(frame, max_lhs=2) if r.rhs == "t"]


def test_singleton_groups_are_no_rule(spark):
    frame = frame_of(spark, {"a": [i % 20 for i in range(40)], "b": [i // 2 for i in range(40)],
                             "t": [(i * 7) % 11 for i in range(40)]})
    assert not [r for r in mine(frame, max_lhs=2) if r.rhs == "t" and len(r.lhs) > 1]


def test_empty_and_constant_tables(spark):
    empty = frame_of(spark, {"a": ["x"], "b": ["y"]})
    assert mine(empty) == []
    none = empty.with_df(empty.df.where("false"))
    none._profile = None
    assert mine(none) == [] and none.profile.rows == 0


def test_order_learner(spark):
    frame = monotone(spark)
    learner = OrderLearner(tau_threshold=0.7).fit(frame)
    assert learner.governed == {"y"}
    assert any(p.op in "<>" for p in learner.rules()[0].predicates)
    assert worst(learner.score(frame), "y") == 5


def tau_by_pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    free = (x[i] != x[j]).sum() * (y[i] != y[j]).sum()
    return s.sum() / np.sqrt(free) if free else float("nan")


@pytest.mark.parametrize("cells,chunk", [(1_000_000, 1_000_000), (0, 1_000_000), (0, 13), (120, 7)])
def test_kendall_matches_pair_counting(spark, monkeypatch, cells, chunk):
    """In one step, by range partitions, with many parts a partition, and with a coarse histogram that is cut again."""
    monkeypatch.setattr(inv, "SMALL_CELLS", cells)
    rng = np.random.default_rng(3)
    cases = {("a", None): (rng.integers(0, 6, 60), rng.integers(0, 5, 60)), ("a", "hot"): (rng.normal(size=300), rng.normal(size=300)),
             ("b", ""): (np.arange(40.0), np.arange(40.0) // 3), ("b", "one"): (np.ones(3), np.arange(3)),
             ("c", "down"): (np.arange(90.0), -np.arange(90.0) ** 3), ("c", "row"): (np.ones(1), np.ones(1))}
    rows = [(p, g, float(a), float(b)) for (p, g), (x, y) in cases.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "p string, g string, x double, y double").repartition(3)
    hist = df.groupBy("p", "g", "x", "y").count().withColumnRenamed("count", "n")
    got = {(r["p"], r["g"]): r for r in inv.kendall(hist, ["p", "g"], chunk).collect()}
    assert set(got) == set(cases)
    for k, (x, y) in cases.items():
        assert got[k]["rows"] == len(x)
        assert got[k]["tau"] == pytest.approx(tau_by_pairs(x, y), nan_ok=True)
    assert inv.kendall(hist.where("false"), ["p", "g"]).count() == 0


def test_a_task_counts_few_cells_at_a_time():
    """Whatever the rows of a range, what a task holds at once is bounded, and nothing is left out."""
    import pyarrow as pa
    part = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000))], ["y"])
    sizes = [t.num_rows for t in inv.chunks(iter([part] * 90), inv.CHUNK)]
    assert sum(sizes) == 900_000 and max(sizes) <= 260_000 and inv.SMALL_CELLS <= 260_000


def test_inversions_of_weighted_rows():
    rng = np.random.default_rng(8)
    key = np.sort(rng.integers(0, 4, 200))
    key = np.unique(key, return_inverse=True)[1]
    y, n = rng.integers(0, 20, 200).astype(float), rng.integers(1, 5, 200).astype(float)
    want = [sum(n[i] * n[j] for i in np.flatnonzero(key == k) for j in np.flatnonzero(key == k) if i < j and y[i] > y[j])
            for k in range(key.max() + 1)]
    assert inv.inversions(key, y, n).tolist() == want


@pytest.mark.parametrize("shape,size", [("trend", 1000), ("noise", 20), ("down", 1000), ("steps", 30)])
def test_isotonic_fit_by_partitions(spark, monkeypatch, shape, size):
    rng = np.random.default_rng(11)
    m = 400
    y = {"trend": np.arange(m) + rng.normal(size=m) * 30, "noise": rng.normal(size=m), "down": -np.arange(m) + 0.0,
         "steps": np.tile(np.arange(m // 8), 8) + 0.0}[shape]
    n = rng.integers(1, 6, m)
    rows = [("hot", float(i), float(v), int(w)) for i, (v, w) in enumerate(zip(y, n))] + [("", 1.0, 5.0, 2)]
    monkeypatch.setattr(iso, "FAN", 2)
    points = spark.createDataFrame(rows, "g string, x double, y double, n long").repartition(3)
    got = {(r["g"], r["x"]): r["fit"] for r in iso.fitted(points, size).collect()}
    want = isotonic_fit(y, n.astype(float))
    assert len(got) == m + 1 and got["", 1.0] == 5.0
    assert [got["hot", float(i)] for i in range(m)] == pytest.approx(want.tolist())


def test_residuals_agree_on_both_paths(spark, monkeypatch):
    from tenetdq.operators import order as od
    frame = monotone(spark)
    for context, up in (("ctx", True), (None, False)):
        spec = od.OrderSpec("x", "y", context, up, 0.9)
        found = []
        for bound in (1_000_000, 0):
            monkeypatch.setattr(od, "SMALL_POINTS", bound)
            found.append(sorted(tuple(r) for r in od.order_cells(frame.weighted(["ctx", "x", "y"]), spec).select(
                "ctx", "xt", "yt", "n", F.round("fit", 9), F.round("resid", 9), F.round("score", 6)).collect()))
        assert found[0] == found[1]


def test_isotonic_matches_min_max_formula():
    rng = np.random.default_rng(4)
    y, w = rng.normal(size=25), rng.integers(1, 5, 25).astype(float)
    mean = lambda j, k: np.average(y[j:k + 1], weights=w[j:k + 1])
    want = [max(min(mean(j, k) for k in range(i, 25)) for j in range(i + 1)) for i in range(25)]
    assert isotonic_fit(y, w) == pytest.approx(want)


def test_linear_learner(spark):
    frame = sums(spark)
    learner = LinearLearner().fit(frame)
    assert learner.governed == {"x", "y", "z"}
    coefs = dict(learner.rules()[0].coefficients)
    dep = next(iter(coefs))
    scaled = {c: v / coefs["z"] for c, v in coefs.items()}
    assert scaled["x"] == pytest.approx(-1, abs=0.05) and scaled["y"] == pytest.approx(-1, abs=0.05), dep
    assert worst(learner.score(frame), "z") == 4


def test_linear_learner_needs_two_numbers(spark):
    learner = LinearLearner().fit(countries(spark))
    assert learner.rules() == [] and learner.governed == set()


def test_routed_scores(spark):
    frame = countries(spark)
    learner = RoutedLearner().fit(frame)
    got = learner.score(frame).toPandas().drop(columns="row_id")
    assert np.isfinite(got.to_numpy()).all() and got.to_numpy().min() >= 0 and got.to_numpy().max() <= 1
    assert worst(learner.score(frame), "continent") == 7


def test_routing_order(spark):
    """All values differ, so each column also determines the others: dependencies come first."""
    frame = sums(spark, jump=3.0)
    learner = RoutedLearner().fit(frame)
    assert {"x", "y", "z"} <= learner.governed
    assert all(isinstance(o, FdLearner) for o in learner.owner.values())
    only = RoutedLearner([LinearLearner()]).fit(frame)
    assert worst(only.score(frame), "z") == 4


def test_ensemble(spark):
    frame = countries(spark)
    both = EnsembleLearner([FdLearner(max_lhs=1), FdLearner(max_lhs=2)]).fit(frame)
    assert worst(both.score(frame), "continent") == 7
    assert len([r for r in both.rules() if r.rhs == "continent"]) == 1
    with pytest.raises(ValueError):
        EnsembleLearner([])


class Foreign:
    """A user's own learner: no cells, only scores."""
    governed = {"noise"}

    def fit(self, frame):
        return self

    def rules(self):
        return []

    def score(self, frame):
        from pyspark.sql import functions as F
        return frame.df.select("row_id", *[
            (F.col("row_id") % 10 if c == "noise" else F.lit(0)).cast("double").alias(c) for c in frame.columns])


def test_foreign_learner_is_ranked(spark):
    frame = countries(spark)
    got = RoutedLearner([Foreign(), FdLearner()]).fit(frame).score(frame)
    assert rows_of(got.where("row_id < 2"), "row_id", "noise") == [(0, 0.0525), (1, 0.1525)]


def test_gated_learner(spark):
    frame = countries(spark, noise=False)
    learner = GatedLearner().fit(frame)
    assert "country -> continent" in map(str, learner.rules())
    assert worst(learner.score(frame), "continent") == 7


def test_analyze_reports_model(spark):
    model = analyze(countries(spark, n=400, bad=(11,)))
    assert "country -> continent" in [r["rule"] for r in model.constraints.collect()]
    top = model.top_violations(3).collect()
    assert any(r["row_id"] == 11 and r["reason"] == "violates a constraint" for r in top)
    assert model.relations.count() >= 1 and model.keys.first()["normal_form"] in ("BCNF", "3NF", "lower than 3NF")


def test_identifier_columns_are_looked_up_together(spark, monkeypatch):
    """With nothing small enough for a broadcast, the cells of all columns share two shuffles and give the same scores."""
    from tenetdq.functions import lookup
    from tenetdq.operators.marginal import MarginalSurprise
    rng = np.random.default_rng(5)
    frame = frame_of(spark, {"a": [f"id{i}" for i in range(90)], "b": rng.integers(0, 60, 90), "c": rng.choice(["x", "yy", ""], 90)})
    want = rows_of(MarginalSurprise().score(frame), "row_id", "a", "b", "c")
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    assert rows_of(MarginalSurprise().score(frame), "row_id", "a", "b", "c") == want


def test_dominance_of_many_rows_forms_no_pairs(spark):
    """Three comparisons without an equality over 3 000 rows, against a sweep by hand."""
    from tenetdq.operators.monitors import dc_monitor
    from tenetdq.plans.constraints import DenialConstraint, Predicate
    rng = np.random.default_rng(6)
    x, y, z = rng.integers(0, 900, 3000), rng.integers(0, 900, 3000), rng.integers(0, 900, 3000)
    frame = frame_of(spark, {"x": x, "y": y, "z": z}, id_cardinality=10_000)
    dc = DenialConstraint((Predicate("x", "<", "x"), Predicate("y", "<=", "y"), Predicate("z", "<", "z")))
    want = [i for i in range(3000) if ((x > x[i]) & (y >= y[i]) & (z > z[i])).any()]
    assert [r[0] for r in rows_of(dc_monitor(frame, dc), "row_id")] == want
