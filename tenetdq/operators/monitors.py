"""Violation monitors: which rows or groups break a given constraint."""
from __future__ import annotations

from itertools import combinations
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tenetdq.functions.dominance import KEY, front_of, judged, keyed, needed, open_reach, reach, within_reach
from tenetdq.functions.lookup import attach, fits_broadcast, settle_sized
from tenetdq.functions.running import running
from tenetdq.functions.values import as_number, number_in
from tenetdq.operators.fd import count_cells
from tenetdq.operators.scoring import residual
from tenetdq.plans.constraints import DenialConstraint, FunctionalDependency, LinearConstraint, Predicate
from tenetdq.plans.frame import ROW_ID, Frame
from tenetdq.session import settle, settle_measured

NUMERIC_OPS = ("<", "<=", ">", ">=")


# -- dependencies and keys ---------------------------------------------------
def fd_monitor(df: DataFrame, fd: FunctionalDependency) -> DataFrame:
    """Left-hand groups with more than one right-hand value, and how many they have.

    Distinct pairs are formed first, so a huge group is reduced before it is gathered.
    """
    pairs = df.select(*[f"`{a}`" for a in fd.lhs], f"`{fd.rhs}`").distinct()
    return (pairs.groupBy(*[f"`{a}`" for a in fd.lhs]).agg(F.count("*").alias("n_distinct"))
            .where("n_distinct > 1"))


def fd_holds(df: DataFrame, fd: FunctionalDependency) -> DataFrame:
    """One row: whether every group has a single value, and the groups that do not."""
    return fd_monitor(df, fd).agg(
        F.lit(str(fd)).alias("rule"), (F.count("*") == 0).alias("ok"), F.count("*").alias("bad_groups"))


def fd_deviations(frame: Frame, fd: FunctionalDependency) -> DataFrame:
    """Rows that differ from the majority of their group (smallest value on ties)."""
    cells = count_cells(frame, [fd])
    bad = cells.table(0, F.col("mode").alias("expected"), F.col("n").alias("__n"),
                      condition=F.col("rhs") != F.col("mode"))
    return attach(frame.df, bad, [*fd.lhs, fd.rhs], weight="__n", how="inner",
                  small=cells.small.get(0, True)).select(ROW_ID, *frame.columns, "expected")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return (df.groupBy(*[f"`{k}`" for k in key]).agg(F.count("*").alias("n_rows"))
            .where("n_rows > 1"))


# -- single-row constraints --------------------------------------------------
def linear_monitor(frame: Frame, rule: LinearConstraint, slack: float | None = None) -> DataFrame:
    """Rows whose residual exceeds the tolerance (or ``slack`` where that is larger)."""
    bound = rule.tolerance if slack is None else max(rule.tolerance, slack)
    rows = frame.numeric_rows(rule.attributes)
    return (rows.withColumn("residual", residual(rule, rows))
            .where(F.abs("residual") > bound).select(ROW_ID, *frame.columns, "residual"))


def exact_sum_monitor(frame: Frame, columns: Sequence[str], total: float) -> DataFrame:
    """Rows whose ``columns`` do not add up to exactly ``total``."""
    rule = LinearConstraint(tuple((c, 1.0) for c in columns), offset=total)
    rows = frame.numeric_rows(columns)
    return (rows.withColumn("residual", residual(rule, rows)).where("residual != 0")
            .select(ROW_ID, *frame.columns, "residual"))


def type_check(frame: Frame, expected: dict[str, str]) -> DataFrame:
    """(column, present, bad): column presence, and non-empty values that are not numbers in
    columns declared ``number``. One scan for all columns."""
    have = [c for c in expected if c in frame.columns]
    aggs = [F.sum(((F.col(f"`{c}`") != "") & as_number(F.col(f"`{c}`")).isNull()).cast("long")
                  if expected[c] == "number" else F.lit(0).cast("long")).alias(c) for c in have]
    one = frame.df.agg(F.count("*").alias("__rows"), *aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"),
                 (F.coalesce(F.col(f"`{c}`"), F.lit(0)) if c in have
                  else F.lit(-1)).cast("long").alias("bad")) for c in expected])).alias("x")).select("x.*")


# -- two-row denial constraints ----------------------------------------------
def _side(rows: DataFrame, p: Predicate, name: str) -> Column:
    return number_in(rows, name) if p.op in NUMERIC_OPS else F.col(f"`{name}`")


def _compared(dcs: Sequence[DenialConstraint]) -> set[str]:
    """Columns the constraints compare as numbers."""
    return {c for dc in dcs for p in dc.predicates if p.op in NUMERIC_OPS for c in (p.left, p.right)}


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _parts(dc: DenialConstraint):
    eq = [p for p in dc.predicates if p.op == "="]
    return eq, [p for p in dc.predicates if p.op != "="]


def _keys(preds: Sequence[Predicate]) -> list[str]:
    return [f"k{i}" for i in range(len(preds))]


def _against_extremes(low: str, high: str, value: Column, op: str) -> Column:
    """Whether some member of a set satisfies ``value op member``, from its extremes alone."""
    lo, hi = F.col(low), F.col(high)
    return {"<": value < hi, "<=": value <= hi, ">": value > lo, ">=": value >= lo,
            "!=": (lo != value) | (hi != value)}[op]


def dc_members(against: DataFrame, dc: DenialConstraint) -> DataFrame:
    """The ``t2`` projections of ``against``: ``k*`` for equality predicates, ``c*`` for the others."""
    eq, rest = _parts(dc)
    return against.select(*[_side(against, p, p.right).alias(f"k{i}") for i, p in enumerate(eq)],
                          *[_side(against, p, p.right).alias(f"c{i}") for i, p in enumerate(rest)]).dropna()


def staircase(members: DataFrame, dc: DenialConstraint) -> DataFrame:
    """The members that decide: any row that has a partner among ``members`` has one among these.

    With one comparison they are the extremes of each key, with two those that set a new extreme of the one column in the
    order of the other, otherwise all distinct ones. Members of several batches can be put together and reduced again."""
    eq, rest = _parts(dc)
    keys, distinct = _keys(eq), members.distinct()
    if len(rest) == 1:
        ends = members.withColumn("k", F.lit(0)).groupBy("k", *keys).agg(F.min("c0").alias("lo"), F.max("c0").alias("hi"))
        return ends.select(*keys, F.explode(F.array("lo", "hi")).alias("c0")).distinct()
    if len(rest) != 2 or not any(p.op in NUMERIC_OPS for p in rest):
        return distinct
    at = next(i for i, p in enumerate(rest) if p.op in NUMERIC_OPS)
    x, y = f"c{at}", f"c{1 - at}"
    sign = F.lit(1.0) if rest[at].op in (">", ">=") else F.lit(-1.0)
    steps = (distinct.withColumn("at", sign * F.col(x)).withColumn("k", F.lit(0)).groupBy("k", *keys, "at", x)
             .agg(F.min(y).alias("lo"), F.max(y).alias("hi")))
    seen = running(steps, ["k", *keys], ["at"], {"low": ("min", "lo"), "high": ("max", "hi")})
    new = F.filter(F.array(F.when(F.col("low").isNull() | (F.col("lo") < F.col("low")), F.col("lo")),
                           F.when(F.col("high").isNull() | (F.col("hi") > F.col("high")), F.col("hi"))), lambda v: v.isNotNull())
    return seen.withColumn(y, F.explode(new)).select(*members.columns).distinct()


def dc_culprits(probe: DataFrame, against: DataFrame, dc: DenialConstraint) -> DataFrame:
    """Distinct ``t1`` projections of ``probe`` for which ``against`` has a matching ``t2``.

    Columns: ``k*`` for equality predicates, ``c*`` for the others (numbers for order
    comparisons). Any number of differences, or up to two comparisons, are decided in linear work from running
    extremes instead of comparing pairs, and more comparisons are brought down to two: for ``a.X > b.X and a.Y < b.Y`` row ``a`` is a culprit
    when the largest Y among the smaller X of its group exceeds its own Y.
    """
    return culprits_among(probe, dc_members(against, dc), dc)


def culprits_among(probe: DataFrame, right: DataFrame, dc: DenialConstraint) -> DataFrame:
    """:func:`dc_culprits` against the ``t2`` projections themselves."""
    eq, rest = _parts(dc)
    if not rest and not eq:
        raise ValueError("a denial constraint needs at least one predicate")
    keys, cs = _keys(eq), [f"c{i}" for i in range(len(rest))]
    left = probe.select(*[_side(probe, p, p.left).alias(k) for k, p in zip(keys, eq)],
                        *[_side(probe, p, p.left).alias(c) for c, p in zip(cs, rest)]).dropna()
    ordered = any(p.op in NUMERIC_OPS for p in rest)
    if len(rest) < 3 or not ordered:
        left = left.distinct()
    if not rest:
        return left.join(right.distinct(), keys, "left_semi")
    if not keys:
        left, right, keys = left.withColumn("k", F.lit(0)), right.withColumn("k", F.lit(0)), ["k"]
    if len(rest) == 1:
        found = _one_comparison(left, right, keys, rest[0])
    elif len(rest) == 2 and ordered:
        found = _two_comparisons(left, right, keys, rest)
    elif not ordered:
        found = _only_differences(left, right, keys, cs)
    else:
        found = _many_comparisons(left, right, keys, rest)
    return found.drop("k") if keys == ["k"] else found


def _one_comparison(left, right, keys, p) -> DataFrame:
    ends = right.groupBy(*keys).agg(F.min("c0").alias("lo"), F.max("c0").alias("hi"))
    return (left.join(ends, keys).where(_against_extremes("lo", "hi", F.col("c0"), p.op))
            .select(*left.columns))


def _two_comparisons(left, right, keys, rest) -> DataFrame:
    """Sweep along the first ordered comparison, keeping extremes of the other."""
    at = next(i for i, p in enumerate(rest) if p.op in NUMERIC_OPS)
    x, y = f"c{at}", f"c{1 - at}"
    px, py = rest[at], rest[1 - at]
    sign = F.lit(1.0) if px.op in (">", ">=") else F.lit(-1.0)     # sweep from the matching side
    members = (right.withColumn("at", sign * F.col(x)).groupBy(*keys, "at")
               .agg(F.min(y).alias("lo"), F.max(y).alias("hi")))
    probes = left.select(*keys, (sign * F.col(x)).alias("at")).distinct()
    nothing = F.lit(None).cast(dict(right.dtypes)[y])
    strict = px.op in (">", "<")
    points = (members.withColumn("probe", F.lit(0)).unionByName(
        probes.select(*keys, "at", nothing.alias("lo"), nothing.alias("hi"), F.lit(1).alias("probe"))))
    # equal positions count only for <= and >=: there the members come first
    points = points.withColumn("turn", F.col("probe") if not strict else 1 - F.col("probe"))
    seen = running(points, keys, ["at", "turn"], {"low": ("min", "lo"), "high": ("max", "hi")})
    best = seen.where("probe = 1 and low is not null").select(*keys, "at", "low", "high")
    hit = left.withColumn("at", sign * F.col(x)).join(best, [*keys, "at"])
    return hit.where(_against_extremes("low", "high", F.col(y), py.op)).select(*left.columns)


def _only_differences(left, right, keys, cs) -> DataFrame:
    """Rows with a partner that differs in all of ``cs``, by inclusion and exclusion: partners
    in the group, minus those equal in one column, plus those equal in two, and so on. Each
    term is one count per value combination; no pair is compared."""
    counts = right.groupBy(*keys, *cs).agg(F.count("*").alias("__n"))
    out = left.withColumn("__partners", F.lit(0).cast("long"))
    for size in range(len(cs) + 1):
        for equal in combinations(cs, size):
            term = counts.groupBy(*keys, *equal).agg(F.sum("__n").alias("__t"))
            out = out.join(term, [*keys, *equal], "left").withColumn(
                "__partners", F.col("__partners") + (-1) ** size * F.coalesce("__t", F.lit(0))).drop("__t")
    return out.where("__partners > 0").select(*left.columns)


def _ranks(left: DataFrame, right: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(column, __r): places of the distinct values of both sides in their order, and how many there are."""
    values = left.select(column).unionByName(right.select(column)).distinct().select(
        column, F.lit(0).alias("__all"), F.lit(1).cast("long").alias("__one"))
    placed, seen = settle_measured(running(values, ["__all"], [column], {"__r": ("sum", "__one")}).select(column, "__r"),
                                   rows=F.count(F.lit(1)))
    return placed, max(1, seen["rows"])


def _halved(rows: DataFrame, place: str, levels: int, half: int, op: str, out: str) -> DataFrame:
    """A row for each node of a binary tree over places in whose ``half`` (0 left, 1 right) the row stands, named by ``out``.

    Two places a < b meet in exactly one node with a on its left and b on its right. For ``!=`` either half will do: the row is there
    once per level, under the side that its partners are on (``half`` 1) or that it is on itself (``half`` 0)."""
    bit = f"(shiftright({place}, l) & 1)"
    node = f"(shiftright({place}, l + 1) * 64 + l)"
    if op == "!=":
        code = f"transform(sequence(0, {levels - 1}), l -> {node} * 2 + {bit if half == 0 else f'1 - {bit}'})"
    else:
        code = f"transform(filter(sequence(0, {levels - 1}), l -> {bit} = {half}), l -> {node})"
    return rows.withColumn(out, F.explode(F.expr(code))).drop(place)


def _many_comparisons(left, right, keys, rest) -> DataFrame:
    """Three or more comparisons: a front of strong members decides most probes and makes most members superfluous (see
    ``functions.dominance``); what is left goes by nodes. Rows in which strong values of one column mean weak ones of another
    leave much to the nodes, in random ones next to nothing is left."""
    left, right = keyed(left, keys), keyed(right, keys)
    bounds, tops = reach(right, rest), reach(left, rest, probes=True)
    if None in bounds + tops:                                # no member or no probe
        return left.drop(KEY).where(F.lit(False))
    front = front_of(within_reach(right, rest, tops), rest)
    if not front.num_rows:                                   # no member within reach of a probe
        return left.drop(KEY).where(F.lit(False))
    placed, seen = settle_measured(judged(left, rest, front, bounds), **open_reach(rest))
    tops = [seen[name] for name in open_reach(rest)]
    hits = placed.where("hit").drop("hit", KEY).distinct()
    if None in tops:                                         # no probe is open
        return hits
    others = placed.where("not hit").drop("hit", KEY).distinct()
    return hits.unionByName(_by_nodes(others, settle(needed(right, rest, front, tops)), keys, rest))


def _by_nodes(left, right, keys, rest) -> DataFrame:
    """Three or more comparisons, by divide and conquer: each comparison beyond two becomes an equality.

    The values of its column are put in order as the leaves of a binary tree. A member that is smaller than a probe
    stands in the left half of exactly one node in whose right half the probe stands, so with a row for each
    such node the comparison says that both name the same node. What remains is a sweep with two comparisons inside
    equal keys and nodes, from running extremes: n log n rows a comparison, in one sort, and no pair is formed."""
    sweep = next(i for i, p in enumerate(rest) if p.op in NUMERIC_OPS)
    others = [i for i in range(len(rest)) if i != sweep]
    last = next((i for i in others if rest[i].op == "!="), others[-1])      # extremes decide a difference as well
    probes, members, nodes = left, right.distinct(), []
    for i in others:
        if i == last:
            continue
        op, c, out = rest[i].op, f"c{i}", f"d{i}"
        ranks, size = _ranks(left, right, c)
        small = fits_broadcast(ranks)
        # places on one scale: the member's is below the probe's exactly when the comparison holds
        up = F.col("__r") if op in (">", ">=", "!=") else F.lit(size - 1) - F.col("__r")
        strict = op in (">", "<")
        place = {"!=": (up, up)}.get(op, (up * 2 + int(strict), up * 2 + int(not strict)))
        levels = (2 * size + 1).bit_length()
        probes, members = (
            _halved(attach(rows, ranks, [c], how="inner", small=small).withColumn("__p", place[half]).drop("__r"),
                    "__p", levels, half, op, out)
            for rows, half in ((probes, 1), (members, 0)))
        nodes.append(out)
    pair = [rest[sweep], rest[last]]
    members = members.select(*keys, *nodes, F.col(f"c{sweep}").alias("m0"), F.col(f"c{last}").alias("m1")).toDF(
        *keys, *nodes, "c0", "c1")
    named = probes.withColumns({f"own{i}": F.col(f"c{i}") for i in range(len(rest))}).drop(*[f"c{i}" for i in range(len(rest))])
    named = named.withColumns({"c0": F.col(f"own{sweep}"), "c1": F.col(f"own{last}")})
    found = _two_comparisons(named, members, [*keys, *nodes], pair)
    return found.select(*keys, *[F.col(f"own{i}").alias(f"c{i}") for i in range(len(rest))]).distinct()


def dc_monitor(frame: Frame, dc: DenialConstraint, against: Frame | None = None) -> DataFrame:
    """Rows that take part as ``t1`` in a violation, each once."""
    eq, rest = _parts(dc)
    rows, other = frame.numeric_rows(_compared([dc])), (against or frame).numeric_rows(_compared([dc]))
    culprits, small, _ = settle_sized(dc_culprits(rows, other, dc))
    keys, cs = _keys(eq), [f"c{i}" for i in range(len(rest))]
    rows = rows.withColumns({
        **{k: _side(rows, p, p.left) for k, p in zip(keys, eq)},
        **{c: _side(rows, p, p.left) for c, p in zip(cs, rest)}})
    return attach(rows, culprits, keys + cs, how="left_semi", small=small).select(ROW_ID, *frame.columns)


def order_constraint(x: str, y: str, context: str | None = None, increasing: bool = True,
                     confidence: float = 1.0) -> DenialConstraint:
    """Y must not fall (``increasing``) or rise while X grows, within equal ``context``."""
    same = (Predicate(context, "=", context),) if context else ()
    return DenialConstraint(
        same + (Predicate(x, ">", x), Predicate(y, "<" if increasing else ">", y)), confidence)


# -- gate --------------------------------------------------------------------
def gate_rules(rules: Sequence, symmetric: bool = False) -> dict[str, DenialConstraint]:
    """The denial constraints that a gate tests, by name: ``g<i>`` for rule i, ``m<i>`` for it with the rows exchanged."""
    return {name: dc for i, r in enumerate(rules) if isinstance(r, DenialConstraint)
            for name, dc in ((f"g{i}", r), *([(f"m{i}", mirrored(r))] if symmetric else []))}


def gate_members(rows: Frame, rules: Sequence, symmetric: bool = False) -> dict[str, DataFrame]:
    """For each constraint of a gate the stored rows that decide (see :func:`staircase`)."""
    tested = gate_rules(rules, symmetric)
    stored = rows.numeric_rows(_compared(list(tested.values())))
    return {name: staircase(dc_members(stored, dc), dc) for name, dc in tested.items()}


def gate(batch: Frame, reference: Frame, rules: Sequence, linear_slack: float = 1e-6,
         symmetric: bool = False) -> DataFrame:
    """``batch`` with ``accepted`` and the first ``reason`` of rejection.

    Linear rules test the row itself; order constraints test it, as ``t1``, against the stored
    ``reference`` rows (``symmetric`` also as ``t2``).
    """
    tested = gate_rules(rules, symmetric)
    stored = reference.numeric_rows(_compared(list(tested.values())))
    return judge_batch(batch, {name: dc_members(stored, dc) for name, dc in tested.items()}, rules, linear_slack, symmetric)


def judge_batch(batch: Frame, members: dict[str, DataFrame], rules: Sequence, linear_slack: float = 1e-6,
                symmetric: bool = False) -> DataFrame:
    """:func:`gate` against given members of each constraint."""
    tested = gate_rules(rules, symmetric)
    rows = batch.numeric_rows(_compared(list(tested.values())) | {
        c for r in rules if isinstance(r, LinearConstraint) for c in r.attributes})
    for name, dc in tested.items():
        rows = _flag(rows, members[name], dc, f"__{name}")
    reasons = []
    for i, r in enumerate(rules):
        if isinstance(r, LinearConstraint):
            reasons.append(F.when(F.abs(residual(r, rows)) > max(r.tolerance, linear_slack), str(r)))
        elif isinstance(r, DenialConstraint):
            hit = F.col(f"__g{i}") | F.col(f"__m{i}") if symmetric else F.col(f"__g{i}")
            reasons.append(F.when(hit, str(r)))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return rows.select(ROW_ID, *batch.columns, reason.isNull().alias("accepted"),
                       F.coalesce(reason, F.lit("")).alias("reason"))


_MIRROR = {"=": "=", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def mirrored(dc: DenialConstraint) -> DenialConstraint:
    """The same constraint with the two rows exchanged."""
    return DenialConstraint(tuple(Predicate(p.right, _MIRROR[p.op], p.left) for p in dc.predicates),
                            dc.confidence)


def _flag(rows: DataFrame, members: DataFrame, dc: DenialConstraint, name: str) -> DataFrame:
    eq, rest = _parts(dc)
    keys, cs = _keys(eq), [f"c{i}" for i in range(len(rest))]
    culprits, small, _ = settle_sized(culprits_among(rows, members, dc).withColumn(name, F.lit(True)))
    probe = rows.withColumns({
        **{k: _side(rows, p, p.left) for k, p in zip(keys, eq)},
        **{c: _side(rows, p, p.left) for c, p in zip(cs, rest)}})
    return (attach(probe, culprits, keys + cs, small=small).drop(*keys, *cs)
            .withColumn(name, F.coalesce(name, F.lit(False))))
