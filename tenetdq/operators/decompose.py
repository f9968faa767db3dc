"""Schema normalization on data: keys, relations, reconstruction and redundancy."""
from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenetdq.operators.scoring import CELL_ABOVE
from tenetdq.plans import algebra
from tenetdq.plans.algebra import RelationSpec
from tenetdq.plans.constraints import Constraint, FunctionalDependency
from tenetdq.plans.frame import ROW_ID, Frame, from_df


class Schema:
    """Attributes, keys, normal form and relations implied by a set of rules."""

    def __init__(self, rules: Sequence[Constraint], fallback: Sequence[str] = ()):
        fds = [r for r in rules if isinstance(r, FunctionalDependency)]
        deps = [(frozenset(fd.lhs), fd.rhs) for fd in fds]
        self.attributes = sorted({a for fd in fds for a in fd.attributes}) or list(fallback)
        self.cover = algebra.cover(deps)
        self.keys = (algebra.keys(self.attributes, self.cover) if deps
                     else [frozenset(self.attributes)])
        self.normal_form = (algebra.normal_form(self.attributes, self.cover, self.keys) if deps
                            else "n/a (no constraints found)")
        self.relations_3nf = algebra.third_normal_form(self.attributes, deps) if deps else []
        self.relations_bcnf = algebra.boyce_codd(self.attributes, deps) if deps else []


def explicit_relations(given: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> list[RelationSpec]:
    """User-supplied relations ``(name, attributes, key)``."""
    return [RelationSpec(n, frozenset(a), frozenset(k)) for n, a, k in given]


def project(df: DataFrame, attrs) -> DataFrame:
    return df.select(*[f"`{a}`" for a in sorted(attrs)]).distinct()


def materialize(df: DataFrame, relations: Sequence[RelationSpec]) -> dict[str, DataFrame]:
    """Distinct projection per relation."""
    return {r.name: project(df, r.attributes) for r in relations}


def first_per_key(df: DataFrame, relation: RelationSpec) -> DataFrame:
    """One row per key value: the one with the smallest row id. ``df`` carries row ids."""
    key, attrs = sorted(relation.key), sorted(relation.attributes)
    rest = [a for a in attrs if a not in key]
    if not rest:
        return project(df, attrs)
    best = df.groupBy(*[f"`{k}`" for k in key]).agg(
        F.min_by(F.struct(*[f"`{a}`" for a in rest]), ROW_ID).alias("__r"))
    return best.select(*key, *[F.col(f"__r.`{a}`").alias(a) for a in rest]).select(*attrs)


def reconstruct(relations: dict[str, DataFrame]) -> DataFrame:
    """Natural join of the relations, joining connected ones first."""
    left = dict(relations)
    name = next(iter(left))
    out = left.pop(name)
    while left:
        name = next((n for n, r in left.items() if set(r.columns) & set(out.columns)), None)
        if name is None:
            raise ValueError("relations share no attributes, so they cannot be joined")
        r = left.pop(name)
        out = out.join(r, [c for c in out.columns if c in r.columns])
    return out.select(*sorted(out.columns))


def _join_tree(relations: dict[str, DataFrame]) -> list[tuple[str, str | None]] | None:
    """Order in which relations can be folded into a neighbour that holds all they share with
    the rest: (relation, neighbour) pairs, or None if they overlap in a cycle."""
    left = {n: set(r.columns) for n, r in relations.items()}
    order: list[tuple[str, str | None]] = []
    while len(left) > 1:
        for n, attrs in left.items():
            shared = attrs & set().union(*[a for m, a in left.items() if m != n])
            host = next((m for m, a in left.items() if m != n and shared and shared <= a), None)
            if host:
                order.append((n, host))
                break
        else:
            return None
        del left[n]
    return [*order, (next(iter(left)), None)]


def joined_rows(relations: dict[str, DataFrame]) -> DataFrame:
    """One row ``rebuilt``: the size of the natural join of distinct relations, without joining.

    Each relation is reduced to a count per shared value, which multiplies the counts of its
    neighbour, so nothing grows even where the join would. Relations that overlap in a cycle
    are joined.
    """
    tree = _join_tree(relations)
    if tree is None:
        return reconstruct(relations).agg(F.count("*").alias("rebuilt"))
    held = {n: r.distinct().withColumn("__w", F.lit(1).cast("decimal(38,0)")) for n, r in relations.items()}
    for name, host in tree[:-1]:
        on = [c for c in relations[name].columns if c in relations[host].columns]
        folded = held[name].groupBy(*[f"`{c}`" for c in on]).agg(F.sum("__w").cast("decimal(38,0)").alias("__k"))
        held[host] = (held[host].join(folded, on)
                      .withColumn("__w", (F.col("__w") * F.col("__k")).cast("decimal(38,0)")).drop("__k"))
    return held[tree[-1][0]].agg(F.coalesce(F.sum("__w"), F.lit(0)).cast("long").alias("rebuilt"))


def lossless(df: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """One row: original and rebuilt distinct rows, and how many differ either way.

    A row is in the join exactly if each relation holds its projection, so lost rows come from
    semi joins and spurious ones from the size of the join.
    """
    if not _connected(relations):
        raise ValueError("relations share no attributes, so they cannot be joined")
    attrs = sorted({a for r in relations.values() for a in r.columns})
    rows = project(df, attrs).withColumn("__in", F.lit(1))
    for k, r in enumerate(relations.values()):
        rows = rows.join(r.distinct().withColumn(f"__h{k}", F.lit(1)), list(r.columns), "left")
        rows = rows.withColumn("__in", F.col("__in") * F.coalesce(f"__h{k}", F.lit(0))).drop(f"__h{k}")
    original = rows.agg(F.count("*").alias("original"), F.coalesce(F.sum("__in"), F.lit(0)).alias("kept"))
    one = F.lit(1).alias("one")
    both = original.select("*", one).join(joined_rows(relations).select("*", one), "one")
    return both.select("original", "rebuilt", (F.col("original") - F.col("kept")).alias("lost"),
                       (F.col("rebuilt") - F.col("kept")).alias("spurious"))


def cross_relation_rows(relations: dict[str, DataFrame], attributes) -> Frame:
    """The rebuilt rows restricted to what a rule needs, so that rules spanning several
    relations can be checked on stored relations. Only relations that carry a needed attribute,
    or connect those that do, are joined. Rows get ids of their own."""
    need, kept = set(attributes), dict(relations)
    for name in list(kept):
        rest = {n: r for n, r in kept.items() if n != name}
        if rest and need <= {c for r in rest.values() for c in r.columns} and _connected(rest):
            kept = rest
    rows = reconstruct(kept).select(*[f"`{a}`" for a in sorted(need)]).distinct()
    return from_df(rows, columns=sorted(need))


def _connected(relations: dict[str, DataFrame]) -> bool:
    todo = [set(r.columns) for r in relations.values()]
    seen = todo.pop()
    while True:
        hit = [c for c in todo if c & seen]
        if not hit:
            return not todo
        for c in hit:
            seen |= c
            todo.remove(c)


def links(relations: Sequence[RelationSpec]) -> list[tuple[str, str, tuple[str, ...]]]:
    """Pairs of relations with common attributes."""
    return [(a.name, b.name, tuple(sorted(a.attributes & b.attributes)))
            for a, b in combinations(relations, 2) if a.attributes & b.attributes]


def check_links(tables: dict[str, DataFrame], found) -> DataFrame:
    """(left, right, shared, orphans_left, orphans_right): values without a partner."""
    rows = []
    for a, b, on in found:
        sides = (tables[a].select(*on).distinct().withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0))
                 .unionByName(tables[b].select(*on).distinct()
                              .withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1))))
        both = sides.groupBy(*on).agg(F.max("__a").alias("a"), F.max("__b").alias("b"))
        rows.append(both.agg(
            F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(", ".join(on)).alias("shared"),
            F.sum((F.col("a") > F.col("b")).cast("long")).alias("orphans_left"),
            F.sum((F.col("a") < F.col("b")).cast("long")).alias("orphans_right")))
    return reduce(DataFrame.unionByName, rows)


def relations_frame(spark: SparkSession, tables: dict[str, DataFrame],
                    relations: Sequence[RelationSpec]) -> DataFrame:
    """(name, attributes, key, rows) of materialized relations."""
    parts = [tables[r.name].agg(
        F.lit(r.name).alias("name"), F.lit(", ".join(sorted(r.attributes))).alias("attributes"),
        F.lit(", ".join(sorted(r.key))).alias("key"), F.count("*").alias("rows")) for r in relations]
    return reduce(DataFrame.unionByName, parts)


def quality_metrics(frame: Frame, schema: Schema, scores: DataFrame | None = None,
                    threshold: float = CELL_ABOVE) -> DataFrame:
    """One row: conformance, redundancy and the sizes they are made of."""
    d = len(frame.columns)
    if scores is None:
        flagged = F.lit(0).cast("long")
        base = frame.df.agg(F.count("*").alias("rows"), flagged.alias("flagged_cells"))
    else:
        hits = reduce(lambda a, b: a + b,
                      [(F.col(f"`{c}`") > threshold).cast("long") for c in frame.columns])
        base = scores.agg(F.count("*").alias("rows"), F.sum(hits).alias("flagged_cells"))
    one = base.first()
    n, flagged_cells = one["rows"], one["flagged_cells"] or 0
    rels = schema.relations_bcnf
    flat = n * len({a for r in rels for a in r.attributes})
    norm = 0
    if rels:
        sizes = relations_frame(frame.spark, materialize(frame.df, rels), rels).collect()
        width = {r.name: len(r.attributes) for r in rels}
        norm = sum(s["rows"] * width[s["name"]] for s in sizes)
    redundancy = max(0.0, 1.0 - norm / max(1, flat)) if rels else 0.0
    row = (n, d, flagged_cells, 1.0 - flagged_cells / max(1, n * d), schema.normal_form,
           len(schema.keys), len(rels), redundancy, flat, norm)
    return frame.spark.createDataFrame([row], (
        "rows long, columns long, flagged_cells long, conformance double, normal_form string, "
        "candidate_keys long, relations long, redundancy double, flat_cells long, norm_cells long"))
