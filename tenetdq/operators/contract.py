"""Contracts: freeze the accepted rules, store them, and re-validate any table."""
from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenetdq.functions.counting import joint_counts, spec_stats
from tenetdq.operators.monitors import dc_monitor
from tenetdq.operators.scoring import residual, split
from tenetdq.plans.constraints import (Constraint, DenialConstraint, FunctionalDependency,
                                       LinearConstraint, Predicate)
from tenetdq.plans.frame import Frame

CONTRACT_SCHEMA = (
    "version int, table string, ord int, id string, kind string, columns array<string>, "
    "lhs array<string>, rhs string, confidence double, "
    "terms map<string,double>, offset double, tolerance double, "
    "predicates array<struct<left:string,op:string,right:string>>")
VERSION = 1
LOG = logging.getLogger(__name__)
CHECK_SLACK = 1e-9


def freeze(spark: SparkSession, table: str, rules: Sequence[Constraint],
           keys: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Contract records in the order key, fd, linear, order."""
    fds, linear, order = split(rules)
    rec = []

    def add(cid, kind, columns=None, lhs=None, rhs=None, confidence=None, terms=None,
            offset=None, tolerance=None, predicates=None):
        rec.append((VERSION, table, len(rec), cid, kind, columns, lhs, rhs, confidence, terms,
                    offset, tolerance, predicates))

    # an id says what the record says: key(a, b), fd(a, b -> c), linear(a, b, c), order(a = a, x > x, y < y)
    for k in keys:
        add(f"key({', '.join(sorted(k))})", "key", columns=sorted(k))
    for fd in fds:
        add(f"fd({', '.join(fd.lhs)} -> {fd.rhs})", "fd", lhs=list(fd.lhs), rhs=fd.rhs,
            confidence=round(float(fd.confidence), 4))
    for r in linear:
        add(f"linear({', '.join(sorted(r.attributes))})", "linear", terms=dict(r.coefficients),
            offset=float(r.offset), tolerance=float(r.tolerance))
    for dc in order:
        add(f"order({', '.join(f'{p.left} {p.op} {p.right}' for p in dc.predicates)})", "order",
            predicates=[(p.left, p.op, p.right) for p in dc.predicates])
    return spark.createDataFrame(rec, CONTRACT_SCHEMA)


def dump(contract: DataFrame, path: str) -> None:
    contract.coalesce(1).write.mode("errorifexists").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read a contract back; anything without the contract columns is refused."""
    raw = spark.read.json(path)
    if not {"version", "id", "kind"} <= set(raw.columns):
        raise ValueError(f"{path} holds no contract")
    return spark.read.schema(CONTRACT_SCHEMA).json(path).orderBy("ord")


def as_rules(contract: DataFrame) -> list[Constraint]:
    """The constraints of a contract (keys are left out); contracts are a few rows."""
    out: list[Constraint] = []
    for c in contract.orderBy("ord").collect():
        if c["kind"] == "fd":
            out.append(FunctionalDependency(tuple(c["lhs"]), c["rhs"], c["confidence"] or 1.0))
        elif c["kind"] == "linear":
            out.append(LinearConstraint(tuple((c["terms"] or {}).items()), c["offset"] or 0.0,
                                        c["tolerance"] or 0.0))
        elif c["kind"] == "order":
            out.append(DenialConstraint(tuple(Predicate(*p) for p in c["predicates"])))
    return out


@dataclass(frozen=True)
class CheckResult:
    """``violations``: cells (key, fd) or rows (linear) that break the record, -1 where it could not be evaluated, for the ``reason``
    given. ``groups``: left sides with more than one value (key, fd). ``monitored``: rows of an order record in violation, not gated."""
    id: str
    kind: str
    violations: int
    reason: str | None = None
    groups: int | None = None
    monitored: int | None = None

    @property
    def ok(self) -> bool:
        return self.violations == 0


UNKNOWN_KIND, INCOMPLETE, NO_COLUMN, UNKNOWN_OPERATOR, FAILED = (
    "unknown kind", "incomplete record", "missing column", "unknown operator", "evaluation failed")


def _evaluable(c, columns: set[str]) -> str | None:
    """Why a record cannot be evaluated, or None."""
    if c["kind"] not in ("key", "fd", "linear", "order"):
        return UNKNOWN_KIND
    try:
        need = {"key": lambda: c["columns"], "fd": lambda: [*c["lhs"], c["rhs"]],
                "linear": lambda: list(c["terms"]),
                "order": lambda: [x for p in c["predicates"] for x in (p[0], p[2])]}[c["kind"]]()
    except TypeError:
        return INCOMPLETE
    if not need or any(x is None for x in need) or c["kind"] == "linear" and None in (
            *c["terms"].values(), c["offset"], c["tolerance"]):
        return INCOMPLETE
    if not set(need) <= columns:
        return NO_COLUMN
    if c["kind"] == "order" and any(p[1] not in ("=", "!=", "<", "<=", ">", ">=") for p in c["predicates"]):
        return UNKNOWN_OPERATOR
    return None


def check(frame: Frame, contract: DataFrame, order_counts: bool = False) -> list[CheckResult]:
    """Re-validate ``frame``. All keys and dependencies share one counting job, all linear
    rules one scan. A key must determine every other column (it need not be unique).

    Violations of an fd or key are cells that differ from their group's majority, of a linear
    rule rows beyond tolerance; -1 marks a record that cannot be evaluated. Order constraints
    never fail; ``order_counts`` reports their rows separately.
    """
    records = contract.orderBy("ord").collect()
    columns = set(frame.columns)
    reason = [_evaluable(c, columns) for c in records]
    usable = [(i, c) for i, c in enumerate(records) if reason[i] is None]
    specs, owner = [], []
    for i, c in usable:
        if c["kind"] == "fd":
            specs.append((tuple(c["lhs"]), c["rhs"])); owner.append(i)
        elif c["kind"] == "key":
            for col in frame.columns:
                if col not in c["columns"]:
                    specs.append((tuple(c["columns"]), col)); owner.append(i)
    broken_cells = {i: 0 for i, _ in usable}
    broken_groups = dict(broken_cells)
    if specs:
        cols = sorted({x for lhs, rhs in specs for x in (*lhs, rhs)})
        for r in spec_stats(joint_counts(frame.weighted(cols), cols, specs)).collect():
            broken_cells[owner[r["spec"]]] += r["rows"] - r["covered"]
            broken_groups[owner[r["spec"]]] += r["broken"]
    linear = [(i, LinearConstraint(tuple(c["terms"].items()), c["offset"] or 0.0, c["tolerance"] or 0.0))
              for i, c in usable if c["kind"] == "linear"]
    if linear:
        rows = frame.numeric_rows({c for _, r in linear for c in r.attributes})
        row = rows.agg(*[
            F.sum((F.abs(residual(r, rows)) > r.tolerance + CHECK_SLACK).cast("long")).alias(f"v{i}")
            for i, r in linear]).first()
        for i, _ in linear:
            broken_cells[i] = row[f"v{i}"] or 0
    out = []
    for i, c in enumerate(records):
        cid, kind, why = c["id"] or "?", c["kind"] or "?", reason[i]
        seen = None
        if why is None and kind == "order" and order_counts:
            try:
                seen = dc_monitor(frame, DenialConstraint(tuple(Predicate(*p) for p in c["predicates"]))).count()
            except Exception as exc:                         # the other records still stand
                LOG.warning("%s: %s: %s", cid, type(exc).__name__, exc)
                why = FAILED
        if why is not None:
            out.append(CheckResult(cid, kind, -1, why))
        else:
            out.append(CheckResult(cid, kind, broken_cells[i], groups=broken_groups[i] if kind in ("key", "fd") else None,
                                   monitored=seen))
    return out


def check_frame(spark: SparkSession, results: Sequence[CheckResult]) -> DataFrame:
    return spark.createDataFrame(
        [(i, r.id, r.kind, r.violations, r.reason, r.groups, r.monitored, r.ok) for i, r in enumerate(results)],
        "ord int, id string, kind string, violations long, reason string, groups long, monitored long, ok boolean")


def check_summary(results: DataFrame, fail_on_violations: bool = False) -> DataFrame:
    """One row: satisfied and total constraints, summed violations, and the failure flag.

    Records that could not be evaluated are not satisfied and add no violations.
    """
    bad = F.count("*") - F.sum(F.col("ok").cast("long"))
    return results.agg(
        F.sum(F.col("ok").cast("long")).alias("satisfied"), F.count("*").alias("total"),
        F.sum(F.greatest(F.col("violations"), F.lit(0))).alias("violations"),
        (F.lit(fail_on_violations) & (bad > 0)).alias("failed"))


class ContractViolation(Exception):
    """Raised by :func:`enforce` when a contract does not hold."""


def enforce(frame: Frame, contract: DataFrame) -> list[CheckResult]:
    results = check(frame, contract)
    broken = [r.id for r in results if not r.ok]
    if broken:
        raise ContractViolation(f"{len(broken)} constraint(s) do not hold: {', '.join(broken)}")
    return results
