import pytest

from tenetdq.operators.decompose import Schema
from tenetdq.plans import algebra as al
from tenetdq.plans.constraints import FunctionalDependency as FD
from tenetdq.plans.constraints import LinearConstraint, Predicate, Rule, active, denial_of, expert_fd


def deps(*pairs):
    return [(frozenset(l), r) for l, r in pairs]


def test_rule_text():
    assert str(FD(("a",), "b")) == "a -> b"
    assert str(FD(("a", "b"), "c")) == "(a, b) -> c"
    assert str(Predicate("x", ">", "y")) == "t1.x > t2.y"
    assert str(LinearConstraint((("z", 1), ("x", -1)), 0, 0.5)) == "1.00*z -1.00*x ~= +0.00  (+-0.5)"


def test_fd_as_denial_constraint():
    dc = denial_of(FD(("a", "b"), "c", 0.9))
    assert [p.op for p in dc.predicates] == ["=", "=", "!="]
    assert dc.confidence == 0.9 and dc.attributes == {"a", "b", "c"}


def test_unknown_operator():
    with pytest.raises(ValueError):
        Predicate("a", "~", "b")


def test_rule_switches():
    rules = [expert_fd(["a"], "b"), Rule(FD(("b",), "c"), enabled=False)]
    assert [str(r) for r in active(rules)] == ["a -> b"]
    assert rules[0].source == "expert" and rules[0].constraint.confidence == 1.0


def test_closure_cover_keys():
    d = deps("Ab", "Bc") and deps(("A", "B"), ("B", "C"))
    assert al.closure({"A"}, d) == {"A", "B", "C"}
    assert al.cover(d + deps(("A", "C"))) == d
    assert al.cover(deps(("A", "B"), ("AB", "C"))) == deps(("A", "B"), ("A", "C"))
    assert al.keys("ABC", d) == [frozenset("A")]
    assert al.keys("ABC", deps(("AB", "C"), ("C", "B"))) == [frozenset("AB"), frozenset("AC")]


def test_normal_forms():
    d = deps(("AB", "C"), ("C", "B"))
    assert al.normal_form("ABC", d, al.keys("ABC", d)) == "3NF"
    chain = deps(("A", "B"), ("B", "C"))
    assert al.normal_form("ABC", chain, al.keys("ABC", chain)) == "lower than 3NF"
    assert al.normal_form("AB", deps(("A", "B")), [frozenset("A")]) == "BCNF"
    assert {frozenset(r.attributes) for r in al.boyce_codd("ABC", chain)} == {frozenset("AB"), frozenset("BC")}
    assert al.third_normal_form("ABCD", chain)[-1].attributes == {"A", "D"}


def test_schema_without_rules():
    s = Schema([], ["a", "b"])
    assert s.normal_form.startswith("n/a") and s.attributes == ["a", "b"] and s.relations_bcnf == []
