"""Registered queries over the given tables and the SQL they are checked against."""
from tenetdq.suite import discovery, scores, rules, learners, flows  # noqa: F401,E401
from tenetdq.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
