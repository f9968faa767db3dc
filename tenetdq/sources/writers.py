"""Sinks. All writes are distributed; nothing passes through the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenetdq.functions.values import round_even
from tenetdq.plans.constraints import RULE_SCHEMA


def write_scored(scored: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Scored rows with ``score`` (four decimals) and ``rule`` as two extra columns."""
    out = scored.withColumn("score", round_even(F.col("score"), 4))
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True, quote='"', escape='"', emptyValue="")
    else:
        writer.format(fmt).save(path)


def write_relations(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> dict[str, str]:
    """One Parquet dataset per relation; returns their paths."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in tables}
    for name, table in tables.items():
        table.write.mode(mode).parquet(paths[name])
    return paths


def write_rules(rules: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The rules of a model as JSON lines (a handful of rows, one file)."""
    rules.coalesce(1).write.mode(mode).json(path)


def write_model(model, folder: str, mode: str = "errorifexists") -> dict[str, str]:
    """A model as JSON tables: its rules, its keys with the normal form, and its 3NF and BCNF relations; returns their paths."""
    parts = {"rules": model.constraints, "keys": model.keys, "relations": model.relations}
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in parts}
    for name, part in parts.items():
        part.coalesce(1).write.mode(mode).json(paths[name])          # a handful of rows
    return paths


MODEL_SCHEMAS = {
    "rules": RULE_SCHEMA, "keys": "ord int, key array<string>, normal_form string",
    "relations": "form string, name string, attributes array<string>, key array<string>"}


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of :func:`write_model`."""
    return {name: spark.read.schema(schema).json(f"{folder.rstrip('/')}/{name}") for name, schema in MODEL_SCHEMAS.items()}
