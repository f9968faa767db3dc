"""Structured Streaming: score, gate and count incoming rows against frozen knowledge."""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tenetdq.functions.values import as_text
from tenetdq.operators.fd import FdCells
from tenetdq.operators.monitors import gate_members, gate_rules, judge_batch, staircase
from tenetdq.operators.scoring import greatest_of, residual
from tenetdq.plans.constraints import FunctionalDependency, LinearConstraint
from tenetdq.plans.frame import ROW_ID, Frame
from tenetdq.session import is_written, remove_path, scratch_path, settle


def stream_frame(stream: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Value view of a stream (the same normalization as for a table)."""
    types = {f.name: f.dataType for f in stream.schema.fields}
    columns = columns or [c for c in stream.columns if c != row_id]
    return stream.select(F.col(f"`{row_id}`").alias(ROW_ID),
                         *[as_text(F.col(f"`{c}`"), types[c]).alias(c) for c in columns])


def score_stream(rows: DataFrame, cells: FdCells, linear: Sequence[LinearConstraint] = ()) -> DataFrame:
    """Score every row against frozen statistics: an unknown left side scores 0, a known left
    side with an unknown right side scores 1. Stream-static joins; broadcast when measured small."""
    columns = rows.columns
    parts, names = [], []
    for i, fd in enumerate(cells.fds):
        small = cells.small.get(i, True)
        hint = F.broadcast if small else (lambda d: d)
        groups = cells.groups(i, "size").withColumnRenamed("size", f"__g{i}")
        table = cells.table(i, F.col("violation").alias(f"__v{i}"))
        rows = rows.join(hint(groups), list(fd.lhs), "left").join(hint(table), [*fd.lhs, fd.rhs], "left")
        parts.append(F.when(F.col(f"__g{i}").isNull(), 0.0).otherwise(F.coalesce(f"__v{i}", F.lit(1.0))))
        names.append(str(fd))
    for r in linear:
        parts.append((F.abs(residual(r, rows, missing_as_zero=True)) > r.tolerance).cast("double"))
        names.append(str(r))
    if not parts:
        return rows.withColumns({"score": F.lit(0.0), "rule": F.lit("")})
    rows = rows.withColumn("score", greatest_of(parts))
    rule = F.lit("")
    for p, name in reversed(list(zip(parts, names))):
        rule = F.when(p == F.col("score"), name).otherwise(rule)
    rows = rows.withColumn("rule", F.when(F.col("score") > 0, rule).otherwise(F.lit("")))
    return rows.select(*columns, "score", "rule")


def to_files(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to Parquet, exactly once per micro-batch."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start())


def gate_stream(rows: DataFrame, reference: Frame, rules: Sequence, accepted: str, rejected: str,
                checkpoint: str, state: str | None = None, extend: bool = True, **trigger) -> StreamingQuery:
    """Split every micro-batch into accepted and rejected rows (with the reason).

    What the reference says about each constraint is frozen once, as the rows that decide (``monitors.staircase``), below
    ``state`` (by default beside ``checkpoint``); batches never read the reference. With ``extend`` the accepted rows of a batch join
    them for the batches after it: batch n reads version n - 1 and writes version n. Rows of one batch are not compared with each
    other. Each batch writes below its own ``batch=<id>`` folder in overwrite mode, so a replay after
    a failure replaces its own output instead of adding to it.
    """
    columns = [c for c in rows.columns if c != ROW_ID]
    spark, state = rows.sparkSession, state or f"{checkpoint.rstrip('/')}-members"
    tested = gate_rules(rules)

    def version(name: str, batch_id: int) -> str:
        return f"{state}/{name}/version={batch_id if extend else -1}"

    if not all(is_written(spark, version(name, -1)) for name in tested):    # a restarted stream goes on with what it has
        for name, members in gate_members(reference, rules).items():
            members.write.mode("overwrite").parquet(version(name, -1))

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            members = {name: spark.read.parquet(version(name, batch_id - 1)) for name in tested}
            judged = settle(judge_batch(Frame(kept, columns, reference.id_cardinality), members, rules))
            good = judged.where("accepted").drop("accepted", "reason")
            good.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
            judged.where("not accepted").drop("accepted").write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
            if extend:
                more = gate_members(Frame(good, columns, reference.id_cardinality), rules)
                for name, dc in tested.items():
                    staircase(members[name].unionByName(more[name]), dc).write.mode("overwrite").parquet(version(name, batch_id))
                    if batch_id > 2:
                        remove_path(spark, version(name, batch_id - 3))     # no replay reads it any more
        finally:
            kept.unpersist()

    return (rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def running_counts(rows: DataFrame, fds: Sequence[FunctionalDependency]) -> DataFrame:
    """Incremental (spec, lhs, rhs, n): the state holds one counter per value combination."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("spec"), F.array(*[F.col(f"`{a}`") for a in fd.lhs]).alias("lhs"),
                 F.col(f"`{fd.rhs}`").alias("rhs")) for i, fd in enumerate(fds)]))
    return rows.select(cells.alias("c")).select("c.*").groupBy("spec", "lhs", "rhs").agg(F.count("*").alias("n"))


def count_stream(rows: DataFrame, fds: Sequence[FunctionalDependency], publish: Callable[[DataFrame, int], None],
                 checkpoint: str, **trigger) -> StreamingQuery:
    """Publish the complete counts after every micro-batch."""
    return (running_counts(rows, fds).writeStream.outputMode("complete").foreachBatch(publish)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def count_table(rows: DataFrame, fds: Sequence[FunctionalDependency], path: str, checkpoint: str,
                compact_every: int = 50, **trigger) -> StreamingQuery:
    """Keep the counts of a stream as a table below ``path`` (read it with :func:`read_counts`).

    A batch writes the counters that it changed, and only those, as ``batch=<id>``; a replay replaces them. Counters only
    grow, so the largest one of a combination is the latest. Every ``compact_every`` batches the changes since the last time
    are merged into ``batch=-<id>``, written before the folders that it replaces go, so readers always find every counter.
    """
    spark = rows.sparkSession

    def publish(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if compact_every and batch_id and batch_id % compact_every == 0:
            merged = settle(read_counts(spark, path))
            merged.write.mode("overwrite").parquet(f"{path}/batch=-{batch_id}")
            for old in range(batch_id - compact_every, batch_id):
                remove_path(spark, f"{path}/batch={old}")
            remove_path(spark, f"{path}/batch=-{batch_id - compact_every}")

    return (running_counts(rows, fds).writeStream.outputMode("update").foreachBatch(publish)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(spec, lhs, rhs, n): the counts that :func:`count_table` has kept so far."""
    return spark.read.parquet(path).groupBy("spec", "lhs", "rhs").agg(F.max("n").alias("n"))


def drain(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query to finish."""
    query.awaitTermination()


def files_as_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Parquet files of ``folder`` matching ``pattern`` as a stream; the schema is that of the
    files already there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


__all__ = ["stream_frame", "score_stream", "to_files", "gate_stream", "running_counts", "count_stream", "count_table", "read_counts",
           "drain", "files_as_stream", "scratch_path"]
