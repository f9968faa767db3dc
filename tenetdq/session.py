"""Session settings and the durable scratch area shared by every operator."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tenetdq", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on (AQE, UTC, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local
    path would be lost together with its executor. That folder goes when the driver's process ends.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="tenetdq-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder (sinks, stream checkpoints)."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _on_file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder, on whatever file system it is."""
    system, target = _on_file_system(spark, path)
    system.delete(target, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written below ``path`` to the end."""
    system, target = _on_file_system(spark, f"{path}/_SUCCESS")
    return system.exists(target)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and continue from there.

    Used where a result feeds several later jobs, or where recomputation could change it
    (range partition ids, floating-point sums). The files survive executor loss.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files: columns, not serialized rows, for wide tables
    of which later jobs read a part."""
    path = scratch_path(df.sparkSession, label)
    flat = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "void" else F.col(f"`{f.name}`")
                       for f in df.schema.fields])
    flat.write.parquet(path)
    return df.sparkSession.read.schema(flat.schema).parquet(path)


def settle_measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`settle`, with aggregates of the written rows observed in the same job."""
    seen = Observation()
    settled = settle(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]))
    return settled, seen.get
