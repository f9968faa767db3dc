"""Connected components by DataFrame operations only.

Each round every node looks at its neighbours' labels, hooks itself and its label's own node under the
smallest one, and then jumps to its label's label, so paths halve and the number of rounds is
logarithmic in practice. Sums over a node are pre-aggregated per task; a hub's edges are joined by a
sort-merge join that adaptive execution may split. Each round's labels are a table in the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenetdq.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b of one orderable type; returns node, label (smallest node)."""
    both = settled(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
                   .unionByName(links.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"))),
                   "component-links")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select(
        "node", F.least("node", "v").alias("label"))
    labels = settled(labels, "component-labels")
    while True:
        nearest = (both.join(labels.withColumnRenamed("node", "v"), "v")
                   .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near")))
        seen = labels.join(nearest, "node")
        hooks = seen.select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")).unionByName(
            seen.where("near < label").select(F.col("label").alias("node"), F.col("near").alias("label"),
                                              F.lit(None).cast(seen.schema["label"].dataType).alias("was")))
        hooked = hooks.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        upper = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = settled(hooked.join(upper, "label").select("node", F.col("above").alias("label"), "was"),
                      "component-labels")
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels
