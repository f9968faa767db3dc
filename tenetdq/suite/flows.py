"""Sources, sinks and streams over the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tenetdq.operators.fd import count_cells
from tenetdq.operators.scoring import score_rows
from tenetdq.plans.constraints import FunctionalDependency, LinearConstraint
from tenetdq.plans.frame import from_df
from tenetdq.session import scratch_path
from tenetdq.sources import readers, writers
from tenetdq.streaming import stream as st
from tenetdq.suite import fixtures as fx
from tenetdq.suite.registry import query
from tenetdq.suite.rules import ORDER_RULE, ORDERED_TEXT
from tenetdq.suite.scores import CELLS, GEO_FDS, SCORED

ORDERS_TEXT = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 10 = 3 THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders"""


def _orders(spark, sf_dir, missing):
    """Orders with padded status and a missing marker in every tenth priority."""
    o = fx.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")).alias("o_orderstatus"),
                    F.when(F.col("o_orderkey") % 10 == 3, missing).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


def _values(df):
    return from_df(df.withColumn("row_id", F.lit(0)), "row_id").df.drop("row_id")


@query("csv_source", ORDERS_TEXT)
def csv_source(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".csv"
    _orders(spark, sf_dir, F.lit("N/A")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False,
                                                   ignoreTrailingWhiteSpace=False)
    return _values(readers.read_any(spark, path))


@query("tsv_source", ORDERS_TEXT)
def tsv_source(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".tsv"
    _orders(spark, sf_dir, F.lit("NULL")).write.csv(path, header=True, sep="\t", ignoreLeadingWhiteSpace=False,
                                                    ignoreTrailingWhiteSpace=False)
    return _values(readers.read_any(spark, path))


@query("jsonl_source", ORDERS_TEXT)
def jsonl_source(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".jsonl"
    _orders(spark, sf_dir, F.lit(None)).write.json(path)
    return _values(readers.read_any(spark, path))


@query("json_array_source", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def json_array_source(spark, sf_dir):
    """An array of records over several lines, in one file."""
    path = scratch_path(spark, "nations") + ".json"
    rows = fx.table(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("r"))
    rows.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit("\n]")).alias("value")).write.text(path)
    return _values(readers.read_any(spark, path))


@query("parquet_source", "SELECT event_id, user_id, event_type FROM events")
def parquet_source(spark, sf_dir):
    return readers.read_any(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")


@query("row_cap", "SELECT least(count(*), 500) AS capped, true AS sampled_below FROM events")
def row_cap(spark, sf_dir):
    """The reader's row cap is the feature here: a prefix of a table and a random share of it."""
    capped = readers.read_any(spark, f"{sf_dir}/events.parquet", nrows=500).agg(F.count("*").alias("capped"))
    whole = fx.table(spark, sf_dir, "events").count()
    share = readers.read_any(spark, f"{sf_dir}/events.parquet", sample=0.5).count()
    return capped.withColumn("sampled_below", F.lit(share < whole))


@query("query_source", """SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(count(*) AS VARCHAR) AS n_orders FROM orders GROUP BY o_custkey""")
def query_source(spark, sf_dir):
    df = readers.read_query(spark, "SELECT o_custkey, count(*) AS n_orders FROM src_orders GROUP BY o_custkey",
                            tables={"src_orders": f"{sf_dir}/orders.parquet"})
    return _values(df)


@query("scored_sink", CELLS + ", " + SCORED + """
SELECT CAST(row_id AS VARCHAR) AS row_id, nation_name, round_even(score, 4) AS score, rule FROM scored""")
def scored_sink(spark, sf_dir):
    path = scratch_path(spark, "scored") + ".csv"
    writers.write_scored(score_rows(fx.geo(spark, sf_dir), GEO_FDS), path, "csv")
    back = spark.read.csv(path, header=True, escape='"').na.fill("")
    return back.select("row_id", "nation_name", F.col("score").cast("double").alias("score"), "rule")


@query("rules_sink", "SELECT count(*) > 0 AS found, 'FD' AS kind FROM customer")
def rules_sink(spark, sf_dir):
    from tenetdq.operators.fd import learn_simple
    from tenetdq.plans.constraints import rules_frame
    path = scratch_path(spark, "rules")
    writers.write_rules(rules_frame(spark, learn_simple(fx.geo(spark, sf_dir))), path)
    return spark.read.json(path).groupBy("kind").agg((F.count("*") > 0).alias("found"))


# -- streams -----------------------------------------------------------------
def _geo_stream(spark, sf_dir):
    """The geography fixture with customers arriving as a stream."""
    c = st.files_as_stream(spark, sf_dir, "customer.parquet")
    n, r = fx.table(spark, sf_dir, "nation"), fx.table(spark, sf_dir, "region")
    flat = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .join(F.broadcast(r), n.n_regionkey == r.r_regionkey))
    rows = flat.select(
        "c_custkey", F.col("c_nationkey").alias("nationkey"),
        F.when(F.col("c_custkey") % 97 == 0, "WRONG").otherwise(F.col("n_name")).alias("nation_name"),
        F.when(F.col("c_custkey") % 89 == 0, "WRONG").otherwise(F.col("r_name")).alias("region_name"),
        F.col("c_mktsegment").alias("segment"))
    return st.stream_frame(rows, "c_custkey")


FROZEN = "WITH " + fx.GEO + ", " + fx.GEO_CLEAN + """,
gk AS (SELECT nationkey, count(*) AS size FROM geo_clean GROUP BY ALL), gn AS (SELECT nation_name, count(*) AS size FROM geo_clean GROUP BY ALL),
c AS (SELECT nationkey, nation_name, count(*) AS n FROM geo_clean GROUP BY ALL),
v AS (SELECT geo.*, CASE WHEN gk.size IS NULL THEN 0.0::DOUBLE WHEN n IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - CAST(n AS DOUBLE) / gk.size END AS a,
    CASE WHEN gn.size IS NULL THEN 0.0::DOUBLE WHEN n IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - CAST(n AS DOUBLE) / gn.size END AS b
  FROM geo LEFT JOIN gk USING (nationkey) LEFT JOIN gn USING (nation_name)
  LEFT JOIN c ON c.nationkey = geo.nationkey AND c.nation_name = geo.nation_name)
SELECT row_id, nationkey, nation_name, region_name, segment, greatest(a, b) AS score,
  CASE WHEN greatest(a, b) = 0 THEN '' WHEN b = greatest(a, b) THEN 'nation_name -> nationkey' ELSE 'nationkey -> nation_name' END AS rule FROM v"""


@query("stream_score", FROZEN)
def stream_score(spark, sf_dir):
    """Statistics frozen on the clean table; unknown nation names arrive in the stream."""
    cells = count_cells(fx.geo(spark, sf_dir, planted=False), GEO_FDS[:2])
    path = scratch_path(spark, "stream")
    st.drain(st.to_files(st.score_stream(_geo_stream(spark, sf_dir), cells), path, scratch_path(spark, "progress")))
    return spark.read.parquet(path)


@query("stream_gate", "WITH " + fx.ORDERED + ", " + fx.ORDERED_CLEAN + """,
judged AS (SELECT *, 2 * x - y < -140 OR 2 * x - y > 10 AS lin,
   EXISTS (SELECT 1 FROM ordered_clean b WHERE b.ctx = a.ctx AND a.x > b.x AND a.y < b.y) AS ord FROM ordered a)
SELECT """ + ORDERED_TEXT + """, CASE WHEN lin OR ord THEN 'rejected' ELSE 'accepted' END AS side FROM judged""")
def stream_gate(spark, sf_dir):
    stored = fx.ordered(spark, sf_dir, planted=False)
    p = st.files_as_stream(spark, sf_dir, "part.parquet")
    y = F.when(F.col("p_partkey") % 101 == 7, 0).otherwise(
        2 * F.col("p_size") + 10 * F.length("p_type") + F.col("p_partkey") % 3)
    arriving = st.stream_frame(p.select("p_partkey", F.col("p_type").alias("ctx"), F.col("p_size").alias("x"),
                                        y.cast("long").alias("y")), "p_partkey")
    band = LinearConstraint((("x", 2.0), ("y", -1.0)), -65.0, 75.0)
    kept, refused = scratch_path(spark, "accepted"), scratch_path(spark, "rejected")
    st.drain(st.gate_stream(arriving, stored, [band, ORDER_RULE], kept, refused, scratch_path(spark, "progress")))
    cols = ["row_id", "ctx", "x", "y"]
    return (spark.read.parquet(kept).select(*cols, F.lit("accepted").alias("side"))
            .unionByName(spark.read.parquet(refused).select(*cols, F.lit("rejected").alias("side"))))


@query("stream_fd_stats", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS t FROM events),
c AS (SELECT u, t, count(*) AS n FROM e GROUP BY ALL)
SELECT u AS user_id, t AS event_type, n FROM c""")
def stream_fd_stats(spark, sf_dir):
    e = st.files_as_stream(spark, sf_dir, "events.parquet")
    rows = st.stream_frame(e.select("event_id", "user_id", "event_type"), "event_id")
    path = scratch_path(spark, "counts")
    st.drain(st.count_table(rows, [FunctionalDependency(("user_id",), "event_type")], path, scratch_path(spark, "progress")))
    return st.read_counts(spark, path).select(F.col("lhs")[0].alias("user_id"), F.col("rhs").alias("event_type"), "n")
