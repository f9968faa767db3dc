"""Tables with planted dependencies and errors, derived from the given tables in Spark.

Each fixture exists twice: as a DataFrame plan and as a SQL common table expression (the
independent formulation that the oracle queries use). Errors are planted by key arithmetic, so both
give the same rows on whole tables at any scale.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenetdq.plans.frame import Frame, from_df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_rows(spark: SparkSession, sf_dir: str, planted: bool = True) -> DataFrame:
    """Customers with nation and region; 1/97 nation names and 1/89 region names are wrong."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    flat = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .join(F.broadcast(r), n.n_regionkey == r.r_regionkey))
    nation, region = F.col("n_name"), F.col("r_name")
    if planted:
        nation = F.when(F.col("c_custkey") % 97 == 0, "WRONG").otherwise(nation)
        region = F.when(F.col("c_custkey") % 89 == 0, "WRONG").otherwise(region)
    return flat.select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("nationkey"),
                       nation.alias("nation_name"), region.alias("region_name"),
                       F.col("c_mktsegment").alias("segment"))


GEO_COLUMNS = ["nationkey", "nation_name", "region_name", "segment"]


def geo(spark: SparkSession, sf_dir: str, planted: bool = True) -> Frame:
    return from_df(geo_rows(spark, sf_dir, planted), "row_id")


GEO = """geo AS (
  SELECT c_custkey AS row_id, CAST(c_nationkey AS VARCHAR) AS nationkey,
         CASE WHEN c_custkey % 97 = 0 THEN 'WRONG' ELSE n_name END AS nation_name,
         CASE WHEN c_custkey % 89 = 0 THEN 'WRONG' ELSE r_name END AS region_name,
         c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

GEO_CLEAN = """geo_clean AS (
  SELECT c_custkey AS row_id, CAST(c_nationkey AS VARCHAR) AS nationkey, n_name AS nation_name,
         r_name AS region_name, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with supplier geography; two exact dependencies. The rows carry no unique key."""
    li, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    return (li.join(s, li.l_suppkey == s.s_suppkey)
            .join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
            .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("s_nationkey").alias("nationkey"), F.col("r_name").alias("region_name"),
                    F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("returnflag")))


CHAIN_COLUMNS = ["nationkey", "region_name", "suppkey", "returnflag"]


def chain(spark: SparkSession, sf_dir: str, id_cardinality: int = 100_000) -> Frame:
    """As a frame for column statistics: the row id is not needed, so none is assigned."""
    rows = chain_rows(spark, sf_dir).withColumn("row_id", F.lit(0).cast("long"))
    return from_df(rows, "row_id", CHAIN_COLUMNS, id_cardinality)


CHAIN = """chain AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS nationkey, r_name AS region_name,
         CAST(l_suppkey AS VARCHAR) AS suppkey, l_returnflag AS returnflag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def graded(spark: SparkSession, sf_dir: str) -> Frame:
    """Parts whose grade depends on type and brand together; 1/53 grades are wrong."""
    p = table(spark, sf_dir, "part")
    brand_no = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    grade = F.when(F.col("p_partkey") % 53 == 0, "BAD").otherwise(
        F.concat(F.lit("G"), ((F.length("p_type") * 7 + brand_no * 3) % 10).cast("string")))
    return from_df(p.select(F.col("p_partkey").alias("row_id"), "p_type", "p_brand", grade.alias("grade")),
                   "row_id")


GRADED = r"""graded AS (
  SELECT p_partkey AS row_id, p_type, p_brand,
         CASE WHEN p_partkey % 53 = 0 THEN 'BAD'
              ELSE 'G' || CAST((length(p_type) * 7
                   + CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) * 3) % 10 AS VARCHAR) END AS grade
  FROM part)"""


def ordered(spark: SparkSession, sf_dir: str, planted: bool = True) -> Frame:
    """Parts where y grows with x within each type, except for 1/101 planted rows."""
    p = table(spark, sf_dir, "part")
    y = 2 * F.col("p_size") + 10 * F.length("p_type") + F.col("p_partkey") % 3
    if planted:
        y = F.when(F.col("p_partkey") % 101 == 7, 0).otherwise(y)
    return from_df(p.select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("ctx"),
                            F.col("p_size").alias("x"), y.cast("long").alias("y")), "row_id")


ORDERED = """ordered AS (
  SELECT p_partkey AS row_id, p_type AS ctx, CAST(p_size AS DOUBLE) AS x,
         CAST(CASE WHEN p_partkey % 101 = 7 THEN 0
              ELSE 2 * p_size + 10 * length(p_type) + p_partkey % 3 END AS DOUBLE) AS y
  FROM part)"""


ORDERED_CLEAN = """ordered_clean AS (
  SELECT p_partkey AS row_id, p_type AS ctx, CAST(p_size AS DOUBLE) AS x,
         CAST(2 * p_size + 10 * length(p_type) + p_partkey % 3 AS DOUBLE) AS y
  FROM part)"""


def summed(spark: SparkSession, sf_dir: str) -> Frame:
    """Parts with z = x + y0, except for 1/97 planted rows."""
    p = table(spark, sf_dir, "part")
    y0 = (F.col("p_partkey") * 7) % 41
    z = F.col("p_size") + y0 + F.when(F.col("p_partkey") % 97 == 11, 50).otherwise(0)
    return from_df(p.select(F.col("p_partkey").alias("row_id"), F.col("p_size").alias("x"),
                            y0.alias("y0"), z.alias("z")), "row_id")


SUMMED = """summed AS (
  SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS x, CAST((p_partkey * 7) % 41 AS DOUBLE) AS y0,
         CAST(p_size + (p_partkey * 7) % 41
              + (CASE WHEN p_partkey % 97 = 11 THEN 50 ELSE 0 END) AS DOUBLE) AS z
  FROM part)"""


def priced(spark: SparkSession, sf_dir: str) -> Frame:
    """Orders with a price, a price with noise (both nearly all distinct), a customer and a value that grows with it."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return from_df(o.select(key.alias("row_id"), F.col("o_totalprice").alias("price"),
                            (F.col("o_totalprice") + (key * 7919) % 100003).alias("noisy"), F.col("o_custkey").alias("cust"),
                            (F.col("o_custkey") * 2 + (key * 7919) % 1001).alias("grown")), "row_id")


PRICED = """priced AS (
  SELECT o_orderkey AS row_id, o_totalprice AS price, o_totalprice + (o_orderkey * 7919) % 100003 AS noisy,
         o_custkey AS cust, o_custkey * 2 + (o_orderkey * 7919) % 1001 AS grown FROM orders)"""
