"""Normalization, profiling and dependency mining."""
from __future__ import annotations

from pyspark.sql import functions as F

from tenetdq.operators import fd as fds
from tenetdq.operators import profile as prof
from tenetdq.plans.constraints import rules_frame
from tenetdq.plans.frame import from_df
from tenetdq.suite import fixtures as fx
from tenetdq.suite.registry import long_sql, query

LINE_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                "l_suppkey", "l_orderkey"]
ORDER_COLUMNS = ["o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey"]


@query("normalize_values", r"""
SELECT c_custkey AS row_id, trim(c_name) AS name, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS segment,
       CAST(c_nationkey AS VARCHAR) AS nationkey
FROM customer""")
def normalize_values(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    padded = c.select(
        "c_custkey", F.concat(F.lit(" \t\xa0"), "c_name", F.lit("\x1f \n")).alias("name"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_nationkey").alias("nationkey"))
    return from_df(padded, "c_custkey").df


PROFILE = """
WITH cells AS ({cells}),
counts AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY ALL),
stats AS (SELECT "column", CAST(sum(n) AS BIGINT) AS "rows", count(*) AS "distinct", max(n) AS top,
                 sum(CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN n ELSE 0 END) AS num
          FROM counts GROUP BY "column")
SELECT "column", "rows", "distinct", CAST(num AS DOUBLE) / "rows" AS numeric_fraction,
       CAST(top AS DOUBLE) / "rows" AS base_rate,
       CASE WHEN "distinct" > 300 THEN 'identifier' WHEN CAST(num AS DOUBLE) / "rows" > 0.95 THEN 'numeric'
            ELSE 'categorical' END AS kind,
       "distinct" > 1 AND "distinct" <= 300 AS modeling
FROM stats"""


@query("column_profile", PROFILE.format(cells=long_sql("lineitem", LINE_COLUMNS)))
def column_profile(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("row_id"), *LINE_COLUMNS)
    return prof.profile_frame(from_df(li, "row_id", LINE_COLUMNS))


@query("column_kinds", """
WITH p AS (""" + PROFILE.format(cells=long_sql("orders", ORDER_COLUMNS)) + """)
SELECT "column", kind, modeling FROM p""")
def column_kinds(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.lit(0).alias("row_id"), *ORDER_COLUMNS)
    p = prof.profile_columns(from_df(o, "row_id", ORDER_COLUMNS))
    chosen = p.modeling()
    return spark.createDataFrame([(c, k, c in chosen) for c, k in p.kinds.items()],
                                 "column string, kind string, modeling boolean")


@query("numeric_view", r"""
SELECT event_id AS row_id,
       CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS user_id
FROM events""")
def numeric_view(spark, sf_dir):
    from tenetdq.functions.values import number_view
    e = fx.table(spark, sf_dir, "events")
    text = F.col("user_id").cast("string")
    mixed = F.when(F.col("event_id") % 5 == 0, F.concat(text, F.lit("f"))).when(
        F.col("event_id") % 7 == 0, F.lit("NaN")).otherwise(text)
    frame = from_df(e.select("event_id", mixed.alias("user_id")), "event_id")
    return number_view(frame.df, ["user_id"], keep="row_id")


@query("value_counts", """
WITH cells AS (""" + long_sql("lineitem", LINE_COLUMNS) + """),
counts AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY ALL),
near AS (SELECT "column" FROM counts GROUP BY "column" HAVING count(*) <= 300)
SELECT "column", CASE WHEN "column" IN ('l_quantity', 'l_discount', 'l_tax')
                      THEN CAST(CAST(round(CAST(value AS DOUBLE) * 100) AS BIGINT) AS VARCHAR) ELSE value END AS value, n
FROM counts JOIN near USING ("column")""")
def value_counts(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("row_id"), *LINE_COLUMNS)
    counts = prof.full_value_counts(from_df(li, "row_id", LINE_COLUMNS))
    cents = F.round(F.col("value").cast("double") * 100).cast("long").cast("string")
    return counts.select("column", F.when(F.col("column").isin("l_quantity", "l_discount", "l_tax"), cents)
                         .otherwise(F.col("value")).alias("value"), "n")


@query("base_rate", "WITH " + fx.GEO + ", cells AS (" + long_sql("geo", fx.GEO_COLUMNS) + """),
counts AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY ALL)
SELECT "column", CAST(max(n) AS DOUBLE) / sum(n) AS base_rate FROM counts GROUP BY "column" """)
def base_rate(spark, sf_dir):
    return prof.base_rates(fx.geo(spark, sf_dir), fx.GEO_COLUMNS)


@query("avg_group_size", "WITH " + fx.CHAIN + """
SELECT '' AS "columns", CAST(1 AS BIGINT) AS groups, CAST(count(*) AS DOUBLE) AS avg_group_size FROM chain
UNION ALL
SELECT 'suppkey', count(DISTINCT suppkey), CAST(count(*) AS DOUBLE) / count(DISTINCT suppkey) FROM chain
UNION ALL
SELECT 'suppkey, returnflag', count(DISTINCT suppkey || '|' || returnflag),
       CAST(count(*) AS DOUBLE) / count(DISTINCT suppkey || '|' || returnflag) FROM chain""")
def avg_group_size(spark, sf_dir):
    return prof.average_group_size(fx.chain(spark, sf_dir), [[], ["suppkey"], ["suppkey", "returnflag"]])


def pair_sql(source: str, columns: list[str]) -> str:
    """SQL text: (lhs, rhs, confidence) of all ordered pairs."""
    parts = [
        f"SELECT '{a}' AS lhs, '{b}' AS rhs, CAST(sum(m) AS DOUBLE) / sum(s) AS confidence FROM "
        f"(SELECT {a}, max(n) AS m, sum(n) AS s FROM (SELECT {a}, {b}, count(*) AS n FROM {source} GROUP BY ALL) "
        f"GROUP BY {a})" for a in columns for b in columns if a != b]
    return " UNION ALL ".join(parts)


@query("single_source_confidence", "WITH " + fx.GEO + " " + pair_sql("geo", fx.GEO_COLUMNS))
def single_source_confidence(spark, sf_dir):
    return fds.single_source_frame(fx.geo(spark, sf_dir), fx.GEO_COLUMNS)


@query("single_source_confidence_chain", "WITH " + fx.CHAIN + " " + pair_sql("chain", fx.CHAIN_COLUMNS))
def single_source_confidence_chain(spark, sf_dir):
    return fds.single_source_frame(fx.chain(spark, sf_dir), fx.CHAIN_COLUMNS)


WIDE_COLUMNS = ["quantity", "discount", "tax", "flag", "status", "line", "supplier", "month", "weekday"]
WIDE = """wide AS (
  SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) AS discount,
         CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) AS tax, l_returnflag AS flag, l_linestatus AS status, CAST(l_linenumber AS VARCHAR) AS line,
         CAST(l_suppkey AS VARCHAR) AS supplier, strftime(l_shipdate, '%Y-%m') AS month, CAST(isodow(l_shipdate) AS VARCHAR) AS weekday
  FROM lineitem)"""


@query("single_source_confidence_wide", "WITH " + WIDE + " " + pair_sql("wide", WIDE_COLUMNS))
def single_source_confidence_wide(spark, sf_dir):
    li, day = fx.table(spark, sf_dir, "lineitem"), F.col("l_shipdate")
    rows = li.select(F.lit(0).cast("long").alias("row_id"), F.col("l_quantity").cast("long").alias("quantity"),
                     F.round(F.col("l_discount") * 100).cast("long").alias("discount"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
                     F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"),
                     F.col("l_suppkey").alias("supplier"), F.date_format(day, "yyyy-MM").alias("month"),
                     (F.weekday(day) + 1).alias("weekday"))
    frame = from_df(rows, "row_id", WIDE_COLUMNS, 10_000)
    frame.profile                                           # keeps the values that the columns are coded by
    names = F.array(*[F.lit(c) for c in WIDE_COLUMNS])
    return fds.pair_table(frame, WIDE_COLUMNS).select(names[F.col("l")].alias("lhs"), names[F.col("r")].alias("rhs"),
                                                      (F.col("covered") / F.col("rows")).alias("confidence"))


def spec_sql(source: str, lhs: list[str], rhs: str) -> str:
    keys = ", ".join(lhs) or "0"
    return (f"SELECT '{', '.join(lhs)}' AS lhs, '{rhs}' AS rhs, CAST(sum(m) AS DOUBLE) / sum(s) AS confidence, "
            f"count(*) AS groups, CAST(sum(s) AS DOUBLE) / count(*) AS avg_group_size FROM "
            f"(SELECT max(n) AS m, sum(n) AS s FROM (SELECT {keys}, {rhs}, count(*) AS n FROM {source} "
            f"GROUP BY ALL) t GROUP BY {keys if lhs else 'ALL'})")


SPECS = [((), "grade"), (("p_type", "p_brand"), "grade"), (("grade", "p_brand"), "p_type"), (("p_type",), "grade")]


@query("composite_confidence", "WITH " + fx.GRADED + " " + " UNION ALL ".join(
    spec_sql("graded", list(lhs), rhs) for lhs, rhs in SPECS))
def composite_confidence(spark, sf_dir):
    return fds.confidence_frame(fx.graded(spark, sf_dir), SPECS)


def mine_sql(source: str, columns: list[str], tau: float = 0.9, lift: float = 0.1) -> str:
    """SQL text: best single source per target (first column on ties), if strong enough."""
    rank = "CASE lhs " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(columns)) + " END"
    base = " UNION ALL ".join(
        f"SELECT '{c}' AS rhs, CAST(max(n) AS DOUBLE) / sum(n) AS base FROM "
        f"(SELECT {c}, count(*) AS n FROM {source} GROUP BY ALL)" for c in columns)
    return f"""conf AS ({pair_sql(source, columns)}), base AS ({base}),
best AS (SELECT *, row_number() OVER (PARTITION BY rhs ORDER BY confidence DESC, {rank}) AS rn FROM conf)
SELECT lhs || ' -> ' || rhs AS rule, round(confidence, 4) AS confidence
FROM best JOIN base USING (rhs) WHERE rn = 1 AND confidence >= {tau} AND confidence - base >= {lift}"""


def _rule_table(spark, rules):
    return rules_frame(spark, rules).select("rule", "confidence")


@query("mine_fds", "WITH " + fx.GEO + ", " + mine_sql("geo", fx.GEO_COLUMNS))
def mine_fds(spark, sf_dir):
    return _rule_table(spark, fds.mine(fx.geo(spark, sf_dir), max_lhs=1))


@query("mine_fds_chain", "WITH " + fx.CHAIN + ", " + mine_sql("chain", fx.CHAIN_COLUMNS))
def mine_fds_chain(spark, sf_dir):
    return _rule_table(spark, fds.learn_simple(fx.chain(spark, sf_dir)))


@query("mine_fds_composite", "WITH " + fx.GRADED + """,
conf AS (""" + pair_sql("graded", ["p_type", "p_brand", "grade"]) + """),
best AS (SELECT rhs, max_by(lhs, confidence) AS first, min_by(lhs, confidence) AS second,
                max(confidence) AS c1 FROM conf GROUP BY rhs),
pairs AS (""" + " UNION ALL ".join(
    spec_sql("graded", lhs, rhs) for lhs, rhs in [
        (["p_brand", "grade"], "p_type"), (["p_type", "grade"], "p_brand"), (["p_type", "p_brand"], "grade")]) + """),
base AS (SELECT 'p_type' AS rhs, CAST(max(n) AS DOUBLE) / sum(n) AS base FROM (SELECT p_type, count(*) AS n FROM graded GROUP BY ALL)
   UNION ALL SELECT 'p_brand', CAST(max(n) AS DOUBLE) / sum(n) FROM (SELECT p_brand, count(*) AS n FROM graded GROUP BY ALL)
   UNION ALL SELECT 'grade', CAST(max(n) AS DOUBLE) / sum(n) FROM (SELECT grade, count(*) AS n FROM graded GROUP BY ALL))
SELECT CASE WHEN c1 >= 0.9 THEN first || ' -> ' || b.rhs ELSE '(' || first || ', ' || second || ') -> ' || b.rhs END AS rule,
       round(CASE WHEN c1 >= 0.9 THEN c1 ELSE p.confidence END, 4) AS confidence
FROM best b JOIN pairs p USING (rhs) JOIN base USING (rhs)
WHERE (c1 >= 0.9 AND c1 - base >= 0.1)
   OR (c1 < 0.9 AND p.confidence > c1 + 0.05 AND p.avg_group_size >= 3 AND p.confidence >= 0.9
       AND p.confidence - base >= 0.1)""")
def mine_fds_composite(spark, sf_dir):
    return _rule_table(spark, fds.mine(fx.graded(spark, sf_dir), max_lhs=2))
