"""Scoring, explanations, ranks, marginal surprise, routing and ensembles."""
from __future__ import annotations

from pyspark.sql import functions as F

from tenetdq.functions.running import rank_columns
from tenetdq.operators import scoring as sc
from tenetdq.operators.marginal import MarginalSurprise, marginal_cells
from tenetdq.operators.report import analyze
from tenetdq.operators.routed import EnsembleLearner, FdLearner, RoutedLearner
from tenetdq.plans.constraints import FunctionalDependency, LinearConstraint, Rule, active, expert_fd, report_order, rules_frame
from tenetdq.plans.frame import from_df
from tenetdq.suite import fixtures as fx
from tenetdq.suite.registry import query

# the dependencies of the geography fixture, as a user would state them
GEO_FDS = [FunctionalDependency(("nation_name",), "nationkey", 0.9913),
           FunctionalDependency(("nationkey",), "nation_name", 0.9893),
           FunctionalDependency(("nationkey",), "region_name", 0.9887)]
SUM_RULE = LinearConstraint((("z", 1.0), ("x", -1.0), ("y0", -1.0)), 0.0, 0.5, 0.98)

VIOL = """viol AS (
  SELECT *, 1.0::DOUBLE - CAST(count(*) OVER (PARTITION BY nation_name, nationkey) AS DOUBLE) / count(*) OVER (PARTITION BY nation_name) AS v_key,
         1.0::DOUBLE - CAST(count(*) OVER (PARTITION BY nationkey, nation_name) AS DOUBLE) / count(*) OVER (PARTITION BY nationkey) AS v_nation,
         1.0::DOUBLE - CAST(count(*) OVER (PARTITION BY nationkey, region_name) AS DOUBLE) / count(*) OVER (PARTITION BY nationkey) AS v_region
  FROM geo)"""
CELLS = f"WITH {fx.GEO}, {VIOL}"
SCORED = """scored AS (
  SELECT row_id, nationkey, nation_name, region_name, segment, greatest(v_key, v_nation, v_region) AS score,
         CASE WHEN greatest(v_key, v_nation, v_region) = 0 THEN ''
              WHEN v_key = greatest(v_key, v_nation, v_region) THEN 'nation_name -> nationkey'
              WHEN v_nation = greatest(v_key, v_nation, v_region) THEN 'nationkey -> nation_name'
              ELSE 'nationkey -> region_name' END AS rule
  FROM viol)"""


@query("fd_cell_score", CELLS + """
SELECT row_id, v_key AS nationkey, v_nation AS nation_name, v_region AS region_name, 0.0::DOUBLE AS segment FROM viol""")
def fd_cell_score(spark, sf_dir):
    return sc.fd_cell_scores(fx.geo(spark, sf_dir), GEO_FDS)


@query("tuple_score", CELLS + " SELECT row_id, greatest(v_key, v_nation, v_region) AS score FROM viol")
def tuple_score(spark, sf_dir):
    frame = fx.geo(spark, sf_dir)
    return sc.tuple_scores(sc.fd_cell_scores(frame, GEO_FDS), frame.columns)


@query("score_table", CELLS + ", " + SCORED + " SELECT * FROM scored")
def score_table(spark, sf_dir):
    return sc.score_rows(fx.geo(spark, sf_dir), GEO_FDS)


@query("score_table_linear", "WITH " + fx.SUMMED + """
SELECT row_id, CAST(CAST(x AS BIGINT) AS VARCHAR) AS x, CAST(CAST(y0 AS BIGINT) AS VARCHAR) AS y0, CAST(CAST(z AS BIGINT) AS VARCHAR) AS z,
       CASE WHEN abs(z - x - y0) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
       CASE WHEN abs(z - x - y0) > 0.5 THEN '1.00*z -1.00*x -1.00*y0 ~= +0.00  (+-0.5)' ELSE '' END AS rule FROM summed""")
def score_table_linear(spark, sf_dir):
    return sc.score_rows(fx.summed(spark, sf_dir), [SUM_RULE])


@query("score_summary", CELLS + ", " + SCORED + """
SELECT count(*) AS "rows", count(*) FILTER (score >= 0.5) AS flagged, 0.5::DOUBLE AS threshold, max(score) AS max_score FROM scored""")
def score_summary(spark, sf_dir):
    return sc.summarize(sc.score_rows(fx.geo(spark, sf_dir), GEO_FDS))


@query("score_summary_lines", "WITH " + fx.CHAIN + """, v AS (
  SELECT 1.0::DOUBLE - CAST(count(*) OVER (PARTITION BY suppkey, returnflag) AS DOUBLE) / count(*) OVER (PARTITION BY suppkey) AS a,
         1.0::DOUBLE - CAST(count(*) OVER (PARTITION BY nationkey, returnflag, suppkey) AS DOUBLE)
           / count(*) OVER (PARTITION BY nationkey, returnflag) AS b FROM chain)
SELECT count(*) AS "rows", count(*) FILTER (greatest(a, b) >= 0.7) AS flagged, 0.7::DOUBLE AS threshold,
       max(greatest(a, b)) AS max_score FROM v""")
def score_summary_lines(spark, sf_dir):
    rules = [FunctionalDependency(("suppkey",), "returnflag"),
             FunctionalDependency(("nationkey", "returnflag"), "suppkey")]
    return sc.summarize(sc.score_rows(fx.chain(spark, sf_dir), rules), 0.7)


@query("top_rows", CELLS + ", " + SCORED + """
SELECT row_id, round_even(score, 4) AS score, rule FROM scored WHERE score > 0 ORDER BY scored.score DESC, row_id LIMIT 25""")
def top_rows(spark, sf_dir):
    return sc.top_rows(sc.score_rows(fx.geo(spark, sf_dir), GEO_FDS), 25)


TOP = CELLS + """, cells AS (
  SELECT row_id, 'nationkey' AS "column", nationkey AS value, v_key AS score FROM viol
  UNION ALL SELECT row_id, 'nation_name', nation_name, v_nation FROM viol
  UNION ALL SELECT row_id, 'region_name', region_name, v_region FROM viol
  UNION ALL SELECT row_id, 'segment', segment, 0.0 FROM viol),
top AS (SELECT * FROM cells ORDER BY score DESC, row_id, "column" LIMIT {k})"""


@query("explain_topk", TOP.format(k=20) + " SELECT * FROM top")
def explain_topk(spark, sf_dir):
    frame = fx.geo(spark, sf_dir)
    return sc.explain(frame, sc.fd_cell_scores(frame, GEO_FDS), 20)


@query("annotate_reason", TOP.format(k=40) + """
SELECT *, CASE WHEN "column" IN ('nationkey', 'region_name') THEN 'violates a constraint'
               ELSE 'rare value (no governing constraint)' END AS reason FROM top""")
def annotate_reason(spark, sf_dir):
    frame = fx.geo(spark, sf_dir)
    cells = sc.explain(frame, sc.fd_cell_scores(frame, GEO_FDS), 40)
    return sc.annotate(cells, [GEO_FDS[2]])


@query("heatmap_counts", CELLS + """
SELECT c AS "column", CAST(n AS BIGINT) AS cells, CAST(r AS BIGINT) AS "rows" FROM (
  SELECT count(*) FILTER (v_key > 0.7) AS k, count(*) FILTER (v_nation > 0.7) AS n1, count(*) FILTER (v_region > 0.7) AS n2,
         count(*) FILTER (greatest(v_key, v_nation, v_region) > 0.7) AS r FROM viol) t,
  LATERAL (VALUES ('nationkey', k), ('nation_name', n1), ('region_name', n2), ('segment', 0), ('(all)', k + n1 + n2)) AS u(c, n)""")
def heatmap_counts(spark, sf_dir):
    frame = fx.geo(spark, sf_dir)
    return sc.heat_counts(sc.fd_cell_scores(frame, GEO_FDS), frame.columns)


@query("clean_rows", CELLS + """
SELECT row_id, nationkey, nation_name, region_name, segment FROM viol WHERE greatest(v_key, v_nation, v_region) <= 0.7""")
def clean_rows(spark, sf_dir):
    frame = fx.geo(spark, sf_dir)
    return sc.clean_rows(frame, sc.fd_cell_scores(frame, GEO_FDS))


@query("rule_catalog", """
SELECT * FROM (VALUES
 (CAST(1 AS INTEGER), 'composite-DC', '(p_brand, p_type) -> grade', 'not-exists (t1, t2): t1.p_brand = t2.p_brand and t1.p_type = t2.p_type and t1.grade != t2.grade', CAST(2 AS INTEGER), CAST(0.95 AS DOUBLE), 'learned', true),
 (CAST(0 AS INTEGER), 'FD', 'p_type -> p_brand', 'not-exists (t1, t2): t1.p_type = t2.p_type and t1.p_brand != t2.p_brand', CAST(1 AS INTEGER), CAST(1 AS DOUBLE), 'expert', true))
 AS t(ord, kind, rule, denial, arity, confidence, source, enabled)
WHERE (SELECT count(*) FROM part) > 0""")
def rule_catalog(spark, sf_dir):
    from tenetdq.operators.fd import mine
    learned = [Rule(FunctionalDependency(r.lhs, r.rhs, 0.95)) for r in mine(fx.graded(spark, sf_dir))]
    rules = [expert_fd(["p_type"], "p_brand"), *learned, Rule(FunctionalDependency(("grade",), "p_type"), enabled=False)]
    return report_order(rules_frame(spark, [r for r in rules if active([r])])).drop("lhs", "rhs")


def rank_sql(value: str, source: str, over: str = "") -> str:
    """SQL text: average rank / n of ``value``."""
    part = f"PARTITION BY {over} " if over else ""
    return (f"(rank() OVER ({part}ORDER BY {value}) + (count(*) OVER ({part.rstrip() + ', ' if over else 'PARTITION BY '}{value}) - 1) / 2.0::DOUBLE)"
            f" / count(*) OVER ({part.rstrip()})")


@query("rank01", "SELECT o_orderkey AS row_id, " + rank_sql("o_totalprice", "orders") + " AS price, "
       + rank_sql("o_custkey", "orders") + " AS cust, 0.0::DOUBLE AS flat FROM orders")
def rank01(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    wide = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"),
                    F.col("o_custkey").cast("double").alias("cust"), F.lit(3.0).alias("flat"))
    return rank_columns(wide, ["price", "cust", "flat"])


def numeric_surprise_sql(source: str, column: str) -> str:
    """SQL text: value-level robust z, then its rank over the rows."""
    return f"""dev_{column} AS (SELECT row_id, abs({column} - (SELECT median({column}) FROM {source})) AS d FROM {source}),
z_{column} AS (SELECT row_id, d / ((SELECT median(d) FROM dev_{column}) + 1e-9) AS z FROM dev_{column}),
s_{column} AS (SELECT row_id, {rank_sql('z', 'z')} AS s FROM z_{column})"""


def text_surprise_sql(source: str, column: str) -> str:
    """SQL text: largest rank of rarity, length z and digit-share z."""
    return f"""m_{column} AS (SELECT row_id, 1.0::DOUBLE - CAST(count(*) OVER (PARTITION BY {column}) AS DOUBLE) / count(*) OVER () AS rarity,
   CAST(length({column}) AS DOUBLE) AS len,
   CAST(length(regexp_replace({column}, '[^0-9]', '', 'g')) AS DOUBLE) / (length({column}) + 1) AS dig FROM {source}),
d_{column} AS (SELECT row_id, rarity, abs(len - (SELECT median(len) FROM m_{column})) AS dl,
   abs(dig - (SELECT median(dig) FROM m_{column})) AS dd FROM m_{column}),
z_{column} AS (SELECT row_id, rarity, dl / ((SELECT median(dl) FROM d_{column}) + 1e-9) AS zl,
   dd / ((SELECT median(dd) FROM d_{column}) + 1e-9) AS zd FROM d_{column}),
s_{column} AS (SELECT row_id, greatest({rank_sql('rarity', '')}, {rank_sql('zl', '')}, {rank_sql('zd', '')}) AS s FROM z_{column})"""


@query("marginal_numeric", """WITH li AS (SELECT l_quantity AS row_id, l_quantity FROM lineitem), """
       + numeric_surprise_sql("li", "l_quantity")
       + " SELECT CAST(row_id AS BIGINT) AS value, count(*) AS n, max(s) AS surprise FROM s_l_quantity GROUP BY 1")
def marginal_numeric(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("row_id"), "l_quantity")
    cells = marginal_cells(from_df(li, "row_id", ["l_quantity"]))
    return cells.select(F.col("value").cast("double").cast("long").alias("value"), "n", "surprise")


CUST_TEXT = ["c_name", "c_mktsegment"]


@query("marginal_categorical", "WITH cust AS (SELECT c_custkey AS row_id, c_name, c_mktsegment FROM customer), "
       + ", ".join(text_surprise_sql("cust", c) for c in CUST_TEXT)
       + " SELECT row_id, a.s AS c_name, b.s AS c_mktsegment FROM s_c_name a JOIN s_c_mktsegment b USING (row_id)")
def marginal_categorical(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    frame = from_df(c.select(F.col("c_custkey").alias("row_id"), *CUST_TEXT), "row_id")
    return MarginalSurprise().score(frame)


def zero_if_flat(value: str) -> str:
    """SQL text: rank of ``value``, or 0 when it is the same everywhere."""
    return f"CASE WHEN min({value}) OVER () = max({value}) OVER () THEN 0.0::DOUBLE ELSE {rank_sql(value, '')} END"


ROUTED = CELLS + ", " + text_surprise_sql("geo", "segment") + f"""
SELECT row_id, {zero_if_flat('v_key')} AS nationkey, {zero_if_flat('v_nation')} AS nation_name,
       {zero_if_flat('v_region')} AS region_name, s AS segment FROM viol JOIN s_segment USING (row_id)"""


@query("routed_score", ROUTED)
def routed_score(spark, sf_dir):
    frame = fx.geo(spark, sf_dir)
    return RoutedLearner().fit(frame).score(frame)


@query("analyze_top_violations", "WITH routed AS (" + ROUTED + """), cells AS (
  SELECT row_id, 'nationkey' AS "column", nationkey AS score FROM routed
  UNION ALL SELECT row_id, 'nation_name', nation_name FROM routed
  UNION ALL SELECT row_id, 'region_name', region_name FROM routed
  UNION ALL SELECT row_id, 'segment', segment FROM routed),
geo2 AS (SELECT c_custkey AS row_id, CAST(c_nationkey AS VARCHAR) AS nationkey,
    CASE WHEN c_custkey % 97 = 0 THEN 'WRONG' ELSE n_name END AS nation_name,
    CASE WHEN c_custkey % 89 = 0 THEN 'WRONG' ELSE r_name END AS region_name, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT row_id, "column", CASE "column" WHEN 'nationkey' THEN nationkey WHEN 'nation_name' THEN nation_name
          WHEN 'region_name' THEN region_name ELSE segment END AS value, score,
       CASE WHEN "column" = 'segment' THEN 'rare value (no governing constraint)' ELSE 'violates a constraint' END AS reason
FROM cells JOIN geo2 USING (row_id) ORDER BY score DESC, row_id, "column" LIMIT 15""")
def analyze_top_violations(spark, sf_dir):
    return analyze(fx.geo(spark, sf_dir)).top_violations(15)


@query("ensemble_score", CELLS + f"""
SELECT row_id, (2 * {zero_if_flat('v_key')}) / 2 AS nationkey, (2 * {zero_if_flat('v_nation')}) / 2 AS nation_name,
       (2 * {zero_if_flat('v_region')}) / 2 AS region_name, 0.0::DOUBLE AS segment FROM viol""")
def ensemble_score(spark, sf_dir):
    frame = fx.geo(spark, sf_dir)
    return EnsembleLearner([FdLearner(max_lhs=1), FdLearner(max_lhs=2)]).fit(frame).score(frame)
