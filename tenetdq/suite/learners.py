"""Order, linear and gated learners, and detection quality."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tenetdq.operators import evaluate as ev
from tenetdq.operators import linear as ln
from tenetdq.operators import order as od
from tenetdq.operators import repair as rp
from tenetdq.operators.gated import GatedLearner
from tenetdq.operators.monitors import order_constraint
from tenetdq.operators.routed import FdLearner, RoutedLearner
from tenetdq.plans.constraints import rules_frame
from tenetdq.suite import fixtures as fx
from tenetdq.suite.registry import query
from tenetdq.suite.scores import CELLS, rank_sql, text_surprise_sql

SIX = 6      # decimals compared where floating-point sums depend on their order

TAU = fx.ORDERED + """, cells AS (
  SELECT 'ctx' AS context, ctx AS g, x, y, CAST(count(*) AS DOUBLE) AS n FROM ordered GROUP BY ALL
  UNION ALL SELECT '', '', x, y, CAST(count(*) AS DOUBLE) FROM ordered GROUP BY x, y),
pairs AS (SELECT a.context, a.g, sum(CASE WHEN a.y < b.y THEN a.n * b.n ELSE 0 END) AS p, sum(CASE WHEN a.y > b.y THEN a.n * b.n ELSE 0 END) AS q
  FROM cells a JOIN cells b ON a.context = b.context AND a.g = b.g AND a.x < b.x GROUP BY ALL),
tx AS (SELECT context, g, sum(n) AS total, sum(n * (n - 1) / 2) AS t FROM (SELECT context, g, x, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY ALL),
ty AS (SELECT context, g, sum(n * (n - 1) / 2) AS t FROM (SELECT context, g, y, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY ALL),
taus AS (SELECT context, g, total, (p - q) / sqrt((total * (total - 1) / 2 - tx.t) * (total * (total - 1) / 2 - ty.t)) AS tau
  FROM pairs JOIN tx USING (context, g) JOIN ty USING (context, g))"""


@query("kendall_tau", f"WITH {TAU} SELECT g AS \"group\", CAST(total AS BIGINT) AS \"rows\", round(tau, {SIX}) AS tau FROM taus")
def kendall_tau(spark, sf_dir):
    frame = fx.ordered(spark, sf_dir)
    taus = od.group_taus(frame.weighted(["ctx", "x", "y"]), [("x", "y")], ["ctx"])
    return taus.select(F.coalesce("group", F.lit("")).alias("group"), "rows", F.round("tau", SIX).alias("tau"))


@query("kendall_tau_orders", f"WITH {fx.PRICED}" + """,
pairs AS (SELECT sum(CASE WHEN a.noisy < b.noisy THEN 1 WHEN a.noisy > b.noisy THEN -1 ELSE 0 END) AS s
  FROM priced a JOIN priced b ON a.price < b.price),
free AS (SELECT sum(n) AS n, sum(CASE WHEN c = 'x' THEN n * (n - 1) // 2 END) AS tx, sum(CASE WHEN c = 'y' THEN n * (n - 1) // 2 END) AS ty
  FROM (SELECT 'x' AS c, count(*) AS n FROM priced GROUP BY price UNION ALL SELECT 'y', count(*) FROM priced GROUP BY noisy)),
total AS (SELECT count(*) AS t, count(DISTINCT price) AS xs, count(DISTINCT noisy) AS ys FROM priced)
SELECT xs AS distinct_x, ys AS distinct_y, t AS "rows",
  round(CAST(s AS DOUBLE) / sqrt(CAST(t * (t - 1) // 2 - tx AS DOUBLE)) / sqrt(CAST(t * (t - 1) // 2 - ty AS DOUBLE)), 6) AS tau FROM pairs, free, total""")
def kendall_tau_orders(spark, sf_dir):
    frame = fx.priced(spark, sf_dir)
    taus = od.group_taus(frame.weighted(["price", "noisy"]), [("price", "noisy")], [])
    values = frame.df.agg(F.count_distinct("price").alias("distinct_x"), F.count_distinct("noisy").alias("distinct_y"))
    return values.crossJoin(taus.select("rows", F.round("tau", SIX).alias("tau")))      # one row each


COND = "cond AS (SELECT context, round(sum(tau * total) / sum(total), 6) AS tau FROM taus WHERE context = '' OR total >= 30 GROUP BY context)"


@query("conditional_tau", f"WITH {TAU}, {COND} SELECT context, tau FROM cond")
def conditional_tau(spark, sf_dir):
    frame = fx.ordered(spark, sf_dir)
    taus = od.context_taus(od.group_taus(frame.weighted(["ctx", "x", "y"]), [("x", "y")], ["ctx"]), 30)
    return taus.select(F.coalesce("context", F.lit("")).alias("context"), F.round("tau", SIX).alias("tau"))


@query("mine_order", f"WITH {TAU}, {COND}, pick AS (SELECT arg_max(context, abs(tau)) AS context, arg_max(tau, abs(tau)) AS tau FROM cond)" + """,
spread AS (SELECT avg(d) AS d FROM (SELECT count(DISTINCT x) AS d FROM ordered, pick GROUP BY CASE WHEN context = '' THEN '' ELSE ctx END)),
func AS (SELECT CAST(sum(m) AS DOUBLE) / sum(s) AS c FROM (SELECT max(n) AS m, sum(n) AS s FROM (SELECT x, y, count(*) AS n FROM ordered GROUP BY ALL) GROUP BY x))
SELECT 'not-exists (t1, t2): ' || CASE WHEN context = '' THEN '' ELSE 't1.ctx = t2.ctx and ' END || 't1.x > t2.x and t1.y '
       || CASE WHEN tau > 0 THEN '<' ELSE '>' END || ' t2.y' AS rule, round((abs(tau) + 1) / 2, 4) AS confidence
FROM pick, spread, func WHERE abs(tau) >= 0.6 AND d >= 5 AND c < 0.95""")
def mine_order(spark, sf_dir):
    return rules_frame(spark, od.OrderLearner().fit(fx.ordered(spark, sf_dir)).rules()).select("rule", "confidence")


# least-squares monotone fit by its min-max formula over the distinct x of each type
ISO = fx.ORDERED + """, pts AS (SELECT ctx, x, avg(y) AS y, CAST(count(*) AS DOUBLE) AS w FROM ordered GROUP BY ALL),
cum AS (SELECT ctx, x, w, sum(w) OVER o AS cw, sum(w * y) OVER o AS cs, w * y AS s FROM pts WINDOW o AS (PARTITION BY ctx ORDER BY x)),
spans AS (SELECT j.ctx, j.x AS xj, k.x AS xk, (k.cs - j.cs + j.s) / (k.cw - j.cw + j.w) AS mean FROM cum j JOIN cum k ON j.ctx = k.ctx AND j.x <= k.x),
low AS (SELECT i.ctx, i.x, s.xj, min(s.mean) AS m FROM pts i JOIN spans s ON s.ctx = i.ctx AND s.xj <= i.x AND s.xk >= i.x GROUP BY ALL),
fits AS (SELECT ctx, x, max(m) AS fit FROM low GROUP BY ctx, x),
res AS (SELECT row_id, ctx, x, y, fit, abs(y - fit) AS resid FROM ordered JOIN fits USING (ctx, x)),
med AS (SELECT ctx, median(round(resid, 12)) AS med FROM res GROUP BY ctx)"""


@query("isotonic_residual", f"""WITH {ISO} SELECT ctx, CAST(CAST(x AS BIGINT) AS VARCHAR) AS xt, CAST(CAST(y AS BIGINT) AS VARCHAR) AS yt,
  count(*) AS n, round(max(fit), {SIX}) AS fit, round(max(resid), {SIX}) AS resid FROM res GROUP BY ctx, x, y""")
def isotonic_residual(spark, sf_dir):
    spec = od.OrderSpec("x", "y", "ctx", True, 0.98)
    cells = od.order_cells(fx.ordered(spark, sf_dir).weighted(["ctx", "x", "y"]), spec)
    return cells.select("ctx", "xt", "yt", "n", F.round("fit", SIX).alias("fit"), F.round("resid", SIX).alias("resid"))


@query("isotonic_orders", f"""WITH {fx.PRICED}, pts AS (SELECT cust AS x, avg(CAST(grown AS DOUBLE)) AS y, CAST(count(*) AS DOUBLE) AS w FROM priced GROUP BY cust),
cum AS (SELECT x, y, w, sum(w) OVER o AS cw, sum(w * y) OVER o AS cs FROM pts WINDOW o AS (ORDER BY x)),
means AS (SELECT j.x AS xj, k.x AS xk, (k.cs - j.cs + j.w * j.y) / (k.cw - j.cw + j.w) AS mean FROM cum j JOIN cum k ON j.x <= k.x),
low AS (SELECT xj, xk, min(mean) OVER (PARTITION BY xj ORDER BY xk DESC) AS m FROM means),
fits AS (SELECT xk AS x, max(m) AS fit FROM low GROUP BY xk)
SELECT CAST(cust AS VARCHAR) AS xt, CAST(grown AS VARCHAR) AS yt, count(*) AS n, round(max(fit), 4) AS fit, round(max(abs(grown - fit)), 4) AS resid
FROM priced JOIN fits ON cust = x GROUP BY cust, grown""")
def isotonic_orders(spark, sf_dir):
    spec = od.OrderSpec("cust", "grown", None, True, 0.9)
    cells = od.order_cells(fx.priced(spark, sf_dir).weighted(["cust", "grown"]), spec)
    return cells.select("xt", "yt", "n", F.round("fit", 4).alias("fit"), F.round("resid", 4).alias("resid"))


@query("order_repair", f"""WITH {ISO} SELECT row_id, 'y' AS "column", CAST(CAST(y AS BIGINT) AS VARCHAR) AS old, round(fit, {SIX}) AS fixed, 'order' AS kind
FROM res JOIN med USING (ctx) WHERE resid > 3 * (med + 1e-9)""")
def order_repair(spark, sf_dir):
    edits = rp.order_edits(fx.ordered(spark, sf_dir), order_constraint("x", "y", "ctx", True, 0.98))
    return edits.select("row_id", "column", "old", F.round(F.col("new").cast("double"), SIX).alias("fixed"), "kind")


def _summed_values(spark, sf_dir):
    return ln.numeric_tuples(fx.summed(spark, sf_dir), ["x", "y0", "z"])


STD = "WITH " + fx.SUMMED + """, med AS (SELECT median(x) AS mx, median(y0) AS my, median(z) AS mz FROM summed),
mad AS (SELECT median(abs(x - mx)) * 1.4826 + 1e-9 AS sx, median(abs(y0 - my)) * 1.4826 + 1e-9 AS sy, median(abs(z - mz)) * 1.4826 + 1e-9 AS sz FROM summed, med),
zs AS (SELECT row_id, (x - mx) / sx AS x, (y0 - my) / sy AS y, (z - mz) / sz AS z FROM summed, med, mad),
cl AS (SELECT greatest(-4.0, least(4.0, x)) AS x, greatest(-4.0, least(4.0, y)) AS y, greatest(-4.0, least(4.0, z)) AS z FROM zs)"""


@query("standardize", STD + f"""
SELECT c AS "column", m AS median, round(s, {SIX}) AS scale FROM med, mad, LATERAL (VALUES ('x', mx, sx), ('y0', my, sy), ('z', mz, sz)) AS u(c, m, s)""")
def standardize(spark, sf_dir):
    scales = ln.standardization(_summed_values(spark, sf_dir), ["x", "y0", "z"], small=True)
    return spark.createDataFrame([(c, m, round(s, SIX)) for c, (m, s) in scales.items()],
                                 "column string, median double, scale double")


@query("winsor_covariance", STD + f"""
SELECT a AS "left", b AS "right", round(v, {SIX}) AS cov FROM (SELECT covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz,
  covar_samp(y, y) AS yy, covar_samp(y, z) AS yz, covar_samp(z, z) AS zz FROM cl) t,
  LATERAL (VALUES ('x', 'x', xx), ('x', 'y0', xy), ('x', 'z', xz), ('y0', 'y0', yy), ('y0', 'z', yz), ('z', 'z', zz)) AS u(a, b, v)""")
def winsor_covariance(spark, sf_dir):
    values, cols = _summed_values(spark, sf_dir), ["x", "y0", "z"]
    scales = ln.standardization(values, cols, small=True)
    cov = ln.covariance(ln.moments(values, [ln.clip(ln.standardized(F.col(c), *scales[c]), 4.0) for c in cols]))
    return spark.createDataFrame([(a, b, round(float(cov[i, j]), SIX)) for i, a in enumerate(cols)
                                  for j, b in enumerate(cols) if i <= j], "left string, right string, cov double")


@query("linear_fit", STD + """, w AS (SELECT mx + sx * c.x AS x, my + sy * c.y AS y, mz + sz * c.z AS z FROM cl c, med, mad),
s AS (SELECT covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz,
        avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM w),
b AS (SELECT (xz * yy - yz * xy) / (xx * yy - xy * xy) AS bx, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS bk, ax, ay, az FROM s),
c AS (SELECT bx, bk, az - bx * ax - bk * ay AS b0 FROM b),
r AS (SELECT z - bx * x - bk * y0 - b0 AS r FROM summed, c), m AS (SELECT median(r) AS m FROM r),
t AS (SELECT median(abs(r - m)) * 1.4826 AS tol FROM r, m)
SELECT u."column", coef, round(b0, 3) + 0.0 AS "offset", round(tol, 4) AS tolerance FROM c, t,
  LATERAL (VALUES ('z', 1.0::DOUBLE), ('x', round(-bx, 3)), ('y0', round(-bk, 3))) AS u("column", coef)""")
def linear_fit(spark, sf_dir):
    rule = ln.LinearLearner().fit(fx.summed(spark, sf_dir)).rules()[0]
    return spark.createDataFrame([(c, v, rule.offset, rule.tolerance) for c, v in rule.coefficients],
                                 "column string, coef double, offset double, tolerance double")


@query("linear_score", STD + f""", p AS (SELECT row_id, (-0.5 * x - 0.25 * y) + 0.75 * z AS p FROM zs), k AS (SELECT median(p * p) AS k FROM p),
v AS (SELECT row_id, round(abs(p), 12) / (sqrt(k) + 1e-9) AS v FROM p, k)
SELECT row_id, {rank_sql('v', '')} AS x, {rank_sql('v', '')} AS y0, {rank_sql('v', '')} AS z FROM v""")
def linear_score(spark, sf_dir):
    frame, cols = fx.summed(spark, sf_dir), ["x", "y0", "z"]
    values, a = _summed_values(spark, sf_dir), np.array([-0.5, -0.25, 0.75])
    scales = ln.standardization(values, cols, small=True)
    z = [ln.standardized(F.col(c), *scales[c]) for c in cols]
    clean = ln.medians(values, ["k"], [F.pow(ln.dot(a, z), 2)], small=True)["k"]
    return ln.LinearLearner(cols=cols, scales=scales, dirs=[(a, clean)]).score(frame)


@query("routed_score_order", "WITH " + ISO + """, raw AS (SELECT row_id, ctx, CAST(CAST(x AS BIGINT) AS VARCHAR) AS xt, x, round(resid, 12) / (med + 1e-9) AS r FROM res JOIN med USING (ctx)), """
       + text_surprise_sql("raw", "ctx") + f"""
SELECT row_id, s_ctx.s AS ctx, {rank_sql('r', '')} AS y FROM raw JOIN s_ctx USING (row_id)""")
def routed_score_order(spark, sf_dir):
    frame = fx.ordered(spark, sf_dir)
    scores = RoutedLearner().fit(frame).score(frame)
    return scores.select("row_id", "ctx", "y")


@query("routed_score_linear")
def routed_score_linear(spark, sf_dir):
    frame = fx.summed(spark, sf_dir)
    return RoutedLearner().fit(frame).score(frame)


@query("gated_score")
def gated_score(spark, sf_dir):
    frame = fx.geo(spark, sf_dir)
    return GatedLearner().fit(frame).score(frame)


# -- detection quality -------------------------------------------------------
@query("error_mask", f"WITH {fx.GEO}, {fx.GEO_CLEAN}" + """
SELECT row_id, 'nationkey' AS "column", d.nationkey <> c.nationkey AS error FROM geo d JOIN geo_clean c USING (row_id)
UNION ALL SELECT row_id, 'nation_name', d.nation_name <> c.nation_name FROM geo d JOIN geo_clean c USING (row_id)
UNION ALL SELECT row_id, 'region_name', d.region_name <> c.region_name FROM geo d JOIN geo_clean c USING (row_id)
UNION ALL SELECT row_id, 'segment', d.segment <> c.segment FROM geo d JOIN geo_clean c USING (row_id)""")
def error_mask(spark, sf_dir):
    dirty, clean = fx.geo(spark, sf_dir), fx.geo(spark, sf_dir, planted=False)
    return ev.mask_cells(ev.error_mask(dirty, clean), dirty.columns)


def curve_sql(source: str, score: str, label: str) -> str:
    """SQL text: AUROC by rank sum and step-wise average precision."""
    return f"""(SELECT (sum(CASE WHEN {label} THEN rk ELSE 0 END) - p * (p + 1) / 2) / (p * (t - p)) FROM (
   SELECT {label}, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS rk,
     CAST(count(*) FILTER ({label}) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () AS DOUBLE) AS t FROM {source}) GROUP BY p, t) AS auroc,
 (SELECT sum(pos * tp / allp) / max(tp) FROM (SELECT pos, CAST(sum(pos) OVER (ORDER BY {score} DESC) AS DOUBLE) AS tp, sum(n) OVER (ORDER BY {score} DESC) AS allp
   FROM (SELECT {score}, count(*) AS n, count(*) FILTER ({label}) AS pos FROM {source} GROUP BY {score}))) AS auprc"""


LABELLED = """WITH l AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality = 1 AS error FROM documents JOIN labels USING (doc_id))"""


@query("auroc", LABELLED + " SELECT CAST(count(*) AS BIGINT) AS n, round(any_value(auroc), 9) AS auroc FROM l, (SELECT " + curve_sql("l", "score", "error") + ")")
def auroc(spark, sf_dir):
    return _label_curves(spark, sf_dir).select("n", F.round("auroc", 9).alias("auroc"))


@query("average_precision", LABELLED + " SELECT CAST(count(*) AS BIGINT) AS n, round(any_value(auprc), 9) AS auprc FROM l, (SELECT " + curve_sql("l", "score", "error") + ")")
def average_precision(spark, sf_dir):
    return _label_curves(spark, sf_dir).select("n", F.round("auprc", 9).alias("auprc"))


def _label_curves(spark, sf_dir):
    docs, labels = fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels")
    both = docs.select("doc_id", "n_chars").join(labels, "doc_id").select(
        F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("error"))
    return ev.curve_metrics(ev.score_histogram(both, "cell"))


@query("evaluate_detection", CELLS + ", " + fx.GEO_CLEAN + """,
duo AS (SELECT v.*, v.nationkey <> c.nationkey AS e1, v.nation_name <> c.nation_name AS e2, v.region_name <> c.region_name AS e3, v.segment <> c.segment AS e4
  FROM viol v JOIN geo_clean c USING (row_id)),
cell AS (SELECT v_key AS score, e1 AS error FROM duo UNION ALL SELECT v_nation, e2 FROM duo UNION ALL SELECT v_region, e3 FROM duo UNION ALL SELECT 0.0, e4 FROM duo),
tup AS (SELECT greatest(v_key, v_nation, v_region) AS score, e1 OR e2 OR e3 OR e4 AS error FROM duo)
SELECT 'geo' AS dataset, (SELECT count(*) FROM tup) AS n, CAST(4 AS INTEGER) AS d, (SELECT avg(CAST(error AS INTEGER)) FROM cell) AS error_rate,
  round(c.auroc, 9) AS cell_auroc, round(c.auprc, 9) AS cell_auprc, round(t.auroc, 9) AS tuple_auroc, round(t.auprc, 9) AS tuple_auprc
FROM (SELECT """ + curve_sql("cell", "score", "error") + ") c, (SELECT " + curve_sql("tup", "score", "error") + ") t")
def evaluate_detection(spark, sf_dir):
    pairs = {"geo": (fx.geo(spark, sf_dir, planted=False), fx.geo(spark, sf_dir))}
    got = ev.evaluate_all(pairs, lambda: FdLearner(max_lhs=1))
    return got.select("dataset", "n", "d", "error_rate", *[
        F.round(c, 9).alias(c) for c in ("cell_auroc", "cell_auprc", "tuple_auroc", "tuple_auprc")])
