"""Monitors, gates, contracts, repair and schema normalization."""
from __future__ import annotations

from pyspark.sql import functions as F

from tenetdq.operators import contract as ct
from tenetdq.operators import decompose as dn
from tenetdq.operators import monitors as mo
from tenetdq.operators import repair as rp
from tenetdq.operators.fd import learn_simple
from tenetdq.operators.scoring import fd_cell_scores
from tenetdq.plans.algebra import RelationSpec
from tenetdq.plans.constraints import DenialConstraint, FunctionalDependency, LinearConstraint, Predicate, denial_of
from tenetdq.plans.frame import Frame, from_df
from tenetdq.session import scratch_path
from tenetdq.suite import fixtures as fx
from tenetdq.suite.registry import query
from tenetdq.suite.scores import CELLS, GEO_FDS, SUM_RULE

ORDER_RULE = mo.order_constraint("x", "y", "ctx", True, 0.98)
NAME_FD = GEO_FDS[1]

# text forms of the numeric fixtures (their frames hold strings)
ORDERED_TEXT = "row_id, ctx, CAST(CAST(x AS BIGINT) AS VARCHAR) AS x, CAST(CAST(y AS BIGINT) AS VARCHAR) AS y"
SUMMED_TEXT = ("row_id, CAST(CAST(x AS BIGINT) AS VARCHAR) AS x, CAST(CAST(y0 AS BIGINT) AS VARCHAR) AS y0, "
               "CAST(CAST(z AS BIGINT) AS VARCHAR) AS z")


@query("fd_monitor", "WITH " + fx.GEO + """
SELECT nationkey, count(DISTINCT nation_name) AS n_distinct FROM geo GROUP BY nationkey HAVING count(DISTINCT nation_name) > 1""")
def fd_monitor(spark, sf_dir):
    return mo.fd_monitor(fx.geo(spark, sf_dir).df, NAME_FD)


@query("fd_monitor_orders", """
SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, count(DISTINCT o_orderpriority) AS n_distinct
FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""")
def fd_monitor_orders(spark, sf_dir):
    from tenetdq.plans.frame import from_df
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return mo.fd_monitor(from_df(o, "o_orderkey").df, FunctionalDependency(("o_custkey",), "o_orderpriority"))


@query("fd_row_check", "WITH " + fx.CHAIN + """, g AS (SELECT suppkey FROM chain GROUP BY suppkey HAVING count(DISTINCT nationkey) > 1)
SELECT 'suppkey -> nationkey' AS rule, count(*) = 0 AS ok, count(*) AS bad_groups FROM g""")
def fd_row_check(spark, sf_dir):
    return mo.fd_holds(fx.chain(spark, sf_dir).df, FunctionalDependency(("suppkey",), "nationkey"))


@query("approx_fd_monitor", "WITH " + fx.GEO + """,
c AS (SELECT nationkey, nation_name, count(*) AS n FROM geo GROUP BY ALL),
m AS (SELECT nationkey, nation_name AS expected FROM (
  SELECT *, row_number() OVER (PARTITION BY nationkey ORDER BY n DESC, nation_name) AS rn FROM c) WHERE rn = 1)
SELECT geo.*, expected FROM geo JOIN m USING (nationkey) WHERE nation_name <> expected""")
def approx_fd_monitor(spark, sf_dir):
    return mo.fd_deviations(fx.geo(spark, sf_dir), NAME_FD)


@query("linear_monitor", "WITH " + fx.SUMMED + f"""
SELECT {SUMMED_TEXT}, z - x - y0 AS residual FROM summed WHERE abs(z - x - y0) > 0.5""")
def linear_monitor(spark, sf_dir):
    return mo.linear_monitor(fx.summed(spark, sf_dir), SUM_RULE)


@query("exact_sum_check", "WITH " + fx.SUMMED + f"""
SELECT {SUMMED_TEXT}, x + y0 - 50 AS residual FROM summed WHERE x + y0 <> 50""")
def exact_sum_check(spark, sf_dir):
    return mo.exact_sum_monitor(fx.summed(spark, sf_dir), ["x", "y0"], 50.0)


ORDER_HITS = """hits AS (SELECT * FROM {a} AS a WHERE EXISTS (
  SELECT 1 FROM {b} AS b WHERE b.ctx = a.ctx AND a.x > b.x AND a.y < b.y))"""


@query("order_dc_monitor", "WITH " + fx.ORDERED + ", " + ORDER_HITS.format(a="ordered", b="ordered")
       + f" SELECT {ORDERED_TEXT} FROM hits")
def order_dc_monitor(spark, sf_dir):
    return mo.dc_monitor(fx.ordered(spark, sf_dir), ORDER_RULE)


@query("order_dc_monitor_orders", """
WITH o AS (SELECT o_orderkey AS row_id, o_custkey, epoch_ms(o_orderdate) // 1000 AS day, o_totalprice AS price FROM orders),
best AS (SELECT o_custkey, day, max(max(price)) OVER (PARTITION BY o_custkey ORDER BY day
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o GROUP BY o_custkey, day)
SELECT row_id FROM o JOIN best USING (o_custkey, day) WHERE top > price""")
def order_dc_monitor_orders(spark, sf_dir):
    from tenetdq.plans.frame import from_df
    o = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("day"),
        F.col("o_totalprice").alias("price"))
    return mo.dc_monitor(from_df(o, "o_orderkey"), mo.order_constraint("day", "price", "o_custkey")).select("row_id")


@query("generic_dc_monitor", "WITH " + fx.GEO + """
SELECT * FROM geo a WHERE EXISTS (SELECT 1 FROM geo b WHERE a.nationkey = b.nationkey AND a.nation_name <> b.nation_name)""")
def generic_dc_monitor(spark, sf_dir):
    return mo.dc_monitor(fx.geo(spark, sf_dir), denial_of(NAME_FD))


@query("generic_dc_cross", "WITH " + fx.SUMMED + f"""
SELECT {SUMMED_TEXT} FROM summed a WHERE EXISTS (SELECT 1 FROM summed b WHERE a.x <= b.y0 AND a.z >= b.z AND a.y0 = b.x)""")
def generic_dc_cross(spark, sf_dir):
    dc = DenialConstraint((Predicate("y0", "=", "x"), Predicate("x", "<=", "y0"), Predicate("z", ">=", "z")))
    return mo.dc_monitor(fx.summed(spark, sf_dir), dc)


@query("generic_dc_three", """WITH cust AS (SELECT c_custkey AS row_id, c_acctbal AS balance, c_nationkey AS nation, length(c_mktsegment) AS size FROM customer)
SELECT row_id, CAST(nation AS VARCHAR) AS nation, CAST(size AS VARCHAR) AS size FROM cust a
WHERE EXISTS (SELECT 1 FROM cust b WHERE a.balance < b.balance AND a.nation > b.nation AND a.size >= b.size)""")
def generic_dc_three(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    frame = from_df(c.select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"),
                             F.length("c_mktsegment").alias("size")), "row_id")
    dc = DenialConstraint((Predicate("balance", "<", "balance"), Predicate("nation", ">", "nation"), Predicate("size", ">=", "size")))
    return mo.dc_monitor(frame, dc).select("row_id", "nation", "size")


@query("generic_dc_four", """WITH line AS (SELECT o_orderkey AS row_id, o_totalprice AS price, o_custkey AS cust, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day,
  o_orderstatus AS status FROM orders)
SELECT row_id, CAST(cust AS VARCHAR) AS cust, status FROM line a WHERE EXISTS (SELECT 1 FROM line b
  WHERE a.price > b.price + 400000 AND a.cust < b.cust AND a.day >= b.day AND a.status <> b.status)""")
def generic_dc_four(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    frame = from_df(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), (F.col("o_totalprice") + 400000).alias("far"),
                             F.col("o_custkey").alias("cust"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01")).alias("day"),
                             F.col("o_orderstatus").alias("status")), "row_id")
    dc = DenialConstraint((Predicate("price", ">", "far"), Predicate("cust", "<", "cust"), Predicate("day", ">=", "day"),
                           Predicate("status", "!=", "status")))
    return mo.dc_monitor(frame, dc).select("row_id", "cust", "status")


@query("key_uniqueness", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS n_rows
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def key_uniqueness(spark, sf_dir):
    from tenetdq.functions.values import value_view
    li = fx.table(spark, sf_dir, "lineitem")
    return mo.duplicate_keys(value_view(li, ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])


@query("type_check", "WITH " + fx.GEO + """
SELECT 'nationkey' AS "column", true AS present, count(*) FILTER (nationkey <> '' AND try_cast(nationkey AS DOUBLE) IS NULL) AS bad FROM geo
UNION ALL SELECT 'nation_name', true, count(*) FILTER (nation_name <> '' AND try_cast(nation_name AS DOUBLE) IS NULL) FROM geo
UNION ALL SELECT 'segment', true, 0 FROM (SELECT count(*) FROM geo)
UNION ALL SELECT 'balance', false, -1 FROM (SELECT count(*) FROM geo)""")
def type_check(spark, sf_dir):
    return mo.type_check(fx.geo(spark, sf_dir), {"nationkey": "number", "nation_name": "number",
                                                 "segment": "string", "balance": "number"})


@query("gate_batch", "WITH " + fx.ORDERED + ", " + fx.ORDERED_CLEAN + """,
judged AS (SELECT *, 2 * x - y < -140 OR 2 * x - y > 10 AS lin,
   EXISTS (SELECT 1 FROM ordered_clean b WHERE b.ctx = a.ctx AND a.x > b.x AND a.y < b.y) AS ord FROM ordered a)
SELECT """ + ORDERED_TEXT + """, NOT (lin OR ord) AS accepted,
  CASE WHEN lin THEN '2.00*x -1.00*y ~= -65.00  (+-75)'
       WHEN ord THEN 'not-exists (t1, t2): t1.ctx = t2.ctx and t1.x > t2.x and t1.y < t2.y' ELSE '' END AS reason FROM judged""")
def gate_batch(spark, sf_dir):
    stored = fx.ordered(spark, sf_dir, planted=False)
    band = LinearConstraint((("x", 2.0), ("y", -1.0)), -65.0, 75.0)
    return mo.gate(fx.ordered(spark, sf_dir), stored, [band, ORDER_RULE])


def _geo_contract(spark):
    return ct.freeze(spark, "geo", [GEO_FDS[1], GEO_FDS[2]], [["nationkey"]])


def _majority_sql(source: str, lhs: str, rhs: str) -> str:
    return (f"(SELECT CAST(sum(s - m) AS BIGINT) FROM (SELECT sum(n) AS s, max(n) AS m FROM (SELECT {lhs}, {rhs}, "
            f"count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {lhs}))")


def _check(spark, frame, contract, kind):
    got = ct.check_frame(spark, ct.check(frame, contract, order_counts=True))
    return got.where(F.col("kind") == kind).select("id", "violations", "ok")


@query("contract_check_key", "WITH " + fx.GEO + ", t AS (SELECT "
       + " + ".join(_majority_sql("geo", "nationkey", c) for c in ["nation_name", "region_name", "segment"])
       + " AS v) SELECT 'key(nationkey)' AS id, v AS violations, v = 0 AS ok FROM t")
def contract_check_key(spark, sf_dir):
    return _check(spark, fx.geo(spark, sf_dir), _geo_contract(spark), "key")


@query("contract_check_fd", "WITH " + fx.GEO + ", t AS (SELECT 'fd(nationkey -> nation_name)' AS id, "
       + _majority_sql("geo", "nationkey", "nation_name") + " AS violations UNION ALL SELECT 'fd(nationkey -> region_name)', "
       + _majority_sql("geo", "nationkey", "region_name") + ") SELECT *, violations = 0 AS ok FROM t")
def contract_check_fd(spark, sf_dir):
    return _check(spark, fx.geo(spark, sf_dir), _geo_contract(spark), "fd")


@query("contract_check_linear", "WITH " + fx.SUMMED + """, t AS (
SELECT 'linear(x, y0, z)' AS id, count(*) FILTER (abs(z - x - y0) > 0.5 + 1e-9) AS violations FROM summed)
SELECT *, violations = 0 AS ok FROM t""")
def contract_check_linear(spark, sf_dir):
    return _check(spark, fx.summed(spark, sf_dir), ct.freeze(spark, "summed", [SUM_RULE]), "linear")


@query("contract_check_order", "WITH " + fx.ORDERED + ", " + ORDER_HITS.format(a="ordered", b="ordered") + """
SELECT 'order(ctx = ctx, x > x, y < y)' AS id, CAST(0 AS BIGINT) AS violations, count(*) AS monitored, true AS ok FROM hits""")
def contract_check_order(spark, sf_dir):
    results = ct.check(fx.ordered(spark, sf_dir), ct.freeze(spark, "ordered", [ORDER_RULE]), order_counts=True)
    return ct.check_frame(spark, results).select("id", "violations", "monitored", "ok")


def _broken_sql(source: str, lhs: str, rhs: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {lhs} FROM {source} GROUP BY {lhs} HAVING count(DISTINCT {rhs}) > 1))"


@query("contract_unevaluable", "WITH " + fx.GEO + """, t AS (SELECT """ + _majority_sql("geo", "nationkey", "nation_name") + " AS v, "
       + _broken_sql("geo", "nationkey", "nation_name") + """ AS g)
SELECT u.* FROM t, LATERAL (VALUES ('fd(nationkey -> nation_name)', v, NULL, g, v = 0), ('linear()', -1, 'incomplete record', NULL, false),
  ('order()', -1, 'incomplete record', NULL, false), ('key()', -1, 'incomplete record', NULL, false), ('fd(gone)', -1, 'missing column', NULL, false),
  ('order(?)', -1, 'unknown operator', NULL, false), ('view', -1, 'unknown kind', NULL, false)) AS u(id, violations, reason, "groups", ok)""")
def contract_unevaluable(spark, sf_dir):
    """Records that cannot be evaluated stand beside one that can."""
    good = ct.freeze(spark, "geo", [GEO_FDS[1]])
    rows = [("linear()", "linear", None, None, None, None, {}, 0.0, 1.0, None), ("order()", "order", None, None, None, None, None, None, None, []),
            ("key()", "key", [], None, None, None, None, None, None, None), ("fd(gone)", "fd", None, ["nationkey"], "gone", 1.0, None, None, None, None),
            ("order(?)", "order", None, None, None, None, None, None, None, [("nationkey", "~", "nationkey")]),
            ("view", "view", None, None, None, None, None, None, None, None)]
    bad = spark.createDataFrame([(ct.VERSION, "geo", 10 + i, *r) for i, r in enumerate(rows)], ct.CONTRACT_SCHEMA)
    found = ct.check(fx.geo(spark, sf_dir), good.unionByName(bad), order_counts=True)
    return ct.check_frame(spark, found).select("id", "violations", "reason", "groups", "ok")


@query("contract_summary", "WITH " + fx.GEO + ", v AS (SELECT "
       + _majority_sql("geo", "nationkey", "nation_name") + " AS a, " + _majority_sql("geo", "nationkey", "region_name") + " AS b, "
       + _majority_sql("geo", "nationkey", "segment") + """ AS c)
SELECT CAST((a = 0)::INT + (b = 0)::INT + (a + b + c = 0)::INT AS BIGINT) AS satisfied, CAST(4 AS BIGINT) AS total,
       CAST(a + b + (a + b + c) AS BIGINT) AS violations, true AS failed FROM v""")
def contract_summary(spark, sf_dir):
    contract = ct.freeze(spark, "geo", [GEO_FDS[1], GEO_FDS[2], FunctionalDependency(("nationkey",), "gone")],
                         [["nationkey"]])
    results = ct.check(fx.geo(spark, sf_dir), contract)
    return ct.check_summary(ct.check_frame(spark, results), fail_on_violations=True)


@query("contract_roundtrip", "WITH " + fx.GEO + ", " + """
t AS (SELECT count(*) AS n FROM geo)
SELECT id, kind, "columns", rhs, confidence FROM t, LATERAL (VALUES
  ('key(nation_name)', 'key', 'nation_name', NULL, NULL),
  ('key(nationkey)', 'key', 'nationkey', NULL, NULL),
  ('fd(nation_name -> nationkey)', 'fd', NULL, 'nationkey', (SELECT round(CAST(sum(m) AS DOUBLE) / n, 4) FROM (SELECT max(k) AS m FROM (SELECT nation_name, nationkey, count(*) AS k FROM geo GROUP BY ALL) GROUP BY nation_name))),
  ('fd(nationkey -> nation_name)', 'fd', NULL, 'nation_name', (SELECT round(CAST(sum(m) AS DOUBLE) / n, 4) FROM (SELECT max(k) AS m FROM (SELECT nation_name, nationkey, count(*) AS k FROM geo GROUP BY ALL) GROUP BY nationkey))),
  ('fd(nationkey -> region_name)', 'fd', NULL, 'region_name', (SELECT round(CAST(sum(m) AS DOUBLE) / n, 4) FROM (SELECT max(k) AS m FROM (SELECT region_name, nationkey, count(*) AS k FROM geo GROUP BY ALL) GROUP BY nationkey)))
) AS u(id, kind, "columns", rhs, confidence)""")
def contract_roundtrip(spark, sf_dir):
    fds = learn_simple(fx.geo(spark, sf_dir))
    contract = ct.freeze(spark, "geo", fds, dn.Schema(fds).keys)
    path = scratch_path(spark, "contract")
    ct.dump(contract, path)
    return ct.load(spark, path).select("id", "kind", F.array_join("columns", ", ").alias("columns"), "rhs", "confidence")


# -- repair ------------------------------------------------------------------
KINDS = {"nationkey": "numeric", "nation_name": "categorical", "region_name": "categorical", "segment": "categorical"}
REPAIR_FDS = [GEO_FDS[1], GEO_FDS[2]]


def _fd_edit_sql(lhs: str, rhs: str, rule: str, confidence: float, ord_: int) -> str:
    return f"""SELECT row_id, '{rhs}' AS "column", {rhs} AS old, mode AS "new", '{rule}' AS rule, 'FD' AS kind,
  {confidence}::DOUBLE AS confidence, CAST({ord_} AS INTEGER) AS ord
FROM geo JOIN (SELECT {lhs}, arg_min({rhs}, (-n, {rhs})) AS mode, sum(n) AS size, max(n) AS top FROM (
  SELECT {lhs}, {rhs}, count(*) AS n FROM geo GROUP BY ALL) GROUP BY {lhs}) USING ({lhs})
JOIN (SELECT {rhs}, count(*) AS freq FROM geo GROUP BY ALL) USING ({rhs})
WHERE {rhs} <> mode AND size >= 5 AND top > 0.5 * size AND freq < 0.05 * (SELECT count(*) FROM geo)"""


EDITS = "WITH " + fx.GEO + ", edits AS (" + " UNION ALL ".join(
    _fd_edit_sql(fd.lhs[0], fd.rhs, str(fd), fd.confidence, i) for i, fd in enumerate(REPAIR_FDS)) + ")"
FIXED = """, fixed AS (SELECT row_id, nationkey, coalesce(n."new", nation_name) AS nation_name,
   coalesce(r."new", region_name) AS region_name, segment FROM geo
   LEFT JOIN (SELECT row_id, "new" FROM edits WHERE "column" = 'nation_name') n USING (row_id)
   LEFT JOIN (SELECT row_id, "new" FROM edits WHERE "column" = 'region_name') r USING (row_id))"""


@query("fd_repair", EDITS + " SELECT * FROM edits")
def fd_repair(spark, sf_dir):
    return rp.propose(fx.geo(spark, sf_dir), REPAIR_FDS, kinds=KINDS)


@query("repair_apply", EDITS + FIXED + " SELECT * FROM fixed")
def repair_apply(spark, sf_dir):
    return rp.repair_table(fx.geo(spark, sf_dir), REPAIR_FDS, kinds=KINDS).repaired.df


@query("repair_by_column", EDITS + """ SELECT "column", count(*) AS edits FROM edits GROUP BY 1""")
def repair_by_column(spark, sf_dir):
    return rp.repair_table(fx.geo(spark, sf_dir), REPAIR_FDS, kinds=KINDS).by_column


@query("repair_undo", "WITH " + fx.GEO + " SELECT * FROM geo")
def repair_undo(spark, sf_dir):
    done = rp.repair_table(fx.geo(spark, sf_dir), REPAIR_FDS, kinds=KINDS)
    return rp.undo(done.repaired, done.edits).df


@query("linear_repair", "WITH " + fx.SUMMED + """
SELECT row_id, 'z' AS "column", CAST(CAST(z AS BIGINT) AS VARCHAR) AS old, CAST(CAST(x + y0 AS BIGINT) AS VARCHAR) AS "new",
       '1.00*z -1.00*x -1.00*y0 ~= +0.00  (+-0.5)' AS rule, 'linear' AS kind, 0.98::DOUBLE AS confidence
FROM summed WHERE abs(z - x - y0) > 0.5""")
def linear_repair(spark, sf_dir):
    return rp.linear_edits(fx.summed(spark, sf_dir), SUM_RULE)


# -- normalization -----------------------------------------------------------
def _relations_sql(parts: list[tuple[str, list[str], list[str]]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{', '.join(sorted(a))}' AS attributes, '{', '.join(k)}' AS \"key\", count(*) AS \"rows\" "
        f"FROM (SELECT DISTINCT {', '.join(a)} FROM chain)" for n, a, k in parts)


def _chain_schema(spark, sf_dir):
    frame = fx.chain(spark, sf_dir)
    return frame, dn.Schema(learn_simple(frame))


@query("bcnf_relations", "WITH " + fx.CHAIN + " " + _relations_sql([
    ("R1", ["nationkey", "region_name"], ["nationkey"]), ("R2", ["nationkey", "suppkey"], ["suppkey"])]))
def bcnf_relations(spark, sf_dir):
    frame, schema = _chain_schema(spark, sf_dir)
    return dn.relations_frame(spark, dn.materialize(frame.df, schema.relations_bcnf), schema.relations_bcnf)


@query("third_nf_relations", "WITH " + fx.CHAIN + " " + _relations_sql([
    ("R1", ["nationkey", "suppkey"], ["suppkey"]), ("R2", ["nationkey", "region_name"], ["nationkey"])]))
def third_nf_relations(spark, sf_dir):
    frame, schema = _chain_schema(spark, sf_dir)
    return dn.relations_frame(spark, dn.materialize(frame.df, schema.relations_3nf), schema.relations_3nf)


@query("lossless_reconstruction", "WITH " + fx.CHAIN + """,
o AS (SELECT DISTINCT nationkey, region_name, suppkey FROM chain),
r AS (SELECT DISTINCT * FROM (SELECT DISTINCT nationkey, region_name FROM chain) NATURAL JOIN (SELECT DISTINCT nationkey, suppkey FROM chain))
SELECT (SELECT count(*) FROM o) AS original, (SELECT count(*) FROM r) AS rebuilt,
  (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT nationkey, region_name, suppkey FROM r)) AS lost,
  (SELECT count(*) FROM (SELECT nationkey, region_name, suppkey FROM r EXCEPT SELECT * FROM o)) AS spurious""")
def lossless_reconstruction(spark, sf_dir):
    frame, schema = _chain_schema(spark, sf_dir)
    return dn.lossless(frame.df, dn.materialize(frame.df, schema.relations_bcnf))


@query("lossy_relations", "WITH " + fx.CHAIN + """,
o AS (SELECT DISTINCT nationkey, returnflag, suppkey FROM chain),
r AS (SELECT DISTINCT * FROM (SELECT DISTINCT returnflag, nationkey FROM chain) NATURAL JOIN (SELECT DISTINCT returnflag, suppkey FROM chain))
SELECT (SELECT count(*) FROM o) AS original, (SELECT count(*) FROM r) AS rebuilt, CAST(0 AS BIGINT) AS lost,
  (SELECT count(*) FROM (SELECT nationkey, returnflag, suppkey FROM r EXCEPT SELECT * FROM o)) AS spurious""")
def lossy_relations(spark, sf_dir):
    frame = fx.chain(spark, sf_dir)
    given = dn.explicit_relations([("flags", ["returnflag", "nationkey"], ["nationkey"]),
                                   ("stock", ["returnflag", "suppkey"], ["suppkey"])])
    return dn.lossless(frame.df, dn.materialize(frame.df, given))


@query("relation_links", "WITH " + fx.CHAIN + """
SELECT 'R1' AS "left", 'R2' AS "right", 'nationkey' AS shared, CAST(0 AS BIGINT) AS orphans_left, CAST(0 AS BIGINT) AS orphans_right
FROM (SELECT count(*) FROM chain)""")
def relation_links(spark, sf_dir):
    frame, schema = _chain_schema(spark, sf_dir)
    tables = dn.materialize(frame.df, schema.relations_bcnf)
    return dn.check_links(tables, dn.links(schema.relations_bcnf))


@query("cross_relation_monitor", "WITH " + fx.CHAIN + """, o AS (SELECT DISTINCT suppkey, region_name FROM chain)
SELECT suppkey, region_name FROM o a WHERE EXISTS (SELECT 1 FROM o b WHERE a.region_name = b.region_name
   AND CAST(a.suppkey AS BIGINT) > CAST(b.suppkey AS BIGINT))""")
def cross_relation_monitor(spark, sf_dir):
    """Suppliers that are not the first of their region: the two attributes live in different relations."""
    frame, schema = _chain_schema(spark, sf_dir)
    tables = dn.materialize(frame.df, schema.relations_bcnf)
    rule = DenialConstraint((Predicate("region_name", "=", "region_name"), Predicate("suppkey", ">", "suppkey")))
    return mo.dc_monitor(dn.cross_relation_rows(tables, rule.attributes), rule).drop("row_id")


@query("candidate_key_check", "WITH " + fx.CHAIN + """
SELECT 'suppkey' AS "key", 'lower than 3NF' AS normal_form, CAST(sum(extra) AS BIGINT) AS disagreeing FROM (
  SELECT count(DISTINCT nationkey) + count(DISTINCT region_name) - 2 AS extra FROM chain GROUP BY suppkey)""")
def candidate_key_check(spark, sf_dir):
    frame, schema = _chain_schema(spark, sf_dir)
    keys = ct.freeze(spark, "chain", [], schema.keys)
    cols = Frame(frame.df.select("row_id", *schema.attributes), schema.attributes)
    rows = [(", ".join(sorted(k)), schema.normal_form, r.violations)
            for k, r in zip(schema.keys, ct.check(cols, keys))]
    return spark.createDataFrame(rows, "key string, normal_form string, disagreeing long")


@query("key_dedup_load", "WITH " + fx.GEO + """
SELECT nationkey, arg_min(nation_name, row_id) AS nation_name, arg_min(region_name, row_id) AS region_name FROM geo GROUP BY nationkey""")
def key_dedup_load(spark, sf_dir):
    rel = RelationSpec("R1", frozenset(["nationkey", "nation_name", "region_name"]), frozenset(["nationkey"]))
    return dn.first_per_key(fx.geo(spark, sf_dir).df, rel)


@query("relation_sink", CELLS + """, kept AS (SELECT * FROM viol WHERE greatest(v_key, v_nation, v_region) <= 0.7)
SELECT 'nations' AS name, count(*) AS "rows" FROM (SELECT DISTINCT nationkey, nation_name, region_name FROM kept)
UNION ALL SELECT 'segments', count(*) FROM (SELECT DISTINCT nationkey, segment FROM kept)""")
def relation_sink(spark, sf_dir):
    from tenetdq.operators.scoring import clean_rows
    from tenetdq.sources.writers import write_relations
    frame = fx.geo(spark, sf_dir)
    kept = clean_rows(frame, fd_cell_scores(frame, GEO_FDS))
    given = dn.explicit_relations([("nations", ["nationkey", "nation_name", "region_name"], ["nationkey"]),
                                   ("segments", ["nationkey", "segment"], ["nationkey", "segment"])])
    paths = write_relations(dn.materialize(kept, given), scratch_path(spark, "relations"))
    parts = [spark.read.parquet(p).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("model_sink", "WITH " + fx.CHAIN + """, f AS (
  SELECT (SELECT CAST(sum(m) AS DOUBLE) / sum(s) FROM (SELECT max(n) AS m, sum(n) AS s FROM (SELECT nationkey, region_name, count(*) AS n FROM chain GROUP BY ALL) GROUP BY nationkey)) AS a,
         (SELECT CAST(sum(m) AS DOUBLE) / sum(s) FROM (SELECT max(n) AS m, sum(n) AS s FROM (SELECT suppkey, nationkey, count(*) AS n FROM chain GROUP BY ALL) GROUP BY suppkey)) AS b)
SELECT 'rule' AS part, 'nationkey -> region_name' AS said, round(a, 4) AS confidence, (SELECT count(DISTINCT nationkey) FROM chain) AS "groups" FROM f
UNION ALL SELECT 'rule', 'suppkey -> nationkey', round(b, 4), (SELECT count(DISTINCT suppkey) FROM chain) FROM f
UNION ALL SELECT 'key', 'suppkey (lower than 3NF)', NULL, (SELECT count(DISTINCT suppkey) FROM chain)
UNION ALL SELECT form, 'nationkey, region_name by nationkey', NULL, (SELECT count(*) FROM (SELECT DISTINCT nationkey, region_name FROM chain)) FROM (VALUES ('3NF'), ('BCNF')) AS v(form)
UNION ALL SELECT form, 'nationkey, suppkey by suppkey', NULL, (SELECT count(*) FROM (SELECT DISTINCT nationkey, suppkey FROM chain)) FROM (VALUES ('3NF'), ('BCNF')) AS v(form)""")
def model_sink(spark, sf_dir):
    """A model written whole and read back; each part with the number of rows it has in the data."""
    from tenetdq.operators.report import Model
    from tenetdq.sources.writers import read_model, write_model
    frame = fx.chain(spark, sf_dir)
    rules = learn_simple(frame)
    path = scratch_path(spark, "model")
    write_model(Model(frame, None, rules, dn.Schema(rules), frame.df), path)
    stored = read_model(spark, path)

    def size(columns):
        return frame.df.select(*columns).distinct().count()

    out = [("rule", r["rule"], r["confidence"], size(r["lhs"])) for r in stored["rules"].collect()]
    out += [("key", f"{', '.join(r['key'])} ({r['normal_form']})", None, size(r["key"])) for r in stored["keys"].collect()]
    out += [(r["form"], f"{', '.join(r['attributes'])} by {', '.join(r['key'])}", None, size(r["attributes"]))
            for r in stored["relations"].collect()]
    return spark.createDataFrame(out, "part string, said string, confidence double, `groups` long")


@query("quality_metrics", CELLS + """, n AS (SELECT count(*) AS n,
   count(*) FILTER (v_key > 0.7) + count(*) FILTER (v_nation > 0.7) + count(*) FILTER (v_region > 0.7) AS flagged,
   count(DISTINCT nation_name || '|' || nationkey) * 2 AS c1, count(DISTINCT nationkey || '|' || region_name || '|' || nation_name) * 3 AS c3 FROM viol)
SELECT n AS "rows", CAST(4 AS BIGINT) AS "columns", CAST(flagged AS BIGINT) AS flagged_cells, 1 - CAST(flagged AS DOUBLE) / (n * 4) AS conformance,
   'BCNF' AS normal_form, CAST(2 AS BIGINT) AS candidate_keys, CAST(1 AS BIGINT) AS relations,
   greatest(0.0::DOUBLE, 1 - CAST(c3 AS DOUBLE) / (n * 3)) AS redundancy, CAST(n * 3 AS BIGINT) AS flat_cells, CAST(c3 AS BIGINT) AS norm_cells FROM n""")
def quality_metrics(spark, sf_dir):
    frame = fx.geo(spark, sf_dir)
    return dn.quality_metrics(frame, dn.Schema(GEO_FDS), fd_cell_scores(frame, GEO_FDS))


@query("quality_metrics_chain", "WITH " + fx.CHAIN + """, n AS (SELECT count(*) AS n, count(DISTINCT suppkey) * 2 + count(DISTINCT nationkey) * 2 AS c FROM chain)
SELECT n AS "rows", CAST(4 AS BIGINT) AS "columns", CAST(0 AS BIGINT) AS flagged_cells, 1.0::DOUBLE AS conformance, 'lower than 3NF' AS normal_form,
  CAST(1 AS BIGINT) AS candidate_keys, CAST(2 AS BIGINT) AS relations, 1 - CAST(c AS DOUBLE) / (n * 3) AS redundancy,
  CAST(n * 3 AS BIGINT) AS flat_cells, CAST(c AS BIGINT) AS norm_cells FROM n""")
def quality_metrics_chain(spark, sf_dir):
    frame, schema = _chain_schema(spark, sf_dir)
    return dn.quality_metrics(frame, schema)
