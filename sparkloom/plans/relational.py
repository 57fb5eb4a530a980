"""Queries over the relational tables: scans, joins, summaries, sets, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.catalog import query
from sparkloom.operators.relational import asof_join, either_end, latest, range_join, recovered, top_per_group
from sparkloom.plans.overlay import DOCS_SQL, documents, table


@query(
    "scan_filter_project",
    """SELECT l_orderkey, l_partkey, l_quantity, round(l_extendedprice * (1 - l_discount), 6) AS revenue FROM lineitem
    WHERE l_quantity > 45 AND l_returnflag = 'R'""",
)
def scan_filter_project(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 45 AND l_returnflag = 'R'")
    return li.select("l_orderkey", "l_partkey", "l_quantity", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("revenue"))


@query(
    "join_inner",
    """SELECT n_name, r_name, count(*) AS n_suppliers, round(sum(s_acctbal), 4) AS balance FROM supplier
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def join_inner(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n_suppliers"), F.round(F.sum("s_acctbal"), 4).alias("balance"))


@query(
    "join_left",
    """SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 4) AS total FROM customer
    LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
)
def join_left(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'F'")
    o = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return c.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 4).alias("total"))


@query("join_right", "SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, d):
    s, n = table(spark, d, "supplier").where("s_acctbal > 5000"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("n_name", "s_suppkey")


@query(
    "join_full",
    """SELECT coalesce(a.k, b.k) AS nationkey, a.n_customers, b.n_suppliers FROM
    (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""",
)
def join_full(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nationkey", "full")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 250000)")
def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice < 250000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("join_cross", "SELECT a.r_name AS left_region, b.r_name AS right_region FROM region a CROSS JOIN region b")
def join_cross(spark, d):
    r = table(spark, d, "region")  # fixed at five rows by the schema
    return r.select(F.col("r_name").alias("left_region")).crossJoin(F.broadcast(r.select(F.col("r_name").alias("right_region"))))


_BANDS = [(0, 900.0, 920.0, "low"), (1, 920.0, 970.0, "middle"), (2, 970.0, 1000.0, "high")]


@query(
    "join_range",
    """WITH bands(band_id, lo, hi, band) AS (VALUES (0, 900.0, 920.0, 'low'), (1, 920.0, 970.0, 'middle'), (2, 970.0, 1000.0, 'high'))
    SELECT band, count(*) AS n_parts, round(avg(p_retailprice), 4) AS mean_price FROM part JOIN bands ON p_retailprice >= lo AND p_retailprice < hi GROUP BY band""",
)
def join_range(spark, d):
    bands = spark.createDataFrame(_BANDS, "band_id int, lo double, hi double, band string")
    j = range_join(table(spark, d, "part"), bands, "p_retailprice", "lo", "hi", 25.0)
    return j.groupBy("band").agg(F.count("*").alias("n_parts"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


@query(
    "join_asof",
    """WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
    v AS (SELECT user_id, ts AS view_ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
    SELECT p.event_id, p.user_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.view_ts""",
)
def join_asof(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id"))
    return asof_join(left, right, ["user_id"], "ts", "view_ts", "view_id").select("event_id", "user_id", "view_id")


@query(
    "edge_or_join_union",
    """WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    f AS (SELECT DISTINCT c_custkey AS node FROM customer WHERE c_custkey % 20 = 0)
    SELECT node, count(*) AS n_edges, count(DISTINCT CASE WHEN src = node THEN dst ELSE src END) AS n_neighbours FROM (
      SELECT f.node, e.src, e.dst FROM f JOIN e ON e.src = f.node UNION ALL SELECT f.node, e.src, e.dst FROM f JOIN e ON e.dst = f.node) GROUP BY node""",
)
def edge_or_join_union(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    edges = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    frontier = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("node"))
    j = either_end(edges, "src", "dst").join(frontier, "node")
    return j.groupBy("node").agg(F.count("*").alias("n_edges"), F.countDistinct("other").alias("n_neighbours"))


@query("set_union", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("set_except", "SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def set_except(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey")).subtract(table(spark, d, "customer").where("c_acctbal > 9900").select("c_nationkey"))


@query(
    "acl_subset",
    f"WITH {DOCS_SQL} SELECT doc_id, len(list_filter(acl, lambda x: NOT list_contains(['group:a', 'group:c'], x))) = 0 AS allowed FROM docs",
)
def acl_subset(spark, d):
    parent = F.array(F.lit("group:a"), F.lit("group:c"))
    return documents(spark, d).select("doc_id", (F.size(F.array_except("acl", parent)) == 0).alias("allowed"))


@query("counter_by_label", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def counter_by_label(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_LABELS = "SELECT event_type, user_id % 3 AS shard, count(*) AS n FROM events GROUP BY "


def _labels(spark, d):
    return table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("shard"))


@query("rollup_labels", _LABELS + "ROLLUP (event_type, shard)")
def rollup_labels(spark, d):
    return _labels(spark, d).rollup("event_type", "shard").agg(F.count("*").alias("n"))


@query("cube_labels", _LABELS + "CUBE (event_type, shard)")
def cube_labels(spark, d):
    return _labels(spark, d).cube("event_type", "shard").agg(F.count("*").alias("n"))


@query("grouping_sets_labels", _LABELS + "GROUPING SETS ((event_type), (shard), ())")
def grouping_sets_labels(spark, d):
    x = _labels(spark, d)
    return x.groupingSets([["event_type"], ["shard"], []], "event_type", "shard").agg(F.count("*").alias("n"))


_EDGES = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]


@query(
    "histogram_buckets",
    "SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, unnest([" + ", ".join(map(str, _EDGES)) + "]) AS t(le) GROUP BY event_type, le",
)
def histogram_buckets(spark, d):
    e = table(spark, d, "events")
    edges = F.array(*[F.lit(x) for x in _EDGES])
    sums = e.groupBy("event_type").agg(*[F.sum((F.col("value") <= x).cast("long")).alias(f"b{i}") for i, x in enumerate(_EDGES)])
    rows = sums.select("event_type", F.explode(F.arrays_zip(edges.alias("le"), F.array(*[F.col(f"b{i}") for i in range(len(_EDGES))]).alias("n"))).alias("b"))
    return rows.select("event_type", F.col("b.le").alias("le"), F.col("b.n").alias("n"))


@query("approx_distinct_users")
def approx_distinct_users(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("n_users"))


@query(
    "topk_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3",
)
def topk_per_group(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_per_group(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)


@query("global_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def global_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "window_frames",
    """SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three,
    ntile(4) OVER w AS quarter, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS status_rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def window_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("last_three"),
        F.ntile(4).over(w).cast("long").alias("quarter"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")).cast("long").alias("status_rank"),
    )


@query(
    "latest_upsert",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def latest_upsert(spark, d):
    return latest(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("delete_source_anti", "SELECT doc_id, source FROM documents WHERE NOT (source IN ('src1', 'src2') AND lang = 'en')")
def delete_source_anti(spark, d):
    gone = spark.createDataFrame([("en", "src1"), ("en", "src2")], "lang string, source string")
    return table(spark, d, "documents").join(F.broadcast(gone), ["lang", "source"], "left_anti").select("doc_id", "source")


@query(
    "constraint_violations",
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT (o_totalprice BETWEEN 1000 AND 450000) THEN 'price_range' END,
      CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN length(o_orderpriority) > 10 THEN 'priority_length' END], lambda x: x IS NOT NULL), ',') AS codes
    FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 450000) OR o_orderstatus NOT IN ('F', 'O') OR length(o_orderpriority) > 10""",
)
def constraint_violations(spark, d):
    checks = {"price_range": F.col("o_totalprice").between(1000, 450000), "status": F.col("o_orderstatus").isin("F", "O"), "priority_length": F.length("o_orderpriority") <= 10}
    bad = recovered(table(spark, d, "orders"), checks).where(F.size("violations") > 0)
    return bad.select("o_orderkey", F.array_join("violations", ",").alias("codes"))
