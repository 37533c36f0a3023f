"""Queries of sources, joins, aggregates, windows, sets and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions.scratch import scratch_path
from quayside.jobs.registry import query
from quayside.operators import aggregates as A
from quayside.operators import features as X
from quayside.operators import joins as J
from quayside.operators import windows as W
from quayside.operators.enrichment import add_rank, add_row_number
from quayside.sources import files as S


@query("src1_read_files", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    path = scratch_path(t.spark, "csv")
    t.nation.select("n_nationkey", "n_name").write.option("header", True).option("delimiter", "|").csv(path)
    return S.read_files(t.spark, path, "csv", "n_nationkey int, n_name string", header=True, delimiter="|")


@query("src2_read_partitioned", "SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders WHERE year(o_orderdate) > 1996")
def _(t):
    path = scratch_path(t.spark, "parts")
    S.write_table(t.orders.select("o_orderkey", F.year("o_orderdate").alias("y")), path, partition_by=["y"])
    return S.read_partitioned(t.spark, path, "y", "1996").select("o_orderkey", "y")


@query("src9_read_incremental", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01' - INTERVAL 3 DAY")
def _(t):
    return S.read_incremental(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1997-06-01", "3 days")


@query("src12_overwrite_partitions", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(t):
    path, o = scratch_path(t.spark, "dyn"), t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    S.overwrite_partitions(o, path, ["o_orderstatus"])
    S.overwrite_partitions(o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2), path, ["o_orderstatus"])
    return t.spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("src14_write_clustered", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 200")
def _(t):
    path = scratch_path(t.spark, "clustered")
    S.write_clustered(t.orders.select("o_orderkey", "o_custkey"), path, ["o_custkey"], 8)
    return t.spark.read.parquet(path).where("o_custkey BETWEEN 100 AND 200")


@query("src15_align_schema", "SELECT NULL::VARCHAR AS n_code, n_name, n_nationkey::BIGINT AS n_nationkey, n_regionkey FROM nation")
def _(t):
    target = t.spark.range(0).selectExpr("cast(null AS string) AS n_code", "'' AS n_name", "1L AS n_nationkey").schema
    return S.align_schema(t.nation.select("n_nationkey", "n_name", "n_regionkey"), target)


@query("src16_schema_drift", "SELECT 'added' AS change, 'n_new' AS \"column\", NULL::VARCHAR AS from_type, 'string' AS to_type UNION ALL SELECT 'removed', 'n_regionkey', 'int', NULL UNION ALL SELECT 'retyped', 'n_nationkey', 'int', 'bigint'")
def _(t):
    return S.schema_drift(t.nation, t.nation.select(F.col("n_nationkey").cast("bigint"), "n_name", F.col("n_name").alias("n_new")))


@query("src17_ingestion_watermark", "SELECT o_orderstatus AS source, max_by(o_orderkey::VARCHAR, {'t': o_orderdate, 'v': o_orderkey::VARCHAR}) AS watermark_value FROM orders GROUP BY 1")
def _(t):
    marks = t.orders.select(F.lit("i").alias("ingestor"), F.col("o_orderstatus").alias("source"), F.lit("prod").alias("env"), F.col("o_orderkey").cast("string").alias("watermark_value"), F.lit("id").alias("watermark_type"), F.col("o_orderdate").alias("last_updated"))
    return S.latest_watermark(marks).select("source", "watermark_value")


@query("jon1_perform_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    n = J.perform_lookup(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"], ["n_name", "n_regionkey"])
    return J.perform_lookup(n.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, ["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("jon2_join_many", "SELECT c_custkey, o.n AS orders_n, l.n AS late_n FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) n FROM orders WHERE year(o_orderdate) > 1996 GROUP BY 1) l ON l.o_custkey = c_custkey")
def _(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    n = lambda df: df.groupBy("c_custkey").agg(F.count("*").alias("n"))
    return J.join_many(t.customer.select("c_custkey"), {"orders": n(o), "late": n(o.where("year(o_orderdate) > 1996"))}, ["c_custkey"])


@query("jon3_asof_join", "SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _(t):
    e = t.events
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("value").alias("last_value"))
    return J.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "click_ts", ["last_value"]).select("event_id", "last_value")


@query("jon4_resolve_foreign_keys", "SELECT o_orderkey, coalesce(n_nationkey + 1000, -1)::BIGINT AS nation_sk FROM orders LEFT JOIN nation ON o_custkey % 30 = n_nationkey")
def _(t):
    dim = t.nation.select(F.col("n_nationkey").cast("bigint").alias("nk"), (F.col("n_nationkey") + 1000).cast("bigint").alias("sk"))
    return J.resolve_foreign_keys(t.orders.select("o_orderkey", (F.col("o_custkey") % 30).alias("bk")), dim, "bk", "nk", "sk", "nation_sk").select("o_orderkey", "nation_sk")


@query("jon4_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey % 30 NOT IN (SELECT n_nationkey FROM nation)")
def _(t):
    return J.orphans(t.orders.select("o_orderkey", (F.col("o_custkey") % 30).alias("bk")), t.nation.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey")), "bk", "n_nationkey").select("o_orderkey")


@query("jon5_ranking_features", "WITH pop AS (SELECT l_partkey AS p, count(*) n FROM lineitem GROUP BY 1), c AS (SELECT c_custkey AS u, c_acctbal, (c_custkey * 31 + j * 17) % (SELECT count(*) FROM part) + 1 AS p FROM customer, range(20) r(j)) SELECT u, p, round(c_acctbal * p_retailprice, 3) AS affinity, coalesce(n, 0) AS popularity, round(ln(1 + coalesce(n, 0)), 6) AS log_popularity FROM c LEFT JOIN part ON p_partkey = p LEFT JOIN pop USING (p)")
def _(t):
    """All customers, each with twenty parts, some of which nobody ordered."""
    inter = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p"))
    users = t.customer.select(F.col("c_custkey").alias("u"), "c_acctbal")
    items = t.part.select(F.col("p_partkey").alias("p"), "p_retailprice")
    made = users.crossJoin(F.broadcast(t.part.agg(F.count("*").alias("k")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(19))))
    cand = made.select("u", ((F.col("u") * 31 + F.col("j") * 17) % F.col("k") + 1).alias("p"))
    out = J.ranking_features(cand, users, items, inter, "u", "p", "c_acctbal", "p_retailprice")
    return out.select("u", "p", F.round("affinity", 3).alias("affinity"), "popularity", F.round("log_popularity", 6).alias("log_popularity"))


@query("jon5_ranking_features_whole", "WITH i AS (SELECT o_custkey AS u, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey), pop AS (SELECT p, count(*) n FROM i GROUP BY 1) SELECT u, p, round(c_acctbal * p_retailprice, 3) AS affinity, n AS popularity, round(ln(1 + n), 6) AS log_popularity FROM (SELECT DISTINCT u, p FROM i) LEFT JOIN customer ON c_custkey = u LEFT JOIN part ON p_partkey = p JOIN pop USING (p)")
def _(t):
    """All customers with an order, each with all parts of its orders."""
    inter = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("p"))
    users = t.customer.select(F.col("c_custkey").alias("u"), "c_acctbal")
    items = t.part.select(F.col("p_partkey").alias("p"), "p_retailprice")
    out = J.ranking_features(inter.distinct(), users, items, inter, "u", "p", "c_acctbal", "p_retailprice")
    return out.select("u", "p", F.round("affinity", 3).alias("affinity"), "popularity", F.round("log_popularity", 6).alias("log_popularity"))


@query("jon6_join_predictions_actuals", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def _(t):
    return J.join_predictions_actuals(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), ["doc_id"])


@query("agg1_aggregate_by_key", "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_avg, round(stddev_samp(l_discount), 6) AS l_discount_stddev, round(var_samp(l_discount), 8) AS l_discount_variance, count(l_tax) AS l_tax_count, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max FROM lineitem GROUP BY 1")
def _(t):
    a = A.aggregate_by_key(t.lineitem, ["l_returnflag"], {"l_quantity": ["sum", "avg"], "l_discount": ["stddev", "variance"], "l_tax": ["count", "min", "max"]})
    return a.withColumns({"l_quantity_sum": F.round("l_quantity_sum", 2), "l_quantity_avg": F.round("l_quantity_avg", 6), "l_discount_stddev": F.round("l_discount_stddev", 6), "l_discount_variance": F.round("l_discount_variance", 8)})


@query("agg2_aggregate_measures", "SELECT c_mktsegment, c_nationkey, count(DISTINCT CASE WHEN o_totalprice > 200000 THEN c_custkey END) AS big_buyers, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL")
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return A.aggregate_measures(j, ["c_mktsegment", "c_nationkey"], {"big_buyers": "count(DISTINCT CASE WHEN o_totalprice > 200000 THEN c_custkey END)", "revenue": "round(sum(o_totalprice), 2)"}, "o_orderstatus <> 'P'")


@query("agg3_pivot_table", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY 1")
def _(t):
    return A.pivot_table(t.lineitem, ["l_returnflag"], "l_linestatus", ["F", "O"], F.round(F.sum("l_quantity"), 2))


@query("agg4_rollup_aggregation", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, grouping_id(l_returnflag, l_linestatus)::BIGINT AS grouping_id FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return A.rollup_aggregation(t.lineitem, ["l_returnflag", "l_linestatus"], [F.round(F.sum("l_quantity"), 2).alias("q")])


@query("agg5_cube_aggregation", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS grouping_id FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return A.cube_aggregation(t.orders, ["o_orderstatus", "o_orderpriority"], [F.count("*").alias("n")])


@query("agg6_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def _(t):
    return A.grouping_sets(t.orders, [["o_orderstatus"], ["o_orderpriority"], []], [F.count("*").alias("n")])


@query("agg7_gold_metrics", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 4) AS avg_revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    g = A.gold_metrics(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), ["c_mktsegment"], "o_totalprice")
    return g.withColumns({"revenue": F.round("revenue", 2), "avg_revenue": F.round("avg_revenue", 4)})


@query("agg8_rfm_features", "SELECT o_custkey, min(date_diff('day', o_orderdate::DATE, DATE '1997-12-31'))::INT AS recency_days, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary, round(avg(o_totalprice), 7) AS avg_order_value, count(*) FILTER (date_diff('day', o_orderdate::DATE, DATE '1997-12-31') < 365) AS orders_365d, round(coalesce(sum(o_totalprice) FILTER (date_diff('day', o_orderdate::DATE, DATE '1997-12-31') < 365), 0), 2) AS spend_365d FROM orders WHERE o_orderdate::DATE <= DATE '1997-12-31' GROUP BY 1")
def _(t):
    r = A.rfm_features(t.orders, "o_custkey", "o_orderdate", "o_totalprice", "1997-12-31")
    return r.select("o_custkey", "recency_days", "frequency", F.round("monetary", 2).alias("monetary"), F.round("avg_order_value", 7).alias("avg_order_value"), "orders_365d", F.round("spend_365d", 2).alias("spend_365d"))


@query("agg9_reconcile_hierarchy", "WITH leaf AS (SELECT 'n' || c_nationkey AS k, c_acctbal AS v FROM customer), up AS (SELECT 'n' || n_nationkey AS k, 'r' || n_regionkey AS a FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || n_nationkey, 'world' FROM nation) SELECT a AS k, round(sum(v), 2) AS v FROM leaf JOIN up USING (k) GROUP BY 1")
def _(t):
    edges = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("c"), F.concat(F.lit("r"), "n_regionkey").alias("p")).unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("c"), F.lit("world").alias("p")))
    leaves = t.customer.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("v"))
    return A.reconcile_bottom_up(leaves, edges, "c", "p", "k", "v").withColumn("v", F.round("v", 2))


@query("agg9_reconcile_top_down", "WITH h AS (SELECT n_regionkey AS g, c_nationkey AS k, sum(c_acctbal) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT g, k, round(p / sum(p) OVER (PARTITION BY g), 6) AS share, round(1000 * (g + 1) * p / sum(p) OVER (PARTITION BY g), 4) AS total FROM h")
def _(t):
    h = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("g"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("p"))
    totals = t.region.select(F.col("r_regionkey").alias("g"), (1000.0 * (F.col("r_regionkey") + 1)).alias("total"))
    return A.reconcile_top_down(totals, h, "g", "k", "total", "p").withColumns({"share": F.round("share", 6), "total": F.round("total", 4)})


OW = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
OO = ["o_orderdate", "o_orderkey"]


@query("win1_add_row_number", f"SELECT o_orderkey, row_number() {OW})::INT AS rn FROM orders")
def _(t):
    return add_row_number(t.orders, ["o_custkey"], OO, "rn").select("o_orderkey", "rn")


@query("win2_add_rank", "SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity)::INT AS rk FROM lineitem")
def _(t):
    return add_rank(t.lineitem, ["l_orderkey"], ["l_quantity"], dense=True, name="rk").select("l_orderkey", "l_linenumber", "rk")


@query("win3_add_running_total", f"SELECT o_orderkey, round(sum(o_totalprice) {OW} ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders")
def _(t):
    return W.add_running_total(t.orders, ["o_custkey"], OO, "o_totalprice", "total").select("o_orderkey", F.round("total", 2).alias("total"))


@query("win4_add_moving_average", f"SELECT o_orderkey, round(avg(o_totalprice) {OW} ROWS 2 PRECEDING), 3) AS ma FROM orders")
def _(t):
    return W.add_moving_average(t.orders, ["o_custkey"], OO, "o_totalprice", 3, "ma").select("o_orderkey", F.round("ma", 3).alias("ma"))


@query("win5_add_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) {OW}) AS o_totalprice_lag_1, lead(o_totalprice) {OW}) AS o_totalprice_lead_1, lag(o_totalprice, 2) {OW}) AS o_totalprice_lag_2, lead(o_totalprice, 2) {OW}) AS o_totalprice_lead_2 FROM orders")
def _(t):
    return W.add_lag_lead_columns(t.orders, ["o_custkey"], OO, ["o_totalprice"], [1, 2]).select("o_orderkey", *[f"o_totalprice_{k}_{p}" for p in (1, 2) for k in ("lag", "lead")])


@query("win6_add_percentile_rank", "SELECT c_custkey, round(percent_rank() OVER w, 8) AS percent_rank, round(cume_dist() OVER w, 8) AS cume_dist FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)")
def _(t):
    return W.add_percentile_rank(t.customer, ["c_nationkey"], ["c_acctbal"]).select("c_custkey", F.round("percent_rank", 8).alias("percent_rank"), F.round("cume_dist", 8).alias("cume_dist"))


@query("win7_add_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)::INT AS q FROM customer")
def _(t):
    return W.add_ntile(t.customer, ["c_nationkey"], ["c_acctbal", "c_custkey"], 4, "q").select("c_custkey", "q")


@query("win8_rolling_window_features", f"SELECT o_orderkey, round(avg(o_totalprice) {OW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 3) AS m3, round(stddev_samp(o_totalprice) {OW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 3) AS s5, max(o_totalprice) {OW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x5 FROM orders")
def _(t):
    r = W.rolling_window_features(t.orders, ["o_custkey"], OO, "o_totalprice", [3, 5], ["mean", "std", "max"])
    return r.select("o_orderkey", F.round("o_totalprice_mean_3", 3).alias("m3"), F.round("o_totalprice_std_5", 3).alias("s5"), F.col("o_totalprice_max_5").alias("x5"))


@query("win9_velocity_features", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_24h, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 4) AS sum_24h FROM events")
def _(t):
    return W.velocity_features(t.events, "user_id", "ts", "value").select("event_id", "n_24h", F.round("sum_24h", 4).alias("sum_24h"))


@query("win10_lag_features", "WITH d AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY ALL) SELECT event_type, day, round(lag(v, 7) OVER w, 4) AS lag_7, round(avg(v) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS rolling_mean_7 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def _(t):
    d = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    return W.lag_features(d, ["event_type"], "day", "v", [7], [7]).select("event_type", "day", F.round("lag_7", 4).alias("lag_7"), F.round("rolling_mean_7", 4).alias("rolling_mean_7"))


DAILY = "d AS (SELECT l_returnflag AS s, l_shipdate::DATE AS day, sum(l_extendedprice) AS y FROM lineitem GROUP BY ALL), p AS (SELECT *, lag(y) OVER (PARTITION BY s ORDER BY day) AS yhat FROM d), fc AS (SELECT * FROM p WHERE yhat IS NOT NULL)"


def daily(t):
    """Daily revenue per return flag, forecast by the day before."""
    d = t.lineitem.groupBy(F.col("l_returnflag").alias("s"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_extendedprice").alias("y"))
    return W.add_lag_lead_columns(d, ["s"], ["day"], ["y"], [1]).where("y_lag_1 is not null").select("s", "day", "y", F.col("y_lag_1").alias("yhat"))


@query("win11_residual_anomalies", f"WITH {DAILY}, r AS (SELECT s, day, y - yhat AS e FROM fc), m AS (SELECT s, avg(e) a, stddev_samp(e) b FROM r GROUP BY s) SELECT s, day, round(e, 2) AS residual, abs(e - a) > 2 * b AS is_anomaly FROM r JOIN m USING (s)")
def _(t):
    d = daily(t)
    return W.residual_anomalies(d.select("s", "day", "yhat"), d.select("s", "day", "y"), ["s", "day"], ["s"], "yhat", "y", 2.0).select("s", "day", F.round("residual", 2).alias("residual"), "is_anomaly")


@query("win12_time_since_event", "SELECT event_id, round((epoch(date_trunc('second', ts)) - max(CASE WHEN event_type = 'purchase' THEN epoch(date_trunc('second', ts)) END) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE UNBOUNDED PRECEDING)) / 3600, 5) AS since_purchase FROM events")
def _(t):
    return W.time_since_event(t.events, "user_id", "ts", "event_type", ["purchase"]).select("event_id", F.round("since_purchase", 5).alias("since_purchase"))


@query("top1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    return J.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)


@query("top2_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1")
def _(t):
    return J.latest_per_key(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", ["event_id"]).drop("ts")


@query("top3_top_k_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) n FROM lineitem) WHERE n <= 3")
def _(t):
    return J.top_k_per_group(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3, "n").select("l_suppkey", "l_orderkey", "l_linenumber", "n")


@query("set1_union_by_name", "SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    return J.union_by_name([t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))])


@query("set2_except_rows", "SELECT l_quantity, l_discount FROM lineitem EXCEPT ALL SELECT l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    a = t.lineitem
    return J.except_rows(a.select("l_quantity", "l_discount"), a.where("l_returnflag = 'R'").select("l_quantity", "l_discount"))


@query("set2_intersect_rows", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def _(t):
    a = t.lineitem
    return J.intersect_rows(a.where("l_returnflag = 'R'").select("l_partkey"), a.where("l_returnflag = 'A'").select("l_partkey"))


@query("fea1_polynomial_features", "SELECT l_orderkey, l_linenumber, round(l_quantity, 3) AS a, round(l_quantity * l_quantity, 3) AS aa, round(l_discount, 3) AS b, round(l_quantity * l_discount, 3) AS ab, round(l_discount * l_discount, 5) AS bb FROM lineitem")
def _(t):
    from pyspark.ml.functions import vector_to_array

    v = X.polynomial_features(t.lineitem, ["l_quantity", "l_discount"]).withColumn("p", vector_to_array("poly"))
    return v.select("l_orderkey", "l_linenumber", *[F.round(F.col("p")[i], 5 if n == "bb" else 3).alias(n) for i, n in enumerate(("a", "aa", "b", "ab", "bb"))])


@query("fea2_bucketize", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity <= 40 THEN 2 END AS b FROM lineitem WHERE l_quantity >= 1")
def _(t):
    return X.bucketize(t.lineitem.where("l_quantity >= 1"), "l_quantity", [1, 10, 25, 40], "b").select("l_orderkey", "l_linenumber", "b")


@query("fea3_one_hot", "WITH f AS (SELECT p_brand, (row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1)::DOUBLE AS brand_index FROM part GROUP BY 1) SELECT p_partkey, brand_index, '(' || (SELECT count(*) FROM f) || ',[' || brand_index::INT || '],[1.0])' AS brand FROM part JOIN f USING (p_brand)")
def _(t):
    return X.one_hot(t.part.select("p_partkey", "p_brand"), "p_brand", "brand").select("p_partkey", "brand_index", F.col("brand").cast("string").alias("brand"))


@query("fea4_target_encode", "WITH g AS (SELECT avg(o_totalprice) g FROM orders) SELECT o_orderkey, round((m * n + g * 10) / (n + 10), 4) AS enc FROM orders JOIN (SELECT o_custkey, avg(o_totalprice) m, count(*) n FROM orders GROUP BY 1) USING (o_custkey), g")
def _(t):
    return X.target_encode(t.orders, "o_custkey", "o_totalprice", 10.0, "enc").select("o_orderkey", F.round("enc", 4).alias("enc"))


@query("fea5_frequency_encode", "SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / (SELECT count(*) FROM part), 8) AS f FROM part")
def _(t):
    return X.frequency_encode(t.part, "p_brand", name="f").select("p_partkey", F.round("f", 8).alias("f"))


@query("fea6_hash_features")
def _(t):
    return X.hash_features(t.part, ["p_brand", "p_type", "p_size"], 64).select("p_partkey", F.col("hashed").cast("string").alias("hashed"))


@query("fea7_count_vectorize")
def _(t):
    return X.count_vectorize(X.words(t.documents, "text"), "words", 500, 2.0).select("doc_id", F.col("counts").cast("string").alias("counts"))


@query("fea8_tfidf", r"WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM tf GROUP BY 1) SELECT doc_id, term, tf, df, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 5) AS tfidf FROM tf JOIN f USING (term)")
def _(t):
    return X.tfidf(X.words(t.documents, "text"), "doc_id", "words").withColumn("tfidf", F.round("tfidf", 5))


@query("fea9_word2vec")
def _(t):
    return X.word2vec(X.words(t.documents, "text"), "words", 16).select("doc_id", F.col("vector").cast("string").alias("vector"))


@query("fea10_ratio_features", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END, 6) AS r FROM lineitem")
def _(t):
    return X.ratio_features(t.lineitem, [("l_discount", "l_tax")], 0.0).select("l_orderkey", "l_linenumber", F.round("l_discount_per_l_tax", 6).alias("r"))


@query("fea11_interaction_features", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 4) AS x FROM lineitem")
def _(t):
    return X.interaction_features(t.lineitem, [("l_quantity", "l_discount")]).select("l_orderkey", "l_linenumber", F.round("l_quantity_x_l_discount", 4).alias("x"))


@query("fea12_cyclical_datetime", "SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) AS hs, round(cos((dayofweek(ts) + 1) * 2 * pi() / 7), 6) AS dc FROM events")
def _(t):
    return X.cyclical_datetime(t.events, "ts", ["hour", "dayofweek"]).select("event_id", F.round("hour_sin", 6).alias("hs"), F.round("dayofweek_cos", 6).alias("dc"))


@query("fea13_haversine", "SELECT c_custkey, round(2 * 6371 * asin(sqrt(pow(sin(radians(40.0 - (c_custkey % 120 - 60)) / 2), 2) + cos(radians(c_custkey % 120 - 60)) * cos(radians(40.0)) * pow(sin(radians(-74.0 - (c_custkey % 300 - 150)) / 2), 2))), 3) AS km FROM customer")
def _(t):
    lat, lon = (F.col("c_custkey") % 120 - 60).cast("double"), (F.col("c_custkey") % 300 - 150).cast("double")
    return t.customer.select("c_custkey", F.round(X.haversine(lat, lon, F.lit(40.0), F.lit(-74.0)), 3).alias("km"))


@query("fea14_geohash", """WITH p AS (SELECT c_custkey, least(floor(((c_custkey * 13 % 3600 / 10 - 180) + 180.0::DOUBLE) / 360 * 32768), 32767)::BIGINT AS x, least(floor(((c_custkey * 7 % 1700 / 10 - 85) + 90.0::DOUBLE) / 180 * 32768), 32767)::BIGINT AS y FROM customer),
b AS (SELECT c_custkey, d, sum(((CASE WHEN (5 * d + k) % 2 = 0 THEN x ELSE y END >> (14 - (5 * d + k) // 2)::BIGINT) & 1) << (4 - k)::BIGINT) AS v FROM p, range(6) r(d), range(5) q(k) GROUP BY ALL)
SELECT c_custkey, string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', v::INT + 1, 1), '' ORDER BY d) AS cell FROM b GROUP BY 1""")
def _(t):
    lat, lon = (F.col("c_custkey") * 7 % 1700 / 10 - 85).cast("double"), (F.col("c_custkey") * 13 % 3600 / 10 - 180).cast("double")
    return t.customer.select("c_custkey", X.geohash(lat, lon, 6).alias("cell"))


@query("fea15_missing_indicators", "SELECT c_custkey, (c_custkey % 10 = 2)::INT AS status_missing FROM customer")
def _(t):
    return X.missing_indicators(t.dirty(), ["status"]).select(F.col("id").alias("c_custkey"), "status_missing")


@query("fea16_cap_outliers", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.1) a, quantile_cont(l_extendedprice, 0.9) b FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, a), b), 3) AS v FROM lineitem, q")
def _(t):
    return X.cap_outliers(t.lineitem, ["l_extendedprice"], "percentile", 0.1, 0.9).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 3).alias("v"))


@query("fea17_correct_skew", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS a, round(sqrt(l_quantity), 6) AS b FROM lineitem")
def _(t):
    return X.correct_skew(X.correct_skew(t.lineitem, ["l_extendedprice"]), ["l_quantity"], "sqrt").select("l_orderkey", "l_linenumber", F.round("l_extendedprice_log1p", 6).alias("a"), F.round("l_quantity_sqrt", 6).alias("b"))


@query("fea18_robust_scale", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.5) m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) r FROM customer) SELECT c_custkey, round((c_acctbal - m) / r, 6) AS v FROM customer, q")
def _(t):
    return X.robust_scale(t.customer, ["c_acctbal"], True).select("c_custkey", F.round("c_acctbal_scaled", 6).alias("v"))


@query("fea19_standard_scale", "WITH m AS (SELECT avg(l_quantity) a, stddev_samp(l_quantity) b, avg(l_extendedprice) c, stddev_samp(l_extendedprice) d FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - a) / b, 6) AS q, round((l_extendedprice - c) / d, 6) AS p FROM lineitem, m")
def _(t):
    from pyspark.ml.functions import vector_to_array

    v = X.standard_scale(X.assemble(t.lineitem, ["l_quantity", "l_extendedprice"], "v"), "v", "s").withColumn("a", vector_to_array("s"))
    return v.select("l_orderkey", "l_linenumber", F.round(F.col("a")[0], 6).alias("q"), F.round(F.col("a")[1], 6).alias("p"))


@query("fea19_scale_and_pca")
def _(t):
    v = X.standard_scale(X.assemble(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "v"), "v", "s")
    return X.pca(v, "s", 2, "p").select("l_orderkey", "l_linenumber", F.col("p").cast("string").alias("p"))


@query("fea20_fourier_features", "SELECT o_orderkey, round(sin(2 * pi() * 2 * dayofyear(o_orderdate) / 365.25), 6) AS ys2, round(cos(2 * pi() * (dayofweek(o_orderdate) + 1) / 7), 6) AS wc1 FROM orders")
def _(t):
    return X.fourier_features(t.orders, "o_orderdate").select("o_orderkey", F.round("yearly_sin_2", 6).alias("ys2"), F.round("weekly_cos_1", 6).alias("wc1"))


@query("fea21_holiday_features", "WITH h AS (SELECT make_date(y, m, 1) AS day, 'first of ' || m AS name FROM range(1992, 2000) a(y), (VALUES (1), (5), (12)) b(m)), n AS (SELECT o_orderkey, min({'a': abs(date_diff('day', o_orderdate::DATE, day)), 's': -date_diff('day', o_orderdate::DATE, day), 'n': name}) AS x FROM orders, h GROUP BY 1) SELECT o_orderkey, x.a = 0 AS is_holiday, CASE WHEN x.a = 0 THEN x.n END AS holiday_name, (-x.s)::INT AS days_to_holiday FROM n")
def _(t):
    years = t.orders.select(F.explode(F.array(*[F.lit(y) for y in range(1992, 2000)])).alias("y")).distinct()
    cal = years.select(F.explode(F.array(*[F.lit(m) for m in (1, 5, 12)])).alias("m"), "y").select(F.make_date("y", "m", F.lit(1)).alias("day"), F.concat(F.lit("first of "), F.col("m")).alias("name"))
    return X.holiday_features(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", cal).drop("o_orderdate")


@query("fea22_read_features", "SELECT a.event_id, b.o_totalprice AS last_price FROM (SELECT event_id, user_id, ts - INTERVAL 27 YEAR AS at FROM events) a ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL) b ON a.user_id = b.o_custkey AND a.at >= b.o_orderdate")
def _(t):
    feats = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("feature_ts"), F.col("o_totalprice").alias("last_price"))
    e = t.events.select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 27 YEARS")).alias("at"))
    return X.read_features(e, feats, ["user_id"], ["last_price"], "at").select("event_id", "last_price")


@query("fea23_online_snapshot", "SELECT 'feature:' || user_id AS key, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1")
def _(t):
    return X.online_snapshot(t.events, "user_id", "ts", ["event_id", "event_type"])
