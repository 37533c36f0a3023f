"""Queries of history, change data and incremental loads, and the layered jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions.scratch import materialize, scratch_path
from quayside.jobs.registry import DIRTY_SQL, query
from quayside.operators import aggregates as A
from quayside.operators import cleaning as C
from quayside.operators import enrichment as E
from quayside.operators import history as H
from quayside.operators import joins as J
from quayside.operators import quality
from quayside.sources.files import overwrite_partitions

#: The second snapshot of the customers: every 7th changed, every 11th gone, as many new ones.
NEW_SQL = """new AS (
  SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 11 <> 0
  UNION ALL SELECT c_custkey + 10000000, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 11 = 0)"""


def snapshots(t):
    old = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    kept = old.where("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    return old, kept.unionByName(old.where("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000))


def changes(t):
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return t.events.select("user_id", "value", op.alias("op"), "event_id")


UPSERT = f"WITH {NEW_SQL} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer) o FULL OUTER JOIN new n ON o.c_custkey = n.c_custkey"


@query("src13_merge_upsert", UPSERT)
def _(t):
    old, new = snapshots(t)
    return H.merge_upsert(old, new, ["c_custkey"])


@query("scd1_apply_scd_type1", UPSERT)
def _(t):
    old, new = snapshots(t)
    return H.apply_scd_type1(new, old, ["c_custkey"], ["c_mktsegment"])


@query("scd2_apply_scd_type2", "WITH v AS (SELECT user_id, event_type, event_id, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id, event_type)), k AS (SELECT * FROM v WHERE n = 1 OR event_type IS DISTINCT FROM p) SELECT user_id, event_type, event_id AS effective_date, coalesce(lead(event_id) OVER w, 99999999) AS end_date, lead(event_id) OVER w IS NULL AS is_current, row_number() OVER w::INT AS version FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)".replace("OVER w::INT AS version", "OVER w AS version"))
def _(t):
    log = t.events.select("user_id", "event_type", F.timestamp_seconds("event_id").alias("at"))
    made = H.apply_scd_type2(log, ["user_id"], ["event_type"], "at")
    end = F.when(F.col("is_current"), F.lit(99999999).cast("long")).otherwise(F.unix_timestamp("end_date"))
    return made.select("user_id", "event_type", F.unix_timestamp("effective_date").alias("effective_date"), end.alias("end_date"), "is_current", F.col("version").cast("long").alias("version"))


@query("scd3_apply_scd_type3", "SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_type_previous FROM events")
def _(t):
    return H.apply_scd_type3(t.events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "event_type", "event_type_previous")


HISTORY = "hist AS (SELECT c_custkey, c_mktsegment, c_acctbal, DATE '2020-01-01' AS valid_from, DATE '9999-12-31' AS valid_to, true AS is_current FROM customer UNION ALL SELECT c_custkey, 'OLD', c_acctbal, DATE '2019-01-01', DATE '2020-01-01', false FROM customer WHERE c_custkey % 3 = 0)"


def history(t):
    now = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit("9999-12-31").cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    past = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("OLD").alias("c_mktsegment"), "c_acctbal", F.lit("2019-01-01").cast("date").alias("valid_from"), F.lit("2020-01-01").cast("date").alias("valid_to"), F.lit(False).alias("is_current"))
    return now.unionByName(past)


@query("scd4_close_scd_records", f"WITH {HISTORY} SELECT c_custkey, valid_from, CASE WHEN is_current AND c_custkey % 7 = 0 THEN DATE '2024-01-01' ELSE valid_to END AS valid_to, is_current AND c_custkey % 7 <> 0 AS is_current FROM hist")
def _(t):
    return H.close_scd_records(history(t), t.customer.where("c_custkey % 7 = 0"), ["c_custkey"], F.lit("2024-01-01").cast("date"), "valid_to").select("c_custkey", "valid_from", "valid_to", "is_current")


@query("scd5_scd2_merge", f"""WITH {HISTORY}, {NEW_SQL}, o AS (SELECT * FROM hist WHERE is_current), j AS (
  SELECT o.c_custkey AS ok, n.c_custkey AS nk, o.c_mktsegment AS os, n.c_mktsegment AS ns, o.c_acctbal AS oa, n.c_acctbal AS na, o.valid_from AS vf FROM o FULL OUTER JOIN new n ON o.c_custkey = n.c_custkey)
SELECT c_custkey, c_mktsegment, c_acctbal, valid_from, valid_to, is_current FROM hist WHERE NOT is_current
UNION ALL SELECT ok, os, oa, vf, CASE WHEN nk IS NULL OR os <> ns THEN DATE '2024-01-01' ELSE DATE '9999-12-31' END, nk IS NOT NULL AND os = ns FROM j WHERE ok IS NOT NULL
UNION ALL SELECT nk, ns, na, DATE '2024-01-01', DATE '9999-12-31', true FROM j WHERE nk IS NOT NULL AND (ok IS NULL OR os <> ns)""")
def _(t):
    return H.scd2_merge(history(t), snapshots(t)[1], ["c_custkey"], ["c_mktsegment"], "2024-01-01", handle_deletes=True)


@query("cdc1_compact_changes", "SELECT user_id, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    return H.compact_changes(changes(t), ["user_id"], ["event_id"]).select("user_id", "value", "event_id")


@query("cdc2_apply_cdc", "WITH l AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN 'd' ELSE 'u' END, event_id) AS op, arg_max(value, event_id) AS v FROM events GROUP BY 1) SELECT coalesce(user_id, c_custkey) AS user_id, CASE WHEN op IS NULL THEN c_acctbal ELSE v END AS value FROM customer FULL OUTER JOIN l ON c_custkey = user_id WHERE op IS DISTINCT FROM 'd'")
def _(t):
    target = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return H.apply_cdc(target, changes(t), ["user_id"], ["event_id"])


@query("cdc3_snapshot_diff", f"WITH {NEW_SQL} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'c' WHEN n.c_custkey IS NULL THEN 'd' ELSE 'u' END AS op FROM customer o FULL OUTER JOIN new n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_mktsegment <> n.c_mktsegment")
def _(t):
    return H.snapshot_diff(*snapshots(t), ["c_custkey"]).select("c_custkey", "op")


@query("inc1_incremental_load", "SELECT o_orderkey, o_orderdate FROM orders")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderdate")
    return H.incremental_load(o, o.where("o_orderdate < TIMESTAMP '1996-01-01'"), "o_orderdate")


@query("inc2_fact_incremental", "SELECT o_orderkey, coalesce(n_nationkey + 1000, -1)::BIGINT AS nation_sk, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS fact_sk FROM orders LEFT JOIN nation ON o_custkey % 30 = n_nationkey WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 30).alias("bk"))
    loaded = o.where("o_orderdate < TIMESTAMP '1997-01-01'")
    dim = t.nation.select(F.col("n_nationkey").cast("bigint").alias("nk"), (F.col("n_nationkey") + 1000).cast("bigint").alias("sk"))
    return H.fact_incremental(o, loaded, "o_orderdate", [(dim, "bk", "nk", "sk", "nation_sk")], "fact_sk", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "nation_sk", "fact_sk")


@query("inc3_backfill", "SELECT ts::DATE AS slice, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    made = H.backfill(lambda d, by: d.groupBy(*by, "event_type").agg(F.count("*").alias("n")), t.events, "ts", "2024-01-01", "2024-02-05")
    path = scratch_path(t.spark, "backfill")
    overwrite_partitions(made, path, ["slice"])
    overwrite_partitions(made.where("slice = DATE '2024-01-02'"), path, ["slice"])  # a slice that runs again
    return t.spark.read.parquet(path).select("slice", "event_type", "n")


@query("inc4_catchup_slices", "WITH s AS (SELECT DISTINCT event_type FROM events), d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day) SELECT event_type, day FROM s, d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = s.event_type AND e.ts::DATE = d.day AND e.user_id % 5 = 0)")
def _(t):
    return H.catchup_slices(t.events.where("user_id % 5 = 0").select("event_type", F.col("ts").cast("date").alias("day")), t.events, "event_type", "day", "2024-01-01", "2024-02-04")


GOLD = "SELECT c_mktsegment AS segment, n_name AS nation, year(o_orderdate)::INT AS o_year, count(*) AS orders, count(DISTINCT o_custkey) AS buyers, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"


@query("job_gold_revenue", GOLD)
def gold_revenue(t):
    """Bronze (provenance), silver (one row per key, clean text, dates, lookups), gold (measures)."""
    bronze = E.add_ingestion_metadata(t.orders, "orders", "b1")
    silver = C.drop_duplicates_by_key(bronze.drop("_ingested_at", "_ingestion_date"), ["o_orderkey"], ["o_orderdate"], "last")
    silver = E.add_date_components(C.trim_and_clean_strings(silver, ["o_orderpriority"]), "o_orderdate", "o")
    customers = J.perform_lookup(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"], ["n_name"], "inner")
    joined = silver.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return A.aggregate_measures(joined.select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), "o_year", "o_custkey", "o_totalprice"), ["segment", "nation", "o_year"], {"orders": "count(*)", "buyers": "count(DISTINCT o_custkey)", "revenue": "round(sum(o_totalprice), 2)"})


@query("job_silver_customers", f"WITH {DIRTY_SQL} SELECT id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, CASE WHEN email LIKE '%.COM %' THEN lower(trim(email)) END AS email, coalesce(CASE WHEN trim(status) IN ('', 'N/A') THEN NULL ELSE trim(status) END, 'UNKNOWN') AS status, sha256(id::VARCHAR) AS customer_hk, email LIKE '%.COM %' AS is_valid FROM dirty")
def _(t):
    d = C.standardize_nulls(C.drop_exact_duplicates(t.dirty()))
    d = C.trim_and_clean_strings(d, ["name", "status"])
    d = C.fill_nulls(C.clean_email_addresses(d, ["email"]), {"status": "UNKNOWN"})
    d = quality.add_validation_flags(E.add_hash_key(d, ["id"], "customer_hk"), {"email": "email IS NOT NULL"})
    return d.select("id", "name", "email", "status", "customer_hk", "is_valid")


@query("job_cdc_to_scd2", f"""WITH l AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN 'd' ELSE 'u' END, event_id) AS op, arg_max(event_type, event_id) AS s FROM events GROUP BY 1),
cur AS (SELECT coalesce(user_id, c_custkey) AS k, CASE WHEN op IS NULL THEN c_mktsegment ELSE s END AS s FROM customer FULL OUTER JOIN l ON c_custkey = user_id WHERE op IS DISTINCT FROM 'd')
SELECT c_custkey AS k, c_mktsegment AS s, cur.k IS NOT NULL AND cur.s = c_mktsegment AS is_current FROM customer LEFT JOIN cur ON cur.k = c_custkey
UNION ALL SELECT cur.k, cur.s, true FROM cur LEFT JOIN customer ON cur.k = c_custkey WHERE c_custkey IS NULL OR c_mktsegment <> cur.s""")
def _(t):
    target = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    log = changes(t).select(F.col("user_id").alias("k"), "op", "event_id").join(t.events.select("event_id", F.col("event_type").alias("s")), "event_id")
    current = materialize(H.apply_cdc(target, log, ["k"], ["event_id"]), "current")
    hist = target.select("k", "s", F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit("9999-12-31").cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    return H.scd2_merge(hist, current, ["k"], ["s"], "2024-01-01", handle_deletes=True).select("k", "s", "is_current")
