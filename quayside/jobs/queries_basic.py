"""Queries of cleaning, enrichment, parsing, validation and masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.jobs.registry import DIRTY_SQL, query
from quayside.operators import cleaning as C
from quayside.operators import enrichment as E
from quayside.operators import parsing as P
from quayside.operators import pii, quality

D = f"WITH {DIRTY_SQL} "


@query("cln1_drop_exact_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def _(t):
    return C.drop_exact_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"))


@query("cln2_drop_duplicates_by_key", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) n FROM orders) WHERE n = 1")
def _(t):
    return C.drop_duplicates_by_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "last")


@query("cln3_standardize_nulls", D + "SELECT id, CASE WHEN trim(status) IN ('', 'NULL', 'null', 'Null', 'N/A', 'n/a', 'NA', 'None', 'none', '#N/A') THEN NULL ELSE status END AS status, CASE WHEN trim(phone) = 'none' THEN NULL ELSE phone END AS phone FROM dirty")
def _(t):
    return C.standardize_nulls(t.dirty().select("id", "status", "phone"))


@query("cln4_trim_and_clean_strings", D + r"SELECT id, lower(trim(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS name FROM dirty")
def _(t):
    return C.trim_and_clean_strings(t.dirty().select("id", "name"), case="lower", remove_special=True)


@query("cln5_normalize_case", D + "SELECT id, upper(email) AS email FROM dirty")
def _(t):
    return C.normalize_case(t.dirty().select("id", "email"), ["email"], "upper")


@query("cln6_remove_special_characters", D + r"SELECT id, regexp_replace(phone, '[^a-zA-Z0-9\s]', '_', 'g') AS phone FROM dirty")
def _(t):
    return C.remove_special_characters(t.dirty().select("id", "phone"), ["phone"], "_")


@query("cln7_replace_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    return C.replace_values(t.orders.select("o_orderkey", "o_orderstatus"), {"o_orderstatus": {"F": "final", "O": "open"}})


@query("cln8_fill_nulls", D + "SELECT id, coalesce(status, 'unknown') AS status FROM dirty")
def _(t):
    return C.fill_nulls(t.dirty().select("id", "status"), {"status": "unknown"})


@query("cln9_drop_null_rows", D + "SELECT id, status FROM dirty WHERE status IS NOT NULL")
def _(t):
    return C.drop_null_rows(t.dirty().select("id", "status"), ["status"])


@query("cln10_coalesce_columns", D + "SELECT id, coalesce(status, segment) AS label FROM dirty")
def _(t):
    return C.coalesce_columns(t.dirty().select("id", "status", "segment"), "label", ["status", "segment"], drop_sources=True)


@query("cln11_filter_by_condition", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def _(t):
    return C.filter_by_condition(t.orders, "o_totalprice > 1000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("cln12_remove_outliers_iqr", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q WHERE l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)")
def _(t):
    return C.remove_outliers_iqr(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 0.5)


@query("cln13_deduplicate_array_column", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS types FROM events GROUP BY user_id")
def _(t):
    made = t.events.groupBy("user_id").agg(F.collect_list("event_type").alias("types"))
    return C.deduplicate_array_column(made, "types").select("user_id", F.array_join(F.array_sort("types"), ",").alias("types"))


@query("cln14_remove_empty_arrays", "SELECT user_id, nullif(count(*) FILTER (event_type = 'error'), 0) AS n_errors FROM events GROUP BY user_id")
def _(t):
    made = t.events.groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("errors"))
    return C.remove_empty_arrays(made, "errors").select("user_id", F.when(F.col("errors").isNotNull(), F.size("errors")).cast("long").alias("n_errors"))


@query("cln15_clean_email_addresses", D + r"SELECT id, CASE WHEN regexp_matches(trim(email), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') THEN lower(trim(email)) END AS email FROM dirty")
def _(t):
    return C.clean_email_addresses(t.dirty().select("id", "email"), ["email"])


@query("cln16_clean_phone_numbers", D + "SELECT id, CASE WHEN regexp_replace(phone, '[^0-9]', '', 'g') <> '' THEN '+1' || regexp_replace(phone, '[^0-9]', '', 'g') END AS phone FROM dirty")
def _(t):
    return C.clean_phone_numbers(t.dirty().select("id", "phone"), ["phone"], "+1")


@query("cln17_project_cast_round", "SELECT p_partkey AS part_id, try_cast(p_size AS VARCHAR) AS p_size, round(p_retailprice, 1) AS p_retailprice FROM part")
def _(t):
    return C.round_numbers(C.cast_column(C.rename_columns(C.select_columns(t.part, ["p_partkey", "p_size", "p_retailprice"]), {"p_partkey": "part_id"}), "p_size", "string"), ["p_retailprice"], 1)


@query("cln18_normalize_numeric", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def _(t):
    return C.normalize_numeric(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("cln19_regex_extract_replace", r"SELECT c_custkey, replace(c_name, '#', '-') AS c_name, regexp_extract(c_name, '(\d+)$', 1) AS digits FROM customer")
def _(t):
    return C.replace_string(C.regex_extract(t.customer.select("c_custkey", "c_name"), "c_name", r"(\d+)$", "digits"), "c_name", "#", "-")


@query("cln20_parse_date", "SELECT o_orderkey, cast(o_orderdate AS DATE) AS d, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q FROM orders")
def _(t):
    made = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    made = C.parse_date(made, "d", "dd/MM/yyyy")
    return C.extract_date_part(C.extract_date_part(made, "d", "year", "y"), "d", "quarter", "q")


@query("cln21_apply_chain", D + r"SELECT DISTINCT id, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS name, coalesce(CASE WHEN trim(status) IN ('', 'N/A') THEN NULL ELSE trim(status) END, 'unknown') AS status FROM dirty")
def _(t):
    return C.apply_chain(t.dirty().select("id", "name", "status"), [
        {"name": "standardize_nulls"}, {"name": "trim_and_clean_strings", "params": {"columns": ["name", "status"]}}, {"name": "normalize_case", "params": {"columns": ["name"]}},
        {"name": "fill_nulls", "params": {"defaults": {"status": "unknown"}}}, {"name": "drop_exact_duplicates"}, {"name": "round_numbers", "params": {"columns": ["id"]}, "when": False}])


@query("enr1_add_audit_columns", "SELECT c_custkey, 'etl' AS created_by, 'etl' AS updated_by FROM customer")
def _(t):
    return E.add_audit_columns(t.customer.select("c_custkey"), "etl").drop("created_at", "updated_at")


@query("enr2_add_ingestion_metadata", "SELECT o_orderkey, 'orders' AS _source, 'b1' AS _batch_id FROM orders")
def _(t):
    return E.add_ingestion_metadata(t.orders.select("o_orderkey"), "orders", "b1").drop("_ingested_at", "_ingestion_date")


@query("enr3_add_surrogate_key", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 99 AS order_sk FROM orders")
def _(t):
    return E.add_surrogate_key(t.orders.select("o_orderkey", "o_orderdate"), "order_sk", ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "order_sk")


@query("enr4_add_hash_key", D + "SELECT id, sha256(concat_ws('||', id::VARCHAR, status, segment)) AS k, md5(concat_ws('||', id::VARCHAR, coalesce(status, '~'), segment)) AS k2 FROM dirty")
def _(t):
    return E.add_hash_key(E.add_hash_key(t.dirty(), ["id", "status", "segment"], "k"), ["id", "status", "segment"], "k2", "md5", "~").select("id", "k", "k2")


@query("enr5_add_date_components", "SELECT o_orderkey, year(o_orderdate)::INT AS o_year, month(o_orderdate)::INT AS o_month, day(o_orderdate)::INT AS o_day FROM orders")
def _(t):
    return E.add_date_components(t.orders, "o_orderdate", "o").select("o_orderkey", "o_year", "o_month", "o_day")


@query("enr6_add_age_from_birthdate", "SELECT o_orderkey, trunc(date_diff('day', o_orderdate::DATE, DATE '2024-06-30') / 365.25)::INT AS age FROM orders")
def _(t):
    return E.add_age_from_birthdate(t.orders, "o_orderdate", "2024-06-30").select("o_orderkey", "age")


@query("enr7_add_tenure_months", "SELECT o_orderkey, datesub('month', o_orderdate::DATE, DATE '2024-06-15')::INT AS tenure_months FROM orders WHERE day(o_orderdate) <= 28")
def _(t):
    day = t.orders.where(F.dayofmonth("o_orderdate") <= 28).withColumn("d", F.col("o_orderdate").cast("date"))
    return E.add_tenure_months(day, "d", F.lit("2024-06-15").cast("date")).select("o_orderkey", "tenure_months")


@query("enr8_add_business_key", "SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS line_key, l_quantity FROM lineitem")
def _(t):
    return E.add_business_key(t.lineitem, ["l_orderkey", "l_linenumber"], "line_key").select("line_key", "l_quantity")


@query("enr9_sql_transform", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def _(t):
    return E.sql_transform(t.customer, "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM {input_table} GROUP BY 1")


@query("enr10_render_template", "SELECT conv_id, turn, '[' || role || '] ' || text || ' {end}' AS prompt FROM conversations")
def _(t):
    return E.render_template(t.conversations, "[{role}] {text} {end}", ["role", "text"], "prompt").select("conv_id", "turn", "prompt")


@query("prs1_parse_json_column", "SELECT event_id, cast(props->>'$.k' AS BIGINT) AS k FROM events")
def _(t):
    return P.parse_json_column(t.events.select("event_id", "props"), "props", "k bigint", drop_source=True)


@query("prs1_parse_json_inferred", "SELECT event_id, cast(props->>'$.k' AS BIGINT) AS k FROM events")
def _(t):
    return P.parse_json_column(t.events.select("event_id", "props"), "props", drop_source=True).select("event_id", "k")


@query("prs2_extract_json_field", "SELECT event_id, props->>'$.k' AS k FROM events")
def _(t):
    return P.extract_json_field(t.events, "props", "$.k", "k").select("event_id", "k")


@query("prs3_explode_array_column", r"SELECT doc_id, i - 1 AS pos, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))")
def _(t):
    made = t.documents.select("doc_id", F.split("text", " ").alias("ws"))
    return P.explode_array_column(made, "ws", "word", keep_position=True).withColumn("pos", F.col("pos").cast("long"))


@query("prs4_split_delimited_column", "SELECT c_custkey, string_split(c_name, '#')[1] AS a, string_split(c_name, '#')[2] AS b, string_split(c_name, '#')[3] AS c FROM customer")
def _(t):
    return P.split_delimited_column(t.customer.select("c_custkey", "c_name"), "c_name", "#", ["a", "b", "c"]).drop("c_name")


@query("prs5_flatten_struct_column", "SELECT o_orderkey, o_custkey AS o_buyer_id, o_orderstatus AS o_status FROM orders")
def _(t):
    made = t.orders.select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("id")).alias("buyer"), F.col("o_orderstatus").alias("status")).alias("o"))
    return P.flatten_struct_column(made, "o", recursive=True)


@query("prs6_parse_fix_log", "SELECT o_orderkey::VARCHAR AS \"ClOrdID\", CASE o_orderstatus WHEN 'F' THEN '8' ELSE 'D' END AS \"MsgType\", floor(o_totalprice)::BIGINT::VARCHAR AS \"OrderQty\", o_custkey::VARCHAR AS \"Tag9001\" FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O'")
def _(t):
    from quayside.sources.messages import SOH, parse_fix_log

    kind = F.when(F.col("o_orderstatus") == "F", "8").when(F.col("o_orderstatus") == "O", "D").otherwise("0")
    lines = t.orders.select(F.concat_ws(SOH, F.lit("8=FIX.4.4"), F.concat(F.lit("35="), kind), F.concat(F.lit("11="), F.col("o_orderkey")), F.concat(F.lit("38="), F.floor("o_totalprice")), F.concat(F.lit("9001="), F.col("o_custkey"))).alias("line"))
    return parse_fix_log(lines, "line", ["8", "D"], ["9001"]).select("ClOrdID", "MsgType", "OrderQty", "Tag9001")


@query("prs12_parse_cdc_envelope", "SELECT CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, event_id AS seq FROM events")
def _(t):
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    before = F.when(op == "d", F.struct("user_id"))
    after = F.when(op != "d", F.struct("user_id", "value"))
    env = t.events.select(F.to_json(F.struct(op.alias("op"), before.alias("before"), after.alias("after"), F.col("event_id").alias("ts_ms"))).alias("v"))
    made = P.parse_cdc_envelope(env, "v", "debezium", "user_id bigint, value double", ["user_id"])
    return made.select("op", "user_id", F.col("row.value").alias("value"), "seq")


@query("prs12_snowflake_updates", "SELECT CASE event_id % 3 WHEN 0 THEN 'u' WHEN 1 THEN 'c' ELSE 'd' END AS op, user_id, value, event_id AS seq FROM events")
def _(t):
    """Every third change is an update: an insert and a delete of one sequence number, in either order."""
    part = F.col("event_id") % 3
    update = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("INSERT"), F.lit("DELETE"))).otherwise(F.array(F.lit("DELETE"), F.lit("INSERT")))
    actions = F.when(part == 0, update).when(part == 1, F.array(F.lit("INSERT"))).otherwise(F.array(F.lit("DELETE")))
    rows = t.events.select("user_id", "value", F.col("event_id").alias("seq"), F.explode(actions).alias("METADATA$ACTION"), (part == 0).alias("METADATA$ISUPDATE"))
    made = P.parse_cdc_envelope(rows.select(F.to_json(F.struct("*")).alias("v")), "v", "snowflake", "user_id bigint, value double", ["user_id"])
    return made.select("op", "user_id", F.col("row.value").alias("value"), "seq")


@query("src10_decode_kafka", "SELECT user_id::VARCHAR AS key, event_id % 4 AS partition, event_id AS \"offset\", event_type, value FROM events")
def _(t):
    raw = t.events.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.to_json(F.struct("event_type", "value")).cast("binary").alias("value"), F.lit("events").alias("topic"), (F.col("event_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))
    return P.decode_kafka(raw, "json", "event_type string, value double").select("key", "partition", "offset", "event_type", "value")


RULES = {"positive": "o_totalprice > 0", "small": "o_totalprice < 5000", "known": "o_orderstatus IN ('F', 'O')"}


@query("val1_add_validation_flags", "SELECT o_orderkey, coalesce(o_totalprice > 0 AND o_totalprice < 5000 AND o_orderstatus IN ('F', 'O'), false) AS is_valid, array_to_string(list_filter([CASE WHEN NOT coalesce(o_totalprice > 0, false) THEN 'positive' END, CASE WHEN NOT coalesce(o_totalprice < 5000, false) THEN 'small' END, CASE WHEN NOT coalesce(o_orderstatus IN ('F', 'O'), false) THEN 'known' END], lambda x: x IS NOT NULL), ',') AS failed_rules FROM orders")
def _(t):
    return quality.add_validation_flags(t.orders, RULES).select("o_orderkey", "is_valid", F.array_join("failed_rules", ",").alias("failed_rules"))


@query("val2_mark_invalid_rows", D + "SELECT id, coalesce(status = 'N/A', false) AS is_invalid FROM dirty")
def _(t):
    return quality.mark_invalid_rows(t.dirty(), "status = 'N/A'").select("id", "is_invalid")


@query("val3_split_valid_invalid", D + "SELECT coalesce(status <> 'N/A', false) AS ok, count(*) AS n FROM dirty GROUP BY 1")
def _(t):
    parts = quality.split_valid_invalid(t.dirty().withColumn("is_valid", F.expr("status <> 'N/A'")))
    return parts["valid"].withColumn("ok", F.lit(True)).unionByName(parts["invalid"].withColumn("ok", F.lit(False))).groupBy("ok").agg(F.count("*").alias("n"))


@query("val4_enforce_not_null", D + "SELECT id, coalesce(status, 'missing') AS status FROM dirty")
def _(t):
    return quality.enforce_not_null(t.dirty().select("id", "status"), {"status": "missing"})


@query("val5_validate_length", D + "SELECT id, coalesce(length(status) BETWEEN 4 AND 9, false) AS ok FROM dirty")
def _(t):
    return quality.validate_length(t.dirty(), "status", 4, 9, "ok").select("id", "ok")


@query("val6_validate_pattern", D + r"SELECT id, phone FROM dirty WHERE regexp_matches(phone, '^\(\d{3}\)')")
def _(t):
    return quality.validate_pattern(t.dirty().select("id", "phone"), "phone", r"^\(\d{3}\)")


@query("val7_validate_range", "SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 5 AND 30 AS ok FROM lineitem")
def _(t):
    return quality.validate_range(t.lineitem, "l_quantity", 5, 30, "ok").select("l_orderkey", "l_linenumber", "ok")


@query("val8_validate_email", D + r"SELECT id, regexp_matches(trim(email), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') AS ok FROM dirty WHERE status IS NOT NULL")
def _(t):
    made = quality.check_not_null(t.dirty().withColumn("email", F.trim("email")), ["status"])
    return quality.validate_email(made, "email", "ok").select("id", "ok")


@query("qty1_expectations_report", D + "SELECT 'email_form' AS check_name, count(*) AS n_rows, count(*) FILTER (NOT coalesce(email LIKE '%@%.%', false)) AS n_failed FROM dirty UNION ALL SELECT 'has_status', count(*), count(*) FILTER (status IS NULL) FROM dirty UNION ALL SELECT 'unique_segment_nation', sum(c)::BIGINT, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT FROM (SELECT count(*) c FROM dirty GROUP BY segment, nation) UNION ALL SELECT 'reference_nation', count(*), count(*) FILTER (nation NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)) FROM dirty")
def _(t):
    ref = {"nation": t.nation.where("n_regionkey < 3").withColumnRenamed("n_nationkey", "nation")}
    return quality.expectations_report(t.dirty(), {"email_form": "email LIKE '%@%.%'", "has_status": "status IS NOT NULL"}, [["segment", "nation"]], ref)


@query("qty3_reconcile_tables", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'different' END AS status FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0")
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    other = o.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return quality.reconcile_tables(o, other, ["o_orderkey"])


@query("qty3_null_keys", "SELECT nullif(o_custkey, 1)::BIGINT AS k, o_orderkey, 'different' AS status FROM orders WHERE o_orderkey % 50 = 0")
def _(t):
    """Rows with a null in their key are in both tables; nothing but what differs is told, though all share one bucket."""
    o = t.orders.select(F.nullif(F.col("o_custkey"), F.lit(1)).alias("k"), "o_orderkey", "o_totalprice")
    other = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return quality.reconcile_tables(o, other, ["k", "o_orderkey"], buckets=1)


@query("qty4_freshness", "SELECT event_type, max(ts) AS newest, epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600 > 30 AS is_late FROM events GROUP BY 1")
def _(t):
    return quality.freshness(t.events, "ts", ["event_type"], "2024-02-01", 30).select("event_type", "newest", "is_late")


@query("qty5_table_profile", "SELECT 'c_custkey' AS \"column\", 'bigint' AS type, count(*) AS n_rows, 0::BIGINT AS n_null, count(DISTINCT c_custkey) AS n_distinct, min(c_custkey)::VARCHAR AS min, max(c_custkey)::VARCHAR AS max FROM customer UNION ALL SELECT 'c_mktsegment', 'string', count(*), 0, count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer UNION ALL SELECT 'c_nationkey', 'int', count(*), 0, count(DISTINCT c_nationkey), min(c_nationkey)::VARCHAR, max(c_nationkey)::VARCHAR FROM customer")
def _(t):
    return quality.table_profile(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), exact=True)


@query("pii1_mask_column", "SELECT c_custkey, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS c_name FROM customer")
def _(t):
    return pii.mask_column(t.customer.select("c_custkey", "c_name"), ["c_name"])


@query("pii2_tokenize_column", "SELECT c_custkey, sha256(c_name || 's1') AS c_name FROM customer")
def _(t):
    return pii.tokenize_column(t.customer.select("c_custkey", "c_name"), ["c_name"], salt="s1")


@query("pii3_redact_email", D + "SELECT id, CASE WHEN email LIKE '%@%' THEN '****@' || regexp_extract(email, '@(.+)$', 1) ELSE '****' END AS email FROM dirty")
def _(t):
    return pii.redact_email(t.dirty().select("id", "email"), ["email"])


@query("pii4_anonymize_with_lookup", "SELECT c_custkey, 'N' || c_nationkey AS nation FROM customer")
def _(t):
    m = t.nation.select("n_name", F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"))
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))
    return pii.anonymize_with_lookup(named, "nation", m, "n_name", "code")


@query("pii5_remove_pii_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return pii.remove_pii_columns(t.customer, ["c_name"])


@query("pii6_redact_by_strategy", D + "SELECT id, sha256(name) AS name, repeat('*', greatest(length(phone) - 4, 0)) || right(phone, 4) AS phone FROM dirty")
def _(t):
    return pii.redact_by_strategy(t.dirty().select("id", "name", "phone", "email"), {"name": "hash", "phone": "mask", "email": "drop"})
