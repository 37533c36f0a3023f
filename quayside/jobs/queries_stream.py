"""Queries of the streaming jobs: the events as a stream of files, run over what is there, against their batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayside.functions.scratch import materialize, scratch_path
from quayside.jobs.registry import query
from quayside.sources import files, messages
from quayside.streaming import jobs as S


def events(t, n: int = 4):
    """The events, written as ``n`` Parquet files and streamed one a batch."""
    path = scratch_path(t.spark, "events")
    e = t.events
    e.repartitionByRange(n, "event_id").write.parquet(path)
    return S.stream_files(t.spark, path, e.schema, "parquet", 1)


@query("str1_stream_files", "SELECT event_id, event_type FROM events")
def _(t):
    return S.run_now(events(t).select("event_id", "event_type"), "append").select("event_id", "event_type")


@query("str2_stream_to_table", "SELECT event_id, value FROM events")
def _(t):
    out, check = scratch_path(t.spark, "out"), scratch_path(t.spark, "check")
    S.stream_to_table(events(t).select("event_id", "value"), out, check).awaitTermination()
    return t.spark.read.parquet(out)


@query("str3_stream_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def _(t):
    return S.run_now(S.stream_counts(events(t), ["event_type"]), "complete").select("event_type", "count")


@query("str4_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    w = S.run_now(S.windowed(events(t), "ts", ["event_type"], "value", "1 day", delay="40 days"), "complete")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str4_sliding_windows", "WITH s AS (SELECT unnest([0, 12]) AS h) SELECT time_bucket(INTERVAL 12 HOUR, ts) - h * INTERVAL 1 HOUR AS window_start, count(*) AS n FROM events, s GROUP BY ALL")
def _(t):
    w = S.run_now(S.windowed(events(t), "ts", [], "value", "1 day", "12 hours", delay="40 days"), "complete")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


SESSIONS = "WITH g AS (SELECT *, (ts - lag(ts) OVER w >= INTERVAL 12 HOUR)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(coalesce(b, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"


@query("str4_sessions", SESSIONS)
def _(t):
    w = S.sessions(t.events, "ts", ["user_id"], "value", "12 hours")
    return w.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("str4_sessions_stream", SESSIONS)
def _(t):
    w = S.run_now(S.sessions(events(t), "ts", ["user_id"], "value", "12 hours", "40 days"), "complete")
    return w.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("str5_dedupe_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return S.run_now(S.dedupe_stream(events(t), ["user_id", "event_type"], "ts", "100 days").select("user_id", "event_type"), "append").select("user_id", "event_type")


@query("str6_split_late", "SELECT 'all' AS part, count(*) AS n FROM events")
def _(t):
    good, late, check = (scratch_path(t.spark, n) for n in ("good", "late", "check"))
    S.split_late(events(t).select("event_id", "ts"), "ts", 86400, S.by_batch(good), S.by_batch(late), check).awaitTermination()
    return t.spark.read.parquet(good).unionByName(t.spark.read.parquet(late)).agg(F.lit("all").alias("part"), F.count("*").alias("n"))


@query("str6_split_late_parts", "WITH m AS (SELECT max(floor(epoch(ts))) AS latest FROM events WHERE user_id % 2 = 0) SELECT event_id, coalesce(user_id % 2 = 1 AND floor(epoch(ts)) < latest - 86400, false) AS is_late FROM events, m")
def _(t):
    """The events of even users come first; those of odd ones come to a second run, which goes on where the first stopped."""
    path, good, late, check = (scratch_path(t.spark, n) for n in ("arrived", "good", "late", "check"))
    for i in range(2):
        t.events.where(f"user_id % 2 = {i}").write.mode("append").parquet(path)
        arrived = S.stream_files(t.spark, path, t.events.schema, "parquet").select("event_id", "ts")
        S.split_late(arrived, "ts", 86400, S.by_batch(good), S.by_batch(late), check).awaitTermination()
    sides = [t.spark.read.parquet(p).select("event_id", F.lit(p == late).alias("is_late")) for p in (good, late)]
    return sides[0].unionByName(sides[1])


@query("str7_stream_transform", "SELECT event_id, upper(event_type) AS event_type FROM events WHERE value > 10")
def _(t):
    steps = [{"name": "filter_by_condition", "params": {"condition": "value > 10"}}, {"name": "normalize_case", "params": {"columns": ["event_type"], "case": "upper"}}]
    return S.run_now(S.stream_transform(events(t).select("event_id", "event_type", "value"), steps), "append").select("event_id", "event_type")


@query("str8_stream_enrich", "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return S.run_now(S.stream_enrich(events(t), c, ["user_id"]).select("event_id", "c_mktsegment"), "append").select("event_id", "c_mktsegment")


@query("str8_interval_join", "SELECT a.event_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def _(t):
    a = events(t).where("event_type = 'click'").select("event_id", "user_id", "ts")
    b = events(t).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("purchase_ts"))
    return S.run_now(S.interval_join(a, b, "user_id", "ts", "purchase_ts", "6 hours", "40 days").select("event_id", "purchase_id"), "append").select("event_id", "purchase_id")


@query("str9_stream_upsert", "SELECT user_id, value FROM (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) WHERE t <> 'error'")
def _(t):
    path, check = scratch_path(t.spark, "upsert"), scratch_path(t.spark, "check")
    op = F.when(F.col("event_type") == "error", "d").otherwise("u")
    q = S.stream_upsert(events(t).select("user_id", "value", op.alias("op"), "event_id"), path, ["user_id"], ["event_id"], check)
    q.awaitTermination()
    return S.upserted(t.spark, path).select("user_id", "value")


@query("str10_stream_score")
def _(t):
    from quayside.operators import models as M

    e = t.events.select("user_id", "value", (F.col("event_type") == "purchase").cast("int").alias("y"))
    model = M.train(e, "y", ["value"], "logistic", maxIter=5)
    payload = events(t).select(F.to_json(F.struct("event_id", "value")).alias("v"))
    return S.run_now(S.stream_score(payload, "v", "event_id long, value double", model, ["value"]).select("event_id", "score"), "append").select("event_id", "score")


@query("str11_user_state", "SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def _(t):
    s = S.user_state(events(t), "user_id", "ts", "value", "100 days")
    return S.run_now(s, "update", keys=["user_id"]).select("user_id", "n", F.round("total", 3).alias("total"))


@query("str11_timers", """WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) // 1000 AS z FROM events),
g AS (SELECT *, coalesce(z - lag(z) OVER w >= 86400000, false)::INT AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY z, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY z, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, k, max(z) AS last_ms, count(*) AS n, round(sum(value), 3) AS total, max(k) OVER (PARTITION BY user_id) AS newest FROM r GROUP BY user_id, k)
SELECT user_id, last_ms, n, total FROM s WHERE k < newest OR last_ms + 86400000 <= (SELECT max(z) FROM e)""")
def _(t):
    """Users that were idle for a day, told once. The events come in the order of their times, in four batches, each of them
    after a restart."""
    path, out, check = (scratch_path(t.spark, n) for n in ("timed", "idle", "check"))
    e = t.events.select("user_id", "ts", "value")
    quarter = F.ntile(4).over(Window.orderBy("day"))
    days = e.select(F.col("ts").cast("date").alias("day")).distinct().withColumn("quarter", quarter)  # a row a day
    dealt = e.join(days, F.col("ts").cast("date") == F.col("day")).select("user_id", "ts", "value", "quarter")
    dealt = materialize(dealt, "dealt")
    for q in (1, 2, 3, 4):
        dealt.where(F.col("quarter") == q).drop("quarter").write.mode("append").parquet(path)
        with S.with_rocksdb(t.spark):
            told = S.idle_runs(S.stream_files(t.spark, path, e.schema, "parquet"), "user_id", "ts", "value")
            told.writeStream.foreachBatch(S.by_batch(out)).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("user_id", "last_ms", "n", F.round("total", 3).alias("total"))


@query("str6_dropped_rows", """WITH m AS (SELECT (max(epoch_us(ts)) // 1000 - 86400000) * 1000 AS mark FROM events WHERE user_id % 2 = 0)
SELECT (SELECT count(*) FROM events) AS rows_read, count(*) FILTER (user_id % 2 = 1 AND epoch_us(ts) <= mark) AS rows_dropped,
  count(*) FILTER (user_id % 2 = 0 OR epoch_us(ts) > mark) AS kept FROM events, m""")
def _(t):
    """The events of even users come first; those of odd ones that lie a day behind them are dropped. Both counts are those
    of the stream's own listener."""
    path, out, check = (scratch_path(t.spark, n) for n in ("arrived", "kept", "check"))
    told = None
    for i in range(2):
        t.events.where(f"user_id % 2 = {i}").write.mode("append").parquet(path)
        arrived = S.stream_files(t.spark, path, t.events.schema, "parquet").select("event_id", "ts")
        log = S.run_logged(S.dedupe_state(arrived, ["event_id"], "ts", "1 day"), out, check)
        told = log if told is None else told.unionByName(log)
    sums = told.agg(F.sum("rows_read").alias("rows_read"), F.sum("rows_dropped").alias("rows_dropped"))
    return sums.crossJoin(F.broadcast(t.spark.read.parquet(out).agg(F.count("*").alias("kept"))))


@query("src14_two_columns", "SELECT count(*) AS n, true AS few_by_day, true AS few_by_part FROM lineitem")
def _(t):
    """Lines along a curve through day and part: of 64 files, those that hold a month or a fiftieth of the parts."""
    path = scratch_path(t.spark, "curve")
    files.write_clustered(t.lineitem, path, ["l_shipdate", "l_partkey"], 64)
    held = t.spark.read.parquet(path)
    read = lambda cond: F.count_distinct(F.when(cond, F.col("_metadata.file_name")))
    most = held.select(F.max("l_partkey")).first()[0]
    found = held.agg(
        F.count("*").alias("n"), F.count_distinct(F.col("_metadata.file_name")).alias("every"),
        read(F.date_trunc("month", "l_shipdate") == F.lit("1995-03-01").cast("timestamp_ntz")).alias("days"), read(F.col("l_partkey") <= most // 50).alias("parts"),
    )
    return found.select("n", (F.col("days").between(1, F.col("every") / 2)).alias("few_by_day"), (F.col("parts").between(1, F.col("every") / 2)).alias("few_by_part"))


@query("src18_audit_row", """WITH b AS (SELECT *, o_orderdate >= TIMESTAMP '1995-01-01' AS late FROM orders)
SELECT 'orders' AS job, unnest([1, 2, 3]) AS run, unnest([count(*) FILTER (NOT late), count(*) FILTER (late), 0]) AS rows_read, unnest([count(*) FILTER (NOT late AND o_orderstatus <> 'P'), count(*) FILTER (late AND o_orderstatus <> 'P'), 0]) AS rows_written,
  unnest([NULL, strftime(max(o_orderdate) FILTER (NOT late), '%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')]) AS watermark_before,
  unnest([strftime(max(o_orderdate) FILTER (NOT late), '%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')]) AS watermark_after,
  unnest(['', 'added source string', '']) AS schema_changes FROM b""")
def _(t):
    """The orders up to a day, then all beyond the watermark with a column more, then those beyond it once more."""
    path, mark, rows = scratch_path(t.spark, "audited"), None, []
    keep = lambda df: df.where("o_orderstatus <> 'P'")
    for run in (1, 2, 3):
        source = t.orders.where("o_orderdate < TIMESTAMP '1995-01-01'") if run == 1 else t.orders.withColumn("source", F.lit("crm"))
        row = files.run_audited(source, path, "orders", watermark="o_orderdate", after=mark, transform=keep)
        mark = row["watermark_after"]
        rows.append((row["job"], run, row["rows_read"], row["rows_written"], row["watermark_before"], mark, ";".join(row["schema_changes"])))
    return t.spark.createDataFrame(rows, "job string, run int, rows_read long, rows_written long, watermark_before string, watermark_after string, schema_changes string")


@query("src7_pictures", "SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) AS segment, round(c_acctbal, 2)::DOUBLE AS balance, (c_custkey % 10)::BIGINT AS first_digit, (c_custkey % 7)::BIGINT AS second_digit, c_nationkey::BIGINT AS nation FROM customer")
def _(t):
    """Repeated signs, a punched sign, a group that occurs twice and two fillers, before the field that all of them shift."""
    layout = files.layout_from_copybook("""
       01 CUSTOMER.
          05 C-CUSTKEY PIC 9(10).
          05 SEGMENT PIC XXX.
          05 FILLER PIC X(2).
      * a comment PIC X(99).
          05 BALANCE PIC S9(7)V99.
             88 EMPTY VALUE ZERO.
          05 PAIR OCCURS 2 TIMES.
             10 DIGIT PIC 99.
             10 FILLER PIC X.
          05 NATION
             PIC 9999.
""")
    cents = F.round(F.abs("c_acctbal") * 100).cast("long").cast("string")
    signs = F.when(F.col("c_acctbal") < 0, "}JKLMNOPQR").otherwise("{ABCDEFGHI")
    last = F.substr(signs, F.substr(cents, F.length(cents)).cast("int") + 1, F.lit(1))
    punched = F.concat(F.substr(F.lpad(cents, 9, "0"), F.lit(1), F.lit(8)), last)
    two = lambda n: F.lpad((F.col("c_custkey") % n).cast("string"), 2, "0")
    line = F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.upper(F.substr("c_mktsegment", F.lit(1), F.lit(3))), F.lit("--"), punched,
        two(10), F.lit("/"), two(7), F.lit("/"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"),
    )
    got = files.slice_fixed_width(t.customer.select(line.alias("value")), "value", layout)
    return got.select("c_custkey", "segment", F.col("balance").cast("double").alias("balance"), F.col("digit_1").alias("first_digit"), F.col("digit_2").alias("second_digit"), "nation")


@query("prs7_two_sets", """SELECT o_orderkey, unnest(['A' || o_orderkey, 'B' || o_orderkey]) AS claim_id, unnest(['ANN DOE' || o_custkey, NULL]) AS patient, unnest([NULL, 'GREG HOUSE']) AS provider FROM orders""")
def _(t):
    """The first set has a patient and no provider, the second one a provider and no patient."""
    text = F.concat(
        F.lit("ISA*00~ST*837*0001~NM1*IL*1*DOE"), F.col("o_custkey"), F.lit("*ANN~CLM*A"), F.col("o_orderkey"), F.lit("*5***11:B:1~SE*4*0001~\nST*837*0002~CLM*B"),
        F.col("o_orderkey"), F.lit("*7***11:B:1~NM1*82*1*HOUSE*GREG~SE*4*0002~IEA*1~"),
    )
    return messages.parse_x12_claims(t.orders.select("o_orderkey", text.alias("x")), "o_orderkey", "x").select("o_orderkey", "claim_id", "patient", "provider")


ORDER_ROWS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def round_trip(t, kind: str, writing: dict | None = None, **reading):
    """Orders written in a format and read back."""
    path = scratch_path(t.spark, kind)
    t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").write.format(kind).options(**(writing or {})).save(path)
    return files.read_files(t.spark, path, kind, "o_orderkey long, o_orderstatus string, o_totalprice double", **reading)


@query("src1_read_json_lines", ORDER_ROWS)
def _(t):
    return round_trip(t, "json")


@query("src1_read_orc", ORDER_ROWS)
def _(t):
    return round_trip(t, "orc")


@query("src1_read_xml", ORDER_ROWS)
def _(t):
    return round_trip(t, "xml", {"rowTag": "order", "rootTag": "orders"}, rowTag="order")


@query("src1_read_text", "SELECT o_orderkey || '|' || o_orderstatus AS value FROM orders")
def _(t):
    path = scratch_path(t.spark, "text")
    t.orders.select(F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("value")).write.text(path)
    return files.read_files(t.spark, path, "text")


@query("src1_read_multiline_json", "SELECT o_orderkey, 'C' || o_custkey AS customer FROM orders")
def _(t):
    """Each file holds one array over many lines."""
    path = scratch_path(t.spark, "multiline")
    one = F.concat(F.lit('{\n  "o_orderkey": '), F.col("o_orderkey"), F.lit(',\n  "customer": "C'), F.col("o_custkey"), F.lit('"\n}'))
    lists = t.orders.groupBy(F.pmod(F.col("o_orderkey"), F.lit(997)).alias("k")).agg(F.array_join(F.collect_list(one), ",\n").alias("a"))
    lists.repartitionByRange(4, "k").select(F.concat(F.lit("[\n"), "a", F.lit("\n]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_files(t.spark, path, "json", "o_orderkey long, customer string", multiLine=True)


@query("src3_read_merged_schema", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice FROM orders")
def _(t):
    path = scratch_path(t.spark, "merged")
    t.orders.where("o_orderkey % 2 = 1").select("o_orderkey").write.parquet(f"{path}/a")
    t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice").write.parquet(f"{path}/b")
    return files.read_merged_schema(t.spark, f"{path}/*").select("o_orderkey", "o_totalprice")


@query("src6_read_fixed_width", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def _(t):
    path = scratch_path(t.spark, "fixed")
    t.customer.select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 10, " "), F.rpad("c_mktsegment", 12, " "), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))).write.text(path)
    spec = [{"name": "c_custkey", "start": 1, "length": 10, "type": "bigint"}, {"name": "c_mktsegment", "start": 11, "length": 12}, {"name": "c_nationkey", "start": 23, "length": 4, "type": "int"}]
    return files.read_fixed_width(t.spark, path, spec)


@query("src7_layout_from_copybook", "SELECT c_custkey, round(abs(c_acctbal), 2)::DECIMAL(12, 2)::DOUBLE AS balance FROM customer")
def _(t):
    layout = files.layout_from_copybook("       05 C-CUSTKEY PIC 9(10).\n       05 BALANCE PIC 9(10)V99.\n")
    lines = t.customer.select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lpad(F.round(F.abs("c_acctbal") * 100).cast("long").cast("string"), 12, "0")).alias("value"))
    return files.slice_fixed_width(lines, "value", layout).select("c_custkey", F.col("balance").cast("double").alias("balance"))


@query("src18_audit_log", "SELECT 'orders' AS job, count(*) AS rows_written, 'succeeded' AS status FROM orders")
def _(t):
    path = scratch_path(t.spark, "audited")
    row = files.run_audited(t.orders, path, "orders")
    return t.spark.createDataFrame([(row["job"], row["rows_written"], row["status"])], "job string, rows_written long, status string")


@query("prs7_parse_x12_claims", "SELECT o_orderkey, 'C' || o_orderkey AS claim_id, floor(o_totalprice)::DOUBLE AS amount, '11' AS place, 'FAM' || o_custkey AS patient FROM orders")
def _(t):
    text = t.orders.select("o_orderkey", F.concat(F.lit("ST*837*0001~NM1*IL*1*FAM"), F.col("o_custkey"), F.lit("~CLM*C"), F.col("o_orderkey"), F.lit("*"), F.floor("o_totalprice"), F.lit("***11:B:1~NM1*82*1*DOC*ANN~SE*5*0001~")).alias("x"))
    return messages.parse_x12_claims(text, "o_orderkey", "x").select("o_orderkey", "claim_id", F.col("amount").cast("double").alias("amount"), "place", "patient")


@query("prs8_parse_swift_mt", "SELECT o_orderkey, '103' AS message_type, 'REF' || o_orderkey AS reference, 'ACME ' || o_custkey AS ordering_customer, 'SHA' AS charges FROM orders")
def _(t):
    text = t.orders.select("o_orderkey", F.concat(F.lit("{1:F01BANKXX}{2:I103BANKYY}{4:\n:20:REF"), F.col("o_orderkey"), F.lit("\n:32A:240101USD10,\n:50K:ACME\n"), F.col("o_custkey"), F.lit("\n:71A:SHA\n-}")).alias("m"))
    return messages.parse_swift_mt(text, "m").select("o_orderkey", "message_type", "reference", "ordering_customer", "charges")


@query("prs9_parse_swift_mx", "SELECT o_orderkey, 'FIToFICstmrCdtTrf' AS message_type, 'M' || o_orderkey AS \"MsgId\" FROM orders")
def _(t):
    text = t.orders.select("o_orderkey", F.concat(F.lit('<Document xmlns="urn:x"><FIToFICstmrCdtTrf><GrpHdr><MsgId>M'), F.col("o_orderkey"), F.lit("</MsgId></GrpHdr></FIToFICstmrCdtTrf></Document>")).alias("m"))
    return messages.parse_swift_mx(text, "m", ["MsgId"]).select("o_orderkey", "message_type", "MsgId")


@query("prs10_parse_hl7", "SELECT c_custkey, 'ADT^A01' AS message_type, c_custkey::VARCHAR AS patient_id, c_mktsegment AS family_name FROM customer")
def _(t):
    text = t.customer.select("c_custkey", F.concat(F.lit("MSH|^~\\&|A|B|C|D|202401010101||ADT^A01|1|P|2.5\rPID|1||"), F.col("c_custkey"), F.lit("^^^MRN||"), F.col("c_mktsegment"), F.lit("^JO||19800101|F\rPV1|1|I")).alias("m"))
    return messages.parse_hl7(text, "m").select("c_custkey", "message_type", "patient_id", "family_name")


@query("prs11_flatten_fhir_bundle", "SELECT o_orderkey, unnest(['Patient', 'Claim']) AS resource_type FROM orders")
def _(t):
    text = t.orders.select("o_orderkey", F.concat(F.lit('{"entry":[{"resource":{"resourceType":"Patient","id":"'), F.col("o_custkey"), F.lit('"}},{"resource":{"resourceType":"Claim","status":"active"}}]}')).alias("m"))
    return messages.flatten_fhir_bundle(text, "m").select("o_orderkey", "resource_type")


@query("src4_read_daily_drop", "SELECT o_orderkey, DATE '1995-01-01' + (o_orderkey % 3)::INT AS file_date FROM orders WHERE o_orderkey % 3 > 0")
def _(t):
    path = scratch_path(t.spark, "drop")
    for i in range(3):
        t.orders.where(F.col("o_orderkey") % 3 == i).select("o_orderkey").write.mode("append").option("mapreduce.output.basename", f"orders_1995-01-0{i + 1}").parquet(path)
    return files.read_daily_drop(t.spark, path, "parquet", "1995-01-01").select("o_orderkey", "file_date")


@query("src5_read_modified_since", "SELECT o_orderkey FROM orders")
def _(t):
    path = scratch_path(t.spark, "modified")
    t.orders.select("o_orderkey").write.parquet(path)
    return files.read_modified_since(t.spark, path, "parquet", "2000-01-01T00:00:00", "o_orderkey long")


@query("src5_read_modified_since_mark", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def _(t):
    """Even orders are written before the mark, odd ones after it; marks have whole seconds."""
    import time

    path = scratch_path(t.spark, "modified")
    o = t.orders.select("o_orderkey")
    o.where("o_orderkey % 2 = 0").write.parquet(path)
    time.sleep(1.1)
    mark = t.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
    time.sleep(1.1)
    o.where("o_orderkey % 2 = 1").write.mode("append").parquet(path)
    return files.read_modified_since(t.spark, path, "parquet", mark, "o_orderkey long")


@query("src8_read_jdbc", "SELECT n_nationkey AS \"K\", n_name AS \"NAME\" FROM nation")
def _(t):
    url, driver = "jdbc:derby:memory:quayside_queries;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    t.nation.select(F.col("n_nationkey").alias("K"), F.col("n_name").alias("NAME")).write.jdbc(url, "nation", mode="overwrite", properties={"driver": driver})
    return files.read_jdbc(t.spark, url, "nation", driver, "K", 0, 25, 4)


@query("src11_write_table", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation")
def _(t):
    path = scratch_path(t.spark, "written")
    for _ in range(2):
        files.write_table(t.nation.select("n_nationkey"), path, "orc")
    return files.read_files(t.spark, path, "orc")


@query("src11_write_table_lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def _(t):
    """All lines, then the first of each order once more, into partitions of ORC files."""
    path, li = scratch_path(t.spark, "written"), t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    files.write_table(li, path, "orc", partition_by=["l_returnflag"])
    files.write_table(li.where("l_linenumber = 1"), path, "orc", partition_by=["l_returnflag"])
    return files.read_files(t.spark, path, "orc")


@query("qty2_contract_breaches", "SELECT count(*) AS n, unnest(['o_missing: missing instead of int', 'o_orderkey: bigint instead of string', count(*) || ' rows, fewer than ' || (count(*) + 1)]) AS breach FROM orders")
def _(t):
    from quayside.operators.quality import enforce_contract

    got = enforce_contract(t.orders, columns={"o_missing": "int", "o_orderkey": "string", "o_custkey": dict(t.orders.dtypes)["o_custkey"]}, min_rows=t.orders.count() + 1)
    return t.spark.createDataFrame([(got["rows"], b) for b in got["breaches"]], "n long, breach string")


@query("qty2_enforce_contract", "SELECT count(*) AS n, 1 AS breaches FROM orders")
def _(t):
    from quayside.operators.quality import enforce_contract

    got = enforce_contract(t.orders, columns={"o_orderkey": "bigint", "o_missing": "int"}, ts="o_orderdate", not_before="1990-01-01")
    return t.spark.createDataFrame([(got["rows"], len(got["breaches"]))], "n long, breaches int")


@query("srv1_batch_score")
def _(t):
    from quayside.operators import models as M

    e = t.events.select("event_id", "value", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return M.batch_score(e, M.train(e, "y", ["value"], "logistic", maxIter=5), ["value"], "v7").select("event_id", "score", "model_version")


@query("fea22_materialize_features", "SELECT user_id, arg_max(value, {'t': ts, 'v': value}) AS value FROM events GROUP BY 1")
def _(t):
    from quayside.operators.features import materialize_features, read_features

    e = t.events.select("user_id", F.col("ts").alias("feature_ts"), "value")
    late = materialize_features(None, e.where("feature_ts >= TIMESTAMP '2024-01-15'"), scratch_path(t.spark, "features"), ["user_id"], ["value"])
    table = materialize_features(late, e.where("feature_ts < TIMESTAMP '2024-01-15'"), scratch_path(t.spark, "features"), ["user_id"], ["value"])
    return read_features(e.select("user_id").distinct(), table, ["user_id"], ["value"])
