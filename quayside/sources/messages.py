"""Message logs as columns: FIX, X12 claims, SWIFT MT and MX, HL7, FHIR bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOH = "\x01"
#: Names of FIX tags, by tag, and of SWIFT fields.
FIX_TAGS = {
    "8": "BeginString", "9": "BodyLength", "10": "CheckSum", "11": "ClOrdID", "31": "LastPx", "32": "LastQty", "34": "MsgSeqNum", "35": "MsgType", "37": "OrderID", "38": "OrderQty",
    "39": "OrdStatus", "40": "OrdType", "44": "Price", "49": "SenderCompID", "52": "SendingTime", "54": "Side", "55": "Symbol", "56": "TargetCompID", "150": "ExecType",
}
SWIFT_FIELDS = {"20": "reference", "32A": "value_date_currency_amount", "50K": "ordering_customer", "59": "beneficiary", "71A": "charges"}


def _last(pairs: Column, tag: str) -> Column:
    """The last value of a tag among ``(tag, value)`` pairs."""
    return F.try_element_at(F.filter(pairs, lambda p: p["tag"] == tag), F.lit(-1))["value"]


def _named(pairs: Column, names: dict[str, str], other: str) -> Column:
    """All pairs in their order as ``(name, value)``; unnamed tags as ``other`` and the tag."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform(pairs, lambda p: F.struct(F.coalesce(F.try_element_at(known, p["tag"]), F.concat(F.lit(other), p["tag"])).alias("name"), p["value"].alias("value")))


def parse_fix_log(df: DataFrame, column: str, message_types: list[str] | None = None, others: list[str] = ()) -> DataFrame:
    """A column per named tag and ``Tag<n>`` for each of ``others``; null where a message lacks it. Of a repeated tag (a
    repeating group) the column has the last value; ``fields`` has every pair in its order, unnamed tags as ``Tag<n>``.
    Pieces without ``=`` are passed over; null messages give no row, empty ones a row of nulls."""
    parts = F.filter(F.split(F.col(column), SOH), lambda x: x.contains("="))
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("tag"), F.substr(x, F.instr(x, "=") + 1).alias("value")))
    tags = FIX_TAGS | {t: f"Tag{t}" for t in others}
    rows = df.where(F.col(column).isNotNull()).withColumn("_m", pairs)
    rows = rows.where(_last(F.col("_m"), "35").isin(message_types)) if message_types else rows
    return rows.select(*[c for c in df.columns if c != column], *[_last(F.col("_m"), t).alias(n) for t, n in tags.items()], _named(F.col("_m"), FIX_TAGS, "Tag").alias("fields"))


def parse_x12_claims(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, claim_id, amount, place, patient, provider)``: a row per CLM segment. The patient is that of the last NM1*IL
    before it, the provider that of the first NM1*82 behind it, both within its transaction set: ST opens one and SE closes
    it, and what stands between sets is read as a set of its own. Null texts give no rows. Each text is read inside its row:
    nothing is shuffled, and rows of equal keys stay apart."""
    claim = "struct<claim_id:string,amount:decimal(18,2),place:string,patient:string,provider:string>"
    at = lambda e, i: F.try_element_at(e, F.lit(i + 1))
    name = lambda e: F.trim(F.concat_ws(" ", at(e, 4), at(e, 3)))
    kind = lambda e: F.when(at(e, 0) == "NM1", F.concat_ws("*", at(e, 0), at(e, 1))).otherwise(at(e, 0))
    parts = F.transform(F.split(F.regexp_replace(column, r"[\r\n]", ""), "~"), lambda s: F.split(F.trim(s), r"\*"))
    parts = F.filter(parts, lambda e: kind(e).isin("ST", "SE", "CLM", "NM1*IL", "NM1*82"))
    state = f"struct<done:array<{claim}>,open:{claim},patient:string>"
    as_state = lambda done, open_, patient: F.struct(done.alias("done"), open_.alias("open"), patient.alias("patient")).cast(state)
    closed = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    def step(acc: Column, e: Column) -> Column:
        now = acc["open"]
        opened = F.struct(
            at(e, 1).alias("claim_id"), at(e, 2).try_cast("decimal(18,2)").alias("amount"), F.split(at(e, 5), ":")[0].alias("place"),
            acc["patient"].alias("patient"), F.lit(None).cast("string").alias("provider"),
        )
        treated = F.when(now.isNotNull(), now.withField("provider", F.coalesce(now["provider"], name(e))))
        return (
            F.when(kind(e).isin("ST", "SE"), as_state(closed(acc), F.lit(None).cast(claim), F.lit(None).cast("string")))
            .when(kind(e) == "CLM", as_state(closed(acc), opened, acc["patient"]))
            .when(kind(e) == "NM1*IL", as_state(acc["done"], now, name(e)))
            .otherwise(as_state(acc["done"], treated, acc["patient"]))
        )

    start = as_state(F.array().cast(f"array<{claim}>"), F.lit(None).cast(claim), F.lit(None).cast("string"))
    found = F.aggregate(parts, start, step, closed)
    return df.select(key, F.explode(found).alias("_c")).select(key, "_c.*")


def parse_swift_mt(df: DataFrame, column: str) -> DataFrame:
    """Message type of block 2 and the fields of block 4: ``fields`` has every one in its order, unnamed ones as
    ``Field<n>``; the named columns have the last value of a repeated field (statements repeat ``:61:``)."""
    body = F.regexp_extract(column, r"(?s)\{4:\s*(.*?)-\}", 1)
    keys = F.regexp_extract_all(body, F.lit(r"(?m)^:(\d{2}[A-Z]?):"), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(r"(?s):\d{2}[A-Z]?:(.*?)(?=\n:\d{2}[A-Z]?:|\z)"), F.lit(1)), lambda v: F.trim(F.regexp_replace(v, r"[\r\n]+", " ")))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("tag"), v.alias("value")))
    made = df.withColumn("message_type", F.regexp_extract(column, r"\{2:[IO](\d{3})", 1)).withColumn("_f", pairs)
    return made.select(*df.columns, "message_type", _named(F.col("_f"), SWIFT_FIELDS, "Field").alias("fields"), *[_last(F.col("_f"), k).alias(n) for k, n in SWIFT_FIELDS.items()])


def parse_swift_mx(df: DataFrame, column: str, leaves: list[str]) -> DataFrame:
    """Type (the first element under Document) and the first leaf of each name, whatever the namespace."""
    bare = F.regexp_replace(F.regexp_replace(column, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1")
    return df.withColumn("_x", bare).select(*df.columns, F.regexp_extract("_x", r"<Document>\s*<(\w+)", 1).alias("message_type"), *[F.nullif(F.xpath_string("_x", F.lit(f"string((//{n})[1])")), F.lit("")).alias(n) for n in leaves]).drop("_x")


def parse_hl7(df: DataFrame, column: str) -> DataFrame:
    """Message type and time, patient and visit of HL7 version 2 messages (segments by line, fields by |, parts by ^)."""
    lines = F.split(F.regexp_replace(column, r"\r\n?", "\n"), "\n")
    seg = lambda name: F.split(F.try_element_at(F.filter(lines, lambda x: x.startswith(name + "|")), F.lit(1)), r"\|")
    field = lambda s, i: F.try_element_at(s, F.lit(i + 1))
    part = lambda c, i: F.try_element_at(F.split(c, r"\^"), F.lit(i))
    msh, pid, pv1 = seg("MSH"), seg("PID"), seg("PV1")
    return df.select(*df.columns, field(msh, 8).alias("message_type"), field(msh, 6).alias("message_time"), part(field(pid, 3), 1).alias("patient_id"), part(field(pid, 5), 1).alias("family_name"), part(field(pid, 5), 2).alias("given_name"), field(pid, 7).alias("birth_date"), field(pid, 8).alias("sex"), field(pv1, 2).alias("patient_class"))


def flatten_fhir_bundle(df: DataFrame, column: str) -> DataFrame:
    """A row per resource of a bundle: type, id, status, subject, and the resource's JSON."""
    entry = F.from_json(F.get_json_object(column, "$.entry"), "array<struct<resource:string>>")
    rows = df.select(*[c for c in df.columns if c != column], F.explode(entry).alias("e"))
    get = lambda p: F.get_json_object("e.resource", p)
    return rows.select(*[c for c in df.columns if c != column], get("$.resourceType").alias("resource_type"), get("$.id").alias("id"), get("$.status").alias("status"), get("$.subject.reference").alias("subject"), F.col("e.resource").alias("resource"))
