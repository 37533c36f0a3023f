"""Chat formatting: tool calls linked to their results, put in order, validated and serialised. DataFrame functions only.

Calls and results of a conversation meet in a hash join on the identifier. Calls depend on those whose results their
arguments name (``{"$ref": "<call id>"}`` anywhere in the arguments); their order is topological: level 0 has no
dependency, level n + 1 waits for level n, calls of a cycle and those that wait for one have no level. Levels are settled
in rounds that double the reach (see ``order_calls`` for its bounds), each ending in a written table, so a conversation is
never gathered in one task and a long one takes few rounds. Arguments are checked against a schema per tool, and everything is serialised as canonical JSON:
keys sorted, no blanks, plain numbers without trailing zeros. Numbers with an exponent are read as doubles and written as
such (``1E2`` as ``100.0``, one beyond a double's range as the string ``Infinity``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scratch import discard, materialize

_TYPES = {"string": ["STRING"], "integer": ["BIGINT", "DECIMAL(%,0)"], "number": ["BIGINT", "DECIMAL%", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "array": ["ARRAY%"], "object": ["OBJECT%"], "null": ["VOID"]}


def canonical_json(text: F.Column) -> F.Column:
    """JSON text with sorted keys, without blanks; null for text that isn't JSON."""
    return F.to_json(F.try_parse_json(text))


#: Rules of a schema that are checked; others than these and the notes are refused, so that none is passed over.
_RULES = {"type", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "anyOf"}
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "format", "deprecated"}


def _variant(value: F.Column, kind: str) -> F.Column:
    return F.try_variant_get(value, "$", kind)


def _is(value: F.Column, kind: str) -> F.Column:
    like = F.lit(False)
    for pattern in _TYPES[kind]:
        like = like | F.schema_of_variant(value).like(pattern)
    whole = _variant(value, "double") == F.floor(_variant(value, "double")) if kind == "integer" else F.lit(False)
    return F.coalesce(like | (whole & F.schema_of_variant(value).isin("DOUBLE", "FLOAT")), F.lit(False))


def _one_of(value: F.Column, allowed: list) -> F.Column:
    return F.coalesce(F.to_json(value).isin([json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in allowed]), F.lit(False))


def _problems(rule: dict, value: F.Column, name: str) -> F.Column:
    """An array of messages, one for each rule of a schema that the variant ``value`` breaks."""
    if unknown := set(rule) - _RULES - _NOTES:
        raise ValueError(f"rules that are not checked: {sorted(unknown)}")
    out, more = [], []
    say = lambda bad, what: out.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(what)))
    kinds = [rule["type"]] if isinstance(rule.get("type"), str) else rule.get("type", [])
    if kinds:
        fits = F.lit(False)
        for kind in kinds:
            fits = fits | _is(value, kind)
        say(~fits, f"{name} is not {' or '.join(kinds)}" if name else f"not {' or '.join(kinds)}")
    shown = name or "value"
    number = F.when(_is(value, "number"), _variant(value, "double"))
    text = F.when(_is(value, "string"), _variant(value, "string"))
    items = F.when(_is(value, "array"), _variant(value, "array<variant>"))
    fields = F.when(_is(value, "object"), _variant(value, "map<string,variant>"))
    for key, bad, what in (
        ("minimum", lambda x: number < x, "too small"), ("maximum", lambda x: number > x, "too large"), ("exclusiveMinimum", lambda x: number <= x, "too small"), ("exclusiveMaximum", lambda x: number >= x, "too large"),
        ("minLength", lambda x: F.length(text) < x, "too short"), ("maxLength", lambda x: F.length(text) > x, "too long"), ("pattern", lambda x: ~text.rlike(x), "does not match"),
        ("minItems", lambda x: F.size(items) < x, "too short"), ("maxItems", lambda x: F.size(items) > x, "too long"),
        ("enum", lambda x: ~_one_of(value, x), "not allowed"), ("const", lambda x: ~_one_of(value, [x]), "not allowed"),
    ):
        if key in rule:
            say(bad(rule[key]), f"{shown} {what}")
    below = f"{name}." if name else ""
    properties = rule.get("properties", {})
    for key in sorted(rule.get("required", [])):
        say(~F.map_contains_key(fields, F.lit(key)), f"missing {below}{key}")
    if rule.get("additionalProperties") is False:
        extra = F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in properties]).cast("array<string>"))
        out.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(F.transform(extra, lambda k: F.concat(F.lit(below), k))), " "))))
    for key, inner in sorted(properties.items()):
        found = _problems(inner, F.try_element_at(fields, F.lit(key)), below + key)
        more.append(F.when(F.map_contains_key(fields, F.lit(key)), found))
    if isinstance(rule.get("additionalProperties"), dict):
        rest = F.filter(F.map_values(F.map_filter(fields, lambda k, _: ~k.isin(sorted(properties)))), lambda v: F.lit(True))
        more.append(F.array_distinct(F.flatten(F.transform(rest, lambda v: _problems(rule["additionalProperties"], v, f"{below}*")))))
    if "items" in rule:
        more.append(F.array_distinct(F.flatten(F.transform(items, lambda v: _problems(rule["items"], v, f"{name}[]")))))
    if "anyOf" in rule:
        none = F.lit(True)
        for option in rule["anyOf"]:
            none = none & (F.size(_problems(option, value, name)) > 0)
        say(none, f"{shown} fits no option")
    found = F.array_compact(F.array(F.lit(None).cast("string"), *out))
    nothing = F.array().cast("array<string>")
    for part in more:
        found = F.concat(found, F.coalesce(part, nothing))
    return found


def validate_arguments(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` with ``errors``: what is wrong with ``arguments`` under the schema of ``name``; none: an empty array.

    Checked are the rules of ``_RULES`` at any depth; a schema with another rule raises ValueError. Arguments that are null,
    not JSON or not an object, and unknown tools are errors of their own.
    """
    args = F.try_parse_json("arguments")
    found = F.when(F.col("name").isNull() | ~F.col("name").isin(sorted(schemas)), F.array(F.lit("unknown tool")))
    found = found.when(~_is(args, "object"), F.array(F.lit("arguments are not an object")))
    for name, tool in sorted(schemas.items()):
        found = found.when(F.col("name") == name, _problems(tool, args, ""))
    return calls.withColumn("errors", found)


#: Calls for which a call may wait in a round that replaces them by those that they wait for.
WIDE = 64


def order_calls(calls: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, level)`` for each call whose dependencies (``depends``, ids of calls of the same conversation) can all be
    met. ``keys``: the conversation's columns and the call's identifier, last. Unknown ids are no dependencies. Calls that
    share an identifier are one here, with the dependencies of all of them.

    A level is one more than the highest level among the dependencies. An open call carries its dependencies with a
    distance and the best level known so far. In each round a dependency that is settled is turned into a level, and one
    that itself waits for others is replaced by those, the distances added up (the longest one counts), so the reach of a
    call doubles and n calls in a row, each waiting for one or several before it, take about log2(n) rounds. That holds
    while a call waits for at most WIDE others and has at most WIDE^2 to look at; where it waits for more, only those of its
    dependencies that wait for a single call are replaced, and the round settles those whose turn it is. A call that comes
    to wait for itself, or at a distance beyond the number of calls, is in a cycle.
    """
    group, call = keys[:-1], keys[-1]
    plain = calls.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set("depends"))).alias("depends"))
    known = plain.select(*group, F.col(call).alias("on"))
    edges = plain.select(*keys, F.explode(F.array_distinct("depends")).alias("on")).join(known.hint("shuffle_merge"), [*group, "on"], "left_semi")
    waits = edges.groupBy(*keys).agg(F.collect_set(F.struct("on", F.lit(1).cast("long").alias("w"))).alias("deps"))
    none = F.array().cast("array<struct<on:string,w:bigint>>")
    state = plain.select(*keys).join(waits.hint("shuffle_merge"), keys, "left")
    state = materialize(state.select(*keys, F.lit(0).cast("long").alias("best"), F.coalesce("deps", none).alias("deps"), F.lit(False).alias("stuck")), "levels")
    total, seen = state.count(), None
    while True:
        mark = state.where("size(deps) > 0 and not stuck").agg(F.count("*"), F.sum(F.xxhash64(*keys, F.array_sort("deps")).cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            return state.where("size(deps) = 0").select(*keys, F.col("best").alias("level"))
        seen = mark
        other = state.select(*group, F.col(call).alias("on"), F.col("best").alias("o_best"), F.col("deps").alias("o_deps"), F.col("stuck").alias("o_stuck"))
        dep = state.where("size(deps) > 0 and not stuck").select(*keys, F.size("deps").alias("own"), F.inline("deps"))
        met = dep.join(other.hint("shuffle_merge"), [*group, "on"])
        # Null: it stays as it is. An empty array: it is settled.
        below = F.when(~F.col("o_stuck") & ((F.size("o_deps") <= 1) | ((F.col("own") <= WIDE) & (F.size("o_deps") <= WIDE))), F.col("o_deps"))
        met = met.groupBy(*keys).agg(F.collect_list(F.struct("on", "w", "o_best", below.alias("below"))).alias("met"))
        few = F.aggregate("met", F.lit(0), lambda n, m: n + F.greatest(F.coalesce(F.size(m["below"]), F.lit(1)), F.lit(1))) <= WIDE * WIDE
        met = met.withColumn("few", few)
        passes = lambda m: m["below"].isNotNull() & (F.col("few") | (F.size(m["below"]) <= 1))
        onward = lambda m: F.transform(m["below"], lambda d: F.struct(d["on"].alias("on"), (d["w"] + m["w"]).alias("w")))
        same = lambda m: F.array(F.struct(m["on"].alias("on"), m["w"].alias("w")))
        step = met.select(
            *keys,
            F.flatten(F.transform("met", lambda m: F.when(passes(m), onward(m)).otherwise(same(m)))).alias("pairs"),
            F.array_max(F.transform("met", lambda m: F.when(passes(m), m["o_best"] + m["w"]))).alias("n_best"),
        )
        longest = lambda on: F.array_max(F.transform(F.filter("pairs", lambda p: p["on"] == on), lambda p: p["w"]))
        targets = F.array_distinct(F.transform("pairs", lambda p: p["on"]))
        step = step.withColumn("targets", targets).select(*keys, "n_best", F.transform("targets", lambda on: F.struct(on.alias("on"), longest(on).alias("w"))).alias("n_deps"))
        moved = state.join(step.hint("shuffle_merge"), keys, "left")
        deps = F.when(F.col("n_deps").isNull(), F.col("deps")).otherwise(F.col("n_deps"))
        stuck = F.col("stuck") | F.exists(deps, lambda d: (d["on"] == F.col(call)) | (d["w"] > total))
        before, state = state, materialize(moved.select(*keys, F.greatest("best", F.coalesce("n_best", F.lit(0))).alias("best"), deps.alias("deps"), stuck.alias("stuck")), "levels")
        discard(before)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per result without a call: ``conv_id, call_id, pos, level, status, n_results, errors, message``.

    ``calls``: ``conv_id, call_id, pos, name, arguments`` (JSON text); ``results``: ``conv_id, call_id, pos, content``.
    ``status``: ``linked``, ``unanswered`` or ``orphan`` (a result without a call). Of several results of a call the first
    (by pos, then content) counts; of several calls with one identifier each is linked. Rows with a null conversation or
    identifier link with nothing. ``level`` is null in and behind cycles. ``message`` is canonical JSON. Empty tables give
    no rows; other columns are not looked at.
    """
    c = calls.select("conv_id", "call_id", "pos", "name", "arguments")
    refs = F.regexp_extract_all(F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("")), F.lit(r'\{"\$ref":"((?:[^"\\]|\\.)*)"\}'), F.lit(1))
    c = validate_arguments(c, schemas).withColumn("depends", F.array_sort(F.array_distinct(refs)))
    c = materialize(c, "calls")
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("pos", "content")).alias("r"), F.count("*").alias("n_results"))
    first = first.select("conv_id", "call_id", F.col("r.pos").alias("result_pos"), F.col("r.content").alias("content"), "n_results", F.lit(True).alias("answered"))
    # Rows without a conversation or an identifier meet nobody, and would all meet in one task.
    keys, named = ["conv_id", "call_id"], "conv_id is not null and call_id is not null"
    nameless = f"not ({named})"
    called, answers = c.withColumn("called", F.lit(True)), materialize(first, "answers")
    levels = order_calls(c.where(named), keys)
    met = called.where(named).join(answers.where(named).hint("shuffle_merge"), keys, "left").join(levels.hint("shuffle_merge"), keys, "left")
    orphans = answers.where(named).join(c.where(named).select(*keys).hint("shuffle_merge"), keys, "left_anti")
    linked = met
    for more in (orphans, called.where(nameless), answers.where(nameless)):
        linked = linked.unionByName(more, allowMissingColumns=True)
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    args = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    plain = F.to_json(F.struct("call_id", "content", "conv_id", "depends", "errors", "level", "name", status.alias("status")), {"ignoreNullFields": "false"})
    body = F.when(F.col("called").isNull(), plain).otherwise(F.concat(F.lit('{"arguments":'), args, F.lit(","), F.substr(plain, F.lit(2))))
    return linked.select("conv_id", "call_id", F.coalesce("pos", "result_pos").alias("pos"), "level", status.alias("status"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), body.alias("message"))


#: Schemas of the tools that the query's calls name.
SCHEMAS = {
    "answer": {"properties": {"after": {"type": "object"}, "length": {"type": "integer", "minimum": 1, "maximum": 250}, "prompt": {"type": "string", "minLength": 20}}, "required": ["length", "prompt"], "additionalProperties": False},
}


def op5_tool_call_links(spark, sf_dir: str) -> DataFrame:
    """All conversations: a user's turn calls ``answer`` with its text, after the call of the user's turn before; the
    assistant's turn is the result that names the turn before it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    users = turns.where("role = 'user'").select("conv_id", "turn", "text")
    turn = Window.partitionBy("conv_id").orderBy("turn")
    calls = users.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("prior", F.lag("turn").over(turn))
    call_id = lambda c: F.concat(F.lit("call-"), F.col(c).cast("string"))
    args = F.to_json(F.struct(F.when(F.col("prior").isNotNull(), F.struct(call_id("prior").alias("$ref"))).alias("after"), F.length("text").alias("length"), F.col("text").alias("prompt")))
    calls = calls.select("conv_id", call_id("turn").alias("call_id"), F.col("turn").alias("pos"), F.lit("answer").alias("name"), args.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    out = link_tool_calls(calls, results, SCHEMAS)
    return out.select("conv_id", "call_id", "pos", "level", "status", "n_results", F.array_join("errors", "; ").alias("errors"), F.sha2("message", 256).alias("message_sha256"), F.length("message").cast("long").alias("message_chars"))


OP5_SQL = r"""
WITH u AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id, turn),
c AS (
  SELECT conv_id, 'call-' || turn AS call_id, turn AS pos, text, lag(turn) OVER w AS prior, row_number() OVER w - 1 AS level
  FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (
  SELECT conv_id, 'call-' || (turn - 1) AS call_id, min_by(text, {'t': turn, 'x': text}) AS content, min(turn) AS result_pos, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.pos, r.result_pos) AS pos, level, text, prior, content,
    coalesce(n_results, 0) AS n_results, c.call_id IS NOT NULL AS called,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM c FULL OUTER JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
e AS (
  SELECT *, list_filter([
    CASE WHEN called AND text IS NULL THEN 'missing length' END, CASE WHEN called AND text IS NULL THEN 'missing prompt' END,
    CASE WHEN length(text) < 1 THEN 'length too small' END, CASE WHEN length(text) > 250 THEN 'length too large' END,
    CASE WHEN length(text) < 20 THEN 'prompt too short' END], lambda x: x IS NOT NULL) AS errors FROM j),
m AS (
  SELECT *,
    CASE WHEN called THEN '{"arguments":{' || CASE WHEN prior IS NULL THEN '' ELSE '"after":{"$ref":"call-' || prior || '"},' END
      || CASE WHEN text IS NULL THEN '' ELSE '"length":' || length(text) || ',"prompt":' || to_json(text) END || '},' ELSE '{' END
    || '"call_id":' || to_json(call_id) || ',"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"conv_id":' || conv_id
    || ',"depends":' || CASE WHEN NOT called THEN 'null' WHEN prior IS NULL THEN '[]' ELSE '["call-' || prior || '"]' END
    || ',"errors":' || CASE WHEN called THEN to_json(errors)::VARCHAR ELSE 'null' END || ',"level":' || coalesce(level::VARCHAR, 'null')
    || ',"name":' || CASE WHEN called THEN '"answer"' ELSE 'null' END || ',"status":"' || status || '"}' AS message FROM e)
SELECT conv_id, call_id, pos, level, status, n_results, array_to_string(errors, '; ') AS errors, sha256(message) AS message_sha256, length(message)::BIGINT AS message_chars FROM m
"""
