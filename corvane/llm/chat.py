"""Conversations in canonical JSON, with tool calls linked to their results, by DataFrame functions alone.

Messages are rows (conv_id, turn, role, text). An assistant's text may be a JSON object with tool_calls, a list of
{id, name, arguments}, and content; a tool's text may be a JSON object with tool_call_id and content. Any other text is
plain content, also JSON that names a member twice. Calls and results are joined by (conv_id, id): a result belongs to
the earliest call with its id, further calls with that id get no link. Messages are in topological order: by turn, but a
result that stands before its call comes directly after it. Arguments, an object or the JSON text of one, are checked
against the JSON schema of the named tool (see schemas; a keyword that is not supported is an error, never ignored); a
call of an unknown tool is invalid if tools are given, and null otherwise.

JSON is canonical: members sorted by name, no white space, nulls written. Every member that a call's or result's message
has stays, nested ones too; the role is the row's, and content is null where it is absent. There is one row for each
message, never one for a conversation, as a conversation can be of any length: messages are sorted over ranges of rows,
and positions, which count from 0, follow from the sizes of the ranges.

A null text is JSON null, a null role too; rows with null conv_id form one conversation, rows with null turn come first.
Rows that repeat stay and have neighbouring positions. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json as json_text

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schemas, scratch

CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: variant>>, tool_call_id: string>"
#: Tools whose schemas the driver compiles; more are an error.
MOST_TOOLS = 2000
_LEAST = -(1 << 63)


def validity(calls: DataFrame, tools: DataFrame | None) -> DataFrame:
    """calls (name, arguments variant, ...) with valid. tools: name and parameters, a JSON schema as text (null: any object).

    Tools are a registry, not data: their schemas become expressions. Of repeated names the least schema counts.
    """
    if tools is None:
        return calls.withColumn("valid", F.lit(None).cast("boolean"))
    known = tools.where("name is not null").groupBy(F.col("name").cast("string").alias("name")).agg(F.min(F.col("parameters").cast("string")).alias("parameters"))
    rows = known.orderBy("name").limit(MOST_TOOLS + 1).collect()
    if len(rows) > MOST_TOOLS:
        raise ValueError(f"more than {MOST_TOOLS} tools")
    out = None
    for r in rows:
        schema = json_text.loads(r["parameters"]) if r["parameters"] is not None else True
        fit = schemas.fits(schema, F.col("_given"))
        mine = F.col("name") == r["name"]
        out = F.when(mine, fit) if out is None else out.when(mine, fit)
    is_text = F.schema_of_variant("arguments") == "STRING"
    given = F.when(is_text, F.try_parse_json(F.try_variant_get("arguments", "$", "string"))).otherwise(F.col("arguments"))
    is_object = F.coalesce(F.schema_of_variant("_given").startswith("OBJECT"), F.lit(False))
    found = F.coalesce(out, F.lit(False)) if out is not None else F.lit(False)
    return calls.withColumn("_given", given).withColumn("valid", is_object & found).drop("_given")


def _quoted(text: Column) -> Column:
    """A JSON string."""
    shown = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(shown.substr(F.lit(6), F.length(shown) - 6))


def _object(text: Column, role: Column) -> Column:
    """The JSON object in text, canonical, with this role and with content."""
    found = F.from_json(F.to_json(F.try_parse_json(text)), "map<string, variant>")
    given = F.transform(F.map_entries(found), lambda e: F.struct(e["key"].alias("k"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("v")))
    rest = F.filter(given, lambda e: e["k"] != "role")
    fixed = F.when(F.map_contains_key(found, "content"), F.array(F.struct(F.lit("role").alias("k"), _quoted(role).alias("v"))))
    fixed = fixed.otherwise(F.array(F.struct(F.lit("content").alias("k"), F.lit("null").alias("v")), F.struct(F.lit("role").alias("k"), _quoted(role).alias("v"))))
    members = F.array_sort(F.concat(rest, fixed))
    return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def positions(df: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """df with position: the place of each row in its group, by keys (nulls first). Rows are sorted over ranges, so a
    group of any size is spread, and rows with equal keys too; only one count a range comes to the driver."""
    spark = df.sparkSession
    order = [F.col(c).asc_nulls_first() for c in [group, *keys, "_tie"]]
    df = scratch.keep(df.withColumn("_tie", F.monotonically_increasing_id()), "ordered")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    # Written once: its ranges would differ if it were made again.
    ranged = scratch.keep(ranged, "ranges")
    part, local = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in sorted(ranged.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    offset = spark.createDataFrame(offsets, "_part long, _before long")
    placed = ranged.withColumns({"_part": part, "_local": local}).join(F.broadcast(offset), "_part").withColumn("_at", F.col("_before") + F.col("_local"))
    first = scratch.keep(placed.groupBy(group).agg(F.min("_at").alias("_first")), "firsts")
    return placed.join(first, group).withColumn("position", F.col("_at") - F.col("_first")).drop("_tie", "_m", "_part", "_before", "_local", "_at", "_first")


def format_chat(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, position, role, n_calls, n_answered, args_valid, call_turn, json for each message."""
    text, role = F.col("text").cast("string"), F.col("role").cast("string")
    is_json = role.isin("assistant", "tool") & F.startswith(F.ltrim(text), F.lit("{")) & F.try_parse_json(text).isNotNull()
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(is_json, F.from_json(text, CALLS)).alias("p"))
    conv = F.coalesce("conv_id", F.lit(_LEAST)).alias("conv")
    at = F.coalesce("turn", F.lit(_LEAST))
    has_calls = (F.col("role") == "assistant") & (F.size("p.tool_calls") > 0)
    calls = rows.where(has_calls).select(conv, at.alias("at"), "role", "text", F.posexplode("p.tool_calls").alias("k", "c")).select("conv", "at", "role", "text", "k", "c.id", "c.name", "c.arguments")
    results = rows.where("role = 'tool' and p.tool_call_id is not null").select(conv, at.alias("result_at"), F.col("p.tool_call_id").alias("id"))
    # One row for each id on either side, combined before the shuffle; then a join by identifier.
    first = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("at", "k", "text")).alias("first"), F.min("at").alias("call_at"))
    answered = results.groupBy("conv", "id").agg(F.count(F.lit(1)).alias("n"))
    linked = first.join(answered.hint("shuffle_hash"), ["conv", "id"])
    checked = validity(calls.join(linked.select("conv", "id", "first", "n"), ["conv", "id"], "left"), tools)
    mine = (F.col("first.at") == F.col("at")) & (F.col("first.k") == F.col("k")) & (F.col("first.text") == F.col("text"))
    # Equal messages at one turn have equal calls, so distinct ones are enough.
    per_message = checked.groupBy("conv", "at", "text").agg(F.count_distinct(F.when(mine, F.col("k"))).alias("n_answered"), F.min("valid").alias("args_valid"))
    base = rows.withColumns({"conv": conv, "at": at, "result_id": F.when(F.col("role") == "tool", F.col("p.tool_call_id")), "n_calls": F.when(has_calls, F.size("p.tool_calls")).otherwise(0).cast("long")})
    base = base.withColumns({"is_call": F.col("n_calls") > 0, "is_result": F.col("result_id").isNotNull()})
    base = base.join(first.select("conv", F.col("id").alias("result_id"), "call_at"), ["conv", "result_id"], "left")
    calling = base.where("n_calls > 0").join(per_message, ["conv", "at", "text"], "left")
    plain = base.where("n_calls = 0").withColumns({"n_answered": F.lit(0).cast("long"), "args_valid": F.lit(None).cast("boolean")})
    all_rows = calling.unionByName(plain)
    # A result goes behind its call; among results of one call, by turn.
    placed = all_rows.withColumns({"topo": F.greatest("at", F.coalesce("call_at", "at")), "late": (F.coalesce("call_at", "at") >= F.col("at")).cast("int") * F.col("call_at").isNotNull().cast("int")})
    placed = placed.drop("p", "result_id")
    numbered = positions(placed, "conv", ["topo", "late", "at", "role", "text"])
    plain_json = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    json = F.when(F.col("is_call") | F.col("is_result"), _object(F.col("text"), F.col("role"))).otherwise(plain_json)
    call_turn = F.when(F.col("call_at") == _LEAST, F.lit(None)).otherwise(F.col("call_at"))
    return numbered.select("conv_id", "turn", F.col("position").cast("long").alias("position"), "role", "n_calls", "n_answered", "args_valid", call_turn.cast("long").alias("call_turn"), json.alias("json"))


#: What chat_tool_calls makes of the conversations: each assistant's message calls a tool, most calls have a result,
#: half of these stand before their call. The same rule stands in TOOL_SQL.
TOOLS = [("lookup", '{"type": "object", "required": ["limit", "query"], "additionalProperties": false, "properties": {"limit": {"type": "integer", "minimum": 1, "maximum": 10}, "mode": {"enum": ["fast", "exact"]}, "query": {"type": "string", "minLength": 1}}}')]


def with_tool_traffic(messages: DataFrame) -> DataFrame:
    """Conversations in which assistants call tools, derived row by row: the input of chat_tool_calls."""
    n, call = F.length("text"), F.concat(F.lit("call_"), F.col("turn").cast("string"))
    arguments = F.struct(F.col("text").alias("query"), F.element_at(F.array(F.lit("fast"), F.lit("exact"), F.lit("odd")), (n % 3 + 1).cast("int")).alias("mode"), (n % 12).cast("long").alias("limit"))
    one = F.struct(F.when(F.col("turn") % 5 == 4, "unknown").otherwise("lookup").alias("name"), call.alias("id"), arguments.alias("arguments"))
    asked = F.to_json(F.struct(F.array(one).alias("tool_calls"), F.col("text").alias("content"), n.alias("weight")))
    answer = F.to_json(F.struct(call.alias("tool_call_id"), F.lit("ok").alias("status"), F.substring("text", 1, 20).alias("content")))
    is_call = F.coalesce((F.col("role") == "assistant") & F.col("text").isNotNull() & F.col("turn").isNotNull(), F.lit(False))
    calls = messages.select("conv_id", "turn", "role", F.when(is_call, asked).otherwise(F.col("text")).alias("text"))
    results = messages.where(is_call & (n % 7 != 0)).select("conv_id", F.when(n % 2 == 0, F.col("turn") - 1).otherwise(F.col("turn") + 1).alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    return calls.unionByName(results)


TOOL_SQL = """
WITH m AS (SELECT conv_id, turn, role, text, length(text) AS n, coalesce(role = 'assistant' AND text IS NOT NULL AND turn IS NOT NULL, false) AS is_call FROM conversations),
a AS (
    SELECT conv_id, turn, role, text AS t, turn AS topo, 0 AS late, CAST(NULL AS BIGINT) AS call_turn, CAST(is_call AS BIGINT) AS n_calls,
           CAST(is_call AND n % 7 <> 0 AS BIGINT) AS n_answered,
           CASE WHEN is_call THEN turn % 5 <> 4 AND n % 12 BETWEEN 1 AND 10 AND n % 3 < 2 AND n >= 1 END AS args_valid,
           CASE WHEN is_call THEN CAST(to_json({'content': text, 'role': role, 'tool_calls': [{'arguments': {'limit': n % 12, 'mode': ['fast', 'exact', 'odd'][n % 3 + 1], 'query': text},
               'id': 'call_' || turn, 'name': CASE WHEN turn % 5 = 4 THEN 'unknown' ELSE 'lookup' END}], 'weight': n}) AS VARCHAR)
                ELSE CAST(to_json({'content': text, 'role': role}) AS VARCHAR) END AS json
    FROM m
    UNION ALL
    SELECT conv_id, CASE WHEN n % 2 = 0 THEN turn - 1 ELSE turn + 1 END, 'tool', '', CASE WHEN n % 2 = 0 THEN turn ELSE turn + 1 END, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END, turn, 0, 0, NULL,
           CAST(to_json({'content': left(text, 20), 'role': 'tool', 'status': 'ok', 'tool_call_id': 'call_' || turn}) AS VARCHAR)
    FROM m WHERE is_call AND n % 7 <> 0)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY topo NULLS FIRST, late, turn NULLS FIRST, role NULLS FIRST, t NULLS FIRST) - 1 AS BIGINT) AS position,
       role, n_calls, n_answered, args_valid, call_turn, json FROM a
"""

#: The same for conversations without tool messages, as they are in the conversations table.
SQL = """
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS BIGINT) AS position,
       role, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_answered, CAST(NULL AS BOOLEAN) AS args_valid, CAST(NULL AS BIGINT) AS call_turn,
       CAST(to_json({'content': text, 'role': role}) AS VARCHAR) AS json
FROM conversations
"""
