"""Chat formatting with linked tool calls, in DataFrame expressions only.

Convention: an assistant turn may hold <tool_call>{"id", "name", "arguments"}</tool_call>
blocks; a turn of the role "tool" holds {"tool_call_id", "content"}.  Calls and
results meet in a hash join on conversation and identifier.  A topological order
of a conversation follows from keys that each row carries, so no conversation is
ever gathered: a message stands at its own turn, a linked result right after its
call, in the order of the calls.  Arguments are checked against schemas, and each
message becomes canonical JSON: sorted keys, no spaces, no nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
#: Parameters by tool: type name and whether it is required.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "unit": ("string", False)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
}
# What a variant calls the JSON types.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL.*|DOUBLE)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether arguments (a JSON object as text) suit the tool: known tool, required ones there, types right, no others."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    verdict = F.lit(False)
    for tool, parameters in schemas.items():
        good = keys.isNotNull()
        for parameter, (kind, required) in parameters.items():
            is_kind = F.schema_of_variant(F.try_variant_get(value, f"$.{parameter}", "variant")).rlike(TYPES[kind])
            there = F.array_contains(keys, parameter)
            good = good & (F.coalesce(there & is_kind, F.lit(False)) | (F.lit(not required) & ~F.coalesce(there, F.lit(False))))
        others = F.size(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]))) == 0
        verdict = F.when(name == tool, F.coalesce(good & others, F.lit(False))).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def calls_in(text: Column, schemas) -> Column:
    """The calls of a text, in order, as structs with arguments, id, name and valid."""

    def call(block: Column) -> Column:
        name, arguments = F.get_json_object(block, "$.name"), F.get_json_object(block, "$.arguments")
        return F.struct(
            F.try_parse_json(arguments).alias("arguments"),
            F.get_json_object(block, "$.id").alias("id"),
            name.alias("name"),
            valid_arguments(name, arguments, schemas).alias("valid"),
        )

    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(CALL), 1), well_formed), call)


def well_formed(block: Column) -> Column:
    """Whether a block holds a JSON object that names a tool."""
    value = F.try_parse_json(block)
    return F.coalesce(F.schema_of_variant(value).rlike("^OBJECT<") & F.get_json_object(block, "$.name").isNotNull(), F.lit(False))


def without_calls(text: Column) -> Column:
    """The text around its calls; blocks that are no calls stay, as they are text."""
    between = F.split(text, CALL)
    blocks = F.transform(F.regexp_extract_all(text, F.lit(CALL), 1), lambda b: F.when(well_formed(b), F.lit("")).otherwise(F.concat(F.lit("<tool_call>"), b, F.lit("</tool_call>"))))
    return F.trim(F.array_join(F.zip_with(between, blocks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def canonical_content(text: Column) -> Column:
    """A result's content as a value: texts, numbers, lists and objects stay what they are, keys in order; null where there is none."""
    value = F.try_variant_get(F.try_parse_json(text), "$.content", "variant")
    as_text = F.try_variant_get(F.try_parse_json(F.to_json(F.array(F.get_json_object(text, "$.content")))), "$[0]", "variant")
    return F.when(~F.is_variant_null(F.coalesce(value, as_text)), F.coalesce(value, as_text))


def calls(turns: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """(conv_id, turn, call, id, name, arguments, valid): one row for each call."""
    text = F.coalesce("text", F.lit(""))
    some = turns.filter((F.col("role") == "assistant") & text.contains("<tool_call>"))
    each = some.select("conv_id", "turn", F.posexplode(calls_in(text, schemas)).alias("call", "c"))
    return each.select("conv_id", "turn", "call", "c.id", "c.name", F.to_json("c.arguments").alias("arguments"), "c.valid")


def format_chat(turns: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """(conv_id, turn, role, kind, order_turn, order_step, n_calls, n_valid, json) for every row of turns.

    kind is message, call, result, or orphan (a result without a call).  Sorting
    a conversation by order_turn, order_step, turn gives the topological order.
    If calls share an identifier, the first call of the conversation has it; a
    result before its call moves behind it; blocks that hold no object with a name are
    text, as they stand; null texts count as empty, null roles as "user"; turns
    without a conv_id are one conversation; repeated rows stay; texts of any length are
    read whole; no rows give no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"))
    has_calls = (F.col("role") == "assistant") & F.col("text").contains("<tool_call>")
    is_result = F.coalesce((F.col("role") == "tool") & F.get_json_object("text", "$.tool_call_id").isNotNull(), F.lit(False))
    columns = ["conv_id", "turn", "role", "kind", "order_turn", "order_step", "n_calls", "n_valid", "json"]
    zero = F.lit(0).cast("long")

    found = F.transform(F.array(calls_in(F.col("text"), schemas)), lambda c: c).getItem(0)
    own = base.filter(~is_result).withColumn("c", F.when(has_calls, found))
    content = F.when(has_calls, without_calls(F.col("text"))).otherwise(F.col("text"))
    listed = F.when(F.size("c") > 0, F.transform("c", lambda c: F.struct(c.getField("arguments").alias("arguments"), c.getField("id").alias("id"), c.getField("name").alias("name"))))
    messages = own.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.size("c") > 0, "call").otherwise("message").alias("kind"),
        F.col("turn").cast("long").alias("order_turn"),
        zero.alias("order_step"),
        F.greatest(F.coalesce(F.size("c"), F.lit(0)), F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce(F.size(F.filter("c", lambda c: c.getField("valid"))), F.lit(0)).cast("long").alias("n_valid"),
        F.to_json(F.struct(content.alias("content"), F.col("role").alias("role"), listed.alias("tool_calls"))).alias("json"),
    )

    first = calls(base, schemas).filter("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "call", "valid")).alias("c"))
    results = base.filter(is_result).withColumn("id", F.get_json_object("text", "$.tool_call_id"))
    named = first.withColumnsRenamed({"conv_id": "conv_of", "id": "id_of"}).hint("shuffle_hash")
    linked = results.join(named, F.col("conv_id").eqNullSafe(F.col("conv_of")) & (F.col("id") == F.col("id_of")), "left")
    is_linked = F.col("c").isNotNull()
    answers = linked.select(
        "conv_id",
        "turn",
        "role",
        F.when(is_linked, "result").otherwise("orphan").alias("kind"),
        F.coalesce(F.col("c.turn"), F.col("turn")).cast("long").alias("order_turn"),
        F.when(is_linked, F.col("c.call") + 1).otherwise(0).cast("long").alias("order_step"),
        zero.alias("n_calls"),
        F.when(F.col("c.valid"), 1).otherwise(0).cast("long").alias("n_valid"),
        F.to_json(F.struct(canonical_content(F.col("text")).alias("content"), F.col("role").alias("role"), F.col("id").alias("tool_call_id"))).alias("json"),
    )
    return messages.select(*columns).unionByName(answers.select(*columns))


#: Over tables without tool turns; the linking itself is tested on a fixture.
ORACLE = """
SELECT conv_id, turn, coalesce(role, 'user') AS role, 'message' AS kind, turn AS order_turn, 0::BIGINT AS order_step,
       0::BIGINT AS n_calls, 0::BIGINT AS n_valid,
       '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(coalesce(role, 'user'))::VARCHAR || '}' AS json
FROM conversations
"""

#: Over conversations turned into calls and results (queries.tool_turns): links, their order, the schema's verdicts.
LINKED_ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, turn % 2 = 0 AS is_call, 'c' || conv_id || '-' AS c FROM conversations),
calls AS (SELECT conv_id, turn, c || turn AS id, turn % 3 <> 0 AS valid, CASE WHEN turn % 3 = 0 THEN '{"limit":3}' ELSE '{"limit":2,"query":"q' || turn || '"}' END AS arguments FROM t WHERE is_call),
results AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'none' ELSE c || (turn - 1) END AS id FROM t WHERE NOT is_call)
SELECT conv_id, turn, 'assistant' AS role, 'call' AS kind, turn AS order_turn, 0::BIGINT AS order_step, 1::BIGINT AS n_calls, valid::BIGINT AS n_valid,
'{"content":"Look.","role":"assistant","tool_calls":[{"arguments":' || arguments || ',"id":"' || id || '","name":"search"}]}' AS json FROM calls
UNION ALL SELECT r.conv_id, r.turn, 'tool', CASE WHEN k.id IS NULL THEN 'orphan' ELSE 'result' END, coalesce(k.turn, r.turn), CASE WHEN k.id IS NULL THEN 0 ELSE 1 END, 0, coalesce(valid, false)::BIGINT,
'{"content":"r' || r.turn || '","role":"tool","tool_call_id":"' || r.id || '"}' FROM results r LEFT JOIN calls k ON r.conv_id = k.conv_id AND r.id = k.id
"""
