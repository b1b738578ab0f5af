"""Chat formatting with tool-call linking, in DataFrame functions only.

Messages (``conv_id, turn, role, text``) become *events*: calls, results and notes. A text that is a JSON object, white space
around it aside, with ``tool_call`` (``id, name, arguments, after``) or ``tool_result`` (``id, content``) says so itself. In a
plain dialogue a user turn is a call of the tool ``reply`` whose arguments are its text and number of words, identified by
conversation and turn, and an assistant turn is a result for the latest user turn before it.

Calls and results meet by a hash join on (conversation, identifier); either side is reduced to one row per identifier
first, so repeated results of one call cannot multiply. Arguments are validated against a schema per tool: required fields,
types, bounds, and no field that the schema lacks. Events are put in topological order: a call comes after the calls that it
names in ``after``, a result after its call. Order by turn is such an order wherever all of these lie earlier; conversations
where one does not are ordered by Kahn's rounds, which go on until no event is ready. Every event is written as canonical
JSON: keys in code-point order, no spaces, the content of a ``tool_result`` included.

A conversation may hold a third of all rows: places and latest turns are computed in blocks of ``BLOCK`` turns, and only
one row per block is ordered per conversation.

Defined cases: null text is the empty text; a null role is a note; events of a null conversation or turn keep their nulls
and are never linked; equal (conversation, turn) pairs follow one another by role and text; calls in a cycle, and what
waits for them, come last, by turn; an identifier that several calls share is ready when the first of them is; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.registry import query
from docweft.llm.words import n_words
from docweft.session import durable, release, table

BLOCK = 512
#: Per tool, its fields with type, whether required, and a bound on length or value.
SCHEMAS: dict[str, dict[str, tuple[str, bool, int | None]]] = {
    "reply": {"n_words": ("BIGINT", True, 4000), "text": ("STRING", True, 8000)},
    "search": {"query": ("STRING", True, 1000), "limit": ("BIGINT", False, 100)},
    "fetch": {"url": ("STRING", True, 2000)},
}


def _at(document: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(document, path, kind)


def valid_arguments(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """Whether the variant ``arguments`` fits its tool's schema; false for unknown tools."""
    out = None
    for tool, fields in schemas.items():
        fits = F.lit(True)
        for field, (kind, required, most) in fields.items():
            value = F.try_variant_get(arguments, f"$.{field}", "variant")
            there = value.isNotNull()
            typed = F.schema_of_variant(value) == kind
            if most is not None:
                size = F.length(_at(arguments, f"$.{field}")) if kind == "STRING" else _at(arguments, f"$.{field}", "bigint")
                low = F.lit(0) if kind == "STRING" else F.lit(1)
                typed = typed & (size <= most) & (size >= low)
            fits = fits & F.when(there, F.coalesce(typed, F.lit(False))).otherwise(F.lit(not required))
        keys = F.map_keys(F.try_variant_get(arguments, "$", "map<string,variant>"))
        fits = fits & F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) == 0, F.lit(False))
        out = F.when(name == tool, fits) if out is None else out.when(name == tool, fits)
    return F.coalesce(out, F.lit(False))


def _blocked(frame: DataFrame) -> DataFrame:
    return frame.withColumn("_block", F.floor(F.col("turn") / BLOCK))


def latest_user_turn(messages: DataFrame) -> DataFrame:
    """Adds ``_asked``: the last user turn at or before each message."""
    asked = F.when(F.col("role") == "user", F.col("turn"))
    blocked = _blocked(messages).withColumn("_u", asked)
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn")
    by_block = blocked.groupBy("conv_id", "_block").agg(F.max("_u").alias("_m"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_block.withColumn("_c", F.max("_m").over(before)).select(F.col("conv_id").alias("_cv"), F.col("_block").alias("_bk"), "_c")
    own = blocked.withColumn("_w", F.max("_u").over(inside))
    met = own.join(carried, own["conv_id"].eqNullSafe(carried["_cv"]) & own["_block"].eqNullSafe(carried["_bk"]), "left")
    return met.withColumn("_asked", F.coalesce("_w", "_c")).drop("_u", "_w", "_c", "_cv", "_bk", "_block")


def events(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, kind, call_id, name, args`` (variant), ``after, payload`` (variant) for every message."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    said = latest_user_turn(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", whole.alias("text")))
    parsed = said.withColumn("_d", F.when(F.col("text").rlike("^\\s*\\{"), F.try_parse_json("text")))
    call, result = _at(F.col("_d"), "$.tool_call.id"), _at(F.col("_d"), "$.tool_result.id")
    kind = F.when(call.isNotNull(), "call").when(result.isNotNull(), "result").when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("note")
    implied = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    known = F.col("conv_id").isNotNull()
    plain = F.when(known & (F.col("role") == "user") & F.col("turn").isNotNull(), implied(F.col("turn"))).when(known & (F.col("role") == "assistant") & F.col("_asked").isNotNull(), implied(F.col("_asked")))
    own_args = F.try_parse_json(F.to_json(F.struct(n_words(F.col("text")).alias("n_words"), F.col("text").alias("text"))))
    after = F.from_json(F.to_json(F.try_variant_get("_d", "$.tool_call.after", "variant")), "array<string>")
    return parsed.select(
        "conv_id",
        "turn",
        "role",
        "text",
        kind.alias("kind"),
        F.coalesce(call, result, plain).alias("call_id"),
        F.when(kind == "call", F.coalesce(_at(F.col("_d"), "$.tool_call.name"), F.lit("reply"))).alias("name"),
        F.when(kind == "call", F.when(call.isNotNull(), F.try_variant_get("_d", "$.tool_call.arguments", "variant")).otherwise(own_args)).alias("args"),
        F.when(call.isNotNull(), after).alias("after"),
        F.when(call.isNull() & result.isNotNull(), F.try_variant_get("_d", "$.tool_result.content", "variant")).alias("payload"),
    )


def link(found: DataFrame) -> DataFrame:
    """Adds ``linked`` (a call has a result, a result has its call) and ``valid`` (the call's arguments fit)."""
    calls = found.where("kind = 'call' AND call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("turn").alias("_asked"), F.bool_or(valid_arguments(F.col("name"), F.col("args"))).alias("_ok"))
    results = found.where("kind = 'result' AND call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("_answers"))
    both = calls.join(results, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "_ok", "_answers", F.lit(True).alias("_there"))
    met = found.join(both, ["conv_id", "call_id"], "left")
    linked = F.when(F.col("kind") == "call", F.col("_answers").isNotNull()).when(F.col("kind") == "result", F.col("_there").isNotNull()).otherwise(F.lit(False))
    valid = F.when(F.col("kind") == "call", valid_arguments(F.col("name"), F.col("args"))).when(F.col("kind") == "result", F.coalesce("_ok", F.lit(False))).otherwise(F.lit(True))
    return met.withColumn("linked", linked).withColumn("valid", valid).drop("_ok", "_answers", "_there")


def levels(found: DataFrame) -> DataFrame | None:
    """``conv_id, node, level`` for the calls and results of conversations in which one waits for another that is not earlier; else None.

    Nodes are identifiers of calls (``c`` before them) and of results (``r``). Kahn's rounds on the edges alone: each round
    gives the next level to nodes that wait for nothing open, until a round finds none; what is then open waits for a cycle.
    """
    known = found.where("call_id IS NOT NULL AND conv_id IS NOT NULL")
    calls = known.where("kind = 'call'")
    named = calls.where(F.size("after") > 0).select("conv_id", "turn", _node("call").alias("node"), F.explode("after").alias("_n")).select("conv_id", "turn", "node", F.concat(F.lit("c"), "_n").alias("needs"))
    answers = known.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    answered = answers.select("conv_id", "turn", _node("result").alias("node"), _node("call").alias("needs"))
    places = calls.groupBy("conv_id", _node("call").alias("needs")).agg(F.min("turn").alias("at"))
    edges = durable(named.unionByName(answered).join(places, ["conv_id", "needs"]).where("node <> needs"))
    late = F.when(F.substring("node", 1, 1) == "r", F.col("at") > F.col("turn")).otherwise(F.col("at") >= F.col("turn"))
    odd = edges.where(late).select("conv_id").distinct()
    if odd.limit(1).count() == 0:
        return None
    edges = durable(edges.join(odd, "conv_id", "left_semi").select("conv_id", "node", "needs").distinct())
    kinds = F.when(F.col("kind") == "call", _node("call")).otherwise(_node("result"))
    open_ = durable(known.where("kind IN ('call', 'result')").join(odd, "conv_id", "left_semi").select("conv_id", kinds.alias("node")).distinct())
    done, depth = [], 0
    while True:
        waiting = edges.join(open_.withColumnRenamed("node", "needs"), ["conv_id", "needs"], "left_semi").select("conv_id", "node").distinct()
        ready = durable(open_.join(waiting, ["conv_id", "node"], "left_anti").withColumn("level", F.lit(depth)))
        if ready.limit(1).count() == 0:
            break
        done.append(ready)
        depth += 1
        before, open_ = open_, durable(open_.join(ready, ["conv_id", "node"], "left_anti"))
        release(before)
        if len(done) == 32:  # long chains: keep the union of levels short
            merged = durable(_union(done))
            release(*done)
            done = [merged]
    return _union([*done, open_.withColumn("level", F.lit(depth))])


def _node(kind: str) -> Column:
    return F.concat(F.lit(kind[0]), "call_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def positions(linked: DataFrame, by_level: DataFrame | None) -> DataFrame:
    """Adds ``position``, the event's place from 0 in its conversation's topological order."""
    if by_level is None:
        ordered = linked.withColumn("_level", F.lit(0))
    else:
        node = F.when(F.col("kind") == "call", _node("call")).when(F.col("kind") == "result", _node("result"))
        leveled = by_level.withColumnRenamed("level", "_level")
        ordered = linked.withColumn("node", node).join(leveled, ["conv_id", "node"], "left").withColumn("_level", F.coalesce("_level", F.lit(0))).drop("node")
    blocked = _blocked(ordered)
    inside = Window.partitionBy("conv_id", "_level", "_block").orderBy("turn", "role", F.xxhash64("text"))
    before = Window.partitionBy("conv_id").orderBy("_level", "_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy("conv_id", "_level", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.select(F.col("conv_id").alias("_cv"), F.col("_level").alias("_lv"), F.col("_block").alias("_bk"), "_ahead")
    own = blocked.withColumn("_r", F.row_number().over(inside) - 1)
    met = own.join(sizes, own["conv_id"].eqNullSafe(sizes["_cv"]) & (own["_level"] == sizes["_lv"]) & own["_block"].eqNullSafe(sizes["_bk"]))
    return met.withColumn("position", (F.col("_r") + F.col("_ahead")).cast("long")).drop("_r", "_ahead", "_cv", "_lv", "_bk", "_level", "_block")


def canonical(kind: Column) -> Column:
    """Canonical JSON of an event: keys in order, no spaces; null fields are left out."""
    call = F.concat(F.lit('{"arguments":'), F.to_json("args"), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"type":"call"}'))
    content = F.coalesce(F.to_json("payload"), _quoted(F.col("text")))
    result = F.concat(F.lit('{"content":'), content, F.when(F.col("call_id").isNotNull(), F.concat(F.lit(',"id":'), _quoted(F.col("call_id")))).otherwise(F.lit("")), F.lit(',"type":"result"}'))
    note = F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"type":"note"}'))
    return F.when(kind == "call", F.coalesce(call, note)).when(kind == "result", result).otherwise(note)


def _quoted(value: Column) -> Column:
    """A JSON string, taken from a one-element array."""
    text = F.to_json(F.array(value))
    return text.substr(F.lit(2), F.length(text) - 2)


def format_chats(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, kind, call_id, linked, valid, position, json`` for every message."""
    found = events(messages)
    out = positions(link(found), levels(found))
    return out.select("conv_id", "turn", "role", "kind", "call_id", "linked", "valid", "position", canonical(F.col("kind")).alias("json"))


ORACLE = r"""
WITH m AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS t,
    max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations),
e AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'note' END AS kind,
    CASE WHEN role = 'user' THEN conv_id || ':' || turn WHEN role = 'assistant' AND asked IS NOT NULL THEN conv_id || ':' || asked END AS call_id,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM m),
c AS (SELECT conv_id, call_id, bool_or(n BETWEEN 1 AND 4000 AND length(t) <= 8000) AS ok FROM e WHERE kind = 'call' GROUP BY ALL),
r AS (SELECT conv_id, call_id FROM e WHERE kind = 'result' AND call_id IS NOT NULL GROUP BY ALL)
SELECT e.conv_id, e.turn, e.role, e.kind, e.call_id,
  CASE e.kind WHEN 'call' THEN r.call_id IS NOT NULL WHEN 'result' THEN c.call_id IS NOT NULL ELSE false END AS linked,
  CASE e.kind WHEN 'call' THEN n BETWEEN 1 AND 4000 AND length(t) <= 8000 WHEN 'result' THEN coalesce(c.ok, false) ELSE true END AS valid,
  (row_number() OVER (PARTITION BY e.conv_id ORDER BY e.turn, e.role) - 1)::BIGINT AS position,
  CASE e.kind WHEN 'call' THEN '{"arguments":{"n_words":' || n || ',"text":' || to_json(t)::VARCHAR || '},"id":' || to_json(e.call_id)::VARCHAR || ',"name":"reply","type":"call"}'
    WHEN 'result' THEN '{"content":' || to_json(t)::VARCHAR || CASE WHEN e.call_id IS NOT NULL THEN ',"id":' || to_json(e.call_id)::VARCHAR ELSE '' END || ',"type":"result"}'
    ELSE '{"content":' || to_json(t)::VARCHAR || ',"type":"note"}' END AS json
FROM e LEFT JOIN c USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)
"""


@query("op4_chat_format", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations as a linked, validated, ordered event."""
    return format_chats(table(spark, sf_dir, "conversations"))
