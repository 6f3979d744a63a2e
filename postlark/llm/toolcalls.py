"""Links tool calls with their results, orders, validates and serialises them.

All of it is DataFrame functions. Calls and results are each reduced to one row
for each identifier before the join, which reuses that partitioning, so copies
of one identifier collapse on the map side and one large conversation is dealt
out by identifier, never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

#: Tool name -> argument -> (JSON type, whether it is required).
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

#: JSON types by the prefix of the name that schema_of_variant() has for them.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def _errors(schemas: Schemas) -> Column:
    """What is wrong with the column `args` (a variant) of tool `name`; never null."""
    text = F.to_json("args")
    out = F.array(F.lit("unknown tool"))
    for tool, props in schemas.items():
        found = []
        for p, (kind, required) in props.items():
            at = F.schema_of_variant(F.variant_get("args", f"$['{p}']", "variant"))
            wrong = ~F.coalesce(at, F.lit("")).rlike(f"^({_TYPES[kind]})")
            missing = at.isNull() | (at == "VOID")
            found.append(F.when(missing, F.lit(f"missing {p}") if required else None).when(wrong, F.lit(f"{p} is not {kind}")))
        extra = F.array_except(F.json_object_keys(text), F.array(*map(F.lit, props)))
        named = F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        out = F.when(F.col("name") == tool, F.concat(F.array_compact(F.array(*found)), named)).otherwise(out)
    shaped = F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False))
    return F.when(F.col("n_calls") == 0, F.array().cast("array<string>")).when(~shaped, F.array(F.lit("arguments are no object"))).otherwise(out)


def _levels(calls: DataFrame) -> DataFrame:
    """The longest path of `after` to each call: conv_id, call_id, level; calls on or behind a cycle have none.

    Only calls that name another one, or are named, take part; the rest have level 0.
    A call that needs one other call alone follows it by pointer doubling, in rounds
    that grow with the logarithm of a chain, to the first call that needs none or
    several. Those that need several go by Kahn's rounds over what is left.
    """
    keys, node = ["conv_id", "call_id"], F.struct("conv_id", "call_id")
    known = calls.select("conv_id", F.col("call_id").alias("needs")).distinct()
    edges = calls.select(*keys, F.explode("after").alias("needs")).distinct().join(known, ["conv_id", "needs"], "left_semi")
    edges = stored(edges.select(node.alias("x"), F.struct("conv_id", F.col("needs").alias("call_id")).alias("to")), "needs")
    n = edges.groupBy("x").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    single = n.where("n = 1").select("x", "to")
    ends = single.select(F.col("x").alias("to"), F.lit(False).alias("end"))
    walk = stored(single.join(ends, "to", "left").select("x", "to", F.lit(1).alias("d"), F.coalesce("end", F.lit(True)).alias("end")), "walk")
    left = before = None
    while left != 0 and (before is None or left < before):
        before, left = left, walk.where("NOT end").count()
        if left:
            step = walk.select(F.col("x").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("end").alias("end2"))
            more = walk.where("NOT end").join(step, "to").select("x", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.col("end2").alias("end"))
            last, walk = walk, stored(walk.where("end").unionByName(more), "walk")
            discard(last)
    ended = walk.where("end").select("x", "to", "d")  # the others run in a circle
    several = edges.join(n.where("n > 1").select("x"), "x", "left_semi")
    several = stored(several.join(walk.select(F.col("x").alias("to"), F.col("to").alias("root"), "d", "end"), "to", "left").select("x", F.when(F.col("end"), F.col("root")).when(F.col("end").isNull(), F.col("to")).alias("root"), (F.coalesce("d", F.lit(0)) + 1).alias("d")), "merges")
    roots = edges.select(F.col("to").alias("x")).distinct().join(n.select("x"), "x", "left_anti").withColumn("level", F.lit(0))
    level = stored(roots, "levels")
    waiting = stored(several.select("x").distinct(), "waiting")
    while not waiting.isEmpty():
        open_edges = several.join(waiting, "x", "left_semi").join(level.select(F.col("x").alias("root"), "level"), "root", "left")
        ready = open_edges.groupBy("x").agg(F.max(F.col("level") + F.col("d")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0").select("x", "level")
        ready = stored(ready, "ready")
        if ready.isEmpty():
            break
        last, waiting = waiting, stored(waiting.join(ready, "x", "left_anti"), "waiting")
        discard(last)
        level = level.unionByName(ready)
    chained = ended.join(level.select(F.col("x").alias("to"), "level"), "to", "left").select("x", (F.col("level") + F.col("d")).alias("level"))
    circles = walk.where("NOT end").select("x").union(waiting).withColumn("level", F.lit(None).cast("int"))
    return level.unionByName(chained).unionByName(circles).select("x.conv_id", "x.call_id", "level")


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each (conv_id, call_id) of either side.

    calls: conv_id, call_id, turn, name, arguments (JSON text), and, if calls can
    need one another, after (identifiers of calls that come first). results:
    conv_id, call_id, turn, content. Other columns are not read.

    Returns conv_id, call_id, turn, name, level, n_calls, n_results, status,
    errors, json. (level, turn, call_id) is a topological order within a
    conversation. status is the first that holds of: orphan (a result without a
    call), ambiguous (different calls or different results with one identifier;
    the smallest by turn and content is shown), cyclic (level is null), invalid
    (see errors), unanswered, early (the result's turn is not behind the call's),
    linked. json has sorted keys, no spaces and no null members; it is null
    for orphans and for arguments that are no JSON object. Null identifiers link
    with nothing. Repeated rows count in n_calls and n_results. Identifiers in
    after that no call of the conversation has are ignored. Empty tables give
    what the other one has.
    """
    keys = ["conv_id", "call_id"]
    deps = "after" in calls.columns
    body = F.struct("turn", "name", "arguments")
    one = calls.groupBy(*keys).agg(
        F.count("*").alias("n_calls"), F.min(body).alias("c"), F.max(F.struct("name", "arguments")).alias("c1"), F.min(F.struct("name", "arguments")).alias("c0")
    )
    answer = results.groupBy(*keys).agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "content")).alias("r"), F.min("content").alias("r0"), F.max("content").alias("r1"))
    both = one.join(answer, keys, "full_outer")
    both = both.select(
        *keys,
        F.coalesce("c.turn", "r.turn").alias("turn"),
        "c.name",
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_calls", "n_results")),
        F.try_parse_json("c.arguments").alias("args"),
        F.col("r.content").alias("content"),
        (F.coalesce(F.col("c0") != F.col("c1"), F.lit(False)) | F.coalesce(F.col("r0") != F.col("r1"), F.lit(False))).alias("differs"),
        F.coalesce(F.col("r.turn") <= F.col("c.turn"), F.lit(False)).alias("early"),
    )
    if deps:
        both = both.join(_levels(calls).withColumn("ranked", F.lit(True)), keys, "left")
        level = F.when(F.col("ranked"), F.col("level")).otherwise(F.lit(0))
    else:
        level = F.lit(0)
    both = both.withColumn("level", level).withColumn("errors", _errors(schemas))
    status = (
        F.when(F.col("n_calls") == 0, "orphan")
        .when(F.col("differs"), "ambiguous")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("n_results") == 0, "unanswered")
        .when(F.col("early"), "early")
        .otherwise("linked")
    )
    json = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result")))
    shaped = F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False))
    return both.select(*keys, "turn", "name", "level", "n_calls", "n_results", status.alias("status"), "errors", F.when(shaped, json).alias("json"))


def from_messages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) in the usual chat format.

    Calls are {"tool_calls": [{"id", "name", "arguments", "after"}]} of the role
    assistant, results {"tool_call_id", "content"} of the role tool. Other texts have none.
    """
    kind = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
    got = df.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", kind)["tool_calls"]).alias("t"))
    calls = got.select("conv_id", F.col("t.id").alias("call_id"), "turn", "t.name", "t.arguments", F.coalesce("t.after", F.array().cast("array<string>")).alias("after"))
    back = df.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", "struct<tool_call_id:string,content:string>").alias("t"))
    return calls, back.where("t.tool_call_id IS NOT NULL").select("conv_id", F.col("t.tool_call_id").alias("call_id"), "turn", "t.content")


#: What a turn must carry where plain conversations are read as calls.
TURN_SCHEMAS: Schemas = {role: {"text": ("string", True), "turn": ("integer", True)} for role in ("user", "system")}


def from_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads plain conversations as calls: each turn not by the assistant calls the tool named by its role.

    The assistant's turn n answers the call of turn n - 1. A call needs the one of the
    turn before it or, if that one is no call, of the turn before that.
    """
    ident = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    asked = df.where(~answer)
    last = asked.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows")).distinct()
    after = F.array(ident(F.when(F.col("follows"), F.col("turn") - 1).otherwise(F.col("turn") - 2)))
    calls = asked.join(last, ["conv_id", "turn"], "left").select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.col("role").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), after.alias("after"))
    return calls, df.where(answer).select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))


def from_conversations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations: tool messages as from_messages() reads them, all other turns as from_turns() does."""
    tool = F.when(F.col("role") == "assistant", F.from_json("text", "struct<tool_calls:array<string>>")["tool_calls"].isNotNull()).when(F.col("role") == "tool", F.from_json("text", "struct<tool_call_id:string>")["tool_call_id"].isNotNull())
    marked = df.select("conv_id", "turn", "role", "text", F.coalesce(tool, F.lit(False)).alias("tool"))
    calls, results = from_messages(marked.where("tool"))
    more_calls, more_results = from_turns(marked.where("NOT tool"))
    return more_calls.unionByName(calls), more_results.unionByName(results)
