"""Chat formatting with linked tool calls, by built-in functions only.

Messages hold tool calls as JSON: an assistant text ``{"content": .., "tool_calls": [{"id",
"name", "arguments"}]}`` (or the nested ``function`` form, arguments also as a JSON string),
a result text ``{"tool_call_id": .., "content": ..}``. Calls and results meet in an equi-join
on conversation and identifier, after each identifier was reduced to its first call and first
result; arguments are checked against the tools' schemas; ``${id}`` inside arguments makes a
call depend on another, and calls are put in topological steps. Every turn, call and result is
a row with canonical JSON (sorted keys, no spaces), so no conversation is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Parameters of each tool: type and whether it is required.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True), "timeout": ("number", False)},
    "calculate": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "days": ("integer", False)},
}
_TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT",
    "array": r"^ARRAY",
}
_CALL = "array<struct<id:string,name:string,arguments:variant,function:struct<name:string,arguments:variant>>>"
_REFERENCE = r"\$\{([^}]+)\}"


def _arguments(raw: Column) -> Column:
    """Arguments as an object; a JSON string is read once more."""
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(F.try_variant_get(raw, "$", "string"))).otherwise(raw)


def events(conversations: DataFrame) -> DataFrame:
    """A row for each message or result, and one for each call inside a message."""
    text = F.coalesce("text", F.lit(""))
    whole = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    parsed = whole.withColumn("v", F.when(F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text")))
    parsed = parsed.withColumn("result_id", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))
    calls = F.coalesce(F.try_variant_get("v", "$.tool_calls", _CALL), F.array().cast(_CALL))
    result = F.col("result_id").isNotNull()
    plain = F.to_json(F.struct(F.col("text").alias("content"), F.col("role")))
    own = F.struct(
        F.when(result, "result").otherwise("message").alias("kind"),
        F.lit(0).alias("ord"),
        F.col("result_id").alias("call_id"),
        F.lit(None).cast("string").alias("tool"),
        F.when(result, F.to_json(F.try_variant_get("v", "$.content", "variant"))).alias("payload"),
        F.when(F.col("v").isNull(), plain).otherwise(F.to_json("v")).alias("canonical"),
    )
    inner = F.transform(
        calls,
        lambda c, k: F.struct(
            F.lit("call").alias("kind"),
            (k + 1).alias("ord"),
            c["id"].alias("call_id"),
            F.coalesce(c["name"], c["function"]["name"]).alias("tool"),
            F.to_json(_arguments(F.coalesce(c["arguments"], c["function"]["arguments"]))).alias("payload"),
            F.lit(None).cast("string").alias("canonical"),
        ),
    )
    return parsed.select("conv_id", "turn", F.explode(F.concat(F.array(own), inner)).alias("e")).select("conv_id", "turn", "e.*")


def argument_errors(tool: Column, payload: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments, in order of the schema's parameters; unknown ones last."""
    value = F.try_parse_json(payload)
    known = F.lit(False)
    out = F.when(tool.isNull(), F.array(F.lit("no tool")))
    for name, parameters in sorted(schemas.items()):
        known = known | (tool == name)
        checks = []
        for parameter, (kind, required) in parameters.items():
            one = F.try_variant_get(value, f"$['{parameter}']", "variant")
            shape = F.schema_of_variant(one)
            missing = one.isNull() | (shape == "VOID")
            checks.append(F.when(missing, F.lit(f"{parameter} missing") if required else F.lit(None)).when(~shape.rlike(_TYPES[kind]), F.lit(f"{parameter} not {kind}")))
        keys = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
        extra = F.transform(F.filter(keys, lambda k: ~k.isin(*parameters)), lambda k: F.concat(k, F.lit(" unknown")))  # noqa: B023
        no_object = F.coalesce(~F.schema_of_variant(value).rlike("^OBJECT"), F.lit(True))
        found = F.when(no_object, F.array(F.lit("arguments no object"))).otherwise(F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.array().cast("array<string>"))))
        out = out.when(tool == name, found)
    return out.otherwise(F.array(F.lit("unknown tool")))


#: Rounds of hubs after which the levels found so far are written as one table.
MERGE = 16


def _roots(single: DataFrame) -> DataFrame:
    """``(conv_id, call_id, root, hops, lost)``: where the chain of single dependencies from each call ends, by doubling.

    ``single``: conv_id, call_id, needs, one row a call. Each round every call takes over the reach of
    the call it has reached, so chains end after a number of rounds that grows with the logarithm
    of their length; what has not ended by then runs on a cycle (``lost``).
    """
    at = settle(single.select("conv_id", "call_id", F.col("needs").alias("root"), F.lit(1).alias("hops"), F.lit(True).alias("lost")))
    for _ in range(max(1, at.count()).bit_length() + 1):
        ahead = at.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("on"), F.col("hops").alias("further"))
        at = settle(at.join(ahead, ["conv_id", "root"], "left").select("conv_id", "call_id", F.coalesce("on", "root").alias("root"), (F.col("hops") + F.coalesce("further", F.lit(0))).alias("hops"), F.col("on").isNotNull().alias("lost")))
        if at.filter("lost").isEmpty():
            break
    return at


def _steps(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of the first calls that depend on others; null level on a cycle or behind one.

    Calls without known dependencies have level 0 and are not listed. Chains of calls with one
    dependency each are contracted first (``_roots``); the rest, calls with several (hubs), settle round
    by round with the last of their roots, so rounds follow the longest chain of hubs alone.
    """
    keys = ["conv_id", "call_id"]
    named = calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.regexp_extract_all("payload", F.lit(_REFERENCE), F.lit(1)))).alias("needs"))
    ids = calls.select("conv_id", F.col("call_id").alias("needs"))
    waits = settle(named.join(ids, ["conv_id", "needs"], "left_semi"))
    counted = waits.groupBy(*keys).agg(F.count("*").alias("n"), F.min("needs").alias("needs"))
    roots = _roots(counted.filter("n = 1").select(*keys, "needs"))
    hubs = counted.filter("n > 1").select(*keys)
    known = roots.select("conv_id", F.col("call_id").alias("needs"), "root", "hops", "lost")
    edges = waits.join(hubs, keys, "left_semi").join(known, ["conv_id", "needs"], "left")
    # a root that is lost, or a hub that waits, has no level yet; others begin at 0
    target = F.coalesce("root", "needs")
    edges = edges.select(*keys, target.alias("root"), (F.coalesce("hops", F.lit(0)) + 1).alias("way"), F.coalesce("lost", F.lit(False)).alias("lost"))
    waiting = hubs.select("conv_id", F.col("call_id").alias("root"), F.lit(True).alias("hub"))
    edges = settle(edges.join(waiting, ["conv_id", "root"], "left").select(*keys, "root", "way", F.when(~F.col("lost") & F.col("hub").isNull(), F.col("way")).alias("level")))
    done = lambda e: e.groupBy(*keys).agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0").drop("open")
    levels, new, rounds = calls.select("conv_id", "call_id", F.lit(0).alias("level")).limit(0), settle(done(edges)), 0
    while not new.isEmpty():
        levels, rounds = levels.unionByName(new), rounds + 1
        levels = settle(levels) if rounds % MERGE == 0 else levels
        told = new.select("conv_id", F.col("call_id").alias("root"), F.col("level").alias("told"))
        rest = edges.join(new.select(*keys), keys, "left_anti").join(told, ["conv_id", "root"], "left")
        edges = settle(rest.select(*keys, "root", "way", F.coalesce("level", F.col("told") + F.col("way")).alias("level")))
        new = settle(done(edges))
    of_hubs = hubs.join(levels, keys, "left").select(*keys, "level")
    behind = of_hubs.select("conv_id", F.col("call_id").alias("root"), F.lit(True).alias("hub"), F.col("level").alias("base"))
    base = F.when(F.col("hub"), F.col("base")).otherwise(0)
    of_single = roots.join(behind, ["conv_id", "root"], "left").select(*keys, F.when(~F.col("lost"), base + F.col("hops")).alias("level"))
    return of_single.unionByName(of_hubs)


def link(conversations: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """conv_id, turn, ord, kind, call_id, tool, linked, valid, errors, step, canonical.

    A row per turn (kind message or result, ord 0) and per call (ord from 1). The first call of an
    identifier in a conversation is linked to the first of its results that is not on an earlier
    turn, and that result to it; other calls and results of the same identifier are unlinked
    duplicates, as are those whose conversation or identifier is null. Calls at one place are
    ordered by tool and arguments; of like rows one is the first. step is twice a call's topological level, one more for
    its result; null for messages, unlinked results and calls on a cycle. Text that is no JSON
    object is a plain message; null text and role count as empty. Ties on the turn are one turn.
    """
    found = settle(events(conversations).withColumn("n", F.monotonically_increasing_id()))
    marked = found.filter(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    keys = ["conv_id", "call_id"]
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    place = F.struct("turn", "ord", "tool", "payload", "n")  # n tells only repeats apart
    first_calls = marked.filter(is_call).groupBy(*keys).agg(F.min(place).alias("first_call"))
    answers = marked.filter(is_result).join(first_calls, keys).filter(F.col("turn") >= F.col("first_call.turn"))
    firsts = first_calls.join(answers.groupBy(*keys).agg(F.min(place).alias("first_result")), keys, "left")
    steps = _steps(first_calls.select("conv_id", "call_id", F.col("first_call.payload").alias("payload")))
    partners = firsts.join(steps.withColumn("dependent", F.lit(True)), ["conv_id", "call_id"], "left").withColumn("level", F.when(F.col("dependent"), F.col("level")).otherwise(0)).drop("dependent")
    known = marked.join(partners, ["conv_id", "call_id"], "left")
    others = found.filter(F.col("call_id").isNull() | F.col("conv_id").isNull() | F.col("turn").isNull())
    mine = F.when(is_call, F.col("first_call")).otherwise(F.col("first_result"))
    first = F.coalesce(mine["n"] == F.col("n"), F.lit(False))
    known = known.withColumn("first", first).withColumn("linked", first & F.col("first_call").isNotNull() & F.col("first_result").isNotNull())
    known = known.select("conv_id", "turn", "ord", "kind", "call_id", "tool", "payload", "canonical", "first", "linked", "level", F.col("first_result.payload").alias("result"), F.col("first_call.turn").alias("called"))
    empty = {"first": F.lit(False), "linked": F.lit(False), "level": F.lit(None).cast("int"), "result": F.lit(None).cast("string"), "called": F.lit(None).cast(found.schema["turn"].dataType)}
    rows = known.unionByName(others.drop("n").withColumns(empty))
    errors = F.when(
        is_call,
        F.concat(
            argument_errors(F.col("tool"), F.col("payload"), SCHEMAS if schemas is None else schemas),
            F.when(F.col("call_id").isNull(), F.array(F.lit("no id"))).when(~F.col("first"), F.array(F.lit("repeated id"))).when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
        ),
    ).when(is_result & ~F.col("linked"), F.array(F.when(F.col("called").isNull(), "no call").when(F.col("turn") < F.col("called"), "before its call").otherwise("repeated result"))).otherwise(F.array().cast("array<string>"))
    call_json = F.to_json(
        F.to_variant_object(
            F.struct(
                F.coalesce(F.try_parse_json("payload"), F.parse_json(F.lit("null"))).alias("arguments"),
                F.coalesce("call_id", F.lit("")).alias("id"),
                F.coalesce("tool", F.lit("")).alias("name"),
                F.when(F.col("linked"), F.coalesce(F.try_parse_json("result"), F.parse_json(F.lit("null")))).otherwise(F.parse_json(F.lit("null"))).alias("result"),
            )
        )
    )
    step = F.when(is_call & F.col("first"), F.col("level") * 2).when(is_result & F.col("linked"), F.col("level") * 2 + 1)
    return (
        rows.withColumn("errors", F.array_join(errors, "; "))
        .withColumn("canonical", F.when(is_call, call_json).otherwise(F.col("canonical")))
        .select("conv_id", "turn", "ord", "kind", "call_id", "tool", "linked", (F.col("errors") == "").alias("valid"), "errors", step.cast("int").alias("step"), "canonical")
    )


def with_tool_calls(conversations: DataFrame) -> DataFrame:
    """``conversations`` told through tool calls, so that tables of plain messages exercise the linking.

    Each assistant turn calls ``calculate`` with the call of the assistant's turn before it as
    argument, and every fourth with the one before that too; a user turn right behind an assistant's brings its result.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.xxhash64("role", "text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("k", F.sum((F.col("role") == "assistant").cast("int")).over(order)).withColumn("after", F.lag("role").over(order))
    ask = lambda n: F.concat(F.lit("${c"), F.col("k") - n, F.lit("}"))
    said = F.when(F.col("k") == 1, F.lit("1")).when((F.col("k") % 4 == 0), F.concat(ask(1), F.lit(" + "), ask(2))).otherwise(ask(1))
    call = F.concat(F.lit('{"tool_calls": [{"name": "calculate", "id": "c'), F.col("k"), F.lit('", "arguments": {"expression": "'), said, F.lit('"}}], "content": ""}'))
    result = F.concat(F.lit('{"tool_call_id": "c'), F.col("k"), F.lit('", "content": {"turn": '), F.col("turn"), F.lit("}}"))
    is_call, is_result = F.col("role") == "assistant", (F.col("role") == "user") & (F.col("after") == "assistant")
    return rows.select("conv_id", "turn", F.when(is_result, "tool").otherwise(F.col("role")).alias("role"), F.when(is_call, call).when(is_result, result).otherwise(F.col("text")).alias("text"))


CALLS_SQL = """
WITH r AS (SELECT *, sum((role = 'assistant')::INT) OVER w AS k, lag(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, CASE WHEN k = 1 THEN '1' WHEN k % 4 = 0 THEN '${c' || (k - 1) || '} + ${c' || (k - 2) || '}' ELSE '${c' || (k - 1) || '}' END AS said, role = 'user' AND coalesce(after, '') = 'assistant' AS brings FROM r),
f AS (SELECT conv_id, k, min(turn) AS turn FROM e WHERE brings GROUP BY conv_id, k)
SELECT conv_id, turn, CAST(0 AS INTEGER) AS ord, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS tool, false AS linked, true AS valid, '' AS errors, CAST(NULL AS INTEGER) AS step,
  CASE WHEN role = 'assistant' THEN '{"content":"","tool_calls":[{"arguments":{"expression":"' || said || '"},"id":"c' || k || '","name":"calculate"}]}'
    ELSE CAST(json_object('content', coalesce(text, ''), 'role', coalesce(role, '')) AS VARCHAR) END AS canonical
FROM e WHERE NOT brings
UNION ALL SELECT conv_id, turn, 0, 'result', 'c' || k, NULL, true, true, '', CAST(2 * k - 1 AS INTEGER), '{"content":{"turn":' || turn || '},"tool_call_id":"c' || k || '"}' FROM e WHERE brings
UNION ALL SELECT e.conv_id, e.turn, 1, 'call', 'c' || e.k, 'calculate', f.turn IS NOT NULL, true, '', CAST(2 * e.k - 2 AS INTEGER),
  '{"arguments":{"expression":"' || said || '"},"id":"c' || e.k || '","name":"calculate","result":' || coalesce('{"turn":' || f.turn || '}', 'null') || '}' FROM e LEFT JOIN f ON f.conv_id = e.conv_id AND f.k = e.k WHERE e.role = 'assistant'
"""
#: Texts that are JSON objects do not occur in the tables that the driver compares; the tests hold those.
LINK_SQL = """
SELECT conv_id, turn, CAST(0 AS INTEGER) AS ord, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS tool,
  false AS linked, true AS valid, '' AS errors, CAST(NULL AS INTEGER) AS step,
  CAST(json_object('content', coalesce(text, ''), 'role', coalesce(role, '')) AS VARCHAR) AS canonical
FROM conversations
"""
