"""Chat formatting: tool calls and results linked by identifier, ordered, validated and written as canonical JSON.

DataFrame functions only. A conversation is never gathered: each message is a row, and (level, turn, call_id) orders
them, so a conversation may have any number of messages. Arguments are parsed as variants, which keep JSON's types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.shared import discard, durable, new_path

#: What schema_of_variant() says of values of a type.
TYPES = {
    "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": "^(BIGINT|DECIMAL|DOUBLE)", "boolean": "^BOOLEAN$",
    "object": "^OBJECT<", "array": "^ARRAY<", "null": "^VOID$",
}


def quoted(x: Column) -> Column:
    """A JSON string; null as null."""
    whole = F.to_json(F.struct(x.alias("v")))
    return F.when(x.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def _ok(entry: Column, rule: Column) -> Column:
    fits = F.lit(False)
    for name, pattern in TYPES.items():
        fits = fits | ((rule["type"] == name) & entry["type"].rlike(pattern))
    return fits & (rule["minimum"].isNull() | F.coalesce(entry["json"].try_cast("double") >= rule["minimum"], F.lit(False)))


def parsed(text: Column) -> Column:
    """The variant of a text that is one JSON value; null for other texts, such as with something after it or repeated keys."""
    many = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).try_cast("array<variant>")
    return F.when(F.size(many) == 1, many[0])


def validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls with `problems` (array of text, ordered) and `args_json`, the arguments as canonical JSON: sorted keys at every
    depth, no blanks, numbers without needless zeros; those of more than 38 digits or with an exponent as doubles.

    tools: name, param, type, required, minimum; one row per parameter; types are those of TYPES. Arguments that are no
    JSON object or name a key twice, unknown tools, unknown or missing parameters, values of another type and numbers under
    the minimum are problems. Arguments that are no JSON are written as null.
    """
    rules = tools.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("param", "type", "required", "minimum"))).alias("rules")).withColumnRenamed("name", "tool_")
    df = calls.join(rules, calls["name"] == F.col("tool_"), "left").withColumn("args_", parsed(F.col("arguments")))
    value = lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("type"), F.to_json(e["value"]).alias("json"))
    df = df.withColumn("entries_", F.array_sort(F.transform(F.map_entries(F.col("args_").try_cast("map<string,variant>")), value)))
    rule_of = lambda key: F.filter("rules", lambda r: r["param"] == key)
    keys = F.transform("entries_", lambda e: e["key"])
    missing = F.transform(F.filter("rules", lambda r: r["required"] & ~F.coalesce(F.array_contains(keys, r["param"]), F.lit(False))), lambda r: F.concat(F.lit("missing "), r["param"]))
    unknown = F.transform(F.filter("entries_", lambda e: F.size(rule_of(e["key"])) == 0), lambda e: F.concat(F.lit("unknown "), e["key"]))
    wrong = F.transform(F.filter("entries_", lambda e: F.exists(rule_of(e["key"]), lambda r: ~_ok(e, r))), lambda e: F.concat(F.lit("invalid "), e["key"]))
    none = F.array().cast("array<string>")
    problems = (
        F.when(F.col("tool_").isNull(), F.array(F.lit("no such tool")))
        .when(F.col("entries_").isNull(), F.array(F.lit("no JSON object")))
        .otherwise(F.array_sort(F.concat(F.coalesce(missing, none), F.coalesce(unknown, none), F.coalesce(wrong, none))))
    )
    return df.withColumn("problems", problems).withColumn("args_json", F.coalesce(F.to_json("args_"), F.lit("null"))).drop("rules", "tool_", "args_", "entries_")


def _chains(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, up, steps, open): each call's first call above it that is not in `single`, and how far it is.

    single: calls with one dependency, `up`. Each round doubles the steps, so rounds grow with the logarithm of the longest
    chain. Calls on or behind a cycle stay open.
    """
    inner = single.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("open"))
    now = durable(single.join(inner, ["conv_id", "up"], "left").select("conv_id", "call_id", "up", F.lit(1).alias("steps"), F.coalesce("open", F.lit(False)).alias("open")), "chains")
    reach, n = 1, now.count()
    while reach <= n and not now.where("open").isEmpty():
        k = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = now.where("open").join(k, ["conv_id", "up"]).select("conv_id", "call_id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        nxt = durable(now.where("not open").unionAll(moved), "chains")
        discard(now)
        now, reach = nxt, reach * 2
    return now


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without dependencies, else one more than the highest of them; -1 on or behind a cycle.

    A dependency on a call that is not there does not count. Chains of calls with one dependency are followed by doubling;
    rounds settle only calls with several, as many rounds as the longest chain of such calls. What a round settles is
    appended to one table; the driver sees only whether something was settled.
    """
    spark, keys = calls.sparkSession, ["conv_id", "call_id"]
    nodes = calls.select(*keys).distinct()
    edges = calls.select(*keys, F.explode("depends").alias("dep")).distinct()
    edges = durable(edges.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi").select(*keys, "dep"), "edges")
    several = edges.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    chains = _chains(edges.join(several, keys, "left_anti").select(*keys, F.col("dep").alias("up")))
    roots = nodes.join(edges, keys, "left_anti").withColumn("level", F.lit(0))
    path = new_path(spark, "levels")
    roots.write.parquet(path)
    settled = lambda: spark.read.schema(roots.schema).parquet(path)
    anchors = chains.select("conv_id", F.col("call_id").alias("dep"), F.when(F.col("open"), None).otherwise(F.col("up")).alias("up"), "steps", "open")
    links = edges.join(several, keys, "left_semi").join(anchors, ["conv_id", "dep"], "left").select(*keys, F.when(F.coalesce("open", F.lit(False)), None).otherwise(F.coalesce("up", "dep")).alias("up"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    left, last, best = durable(links, "links"), settled(), None
    while not left.isEmpty():
        above = last.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("base"))
        hit = left.join(above, ["conv_id", "up"]).select(*keys, (F.col("base") + F.col("steps")).alias("level"))
        best_ = durable((hit if best is None else best.unionAll(hit)).groupBy(*keys).agg(F.max("level").alias("level")), "best")
        left_ = durable(left.join(above, ["conv_id", "up"], "left_anti").select(*left.columns), "links")
        ready = durable(best_.join(left_, keys, "left_anti"), "ready")
        if ready.isEmpty():
            break
        ready.select(*roots.columns).write.mode("append").parquet(path)
        best, left, last = best_.join(ready, keys, "left_anti"), left_, ready
    done = settled()
    level = done.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("base"))
    own = chains.where("not open").join(level, ["conv_id", "up"]).select(*keys, (F.col("base") + F.col("steps")).alias("level"))
    known = done.unionAll(own)
    return known.unionAll(nodes.join(known, keys, "left_anti").withColumn("level", F.lit(-1)))


def format_messages(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per row of messages: conv_id, turn, role, call_id, level, status, json.

    messages: conv_id, turn, role, text, call_id, name, arguments, depends. A row with a call_id and a name is a call, one
    with a call_id alone is a result, others are plain. status: `linked` (a call with a result, a result with a call),
    `no_result`, `orphan`, `invalid` (a call with problems, linked or not) or `plain`. Results stand at their call's
    level; plain rows and orphans have none. A call whose id another row of the conversation has too counts once: links,
    order and checks are by id; repeated rows come out as often as they go in. Null texts are JSON null; rows without conv_id
    link to nothing. Empty tables give no rows, texts may have any length, and other columns of messages are not read.
    """
    kind = F.when(F.col("call_id").isNull(), "plain").when(F.col("name").isNotNull(), "call").otherwise("result")
    m = messages.select("conv_id", "turn", "role", "text", "call_id", "name", "arguments", F.coalesce("depends", F.array().cast("array<string>")).alias("depends")).withColumn("kind", kind)
    calls, results, plain = (m.where(F.col("kind") == k) for k in ("call", "result", "plain"))
    keys = ["conv_id", "call_id"]
    level = durable(levels(calls.where("conv_id is not null")), "levels")
    answered = results.select(*keys).distinct().withColumn("answered", F.lit(True))
    asked = calls.select(*keys).distinct().withColumn("asked", F.lit(True))
    c = validated(calls, tools).join(level, keys, "left").join(answered, keys, "left")
    status = F.when(F.size("problems") > 0, "invalid").when(F.col("answered"), "linked").otherwise("no_result")
    c = c.withColumn("status", status).withColumn("json", F.concat(
        F.lit('{"arguments":'), F.col("args_json"), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"problems":'), F.to_json("problems"), F.lit(',"role":'), quoted(F.col("role")), F.lit("}"),
    ))
    r = results.join(level, keys, "left").join(asked, keys, "left").withColumn("status", F.when(F.col("asked"), "linked").otherwise("orphan"))
    r = r.withColumn("json", F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")))
    p = plain.withColumns({"level": F.lit(None).cast("int"), "status": F.lit("plain")}).withColumn("json", F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")))
    out = ["conv_id", "turn", "role", "call_id", "level", "status", "json"]
    return c.select(*out).unionAll(r.select(*out)).unionAll(p.select(*out))


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as calls and results: a user's turn is a call of `ask` that depends on the
    user's turn before, and an assistant's turn is the result of the turn before it."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    name = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(user, name(0)).when(answer, name(1)).alias("call_id"),
        F.when(user, F.lit("ask")).alias("name"),
        F.when(user, F.to_json(F.struct(words.alias("words"), F.col("text").alias("prompt")))).alias("arguments"),
        F.when(user, F.array(name(2))).alias("depends"),
    )
