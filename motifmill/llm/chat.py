"""Chat formatting by tool-call linking. DataFrame functions only.

Calls and results are hash-joined by conversation and call id; calls are ordered so that each comes after the calls it depends
on; arguments are validated against the tools' schemas; and each call is serialised as one line of canonical JSON (keys sorted
at every level, no white space, numbers and escapes in one form), for which arguments pass through Spark's variant type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, table

#: JSON types of schemas by the first word of the variant type.
_TYPES = {"STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "BOOLEAN": "boolean", "VOID": "null", "ARRAY": "array", "OBJECT": "object"}
KEY = ["conv_id", "call_id"]


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest way from a call without needs; null on and after cycles.

    calls: distinct keys; needs: (conv_id, call_id, dep), both ends known. A call's level is the largest of a floor and its needs'
    levels plus weights. In a round, needs with a level go into the floor; a need that itself waits for one call only is replaced by
    that call, with the weights added up. So chains halve in every round, of whatever length, and any call all of whose needs have
    levels gets its own; when no call does, the rest is on or behind cycles. Every round is written to the shared folder.
    """
    spark, on, done = calls.sparkSession, ["conv_id", "dep"], []
    raised = lambda floors, least: floors.join(least.groupBy(*KEY).agg(F.max("least").alias("least")), KEY, "left").select(*KEY, F.greatest("floor", F.coalesce("least", F.lit(0))).alias("floor"))
    floors = stored(calls.withColumn("floor", F.lit(0)), "floors")
    edges = stored(needs.distinct().withColumn("weight", F.lit(1)), "needs")
    while True:
        waiting = edges.select(*KEY).distinct()
        placed = stored(floors.join(waiting, KEY, "left_anti").withColumnRenamed("floor", "level"), "placed")
        if placed.isEmpty():
            break
        done.append(placed)
        if edges.isEmpty():
            break
        met = stored(edges.join(placed.withColumnRenamed("call_id", "dep"), on, "left"), "met")
        left = stored(raised(floors.join(waiting, KEY, "left_semi"), met.where("level is not null").select(*KEY, (F.col("level") + F.col("weight")).alias("least"))), "floors")
        rest = met.where("level is null").drop("level")
        single = rest.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("dep").alias("next"), F.max("weight").alias("more")).where("n = 1").drop("n")
        single = stored(single.join(left, KEY).withColumnRenamed("call_id", "dep"), "single")
        hops = stored(rest.join(single, on, "left"), "hops")
        old = [floors, edges]
        floors = stored(raised(left, hops.where("next is not null").select(*KEY, (F.col("floor") + F.col("weight")).alias("least"))), "floors")
        edges = stored(hops.select(*KEY, F.coalesce("next", "dep").alias("dep"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight")).groupBy(*KEY, "dep").agg(F.max("weight").alias("weight")), "needs")
        drop_stored(spark, met, left, single, hops, *old)
    out = done[0] if done else calls.withColumn("level", F.lit(0)).where("false")
    for more in done[1:]:
        out = out.unionByName(more)
    return calls.join(out, KEY, "left")


def _kind(value: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    return F.element_at(kinds, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def schema_rules(schemas: DataFrame) -> tuple[DataFrame, int]:
    """A rule for each place of the schemas, and how deep they go: tool, path ("" the whole, "a.b" a property, "a[]" the items of an
    array), types, enum (JSON texts), minimum, maximum, required, names, closed. One round for each level of nesting."""
    level = schemas.where("name is not null").groupBy(F.col("name").alias("tool")).agg(F.min("schema").alias("text")).select("tool", F.lit("").alias("path"), F.try_parse_json("text").alias("s"))
    parts = [stored(level, "schemas")]
    inner = lambda path, kind: F.try_variant_get("s", path, kind)
    while not parts[-1].isEmpty():
        named = parts[-1].select("tool", "path", F.explode(inner("$.properties", "map<string, variant>")).alias("k", "s")).select("tool", _under(F.col("k")).alias("path"), "s")
        items = parts[-1].select("tool", F.concat("path", F.lit("[]")).alias("path"), F.try_variant_get("s", "$.items", "variant").alias("s")).where("s is not null")
        parts.append(stored(named.unionByName(items), "schemas"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    kind = inner("$.type", "variant")
    rules = every.select(
        "tool", "path",
        F.when(F.schema_of_variant(kind).startswith("ARRAY"), inner("$.type", "array<string>")).when(kind.isNotNull(), F.array(inner("$.type", "string"))).alias("types"),
        F.transform(inner("$.enum", "array<variant>"), lambda x: F.to_json(F.struct(x.alias("x")))).alias("enum"),
        inner("$.minimum", "double").alias("minimum"), inner("$.maximum", "double").alias("maximum"),
        F.coalesce(inner("$.required", "array<string>"), F.array().cast("array<string>")).alias("required"),
        F.coalesce(F.map_keys(inner("$.properties", "map<string, variant>")), F.array().cast("array<string>")).alias("names"),
        F.coalesce(inner("$.additionalProperties", "boolean") == F.lit(False), F.lit(False)).alias("closed"),
    )
    return stored(rules, "rules"), len(parts) - 1


def _under(k: Column) -> Column:
    return F.when(F.col("path") == "", k).otherwise(F.concat("path", F.lit("."), k))


def argument_errors(rows: DataFrame, rules: DataFrame, depth: int) -> DataFrame:
    """(uid, wrong): the errors of each call's arguments by its tool's rules, calls without any left out. rows: uid, tool, v (variant).

    Values are taken apart level by level, as deep as the rules go, and each is joined with the rule of its place.
    """
    none = F.array().cast("array<string>")
    nodes, found = rows.select("uid", "tool", F.lit("").alias("path"), "v"), None
    for _ in range(depth):
        nodes = nodes.join(rules, ["tool", "path"])
        kind, keys = _kind(F.col("v")), F.coalesce(F.map_keys(F.try_variant_get("v", "$", "map<string, variant>")), none)
        number = F.when(kind.isin("integer", "number"), F.try_variant_get("v", "$", "double"))
        told = lambda what, names: F.transform(names, lambda k: F.concat(F.lit(what), _under(k)))
        only = lambda cond, what: F.when(F.coalesce(cond, F.lit(False)), F.array(F.concat(F.lit(what), "path"))).otherwise(none)
        is_object = kind == "object"
        wrong = F.concat(
            only(~(F.array_contains("types", kind) | (F.array_contains("types", F.lit("number")) & (kind == "integer"))), "type: "),
            only(~F.array_contains("enum", F.to_json(F.struct(F.col("v").alias("x")))), "enum: "),
            only(number < F.col("minimum"), "minimum: "), only(number > F.col("maximum"), "maximum: "),
            F.when(is_object, told("missing: ", F.array_except("required", keys))).otherwise(none),
            F.when(is_object & F.col("closed"), told("unknown: ", F.array_except(keys, "names"))).otherwise(none),
        )
        mine = nodes.select("uid", F.explode(wrong).alias("error"))
        found = mine if found is None else found.unionByName(mine)
        named = nodes.select("uid", "tool", "path", F.explode(F.try_variant_get("v", "$", "map<string, variant>")).alias("k", "v")).select("uid", "tool", _under(F.col("k")).alias("path"), "v")
        items = nodes.where(kind == "array").select("uid", "tool", F.concat("path", F.lit("[]")).alias("path"), F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
        nodes = named.unionByName(items)
    if found is None:
        return rows.select("uid", none.alias("wrong")).where("false")
    return found.groupBy("uid").agg(F.collect_set("error").alias("wrong"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `position`, counted from 0 within conv_id by `order`. Rows are range-partitioned by the whole order, numbered
    within a partition and shifted by the partitions before, so a conversation of any length is spread over tasks."""
    dealt = stored(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "ordered")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("base"))
    local = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1
    on = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.part") == F.col("r.part"))
    return dealt.withColumn("local", local).alias("l").join(bases.alias("r"), on).select("l.*", (F.col("r.base") + F.col("l.local")).cast("long").alias("position")).drop("part", "local")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call, and one a result without a call: conv_id, turn, call_id, name, level, position, has_result, errors, line.

    calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids); results: conv_id, turn, call_id,
    content; schemas: name, schema (JSON text with type (one or several), enum, minimum, maximum, properties, required,
    additionalProperties (false) and items, nested to any depth; other keywords aren't checked). Of two schemas of a name the least
    text counts.

    Of calls, and of results, with one id in a conversation the first by turn (then by content) counts: later calls get the error
    "duplicate call" and no result, later results are counted in the error "n duplicate results" of the call. errors is a sorted
    array, empty for a valid call: "unknown tool", "arguments are not an object", "missing: k", "type: k", "enum: k", "minimum: k",
    "maximum: k", "unknown: k" (k a path like a.b or a[].b, each named once),
    "missing call: id" (a need without a call), "cycle", "no result". Calls on a cycle, or that need one, have no level and come
    last. A null call id links with nothing ("no id"). Results without a call come as rows with the error "no call" and no level.
    Rows in which everything repeats stay rows of their own. Empty tables give an empty result; other columns aren't read.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    c = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), text("call_id"), text("name"), text("arguments"), "depends_on")
    r = results.select("conv_id", F.col("turn").cast("long").alias("turn"), text("call_id"), text("content"))
    c = stored(c.withColumn("uid", F.monotonically_increasing_id()), "calls")
    first = c.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments", "uid")).alias("f")).select(*KEY, F.col("f.uid").alias("uid"))
    first = stored(first, "first")
    answers = r.groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("a"), F.count(F.lit(1)).alias("results"))
    needs = c.join(first, "uid", "left_semi").select("conv_id", "call_id", F.explode("depends_on").alias("dep")).where("dep is not null").distinct()
    known = first.select("conv_id", F.col("call_id").alias("dep"))
    needs = stored(needs.join(known.withColumn("known", F.lit(True)), ["conv_id", "dep"], "left"), "needs")
    lost = needs.where("known is null").groupBy(*KEY).agg(F.sort_array(F.collect_set(F.concat(F.lit("missing call: "), "dep"))).alias("lost"))
    level = levels(first.select(*KEY), needs.where("known").select(*KEY, "dep"))
    facts = first.join(level, KEY).join(answers, KEY, "left").join(lost, KEY, "left").drop(*KEY)
    rules, depth = schema_rules(schemas)
    tools = rules.where("path = ''").select("tool")
    value = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    wrong = stored(argument_errors(c.where(is_object).select("uid", F.col("name").alias("tool"), value.alias("v")), rules, depth), "wrong")
    rows = c.join(facts, "uid", "left").join(tools, F.col("name") == F.col("tool"), "left").join(wrong, "uid", "left")

    only = lambda cond, message: F.when(cond, F.array(F.lit(message))).otherwise(F.array().cast("array<string>"))
    linked = F.col("results").isNotNull()
    unique = F.col("uid_first")
    by_schema = F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).when(~is_object, F.array(F.lit("arguments are not an object"))).otherwise(F.coalesce("wrong", F.array().cast("array<string>")))
    errors = F.concat(
        by_schema,
        F.coalesce("lost", F.array().cast("array<string>")),
        only(F.col("call_id").isNull() | F.col("conv_id").isNull(), "no id"),
        only(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & ~unique, "duplicate call"),
        only(unique & F.col("level").isNull(), "cycle"),
        only(unique & ~linked, "no result"),
        F.when(F.col("results") > 1, F.array(F.concat((F.col("results") - 1).cast("string"), F.lit(" duplicate results")))).otherwise(F.array().cast("array<string>")),
    )
    marked = rows.join(first.select("uid", F.lit(True).alias("mark")), "uid", "left").withColumn("uid_first", F.coalesce("mark", F.lit(False)))
    line = F.to_json(F.struct(value.alias("arguments"), F.col("call_id").alias("id"), F.col("name"), F.col("a.content").alias("result"), F.lit("tool_call").alias("type")))
    out = marked.select("conv_id", "turn", "call_id", "name", "level", linked.alias("has_result"), F.sort_array(errors).alias("errors"), line.alias("line"))
    stray = r.join(first, KEY, "left_anti").select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.lit(True).alias("has_result"), F.array(F.lit("no call")).alias("errors"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"), F.lit("tool_result").alias("type"))).alias("line"),
    )
    last = F.coalesce("level", F.lit(2**31 - 1))
    return positions(out.unionByName(stray).withColumn("rank", last), ["rank", "turn", "call_id", "line"]).drop("rank")


#: The tools that `calls_of_turns` uses.
TOOLS = [
    ("search", '{"properties":{"query":{"type":"string"},"limit":{"type":"integer"}},"required":["query","limit"],"additionalProperties":false}'),
    ("translate", '{"properties":{"text":{"type":"string"},"to":{"type":"string","enum":["de","en","es","fr"]}},"required":["text","to"]}'),
    ("measure", '{"properties":{"text":{"type":"string"},"scale":{"type":"number"}},"required":["text"],"additionalProperties":false}'),
]


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of all turns of conversations: every user's turn becomes a call whose arguments hold its text, every
    assistant's turn the result of the turn before, and every other turn (system, tool, any other role or none), and what repeats an
    assistant's turn, a result of its own that no call has. A call needs that of two turns before, so a conversation is one chain. By a
    hash of their place, some calls lack an argument or have one of a wrong type, so that validation has work."""
    t = F.col("turn").cast("long")
    place = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(12))
    name_of = lambda turn: F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    size = F.length("text").cast("long")
    search = F.to_json(F.struct(F.col("text").alias("query"), F.when(place == 0, F.lit("ten")).otherwise((size % 50).cast("string")).alias("limit")))
    search = F.when(place == 0, search).otherwise(F.to_json(F.struct(F.col("text").alias("query"), (size % 50).alias("limit"))))
    translate = F.to_json(F.struct(F.element_at(F.array(*map(F.lit, ["de", "en", "es", "fr", "xx"])), (size % 5 + 1).cast("int")).alias("to"), F.when(place != 5, F.col("text")).alias("text")))
    measure = F.to_json(F.struct(F.col("text"), (size / 4).alias("scale")))
    kind = place % 3
    calls = turns.where("role = 'user'").select(
        "conv_id", t.alias("turn"), name_of(t).alias("call_id"),
        F.when(kind == 0, "search").when(kind == 1, "measure").otherwise("translate").alias("name"),
        F.when(kind == 0, search).when(kind == 1, measure).otherwise(translate).alias("arguments"),
        F.when(t >= 2, F.array(name_of(t - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    others = turns.where("not coalesce(role = 'user', false)").select("conv_id", t.alias("turn"), "role", F.col("text").alias("content"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn", "role").orderBy("content"))
    own = F.concat_ws("_", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    call_id = F.when((F.col("role") == "assistant") & (F.col("nth") == 1), name_of(F.col("turn") - 1)).otherwise(own)
    return calls, others.withColumn("nth", nth).select("conv_id", "turn", call_id.alias("call_id"), "content")


def format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of_turns(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(j).alias("schema")) for n, j in TOOLS]))))
