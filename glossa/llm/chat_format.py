"""Chat formatting: links tool calls with their results, orders them, validates arguments, and writes canonical JSON.

DataFrame functions only.  Calls and results meet in a hash join by conversation and identifier; repeated identifiers are
reduced to one before it, by sums that merge.  Arguments are checked as variants against a table of schemas, row by row.
A conversation is one JSON text in the end, so its messages are gathered in one row.  Its calls are put in topological
order there: always the first call whose known dependencies are done.  By turn that is the order as it stands, unless a
call depends on a later one or itself; only such conversations go through a fold, which is cubic in their calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Schemas (tools) that are broadcast; more are joined by shuffle.
MAX_TOOLS = 10_000


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls (name, arguments: JSON text) with args (variant) and errors (sorted array<string>).

    schemas: tool, field, type (string, integer, number, boolean, array, object), required, minimum, maximum.  Errors are
    "arguments" (no JSON object), "tool" (unknown name), "missing:f", "unknown:f", "type:f" and "range:f".  Only a null
    value passes for any type that is not required.
    """
    tools = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("field", "type", "required", "minimum", "maximum"))).alias("fields")).withColumnRenamed("tool", "name")
    bounded = tools.limit(MAX_TOOLS + 1).count() <= MAX_TOOLS
    parsed = calls.withColumn("args", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("given", F.when(F.schema_of_variant("args").startswith("OBJECT"), F.expr("try_cast(args as map<string, variant>)")))
    joined = parsed.join(F.broadcast(tools) if bounded else tools, "name", "left")
    kind = "schema_of_variant(element_at(given, f.field))"
    value = "try_variant_get(element_at(given, f.field), '$', 'double')"
    fits = (
        f"(case f.type when 'string' then {kind} = 'STRING' when 'boolean' then {kind} = 'BOOLEAN' when 'integer' then {kind} = 'BIGINT' "
        f"when 'number' then {kind} = 'BIGINT' or {kind} = 'DOUBLE' or {kind} like 'DECIMAL%' when 'array' then {kind} like 'ARRAY%' when 'object' then {kind} like 'OBJECT%' else true end)"
    )
    bad = F.expr(
        "case when given is null then array('arguments') when fields is null then array('tool') else array_sort(concat("
        "transform(filter(fields, f -> f.required and not map_contains_key(given, f.field)), f -> concat('missing:', f.field)), "
        "transform(filter(map_keys(given), k -> not exists(fields, f -> f.field = k)), k -> concat('unknown:', k)), "
        f"transform(filter(fields, f -> map_contains_key(given, f.field) and not {fits} and not ({kind} = 'VOID' and not f.required)), f -> concat('type:', f.field)), "
        f"transform(filter(fields, f -> map_contains_key(given, f.field) and coalesce({value} < f.minimum or {value} > f.maximum, false)), f -> concat('range:', f.field))"
        ")) end"
    )
    return joined.withColumn("errors", bad).drop("given", "fields")


def topological(calls_column: str) -> str:
    """SQL of a fold: the calls (call_id, depends, ...) of an array, dependencies first, else in the array's order.

    Dependencies that are not in the array don't count.  Calls on a cycle, and those behind one, come last, in order.
    """
    c = calls_column
    ready = f"filter({c}, x -> not array_contains(s.done, x.call_id) and size(array_except(array_intersect(x.depends, s.ids), s.done)) = 0)"
    left = f"filter({c}, x -> not array_contains(s.done, x.call_id))"
    step = f"slice(concat({ready}, {left}), 1, 1)"
    return (
        f"aggregate(sequence(1, greatest(size({c}), 1)), named_struct('done', cast(array() as array<string>), 'ids', transform({c}, x -> x.call_id), 'cyclic', 0, 'last', {c}), "
        f"(s, k) -> named_struct('done', concat(s.done, transform({step}, x -> x.call_id)), 'ids', s.ids, 'cyclic', s.cyclic + if(size({ready}) = 0 and size({left}) > 0, 1, 0), 'last', s.last))"
    )


def link_tools(calls: DataFrame, results: DataFrame, schemas: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One row per conversation with calls or results: conv_id, n_calls, n_linked, n_orphans, n_invalid, n_cyclic, json.

    calls: conv_id, call_id, turn, name, arguments (JSON text), depends (array<string>).  results: conv_id, call_id,
    content.  Of calls with one identifier in a conversation the one of the least turn stays (then least name, arguments),
    of results the least content; both null identifiers and results without a call are no part of the JSON, the latter
    counted as orphans.  Null depends are none, null arguments invalid.  Empty tables give no rows; extra columns are
    ignored.  json has sorted keys, no spaces, and null for a missing result.

    turns: conv_id, turn, role, text of what is neither a call nor a result.  A conversation with such turns has them after
    its calls, as "turns" in the order of turn, role and text; it has a row even without calls and results.
    """
    one = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", F.coalesce("depends", F.array().cast("array<string>")).alias("depends"))).alias("c")
    ).select("conv_id", "call_id", "c.*")
    answer = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("content").alias("content")).withColumn("answered", F.lit(True))
    checked = validate(one, schemas).select("conv_id", "call_id", "turn", "name", "args", "errors", "depends", F.lit(True).alias("called"))
    left, right = checked.alias("l"), answer.alias("r")
    on = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.call_id") == F.col("r.call_id"))
    linked = left.join(right.hint("shuffle_hash"), on, "full_outer").select(
        F.coalesce("l.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("l.call_id", "r.call_id").alias("call_id"),
        "turn", "name", F.to_json("args").alias("args"), "errors", "depends", F.coalesce("called", F.lit(False)).alias("called"), "content", F.coalesce("answered", F.lit(False)).alias("answered"),
    )
    linked = linked.withColumn("said", F.lit(None).cast("struct<turn:bigint,role:string,text:string>"))
    if turns is not None:
        said = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), "role", "text").alias("said"))
        linked = linked.unionByName(said.withColumns({"called": F.lit(False), "answered": F.lit(False)}), allowMissingColumns=True)
    quoted = lambda c: F.to_json(F.array(c))
    text = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce("args", F.lit("null")), F.lit(',"errors":'), F.to_json("errors"), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), F.coalesce(text("name"), F.lit("null")),
        F.lit(',"result":'), F.when(F.col("content").isNull(), F.lit("null")).otherwise(text("content")), F.lit("}"),
    )
    entry = F.struct("turn", "call_id", "depends", body.alias("body"))
    grouped = linked.groupBy("conv_id").agg(
        F.count_if("called").alias("n_calls"), F.count_if(F.col("called") & F.col("answered")).alias("n_linked"), F.count_if(~F.col("called") & F.col("said").isNull()).alias("n_orphans"), F.array_sort(F.collect_list("said")).alias("said"),
        F.count_if(F.col("called") & (F.size("errors") > 0)).alias("n_invalid"), F.array_sort(F.collect_list(F.when(F.col("called"), entry))).alias("entries"),
    )
    # Where every dependency stands before its call the order is the array's; only other conversations are folded.
    late = "exists(transform(entries, (x, i) -> exists(x.depends, d -> array_position(ids, d) > i)), b -> b)"
    ordered = grouped.withColumn("ids", F.expr("transform(entries, x -> x.call_id)")).withColumn("late", F.expr(late))
    ordered = ordered.withColumn("o", F.when(F.col("late"), F.expr(topological("entries"))))
    sought = F.expr("array_join(transform(o.done, d -> element_at(filter(entries, e -> e.call_id = d), 1).body), ',')")
    bodies = F.when(F.col("late"), sought).otherwise(F.expr("array_join(transform(entries, x -> x.body), ',')"))
    value = lambda c: f"coalesce(substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2), 'null')"
    one_turn = f"""concat('{{"role":', {value("x.role")}, ',"text":', {value("x.text")}, ',"turn":', coalesce(cast(x.turn as string), 'null'), '}}')"""
    others = F.when(F.size("said") > 0, F.concat(F.lit(',"turns":['), F.expr(f"array_join(transform(said, x -> {one_turn}), ',')"), F.lit("]"))).otherwise(F.lit(""))
    return ordered.select(
        "conv_id", "n_calls", "n_linked", "n_orphans", "n_invalid", F.coalesce(F.col("o.cyclic"), F.lit(0)).cast("long").alias("n_cyclic"),
        F.concat(F.lit('{"calls":['), F.when(F.size("entries") > 0, bodies).otherwise(F.lit("")), F.lit("]"), others, F.lit("}")).alias("json"),
    )


#: The schema of turns read as calls: a prompt that a reply answers.
REPLY_SCHEMA = [("chat.reply", "prompt", "string", True, None, None), ("chat.reply", "turn", "integer", True, 0.0, None)]


def conversations_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls, results, schema and other turns of a table of turns: a user's turn asks chat.reply, the assistant's next turn
    answers.

    A user's turn depends on the one two turns before.  Other turns are those of other roles, an assistant's turn that no
    user's turn precedes, and what repeats the turn number of a call or result.
    """
    spark = conversations.sparkSession
    key = lambda shift: F.concat_ws(":", F.lit("t"), (F.col("turn") - shift).cast("string"))
    asked, answer = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").cast("long").alias("turn")))
    rows = conversations.select("conv_id", "turn", "role", "text", asked.alias("asked"), answer.alias("answer"), F.when(asked, arguments).alias("arguments"))
    talk = rows.where("asked or answer").withColumn("call_id", F.when(F.col("asked"), key(0)).otherwise(key(1)))
    place = Window.partitionBy("conv_id", "call_id")
    talk = talk.withColumn("has_call", F.max("asked").over(place)).withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "call_id", "asked").orderBy("arguments", F.asc_nulls_last("text"))))
    calls = talk.where("asked and k = 1").select(
        "conv_id", "call_id", F.col("turn").cast("long").alias("turn"), F.lit("chat.reply").alias("name"), "arguments", F.array(key(2)).alias("depends"),
    )
    results = talk.where("answer").select("conv_id", "call_id", F.col("text").alias("content"))
    left = talk.where("k > 1 or not has_call").select("conv_id", "turn", "role", "text")
    turns = rows.where("not asked and not answer").select("conv_id", "turn", "role", "text").unionByName(left)
    schemas = spark.createDataFrame(REPLY_SCHEMA, "tool string, field string, type string, required boolean, minimum double, maximum double")
    return calls, results, schemas, turns
