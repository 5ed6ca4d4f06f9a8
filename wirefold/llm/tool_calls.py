"""Tool-call linking for chat data (DataFrame operations only).

Calls and results are hash-joined by (conversation, call id). The links that
calls have to earlier calls are put in topological order: a call whose links all
lead to placed calls is placed next, and a whole run of calls that wait for one
call each is placed with its head, by pointer doubling. Arguments are parsed
to variants, checked against the schemas, and written as canonical JSON (keys
sorted, no white space). Every join key holds the call id, so a conversation
with a third of all rows is spread over all tasks; nothing is collected per
conversation, and the order is a column (level, then turn and call id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm.common import stored, table

#: tool -> parameter -> (JSON type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]

#: JSON types by the type names of variants.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def canonical_json(text: Column) -> Column:
    """The JSON value with sorted keys and no white space; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(text))


def quoted(text: Column) -> Column:
    """A text as a JSON string (null: ``null``)."""
    wrapped = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_replace(F.regexp_replace(wrapped, r"^\{\"v\":", ""), r"\}$", "")


def _type_ok(value: Column, kind: str) -> Column:
    name = F.schema_of_variant(value)
    if kind == "number":
        return name.startswith("DECIMAL") | name.isin("BIGINT", "DOUBLE", "FLOAT")
    return name.startswith(TYPES[kind])


def argument_errors(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of errors of a call: ``malformed``, ``unknown_tool``,
    ``missing:<p>``, ``type:<p>`` and ``unknown:<p>``."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    checks = F.array(F.lit("unknown_tool"))
    for name, params in schemas.items():
        said = []
        for p, (kind, required) in params.items():
            value = F.try_variant_get(parsed, f"$['{p}']", "variant")
            if required:
                said.append(F.when(value.isNull(), F.lit(f"missing:{p}")))
            said.append(F.when(value.isNotNull() & ~F.coalesce(_type_ok(value, kind), F.lit(False)), F.lit(f"type:{p}")))
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(F.to_json(parsed)), F.array().cast("array<string>")),
                                           F.array(*[F.lit(p) for p in params]).cast("array<string>")),
                            lambda k: F.concat(F.lit("unknown:"), k))
        found = F.array_compact(F.array(*said).cast("array<string>")) if said else F.array().cast("array<string>")
        checks = F.when(tool == name, F.concat(found, extra)).otherwise(checks)
    return F.array_sort(F.when(is_object, checks).otherwise(F.array(F.lit("malformed"))))


def _run_heads(singles: DataFrame) -> DataFrame:
    """``singles`` (conv_id, call_id, parent, least, steps): each row's level is
    the larger of ``least`` and its parent's level + ``steps``. Returns them with
    ``parent`` moved along the run to the first call that is not itself one of
    ``singles``. Rows on or behind a cycle keep one of them as parent."""
    hops = singles
    for _ in range(max(1, singles.count().bit_length() + 1)):
        beyond = hops.select("conv_id", F.col("call_id").alias("parent"), F.col("parent").alias("b_parent"),
                             F.col("least").alias("b_least"), F.col("steps").alias("b_steps"))
        hops = stored(hops.join(beyond.hint("shuffle_hash"), ["conv_id", "parent"], "left").select(
            "conv_id", "call_id", F.coalesce("b_parent", "parent").alias("parent"),
            F.greatest("least", F.col("b_least") + F.col("steps")).alias("least"),
            (F.col("steps") + F.coalesce("b_steps", F.lit(0))).alias("steps"),
            F.col("b_parent").isNotNull().alias("moved")), "call-hops")
        if hops.filter("moved").isEmpty():
            break
        hops = hops.drop("moved")
    return hops.drop("moved")


def topological_levels(calls: DataFrame, links: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without links, else one more than the
    deepest linked call; null on or behind a cycle. ``links`` (conv_id, call_id,
    parent) to calls that don't exist are ignored, and so are calls with a null
    key. A run of n calls with one open link each takes about log2(n) joins; a
    round is needed for each further call that waits for two or more at once."""
    key = ["conv_id", "call_id"]
    nodes = stored(calls.select(*key).dropna().distinct(), "call-nodes")
    open_links = (links.filter("parent IS NOT NULL").select("conv_id", "call_id", "parent").distinct()
                  .join(nodes, key, "left_semi")
                  .join(nodes.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_semi"))
    open_links = stored(open_links, "call-links")
    placed, waiting = [], nodes.withColumn("least", F.lit(0).cast("long"))
    while True:
        degree = open_links.groupBy(*key).agg(F.count(F.lit(1)).alias("waits"), F.min("parent").alias("parent"))
        state = stored(waiting.join(degree, key, "left"), "call-state")
        ready = state.filter("waits IS NULL").select(*key, F.col("least").alias("level"))
        if ready.isEmpty():
            break
        done = ready
        singles = state.filter("waits = 1").select(*key, "parent", "least", F.lit(1).cast("long").alias("steps"))
        if not singles.isEmpty():
            heads = ready.select("conv_id", F.col("call_id").alias("parent"), "level")
            done = done.unionAll(_run_heads(singles).join(heads, ["conv_id", "parent"]).select(
                *key, F.greatest("least", F.col("level") + F.col("steps")).alias("level")))
        done = stored(done, "call-levels")
        placed.append(done)
        left = state.select(*key, "least").join(done, key, "left_anti")
        if left.isEmpty():
            waiting = left
            break
        parents = done.select("conv_id", F.col("call_id").alias("parent"), "level")
        reached = (open_links.join(parents, ["conv_id", "parent"]).groupBy(*key)
                   .agg((F.max("level") + 1).alias("reached")))
        waiting = stored(left.join(reached, key, "left")
                         .select(*key, F.greatest("least", "reached").alias("least")), "call-waiting")
        open_links = stored(open_links.join(parents, ["conv_id", "parent"], "left_anti")
                            .join(waiting, key, "left_semi").select(*key, "parent"), "call-links")
    out = waiting.select(*key, F.lit(None).cast("long").alias("level"))
    for p in placed:
        out = out.unionAll(p)
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per (conv_id, call_id) of either side: turn, level, status,
    valid, errors, message.

    ``calls``: conv_id, call_id, turn, tool, arguments (JSON text), parents
    (array of call ids). ``results``: conv_id, call_id, turn, content. Status is
    ``linked``, ``no_result``, ``no_call`` or ``cycle``. Of repeated ids the
    earliest turn counts (then the smallest content). Rows with a null
    conversation or call id can't be linked: each side's are grouped under null
    and have status no_result or no_call. ``message`` is canonical JSON with the
    call, its result and its level. A null result is JSON null; arguments that
    don't parse are JSON null with the error ``malformed``. Empty tables give no
    rows; further columns are not read.
    """
    key = ["conv_id", "call_id"]
    one_call = calls.groupBy(*key).agg(F.min(F.struct("turn", "tool", "arguments", "parents")).alias("c"))
    one_call = stored(one_call.select(*key, "c.*"), "calls")
    one_result = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"))
    one_result = one_result.select(*key, F.col("r.turn").alias("result_turn"), "r.content", F.lit(True).alias("has_result"))
    links = one_call.select(*key, F.explode("parents").alias("parent"))
    levels = topological_levels(one_call, links)
    known = one_call.withColumn("has_call", F.lit(True)).join(levels.hint("shuffle_hash"), key, "left")
    both = known.hint("shuffle_hash").join(one_result.hint("shuffle_hash"), key, "full")
    has_call, has_result = F.coalesce("has_call", F.lit(False)), F.coalesce("has_result", F.lit(False))
    nameless = F.col("conv_id").isNull() | F.col("call_id").isNull()
    status = (F.when(~has_call, "no_call").when(F.col("level").isNull() & ~nameless, "cycle")
              .when(has_result, "linked").otherwise("no_result"))
    errors = F.when(has_call, argument_errors(F.col("tool"), F.col("arguments"), schemas)).otherwise(
        F.array().cast("array<string>"))
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")),
        F.lit(',"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), quoted(F.col("tool")), F.lit(',"status":'), quoted(F.col("status")), F.lit("}"))
    return (both.withColumn("status", status).withColumn("errors", errors)
            .select(*key, F.coalesce("turn", "result_turn").alias("turn"), "level", "status",
                    (has_call & (F.size("errors") == 0)).alias("valid"), F.concat_ws(",", "errors").alias("errors"),
                    message.alias("message")))


#: The tools of the registered query.
QUERY_SCHEMAS: Schemas = {
    "search": {"text": ("string", True), "words": ("integer", True)},
    "translate": {"text": ("string", True), "words": ("integer", True), "target": ("string", True)},
    "summarise": {"text": ("string", True)},
}


def conversation_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls and results from the conversations: each user turn calls a tool
    with its whole text, and each assistant turn answers the turn before it.
    A call follows the call two turns before, so a conversation is one chain."""
    rows = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    tool = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("summarise")), (F.pmod(F.expr("turn div 2"), F.lit(3)) + 1).cast("int"))
    arguments = F.to_json(F.struct(F.size(F.split("text", " ")).alias("words"), F.col("text")))
    before = F.col("turn") - 2
    parents = F.array(name(before))
    calls = rows.filter("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), "turn", tool.alias("tool"),
                                                arguments.alias("arguments"), parents.alias("parents"))
    results = rows.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn",
                                                       F.col("text").alias("content"))
    return calls, results


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*conversation_calls(spark, sf_dir), QUERY_SCHEMAS)
