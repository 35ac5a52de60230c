"""Chat formatting: tool-call linking, in DataFrame functions only.

Calls and results are hash-joined on (conversation, call id). Calls may refer to
results of other calls by {"$ref": "id"} strings in their arguments; levels give
a topological order: a call stands one level above the calls it refers to, its
result directly behind it. Arguments are validated against schemas (name,
argument, type, required) by parsing them to VARIANT. Records are canonical
JSON: keys in order, no spaces.

Order is given as sort columns (level, turn, step), not by numbering, so a very
long conversation is never gathered in a task.

Defined results: null or malformed arguments are invalid and serialised as null;
a call without result has linked false, a result without call is kept as an
orphan; of several results with one id the earliest counts as the link and all
are kept; of repeated calls with one id each is linked; calls in a reference
cycle, and those above one, have a null level; null ids never link; calls of
a null turn sort first; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import keep, materialize, release, scratch

TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical(json: Column) -> Column:
    """JSON text with ordered keys and no spaces; null if malformed."""
    return F.to_json(F.try_parse_json(json))


def parse_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in messages (conv_id, turn, role, text).

    An assistant's call is <tool_call>{"id", "name", "arguments"}</tool_call>; a message of role tool is
    {"tool_call_id", "content"}.
    """
    shape = "id string, name string, arguments string"
    calls = (
        messages.where("role = 'assistant'")
        .select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))).alias("j"))
        .select("conv_id", "turn", F.from_json("j", shape).alias("c"))
        .select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    )
    results = messages.where("role = 'tool'").select(
        "conv_id", "turn", F.get_json_object("text", "$.tool_call_id").alias("call_id"), F.get_json_object("text", "$.content").alias("content")
    )
    return calls, results


def validate(calls: DataFrame, schema: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """Adds `arguments_json` (canonical) and `valid`: a known name, an object with every required argument and no unknown or mistyped one.

    schema: tool name -> argument -> (type, required); it is code, so its size does not grow with data.
    """
    out = calls.withColumn("_v", F.try_parse_json("arguments")).withColumn("arguments_json", F.to_json("_v"))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    out = out.withColumn("_m", F.when(is_object, F.col("_v").cast("map<string,variant>")))
    ok = F.lit(False)
    for name, args in schema.items():
        good = F.col("_m").isNotNull()
        if args:
            good &= F.size(F.array_except(F.map_keys("_m"), F.array(*(F.lit(a) for a in args)))) == 0
        else:
            good &= F.size("_m") == 0
        for a, (kind, required) in args.items():
            got = F.schema_of_variant(F.col("_m")[a])
            typed = got.rlike(f"^(?:{TYPES[kind]})$")
            good &= F.coalesce(typed, F.lit(not required))
        ok = F.when(F.col("name") == name, F.coalesce(good, F.lit(False))).otherwise(ok)
    return out.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_v", "_m")


def levels(calls: DataFrame) -> DataFrame:
    """Adds `level`: 0 for a call that refers to none, else one more than the highest it refers to; null in cycles and above them.

    The reference graph is contracted by rounds: a reference to a call without open references is settled, one to a call
    with a single open reference skips that call. A chain of d references takes log2(d) rounds, every round three jobs.
    """
    with scratch():
        found = _levels(calls)
        if found is None:
            return calls.withColumn("level", F.lit(0))
        keep(found)
    # a call that neither refers nor is referred to takes no part
    state = found.withColumn("_in", F.lit(True))
    return calls.join(state, ["conv_id", "call_id"], "left").withColumn("level", F.when(F.col("_in"), F.col("level")).otherwise(0)).drop("_in")


def _levels(calls: DataFrame) -> DataFrame | None:
    refs = F.regexp_extract_all("arguments", F.lit(r'\{\s*"\$ref"\s*:\s*"([^"]*)"\s*\}'), F.lit(1))
    edges = calls.where(F.col("arguments").contains('"$ref"')).select("conv_id", "call_id", F.explode(refs).alias("to")).where("call_id is not null").distinct()
    known = calls.select("conv_id", F.col("call_id").alias("to")).distinct()
    edges = materialize(edges.join(known, ["conv_id", "to"], "left_semi").select("conv_id", "call_id", "to", F.lit(1).cast("long").alias("w"), F.lit(True).alias("moved")), "refs")
    if edges.isEmpty():
        return None
    nodes = edges.select("conv_id", "call_id").unionByName(edges.select("conv_id", F.col("to").alias("call_id"))).distinct()
    base = materialize(nodes.withColumn("level", F.lit(0).cast("long")), "levels")
    # a path of more steps than there are calls goes round a cycle
    most, endless, left = base.count(), 1 << 40, -1
    while True:
        state = edges.agg(F.count("*").alias("n"), F.max("moved").alias("moved")).first()
        if not state.n:
            break
        # where every open reference leads to a call with several, all of them lead into cycles
        stuck = state.n == left and not state.moved
        out = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.max("to").alias("next"), F.max("w").alias("step"))
        via = out.join(base, ["conv_id", "call_id"], "right").withColumnsRenamed({"call_id": "to", "level": "far"})
        over = edges.join(via, ["conv_id", "to"])
        round_ = F.lit(True) if stuck else (F.col("call_id") == F.col("to")) | (F.col("w") > most)
        gain = F.when(round_, endless).otherwise(F.least(F.lit(endless), F.col("far") + F.col("w")))
        over = materialize(over.withColumn("cycle", round_).withColumn("gain", gain), "over")
        raised = over.groupBy("conv_id", "call_id").agg(F.max("gain").alias("gain"))
        old_base, old_edges = base, edges
        base = materialize(base.join(raised, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("level", F.coalesce("gain", "level")).alias("level")), "levels")
        single = F.col("n") == 1
        going = over.where("n is not null and not cycle").select(
            "conv_id", "call_id", F.when(single, F.col("next")).otherwise(F.col("to")).alias("to"), (F.col("w") + F.when(single, F.col("step")).otherwise(0)).alias("w"), single.alias("moved")
        )
        edges = materialize(going.groupBy("conv_id", "call_id", "to").agg(F.max("w").alias("w"), F.max("moved").alias("moved")), "refs")
        left = state.n
        for old in (old_base, old_edges, over):
            release(old)
    return materialize(base.select("conv_id", "call_id", F.when(F.col("level") < endless, F.col("level").cast("int")).alias("level")), "levels")


def link(calls: DataFrame, results: DataFrame, schema: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """Records in order of (conv_id, level, turn, step): conv_id, level, turn, step (0 call, 1 result), call_id, linked, valid, record."""
    first = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"))
    c = levels(validate(calls.select("conv_id", "turn", "call_id", "name", "arguments"), schema)).join(first, ["conv_id", "call_id"], "left")
    # the arguments are put in as JSON text, so that they are not quoted again
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments_json", F.lit("null")), F.lit(',"id":'), _quote("call_id"), F.lit(',"name":'), _quote("name"), F.lit(',"type":"call"}')
    )
    left = c.select("conv_id", "level", "turn", F.lit(0).alias("step"), "call_id", F.col("result_turn").isNotNull().alias("linked"), "valid", record.alias("record"))
    known = c.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("level").alias("level"), F.min("turn").alias("call_turn"))
    r = results.select("conv_id", "turn", "call_id", "content").join(known, ["conv_id", "call_id"], "left")
    record = F.concat(F.lit('{"content":'), _quote("content"), F.lit(',"id":'), _quote("call_id"), F.lit(',"type":"result"}'))
    right = r.select("conv_id", "level", "turn", F.lit(1).alias("step"), "call_id", F.col("call_turn").isNotNull().alias("linked"), F.lit(True).alias("valid"), record.alias("record"))
    return left.unionByName(right)


def _quote(col: str) -> Column:
    """A string as JSON text, null as null."""
    one = F.to_json(F.array(F.col(col).cast("string")))
    return F.substring(one, F.lit(2), F.length(one) - 2)
