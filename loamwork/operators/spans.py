"""Messages of agent traces from their spans, whose payloads are JSON texts.

spans: trace, seq (order of arrival), span_id, id, root (boolean), created,
name, kind (llm, tool ...), input, output.  Payloads are parsed as variants, so
that any shape of JSON is read without a schema and without Python.  Messages
are rows; a trace is never gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CALL = "struct<name:string,arguments:string,id:string>"
#: A message: its role, content, tool calls, the call that it answers and the name of the tool.
MESSAGE = f"struct<role:string,content:string,tool_calls:array<{_CALL}>,tool_call_id:string,name:string>"


def _kind(v: str) -> str:
    """SQL for object, array, string ... of a variant."""
    return f"lower(regexp_extract(schema_of_variant({v}), '^[A-Za-z]+', 0))"


def _is(v: str, kind: str) -> str:
    return f"coalesce({_kind(v)} = '{kind}', false)"


def _get(v: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({v}, '{path}', '{kind}')"


def _text(v: str) -> str:
    """SQL for a value as text: strings and numbers as they are, objects and arrays as JSON; null stays null."""
    return f"CASE WHEN is_variant_null({v}) THEN NULL WHEN {_kind(v)} IN ('object', 'array') THEN to_json({v}) ELSE try_cast({v} AS string) END"


def _call(c: str, i: str) -> str:
    """SQL for one tool call given by an object with name and arguments."""
    return f"named_struct('name', {_text(_get(c, '$.name'))}, 'arguments', coalesce({_text(_get(c, '$.arguments'))}, '{{}}'), 'id', {i})"


def _calls(m: str) -> str:
    """SQL for a message's tool calls, in any of three layouts (TRC-18)."""
    raw, old = _get(m, "$.tool_calls"), _get(m, "$.function")
    ident = lambda v: _get(v, "$.id", "string")
    one = f"CASE WHEN {_is(_get('c', '$.function.name'), 'string')} THEN {_call(_get('c', '$.function'), ident('c'))} WHEN {_get('c', '$.name')} IS NOT NULL THEN {_call('c', ident('c'))} END"
    listed = f"filter(transform(filter({_get(m, '$.tool_calls', 'array<variant>')}, c -> {_is('c', 'object')}), c -> {one}), c -> c IS NOT NULL)"
    none = f"cast(array() AS array<{_CALL}>)"
    empty = f"({raw} IS NULL OR is_variant_null({raw}) OR coalesce(size({_get(m, '$.tool_calls', 'array<variant>')}) = 0, false))"
    return f"CASE WHEN {empty} AND {_is(old, 'object')} THEN array({_call(old, ident(m))}) WHEN {empty} THEN {none} ELSE coalesce({listed}, {none}) END"


def _message(m: str) -> str:
    """SQL for one message given by an object; without a role it is the assistant's."""
    content = f"coalesce({_text(_get(m, '$.content'))}, '')"
    return f"named_struct('role', coalesce({_get(m, '$.role', 'string')}, 'assistant'), 'content', {content}, 'tool_calls', {_calls(m)}, 'tool_call_id', {_get(m, '$.tool_call_id', 'string')}, 'name', {_get(m, '$.name', 'string')})"


def _said(text: str) -> str:
    """SQL for what the assistant says in a bare text."""
    return f"array(named_struct('role', 'assistant', 'content', {text}, 'tool_calls', cast(array() AS array<{_CALL}>), 'tool_call_id', cast(NULL AS string), 'name', cast(NULL AS string)))"


def _list(v: str) -> str:
    return f"transform(filter({v}, m -> {_is('m', 'object')}), m -> {_message('m')})"


_NONE = f"cast(array() AS array<{MESSAGE}>)"


def _bound(payload: str, body: str) -> Column:
    """*body* over v, the payload parsed once; none for what is missing or no JSON."""
    return F.expr(f"coalesce(get(transform(array(try_parse_json({payload})), v -> {body}), 0), {_NONE})")


def input_messages(payload: str) -> Column:
    """Messages of an input column: a list, or an object's list named messages (TRC-17)."""
    return _bound(payload, f"CASE WHEN {_is('v', 'array')} THEN {_list('try_cast(v AS array<variant>)')} WHEN {_is('v', 'object')} THEN {_list(_get('v', '$.messages', 'array<variant>'))} END")


def output_messages(payload: str) -> Column:
    """Messages of an output column: a text, a message, a list of them, or an object with messages or content (TRC-18)."""
    listed = _get("v", "$.messages", "array<variant>")
    content = _text(_get("v", "$.content"))
    body = (
        f"CASE WHEN {_is('v', 'string')} AND cast(v AS string) <> '' THEN {_said('cast(v AS string)')} WHEN {_is('v', 'array')} THEN {_list('try_cast(v AS array<variant>)')} "
        f"WHEN {_is('v', 'object')} AND {_get('v', '$.role')} IS NOT NULL THEN array({_message('v')}) "
        f"WHEN {_is('v', 'object')} AND size({listed}) > 0 THEN {_list(listed)} "
        f"WHEN {_is('v', 'object')} AND coalesce({content}, '') <> '' THEN {_said(content)} END"
    )
    return _bound(payload, body)


def tool_response(payload: str, name: Column, call_id: Column) -> Column:
    """A tool span's message: its text, or its content or result, or all of it (TRC-27); none without output."""
    inner = f"coalesce({_get('v', '$.content')}, {_get('v', '$.result')})"
    text = f"get(transform(array(try_parse_json({payload})), v -> CASE WHEN {_is('v', 'object')} THEN coalesce({_text(inner)}, CASE WHEN {inner} IS NULL THEN to_json(v) END, '') ELSE {_text('v')} END), 0)"
    role = F.struct(F.lit("tool").alias("role"), F.expr(text).alias("content"), F.array().cast(f"array<{_CALL}>").alias("tool_calls"), F.nullif(call_id, F.lit("")).alias("tool_call_id"), F.nullif(name, F.lit("")).alias("name"))
    return F.when(F.expr(text).isNotNull(), F.array(role.cast(MESSAGE))).otherwise(F.expr(_NONE))


def trace_messages(spans: DataFrame) -> DataFrame:
    """The conversation of each trace: trace, strategy, place (from 0), role, content, tool_calls, tool_call_id, name (TRC-17).

    1. The root's input, if it holds an assistant's message.
    2. Else the llm span with the most input messages (the first of equals):
       these, its output, and what later spans put out, each content once and
       none that the input holds; if there is an assistant's message in it.
    3. Else the root's input and the output of all spans in order.

    Spans are ordered by creation, then arrival.  Traces without a root, and
    those without any message, give no rows.
    """
    order = Window.partitionBy("trace").orderBy(F.coalesce("created", F.lit("")), "seq")
    call = F.coalesce(F.nullif("span_id", F.lit("")), "id")
    roots = spans.where("root").select("trace", input_messages("input").alias("m"))
    kids = spans.where("NOT root").join(roots.select("trace").distinct(), "trace", "left_semi")
    kids = kids.select(
        "trace", F.row_number().over(order).alias("n"), (F.col("kind") == "llm").alias("llm"), F.coalesce(F.col("kind") == "tool", F.lit(False)).alias("tool"),
        input_messages("input").alias("asked"), output_messages("output").alias("said"), tool_response("output", F.col("name"), call).alias("answer"),
    )
    talks = lambda c: F.exists(c, lambda m: m["role"] == "assistant")
    best = kids.where("llm").groupBy("trace").agg(F.min(F.struct((-F.size("asked")).alias("size"), F.col("n").alias("best"))).alias("b")).select("trace", "b.best")
    flags = roots.groupBy("trace").agg(F.max(talks("m")).alias("root_talks"))

    def rows(some: DataFrame, part: int, column: str, n: Column) -> DataFrame:
        return some.select("trace", F.lit(part).alias("part"), n.alias("n"), F.posexplode(column).alias("at", "m"))

    own = kids.join(best, "trace")
    first = rows(own.where("n = best"), 0, "asked", F.lit(0))
    reply = rows(own.where("n = best"), 1, "said", F.lit(0))
    later = rows(own.where("n > best").withColumn("out", F.when(F.col("tool"), F.col("answer")).otherwise(F.col("said"))), 2, "out", F.col("n"))
    content = F.col("m.content")
    once = F.row_number().over(Window.partitionBy("trace", content).orderBy("n", "at"))
    seen = first.where(content != "").select("trace", content.alias("known")).distinct()
    later = later.withColumn("k", once).where("k = 1").drop("k").join(seen, (later["trace"] == seen["trace"]) & content.eqNullSafe(F.col("known")), "left_anti")
    second = first.union(reply).union(later)
    good = second.groupBy("trace").agg(F.max(F.col("m.role") == "assistant").alias("child_talks"))
    flags = flags.join(good, "trace", "left").select("trace", F.when(F.col("root_talks"), 1).when(F.col("child_talks"), 2).otherwise(3).alias("strategy"))
    third = rows(roots, 0, "m", F.lit(0)).withColumn("only", F.lit(0))
    said = rows(kids, 1, "said", F.col("n")).withColumn("only", F.lit(3))
    whole = second.withColumn("only", F.lit(2)).union(third).union(said).join(flags, "trace")
    whole = whole.where((F.col("strategy") == F.col("only")) | ((F.col("only") == 0) & (F.col("strategy") != 2)))
    place = F.row_number().over(Window.partitionBy("trace").orderBy("part", "n", "at")) - 1
    return whole.select("trace", "strategy", place.alias("place"), "m.*")


def normalised(spans: DataFrame) -> DataFrame:
    """One row per trace with a root: trace, created, n_messages, errors (TRC-26).

    A trace with a payload that is no JSON keeps its row, with the error and
    without messages.
    """
    bad = lambda c: F.col(c).isNotNull() & F.expr(f"try_parse_json({c}) IS NULL")
    heads = spans.groupBy("trace").agg(F.max("root").alias("has_root"), F.min(F.when(F.col("root"), F.col("created"))).alias("created"), F.sum((bad("input") | bad("output")).cast("int")).alias("broken"))
    counts = trace_messages(spans).groupBy("trace").agg(F.count("*").alias("n"))
    rows = heads.where("has_root").join(counts, "trace", "left")
    error = F.concat(F.lit("Message extraction failed: "), F.col("broken").cast("string"), F.lit(" payloads are no JSON"))
    return rows.select("trace", "created", F.when(F.col("broken") > 0, 0).otherwise(F.coalesce("n", F.lit(0))).alias("n_messages"), F.when(F.col("broken") > 0, F.array(error)).alias("errors"))
