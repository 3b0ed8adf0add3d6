"""Tool calls of conversations: linked to their results, ordered, validated and written as canonical JSON.

``calls`` has conv_id, call_id, after (the call that must come before, or an array of them; null: none), name and arguments (JSON);
``results`` has conv_id, call_id and content. A call is identified by conv_id and call_id together.

* Linking is a hash join on the identifiers. Of several rows with one identifier the least (by their other columns) counts;
  results without a call are left out; calls without a result have ``linked`` false.
* The topological rank is the number of calls that must come before, one after another, on the longest way. With one call before each it
  comes from pointer jumping: each round joins every call to the call it points at and doubles the distance, so a chain of n
  calls takes log2 n rounds. With arrays the graph is peeled: each round ranks the calls all of whose calls before are ranked, by
  joins, in as many rounds as the longest way. What is not there does not count. Calls on a cycle, or after one, have rank -1.
* Arguments are valid if they parse as a JSON object that fits the schema of their name: all fields that it requires, of the kinds it
  gives, and no fields that it lacks. A kind is a name (of ``KINDS``), a dict (an object of these fields), a list of one kind (an array of
  such items) or a tuple (one of these values); a field whose name or kind ends in ? may be absent. Names without a schema are invalid, and so are null arguments.
* A record is JSON without blanks and with sorted keys. Arguments that do not parse are kept as a string.

All steps are column functions and joins; no group is gathered. Rows with null identifiers are left out; null names and contents are
null in the record. Texts of any length are written whole. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellaudit.llm.common import written

#: JSON kinds by the types that Spark gives to parsed values.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def _ranked(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and rank."""
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    state = calls.select("conv_id", "call_id", "after").join(known, ["conv_id", "after"], "left").select("conv_id", "call_id", F.when(F.col("there"), F.col("after")).alias("to"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("rank"))
    state = written(state, name="ranks")
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):
        if state.filter("to is not null").isEmpty():
            break
        next_ = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("beyond"), F.col("rank").alias("more"))
        moved = state.filter("to is not null").join(next_, ["conv_id", "to"]).select("conv_id", "call_id", F.col("beyond").alias("to"), (F.col("rank") + F.col("more")).alias("rank"))
        state = written(state.filter("to is null").unionByName(moved), name="ranks")
    return state.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("rank")).otherwise(-1).alias("rank"))


def _peeled(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and rank, where ``after`` is an array."""
    own = ["conv_id", "call_id"]
    edges = calls.select(*own, F.explode("after").alias("before")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("before"))
    edges = written(edges.join(known, ["conv_id", "before"]), name="edges")
    open_, ranked, rank = calls.select(own), None, 0
    while True:
        free = written(open_.join(edges.select(own).distinct(), own, "left_anti"), name="free")
        named = free.withColumn("rank", F.lit(rank).cast("long"))
        ranked = named if ranked is None else ranked.unionByName(named)
        if free.isEmpty():
            return ranked.unionByName(open_.withColumn("rank", F.lit(-1).cast("long")))
        open_ = written(open_.join(free, own, "left_anti"), name="open")
        edges = written(edges.join(free.withColumnRenamed("call_id", "before"), ["conv_id", "before"], "left_anti"), name="edges")
        rank += 1


Schema = str | dict | list | tuple


def _fits(value: Column, schema: Schema) -> Column:
    """Whether a variant fits; null where there is none."""
    kind = F.schema_of_variant(value)
    if isinstance(schema, str):
        return kind.rlike(f"^({KINDS[schema.rstrip('?')]})$")
    if isinstance(schema, tuple):
        return F.to_json(value).isin(*(json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema))
    if isinstance(schema, list):
        return kind.startswith("ARRAY") & F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(_fits(x, schema[0]), F.lit(False))), F.lit(False))
    fits, there = kind.startswith("OBJECT"), F.lit(0)
    for field, of in schema.items():
        may_lack = field.endswith("?") or isinstance(of, str) and of.endswith("?")
        # a field that is absent gives null
        own = F.try_variant_get(value, f"$['{field.removesuffix('?')}']", "variant")
        fits = fits & F.when(own.isNull(), F.lit(may_lack)).otherwise(F.coalesce(_fits(own, of), F.lit(False)))
        there = there + own.isNotNull().cast("int")
    return fits & (F.size(F.json_object_keys(F.to_json(value))) == there)


def _valid(schemas: dict[str, dict[str, Schema]]) -> Column:
    """Whether ``parsed`` fits the schema of ``name``."""
    out = F.lit(False)
    for name, fields in schemas.items():
        out = F.when(F.col("name") == name, _fits(F.col("parsed"), fields)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, Schema]]) -> DataFrame:
    """conv_id, call_id, rank, linked, valid and record (canonical JSON) of each call."""
    many = dict(calls.dtypes)["after"].startswith("array")
    if many:
        calls = calls.withColumn("after", F.array_sort(F.array_distinct(F.filter("after", lambda x: x.isNotNull()))))
    one = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("after", "name", "arguments")).alias("c")).select("conv_id", "call_id", "c.*")
    one = written(one, name="calls")
    got = results.groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    linked = one.join(got.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join((_peeled if many else _ranked)(one), ["conv_id", "call_id"])
    parsed = linked.withColumn("parsed", F.try_parse_json("arguments")).withColumn("valid", _valid(schemas))
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(F.col(c)))), F.lit("[null]"))
    # one-element arrays give quoted strings; their brackets go
    quoted = {c: F.regexp_replace(text(c), r"(?s)^\[(.*)\]$", "$1") for c in ("call_id", "name", "content", "arguments", *(() if many else ("after",)))}
    if many:
        quoted["after"] = F.coalesce(F.to_json(F.to_variant_object("after")), F.lit("null"))
    arguments = F.coalesce(F.when(F.col("parsed").isNotNull(), F.to_json("parsed")), quoted["arguments"])
    record = F.concat(F.lit('{"after":'), quoted["after"], F.lit(',"arguments":'), arguments, F.lit(',"id":'), quoted["call_id"], F.lit(',"name":'), quoted["name"], F.lit(',"rank":'), F.col("rank").cast("string"), F.lit(',"result":'), quoted["content"], F.lit(',"valid":'), F.col("valid").cast("string"), F.lit("}"))
    return parsed.select("conv_id", "call_id", "rank", F.coalesce("linked", F.lit(False)).alias("linked"), "valid", record.alias("record"))


#: What a turn asks for, as a call.
SCHEMAS = {"user": {"query": "string", "turn": "integer", "words": "integer"}, "system": {"query": "string", "turn": "integer", "words": "integer?"}}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    Each turn that is not the assistant's is a call named by its role; an assistant's turn is the result of the turn before.
    A call comes after the call two turns before, or else the one before, where there is one.
    """
    one = turns.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))
    asked = one.filter("role != 'assistant'")
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    two = asked.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(2).alias("back2"))
    back = asked.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(1).alias("back1"))
    linked = asked.join(two, ["conv_id", "turn"], "left").join(back, ["conv_id", "turn"], "left")
    arguments = F.to_json(F.struct(F.col("turn"), F.size(F.split(F.trim("text"), r"\s+")).alias("words"), F.col("text").alias("query")))
    calls = linked.select("conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - F.coalesce("back2", "back1")).alias("after"), F.col("role").alias("name"), arguments.alias("arguments"))
    results = one.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
