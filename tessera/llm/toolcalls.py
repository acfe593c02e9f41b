"""Chat formatting with linked tool calls.

A turn whose text is a JSON object may hold calls (``tool_calls``: objects with ``id``, ``name``, ``arguments``, or these two inside ``function``; arguments are an object
or its JSON text) or be a result (``tool_call_id`` and ``content``). Arguments may refer to another call's result by ``{"$ref": "<id>"}``.
Calls and results are hash-joined by conversation and identifier; a result follows its call, and a call follows the results it refers to. Turns are put into that order
(topologically, by turn number where it leaves a choice), arguments are validated against the tools' schemas, and every turn is written as canonical JSON.
Only identifiers and turn numbers meet by conversation; texts do not leave their rows.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.durable import settle

KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and characters as they are; lone surrogates are escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.encode("utf-8", "backslashreplace").decode() if any("\ud800" <= c <= "\udfff" for c in text) else text


def violations(value, schema: dict, at: str = "") -> list[str]:
    """Where a value breaks a JSON schema (type, enum, required, properties, additionalProperties, items, minimum, maximum)."""
    found = []
    kinds = schema.get("type")
    if kinds is not None:
        def fits(kind: str) -> bool:
            if kind in ("number", "integer"):
                return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
            return isinstance(value, KINDS.get(kind, object))

        if not any(fits(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return [f"{at or '/'}: not {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at or '/'}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{at or '/'}: out of range")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}/{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in own:
                if not (isinstance(v, dict) and set(v) == {"$ref"}):
                    found += violations(v, own[k], f"{at}/{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}/{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += violations(v, schema["items"], f"{at}/{i}")
    return found


def references(value) -> Iterator[str]:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                yield x["$ref"]
            stack += x.values()
        elif isinstance(x, list):
            stack += x


def read_turn(role: str | None, text: str | None, schemas: dict[str, dict] | None) -> tuple[str, list[str], str | None, list[str], list[str]]:
    """(canonical message, ids of its calls, id of the call it answers, ids its calls refer to, problems)."""
    body = None
    if text is not None and text.lstrip()[:1] == "{":
        try:
            body = json.loads(text)
        except (ValueError, RecursionError):
            body = None
    message: dict = {"role": role, "content": text}
    calls, refs, problems, answers = [], [], [], None
    try:
        if isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
            message["content"], message["tool_calls"] = body.get("content"), []
            for raw in body["tool_calls"]:
                raw = raw if isinstance(raw, dict) else {}
                inner = raw.get("function") if isinstance(raw.get("function"), dict) else raw
                name, arguments, own = inner.get("name"), inner.get("arguments", {}), raw.get("id")
                if isinstance(arguments, str):
                    try:
                        arguments = json.loads(arguments)
                    except ValueError:
                        problems.append(f"{own}: arguments are not JSON")
                if own is None:
                    problems.append("call without id")
                else:
                    calls.append(str(own))
                if schemas is not None and not isinstance(arguments, str):
                    if name not in schemas:
                        problems.append(f"{own}: unknown tool {name}")
                    else:
                        problems += [f"{own}: {v}" for v in violations(arguments, schemas[name])]
                refs += references(arguments)
                message["tool_calls"].append({"id": own, "name": name, "arguments": arguments})
        elif isinstance(body, dict) and body.get("tool_call_id") is not None:
            answers = str(body["tool_call_id"])
            message["content"], message["tool_call_id"] = body.get("content"), answers
        return canonical(message), calls, answers, sorted(set(refs)), problems
    except RecursionError:
        return canonical({"role": role, "content": text}), [], None, [], ["nested too deeply"]


def offered(text: str | None) -> list[tuple[str, str]]:
    """(name, schema as JSON) of the tools that a turn declares: ``tools``, objects with ``name`` and ``parameters``, or these two inside ``function``."""
    if text is None or '"tools"' not in text or text.lstrip()[:1] != "{":
        return []
    try:
        tools = json.loads(text).get("tools")
        tools = [t.get("function") if isinstance(t.get("function"), dict) else t for t in tools if isinstance(t, dict)] if isinstance(tools, list) else []
        return [(t["name"], canonical(t["parameters"] if isinstance(t.get("parameters"), dict) else {})) for t in tools if isinstance(t.get("name"), str)]
    except (ValueError, RecursionError):
        return []


def _declarations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (conv_id, turn, text): (conv_id, turn, name, schema)."""
    for batch in batches:
        found = [(i, *tool) for i, text in enumerate(batch.column(2).to_pylist()) for tool in offered(text)]
        row, names, schemas = zip(*found, strict=True) if found else ((), (), ())
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(names, pa.string()), pa.array(schemas, pa.string())], ["conv_id", "turn", "name", "schema"])


def _against(message: str, turn: int, tools: list[dict]) -> list[str]:
    """Problems of a turn's calls by the schemas that its conversation declared up to it; the last one of a name counts."""
    schemas = {t["name"]: t["schema"] for t in sorted(tools, key=lambda t: (t["turn"], t["schema"])) if t["turn"] <= turn}
    problems = []
    for call in json.loads(message)["tool_calls"]:
        name, own = call["name"], call["id"]
        if not isinstance(name, str) or name not in schemas:
            problems.append(f"{own}: unknown tool {name}")
        elif not isinstance(call["arguments"], str):
            try:
                problems += [f"{own}: {v}" for v in violations(call["arguments"], json.loads(schemas[name]))]
            except (TypeError, AttributeError, ValueError, OverflowError, RecursionError):
                problems.append(f"{own}: schema of {name} cannot be read")
    return problems


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (conv_id, turn, message, tools): (conv_id, turn, what)."""
    for batch in batches:
        found = [(i, what) for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 1, 3)), strict=True)) for what in _against(*row)]
        at = pa.array([i for i, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([w for _, w in found], pa.string())], ["conv_id", "turn", "what"])


def _turn_reader(schemas: dict | None):
    lists = pa.list_(pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_turn(role, text, schemas) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), lists, pa.string(), lists, lists), strict=True))], ["conv_id", "turn", "role", "message", "calls", "answers", "refs", "problems"])

    return read


def arrange(edges: list[tuple[int, int]]) -> dict[int, tuple[int, int] | None]:
    """(turn to stand at, rank there) of each turn in edges (before, after), or None for turns on or behind a cycle."""
    after, needs = defaultdict(set), defaultdict(set)
    for a, b in edges:
        after[a].add(b)
        needs[b].add(a)
    spot: dict[int, tuple[int, int] | None] = {t: None for t in {*after, *needs}}
    waits = {t: len(needs[t]) for t in spot}
    ready = [t for t in spot if not waits[t]]
    heapq.heapify(ready)
    while ready:
        t = heapq.heappop(ready)
        latest = max((spot[a] for a in needs[t]), default=(t - 1, 0))
        spot[t] = (t, 0) if latest[0] < t else (latest[0], latest[1] + 1)
        for b in after[t]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, b)
    return spot


def _sorter(frame: pd.DataFrame) -> pd.DataFrame:
    spot = arrange(list(zip(frame["before"], frame["after"], strict=True)))
    rows = [(frame["c"].iloc[0], t, *(s or (t, 0)), s is None) for t, s in spot.items()]
    return pd.DataFrame(rows, columns=["c", "t", "at", "rank", "cyclic"])


def link(conversations: DataFrame, schemas: dict[str, dict] | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, seq, message, problems), one for each turn.

    ``seq`` numbers a conversation's turns in their order from 0 (equal turn numbers by message); ``message`` is canonical JSON; ``problems`` says what is wrong: calls without a
    result, results without a call, identifiers that several calls use (the first turn counts), arguments against their schema (those given, or else those that the conversation's own turns declared before or in the call's turn; without any, none), references in a cycle (those
    turns keep their places). Texts that are not such JSON are plain messages; null texts have null content. Turns without a conversation id or number are plain, too. An empty table gives an
    empty result. Other columns are not read, so their names cannot clash. Very long texts are parsed whole, one turn at a time; JSON nested too deeply to parse is a plain message. Repeated rows have a row each.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = settle(rows.mapInArrow(_turn_reader(schemas), f"conv_id {kind}, turn long, role string, message string, calls array<string>, answers string, refs array<string>, problems array<string>"), "turns")

    known = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    each = known.select("conv_id", "turn", F.explode("calls").alias("id"))
    calls = each.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"), F.count("*").alias("uses"))
    answers = known.filter("answers IS NOT NULL").select("conv_id", "turn", F.col("answers").alias("id"))
    results = answers.groupBy("conv_id", "id").agg(F.min("turn").alias("result_turn"))
    linked = settle(calls.join(results, ["conv_id", "id"], "full"), "linked-calls")
    refs = known.select("conv_id", "turn", F.explode("refs").alias("id"))

    follows = answers.join(linked.filter("call_turn IS NOT NULL"), ["conv_id", "id"]).select("conv_id", F.col("call_turn").alias("before"), F.col("turn").alias("after"))
    needs = refs.join(linked.filter("call_turn IS NOT NULL AND result_turn IS NOT NULL"), ["conv_id", "id"]).select("conv_id", F.col("result_turn").alias("before"), F.col("turn").alias("after"))
    edges = settle(follows.union(needs).distinct(), "turn-order")
    # only conversations in which something stands before what it needs are put in order anew
    wrong = edges.filter("before >= after").select("conv_id").distinct()
    placed = edges.join(wrong, "conv_id", "left_semi").withColumnRenamed("conv_id", "c").groupBy("c").applyInPandas(_sorter, f"c {kind}, t long, at long, rank long, cyclic boolean")

    # problems that show in the links, by turn
    missing = linked.filter("result_turn IS NULL").select("conv_id", F.col("call_turn").alias("turn"), F.concat("id", F.lit(": no result")).alias("what"))
    orphans = answers.join(linked.filter("call_turn IS NULL").select("conv_id", "id"), ["conv_id", "id"], "left_semi").select("conv_id", "turn", F.concat("id", F.lit(": no call")).alias("what"))
    reused = each.join(linked.filter("uses > 1"), ["conv_id", "id"]).filter("turn > call_turn").select("conv_id", "turn", F.concat("id", F.lit(": used before")).alias("what"))
    cyclic = placed.filter("cyclic").select(F.col("c").alias("conv_id"), F.col("t").alias("turn"), F.lit("references in a cycle").alias("what"))
    said = missing.union(orphans).union(reused).union(cyclic)
    if schemas is None:
        tools = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "text").mapInArrow(_declarations, f"conv_id {kind}, turn long, name string, schema string")
        tools = tools.groupBy(F.col("conv_id").alias("tc")).agg(F.collect_set(F.struct("turn", "name", "schema")).alias("tools"))
        own = known.filter('message LIKE \'%"tool_calls":[%\' AND (size(calls) > 0 OR size(problems) > 0)').join(tools, F.col("conv_id") == F.col("tc"))
        said = said.union(own.select("conv_id", "turn", "message", "tools").mapInArrow(_judged, f"conv_id {kind}, turn long, what string"))
    more = said.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("what")).alias("more")).withColumnsRenamed({"conv_id": "mc", "turn": "mt"})

    found = turns.join(more, (F.col("conv_id") == F.col("mc")) & (F.col("turn") == F.col("mt")), "left").join(placed, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    by_place = W.partitionBy("conv_id").orderBy(F.coalesce("at", "turn"), F.coalesce("rank", F.lit(0)), "turn", "message")
    return found.select("conv_id", "turn", "role", (F.row_number().over(by_place) - 1).cast("long").alias("seq"), "message", F.concat("problems", F.coalesce("more", F.array())).alias("problems"))


def op8_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("problems", F.array_join("problems", "; "))


QUERIES = {"op8_toolcalls": op8_toolcalls}
ORACLES: dict[str, str] = {}
