"""Chat formatting with linked tool calls: hash join by identifier, topological order, schema checks, canonical JSON.

The turns of a conversation travel once, to the task that writes the conversation; calls and results meet there in a hash table
keyed by their identifier. A conversation is one row of the result, so it has to fit in a task in any case.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The tool as which an ordinary exchange is written: the user's turn is the call, the assistant's next turn its result.
REPLY = {
    "reply": {
        "type": "object",
        "properties": {"after": {"type": "string", "pattern": "^\\$call-"}, "prompt": {"type": "string", "minLength": 1}},
        "required": ["prompt"],
        "additionalProperties": False,
    }
}
#: Arguments nested deeper than this are an error of their call.
MAX_DEPTH = 100
_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes but the needed ones; NaN and infinities become null, lone surrogates U+FFFD."""

    def clean(v):
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, list) else v

    return _LONE.sub("\ufffd", json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def parsed(text: str):
    """The value of a JSON text; ValueError where it isn't one or is nested too deeply."""
    try:
        value = json.loads(text)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > MAX_DEPTH:
            raise ValueError("nested too deeply")
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return value


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What breaks the schema (type, enum, properties, required, additionalProperties, items, bounds, lengths, pattern)."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    want = schema.get("type")
    bad: list[str] = []
    if want:
        names = [want] if isinstance(want, str) else want
        fits = any(
            (isinstance(value, int) and not isinstance(value, bool)) if n == "integer"
            else (isinstance(value, int | float) and not isinstance(value, bool)) if n == "number"
            else isinstance(value, kinds[n])
            for n in names
        )
        if not fits:
            return [f"{at}: not {'|'.join(names)}"]
    if "enum" in schema and value not in schema["enum"]:
        bad.append(f"{at}: not in enum")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        bad += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in props:
                bad += violations(v, props[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                bad.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            bad += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            bad.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            bad.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            bad.append(f"{at}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            bad.append(f"{at}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            bad.append(f"{at}: no match")
    return bad


def references(value) -> set[str]:
    """Ids of the calls whose results the arguments name: strings "$<id>"."""
    if isinstance(value, str):
        return {value[1:]} if value.startswith("$") else set()
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return set().union(*(references(v) for v in parts), set())


def topological(ids: list[str], needs: dict[str, set[str]]) -> tuple[list[str], set[str]]:
    """(order, those on or behind a cycle). What is free comes in the given order; cyclic calls come last, in the given order."""
    rank = {x: i for i, x in enumerate(ids)}
    wait = {x: {n for n in needs.get(x, ()) if n in rank} for x in ids}
    users: dict[str, list[str]] = {}
    for x, ns in wait.items():
        for n in ns:
            users.setdefault(n, []).append(x)
    free = [rank[x] for x in ids if not wait[x]]
    heapq.heapify(free)
    out: list[str] = []
    while free:
        x = ids[heapq.heappop(free)]
        out.append(x)
        for u in users.get(x, []):
            wait[u].discard(x)
            if not wait[u]:
                heapq.heappush(free, rank[u])
    done = set(out)
    rest = [x for x in ids if x not in done]
    return out + rest, set(rest)


def exchanges(turns: list[tuple[int, str | None, str | None]]) -> tuple[list[dict], list[dict], str | None]:
    """(calls, results, system) of a conversation's turns (turn, role, text).

    Messages that hold tool calls are read as such: an assistant text that is a JSON object with a list of ``tool_calls`` (each with
    id, name and arguments, or id and function: {name, arguments}) gives these calls, and its ``content``, if it has some, is an
    assistant turn; a ``tool`` text that is an object with ``tool_call_id`` and ``content`` gives a result. All other user turns
    are calls of the tool "reply" (id "call-<turn>", the prompt, and "after": "$call-<turn before>" where an earlier user turn
    exists), and an assistant turn is the result of the user turn just before it; an assistant turn that follows none, a tool turn
    without an id and a turn of any other role is the result of "none-<turn>", which no call has. The system texts are joined by
    line ends. Equal turns count once; turn order breaks ties by text.
    """
    calls, results, system = [], [], []
    before, last = None, None  # the latest user turn; the last turn of user or assistant

    def answer(turn, text):
        results.append({"id": f"call-{last[1]}" if last and last[0] == "user" else f"none-{turn}", "turn": turn, "content": text})

    for turn, role, text in sorted(set(turns), key=lambda x: (x[0], x[2] is not None, x[2] or "", x[1] or "")):
        data = None
        if role in ("assistant", "tool") and text and text.lstrip().startswith("{"):
            try:
                data = parsed(text)
            except ValueError:
                data = None
        text = text or ""
        if role == "system":
            system.append(text)
        elif role == "user":
            args = {"prompt": text} | ({"after": f"$call-{before}"} if before is not None else {})
            calls.append({"id": f"call-{turn}", "turn": turn, "name": "reply", "args": args, "raw": canonical(args)})
            before, last = turn, ("user", turn)
        elif role == "assistant":
            listed = data.get("tool_calls") if isinstance(data, dict) else None
            if isinstance(listed, list) and listed:
                for c in listed:
                    c = c if isinstance(c, dict) else {}
                    f = c["function"] if isinstance(c.get("function"), dict) else c
                    args, name, key = f.get("arguments"), f.get("name"), c.get("id")
                    raw = args if isinstance(args, str) else None if args is None else canonical(args)
                    calls.append({"id": None if key is None else str(key), "turn": turn, "name": None if name is None else str(name), "raw": raw})
                said = data.get("content")
                if not said:
                    continue
                text = said if isinstance(said, str) else canonical(said)
            answer(turn, text)
            last = ("assistant", turn)
        elif role == "tool" and isinstance(data, dict) and data.get("tool_call_id") is not None:
            said = data.get("content")
            results.append({"id": str(data["tool_call_id"]), "turn": turn, "content": said if isinstance(said, str) else "" if said is None else canonical(said)})
        else:
            results.append({"id": f"none-{turn}", "turn": turn, "content": text})
    return calls, results, "\n".join(system) if system else None


def link(calls: list[dict], results: list[dict]) -> tuple[list[tuple[dict, dict | None]], list[dict]]:
    """(each call with its result or None, results without a call): a hash join by id.

    The first of repeated calls and results of an id counts (by turn, then text). A call without an id stays unanswered.
    """
    by: dict = {}
    for i, c in enumerate(sorted(calls, key=lambda c: (c["turn"], c["id"] or "", c["raw"] or ""))):
        by.setdefault(c["id"] if c["id"] is not None else ("", i), c)
    found: dict[str, dict] = {}
    for r in sorted(results, key=lambda r: (r["turn"], r["content"])):
        found.setdefault(r["id"], r)
    return [(c, found.get(c["id"])) for c in by.values()], [r for k, r in found.items() if k not in by]


def assemble(conv_id: int, turns: list[tuple[int, str | None, str | None]], schemas: dict[str, dict]) -> dict | None:
    """One conversation: figures and canonical JSON; None where there is nothing besides system turns."""
    calls, results, system = exchanges(turns)
    linked, orphans = link(calls, results)
    if not linked and not orphans:
        return None
    keys = [c["id"] if c["id"] is not None else f"\x00{i}" for i, (c, _) in enumerate(linked)]
    by, needs, errors = dict(zip(keys, linked, strict=True)), {}, {}
    for k, (c, _) in by.items():
        try:
            args = c["args"] if "args" in c else parsed(c["raw"]) if c["raw"] is not None else {}
        except ValueError:
            args, errors[k] = None, ["$: not JSON"]
        c["args"] = args
        needs[k] = references(args)
        if k not in errors:
            s = schemas.get(c["name"])
            errors[k] = [f"$: no tool {c['name']}"] if s is None else violations(args, s)
            errors[k] += [f"$: no call {x}" for x in sorted(needs[k]) if x not in by]
    order, cyclic = topological(keys, needs)
    out, valid = [], 0
    for k in order:
        c, r = by[k]
        e = errors[k] + (["$: cycle"] if k in cyclic else [])
        valid += not e
        item = {"arguments": c["args"], "id": c["id"], "name": c["name"], "result": r and r["content"], "status": "linked" if r else "unanswered", "valid": not e}
        if e:
            item["errors"] = e
        out.append(item)
    doc = {"calls": out, "conv_id": conv_id, "orphans": [{"id": r["id"], "result": r["content"]} for r in orphans], "system": system}
    return {"conv_id": conv_id, "n_calls": len(out), "n_linked": sum(r is not None for _, r in linked), "n_valid": valid, "n_orphans": len(orphans), "chat": canonical(doc)}


def format_chats(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, n_calls, n_linked, n_valid, n_orphans, chat): each conversation as canonical JSON with linked tool calls.

    See ``exchanges`` for what counts as a call. Calls stand in topological order of the results that their arguments name
    ("$<id>"), else by turn; each has its result or status "unanswered", and the violations of its tool's schema. Results without
    a call are listed as orphans. Rows with a NULL conv_id or turn are left out, a NULL text counts as empty, repeated turns count
    once, and a conversation of which nothing is left besides system turns has no row. Arguments that aren't JSON, or are nested
    more than MAX_DEPTH deep, are null and an error of their call. Other columns aren't read.
    """
    small_batches(turns.sparkSession)
    schemas = REPLY if schemas is None else schemas
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = t.where("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    fields = [("conv_id", pa.int64()), ("n_calls", pa.int64()), ("n_linked", pa.int64()), ("n_valid", pa.int64()), ("n_orphans", pa.int64()), ("chat", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("turns")
            off, flat = col.offsets.to_pylist(), list(zip(*(col.values.field(i).to_pylist() for i in range(3)), strict=True))
            got = (assemble(c, flat[a:b], schemas) for c, a, b in zip(batch.column("conv_id").to_pylist(), off, off[1:], strict=False))
            yield pa.RecordBatch.from_pylist([r for r in got if r is not None], schema=pa.schema(fields))

    return rows.mapInArrow(run, "conv_id long, n_calls long, n_linked long, n_valid long, n_orphans long, chat string")
