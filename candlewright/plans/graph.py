"""Typed signal graphs: 31 node types, validated, then compiled to staged columns over the dense panel.

A graph is {"nodes": [{"id", "type", "params", "inputs"}]}. Only the nodes that the sink needs are compiled. Each node is one
column; nodes are added in stages, a stage for each depth, so shared nodes are computed once. Nodes with memory (EMA, RSI)
form one grouped pass a stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions import indicators as I

_ID = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


@dataclass(frozen=True)
class Param:
    name: str
    kind: str  # int or float
    default: float | None = None
    least: float | None = None


@dataclass(frozen=True)
class Node:
    ports: tuple[str, ...]
    takes: str  # series or bool
    gives: str  # series, bool or signal
    params: tuple[Param, ...] = ()
    build: object = None  # (inputs, params, window) -> Column; None: sequential kernel


def _w(name="window", least=1):
    return (Param(name, "int", None, least),)


_S, _B = "series", "bool"
NODES: dict[str, Node] = {f"source.{f}": Node((), _S, _S, (), lambda i, p, w, f=f: F.coalesce(F.col(f), F.col("close")) if f in ("high", "low") else F.col(f)) for f in ("close", "open", "high", "low", "volume")}
NODES |= {
    "indicator.sma": Node(("series",), _S, _S, _w(), lambda i, p, w: I.sma(i[0], p["window"], w)),
    "indicator.ema": Node(("series",), _S, _S, _w("span"), ("ema", "span")),
    "indicator.rolling_std": Node(("series",), _S, _S, _w(), lambda i, p, w: I.rolling_std(i[0], p["window"], w)),
    "indicator.rolling_max": Node(("series",), _S, _S, _w(), lambda i, p, w: I.rolling_max(i[0], p["window"], w)),
    "indicator.rolling_min": Node(("series",), _S, _S, _w(), lambda i, p, w: I.rolling_min(i[0], p["window"], w)),
    "indicator.rsi": Node(("series",), _S, _S, _w("period"), ("rsi", "period")),
    "indicator.zscore": Node(("series",), _S, _S, _w(least=2), lambda i, p, w: I.zscore(i[0], p["window"], w)),
    "transform.shift": Node(("series",), _S, _S, (Param("periods", "int", 1, 0),), lambda i, p, w: F.lag(i[0], p["periods"]).over(w)),
    "math.add": Node(("a", "b"), _S, _S, (), lambda i, p, w: i[0] + i[1]),
    "math.sub": Node(("a", "b"), _S, _S, (), lambda i, p, w: i[0] - i[1]),
    "math.mul": Node(("a", "b"), _S, _S, (), lambda i, p, w: i[0] * i[1]),
    "math.div": Node(("a", "b"), _S, _S, (), lambda i, p, w: F.try_divide(i[0], i[1])),
    "math.scale": Node(("series",), _S, _S, (Param("factor", "float"),), lambda i, p, w: i[0] * F.lit(p["factor"])),
    "logic.gt": Node(("a", "b"), _S, _B, (), lambda i, p, w: I.gt(i[0], i[1])),
    "logic.ge": Node(("a", "b"), _S, _B, (), lambda i, p, w: I.ge(i[0], i[1])),
    "logic.lt": Node(("a", "b"), _S, _B, (), lambda i, p, w: I.lt(i[0], i[1])),
    "logic.le": Node(("a", "b"), _S, _B, (), lambda i, p, w: I.le(i[0], i[1])),
    "logic.gt_value": Node(("series",), _S, _B, (Param("value", "float"),), lambda i, p, w: I.gt(i[0], F.lit(p["value"]))),
    "logic.lt_value": Node(("series",), _S, _B, (Param("value", "float"),), lambda i, p, w: I.lt(i[0], F.lit(p["value"]))),
    "logic.and": Node(("a", "b"), _B, _B, (), lambda i, p, w: i[0] & i[1]),
    "logic.or": Node(("a", "b"), _B, _B, (), lambda i, p, w: i[0] | i[1]),
    "logic.not": Node(("a",), _B, _B, (), lambda i, p, w: ~i[0]),
    "logic.cross_above": Node(("a", "b"), _S, _B, (), lambda i, p, w: I.rising(I.gt(i[0], i[1]), w)),
    "logic.cross_below": Node(("a", "b"), _S, _B, (), lambda i, p, w: I.falling(I.gt(i[0], i[1]), w)),
    "signal.enter_exit_on_state": Node(("state",), _B, "signal", (), lambda i, p, w: F.struct(I.rising(i[0], w).alias("entry"), I.falling(i[0], w).alias("exit"))),
    "signal.enter_exit": Node(("enter", "exit"), _B, "signal", (), lambda i, p, w: F.struct(i[0].alias("entry"), i[1].alias("exit"))),
}


class GraphError(ValueError):
    """A graph that doesn't validate; ``errors`` lists all that is wrong."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass
class Checked:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    sink: str | None = None
    params: dict[str, dict] = field(default_factory=dict)


def coerce(p: Param, value):
    """The value as the parameter's kind; raises where it isn't a number, not integral, or below the least value."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        raise ValueError(f"{p.name} must be a number")
    x = float(value)
    if p.kind == "int":
        if x != int(x):
            raise ValueError(f"{p.name} must be integral")
        x = int(x)
    if p.least is not None and x < p.least:
        raise ValueError(f"{p.name} must be at least {p.least:g}")
    return x


def validate(graph: dict) -> Checked:
    """Errors, warnings (nodes that the sink doesn't need), topological order of what it needs, coerced parameters."""
    r = Checked()
    nodes: dict[str, dict] = {}
    for n in graph.get("nodes", []):
        i = n.get("id", "")
        if not _ID.match(i):
            r.errors.append(f"bad id {i!r}")
        elif i in nodes:
            r.errors.append(f"repeated id {i}")
        nodes[i] = n
    for i, n in nodes.items():
        d = NODES.get(n.get("type"))
        if d is None:
            r.errors.append(f"{i}: unknown type {n.get('type')}")
            continue
        got = n.get("inputs", {}) or {}
        for port in d.ports:
            src = got.get(port)
            if src is None:
                r.errors.append(f"{i}: input {port} missing")
            elif src not in nodes:
                r.errors.append(f"{i}: no node {src}")
            elif (s := NODES.get(nodes[src].get("type"))) is not None and s.gives != d.takes:
                r.errors.append(f"{i}: input {port} must be {d.takes}, {src} gives {s.gives}")
        r.errors += [f"{i}: unknown input {p}" for p in got if p not in d.ports]
        given = n.get("params", {}) or {}
        known = {p.name for p in d.params}
        r.errors += [f"{i}: unknown parameter {p}" for p in given if p not in known]
        r.params[i] = {}
        for p in d.params:
            v = given.get(p.name, p.default)
            if v is None:
                r.errors.append(f"{i}: parameter {p.name} missing")
                continue
            try:
                r.params[i][p.name] = coerce(p, v)
            except ValueError as e:
                r.errors.append(f"{i}: {e}")
    sinks = [i for i, n in nodes.items() if (d := NODES.get(n.get("type"))) and d.gives == "signal"]
    if len(sinks) != 1:
        r.errors.append(f"exactly one signal node needed, found {len(sinks)}")
        return r
    r.sink = sinks[0]
    state: dict[str, int] = {}
    stack = [(r.sink, False)]
    while stack:
        i, done = stack.pop()
        if done:
            state[i] = 2
            r.order.append(i)
            continue
        if state.get(i) == 2:
            continue
        if state.get(i) == 1:
            r.errors.append(f"cycle through {i}")
            return r
        state[i] = 1
        stack.append((i, True))
        for src in (nodes[i].get("inputs") or {}).values():
            if src in nodes:
                if state.get(src) == 1:
                    r.errors.append(f"cycle through {src}")
                    return r
                if state.get(src) != 2:
                    stack.append((src, False))
    r.order = list(dict.fromkeys(r.order))
    r.warnings += [f"{i} isn't used" for i in nodes if i not in r.order]
    return r


def override(graph: dict, values: dict[str, object]) -> dict:
    """A copy of the graph with dotted ``node.param`` values set; an unknown name is an error."""
    nodes = [{**n, "params": dict(n.get("params") or {})} for n in graph["nodes"]]
    by = {n["id"]: n for n in nodes}
    for key, v in values.items():
        i, _, p = key.partition(".")
        if i not in by or p not in {q.name for q in NODES[by[i]["type"]].params}:
            raise KeyError(f"no parameter {key}")
        by[i]["params"][p] = v
    return {**graph, "nodes": nodes}


def compile_graph(graph: dict, panel: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, date, entry, exit) of the graph over a dense panel; ``keep`` names nodes whose values are wanted too."""
    c = validate(graph)
    if c.errors:
        raise GraphError(c.errors)
    nodes = {n["id"]: n for n in graph["nodes"]}
    depth: dict[str, int] = {}
    for i in c.order:
        depth[i] = 1 + max([depth[s] for s in (nodes[i].get("inputs") or {}).values()], default=-1)
    w, df = I.by_symbol(), panel
    for level in range(max(depth.values()) + 1):
        here = [i for i in c.order if depth[i] == level]
        cols, jobs = {}, []
        for i in here:
            d = NODES[nodes[i]["type"]]
            ins = [f"n_{nodes[i]['inputs'][p]}" for p in d.ports]
            if isinstance(d.build, tuple):
                jobs.append((f"n_{i}", d.build[0], ins[0], c.params[i][d.build[1]]))
            else:
                cols[f"n_{i}"] = d.build([F.col(x) for x in ins], c.params[i], w)
        if cols:
            df = df.withColumns(cols)
        if jobs:
            df = I.sequential(df, jobs)
    return df.select("symbol", "date", F.col(f"n_{c.sink}.entry").alias("entry"), F.col(f"n_{c.sink}.exit").alias("exit"), *(F.col(f"n_{k}").alias(k) for k in keep))


def catalog() -> list[dict]:
    """What an editor needs to know of every node type."""
    return [
        {"type": t, "ports": list(n.ports), "takes": n.takes, "gives": n.gives, "params": [vars(p) for p in n.params]}
        for t, n in sorted(NODES.items())
    ]


def _n(id_: str, type_: str, params: dict | None = None, **inputs: str) -> dict:
    return {"id": id_, "type": type_, "params": params or {}, "inputs": inputs}


def preset(name: str, **p) -> dict:
    """The five preset graphs: sma_crossover, ema_crossover, bollinger_bands, rsi_2, donchian_breakout."""
    close = _n("px", "source.close")
    if name in ("sma_crossover", "ema_crossover"):
        kind, key = ("indicator.sma", "window") if name[0] == "s" else ("indicator.ema", "span")
        a, b = (20, 100) if name[0] == "s" else (12, 26)
        return {"nodes": [close, _n("quick", kind, {key: p.get("fast", a)}, series="px"), _n("calm", kind, {key: p.get("slow", b)}, series="px"), _n("up", "logic.gt", a="quick", b="calm"), _n("sig", "signal.enter_exit_on_state", state="up")]}
    if name == "bollinger_bands":
        n, k = p.get("lookback", 20), p.get("k", 2.0)
        return {"nodes": [close, _n("mid", "indicator.sma", {"window": n}, series="px"), _n("dev", "indicator.rolling_std", {"window": n}, series="px"), _n("wide", "math.scale", {"factor": k}, series="dev"), _n("floor", "math.sub", a="mid", b="wide"), _n("below", "logic.lt", a="px", b="floor"), _n("back", "logic.ge", a="px", b="mid"), _n("sig", "signal.enter_exit", enter="below", exit="back")]}
    if name == "rsi_2":
        nodes = [close, _n("osc", "indicator.rsi", {"period": p.get("period", 2)}, series="px"), _n("low_", "logic.lt_value", {"value": p.get("entry_rsi", 10.0)}, series="osc"), _n("high_", "logic.gt_value", {"value": p.get("exit_rsi", 70.0)}, series="osc")]
        go = "low_"
        if p.get("trend_sma", 200) > 0:
            nodes += [_n("base", "indicator.sma", {"window": p.get("trend_sma", 200)}, series="px"), _n("rising", "logic.gt", a="px", b="base"), _n("both", "logic.and", a="low_", b="rising")]
            go = "both"
        return {"nodes": [*nodes, _n("sig", "signal.enter_exit", enter=go, exit="high_")]}
    if name == "donchian_breakout":
        return {"nodes": [close, _n("hi", "source.high"), _n("lo", "source.low"), _n("top", "indicator.rolling_max", {"window": p.get("entry_period", 20)}, series="hi"), _n("ceil", "transform.shift", series="top"), _n("bot", "indicator.rolling_min", {"window": p.get("exit_period", 10)}, series="lo"), _n("base", "transform.shift", series="bot"), _n("go", "logic.gt", a="px", b="ceil"), _n("stop", "logic.lt", a="px", b="base"), _n("sig", "signal.enter_exit", enter="go", exit="stop")]}
    raise KeyError(name)
