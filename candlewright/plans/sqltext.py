"""Fragments of the SQL twins."""

EVENT_BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS date, arg_min(value, event_id) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)"""
ORDER_BARS = """bars AS (SELECT r_name AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
 min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
DENSE = """p AS (SELECT s.symbol, d.date, b.open, b.high, b.low, b.close, b.volume, row_number() OVER (PARTITION BY s.symbol ORDER BY d.date) AS rn
 FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = d.date)"""
PANEL = f"{EVENT_BARS}, {DENSE}"
ORDER_PANEL = f"{ORDER_BARS}, {DENSE}"
W = "(PARTITION BY symbol ORDER BY date)"


def frame(n: int, end: int = 0) -> str:
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1 - end} PRECEDING AND {last})"


def full(agg: str, x: str, n: int, end: int = 0) -> str:
    w = frame(n, end)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


def sma(x: str, n: int) -> str:
    return full("avg", x, n)


def gt(a: str, b: str) -> str:
    return f"coalesce(({a}) - ({b}) > greatest(abs({a}), abs({b})) * 1e-12, false)"


def ge(a: str, b: str) -> str:
    return f"coalesce(({a}) - ({b}) >= greatest(abs({a}), abs({b})) * -1e-12, false)"


def phi(z: str) -> str:
    """Standard normal distribution function, the same rational approximation."""
    from candlewright.operators.stats import PHI_BOTTOM, PHI_SWITCH, PHI_TOP, ROOT_TAU

    x, (top, bottom) = f"abs({z})", (("(" * (len(k) - 1)) + f"{k[0]!r}::DOUBLE" + "".join(f" * x + {c!r}::DOUBLE)" for c in k[1:]) for k in (PHI_TOP, PHI_BOTTOM))
    body = f"CASE WHEN x > 37 THEN 0 WHEN x < {PHI_SWITCH!r} THEN exp(-x * x / 2) * {top} / {bottom} ELSE exp(-x * x / 2) / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65::DOUBLE))))) / {ROOT_TAU!r} END"
    body = body.replace(" x ", f" {x} ").replace("(x ", f"({x} ").replace("-x ", f"-{x} ")
    return f"(CASE WHEN {z} > 0 THEN 1 - ({body}) WHEN {z} IS NOT NULL THEN {body} END)"


def rising(s: str) -> str:
    return f"({s} AND NOT coalesce(lag({s}) OVER {W}, false))"


def falling(s: str) -> str:
    return f"(NOT {s} AND coalesce(lag({s}) OVER {W}, false))"


def ewm(name: str, src: str, x: str, alpha: str, min_periods: int = 0) -> str:
    """Recursive common table ``name`` (symbol, rn, y, seen): exponential mean of x in src by (symbol, rn)."""
    a = f"({alpha})"
    return f"""{name}_r AS (SELECT symbol, rn, {x} AS x, {x} AS y, 1.0::DOUBLE AS w, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS seen FROM {src} WHERE rn = 1
 UNION ALL SELECT s.symbol, s.rn, s.{x}, CASE WHEN e.y IS NULL THEN s.{x} WHEN s.{x} IS NULL THEN e.y ELSE (e.w * (1 - {a}) * e.y + {a} * s.{x}) / (e.w * (1 - {a}) + {a}) END,
 CASE WHEN e.y IS NOT NULL AND s.{x} IS NULL THEN e.w * (1 - {a}) ELSE 1.0::DOUBLE END, e.seen + CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END
 FROM {name}_r e JOIN {src} s ON s.symbol = e.symbol AND s.rn = e.rn + 1),
 {name} AS (SELECT symbol, rn, CASE WHEN seen >= {min_periods} THEN y END AS y FROM {name}_r)"""


#: From (symbol, date, rn, entry, exit) in ``sig``: lagged by one bar, then the held state.
HELD = f"""lagged AS (SELECT *, coalesce(lag(entry) OVER {W}, false) AS le, coalesce(lag(exit) OVER {W}, false) AS lx FROM sig),
 held AS (SELECT *, coalesce(last_value(CASE WHEN lx THEN 0 WHEN le THEN 1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS held FROM lagged)"""
