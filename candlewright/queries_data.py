"""Queries over sources and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.operators import load as L
from candlewright.operators import prepare as P
from candlewright.plans import sqltext as Q
from candlewright.plans.registered import query
from candlewright.queries_signals import order_panel
from candlewright.sources import bars as B
from candlewright.sources import parsers as X

FIELDS = "open, high, low, close, volume"


def _chunk(c):
    """Payloads of some thousand rows, as a feed sends them, and not one for a whole series."""
    return F.floor(F.col(c) / 5000)


@query(f"WITH {Q.EVENT_BARS} SELECT symbol, date, {FIELDS} FROM bars WHERE symbol IN ('click', 'view', 'purchase') AND date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def read_symbols(spark, d):
    path = B.scratch(spark, "bars")
    B.write_symbols(B.event_bars(spark, d), path)
    return B.read_symbols(spark, path, ["click", "view", "purchase", "absent"], "2024-01-05", "2024-01-20").select("symbol", "date", *B.FIELDS)


@query(f"""WITH {Q.EVENT_BARS}, n AS (SELECT symbol, date, open, high, low, close + 1 AS close, volume FROM bars WHERE date >= TIMESTAMP '2024-01-15')
 SELECT * FROM n UNION ALL SELECT symbol, date, {FIELDS} FROM bars WHERE date < TIMESTAMP '2024-01-15'""")
def merge_fetched(spark, d):
    b = B.event_bars(spark, d)
    new = b.where("date >= timestamp_ntz'2024-01-15'").withColumn("close", F.col("close") + 1)
    return B.merge_bars(b, new)


_REQ = "r AS (SELECT DISTINCT event_type AS symbol, DATE '2023-12-20' AS a, DATE '2024-02-10' AS b FROM events), c AS (SELECT event_type AS symbol, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events WHERE event_type <> 'click' GROUP BY 1)"


def _spans(spark, d):
    e = B.table(spark, d, "events")
    req = e.select(F.col("event_type").alias("symbol")).distinct().select("symbol", F.lit("2023-12-20").cast("date").alias("start"), F.lit("2024-02-10").cast("date").alias("end"))
    cov = e.where("event_type <> 'click'").groupBy(F.col("event_type").alias("symbol")).agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))
    return req, cov


@query(f"""WITH {_REQ}, j AS (SELECT r.symbol, r.a, r.b, c.a AS ca, c.b AS cb FROM r LEFT JOIN c USING (symbol))
 SELECT symbol, 'full' AS need, a AS start, b AS "end" FROM j WHERE ca IS NULL UNION ALL SELECT symbol, 'before', a, ca - 1 FROM j WHERE a < ca UNION ALL SELECT symbol, 'after', cb + 1, b FROM j WHERE b > cb""")
def gap_plan(spark, d):
    return B.gap_plan(*_spans(spark, d))


@query(f"""WITH {_REQ} SELECT symbol, min(a) AS start, max(b) AS "end" FROM (SELECT * FROM r UNION ALL SELECT * FROM c) GROUP BY symbol""")
def coverage_merge(spark, d):
    req, cov = _spans(spark, d)
    return B.widen_coverage(cov, req)


_SYMS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(f"""WITH {Q.ORDER_BARS} SELECT date, {', '.join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS \"{s}|close\"" for s in _SYMS)} FROM bars GROUP BY date""")
def close_matrix(spark, d):
    return B.to_wide(B.order_bars(spark, d), _SYMS, ("close",))


@query(f"WITH {Q.ORDER_BARS} SELECT symbol, date, {FIELDS} FROM bars")
def wide_round_trip(spark, d):
    return B.from_wide(B.to_wide(B.order_bars(spark, d), _SYMS))


@query(f"WITH {Q.ORDER_BARS} SELECT symbol, date, {FIELDS} FROM bars")
def normalize_frame(spark, d):
    return B.normalize_ohlcv(B.order_bars(spark, d).select("symbol", F.col("date").alias("Date"), *(F.col(c).cast("string").alias(c.upper()) for c in B.FIELDS)))


@query(f"WITH {Q.ORDER_BARS} SELECT symbol, date, {FIELDS}, 0.0::DOUBLE AS div_cash, 1.0::DOUBLE AS split_factor FROM bars")
def parse_eod(spark, d):
    b = B.order_bars(spark, d).select("symbol", F.struct(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), *B.FIELDS).alias("r"))
    return X.parse_eod(b.groupBy("symbol", F.year(F.to_date("r.date"))).agg(F.to_json(F.collect_list("r")).alias("payload")))


@query(f"""WITH {Q.EVENT_BARS}, x AS (SELECT upper(symbol) AS symbol, date_trunc('day', date)::TIMESTAMP AS d, date, {FIELDS} FROM bars)
 SELECT symbol, d AS date, arg_max(open, date) AS open, arg_max(high, date) AS high, arg_max(low, date) AS low, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM x GROUP BY symbol, d""")
def parse_crypto(spark, d):
    b = B.event_bars(spark, d).select("symbol", F.struct(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), *B.FIELDS).alias("r"))
    a = b.groupBy("symbol", F.substring("r.date", 1, 10)).agg(F.collect_list("r").alias("p")).select(F.to_json(F.array(F.struct(F.col("symbol").alias("ticker"), F.col("p").alias("priceData")))).alias("payload"))
    return X.parse_crypto(a)


def _macro(spark, d):
    e = B.table(spark, d, "events")
    day = F.to_date("ts")
    v = F.when(F.col("event_id") % 7 == 0, F.lit(".")).otherwise(F.col("value").cast("string"))
    o = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), v.alias("value"), F.date_format(day, "yyyy-MM-dd").alias("realtime_start"), F.date_format(F.date_add(day, 10), "yyyy-MM-dd").alias("realtime_end"))
    p = e.groupBy(F.col("event_type").alias("series_id"), _chunk("event_id")).agg(F.to_json(F.struct(F.collect_list(o).alias("observations"))).alias("payload"))
    return X.parse_macro(p)


_MACRO = "m AS (SELECT event_type AS series_id, ts::DATE AS date, CASE WHEN event_id % 7 <> 0 THEN value END AS value, ts::DATE AS realtime_start, ts::DATE + 10 AS realtime_end FROM events)"


@query(f"WITH {_MACRO} SELECT * FROM m")
def parse_macro(spark, d):
    return _macro(spark, d)


@query(f"WITH {_MACRO} SELECT series_id, date, value FROM m WHERE realtime_start <= DATE '2024-01-15' AND DATE '2024-01-15' <= realtime_end")
def macro_vintage(spark, d):
    return X.vintage(_macro(spark, d), "2024-01-15")


def _news(spark, d):
    e = B.table(spark, d, "events")
    a = F.struct(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.lit("dom").alias("domain"), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).otherwise(F.lit("bad")).alias("seendate"))
    return X.parse_gdelt(e.groupBy("event_type", _chunk("event_id")).agg(F.to_json(F.struct(F.collect_list(a).alias("articles"))).alias("payload")))


_NEWS = "n AS (SELECT date_trunc('second', ts)::TIMESTAMP AS published_at, 't' || event_id AS headline, 'u' || event_id AS url FROM events WHERE event_id % 2 = 0)"


@query(f"WITH {_NEWS} SELECT published_at, headline, url FROM n")
def parse_news(spark, d):
    return _news(spark, d).select(F.col("published_at").cast("timestamp_ntz").alias("published_at"), "headline", "url")


@query(f"WITH {_NEWS} SELECT published_at, headline, url FROM n WHERE published_at < TIMESTAMP '2024-01-12 00:00:00'")
def news_point_in_time(spark, d):
    return X.point_in_time(_news(spark, d), "2024-01-12 00:00:00").select(F.col("published_at").cast("timestamp_ntz").alias("published_at"), "headline", "url")


@query("""SELECT event_id, CASE WHEN x <= -0.35 THEN 'bearish' WHEN x <= -0.15 THEN 'somewhat_bearish' WHEN x < 0.15 THEN 'neutral' WHEN x < 0.35 THEN 'somewhat_bullish' ELSE 'bullish' END AS label
 FROM (SELECT event_id, (event_id % 201 - 100) / 100.0::DOUBLE AS x FROM events)""")
def sentiment_labels(spark, d):
    return B.table(spark, d, "events").select("event_id", X.sentiment_label((F.col("event_id") % 201 - 100) / 100.0).alias("label"))


@query(f"WITH {Q.EVENT_BARS} SELECT symbol, date, {FIELDS} FROM bars")
def json_round_trip(spark, d):
    path = B.scratch(spark, "json")
    b = B.event_bars(spark, d)
    b.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")).write.json(path)
    r = spark.read.schema("symbol string, date string, open double, high double, low double, close double, volume double").json(path)
    return r.withColumn("date", F.to_timestamp_ntz("date", F.lit("yyyy-MM-dd HH:mm:ss")))


@query(f"""WITH {Q.EVENT_BARS}, m AS (SELECT event_type AS symbol, ts AS date, value AS v, event_id FROM events),
 k AS (SELECT symbol, date, arg_max(v, event_id) AS v FROM m GROUP BY ALL)
 SELECT b.symbol, b.date, b.close, k.v FROM bars b ASOF LEFT JOIN k ON b.symbol = k.symbol AND b.date >= k.date""")
def as_of_join(spark, d):
    e = B.table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.col("ts").alias("date")).agg(F.max_by("value", "event_id").alias("v"))
    return B.as_of_join(B.event_bars(spark, d).select("symbol", "date", "close"), e, "symbol", "date", "v")


def _raw(spark, d):
    b = B.order_bars(spark, d)
    day = F.dayofyear("date")
    return b.withColumns({"div_cash": F.when(day % 45 == 0, F.col("close") * 0.01).when(day % 45 != 1, 0.0), "split_factor": F.when(day % 180 == 0, 2.0).when(day % 180 == 1, 0.0).otherwise(1.0)})


@query(f"""WITH {Q.ORDER_BARS}, r AS (SELECT *, CASE WHEN dayofyear(date) % 45 = 0 THEN close * 0.01 ELSE 0 END AS dv, CASE WHEN dayofyear(date) % 180 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sp FROM bars),
 q AS (SELECT *, (1 / sp) * (1 - coalesce(dv / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0), 0)) AS ratio FROM r),
 f AS (SELECT *, coalesce(product(ratio) OVER w, 1) AS pf, coalesce(product(sp) OVER w, 1) AS vf FROM q WINDOW w AS (PARTITION BY symbol ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT symbol, date, round(open * pf, 4) AS open, round(close * pf, 4) AS close, round(volume * vf, 4) AS volume FROM f""")
def adjust_prices(spark, d):
    a = P.adjust(_raw(spark, d))
    return a.select("symbol", "date", *(F.round(c, 4).alias(c) for c in ("open", "close", "volume")))


def _dirty(spark, d):
    """Order bars with faults: some prices missing or negative, high below low, no volume, repeated rows."""
    b = B.order_bars(spark, d).withColumn("k", F.dayofyear("date"))
    b = b.withColumns({
        "open": F.when(F.col("k") % 50 != 0, F.col("open")), "low": F.when(F.col("k") % 61 == 0, -F.col("low")).otherwise(F.col("low")),
        "high": F.when(F.col("k") % 71 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(F.col("k") % 81 == 0, F.lit(0.0)).otherwise(F.col("volume")),
    })
    return b.unionByName(b.where("k % 91 = 0")).drop("k")


_DIRTY = f"""{Q.ORDER_BARS}, d0 AS (SELECT symbol, date, dayofyear(date) AS k, CASE WHEN dayofyear(date) % 50 <> 0 THEN open END AS open, CASE WHEN dayofyear(date) % 61 = 0 THEN -low ELSE low END AS low,
 CASE WHEN dayofyear(date) % 71 = 0 THEN low - 1 ELSE high END AS high, close, CASE WHEN dayofyear(date) % 81 = 0 THEN 0 ELSE volume END AS volume FROM bars),
 d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE k % 91 = 0)"""
_REQUEST = "rq AS (SELECT * FROM (SELECT DISTINCT symbol FROM d UNION ALL SELECT 'NOWHERE') CROSS JOIN (SELECT DATE '1995-01-01' AS a, DATE '2001-12-31' AS b))"


def _request(spark, d):
    names = B.order_bars(spark, d).select("symbol").distinct().union(spark.createDataFrame([("NOWHERE",)], "symbol string"))
    return names.select("symbol", F.lit("1995-01-01").cast("date").alias("start"), F.lit("2001-12-31").cast("date").alias("end"))


def _count(kind: str, severity: str, cond: str, detail: str = "") -> str:
    return f"SELECT symbol, '{kind}' AS kind, '{severity}' AS severity, count(*) AS n, '{detail}' AS detail FROM d WHERE {cond} GROUP BY symbol"


_ROWS = " UNION ALL ".join(
    ["SELECT symbol, 'empty' AS kind, 'error' AS severity, 0 AS n, '' AS detail FROM rq WHERE symbol NOT IN (SELECT symbol FROM d)",
     "SELECT symbol, 'duplicate_dates', 'error', count(*) - count(DISTINCT date), '' FROM d GROUP BY symbol HAVING count(*) > count(DISTINCT date)"]
    + [_count("nan", "warning", f"{c} IS NULL", c) for c in P.PRICES] + [_count("nonpositive_price", "warning", f"{c} <= 0", c) for c in P.PRICES]
    + [_count("high_lt_low", "error", "high < low"), _count("zero_volume", "warning", "coalesce(volume, 0) <= 0")])


def _listed(src: str, kind: str) -> str:
    return f"SELECT symbol, '{kind}', 'warning', count(*), array_to_string(list_sort(list(strftime(date, '%Y-%m-%d')))[1:5], ', ') FROM {src} GROUP BY symbol"


@query(f"""WITH {_DIRTY}, {_REQUEST}, h AS (SELECT DISTINCT symbol, date::DATE AS date FROM d), s AS (SELECT symbol, min(date) AS d0, max(date) AS d1 FROM h GROUP BY symbol),
 cal AS (SELECT x::DATE AS date FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6),
 ms AS (SELECT s.symbol, cal.date FROM s JOIN cal ON cal.date BETWEEN d0 AND d1 ANTI JOIN h ON h.symbol = s.symbol AND h.date = cal.date),
 un AS (SELECT symbol, date FROM h WHERE date NOT IN (SELECT date FROM cal)),
 k AS (SELECT s.symbol, count(CASE WHEN cal.date < d0 THEN 1 END) AS x, count(CASE WHEN cal.date > d1 THEN 1 END) AS y FROM s JOIN rq USING (symbol) JOIN cal ON cal.date BETWEEN least(a, d0) AND greatest(b, d1) GROUP BY s.symbol)
 {_ROWS} UNION ALL {_listed('ms', 'missing_days')} UNION ALL {_listed('un', 'unexpected_session')}
 UNION ALL SELECT symbol, 'coverage_truncated', 'warning', x, 'start' FROM k WHERE x > 0 UNION ALL SELECT symbol, 'coverage_truncated', 'warning', y, 'end' FROM k WHERE y > 0""")
def quality_exact(spark, d):
    return P.quality_issues(_dirty(spark, d), _request(spark, d), P.sessions(spark, "us_equity", "1995-01-01", "2001-12-31"))


_GAPS = f"""h AS (SELECT DISTINCT symbol, date::DATE AS date FROM d), s AS (SELECT symbol, min(date) AS d0, max(date) AS d1 FROM h GROUP BY symbol),
 g AS (SELECT symbol, date FROM (SELECT symbol, date, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS g FROM h) WHERE g > 5),
 iss AS ({_ROWS} UNION ALL {_listed('g', 'calendar_gap')}
 UNION ALL SELECT s.symbol, 'coverage_truncated', 'warning', d0 - a, 'start' FROM s JOIN rq USING (symbol) WHERE d0 > a UNION ALL SELECT s.symbol, 'coverage_truncated', 'warning', b - d1, 'end' FROM s JOIN rq USING (symbol) WHERE b > d1)"""


@query(f"WITH {_DIRTY}, {_REQUEST}, {_GAPS} SELECT * FROM iss")
def quality_fallback(spark, d):
    return P.quality_issues(_dirty(spark, d), _request(spark, d))


@query(f"WITH {_DIRTY}, {_REQUEST}, {_GAPS} SELECT rq.symbol, count(CASE WHEN severity = 'error' THEN 1 END) = 0 AS ok, count(kind) AS n_issues FROM rq LEFT JOIN iss USING (symbol) GROUP BY rq.symbol")
def quality_universe(spark, d):
    return P.universe_ok(P.quality_issues(_dirty(spark, d), _request(spark, d)), _request(spark, d))


@query("SELECT x::DATE AS date FROM range(TIMESTAMP '2020-01-01', TIMESTAMP '2022-01-01', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6")
def calendar_sessions(spark, d):
    return P.sessions(spark, "us_equity", "2020-01-01", "2021-12-31")


_CLASS = "CASE p_size % 4 WHEN 0 THEN 'etf' WHEN 1 THEN 'equity' WHEN 2 THEN 'crypto' END"


def _parts(spark, d):
    p = B.table(spark, d, "part")
    k = F.col("p_size") % 4
    cls = p.select(F.col("p_name").alias("symbol"), F.when(k == 0, "etf").when(k == 1, "equity").when(k == 2, "crypto").alias("asset_class"), "p_partkey", "p_retailprice").dropDuplicates(["symbol"])
    return p, cls


_COST = "SELECT p_partkey, 'P' || p_partkey AS symbol, p_size, p_retailprice FROM part"


@query(f"""WITH s AS ({_COST}), c AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {f}::DOUBLE, {s}::DOUBLE, {x}::DOUBLE)" for a, f, s, x in P.COST_CLASSES)}) t(asset_class, f, l, x)),
 j AS (SELECT s.symbol, coalesce({_CLASS}, 'equity') AS asset_class, CASE WHEN p_partkey % 10 = 0 THEN round(p_retailprice / 100, 2) END AS o FROM s),
 r AS (SELECT symbol, j.asset_class, coalesce(o, f) AS fees_bps, l AS slippage_bps, x AS spread_bps FROM j JOIN c ON c.asset_class = j.asset_class)
 SELECT *, slippage_bps + spread_bps / 2 AS effective_slippage_bps, fees_bps + slippage_bps + spread_bps / 2 AS total_bps FROM r""")
def symbol_costs(spark, d):
    p = B.table(spark, d, "part")
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    k = F.col("p_size") % 4
    cls = p.select(F.lower(name).alias("symbol"), F.when(k == 0, "etf").when(k == 1, "equity").when(k == 2, "crypto").alias("asset_class"))
    over = p.where("p_partkey % 10 = 0").select(name.alias("symbol"), F.round(F.col("p_retailprice") / 100, 2).alias("fees_bps"), F.lit(None).cast("double").alias("slippage_bps"), F.lit(None).cast("double").alias("spread_bps"))
    classes = spark.createDataFrame(P.COST_CLASSES, "asset_class string, fees_bps double, slippage_bps double, spread_bps double")
    return P.resolve_costs(p.select(name.alias("symbol")), over, cls, classes)


@query(f"SELECT symbol, asset_class, 'crypto_24_7' AS calendar FROM (SELECT symbol, {_CLASS} AS asset_class FROM ({_COST})) WHERE asset_class = 'crypto'")
def calendar_conflicts(spark, d):
    p = B.table(spark, d, "part")
    k = F.col("p_size") % 4
    return P.calendar_conflicts(p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.when(k == 0, "etf").when(k == 1, "equity").when(k == 2, "crypto").alias("asset_class")).where("asset_class is not null"), "us_equity")


@query(f"WITH {Q.ORDER_BARS} SELECT symbol, count(*) AS n FROM bars GROUP BY symbol")
def content_counts(spark, d):
    return B.content_hash(B.order_bars(spark, d)).select("symbol", "n")


@query(f"WITH {Q.ORDER_PANEL} SELECT symbol, date, close FROM p")
def order_close_panel(spark, d):
    return order_panel(spark, d).select("symbol", "date", "close")



_ADJ = f"""{Q.ORDER_BARS}, r AS (SELECT *, CASE WHEN dayofyear(date) % 45 = 0 THEN close * 0.01 ELSE 0 END AS dv, CASE WHEN dayofyear(date) % 180 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sp FROM bars),
 q AS (SELECT *, (1 / sp) * (1 - coalesce(dv / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0), 0)) AS ratio FROM r),
 f AS (SELECT symbol, date, close * coalesce(product(ratio) OVER w, 1) AS close FROM q WINDOW w AS (PARTITION BY symbol ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {_ADJ} SELECT s.symbol, d.date, round(f.close, 4) AS close FROM (SELECT DISTINCT date FROM f) d CROSS JOIN (SELECT DISTINCT symbol FROM f) s LEFT JOIN f ON f.symbol = s.symbol AND f.date = d.date""")
def load_panel(spark, d):
    raw = _raw(spark, d)
    names = raw.select("symbol").distinct()
    req = names.select("symbol", F.lit("1995-01-01").cast("date").alias("start"), F.lit("2001-08-01").cast("date").alias("end"))
    p = L.load_panel(raw, req, names.withColumn("asset_class", F.lit("etf")), "us_equity")
    return p.select("symbol", "date", F.round("close", 4).alias("close"))


@query(f"""WITH {Q.EVENT_BARS} SELECT symbol, date, {FIELDS} FROM bars""")
def refresh_symbols(spark, d):
    """Half of the bars are stored, the other half comes from a fetch of the gaps; together they are all."""
    b = B.event_bars(spark, d)
    half = b.where("date < timestamp_ntz'2024-01-15'")
    cov = half.groupBy("symbol").agg(F.to_date(F.min("date")).alias("start"), F.lit("2024-01-14").cast("date").alias("end"))
    req = b.groupBy("symbol").agg(F.to_date(F.min("date")).alias("start"), F.to_date(F.max("date")).alias("end"))

    def fetch(plan):
        p = plan.withColumnRenamed("symbol", "s")
        return b.join(p, (F.col("symbol") == F.col("s")) & F.to_date("date").between(F.col("start"), F.col("end"))).select("symbol", "date", *B.FIELDS)

    return L.refresh(half, cov, req, fetch)[0]


@query(f"SELECT symbol, CASE WHEN asset_class = 'crypto' THEN 'crypto_24_7' ELSE 'us_equity' END AS calendar FROM (SELECT symbol, {_CLASS} AS asset_class FROM ({_COST}))")
def route_by_calendar(spark, d):
    p = B.table(spark, d, "part")
    k = F.col("p_size") % 4
    s = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.when(k == 0, "etf").when(k == 1, "equity").when(k == 2, "crypto").alias("asset_class"))
    return L.route_by_calendar(s.select("symbol"), s)
