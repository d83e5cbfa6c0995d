"""Loading a universe: guardrail, gap planning and fetching, quality gate, adjustment, dense panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.operators import prepare as P
from candlewright.sources import bars as B


class QualityError(ValueError):
    """A load that the quality gate stopped."""


def route_by_calendar(plan: DataFrame, class_of: DataFrame) -> DataFrame:
    """``plan`` (symbol, ...) with the calendar, and so the connector, that each symbol's class belongs to; unknown classes fall to us_equity."""
    names = F.create_map(*[F.lit(x) for kv in P.ASSET_CALENDAR.items() for x in kv])
    j = plan.join(class_of.select("symbol", "asset_class"), "symbol", "left")
    return j.withColumn("calendar", F.coalesce(F.try_element_at(names, F.coalesce("asset_class", F.lit(""))), F.lit("us_equity"))).drop("asset_class")


def refresh(stored: DataFrame, coverage: DataFrame, requested: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged bars, new coverage, fetched symbols): only what coverage lacks is asked of ``fetch`` (a plan -> bars)."""
    plan = B.gap_plan(requested, coverage)
    new = fetch(plan)
    return B.merge_bars(stored, new), B.widen_coverage(coverage, requested), plan.select("symbol").distinct()


def load_panel(bars: DataFrame, requested: DataFrame, class_of: DataFrame, calendar: str, calendar_days: DataFrame | None = None) -> DataFrame:
    """The adjusted dense panel of raw bars (with div_cash, split_factor); mixed calendars and quality errors raise before any work.

    Warnings (gaps, missing prices) let the load pass.
    """
    P.require_one_calendar(class_of, calendar)
    c = P.calendar(calendar)
    bad = P.quality_issues(bars, requested, calendar_days, c.max_gap_days).where("severity = 'error'").limit(20).collect()
    if bad:
        raise QualityError("; ".join(f"{r['symbol']}: {r['kind']}" for r in bad))
    return B.densify(B.clean(P.adjust(bars)))


def load_universe(
    spark: SparkSession, config: dict, name: str, start: str, end: str, fetch: Callable[[DataFrame], DataFrame], store: str, class_of: DataFrame | None = None, calendar_days: DataFrame | None = None
) -> DataFrame:
    """From a universe's settings to its dense panel, the stored bars first: (symbol, date, fields).

    ``store`` is a folder with the bars by symbol and their coverage. Only what the coverage lacks is asked of ``fetch`` (a plan
    -> raw bars); the symbols that got bars are rewritten, then the coverage is widened, and the quality gate and the adjustment
    run over the universe's symbols between the two days. A universe without symbols or of mixed calendars is an error.
    """
    if name not in config:
        raise KeyError(f"no universe {name}")
    members = universe_table(spark, {name: config[name]})
    symbols = [r["symbol"] for r in members.select("symbol").distinct().collect()]
    if not symbols:
        raise ValueError(f"universe {name} has no symbols")
    cal = members.select("calendar").first()["calendar"]
    requested = members.select("symbol", F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end")).distinct()
    classes = members.select("symbol", F.lit("crypto" if cal == "crypto_24_7" else "equity").alias("asset_class")) if class_of is None else class_of.join(members.select("symbol"), "symbol", "left_semi")
    P.require_one_calendar(classes, cal)
    bars, coverage = f"{store}/bars", B.read_coverage(spark, f"{store}/coverage")
    plan = B.gap_plan(requested, coverage)
    if plan.limit(1).count():
        new, have = fetch(plan), B.raw_store(spark, bars)
        got = new.select("symbol").distinct()
        merged = B.merge_raw(have.join(got, "symbol", "left_semi"), new)
        tmp = B.scratch(spark, "fetched")  # a store can't be read and replaced at once
        merged.write.parquet(tmp)
        B.write_symbols(spark.read.parquet(tmp), bars)
        B.write_coverage(B.widen_coverage(coverage, requested), f"{store}/coverage")
    raw = B.raw_store(spark, bars).where(F.col("symbol").isin(symbols) & F.to_date("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return load_panel(raw, requested, classes, cal, calendar_days)


def periods_per_year(calendar: str, explicit: float | None = None) -> float:
    """An explicit setting wins, else the calendar's convention."""
    return float(explicit) if explicit is not None else float(P.calendar(calendar).periods_per_year)


def universe_table(spark: SparkSession, config: dict) -> DataFrame:
    """(universe, provider, calendar, delisted_included, point_in_time, last_audit_date, symbol) of {name: settings}; wrong types are NULL."""
    flag = lambda v: v if isinstance(v, bool) else None
    rows = [
        (n, u.get("provider"), u.get("calendar", "us_equity"), flag(u.get("delisted_included")), flag(u.get("point_in_time")), str(u["last_audit_date"]) if u.get("last_audit_date") else None, s)
        for n, u in config.items() for s in u.get("symbols", [])
    ]
    t = spark.createDataFrame(rows, "universe string, provider string, calendar string, delisted_included boolean, point_in_time boolean, last_audit_date string, symbol string")
    return t.withColumn("last_audit_date", F.expr("try_cast(last_audit_date AS date)"))
