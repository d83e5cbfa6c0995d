"""Vendor payloads to tables. Fetching is outside; these take JSON strings as a column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_eod(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(symbol, payload) of end-of-day rows as a JSON array -> raw bars; dividend defaults to 0, split to 1, zone cut off."""
    t = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double,divCash:double,splitFactor:double>>"
    x = rows.select("symbol", F.explode(F.from_json(payload, t)).alias("r"))
    return x.select(
        "symbol", F.to_timestamp_ntz(F.substring("r.date", 1, 10), F.lit("yyyy-MM-dd")).alias("date"), "r.open", "r.high", "r.low", "r.close", "r.volume",
        F.coalesce("r.divCash", F.lit(0.0)).alias("div_cash"), F.coalesce("r.splitFactor", F.lit(1.0)).alias("split_factor"),
    )


def parse_crypto(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """[{ticker, priceData: [{date, open, ...}]}] -> bars at midnight, one a day (the last stamp of a day wins)."""
    t = "array<struct<ticker:string,priceData:array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>>>"
    x = rows.select(F.explode(F.from_json(payload, t)).alias("a")).select(F.upper("a.ticker").alias("symbol"), F.explode("a.priceData").alias("r"))
    x = x.select("symbol", F.to_timestamp_ntz(F.substring("r.date", 1, 10), F.lit("yyyy-MM-dd")).alias("day"), F.col("r.date").alias("stamp"), "r.open", "r.high", "r.low", "r.close", "r.volume")
    return x.groupBy("symbol", F.col("day").alias("date")).agg(*(F.max_by(c, "stamp").alias(c) for c in ("open", "high", "low", "close", "volume")))


def parse_macro(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(series_id, payload) with {"observations": [{date, value, realtime_start, realtime_end}]} -> long series; "." is NULL."""
    t = "struct<observations:array<struct<date:string,value:string,realtime_start:string,realtime_end:string>>>"
    x = rows.select("series_id", F.explode(F.from_json(payload, t)["observations"]).alias("o"))
    return x.select("series_id", F.to_date("o.date").alias("date"), F.expr("try_cast(nullif(o.value, '.') AS double)").alias("value"), F.to_date("o.realtime_start").alias("realtime_start"), F.to_date("o.realtime_end").alias("realtime_end"))


def vintage(macro: DataFrame, as_of: str) -> DataFrame:
    """The series as it was known on a day: rows whose real-time span holds it."""
    d = F.lit(as_of).cast("date")
    return macro.where((F.col("realtime_start") <= d) & (d <= F.col("realtime_end"))).select("series_id", "date", "value")


def sentiment_label(x: Column) -> Column:
    """Five labels by score: bounds 0.15 and 0.35 on either side; NULL stays NULL."""
    return (
        F.when(x <= -0.35, "bearish").when(x <= -0.15, "somewhat_bearish").when(x < 0.15, "neutral").when(x < 0.35, "somewhat_bullish").when(x.isNotNull(), "bullish")
    )


def parse_gdelt(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """{"articles": [{title, url, domain, seendate}]} -> news; articles without title, url or a readable date are dropped."""
    t = "struct<articles:array<struct<title:string,url:string,domain:string,seendate:string>>>"
    x = rows.select(F.explode(F.from_json(payload, t)["articles"]).alias("a"))
    x = x.select(F.try_to_timestamp("a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("published_at"), F.trim("a.title").alias("headline"), F.col("a.domain").alias("source"), F.col("a.url").alias("url"))
    return x.where(F.col("published_at").isNotNull() & (F.length("headline") > 0) & (F.length("url") > 0)).select(
        "published_at", "headline", "source", "url", F.lit("gdelt").alias("provider"), F.array().cast("array<string>").alias("symbols"), F.lit(None).cast("double").alias("sentiment"), F.lit(None).cast("string").alias("label")
    )


def parse_alpha(rows: DataFrame, symbol: str | None = None, payload: str = "payload") -> DataFrame:
    """{"feed": [...]} -> news; the score of ``symbol`` beats the article's; rows without title or date are dropped."""
    t = "struct<feed:array<struct<title:string,url:string,source:string,time_published:string,overall_sentiment_score:double,ticker_sentiment:array<struct<ticker:string,ticker_sentiment_score:string>>>>>"
    x = rows.select(F.explode(F.from_json(payload, t)["feed"]).alias("a")).select("a.*")
    own = F.filter("ticker_sentiment", lambda s: s["ticker"] == F.lit(symbol))
    score = F.coalesce(F.expr("NULL") if symbol is None else F.get(own, F.lit(0))["ticker_sentiment_score"].cast("double"), F.col("overall_sentiment_score"))
    x = x.select(F.try_to_timestamp("time_published", F.lit("yyyyMMdd'T'HHmmss")).alias("published_at"), F.col("title").alias("headline"), "source", "url", F.lit("alpha_vantage").alias("provider"), F.transform("ticker_sentiment", lambda s: s["ticker"]).alias("symbols"), score.alias("sentiment"))
    return x.where(F.col("published_at").isNotNull() & (F.length("headline") > 0)).withColumn("label", sentiment_label(F.col("sentiment")))


def dropped_after(items: DataFrame, as_of: str, time_col: str = "published_at") -> int:
    """How many items ``point_in_time`` leaves out: those of the moment or later, and those without a time."""
    kind = items.schema[time_col].dataType
    return items.where(F.col(time_col).isNull() | (F.col(time_col) >= F.lit(as_of).cast(kind))).count()


def revised_series(macro: DataFrame) -> DataFrame:
    """(series_id, n_revised): days that a series reports with several values; such a series has to be read as of a date."""
    n = macro.groupBy("series_id", "date").agg(F.count_distinct("value").alias("n"))
    return n.where("n > 1").groupBy("series_id").agg(F.count("*").alias("n_revised"))


def point_in_time(items: DataFrame, as_of: str, time_col: str = "published_at", zoned: bool = False) -> DataFrame:
    """What was published strictly before a moment, newest first. With ``zoned`` a moment without a zone is an error."""
    if zoned and not re.search(r"(Z|[+-]\d{2}:?\d{2})$", as_of.strip()):
        raise ValueError(f"{as_of} has no time zone")
    kind = items.schema[time_col].dataType
    return items.where(F.col(time_col) < F.lit(as_of).cast(kind)).orderBy(F.desc(time_col))
