"""Bars from tables, the raw bar store, and the planning of incremental loads.

Bars are long: symbol STRING, date TIMESTAMP_NTZ, open, high, low, close, volume DOUBLE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of ``events``: symbol = event type, prices = value in order of event_id, volume = number of events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("date")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"),
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ``orders``: symbol = region of the customer, prices = o_totalprice in order of o_orderkey."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return j.groupBy(F.col("r_name").alias("symbol"), F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"),
    )


def clean(df: DataFrame, cols: tuple[str, ...] = FIELDS) -> DataFrame:
    """NaN becomes NULL in the given columns, so that NULL alone means missing."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def densify(bars: DataFrame) -> DataFrame:
    """The panel: every symbol on every date that any symbol has, fields NULL where there is no bar.

    Windows over rows then count calendar rows, as they would in a wide frame. The cross join is of distinct symbols and
    dates, never of bars.
    """
    grid = bars.select("date").distinct().crossJoin(bars.select("symbol").distinct())
    return grid.join(bars, ["symbol", "date"], "left").select("symbol", "date", *FIELDS)


def read_symbols(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Range read of the bar store: partitions of the wanted symbols, dates pushed to the scan; unknown symbols give nothing."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("timestamp_ntz"))
    return df.orderBy("symbol", "date")


def write_symbols(df: DataFrame, path: str) -> None:
    """Write bars by symbol; only the symbols in ``df`` are replaced."""
    df.repartition("symbol").sortWithinPartitions("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared folder of the cluster (a local one only where none is set and all runs on this machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
    base = base or "file:///tmp/candlewright-shared"
    return f"{base.rstrip('/')}/cw-{what}-{uuid.uuid4().hex}"


def merge_bars(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stored and new bars, of which the new one wins on an equal (symbol, date); later ``ordinal`` wins within the new ones."""
    cols = ["symbol", "date", *FIELDS]
    both = stored.select(*cols, F.lit(0).alias("batch"), F.lit(0).cast("long").alias("ordinal")).union(
        fetched.select(*cols, F.lit(1).alias("batch"), (F.col("ordinal") if "ordinal" in fetched.columns else F.lit(0)).cast("long").alias("ordinal"))
    )
    w = Window.partitionBy("symbol", "date").orderBy(F.desc("batch"), F.desc("ordinal"))
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*cols)


RAW = "date timestamp_ntz, open double, high double, low double, close double, volume double, div_cash double, split_factor double, symbol string"


def raw_store(spark: SparkSession, path: str) -> DataFrame:
    """Raw bars (with div_cash, split_factor) of a store that ``write_symbols`` made; none where there is none."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], RAW)
    return spark.read.schema(RAW).parquet(path)


def merge_raw(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """``merge_bars`` for raw bars: of an equal (symbol, date) the fetched one wins."""
    cols = ["symbol", "date", *FIELDS, "div_cash", "split_factor"]
    both = stored.select(*cols, F.lit(0).alias("batch")).unionByName(fetched.select(*cols, F.lit(1).alias("batch")))
    w = Window.partitionBy("symbol", "date").orderBy(F.desc("batch"))
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*cols)


def gap_plan(requested: DataFrame, coverage: DataFrame) -> DataFrame:
    """What must be fetched: (symbol, need, start, end) for requested spans (symbol, start, end) against covered ones.

    need is 'full' without coverage, else 'before' and/or 'after'; a covered request has no row.
    """
    c = coverage.select("symbol", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    j = requested.join(c, "symbol", "left")
    need = F.array(
        F.when(F.col("c_start").isNull(), F.struct(F.lit("full").alias("need"), "start", "end")),
        F.when(F.col("start") < F.col("c_start"), F.struct(F.lit("before").alias("need"), "start", F.date_sub("c_start", 1).alias("end"))),
        F.when(F.col("end") > F.col("c_end"), F.struct(F.lit("after").alias("need"), F.date_add("c_end", 1).alias("start"), "end")),
    )
    return j.select("symbol", F.explode(F.array_compact(need)).alias("n")).select("symbol", "n.need", "n.start", "n.end")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, start, end) of a stored coverage, its latest version; none where there is no such store."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("version=") and fs.exists(_done(spark, s.getPath()))) if fs.exists(fs_path) else []
    schema = "symbol string, start date, end date"
    return spark.read.schema(schema).parquet(f"{path}/version={versions[-1]}") if versions else spark.createDataFrame([], schema)


def _done(spark: SparkSession, folder):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")


def write_coverage(coverage: DataFrame, path: str) -> None:
    """Store a coverage as a further version, so that a reader never meets half of one; a version without its mark doesn't count."""
    spark = coverage.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max((int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("version=")), default=-1) if fs.exists(fs_path) else -1
    coverage.select("symbol", "start", "end").write.parquet(f"{path}/version={last + 1}")


def widen_coverage(coverage: DataFrame, requested: DataFrame) -> DataFrame:
    """Coverage after a fetch: the union span of what was covered and what was asked for."""
    return coverage.select("symbol", "start", "end").union(requested.select("symbol", "start", "end")).groupBy("symbol").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def to_wide(panel: DataFrame, symbols: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row a date, columns symbol|field."""
    aggs = [F.first(f).alias(f) for f in fields]
    wide = panel.groupBy("date").pivot("symbol", symbols).agg(*aggs)
    return wide.select("date", *(F.col(f"`{s}_{f}`" if len(fields) > 1 else f"`{s}`").alias(f"{s}|{f}") for s in symbols for f in fields))


def from_wide(wide: DataFrame) -> DataFrame:
    """Back to long rows (symbol, date, fields...); rows without any value are left out."""
    cols = [c.split("|") for c in wide.columns if "|" in c]
    fields = list(dict.fromkeys(f for _, f in cols))
    symbols = list(dict.fromkeys(s for s, _ in cols))
    rows = F.array(*(F.struct(F.lit(s).alias("symbol"), *(F.col(f"`{s}|{f}`").alias(f) for f in fields)) for s in symbols))
    return wide.select("date", F.explode(rows).alias("r")).select("r.symbol", "date", *(f"r.{f}" for f in fields)).where(F.coalesce(*fields).isNotNull())


def normalize_ohlcv(df: DataFrame) -> DataFrame:
    """Any frame with the five fields and a date column (names in any case) as bars of doubles and zone-less timestamps."""
    by = {c.lower(): c for c in df.columns}
    date = next((by[n] for n in ("date", "datetime", "timestamp", "ts") if n in by), None)
    missing = [f for f in FIELDS if f not in by]
    if date is None or missing:
        raise ValueError(f"missing columns: {missing + ([] if date else ['date'])}")
    sym = [F.col(f"`{by['symbol']}`").alias("symbol")] if "symbol" in by else []
    return df.select(*sym, F.col(f"`{date}`").cast("timestamp_ntz").alias("date"), *(F.col(f"`{by[f]}`").cast("double").alias(f) for f in FIELDS))


def content_hash(bars: DataFrame) -> DataFrame:
    """Hash of each symbol's whole content (order-free): (symbol, n, content_hash)."""
    return bars.groupBy("symbol").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("date", *FIELDS)).alias("content_hash"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """Each left row with the latest ``value`` of ``right`` (same key) at or before it: one union and one window, no range join."""
    cols = left.columns
    l = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)})
    r = right.select(*(F.col(c) if c in (key, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*cols, value)
