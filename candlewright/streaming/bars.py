"""Bars and indicators on Structured Streaming, with the semantics of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.shipping import ensure
from candlewright.sources.bars import scratch


def ticks(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Stream of (symbol, ts, seq, price) from Parquet files of events; event time is a zoned timestamp, as watermarks need.

    A trigger takes all files there are: what is stored by then is one batch, in order of seq whatever the files' order.
    """
    schema = schema or spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).parquet(path)
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def ohlcv(t: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) bars; rows later than the watermark are dropped, state behind it is freed."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return t.withWatermark("ts", late).groupBy("symbol", win.alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count("*").cast("double").alias("volume")
    ).select("symbol", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")


def sessions(t: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Activity sessions by symbol: (symbol, start, end, n)."""
    s = t.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fold_ema(x: np.ndarray, alpha: float, y: float | None = None, w: float = 1.0) -> tuple[np.ndarray, float | None, float]:
    """Exponential mean of x (NaN: missing) from the state (y, w) on: (values, y, w). Weights decay over gaps, as in the batch mean."""
    out, nan, keep = [], float("nan"), 1 - alpha
    for v in x.tolist():
        if v == v:
            y, w = (v, 1.0) if y is None else ((w * keep * y + alpha * v) / (w * keep + alpha), 1.0)
        elif y is not None:
            w *= keep
        out.append(nan if y is None else y)
    return np.array(out, dtype=float), y, w


def running_ema(t: DataFrame, span: int) -> DataFrame:
    """(symbol, seq, ema): exponential mean of each symbol's prices, carried in state across batches and over missing prices.

    A batch's rows of one symbol are in one task; ``ema_table`` spreads them.
    """
    alpha = 2.0 / (span + 1)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        y, w = state.get if state.exists else (None, 1.0)
        pdf = pd.concat([f[["seq", "price"]] for f in frames]).sort_values("seq")
        out, y, w = fold_ema(pdf["price"].to_numpy(dtype=float, na_value=np.nan), alpha, y, w)
        state.update((y, w))
        yield pd.DataFrame({"symbol": key[0], "seq": pdf["seq"].to_numpy(), "ema": out})

    ensure(t.sparkSession)
    return t.select("symbol", "seq", "price").groupBy("symbol").applyInPandasWithState(step, "symbol string, seq long, ema double", "y double, w double", "append", "NoTimeout")


STATE = "symbol string, y double, w double"
#: Rows a part, about; so many a task's Python worker holds at once.
PART_ROWS = 100_000
#: What a part does to the mean before it: its missing prices ahead of the first one, the first price, the share of a change of the
#: first mean that is left at the end, and mean and weight at the end when nothing is before it.
PART = "symbol string, part int, n long, ahead long, first double, left double, y double, w double"


def _part(x: np.ndarray, alpha: float) -> tuple:
    _, y, w = fold_ema(x, alpha)
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return len(x), len(x), None, None, None, 1.0
    u = (1 - alpha) ** np.diff(at).astype(float)
    return len(x), int(at[0]), float(x[at[0]]), float(np.prod(u / (u + alpha))), y, w


def _after(state: tuple, part, alpha: float) -> tuple:
    """State (y, w) after a part, from the one before it."""
    y, w = state
    if pd.isna(part.first):
        return y, w * (1 - alpha) ** part.n if y is not None else 1.0
    if y is None:
        return part.y, part.w
    u = w * (1 - alpha) ** (part.ahead + 1)
    begin = (u * y + alpha * part.first) / (u + alpha)
    return part.y + part.left * (begin - part.first), part.w


def ema_batch(t: DataFrame, span: int, before: DataFrame | None, path: str, out: str, state: str, part_rows: int = PART_ROWS) -> None:
    """Write (symbol, seq, ema) of the rows t to ``out`` and the state after them to ``state``, from the state ``before`` on.

    The rows are cut into ranges of (symbol, seq), so that no task has to hold a symbol: each part is summed up, the parts of a symbol
    are chained, and each part is folded from its own beginning. ``path`` takes the cut rows and the chain.
    """
    ensure(t.sparkSession)
    spark, alpha = t.sparkSession, 2.0 / (span + 1)
    x = t.select("symbol", F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"))
    # stored before it is used, as a range's bounds come from a sample that another run may draw otherwise
    x.repartitionByRange(-(-t.count() // part_rows) or 1, "symbol", "seq").withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema("symbol string, seq long, price double, part int").parquet(f"{path}/rows")
    price = lambda pdf: pdf["price"].to_numpy(dtype=float, na_value=np.nan)

    def sum_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *_part(price(pdf.sort_values("seq", kind="stable")), alpha))], columns=["symbol", "part", "n", "ahead", "first", "left", "y", "w"])

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The state at the beginning of each part, and at the end, where part is NULL. The state before has no rows and comes first."""
        now, at = (None, 1.0), []
        for r in pdf.sort_values("part", kind="stable").itertuples(index=False):
            if r.part < 0:
                now = (None if pd.isna(r.y) else r.y, r.w)
            else:
                at.append((key[0], r.part, *now))
                now = _after(now, r, alpha)
        at.append((key[0], None, *now))
        c = pd.DataFrame(at, columns=["symbol", "part", "y", "w"])
        return c.astype({"part": "Int32", "y": "float64", "w": "float64"})

    def fold(key: tuple, pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        y, w = begin["y"].iloc[0], begin["w"].iloc[0]
        e, _, _ = fold_ema(price(pdf), alpha, None if pd.isna(y) else float(y), float(w))
        return pd.DataFrame({"symbol": key[0], "seq": pdf["seq"].to_numpy(), "ema": pd.array(e, dtype="Float64") if not np.isnan(e).any() else pd.array(np.where(np.isnan(e), None, e), dtype="Float64")})

    parts = rows.groupBy("symbol", "part").applyInPandas(sum_up, PART)
    if before is not None:
        zero = F.lit(0).cast("long")
        parts = parts.unionByName(before.select("symbol", F.lit(-1).alias("part"), zero.alias("n"), zero.alias("ahead"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("left"), "y", "w"))
    parts.groupBy("symbol").applyInPandas(chain, "symbol string, part int, y double, w double").write.mode("overwrite").parquet(f"{path}/chain")
    begins = spark.read.schema("symbol string, part int, y double, w double").parquet(f"{path}/chain")
    rows.groupBy("symbol", "part").cogroup(begins.where("part is not null").groupBy("symbol", "part")).applyInPandas(fold, "symbol string, seq long, ema double").write.mode("overwrite").parquet(out)
    begins.where("part is null").select("symbol", "y", "w").write.mode("overwrite").parquet(state)


def ema_table(t: DataFrame, span: int, path: str, checkpoint: str, part_rows: int = PART_ROWS):
    """``running_ema`` appended to the Parquet table ``path``/ema, each batch once (batch id in the path), whatever the size of a symbol."""

    def step(df: DataFrame, i: int) -> None:
        before = df.sparkSession.read.schema(STATE).parquet(f"{path}/state/batch={i - 1}") if i else None
        ema_batch(df, span, before, f"{path}/work", f"{path}/ema/batch={i}", f"{path}/state/batch={i}", part_rows)

    return t.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a stream has written below ``path``, without the batch ids; no rows where no batch had any."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_available(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Process what there is into a new table of files in the shared folder and return it; in complete mode the last batch's rows."""
    path = scratch(stream.sparkSession, name)

    def step(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/table" if mode == "complete" else f"{path}/table/batch={i}")

    q = stream.writeStream.foreachBatch(step).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return written(stream.sparkSession, f"{path}/table", stream.schema).select(*stream.columns)


def run_ema(t: DataFrame, span: int, name: str) -> DataFrame:
    """``ema_table`` over what there is, in a new folder of the shared one: (symbol, seq, ema)."""
    path = scratch(t.sparkSession, name)
    ema_table(t, span, path, f"{path}/checkpoint").awaitTermination()
    schema = "symbol string, seq long, ema double"
    return written(t.sparkSession, f"{path}/ema", schema).select("symbol", "seq", "ema")


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Append finished windows to a Parquet table, each batch once (batch id in the path)."""
    return stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
