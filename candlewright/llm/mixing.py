"""Mixing sources to target weights by weighted fair queueing, and prefix sums that no single task has to carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_parts, written

DEFAULT_WEIGHT, SEED = 1.0, 5
WORD = r"[^ \t\n\r\f]+"


def prefix_sum(df: DataFrame, group: list[str], slice_col: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` in each group in the order (slice_col, *order), the row itself included.

    Sums by slice are few (slices x groups) and get their own running sum; within a slice a window does the rest, so work is
    partitioned by (group, slice) and no partition has to hold a whole group.
    """
    keys = [*group, slice_col]
    per = df.groupBy(*keys).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    before = per.withColumn("_before", F.sum("_s").over(w.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).drop("_s")
    b = before.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_before")
    inner = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.withColumn("_in", inner).join(b, on).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", *(f"_k_{k}" for k in keys))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, fraction: float = 0.5, seed: int = SEED) -> DataFrame:
    """The documents that fit the budget: (doc_id, source, tokens, finish, running, row_key).

    In each source the documents stand in the order of a hash of (seed, doc_id). A document's virtual finish time is the
    source's tokens up to and with it, divided by the source's weight (``weights``, else 1; weights must be above 0). All
    documents are sorted by finish time (then source, doc_id, tokens) and kept while the running total of tokens is at most
    ``budget`` (else ``fraction`` of all tokens, rounded down). Tokens are runs of signs other than space, tab and line ends. A
    NULL text has 0 tokens; NULL sources form one source; a NULL doc_id stands last in its hash slice order; repeated rows count
    each time.
    """
    weights = weights or {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        F.xxhash64("doc_id", "source", "text").alias("row_key"),
    ).withColumn("shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    weight = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    d = written(d.withColumn("part", F.substring("shuffle", 1, 3)), "mix")
    f = prefix_sum(d, ["source"], "part", ["shuffle", F.col("doc_id").asc_nulls_last(), "tokens", "row_key"], "tokens", "cum")
    f = f.withColumn("finish", F.col("cum") / weight).select("doc_id", "source", "tokens", "row_key", "finish")
    order = ["finish", F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), "tokens", "row_key"]
    # the ranges come from a sample of the finish times, so that a source with a tiny weight can't crowd the others into one
    f = written(f.repartitionByRange(n_parts(docs.sparkSession), *order).withColumn("slot", F.spark_partition_id()), "finish")
    total = f.agg(F.sum("tokens")).first()[0] or 0
    limit = budget if budget is not None else int(total * fraction)
    r = prefix_sum(f, [], "slot", order, "tokens", "running")
    return r.where(F.col("running") <= limit).drop("slot")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, fraction: float = 0.5, seed: int = SEED) -> DataFrame:
    """``schedule`` in range-sorted order of finish time: (doc_id, source, tokens, finish, running)."""
    s = schedule(docs, weights, budget, fraction, seed)
    return s.orderBy("finish", "source", "doc_id").select("doc_id", "source", "tokens", "finish", "running")


def select_mixture(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, fraction: float = 0.5, seed: int = SEED) -> DataFrame:
    """The documents that ``schedule`` keeps, with all their columns, whatever their names.

    Of rows with the same id, source and text as many stay as fit, in the order of a hash of all their columns.
    """
    s = schedule(docs, weights, budget, fraction, seed)
    key, other, n, rn = fresh(docs, "key", "other", "n", "rn")
    keep = s.groupBy(F.col("row_key").alias(other)).agg(F.count("*").alias(n))
    id_, src = F.col("doc_id").cast("long"), F.col("source").cast("string")
    d = docs.withColumn(key, F.xxhash64(id_, src, "text")).join(keep, F.col(key) == F.col(other))
    d = d.withColumn(rn, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*(F.to_json(F.struct(F.col(c))) if "map<" in t else F.col(c) for c, t in docs.dtypes)))))
    return d.where(F.col(rn) <= F.col(n)).select(*docs.columns)
