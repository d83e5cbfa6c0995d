"""Resharding by minimum-cost flow: which blocks move so that the fewest bytes do, and a rewrite of the affected shards alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .mixing import prefix_sum

BLOCK_IDS, SLICE_BLOCKS = 1024, 4096


def even_flow(supply: list[int], capacity: list[int], same: list[int]) -> dict[tuple[int, int], int]:
    """``min_cost_flow`` where a byte that stays costs 0 and any other 1: {(old, new): bytes}, without the zeros.

    ``same`` gives the new shard that an old one is, or -1. Every flow in which each shard keeps what it can is a cheapest one, as
    all other ways cost the same; surplus goes to room in the order of the shards. Linear in the number of shards.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are too small")
    room, flow, left = list(capacity), {}, list(supply)
    for i, j in enumerate(same):
        if j >= 0 and (n := min(left[i], room[j])):
            flow[i, j] = n
            left[i] -= n
            room[j] -= n
    j = 0
    for i, n in enumerate(left):
        while n:
            while not room[j]:
                j += 1
            x = min(n, room[j])
            flow[i, j] = flow.get((i, j), 0) + x
            n -= x
            room[j] -= x
    return flow


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Bytes from each old to each new shard at least total cost, by successive shortest paths (Bellman-Ford on residuals).

    Ties go to the lowest old, then the lowest new shard. Raises ValueError where the capacities can't hold the supply.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are too small")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        inf = float("inf")
        old = [0.0 if x else inf for x in left]
        new, from_old, from_new = [inf] * m, [-1] * m, [-1] * n
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if old[i] < inf:
                    for j in range(m):
                        if old[i] + cost[i][j] < new[j] - 1e-12:
                            new[j], from_old[j], changed = old[i] + cost[i][j], i, True
            for j in range(m):
                if new[j] < inf:
                    for i in range(n):
                        if flow[i][j] and new[j] - cost[i][j] < old[i] - 1e-12:
                            old[i], from_new[i], changed = new[j] - cost[i][j], j, True
        goal = min((j for j in range(m) if room[j]), key=lambda j: (new[j], j))
        path, j = [], goal
        while True:
            i = from_old[j]
            path.append((i, j, True))
            if from_new[i] < 0:
                break
            j = from_new[i]
            path.append((i, j, False))
        push = min([left[i], room[goal], *(flow[a][b] for a, b, up in path if not up)])
        for a, b, up in path:
            flow[a][b] += push if up else -push
        left[i] -= push
        room[goal] -= push
    return flow


def plan(docs: DataFrame, capacities: dict[str, int] | None = None, extra: int = 4, shard: str = "source", block_ids: int = BLOCK_IDS, costs: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Where each document goes: (doc_id, old_shard, new_shard, moved).

    Old shards are the values of ``shard`` (NULL counts as the shard ''), their sizes the bytes of the texts (NULL text: 0). New
    ``capacities`` in bytes default to the old names and ``extra`` new ones (new0, new1, ...) with an equal share each, rounded
    up. A byte that stays costs 0, one that moves 1, or what ``costs`` gives for (old, new). The flow is exact in bytes; it is
    carried out in blocks (the documents of one shard in a stretch of ``block_ids`` ids; NULL ids count as -1): in each shard,
    blocks in order of their ids first fill what stays, then the transfers in order of the new names, and a block belongs
    to the stretch its first byte falls in, so a shard exceeds its capacity by less than one block for each transfer. The driver
    sees one row for each shard only. Repeated rows move together; an empty table gives no rows.
    """
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(shard).cast("string"), F.lit("")).alias("old_shard"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
    ).withColumn("block", F.floor(F.coalesce("doc_id", F.lit(-1)) / block_ids))
    blocks = written(d.groupBy("old_shard", "block").agg(F.sum("bytes").alias("bytes")), "blocks")
    sizes = {r["old_shard"]: r["b"] for r in blocks.groupBy("old_shard").agg(F.sum("bytes").alias("b")).collect()}
    old = sorted(sizes)
    if capacities is None:
        names = sorted(old + [f"new{i}" for i in range(extra)])
        share = -(-sum(sizes.values()) // max(len(names), 1))
        capacities = dict.fromkeys(names, share)
    new = sorted(capacities)
    supply, rooms, place = [sizes[a] for a in old], [capacities[b] for b in new], {b: j for j, b in enumerate(new)}
    if costs:
        dense = min_cost_flow(supply, rooms, [[costs.get((a, b), 0.0 if a == b else 1.0) for b in new] for a in old])
        flow = {(i, j): n for i, row in enumerate(dense) for j, n in enumerate(row) if n}
    else:
        flow = even_flow(supply, rooms, [place.get(a, -1) for a in old])
    goals: dict[int, list[tuple[int, int]]] = {}
    for (i, j), n in sorted(flow.items()):
        goals.setdefault(i, []).append((j, n))
    stretches = []
    for i, a in enumerate(old):
        at = 0
        for j, n in sorted(goals.get(i, []), key=lambda x: (new[x[0]] != a, x[0])):
            stretches.append((a, new[j], at, at + n))
            at += n
        # empty documents behind the last byte go where the last byte is
        if stretches and stretches[-1][0] == a:
            stretches[-1] = (*stretches[-1][:3], 1 << 62)
        else:
            stretches.append((a, a if a in capacities else new[0], 0, 1 << 62))
    spark = docs.sparkSession
    s = spark.createDataFrame(stretches, "s_shard string, new_shard string, lo long, hi long")
    b = blocks.withColumn("slice", F.floor(F.col("block") / SLICE_BLOCKS))
    b = prefix_sum(b, ["old_shard"], "slice", ["block"], "bytes", "end").withColumn("at", F.col("end") - F.col("bytes"))
    placed = b.join(F.broadcast(s), (F.col("old_shard") == F.col("s_shard")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))  # a row for each transfer between shards
    placed = placed.select(F.col("old_shard").alias("p_shard"), F.col("block").alias("p_block"), "new_shard")
    return (
        d.join(placed, (d.old_shard == F.col("p_shard")) & (d.block == F.col("p_block")))
        .select("doc_id", "old_shard", "new_shard", (F.col("old_shard") != F.col("new_shard")).alias("moved"))
    )


def rewrite(
    docs: DataFrame, out_dir: str, capacities: dict[str, int] | None = None, extra: int = 4, shard: str = "source", block_ids: int = BLOCK_IDS, costs: dict[tuple[str, str], float] | None = None
) -> DataFrame:
    """Write the affected shards under ``out_dir`` (shard=<name>/) and return a manifest (shard, documents, bytes, rewritten).

    Only shards that give or get a block are written; for the others the manifest says rewritten = false and their old files
    hold. Documents keep all columns. A document's place is that of ``plan``. A table that has a column "shard" is written under
    another name (_cw_shard=<name>/).
    """
    p = written(plan(docs, capacities, extra, shard, block_ids, costs), "plan")
    return _rewritten(docs, p, out_dir, shard, block_ids)


def _rewritten(docs: DataFrame, p: DataFrame, out_dir: str, shard: str, block_ids: int) -> DataFrame:
    new, key, k1, k2, kd, hit, name = fresh(docs, "new_shard", "old", "k_old", "k_block", "block", "hit", "shard")
    block = F.floor(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) / block_ids)
    places = p.select(F.col("old_shard").alias(k1), block.alias(k2), F.col("new_shard").alias(new)).distinct()
    moves = p.where("moved").select("old_shard", "new_shard").distinct()
    touched = moves.select(F.col("old_shard").alias(hit)).union(moves.select("new_shard")).distinct()
    places = written(places.join(touched, F.col(new) == F.col(hit), "left"), "places")
    d = docs.withColumn(key, F.coalesce(F.col(shard).cast("string"), F.lit(""))).withColumn(kd, block)
    d = d.join(places, (F.col(key) == F.col(k1)) & (F.col(kd) == F.col(k2)))
    if "shard" not in {c.lower() for c in docs.columns}:
        name = "shard"
    d.where(F.col(hit).isNotNull()).select(*docs.columns, F.col(new).alias(name)).write.mode("overwrite").partitionBy(name).parquet(out_dir)
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long")
    return d.groupBy(F.col(new).alias("shard")).agg(F.count("*").alias("documents"), size.alias("bytes"), F.max(F.col(hit).isNotNull()).alias("rewritten"))


def reshard(docs: DataFrame, out_dir: str, capacities: dict[str, int] | None = None, extra: int = 4, shard: str = "source", block_ids: int = BLOCK_IDS) -> DataFrame:
    """``plan``, carried out: the affected shards are written under ``out_dir`` (see ``rewrite``) and the plan is returned."""
    p = written(plan(docs, capacities, extra, shard, block_ids), "plan")
    _rewritten(docs, p, out_dir, shard, block_ids)
    return p
