"""Sharding on a consistent-hash ring with bounded loads (operator 5).

The ring has CELLS places.  Each shard owns `virtual` of them, drawn by hash;
a row hashes to a place and belongs to the next virtual node clockwise.  A
shard takes no more rows than its capacity: floor or ceil of rows/shards, so
counts are at most one apart.  Rows beyond it go on clockwise to the next
virtual node whose shard has room.

Only the number of rows at each place (CELLS counters, whatever the input)
reaches the driver, which lays out intervals of ranks; rows find their shard by
their rank within their place.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import workspace

CELLS = 1 << 16


def ring(shards: int, virtual: int) -> list[int]:
    """The shard of every place: that of the next virtual node clockwise. A place taken already is passed on for the next draw."""
    owner: dict[int, int] = {}
    for s in range(shards):
        draw = 0
        for v in range(virtual):
            while (at := xxhash.xxh64_intdigest(f"{s}:{v}:{draw}", 0) % CELLS) in owner:
                draw += 1
            owner[at] = s
    out, nearest = [0] * CELLS, owner[min(owner)]
    for c in range(CELLS - 1, -1, -1):
        nearest = owner.get(c, nearest)
        out[c] = nearest
    return out


def layout(counts: dict[int, int], shards: int, virtual: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (place, first rank, rank after the last, shard, slot of the first) for the rows counted at each place."""
    home = ring(shards, virtual)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out, over = [], deque()
    for c in sorted(counts):
        s, n = home[c], counts[c]
        k = min(n, room[s] - used[s])
        if k:
            out.append((c, 0, k, s, used[s]))
            used[s] += k
        if k < n:
            over.append((c, k, n))
    # Clockwise from the place, the order in which shards come.
    for c, k, n in over:
        at = c
        while k < n:
            s = home[at % CELLS]
            take = min(n - k, room[s] - used[s])
            if take:
                out.append((c, k, k + take, s, used[s]))
                used[s] += take
                k += take
            at += 1
    return out


def shard(df: DataFrame, shards: int, virtual: int = 128, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size: bytes of the UTF-8 text plus 8, null text counting none.  A row's
    place is decided by its key, size and checksum; rows that are equal in all
    three take consecutive ranks.  slot: gapless from 0 in every shard.  An
    empty table gives an empty one; null keys are placed like others.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("k"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    rows = rows.groupBy("k", "size", "crc").agg(F.count("*").alias("copies"))
    place = F.pmod(F.xxhash64("k", "size", "crc"), F.lit(CELLS)).cast("int")
    rows = workspace.written(rows.withColumn("place", place), "sizes")
    counts = {r["place"]: r["n"] for r in rows.groupBy("place").agg(F.sum("copies").alias("n")).collect()}
    plan = pd.DataFrame(layout(counts, shards, virtual), columns=["place", "low", "high", "shard", "slot0"])
    plan = spark.createDataFrame(plan, "place int, low bigint, high bigint, shard int, slot0 bigint")
    by_place = Window.partitionBy("place").orderBy("k", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("rank0", F.coalesce(F.sum("copies").over(by_place), F.lit(0)))
    each = ranked.withColumn("rank", F.explode(F.expr("sequence(rank0, rank0 + copies - 1)")))
    p = F.broadcast(plan)  # at most CELLS + 2 * shards intervals
    at = each.join(p, (each.place == plan.place) & (each["rank"] >= plan.low) & (each["rank"] < plan.high))
    return at.select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("rank") - F.col("low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
