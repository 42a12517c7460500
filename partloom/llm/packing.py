"""Problem 9: items of varying length in containers of fixed capacity with little unused space.

Method: cost-balanced packing. An item costs a linear and a quadratic part of its tokens, as attention does; items go
in descending order to the container of lowest cost that still has room.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.tokenizer import token_counts
from partloom.session import materialize, table


def pack_shard(sizes: list[int], capacity: int, linear: float, quadratic: float) -> list[int]:
    """Container of each item, items given in descending order.

    As many containers as the sum needs are open from the start; a further one opens only if no open one has room.
    """
    n = max(1, math.ceil(sum(sizes) / capacity))
    room = [capacity] * n
    heap = [(0.0, c) for c in range(n)]
    out = []
    for size in sizes:
        passed = []
        while heap and room[heap[0][1]] < size:
            passed.append(heapq.heappop(heap))
        if heap:
            cost, c = heapq.heappop(heap)
        else:
            cost, c = 0.0, len(room)
            room.append(capacity)
        room[c] -= size
        out.append(c)
        for x in passed:
            heapq.heappush(heap, x)
        heapq.heappush(heap, (cost + linear * size + quadratic * size * size, c))
    return out


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", containers_per_shard: int = 256, rows_per_shard: int = 200_000, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """``(key, piece, start, n_tokens, container_id)``: every item placed, in pieces only if it exceeds ``capacity``.

    A larger item is cut into full containers and a rest. The other pieces are dealt by a hash to shards of about
    ``containers_per_shard`` containers and at most about ``rows_per_shard`` items, empty ones included, and packed shard by
    shard, so no task holds more than a shard; a shard wastes
    less than one container beside what cannot be filled. Null and negative sizes count as 0 and are placed as well;
    repeated keys are repeated items; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    items = materialize(sizes.select(F.col(key).alias("_key"), n.alias("_n")).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / F.lit(capacity)) - 1, F.lit(0)).cast("long")))
    start = F.col("piece") * F.lit(capacity)
    pieces = items.withColumn("piece", cuts).select("_key", "_row", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("_n") - start).alias("n_tokens"))
    rest = pieces.filter(F.col("n_tokens") < capacity)
    total = rest.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, math.ceil(total / (capacity * containers_per_shard)), math.ceil(rest.count() / rows_per_shard))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "_row", "piece"], ascending=[False, True, True])
        pdf["container_id"] = [f"s{pdf['shard'].iloc[0]}-{c}" for c in pack_shard(pdf["n_tokens"].tolist(), capacity, linear, quadratic)]
        return pdf[["_key", "piece", "start", "n_tokens", "container_id"]]

    kind = items.schema["_key"].dataType.simpleString()
    packed = rest.groupBy("shard").applyInPandas(run, f"_key {kind}, piece long, start long, n_tokens long, container_id string")
    whole = pieces.filter(F.col("n_tokens") == capacity).select("_key", "piece", "start", "n_tokens", F.concat(F.lit("f"), "_row", F.lit("-"), "piece").alias("container_id"))
    return whole.unionByName(packed).withColumnRenamed("_key", key)


def p9_pack(spark, sf_dir: str, capacity: int = 2048) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")), capacity)


def p9_fill(spark, sf_dir: str, capacity: int = 2048) -> DataFrame:
    """Containers by tenth of their fill, with their share of attention cost."""
    used = p9_pack(spark, sf_dir, capacity).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("squares"))
    return used.groupBy(F.floor(F.col("used") * 10 / capacity).alias("fill_tenth")).agg(F.count("*").alias("n_containers"), F.sum("used").alias("tokens"), F.round(F.avg("squares"), 1).alias("mean_squares"))
