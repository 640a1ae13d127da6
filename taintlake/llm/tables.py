"""Helpers on DataFrames: ordered ranges of a key, connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintlake.plans.storage import saved


def range_starts(df: DataFrame, key: str, rows: int) -> list[int]:
    """Keys that start ranges of about `rows` rows each; the smallest key is first.
    Every start occurs in the data.  One number per `rows` rows reaches the driver."""
    n = df.count()
    parts = max(1, math.ceil(n / rows))
    low, starts = df.agg(F.min(key), F.percentile_approx(key, [i / parts for i in range(parts)], max(10_000, 10 * parts))).first()
    return sorted({low, *(starts or [])}) if low is not None else []


def range_of(key: Column, starts: list[int]) -> Column:
    """Number of the range that a key lies in, found in two steps through literal
    arrays (a square root of the ranges each)."""
    if len(starts) < 2:
        return F.lit(0).cast("long")
    step = math.isqrt(len(starts) - 1) + 1
    rows = [starts[i:i + step] for i in range(0, len(starts), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows]) if len(rows) < 64 else F.expr(f"array({','.join(f'{r[0]}L' for r in rows)})")
    inner = F.expr("array(" + ",".join("array(" + ",".join(f"{x}L" for x in r) + ")" for r in rows) + ")")

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= key))

    block = F.greatest(upto(heads), F.lit(1))
    return ((block - 1) * step + F.greatest(upto(F.element_at(inner, block)), F.lit(1)) - 1).cast("long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it
    can reach.  Alternates large-star and small-star rounds; each round is written
    to the shared folder, so a lost executor costs one round at most."""

    def stars(pairs: DataFrame, small: bool) -> DataFrame:
        if small:  # point the larger end at the smaller ones, and these at the least
            out = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            out = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        least = out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = out.join(least, "u")
        if small:
            linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        else:
            linked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return linked.where("a <> b").distinct()

    state, before = saved(edges.select("a", "b").where("a <> b").distinct(), name), None
    while True:
        state = saved(stars(stars(state, small=False), small=True), name)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        if now == before:
            break
        before = now
    return (state.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(state.select("b", "b")).groupBy("node").agg(F.min("root").alias("root")))
