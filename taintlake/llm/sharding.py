"""Sharding by minimax contiguous partition.

All rows of one text form an atomic group.  Groups are ordered by a 64-bit hash of the
text (texts that share it stay together too) and cut into contiguous shards so that the
largest shard is as small as possible: a binary search over the capacity, each checked
greedily.  A checker needs only group sizes near the cuts, so it works on a tree of hash
ranges: it starts from 4,096 equal ranges, bounds the capacity from both sides, and asks
for finer sizes (one aggregation each round) of just the ranges that a cut may fall in,
until both bounds agree.  The driver holds some thousand numbers, whatever the input.

Within the best capacity the cuts are then moved so that shards are as even as they can
be, which matters when one group is larger than a fair share."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taintlake.plans.storage import saved

TOP_BITS, STEP_BITS = 12, 6
SLOT_ROWS = 20_000


@dataclass
class Span:
    """Groups whose unsigned hash starts with `prefix` (of `bits` bits)."""

    prefix: int
    bits: int
    size: int
    groups: int
    largest: int

    @property
    def start(self) -> int:
        return self.prefix << (64 - self.bits)


def _fill(spans: list[Span], capacity: int, inside: bool) -> tuple[int, list[tuple[int, int]]]:
    """Shards that a greedy fill needs, and (span, bytes into it) of each cut.  `inside`:
    a span of several groups may be cut at any byte, which no real cut can beat."""
    shards, room, cuts = 1, capacity, []
    for i, s in enumerate(spans):
        left = s.size
        while left > room:
            if not inside or s.groups == 1:
                if left > capacity:
                    return 1 << 62, cuts
                cuts.append((i, 0))
                shards, room = shards + 1, capacity
                continue
            left -= room
            cuts.append((i, s.size - left))
            shards, room = shards + 1, capacity
        room -= left
    return shards, cuts


def _smallest(spans: list[Span], shards: int, inside: bool) -> int:
    low = max([-(-sum(s.size for s in spans) // shards), *(s.largest if inside else s.size for s in spans)], default=0)
    high = max(low, sum(s.size for s in spans))
    while low < high:
        middle = (low + high) // 2
        if _fill(spans, middle, inside)[0] <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _even_cuts(spans: list[Span], shards: int, capacity: int) -> list[int]:
    """First span of each further shard: none above the capacity, each as near to a fair
    share of what is left as that allows."""
    n, total = len(spans), sum(s.size for s in spans)
    need = [0] * (n + 1)  # shards that the spans from i on need at this capacity
    ahead, end, room = [0] * (n + 1), n, 0
    sums = [0]
    for s in spans:
        sums.append(sums[-1] + s.size)
    for i in range(n - 1, -1, -1):
        while sums[end] - sums[i] > capacity:
            end -= 1
        ahead[i] = end
        need[i] = 1 + need[end]
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        fair = sums[at] + (total - sums[at]) / left
        stop = at
        while stop < n and stop < ahead[at] and sums[stop + 1] <= fair:
            stop += 1
        if stop < n and stop < ahead[at] and sums[stop + 1] - fair < fair - sums[stop]:
            stop += 1
        while stop < n and need[stop] > left - 1:
            stop += 1
        cuts.append(stop)
        at = stop
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity, and the unsigned hash at which each further shard starts, for
    groups (h long, size long)."""
    def ranges(df: DataFrame, bits: int) -> list[Span]:
        key = F.shiftrightunsigned("h", 64 - bits)
        rows = df.groupBy(key.alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()
        # Ranges are not told apart below 63 bits.
        return [Span(r.prefix, bits, r.size, r.n if bits < 63 else 1, r.largest if bits < 63 else r.size) for r in rows]

    spans = sorted(ranges(groups, TOP_BITS), key=lambda s: s.start)
    while True:
        low, high = _smallest(spans, shards, inside=True), _smallest(spans, shards, inside=False)
        if low == high:
            break
        # A real cut lies between that of a fill that never cuts inside a range, at the
        # lower bound, and that of one that may cut anywhere, at the upper bound.
        early, late = (_fill(spans, c, inside)[1] for c, inside in ((low, False), (high, True)))
        asked = {i for i, s in enumerate(spans) if s.size > low}
        for (first, _), (last, _) in zip(early, late, strict=False):
            asked.update(range(first, last + 1))
        asked = {i for i in asked if spans[i].groups > 1}
        if not asked:
            break
        by_bits: dict[int, list[int]] = {}
        for i in asked:
            by_bits.setdefault(spans[i].bits, []).append(spans[i].prefix)
        fresh = []
        for bits, prefixes in by_bits.items():
            wanted = groups.where(F.shiftrightunsigned("h", 64 - bits).isin(prefixes))
            fresh += ranges(wanted, min(63, bits + STEP_BITS))
        spans = sorted([s for i, s in enumerate(spans) if i not in asked] + fresh, key=lambda s: s.start)
    cuts = _even_cuts(spans, shards, high)
    return high, [spans[i].start if i < len(spans) else 1 << 64 for i in cuts]


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row of `docs` with its shard by the law `bytes`.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from
    0 in each shard), grown_shard (null).  A null text has no bytes, and is a group with
    the empty texts.  Repeated rows are rows of their own.  A null doc_id is kept.  An
    empty table gives no rows.  A group is never split, so a text that holds more than
    a fair share of all bytes makes its shard larger.  Other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = saved(rows, "shard-rows")
    groups = saved(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards) if groups.limit(1).count() else (0, [])
    # Spark compares signed numbers: flip the sign bit of both sides.
    order = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    number = sum(((order >= F.lit(c - (1 << 63))).cast("int") for c in cuts if c < 1 << 64), F.lit(0))
    # Slots: number the rows of small hashed buckets, and add what the buckets before hold.
    buckets = max(1, math.ceil(rows.count() / SLOT_ROWS))
    dealt = rows.select("doc_id", "size", "text_crc32", number.alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).alias("bucket"))
    held = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = held.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return (dealt.withColumn("place", place).join(before, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
