"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt by their population count into tiles of bounded size.
Two fingerprints within a radius differ in population count by no more than it, so
only tile pairs whose counts are that close meet; inside a pair the counts of the
upper halves cut the comparison again.  A pair of tiles answers with the spanning
stars of its links, never with the links themselves.

The number of tile pairs grows with the square of the distinct fingerprints; this is
the price of exact tiles.  Equal fingerprints, and so all exact copies, cost nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintlake.llm.tables import components
from taintlake.llm.unionfind import union
from taintlake.plans.storage import saved

TILE_ROWS = 16_384
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of word shingles, repeats included; zero without words."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
        hashed = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    else:
        hashed = xxhash.xxh64_digest(joined, SEED)
    rows = np.frombuffer(hashed, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(rows), 65_536):
        ones += np.unpackbits(rows[i:i + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def _stars(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside a, or between a and b, as (fingerprint, root) stars."""
    low = np.uint64(32)
    both = np.sort(a if b is None else np.concatenate((a, b)))
    root = np.arange(len(both))

    def laid(x):
        high = np.bitwise_count(x >> low).astype(np.int64)
        order = np.argsort(high, kind="stable")
        return x[order], high[order], np.searchsorted(both, x[order])

    x, hx, ix = laid(a)
    y, hy, iy = (x, hx, ix) if b is None else laid(b)
    for h in np.unique(hx):
        s, e = np.searchsorted(hx, [h, h + 1])
        lo, hi = np.searchsorted(hy, [h - radius, h + radius + 1])
        if b is None:
            lo = max(lo, s)  # each pair once
        step = max(1, 2_000_000 // max(1, hi - lo))
        for i in range(s, e, step):
            j = min(e, i + step)
            near = np.bitwise_count(x[i:j, None] ^ y[None, lo:hi]) <= radius
            p, q = np.nonzero(near)
            if len(p):
                union(root, ix[i + p], iy[lo + q])
    told = np.flatnonzero(root != np.arange(len(root)))
    return both[told], both[root[told]]


def link_fingerprints(prints: DataFrame, name: str, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(fp, root) for each distinct fingerprint (long `fp`) that has a link: root
    names the component."""
    spark = prints.sparkSession
    distinct = saved(prints.select("fp").where("fp IS NOT NULL").distinct(), f"{name}-distinct")
    counted = distinct.withColumn("ones", F.bit_count("fp"))
    tiles = {r.ones: -(-r.n // tile_rows) for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    if not tiles:
        return spark.createDataFrame([], "node long, root long")
    count = F.element_at(F.create_map(*[F.lit(x) for kv in tiles.items() for x in kv]), F.col("ones"))
    dealt = counted.withColumn("tile", F.pmod(F.xxhash64("fp"), count).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                         pa.array([np.asarray(table["fp"]).astype("<i8").tobytes()], pa.binary())], ["ones", "tile", "data"])

    def compare(table: pa.Table) -> pa.Table:
        sides = {s: np.frombuffer(d, np.uint64) for s, d in zip(table["side"].to_pylist(), table["data"].to_pylist(), strict=True)}
        none = np.zeros(0, np.uint64)  # hashing may leave a tile empty
        a, b = _stars(sides.get(0, none), sides.get(1), radius)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    packed = dealt.select("ones", "tile", "fp").groupBy("ones", "tile").applyInArrow(pack, "ones int, tile int, data binary")
    # A tile goes to each of its pairs row by row; no task holds all its copies.
    pairs = packed.select(F.explode(_pairs(tiles, radius)).alias("p"), "data").select("p.pair", "p.side", "data")
    return components(pairs.groupBy("pair").applyInArrow(compare, "a long, b long"), f"{name}-links")


def _pairs(tiles: dict[int, int], radius: int) -> Column:
    """The pairs of tiles that a tile (`ones`, `tile`) takes part in, and its side."""
    counts = F.create_map(*[F.lit(x) for kv in tiles.items() for x in kv])

    def some(start: Column, end: Column, name, side: int) -> Column:
        return F.when(end > start, F.transform(F.sequence(start, end - 1), lambda o: F.struct(name(o).alias("pair"), F.lit(side).alias("side"))))

    out = []
    for d in range(radius + 1):
        for near, side in ((F.col("ones") + d, 0), (F.col("ones") - d, 1)):
            n = F.coalesce(F.try_element_at(counts, near), F.lit(0))
            mine = F.concat_ws(".", "ones", "tile")
            name = (lambda o, near=near: F.concat(mine, F.lit("-"), F.concat_ws(".", near, o))) if side == 0 else (
                lambda o, near=near: F.concat(F.concat_ws(".", near, o), F.lit("-"), mine))
            start, end = (F.col("tile"), n) if d == 0 and side == 0 else (F.lit(0), F.col("tile")) if d == 0 else (F.lit(0), n)
            out.append(F.coalesce(some(start, end, name, side), F.array().cast("array<struct<pair:string,side:int>>")))
    return F.concat(*out)


def _printed(rows: DataFrame, shingle: int) -> DataFrame:
    """Column text replaced by its fingerprint fp; saved."""
    keep = [c for c in rows.columns if c != "text"]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(found.view(np.int64))], [*keep, "fp"])

    form = ", ".join([*[f"{c} long" for c in keep], "fp long"])
    return saved(rows.mapInArrow(prints, form), "simhash-prints")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links
    of `radius` bits or fewer reach, itself included) for every row of `docs`.

    Texts that are null, empty or blank have fingerprint zero, which links like any
    other.  A text of fewer words than a shingle is one shingle.  Rows that repeat a
    doc_id each get a row.  A row without doc_id belongs to its component, whose id is
    the smallest doc_id there, or null if there is none.  Other columns are ignored."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = _printed(slim, shingle)
    links = link_fingerprints(marked, "simhash", radius)
    smallest = marked.groupBy("fp").agg(F.min("doc_id").alias("low")).join(links.withColumnRenamed("node", "fp"), "fp", "left")
    smallest = smallest.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of_root = smallest.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = smallest.join(of_root, "root").select("fp", "component_id")
    return marked.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row of `docs` for each component of `near_duplicates`: the one with the
    smallest doc_id, rows without a doc_id last; among rows of one doc_id that with the
    smallest hash of all columns.  Rows equal in all columns are one row."""
    # Rows are told apart by 128 bits over all columns; a null is not the same as no column.
    whole = [c for name in docs.columns for c in (docs[name], docs[name].isNull())]
    keyed = docs.select(*docs.columns, F.xxhash64(*whole).alias("_h1"), F.xxhash64(F.lit(1), *whole).alias("_h2"))
    marked = _printed(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                   F.col("_h1").alias("h1"), F.col("_h2").alias("h2")), shingle)
    links = link_fingerprints(marked, "simhash", radius)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")
    low = marked.groupBy("fp").agg(F.min(key).alias("low")).join(links.withColumnRenamed("node", "fp"), "fp", "left")
    kept = low.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("low").alias("low")).select(F.col("low.h1").alias("_h1"), F.col("low.h2").alias("_h2"))
    # Equal rows fall together before they are sent, and the join keeps that order.
    distinct = keyed.groupBy("_h1", "_h2").agg(F.first(F.struct(*docs.columns)).alias("row"))
    return distinct.join(kept, ["_h1", "_h2"]).select("row.*")
