"""Embedding near-duplicates with hierarchical navigable small-world graphs.

Equal vectors of a label are one node.  The nodes of each label are dealt into shards
of bounded size, every shard gets a graph, and every shard's nodes query every graph of
their label (each pair of shards once, as the cosine is symmetric).  A task draws
queries, looks up their ten nearest neighbours by brute force, which every query has
however rare links are, and widens its beams until searches find 99 % of them and 99.5 %
of these queries' links.  Only then all queries search the graph, and beams that are full
of links are widened further; a pair of shards is searched from both sides.  If beams as
wide as the graph fail, the pair is compared exactly; `audits` tells where, and the recall
of all others.  Links are verified in double precision; a task answers with numbers of
links and spanning stars, and components are joined across tasks by the stars."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintlake.llm.tables import components
from taintlake.llm.unionfind import union
from taintlake.plans.storage import saved

#: Most vectors of a shard, and most bytes of its vectors in double precision.
SHARD_ROWS, SHARD_BYTES = 10_000, 64 << 20
AUDIT_QUERIES, AUDIT_NEIGHBOURS = 256, 10
AUDIT_RECALL, AUDIT_LINK_RECALL = 0.99, 0.995
DEGREE, BUILD_BEAM, FIRST_BEAM = 16, 64, 64
_SLACK = 1e-3  # single precision finds, double precision decides


class Graph:
    """HNSW over rows of unit vectors; built and searched in batches."""

    def __init__(self, vectors: np.ndarray):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        rng = np.random.default_rng(0)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(DEGREE)).astype(int), 8)
        self.links = [np.full((n, DEGREE * 4), -1, np.int32) for _ in range(self.level.max(initial=0) + 1)]
        self.size = [np.zeros(n, np.int64) for _ in self.links]
        order = rng.permutation(n)
        self.top, done = None, 0
        while done < n:
            batch = order[done:done + max(1, min(64, done))]
            self._insert(batch)
            done += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        if self.top is None:
            self.top = int(batch[0])
            return
        queries, top = self.x[batch], self.level[self.top]
        entry = np.full((len(batch), 1), self.top, np.int32)
        near = queries @ queries.T
        np.fill_diagonal(near, -np.inf)
        for layer in range(max(top, self.level[batch].max()), -1, -1):
            mine = self.level[batch] >= layer
            if layer <= top:
                ids, sims = self.search(queries, entry, BUILD_BEAM if mine.any() else 1, layer)
                entry = ids[:, :1].copy()
            else:
                ids, sims = np.full((len(batch), 0), -1, np.int32), np.zeros((len(batch), 0), np.float32)
            rows = np.flatnonzero(mine)
            if not len(rows):
                continue
            # The batch doesn't see itself in the graph; add its own nodes by force.
            own = np.where(mine[None, :], near[rows], -np.inf)
            ids = np.concatenate((ids[rows], np.broadcast_to(batch, own.shape)), axis=1).astype(np.int32)
            sims = np.concatenate((sims[rows], own), axis=1)
            picked = self._diverse(ids, sims, DEGREE)
            for node, found in zip(batch[rows], picked, strict=True):
                found = found[found >= 0]
                have = self.links[layer][node, :self.size[layer][node]]
                fresh = found[~np.isin(found, have)]
                self._add(layer, node, fresh)
                for other in fresh:
                    if not (self.links[layer][other, :self.size[layer][other]] == node).any():
                        self._add(layer, int(other), np.array([node], np.int32))
        best = batch[np.argmax(self.level[batch])]
        if self.level[best] > top:
            self.top = int(best)

    def _add(self, layer: int, node: int, found: np.ndarray) -> None:
        links, size = self.links[layer], self.size[layer]
        if size[node] + len(found) > links.shape[1]:
            ids = np.concatenate((links[node, :size[node]], found))
            kept = self._diverse(ids[None, :], (self.x[ids] @ self.x[node])[None, :], DEGREE * 2)[0]
            links[node] = -1
            links[node, :len(kept)] = kept
            size[node] = (kept >= 0).sum()
        else:
            links[node, size[node]:size[node] + len(found)] = found
            size[node] += len(found)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` neighbours a row: those nearer to it than to any neighbour picked
        before, then the nearest of the rest."""
        order = np.argsort(-sims, axis=1)[:, :BUILD_BEAM + 64]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = (ids >= 0) & np.isfinite(sims)
        x = self.x[np.where(valid, ids, 0)]
        between = x @ x.transpose(0, 2, 1)
        nearest = np.full(ids.shape, -np.inf, np.float32)
        rows, width = ids.shape
        picked, count = np.zeros(ids.shape, bool), np.zeros(rows, int)
        for j in range(width):
            take = valid[:, j] & (sims[:, j] > nearest[:, j]) & (count < most)
            picked[:, j] = take
            count += take
            nearest = np.where(take[:, None], np.maximum(nearest, between[:, :, j]), nearest)
        rest = valid & ~picked
        spare = np.cumsum(rest, axis=1) + count[:, None]
        picked |= rest & (spare <= most)
        out = np.full((rows, most), -1, np.int32)
        r, c = np.nonzero(picked)
        out[r, (np.cumsum(picked, axis=1) - 1)[r, c]] = ids[r, c]
        return out

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Best `beam` nodes of a layer for each query (ids, similarities; descending)."""
        m, n = len(queries), len(self.x)
        seen = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1, np.int32)
        sims = np.full((m, beam), -np.inf, np.float32)
        spread = np.zeros((m, beam), bool)
        ids[:, 0] = entry[:, 0]
        sims[:, 0] = np.einsum("ij,ij->i", self.x[ids[:, 0]], queries)
        seen[np.arange(m), ids[:, 0]] = True
        at_once = max(1, beam // 32)
        active = np.arange(m)
        while len(active):
            open_sims = np.where(spread[active] | (ids[active] < 0), -np.inf, sims[active])
            best = np.argpartition(-open_sims, min(at_once, beam) - 1, axis=1)[:, :at_once]
            chosen = np.isfinite(np.take_along_axis(open_sims, best, 1))
            some = chosen.any(axis=1)
            active, best, chosen = active[some], best[some], chosen[some]
            if not len(active):
                break
            at = active[:, None]
            spread[at, best] |= chosen
            from_ = np.where(chosen, ids[at, best], 0)
            reach = np.where(chosen[:, :, None], self.links[layer][from_], -1).reshape(len(active), -1)
            if at_once > 1:  # two nodes may lead to the same one
                reach = np.sort(reach, axis=1)
                reach[:, 1:][reach[:, 1:] == reach[:, :-1]] = -1
            fresh = (reach >= 0) & ~seen[at, reach]
            width = int(fresh.sum(axis=1).max(initial=0))
            if not width:
                continue
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            reach, fresh = np.take_along_axis(reach, order, 1), np.take_along_axis(fresh, order, 1)
            r, c = np.nonzero(fresh)
            seen[active[r], reach[r, c]] = True
            got = np.full(reach.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("ij,ij->i", self.x[reach[r, c]], queries[active[r]])
            all_ids = np.concatenate((ids[active], np.where(fresh, reach, -1)), axis=1)
            all_sims = np.concatenate((sims[active], got), axis=1)
            all_spread = np.concatenate((spread[active], ~fresh), axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            spread[active] = np.take_along_axis(all_spread, keep, 1)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def beams(self, queries: np.ndarray, beam: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Best `beam` nodes of the whole graph, for some queries at a time."""
        step = max(1, min(256, 20_000_000 // len(self.x), 2_000_000 // beam))
        for i in range(0, len(queries), step):
            part = slice(i, i + step)
            entry = np.full((len(queries[part]), 1), self.top, np.int32)
            for layer in range(self.level[self.top], 0, -1):
                entry = self.search(queries[part], entry, 1, layer)[0]
            yield part, *self.search(queries[part], entry, beam, 0)

    def within(self, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of similarities at or above a threshold; a beam that is full of
        them is widened."""
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        n, todo = len(self.x), np.arange(len(queries))
        while len(todo):
            beam = min(beam, n)
            again = [np.zeros(0, np.int64)]
            for part, ids, sims in self.beams(queries[todo], beam):
                rows = todo[part]
                full = (sims[:, -1] >= threshold) & (beam < n)
                again.append(rows[full])
                r, c = np.nonzero((sims >= threshold) & (ids >= 0) & ~full[:, None])
                found.append((rows[r], ids[r, c]))
            todo, beam = np.concatenate(again), beam * 4
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compared(queries: np.ndarray, x: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) links by brute force."""
    found = [np.nonzero(queries[i:i + 256] @ x.T >= low) for i in range(0, len(queries), 256)]
    return (np.concatenate([r + 256 * i for i, (r, _) in enumerate(found)] or [np.zeros(0, np.int64)]),
            np.concatenate([c for _, c in found] or [np.zeros(0, np.int64)]))


def _verified(q: np.ndarray, node: np.ndarray, exact: np.ndarray, exact_queries: np.ndarray, threshold: float) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", exact_queries[q[i:i + 100_000]], exact[node[i:i + 100_000]]) >= threshold
                           for i in range(0, len(q), 100_000)] or [np.zeros(0, bool)])


@dataclass
class Audit:
    """What the widening of beams ended with: the beam, the share of nearest neighbours of
    audited queries and of their links that it found, and whether no beam was enough."""

    beam: int
    recall: float
    link_recall: float
    exact: bool


def links(graph: Graph, queries: np.ndarray, exact: np.ndarray, exact_queries: np.ndarray, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray, Audit]:
    """Verified (query, node) links; `same` says that the queries are the graph's own
    nodes.  Beams are widened until the audit passes.  If it fails even with beams as wide
    as the graph, which then has nodes that no path leads to, all is compared, and the
    audit says so."""
    low, n = threshold - _SLACK, len(graph.x)
    picked = np.sort(np.random.default_rng(1).permutation(len(queries))[:AUDIT_QUERIES])
    near = queries[picked] @ graph.x.T
    if same:
        near[np.arange(len(picked)), picked] = -np.inf
    k = min(AUDIT_NEIGHBOURS, n - same)
    kth = np.partition(near, n - k, axis=1)[:, n - k] - 1e-6 if k and len(picked) else np.zeros(len(picked))
    linked = (near >= low).sum()
    audit, beam = Audit(0, 0.0, 0.0, False), FIRST_BEAM
    while True:
        beam = min(beam, n)
        hits = told = 0
        for part, ids, sims in graph.beams(queries[picked], beam):
            others = (ids >= 0) & ((ids != picked[part][:, None]) | (not same))
            hits += np.minimum((others & (sims >= kth[part][:, None])).sum(axis=1), k).sum()
        found_q, found = graph.within(queries[picked], low, beam)
        told = ((found != picked[found_q]) | (not same)).sum()
        audit = Audit(beam, float(hits / max(1, k * len(picked))) if k else 1.0, float(told / linked) if linked else 1.0, False)
        if audit.recall >= AUDIT_RECALL and audit.link_recall >= AUDIT_LINK_RECALL:
            q, node = graph.within(queries, low, beam)
            break
        if beam >= n:
            audit.exact = True
            q, node = _compared(queries, graph.x, low)
            break
        beam *= 2
    keep = _verified(q, node, exact, exact_queries, threshold)
    return q[keep].astype(np.int64), node[keep].astype(np.int64), audit


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors link at a cosine of `threshold` or more within one label.  A vector that is
    null, zero or has null or non-finite components, a null label, or a null vec_id links
    with nothing: n_links 0, its own vec_id as component.  Vectors of different length
    don't compare.  Rows with equal vectors link, also if they repeat a vec_id.  Other
    columns are ignored."""
    return _told(*_searched(vectors, threshold))


def audits(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per pair of shards: kind (label and dimensions), low, high, beam, recall of
    nearest neighbours, link_recall, and exact where no beam was enough."""
    return _searched(vectors, threshold)[2].where("beam IS NOT NULL").select("kind", "low", "high", "beam", "recall", "link_recall", "exact")


def _searched(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their keys, nodes, and what tasks answer: links of nodes and audits."""
    wide = F.col("embedding").cast("array<double>")
    finite = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists(wide, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), wide.alias("v"), usable.alias("usable"),
                          F.xxhash64("embedding").alias("h1"), F.xxhash64(F.reverse("embedding"), F.size("embedding")).alias("h2"))
    same = rows.where("usable").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = saved(same.withColumn("kind", F.concat_ws(":", "label", F.size("v").cast("string"))), "hnsw-nodes")
    need = F.greatest(F.count("*") / SHARD_ROWS, F.sum(8 * F.size("v")) / SHARD_BYTES)
    shards = nodes.groupBy("kind").agg(F.ceil(need).cast("int").alias("shards"))
    dealt = nodes.join(shards, "kind").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["node"]), kind="stable")
        table = table.take(pa.array(order))
        exact = np.asarray(table["v"].combine_chunks().flatten()).reshape(len(table), -1)
        exact = exact / np.abs(exact).max(axis=1, keepdims=True)
        exact = exact / np.linalg.norm(exact, axis=1, keepdims=True)
        graph = Graph(exact)
        data = pickle.dumps((np.asarray(table["node"]), np.asarray(table["copies"]), exact, graph), protocol=5)
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([table["shards"][0].as_py()], pa.int32()),
                         pa.array([data], pa.binary())], ["kind", "shard", "shards", "data"])

    graphs = saved(dealt.select("kind", "shard", "shards", "node", "copies", "v").groupBy("kind", "shard").applyInArrow(
        build, "kind string, shard int, shards int, data binary"), "hnsw-graphs")
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.struct(
        F.least(o, F.col("shard")).alias("low"), F.greatest(o, F.col("shard")).alias("high"))))
    pairs = graphs.select("kind", "shard", "data", meets.alias("pair")).select("kind", "pair.low", "pair.high", "shard", "data")

    def query(key: tuple, table: pa.Table) -> pa.Table:
        # Written and read by this operator's own tasks alone, in the shared folder.
        sides = {s: pickle.loads(d) for s, d in zip(table["shard"].to_pylist(), table["data"].to_pylist(), strict=True)}
        low, high = key[1].as_py(), key[2].as_py()
        ids, copies, exact, graph = sides[low]
        q_ids, q_copies, q_exact, q_graph = sides[high]
        q, node, audit = links(graph, q_graph.x, exact, q_exact, threshold, low == high)
        # A link found from one end holds for both.
        if low == high:
            apart = q != node
            code = np.unique(np.minimum(q, node)[apart] * len(ids) + np.maximum(q, node)[apart])
        else:
            back, mine, other = links(q_graph, graph.x, q_exact, exact, threshold)
            code = np.unique(np.concatenate((q, mine)) * len(ids) + np.concatenate((node, back)))
            audit = Audit(max(audit.beam, other.beam), min(audit.recall, other.recall), min(audit.link_recall, other.link_recall), audit.exact or other.exact)
        q, node = code // max(1, len(ids)), code % max(1, len(ids))
        every = np.unique(np.concatenate((ids, q_ids)))
        a, b = np.searchsorted(every, q_ids[q]), np.searchsorted(every, ids[node])
        count, root = np.zeros(len(every), np.int64), np.arange(len(every))
        np.add.at(count, a, copies[node])
        np.add.at(count, b, q_copies[q])
        union(root, a, b)
        told = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
        rows, none = len(told), [None] * len(told)
        links_ = [[*every[told].tolist(), None], [*count[told].tolist(), None], [*every[root[told]].tolist(), None]]
        about = [[*none, audit.beam], [*none, audit.recall], [*none, audit.link_recall], [*none, audit.exact]]
        keys = [[k.as_py()] * (rows + 1) for k in key]
        return pa.table(dict(zip(_FOUND_NAMES, keys + links_ + about, strict=True)), schema=_FOUND)

    form = "kind string, low int, high int, node long, n long, root long, beam int, recall double, link_recall double, exact boolean"
    return rows, nodes, saved(pairs.groupBy("kind", "low", "high").applyInArrow(query, form), "hnsw-links")


_FOUND = pa.schema([("kind", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64()),
                    ("beam", pa.int32()), ("recall", pa.float64()), ("link_recall", pa.float64()), ("exact", pa.bool_())])
_FOUND_NAMES = _FOUND.names


def _told(rows: DataFrame, nodes: DataFrame, searched: DataFrame) -> DataFrame:
    found = searched.where("node IS NOT NULL")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "hnsw-stars")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = (nodes.select("label", "h1", "h2", "node", "copies").join(counts, "node", "left").join(roots, "node", "left")
             .select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    good = rows.where("usable").select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"]).select("vec_id", "n_links", F.col("root").alias("component_id"))
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
