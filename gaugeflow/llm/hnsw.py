"""Embedding near-dedup over hierarchical navigable small-world graphs.

Equal vectors of a label form one class. A label's classes are dealt out to shards by hash; each shard builds its
own graph. The classes of a label query every shard, shard against shard in one task each. A beam that comes back
full of links is widened for its query, and a shard's beam is widened until audited queries (``AUDIT_EVERY``)
find what an exact scan finds; a beam that would hold much of the shard is an exact scan. Found pairs are verified
by cosine in double precision. A task passes on numbers of links and a spanning forest, never its pairs;
components follow.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label, are
rows of their own without links; only vectors of equal length are compared; rows without id take part but
never name a component (alone they have none); repeated rows are copies and count as links of one another; a column
named like a result column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugeflow.functions.sizes import broadcast_if_few
from gaugeflow.llm.common import stored
from gaugeflow.llm.components import connected_components, contracted

LEAST_COSINE = 0.93
SHARD_ROWS = 8_192
#: Links per node above the ground level, and on it.
LINKS, GROUND_LINKS = 12, 24
BUILD_BEAM, FIRST_BEAM = 48, 32
BATCH = 256
EXPAND = 4
AUDIT_EVERY = 50
WANTED_RECALL = 0.98
#: Single precision finds candidates; these are looked at in double precision.
SLACK = 1e-3


class Level:
    """One level: nodes (rows of the index) and a table of links, -1 where there is none."""

    def __init__(self, size: int, links: int):
        self.links = np.full((size, links), -1, dtype=np.int32)
        self.strength = np.full((size, links), -np.inf, dtype=np.float32)

    @classmethod
    def from_links(cls, links: np.ndarray) -> Level:
        level = cls.__new__(cls)
        level.links = links
        return level

    def connect(self, nodes: np.ndarray, others: np.ndarray, sims: np.ndarray) -> None:
        """Add links; every node keeps its strongest."""
        touched = np.unique(nodes)
        width = self.links.shape[1]
        held = self.links[touched]
        a = np.concatenate([np.repeat(touched, width), nodes])
        b = np.concatenate([held.ravel(), others])
        s = np.concatenate([self.strength[touched].ravel(), sims])
        real = b >= 0
        a, b, s = a[real], b[real], s[real]
        order = np.lexsort((b, a))
        a, b, s = a[order], b[order], s[order]
        once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
        a, b, s = a[once], b[once], s[once]
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, int)
        rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        keep = rank < width
        self.links[touched], self.strength[touched] = -1, -np.inf
        self.links[a[keep], rank[keep]] = b[keep]
        self.strength[a[keep], rank[keep]] = s[keep]


class Graph:
    """Small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        norms = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
        self.units = vectors.astype(np.float64) / norms
        self.points = self.units.astype(np.float32)
        n = len(vectors)
        draw = np.random.default_rng(seed)
        self.top = np.minimum((-np.log(1 - draw.random(n)) / np.log(LINKS)).astype(int), 6)
        order = np.lexsort((draw.random(n), -self.top))  # the highest nodes first: entries exist from the start
        self.levels = [Level(n, GROUND_LINKS if k == 0 else LINKS) for k in range(int(self.top.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        self.build(order)

    def parts(self) -> tuple:
        """Plain arrays of what a search needs."""
        return self.units, [level.links for level in self.levels], self.entry

    @classmethod
    def from_parts(cls, units: np.ndarray, links: list[np.ndarray], entry: int) -> Graph:
        graph = cls.__new__(cls)
        graph.units, graph.points, graph.entry = units, units.astype(np.float32), entry
        graph.levels = [Level.from_links(x) for x in links]
        return graph

    def build(self, order: np.ndarray) -> None:
        done = 0
        while done < len(order):
            size = min(BATCH, max(16, done))
            batch = order[done : done + size]
            inner = self.points[batch] @ self.points[batch].T
            np.fill_diagonal(inner, -np.inf)
            entries = np.full((len(batch), 1), self.entry)
            for k in range(len(self.levels) - 1, -1, -1):
                here = np.flatnonzero(self.top[batch] >= k)
                if done:
                    beam = BUILD_BEAM if len(here) else 1
                    ids, _ = self.beam(self.points[batch], entries, k, beam)
                    entries = np.where(ids[:, :1] >= 0, ids[:, :1], entries)
                else:
                    ids = np.full((len(batch), 1), -1)
                if not len(here):
                    continue
                own = np.where(np.isin(np.arange(len(batch)), here), 0, -np.inf)[None, :] + inner[here]
                near = np.argsort(-own, axis=1)[:, :LINKS]
                fellows = np.where(np.isfinite(np.take_along_axis(own, near, 1)), batch[near], -1)
                self.attach(batch[here], np.concatenate([ids[here], fellows], axis=1), self.levels[k])
            done += len(batch)

    def attach(self, nodes: np.ndarray, candidates: np.ndarray, level: Level) -> None:
        """Link nodes to candidates that are nearer to them than to a candidate chosen before, both ways."""
        sims = np.einsum("bd,bkd->bk", self.points[nodes], self.points[candidates])
        sims = np.where((candidates >= 0) & (candidates != nodes[:, None]), sims, -np.inf)
        order = np.argsort(-sims, axis=1)[:, :BUILD_BEAM]
        candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        points = self.points[candidates]
        among = np.matmul(points, points.transpose(0, 2, 1))
        chosen = np.zeros(candidates.shape, dtype=bool)
        for r in range(candidates.shape[1]):
            shadowed = (chosen & (among[:, r] > sims[:, r, None])).any(axis=1)
            chosen[:, r] = np.isfinite(sims[:, r]) & ~shadowed & (chosen.sum(axis=1) < LINKS)
        spare = np.isfinite(sims) & ~chosen  # the nearest others fill up
        room = LINKS - chosen.sum(axis=1)
        chosen |= spare & (np.cumsum(spare, axis=1) <= room[:, None])
        rows, at = np.nonzero(chosen)
        a, b, s = nodes[rows], candidates[rows, at], sims[rows, at]
        level.connect(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]))

    def beam(self, queries: np.ndarray, entries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes near the queries on level ``k`` with similarities, best first; -1 where there are fewer."""
        n, rows = len(self.points), np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), n + 1), dtype=bool)
        seen[:, n] = True  # stands for a missing link
        ids = np.full((len(queries), width), n, dtype=np.int64)
        sims = np.full((len(queries), width), -np.inf, dtype=np.float32)
        ids[:, 0] = entries[:, 0]
        sims[:, 0] = np.einsum("bd,bd->b", queries, self.points[entries[:, 0]])
        seen[rows[:, 0], entries[:, 0]] = True
        open_ = np.isfinite(sims)
        links, step = self.levels[k].links, min(EXPAND, width)
        active = np.arange(len(queries))
        while len(active):
            rank = np.where(open_[active], sims[active], -np.inf)
            best = np.argpartition(-rank, step - 1, axis=1)[:, :step] if step < width else np.arange(width)[None, :].repeat(len(active), 0)
            usable = np.isfinite(np.take_along_axis(rank, best, 1))
            nodes = np.where(usable, ids[active[:, None], best], n)
            open_[active[:, None], best] = False
            near = np.where(nodes[:, :, None] < n, links[np.minimum(nodes, n - 1)], -1).reshape(len(active), -1).astype(np.int64)
            near = np.sort(np.where(near >= 0, near, n), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[seen[active[:, None], near]] = n
            seen[active[:, None], near] = True
            new = np.einsum("bd,bkd->bk", queries[active], self.points[np.minimum(near, n - 1)])
            new = np.where(near < n, new, -np.inf)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], new], axis=1)
            all_open = np.concatenate([open_[active], near < n], axis=1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active] = np.take_along_axis(all_ids, top, 1)
            sims[active] = np.take_along_axis(all_sims, top, 1)
            open_[active] = np.take_along_axis(all_open, top, 1)
            active = active[open_[active].any(axis=1)]
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(ids < n, ids, -1), sims

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.full((len(queries), 1), self.entry)
        for k in range(len(self.levels) - 1, 0, -1):
            entries = self.beam(queries, entries, k, 1)[0]
        return self.beam(queries, entries, 0, width)

    def near(self, units: np.ndarray, width: int, least: float):
        """Blocks ``(query rows, index rows)`` of the pairs with a cosine of at least ``least`` that are found."""
        points = units.astype(np.float32)
        waiting = [(np.arange(at, min(at + BATCH, len(units))), width) for at in range(0, len(units), BATCH)]
        while waiting:
            rows, width = waiting.pop()
            if width * 8 > len(self.points):
                found = points[rows] @ self.points.T >= least - SLACK
                q, i = np.nonzero(found)
            else:
                ids, sims = self.search(points[rows], width)
                hit = (ids >= 0) & (sims >= least - SLACK)
                full = hit.all(axis=1)
                if full.any():
                    waiting.append((rows[full], width * 4))
                hit[full] = False
                q, at = np.nonzero(hit)
                i = ids[q, at]
            q = rows[q]
            sure = np.einsum("pd,pd->p", units[q], self.units[i]) >= least
            yield q[sure], i[sure]

    def audited_beam(self, sample: np.ndarray, least: float, wanted: float = WANTED_RECALL) -> int:
        """Narrowest tried beam that finds the links and nearest others of sampled rows."""
        width = FIRST_BEAM
        if not len(sample):
            return width
        exact = self.points[sample] @ self.points.T
        exact[np.arange(len(sample)), sample] = -np.inf
        nearest = exact.max(axis=1, keepdims=True)
        expected = (exact >= least) | ((exact == nearest) & np.isfinite(nearest))
        while width * 8 <= len(self.points):
            right = 0
            for at in range(0, len(sample), BATCH):
                ids, sims = self.search(self.points[sample[at : at + BATCH]], width)
                part = expected[at : at + BATCH]
                hits = np.take_along_axis(part, np.maximum(ids, 0), 1) & (ids >= 0)
                full = (sims >= least).all(axis=1)  # such a beam is widened anyway
                right += np.where(full, part.sum(axis=1), hits.sum(axis=1)).sum()
            if right >= wanted * expected.sum():
                break
            width *= 2
        return width


def usable(vector: str, label: str):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("class_id").reset_index(drop=True)
    graph = Graph(np.stack(rows["vector"].to_numpy()))
    sample = np.flatnonzero(rows["class_id"].to_numpy() % AUDIT_EVERY == 0)
    width = graph.audited_beam(sample, LEAST_COSINE)
    body = pickle.dumps((graph.parts(), rows["class_id"].to_numpy(), rows["copies"].to_numpy(), width))
    return pd.DataFrame({"kind": [rows["kind"].iat[0]], "shard": [rows["shard"].iat[0]], "shards": [rows["shards"].iat[0]], "graph": [body]})


def _search(least: float):
    def search(graphs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
        if graphs.empty or rows.empty:
            return empty
        parts, index_ids, index_copies, width = pickle.loads(graphs["graph"].iat[0])
        graph = Graph.from_parts(*parts)
        rows = rows.sort_values("class_id").reset_index(drop=True)
        ids, copies = rows["class_id"].to_numpy(), rows["copies"].to_numpy()
        vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        own = graphs["shard"].iat[0] == rows["shard"].iat[0]
        asked, answered = np.zeros(len(ids)), np.zeros(len(index_ids))
        forest = []
        for q, i in graph.near(units, width, least):
            other = ids[q] != index_ids[i]
            q, i = q[other], i[other]
            asked += np.bincount(q, weights=index_copies[i], minlength=len(ids))
            answered += np.bincount(i, weights=copies[q], minlength=len(index_ids))
            if len(q):
                forest.append(contracted(ids[q], index_ids[i]))
        parts = [(ids, ids, asked)] if own else [(ids, ids, asked), (index_ids, index_ids, answered)]
        if forest:
            a, b = contracted(np.concatenate([f[0] for f in forest]), np.concatenate([f[1] for f in forest]))
            parts.append((a, b, np.zeros(len(a))))
        out = pd.DataFrame({"a": np.concatenate([p[0] for p in parts]), "b": np.concatenate([p[1] for p in parts]), "n": np.concatenate([p[2] for p in parts]).astype(np.int64)})
        return out[(out["n"] > 0) | (out["a"] != out["b"])]

    return search


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", keep: list[str] | None = None, least: float = LEAST_COSINE, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``keep`` (the id by default) with ``n_links``, ``component_id`` and ``kept``."""
    new = ("n_links", "component_id", "kept")
    kept = [c for c in ([id_col] if keep is None else keep) if c not in new]
    rows = vectors.select(F.struct(*kept).alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable("vector", "label"))
    marked = rows.select(
        "row", "vec_id", "ok", "vector",
        F.when(F.col("ok"), F.struct(F.col("label").cast("string").alias("label"), F.size("vector").alias("size"))).alias("kind"),
        F.when(F.col("ok"), F.struct(F.xxhash64("vector").alias("x"), F.hash("vector").alias("y"))).alias("key"),
    )
    good = marked.filter("ok")
    classes = good.groupBy("kind", "key").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("class_id", F.monotonically_increasing_id()), "hnsw-classes")
    sizes = classes.groupBy(F.col("kind").alias("of")).agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("shards"))
    dealt = classes.join(broadcast_if_few(sizes), F.col("kind") == F.col("of"))
    dealt = dealt.select("kind", "class_id", "copies", "vector", "shards", F.pmod(F.xxhash64("class_id"), "shards").alias("shard"))

    kind = classes.schema["kind"].dataType.simpleString()
    graphs = stored(dealt.groupBy("kind", "shard").applyInPandas(_build, f"kind {kind}, shard long, shards long, graph binary"), "hnsw-graphs")
    # shard against shard, each pair of shards once
    asked = graphs.withColumn("asking", F.explode(F.sequence("shard", F.col("shards") - 1)))
    asking = dealt.withColumnRenamed("shard", "asking").withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), "asking")))
    asking = asking.withColumn("shard", F.col("asking"))
    found = asked.groupBy("kind", "shard", "asking").cogroup(asking.groupBy("kind", "asked", "asking")).applyInPandas(_search(least), "a long, b long, n long")
    found = stored(found, "hnsw-links")

    links = found.filter(F.col("a") == F.col("b")).groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("other_links"))
    roots = connected_components(found.filter(F.col("a") != F.col("b")).select("a", "b")).withColumnsRenamed({"id": "class_id", "component": "root"})
    rooted = classes.select("kind", "key", "class_id", "copies", "low_id").join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    lowest = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = rooted.join(lowest, "root").join(links, "class_id", "left").select("kind", "key", "copies", "component_id", F.coalesce("other_links", F.lit(0)).alias("other_links"))
    linked = good.select("row", "vec_id", "kind", "key").join(named, ["kind", "key"]).select("row", "vec_id", (F.col("other_links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = marked.filter(~F.col("ok")).select("row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
