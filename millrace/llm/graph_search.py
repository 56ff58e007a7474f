"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_blocks, stored
from millrace.llm.vectors import best, matrix, questions, usable

GRAPH = "dim int, shard int, node int, entry boolean, ids array<bigint>, vector array<double>, near array<int>"
FOUND = "query_id bigint, vh bigint, vec_id bigint, score double"


def _squares(points: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its rows: (queries, rows)."""
    gap = points[rows] - queries[:, None, :]
    return np.einsum("qrd,qrd->qr", gap, gap)


class PrunedGraph:
    """A directed graph over points whose edges keep what greedy searches need.

    Points are added in batches. A beam search from the entries, which are sampled points, proposes neighbours; robust
    pruning keeps the nearest one and drops others that lie closer to it than 1/``relax`` of their distance, and
    so on, so that edges go near and far. Backward edges are added, and pruned again where they are too many.
    Pruning may cut the last way to a point: in the end such points get an edge from a near one that is reached.
    """

    def __init__(self, points: np.ndarray, degree: int = 24, beam: int = 64, relax: float = 1.2, entries: int = 256):
        # Distances are compared in single precision about the centre; answers are scored elsewhere.
        scale = np.abs(points).max() or 1.0
        centred = points / scale
        self.points = (centred - centred.mean(axis=0)).astype(np.float32)
        self.degree, self.beam, self.relax = degree, beam, relax ** 2
        self.near = np.full((len(points), degree), -1, dtype=np.int32)
        self.count = min(entries, len(points))
        self.entries = np.zeros(0, dtype=np.int64)

    def build(self, seed: int = 0, batch: int = 256) -> None:
        order = np.random.default_rng(seed).permutation(len(self.points))
        done = 1
        while done < len(order):
            self.entries = order[:min(done, self.count)]
            rows = order[done:done + min(batch, done)]
            found, distance = self.search(self.points[rows], self.beam)
            self.near[rows] = self._prune(rows, found, distance)
            self._link_back(rows)
            done += len(rows)
        self.entries = order[:self.count]
        self._connect()

    def reached(self) -> np.ndarray:
        """Which points a walk from the entries can come to."""
        seen = np.zeros(len(self.points), dtype=bool)
        front = self.entries
        while len(front):
            seen[front] = True
            near = np.unique(self.near[front])
            front = near[near >= 0]
            front = front[~seen[front]]
        return seen

    def _connect(self) -> None:
        """Give points that no walk reaches an edge from their nearest reached point, one a round and point, until all are reached."""
        while not (seen := self.reached()).all():
            inside, outside = np.flatnonzero(seen), np.flatnonzero(~seen)
            closest, away = np.zeros(len(outside), dtype=np.int64), np.zeros(len(outside), dtype=np.float32)
            norms = np.einsum("nd,nd->n", self.points[inside], self.points[inside])
            for low in range(0, len(outside), 256):
                part = self.points[outside[low:low + 256]]
                gap = norms[None, :] - 2 * part @ self.points[inside].T
                closest[low:low + 256] = inside[gap.argmin(axis=1)]
                away[low:low + 256] = gap.min(axis=1) + np.einsum("nd,nd->n", part, part)
            order = np.lexsort((away, closest))
            first = np.flatnonzero(np.append(True, closest[order][1:] != closest[order][:-1]))
            source, target = closest[order][first], outside[order][first]
            slot = (self.near[source] >= 0).sum(axis=1)
            if slot.max() == self.near.shape[1]:
                self.near = np.concatenate([self.near, np.full((len(self.near), 1), -1, dtype=np.int32)], axis=1)
            self.near[source, slot] = target

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, squared distances), nearest first, -1 where a beam holds fewer, for all queries at once."""
        count = len(queries)
        rows = np.full((count, beam), -1, dtype=np.int32)
        distance = np.full((count, beam), np.inf, dtype=np.float32)
        open_ = np.zeros((count, beam), dtype=bool)
        seen = np.zeros((count, len(self.points)), dtype=bool)
        start = np.broadcast_to(self.entries.astype(np.int32), (count, len(self.entries)))
        away = _squares(self.points, start, queries)
        nearest_first = np.argsort(away, axis=1, kind="stable")[:, :beam]
        size = nearest_first.shape[1]
        rows[:, :size] = np.take_along_axis(start, nearest_first, axis=1)
        distance[:, :size] = np.take_along_axis(away, nearest_first, axis=1)
        open_[:, :size], seen[:, self.entries] = True, True
        active = np.arange(count)
        while len(active):
            first = np.argmax(open_[active], axis=1)  # beams are sorted
            open_[active, first] = False
            near = self.near[rows[active, first]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[np.broadcast_to(active[:, None], near.shape)[fresh], near[fresh]] = True
            away = np.where(fresh, _squares(self.points, near, queries[active]), np.float32(np.inf))
            joined = np.concatenate([distance[active], away], axis=1)
            keep = np.argsort(joined, axis=1, kind="stable")[:, :beam]
            distance[active] = np.take_along_axis(joined, keep, axis=1)
            rows[active] = np.take_along_axis(np.concatenate([rows[active], np.where(fresh, near, -1)], axis=1), keep, axis=1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], axis=1), keep, axis=1)
            active = active[open_[active].any(axis=1)]
        return rows, distance

    def _prune(self, rows: np.ndarray, found: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Diverse neighbours out of candidates sorted by distance."""
        alive = (found >= 0) & (found != rows[:, None]) & np.isfinite(distance)
        points = self.points[np.maximum(found, 0)]
        out = np.full((len(rows), self.degree), -1, dtype=np.int32)
        size = np.zeros(len(rows), dtype=np.int64)
        for i in range(found.shape[1]):
            pick = np.flatnonzero(alive[:, i] & (size < self.degree))
            if not len(pick):
                continue
            out[pick, size[pick]] = found[pick, i]
            size[pick] += 1
            gap = points[pick] - points[pick, i][:, None, :]
            between = np.einsum("pcd,pcd->pc", gap, gap)
            alive[pick] &= self.relax * between > distance[pick]
        return out

    def _link_back(self, rows: np.ndarray) -> None:
        source = np.repeat(rows, self.degree)
        target = self.near[rows].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        cuts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        crowded, lists = [], []
        for begin, end in zip(cuts, [*cuts[1:], len(target)]):
            node = target[begin]
            have = self.near[node]
            have = have[have >= 0]
            more = source[begin:end][~np.isin(source[begin:end], have)]
            if len(have) + len(more) <= self.degree:
                self.near[node, len(have):len(have) + len(more)] = more
            else:
                crowded.append(node)
                lists.append(np.concatenate([have, more]))
        for low in range(0, len(crowded), 128):
            nodes, part = np.array(crowded[low:low + 128]), lists[low:low + 128]
            padded = np.full((len(part), max(map(len, part))), -1, dtype=np.int32)
            for i, members in enumerate(part):
                padded[i, :len(members)] = members
            away = np.where(padded >= 0, _squares(self.points, padded, self.points[nodes]), np.float32(np.inf))
            order = np.argsort(away, axis=1, kind="stable")
            self.near[nodes] = self._prune(nodes, np.take_along_axis(padded, order, 1), np.take_along_axis(away, order, 1))


def build_graphs(rows: DataFrame, shards: int, *, k: int, degree: int, beam: int, relax: float) -> DataFrame:
    """One row per different vector of a shard: its node, ids (the smallest ``k`` + 1) and out-edges."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def build(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        values = matrix(shard["vector"], np.float64) + 0.0  # one form of zero
        points, node = np.unique(values, axis=0, return_inverse=True)
        graph = PrunedGraph(points, degree, beam, relax)
        graph.build()
        ids = pd.Series(shard["vec_id"].to_numpy()).groupby(node.ravel()).apply(lambda v: np.sort(v.to_numpy())[:k + 1])
        return pd.DataFrame({"dim": key[0], "shard": key[1], "node": np.arange(len(points)),
                             "entry": np.isin(np.arange(len(points)), graph.entries), "ids": ids.to_list(),
                             "vector": list(points), "near": [n[n >= 0] for n in graph.near]})

    # As many tasks as shards: small shards on disk are much work, so they are not merged by their size.
    spread = dealt.repartition(shards, "dim", "shard")
    return stored(spread.groupBy("dim", "shard").applyInPandas(build, GRAPH), "graph")


def nearest(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10,
            every: int = 100, shard_rows: int = 4096, query_rows: int = 1024, degree: int = 24, beam: int = 64,
            search_beam: int = 128, relax: float = 1.2) -> DataFrame:
    """Each query's ``k`` nearest rows, as beam searches of all shards find them.

    Rows are dealt by id into shards; each builds its graph and is stored. Queries (ids divisible by
    ``every``) are dealt into blocks, and each pair of shard and block is a task. A shard's distinct
    vectors are its nodes, with the ids that share one, so a vector that a third of all rows repeat is one
    node per shard. Where a beam reaches fewer than ``k`` rows, the shard is compared in full.

    Returns query_id, rank, vec_id, score (the Euclidean distance in double precision). Vectors that are null,
    zero, without components or an id, or hold a null or non-finite component take no part; vectors of
    different lengths never meet. A repeated row is a candidate as often as it occurs but one query; rows of
    one id with different vectors are queries of their own. An empty table gives no rows.
    """
    rows = stored(usable(vectors, id_column, vector_column, zero=False), "points")
    shards = bounded_blocks(rows.count(), shard_rows)
    graphs = build_graphs(rows, shards, k=k, degree=degree, beam=beam, relax=relax)
    asked = stored(questions(rows, every, F.col("vector")), "graph_queries")
    groups = bounded_blocks(asked.count(), query_rows)
    left = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = (asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "vh"), F.lit(groups)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    keys = ["dim", "shard", "part"]

    def search(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes) and len(asked):
            nodes = nodes.sort_values("node")
            points, ids = matrix(nodes["vector"], np.float64), nodes["ids"].to_list()
            queries = matrix(asked["vector"], np.float64)
            graph = PrunedGraph(points, degree)
            graph.near = np.full((len(points), max(1, max(map(len, nodes["near"])))), -1, dtype=np.int32)
            for i, near in enumerate(nodes["near"]):
                graph.near[i, :len(near)] = near
            graph.entries = np.flatnonzero(nodes["entry"])
            scale = np.abs(points).max() or 1.0
            shifted = (queries / scale - (points / scale).mean(axis=0)).astype(np.float32)
            found, _ = graph.search(shifted, max(search_beam, k + 1))
            for query_id, vh, vector, reached in zip(asked["vec_id"], asked["vh"], queries, found):
                reached = reached[reached >= 0]
                if sum(len(ids[i]) for i in reached) <= k:
                    reached = np.arange(len(points))
                score = np.sqrt(((points[reached] - vector) ** 2).sum(axis=1))
                answers, own = [], False
                for i, s in zip(reached, score):
                    members = list(ids[i])
                    if not own and query_id in members and (points[i] == vector).all():
                        members.remove(query_id)
                        own = True
                    answers += [(s, m) for m in members[:k]]
                out += [(query_id, vh, m, s) for s, m in sorted(answers)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vh", "vec_id", "score"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, FOUND)
    return best(found, k, F.asc("score"))
