"""Approximate nearest neighbours by inner product over robust-pruned directed graphs, one a shard.

Different vectors are dealt over shards by their hash.  A shard's graph is built by inserting points in batches: a
greedy search over the graph so far proposes neighbours, and robust pruning keeps those that no kept neighbour is
nearer to by the factor ALPHA, which leaves diverse edges; reverse edges are added and pruned alike.  Every query
then runs a beam search over every shard, and the shards' best are merged.  The graph is built by angle (vectors scaled
to length one), where pruning has a distance to work with; queries walk it by inner product with the vectors as long
as they are.

A search begins at the ENTRIES nearest of the shard's landmarks, PIVOTS times the square root of its points, which the
build draws at random: tight clusters that few edges join are so reached from within.  Beam, entries and degree are
the same for shards of all sizes.

A shard's task takes first its vectors, then the queries in blocks, so it holds one shard and one block at a time.
Graphs are searched in single precision; the score of what they find is computed from the vectors as they are stored, in double precision.

A shard holds SHARD_ROWS points on average at most, and tables of every size have SHARDS shards at least: recall falls as a shard grows, and dealing by hash keeps
shards of 8,000 below 10,000, where recall is measured (README).  Every query visits every shard, so the rows dealt are
queries times shards: with a twentieth of n vectors as queries n * n / 160,000 rows, 6 million for a million vectors.
Larger shards send fewer rows but need a wider beam for the same recall.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; rows of the same id and vector count once; rows of one id are no candidates of that id's queries; of equal
vectors the smallest ids come first, as many as can be among the nearest, so a very common vector costs one point;
equal scores are ordered by id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.common import written

#: Most out-edges, beam while building and while searching, pruning factor, points expanded a step.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, STEP = 32, 64, 256, 1.2, 4
#: Vectors a shard holds on average at most, least shards (they are built and searched side by side), points inserted and queries searched together.
SHARD_ROWS, SHARDS, BATCH = 8000, 8, 512
#: Landmarks a square root of the points, and how many of the nearest begin a search.
PIVOTS, ENTRIES = 4, 16


class Graph:
    """A robust-pruned directed graph over the rows of x (float32, none of them zero)."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = x
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        n = len(x)
        self.edges = np.full((n, DEGREE), -1, np.int32)
        order = np.random.default_rng(seed).permutation(n)
        first = int(np.argmax(self.unit @ self.unit.mean(axis=0)))
        order = np.concatenate([[first], order[order != first]])
        marks = order[: int(PIVOTS * np.sqrt(n))]
        done = 1
        while done < n:  # a batch is no larger than what the graph holds already
            batch = order[done : done + min(BATCH, done)]
            self._insert(batch, marks[:done])
            done += len(batch)
        self.marks = marks

    def search(self, q: np.ndarray, beam: int, marks: np.ndarray | None = None, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam's ids, largest inner product with x (the vectors) first, and their negative inner products (-1 and inf past the end)."""
        b, n = len(q), len(self.x)
        marks, x = self.marks if marks is None else marks, self.x if x is None else x
        rows = np.arange(b)[:, None]
        away = -(q @ x[marks].T)
        k = min(ENTRIES, len(marks), beam)
        begin = np.argpartition(away, k - 1, axis=1)[:, :k]
        seen = np.zeros((b, n + 1), bool)  # the last column stands for no edge
        seen[:, n] = True
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        fresh = np.zeros((b, beam), bool)
        ids[:, :k], dist[:, :k] = marks[begin], away[rows, begin]
        fresh[:, :k] = True
        seen[rows, ids[:, :k]] = True
        while fresh.any():
            pick = np.argsort(np.where(fresh, dist, np.inf), axis=1, kind="stable")[:, :STEP]
            open_ = fresh[rows, pick]
            fresh[rows, pick] = False
            near = np.where(open_[:, :, None], self.edges[ids[rows, pick]], -1).reshape(b, -1).astype(np.int64)
            near[near < 0] = n
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[seen[rows, near]] = n
            seen[rows, near] = True
            some = near < n
            keep = int(some.sum(axis=1).max(initial=0))
            if not keep:
                continue
            near = np.sort(near, axis=1)[:, :keep]  # n, for none, sorts last
            some = near < n
            d = np.where(some, -np.einsum("bkd,bd->bk", x[np.where(some, near, 0)], q), np.inf)
            all_d = np.concatenate([dist, d], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids = np.concatenate([ids, np.where(some, near, -1)], axis=1)[rows, best]
            fresh = np.concatenate([fresh, some], axis=1)[rows, best]
            dist = all_d[rows, best]
        return ids, dist

    def _prune(self, p: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """For each point of p up to DEGREE of its candidates (nearest first, -1 for none)."""
        b, c = cand.shape
        v = self.unit[np.maximum(cand, 0)]
        apart = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))  # squared distances
        alive = (cand >= 0) & (cand != p[:, None])
        out, count = np.full((b, DEGREE), -1, np.int32), np.zeros(b, np.int64)
        for k in range(c):
            take = np.nonzero(alive[:, k] & (count < DEGREE))[0]
            out[take, count[take]] = cand[take, k]
            count[take] += 1
            alive[take] &= ALPHA * ALPHA * apart[take, k] > dist[take]
        return out

    def _insert(self, batch: np.ndarray, marks: np.ndarray) -> None:
        cand, dist = self.search(self.unit[batch], BUILD_BEAM, marks, self.unit)
        self.edges[batch] = out = self._prune(batch, cand, 2 + 2 * dist)
        to, which = np.nonzero(out >= 0)
        source, target = batch[to], out[to, which].astype(np.int64)
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        points, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        more = np.full((len(points), width), -1, np.int64)
        more[np.repeat(np.arange(len(points)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for a in range(0, len(points), BATCH):
            p = points[a : a + BATCH]
            c = np.concatenate([self.edges[p].astype(np.int64), more[a : a + BATCH]], axis=1)
            d = np.where(c >= 0, 2 - 2 * np.einsum("bkd,bd->bk", self.unit[np.maximum(c, 0)], self.unit[p]), np.inf)
            order = np.argsort(d, axis=1, kind="stable")[:, : 3 * DEGREE]
            rows = np.arange(len(p))[:, None]
            c, d = c[rows, order], d[rows, order]
            full = (c >= 0).sum(axis=1) > DEGREE
            out = c[:, :DEGREE].astype(np.int32)
            if out.shape[1] < DEGREE:
                out = np.pad(out, ((0, 0), (0, DEGREE - out.shape[1])), constant_values=-1)
            if full.any():
                out[full] = self._prune(p[full], c[full], d[full])
            self.edges[p] = out


def _rows(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _single(x: np.ndarray) -> np.ndarray:
    """In single precision; doubles outside its range are scaled, all by one power of two, which keeps the order."""
    top = float(np.abs(x).max(initial=0))
    if x.dtype == np.float32 or 2.0**-40 < top < 2.0**40:
        return x.astype(np.float32, copy=False)
    return (x / 2.0 ** np.frexp(top)[1]).astype(np.float32)


def _shard_search(k: int):
    """(shard, kind, ids, vector) sorted by shard and kind -> the shard's k best rows a query."""
    names = ["query_id", "query_key", "vec_id", "score"]

    def answers(graph: Graph, x: np.ndarray, ids: list, q: np.ndarray, qids: list, keys: list) -> pa.RecordBatch:
        out: tuple[list, list, list, list] = ([], [], [], [])
        single = _single(q)
        for a in range(0, len(q), BATCH):
            found, _ = graph.search(single[a : a + BATCH], max(SEARCH_BEAM, k + 1))
            score = np.einsum("bkd,bd->bk", x[np.maximum(found, 0)].astype(np.float64), q[a : a + BATCH].astype(np.float64))
            for r, row in enumerate(found):
                own, best = qids[a + r], []
                for j in np.argsort(-np.where(row >= 0, score[r], -np.inf), kind="stable")[: k + 1]:
                    if row[j] >= 0:
                        best += [(-float(score[r, j]), i) for i in ids[row[j]] if i != own]
                for s, i in sorted(best)[:k]:
                    for col, value in zip(out, (own, keys[a + r], i, -s), strict=True):
                        col.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph, x, held, ids = None, None, None, [], []
        for batch in batches:
            shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.nonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0))[0] + 1, [len(shards)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, graph, held, ids = shards[a], None, [], []
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(_rows(part.column(3)))
                    ids += part.column(2).to_pylist()
                elif held:
                    if graph is None:
                        x = np.concatenate(held)
                        graph = Graph(_single(x))
                    yield answers(graph, x, ids, _rows(part.column(3)), [i[0] for i in part.column(2).to_pylist()], part.column(4).to_pylist())

    return run


def usable(embedding: Column) -> Column:
    """Neither null, zero, nor holding null or non-finite components."""
    sound = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(embedding.isNotNull() & sound & F.exists(embedding, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors (vec_id, embedding), is_query on vec_id -> query_id, rank (from 1), vec_id, score of each query's k nearest other rows."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("embedding") == (size["d"] if size else 0))
    # of each different vector the k + 1 smallest ids: one may be the query's own
    first = Window.partitionBy("embedding").orderBy("vec_id")
    ids = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    points = written(ids.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    n = points.count()
    shards = max(SHARDS, -(-n // shard_rows))
    key = F.xxhash64("embedding")
    queries = rows.where(is_query).dropDuplicates(["vec_id", "embedding"])
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.array("vec_id").alias("ids"), "embedding", key.alias("key"))
    held = points.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "ids", "embedding", key.alias("key"))
    dealt = held.union(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind", "key")
    best = dealt.mapInArrow(_shard_search(k), "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
