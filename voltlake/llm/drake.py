"""Centroid clustering with Drake's adaptive bounds, in exact integers.

A vector keeps its centroid, lower bounds on the distances to its several nearest other centroids, and one remainder
bound for all further ones.  A round first lowers the bounds by how far their centroids moved and takes the distance to
the own centroid anew.  If all bounds are above it the order is certain; if those from some place on are, only the
centroids before that place are compared, exactly; else the vector is rescanned against all.  How many bounds are kept
adapts: after a round no more than any vector needed, an eighth of the centroids at least.

Each round is one pass over the vectors: a task writes their new bounds and, in rows of their own, its sums by centroid,
so the driver sees centroids and sums only (``k`` times the number of components) and a lost executor costs its tasks.

Distances are exact: whole numbers below 2^21 in float64 products are, others are Python integers.  Bounds are rounded
to the safe side, and a bound equal to the distance certifies nothing, so ties go to the smaller number.

Defined results: vectors null, of another length, or with null or non-finite components take no part; components beyond
+-2^62 count as that, and distances and sums above a long as its largest; with fewer vectors than ``k`` each starts a
centroid; equal hashes start in the order of their components; repeated rows and ids count each; null ids hash as the
text '2:'; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.llm.common import drop_written, give_back, written

DIM, K, ROUNDS, SALT = 64, 40, 5, "2:"
MOST = (1 << 63) - 1
#: Whole numbers below this are exact in float64 products of DIM components; the furthest that a component may be.
EXACT, FURTHEST = 1 << 21, 1 << 62
#: Vectors that a task works on at once.
CHUNK = 4096
#: Rows of vectors (n null) and of a task's sums (n, total and needed set).
STATE = "vec_id {id}, embedding array<double>, cluster int, distance long, near array<short>, lower array<float>, rest float, n long, total array<decimal(38,0)>, needed int"
SQUARES = T.DecimalType(38, 0)


def components(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as whole numbers: float64 where all are below EXACT, else Python integers."""
    y = np.floor(256.0 * x)
    if not y.size or np.abs(y).max() < EXACT:
        return y
    whole = [min(max(int(v) * 256 if abs(v) >= 2.0**53 else math.floor(256.0 * v), -FURTHEST), FURTHEST) for v in x.ravel()]
    return np.array(whole, dtype=object).reshape(x.shape)


def _is_exact(a: np.ndarray) -> bool:
    return a.dtype != object


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    if _is_exact(x) and _is_exact(c):
        return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.int64)
    return ((x.astype(object)[:, None, :] - c.astype(object)[None, :, :]) ** 2).sum(2) if len(x) and len(c) else np.empty((len(x), len(c)), dtype=object)


def squares_to(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to the rows of c that ``which`` (rows by places) names."""
    if _is_exact(x) and _is_exact(c):
        d = x[:, None, :] - c[which]
        return np.einsum("ijk,ijk->ij", d, d).astype(np.int64)
    d = x.astype(object)[:, None, :] - c.astype(object)[which]
    return (d * d).sum(2)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-12)


def _down(x: np.ndarray) -> np.ndarray:
    """To float32, never above x."""
    x = np.maximum(x * (1 - 1e-12), 0.0)
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf), dtype=np.float32), y)


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


class Bounds:
    """The vectors of a chunk: own centroid, its squared distance, nearest others with their lower bounds, the remainder's."""

    def __init__(self, n: int, width: int, centres: np.ndarray):
        self.c, self.width = centres, width
        self.own, self.d2 = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64 if _is_exact(centres) else object)
        self.near, self.lower, self.rest = np.zeros((n, width), dtype=np.int64), np.zeros((n, width), dtype=np.float32), np.zeros(n, dtype=np.float32)
        self.needed = 0

    def scan(self, x: np.ndarray, rows: np.ndarray) -> None:
        """All distances of the rows given."""
        if not len(rows):
            return
        d2 = squares(x[rows], self.c)
        order = np.argsort(d2, axis=1, kind="stable")
        d2 = np.take_along_axis(d2, order, 1)
        b = self.width
        self.d2 = self.d2 if self.d2.dtype == d2.dtype else self.d2.astype(object)
        self.own[rows], self.d2[rows] = order[:, 0], d2[:, 0]
        self.near[rows], self.lower[rows] = order[:, 1 : b + 1], _down(_root(d2[:, 1 : b + 1]))
        self.rest[rows] = _down(_root(d2[:, b + 1])) if d2.shape[1] > b + 1 else np.inf

    def move(self, x: np.ndarray, own: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray, moved: np.ndarray) -> None:
        """The bounds of the round before, and how far each centroid moved since (never too little)."""
        b, n = self.width, len(x)
        lower, rest = lower.astype(np.float64), rest.astype(np.float64)
        lower = np.maximum(lower - moved[near], 0.0)
        rest = np.maximum(rest - (moved.max() if len(moved) else 0.0), 0.0)
        if near.shape[1] > b:  # fewer bounds are kept from now on
            rest = np.minimum(rest, lower[:, b:].min(axis=1))
            near, lower = near[:, :b], lower[:, :b]
        d2 = squares_to(x, self.c, own[:, None])[:, 0]
        upper = _up(_root(d2))
        self.own[:], self.near[:], self.lower[:], self.rest[:] = own, near, _down(lower), _down(rest)
        self.d2 = d2
        after = np.minimum.accumulate(np.c_[self.lower, self.rest][:, ::-1], axis=1)[:, ::-1]  # the least bound from each place on
        certain = after > upper[:, None]
        depth = np.where(certain.any(axis=1), certain.argmax(axis=1), b + 1)
        for k in range(1, b + 1):
            rows = np.flatnonzero(depth == k)
            if len(rows):
                self._compare(x, rows, k)
                self.needed = k
        self.scan(x, np.flatnonzero(depth == b + 1))
        if n and (depth == b + 1).any():
            self.needed = b

    def _compare(self, x: np.ndarray, rows: np.ndarray, k: int) -> None:
        """Exact distances to the first k of the list; those behind are further than the own centroid."""
        which = np.c_[self.own[rows], self.near[rows, :k]]
        d2 = np.c_[self.d2[rows], squares_to(x[rows], self.c, which[:, 1:])]
        by_number = np.argsort(which, axis=1, kind="stable")
        which, d2 = np.take_along_axis(which, by_number, 1), np.take_along_axis(d2, by_number, 1)
        order = np.argsort(d2, axis=1, kind="stable")
        which, d2 = np.take_along_axis(which, order, 1), np.take_along_axis(d2, order, 1)
        self.own[rows], self.d2[rows] = which[:, 0], d2[:, 0]
        self.near[rows, :k], self.lower[rows, :k] = which[:, 1:], _down(_root(d2[:, 1:]))


def _list_of(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(a.ravel(), kind))


def _assign(centres: np.ndarray, moved: np.ndarray | None, width: int, id_type: pa.DataType, dim: int):
    """moved None: the first round, no bounds yet."""
    fields = [("vec_id", id_type), ("embedding", pa.list_(pa.float64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("near", pa.list_(pa.int16())), ("lower", pa.list_(pa.float32())), ("rest", pa.float32())]
    schema = pa.schema([*fields, ("n", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0))), ("needed", pa.int32())])
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, spread, needed = [0] * k, [[0] * dim for _ in range(k)], [0] * k, 0
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                n = batch.num_rows
                x = components(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, dim))
                b = Bounds(n, width, centres)
                if moved is None:
                    b.scan(x, np.arange(n))
                else:
                    near, lower = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("near", "lower"))
                    b.move(x, batch.column("cluster").to_numpy().astype(np.int64), near.astype(np.int64), lower, batch.column("rest").to_numpy(), moved)
                needed = max(needed, b.needed)
                for j in np.unique(b.own):
                    mine = b.own == j
                    counts[j] += int(mine.sum())
                    sums[j] = [s + int(v) for s, v in zip(sums[j], x[mine].sum(axis=0))]
                    spread[j] += int(b.d2[mine].sum())
                distance = np.minimum(b.d2, MOST).astype(np.int64)
                made = [batch.column("vec_id"), batch.column("embedding"), pa.array(b.own, pa.int32()), pa.array(distance), _list_of(b.near, pa.int16()), _list_of(b.lower, pa.float32()), pa.array(b.rest, pa.float32())]
                yield pa.RecordBatch.from_arrays([*made, *(pa.nulls(n, f.type) for f in list(schema)[len(fields) :])], schema=schema)
        full = [j for j in range(k) if counts[j]]
        if full:
            void = [pa.nulls(len(full), t) for _, t in fields]
            void[2] = pa.array(full, pa.int32())
            most = 10**38 - 1
            total = [[Decimal(v) for v in [*sums[j], min(spread[j], most)]] for j in full]
            yield pa.RecordBatch.from_arrays([*void, pa.array([counts[j] for j in full]), pa.array(total, schema.field("total").type), pa.array([needed] * len(full), pa.int32())], schema=schema)
        give_back()

    return run


def _sums(state: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """By centroid: rows, sums of components and then of squared distances, and the most bounds that any vector needed."""
    parts = state.where("n is not null").select("cluster", "n", "needed", F.posexplode("total").alias("place", "v"))
    got = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("v").cast(SQUARES).alias("v"), F.max("needed").alias("needed")).collect()  # k times DIM + 1 rows
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in sorted(got, key=lambda r: (r["cluster"], r["place"])):
        n, values, needed = out.get(r["cluster"], (r["n"], [], 0))
        out[r["cluster"]] = n, [*values, MOST if r["v"] is None else int(r["v"])], max(needed, r["needed"])
    return out


def _centres(whole: list[list[int]], dim: int) -> np.ndarray:
    a = np.array(whole, dtype=object).reshape(len(whole), dim)
    return a.astype(np.float64) if not a.size or max(map(abs, a.ravel())) < EXACT else a


def vectors_of(df: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, embedding of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select("vec_id", x.alias("embedding")).where((F.size("embedding") == dim) & F.when(F.size("embedding") == dim, fine))


def first_centres(vectors: DataFrame, k: int, dim: int) -> list[list[int]]:
    """The components of the k vectors with the smallest hashes: k rows reach the driver."""
    h = F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    best = vectors.orderBy(h, "embedding").limit(k).select(h.alias("h"), "embedding").collect()
    return [[int(v) for v in components(np.array([r["embedding"]], dtype=np.float64)).ravel()] for r in best]


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, report: list | None = None) -> DataFrame:
    """embeddings -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that takes part.

    report, where given, gets for each pass (bounds kept, most bounds that a vector needed).
    """
    spark = df.sparkSession
    vectors = vectors_of(df, dim)
    id_type = vectors.schema["vec_id"].dataType
    schema = STATE.format(id=id_type.simpleString())
    arrow_id = pa.int64() if isinstance(id_type, T.LongType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.string()
    centres = _centres(first_centres(vectors, k, dim), dim)
    k = len(centres)
    width, moved, state = min(max(k // 4, 1), max(k - 1, 0)), None, None
    for r in range(rounds + 1):
        before = state
        state = written((vectors if before is None else before.where("n is null")).mapInArrow(_assign(centres, moved, width, arrow_id, dim), schema), "bounds")
        if before is not None:
            drop_written(before)
        sums = _sums(state)
        needed = max((s[2] for s in sums.values()), default=0)
        if report is not None:
            report.append((width, needed))
        if r == rounds:
            break
        new = [[v // sums[j][0] for v in sums[j][1][:dim]] if j in sums else [int(v) for v in centres[j]] for j in range(k)]
        step = [sum((a - int(b)) ** 2 for a, b in zip(new[j], centres[j])) for j in range(k)]
        moved = np.array([_up(math.sqrt(s)) for s in step], dtype=np.float64)
        if r:
            width = min(width, max(needed, k // 8, 1))
        centres = _centres(new, dim)
    inertia = min(sum(s[1][dim] for s in sums.values()), MOST)
    hashes = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centres]
    facts = spark.createDataFrame([(j, min(s[1][dim], MOST), inertia, hashes[j]) for j, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.where("n is null").select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k facts


def _round_sql(r: int) -> str:
    """Assignment number r against the centroids c{r}, and the centroids after it."""
    return f"""
a{r} AS MATERIALIZED (SELECT id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x, c{r}) GROUP BY id, v),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT k, list(m ORDER BY i) AS m FROM (SELECT k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY k, i)) GROUP BY k) USING (k))"""


#: The same in SQL, every distance taken.
SQL = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM x ORDER BY sha256('2:' || vec_id) LIMIT 40),
{",".join(_round_sql(r) for r in range(ROUNDS + 1))}
SELECT vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN x USING (id) JOIN c{ROUNDS} ON c{ROUNDS}.k = a.k
"""
