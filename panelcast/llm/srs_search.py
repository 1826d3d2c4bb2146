"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are mapped to a Euclidean space in which a larger inner product is a
smaller distance (one more coordinate fills every vector up to the largest
norm; queries are scaled to it), and projected by a Gaussian, that is 2-stable,
matrix onto ``M`` dimensions.  There, squared projected distance over squared
true distance follows a chi-square law with ``M`` degrees of freedom.

* Index: a kd-tree over the projections.  Its upper levels are fitted on a
  bounded sample and cut the rows into cells; cells are cut, by a hash of the
  id, into blocks of bounded size; each task builds the lower levels over its
  block.  Every row is indexed.
* Search: a query takes leaves in order of projected distance and verifies
  their rows by exact inner products.  It stops when a row as near as its
  current k-th would, with probability ``SURE``, have been projected nearer
  than the next leaf.  It runs first in the query's own block; the bound found
  there decides, by the same test, which other blocks are worth a visit.

Recall is at least about ``SURE`` whatever the data; how much is skipped
depends on them (with directions spread evenly, little).

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do null ids, nor vectors of another length than
the most common one (the smaller, if two are); of repeated ids one row counts
(the smallest vector); with fewer candidates than k all come; ties go to the
smaller id, over equal vectors too; no queries or rows give an empty result;
extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, staged

M = 8                   # projected dimensions, even
SURE = 0.99
SAMPLE = 20_000         # rows that the upper kd levels are fitted on
BLOCK = 32_768          # rows of a block
CHUNK = 8_192           # queries that meet a block in one task
LEAF = 256
MAX_CELLS = 256
BATCH = 64

_FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """For even m, by bisection on the closed form."""
    def cdf(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Space:
    """The mapping of rows and queries, and the upper kd levels."""

    def __init__(self, dim: int, norm: float, m: int = M, seed: int = 5):
        self.norm = norm
        self.dim = dim
        self.matrix = np.random.default_rng(seed).standard_normal((dim + 1, m))
        self.reach = chi_square_quantile(SURE, m)

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm ** 2 - (x * x).sum(axis=1)))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.linalg.norm(q, axis=1))[:, None]) @ self.matrix[:-1]

    def distance2(self, score, q: np.ndarray):
        """Squared distance that belongs to an inner product with q."""
        return np.maximum(0.0, 2 * self.norm ** 2 - 2 * self.norm / np.linalg.norm(q, axis=-1) * score)

    def fit_cells(self, sample: np.ndarray, cells: int) -> None:
        """Median cuts along the widest dimension; a cut is (dimension, value,
        left, right), a cell is its number."""
        self.count = 0

        def cut(points, n):
            spread = np.ptp(points, axis=0) if len(points) else np.zeros(self.matrix.shape[1])
            if n <= 1 or len(points) < 2 or not spread.max():
                self.count += 1
                return self.count - 1
            d = int(spread.argmax())
            left = n // 2
            at = float(np.quantile(points[:, d], left / n))
            low = points[:, d] <= at
            return (d, at, cut(points[low], left), cut(points[~low], n - left))

        self.tree = cut(self.rows(sample), cells)

    def cell(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int32)

        def go(node, at):
            if isinstance(node, int):
                out[at] = node
                return
            low = p[at, node[0]] <= node[1]
            go(node[2], at[low])
            go(node[3], at[~low])

        go(self.tree, np.arange(len(p)))
        return out


def box_distance2(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(p), len(low)))
    for d in range(p.shape[1]):
        x = p[:, d:d + 1]
        out += np.maximum(0.0, np.maximum(low[:, d] - x, x - high[:, d])) ** 2
    return out


def kd_leaves(p: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree with median cuts."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        at = todo.pop()
        spread = np.ptp(p[at], axis=0)
        if len(at) <= leaf or not spread.max():
            out += [at[i:i + leaf] for i in range(0, len(at), leaf)]
            continue
        half = len(at) // 2
        at = at[np.argpartition(p[at, int(spread.argmax())], half)]
        todo += [at[:half], at[half:]]
    return out


def search_block(space: Space, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray,
                 bound: np.ndarray, k: int):
    """For each query the rows of this block that may be among its k nearest:
    up to k, and none below ``bound`` (its k-th score so far)."""
    p = space.rows(x)
    leaves = kd_leaves(p)
    order = np.concatenate(leaves)
    ids, x, p = ids[order], x[order], p[order]
    ends = np.cumsum([len(a) for a in leaves])
    starts = ends - [len(a) for a in leaves]
    low = np.stack([p[a:b].min(axis=0) for a, b in zip(starts, ends)])
    high = np.stack([p[a:b].max(axis=0) for a, b in zip(starts, ends)])
    for first in range(0, len(q), BATCH):
        qs, qid = q[first:first + BATCH], query_ids[first:first + BATCH]
        least = box_distance2(space.queries(qs), low, high)
        turn = np.argsort(least, axis=1, kind="stable")
        score = np.full((len(qs), len(x)), -np.inf)
        best = np.full((len(qs), k), -np.inf)
        best[:, 0] = -np.inf
        kth = bound[first:first + BATCH].copy()
        alive, done, step = np.arange(len(qs)), 0, 1
        while len(alive) and done < len(leaves):
            now = turn[alive, done:done + step]
            reach = space.reach * space.distance2(np.where(np.isfinite(kth[alive]), kth[alive], -np.inf), qs[alive])
            near = np.take_along_axis(least[alive], now, axis=1) <= reach[:, None]
            for leaf in np.unique(now[near]):
                who = alive[(near & (now == leaf)).any(axis=1)]
                a, b = starts[leaf], ends[leaf]
                s = qs[who] @ x[a:b].T
                s[qid[who][:, None] == ids[a:b]] = -np.inf       # the query's own row
                score[who, a:b] = s
                both = np.concatenate([best[who], s], axis=1)
                best[who] = -np.partition(-both, k - 1, axis=1)[:, :k]
            kth[alive] = np.maximum(bound[first:first + BATCH][alive], best[alive].min(axis=1))
            done += step
            step = min(2 * step, 32)
            alive = alive[near[:, -1]]      # leaves come by distance: a query whose last one was too far is done
        # sums of a row are the same wherever it stands, unlike those of a matrix product
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
        row, col = np.nonzero((score >= (kth - slack)[:, None]) & np.isfinite(score))
        exact = (qs[row] * x[col]).sum(axis=1)
        o = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[o], col[o], exact[o]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        yield pd.DataFrame({"query_id": qid[row[keep]], "vec_id": ids[col[keep]], "score": exact[keep]})


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part, one per id."""
    ok = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = ok.where("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and "
                  "abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    ok = staged(ok.groupBy("vec_id").agg(F.min("v").alias("v")), "srs-rows")
    size = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return ok.where(F.size("v") == (size["d"] if size else 0))


def search(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id
    is divisible by ``every``."""
    ok = usable(rows)
    spark = ok.sparkSession
    n, norm2, dim = ok.agg(F.count("*"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    space = Space(dim, math.sqrt(norm2))
    sample = np.stack(bounded_sample(ok, "vec_id", SAMPLE).orderBy("vec_id").limit(2 * SAMPLE).toPandas()["v"].to_numpy())
    space.fit_cells(sample, max(1, min(MAX_CELLS, -(-n // BLOCK))))
    dims = [f"p{i}" for i in range(M)]

    def assign(batches):
        for b in batches:
            if len(b):
                p = space.rows(np.stack(b["v"].to_numpy()))
                yield pd.DataFrame({"vec_id": b["vec_id"], "cell": space.cell(p), **dict(zip(dims, p.T))})

    cells = staged(ok.mapInPandas(assign, "vec_id long, cell int, " + ", ".join(f"{d} double" for d in dims)), "srs-cells")
    info = cells.groupBy("cell").agg(F.count("*").alias("n"), *[F.min(d).alias(f"a{d}") for d in dims],
                                     *[F.max(d).alias(f"b{d}") for d in dims]).orderBy("cell").toPandas()
    salts = dict(zip(info["cell"].tolist(), (-(-info["n"] // BLOCK)).tolist()))
    split = F.create_map(*[F.lit(int(x)) for pair in salts.items() for x in pair])
    place = cells.select("vec_id", "cell", F.pmod(F.xxhash64("vec_id"), split[F.col("cell")].cast("long")).cast("int").alias("salt"))
    index = staged(ok.join(place, "vec_id"), "srs-index")
    queries = index.where(F.col("vec_id") % every == 0)

    def home(block: pd.DataFrame) -> pd.DataFrame:
        ids, x = block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy())
        own = ids % every == 0
        if not own.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return pd.concat(search_block(space, ids, x, ids[own], x[own], np.full(own.sum(), -np.inf), k))

    near = staged(index.groupBy("cell", "salt").applyInPandas(home, _FOUND), "srs-home")
    bound = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    low, high = info[[f"a{d}" for d in dims]].to_numpy(), info[[f"b{d}" for d in dims]].to_numpy()
    names, parts = info["cell"].to_numpy(), [salts[c] for c in info["cell"]]

    def route(batches):
        """The other blocks that a query's bound leaves open."""
        for b in batches:
            if not len(b):
                continue
            q = np.stack(b["v"].to_numpy())
            s = b["bound"].to_numpy(dtype=float)
            s = np.where(np.isnan(s), -np.inf, s)
            reach = space.reach * space.distance2(s, q)
            row, at = np.nonzero(box_distance2(space.queries(q), low, high) <= reach[:, None])
            out = [(i, c, t) for i, c in zip(row, at) for t in range(parts[c])]
            if not out:
                continue
            i, c, t = map(np.array, zip(*out))
            d = pd.DataFrame({"query_id": b["vec_id"].to_numpy()[i], "q": b["v"].to_numpy()[i], "bound": s[i],
                              "cell": names[c], "salt": t})
            yield d[(d["cell"] != b["cell"].to_numpy()[i]) | (d["salt"] != b["salt"].to_numpy()[i])]

    asked = (queries.join(bound, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "cell", "salt", "bound")
             .mapInPandas(route, "query_id long, q array<double>, bound double, cell int, salt int"))
    asked = staged(asked, "srs-asked")
    chunks = asked.groupBy("cell", "salt").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    asked = asked.join(chunks, ["cell", "salt"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks").cast("long")).cast("int")).drop("chunks")
    shown = index.join(chunks, ["cell", "salt"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def visit(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return pd.concat(search_block(space, block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy()),
                                      ask["query_id"].to_numpy(), np.stack(ask["q"].to_numpy()), ask["bound"].to_numpy(dtype=float), k))

    far = (shown.groupBy("cell", "salt", "chunk").cogroup(asked.groupBy("cell", "salt", "chunk")).applyInPandas(visit, _FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
