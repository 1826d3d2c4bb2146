"""Reproducible holdouts, folds, grids and samples.

Every split is a function of the row key, not of partitioning or row
order: ``h = md5(series|day|seed[|salt])``.  Spark and DuckDB compute the
same digest, so the same rows land in the same split in both engines.

* ``hash`` modes are map-only: the first 8 hex digits of ``h`` as a
  fraction (holdout) or modulo ``k`` (folds).
* ``exact`` modes give exactly ``ceil(frac*n)`` test rows, or folds sized
  like ``NTILE(k)`` over the rows ordered by ``(h, series, day)``.  They
  never sort or shuffle the rows: the rank positions of the few cut points
  are located by counting rows per hash prefix (4 hex digits, then 8, ...),
  each level one small aggregation restricted to the bucket that holds a
  cut.  Once a bucket holding a cut is small it is collected (bounded by
  ``SMALL``) and the exact cut tuple read off.  Each row then takes its fold
  by comparing its order key with the k-1 cut tuples: a projection.
* ``blocks`` mode gives contiguous, unshuffled blocks in ``(day, h,
  series)`` order (day first, so blocks are chronological), located the
  same way with the day as first level.  Rows per day are counted on the
  map side; the number of days is bounded by the calendar.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH = "_h"
SMALL = 4096          # largest bucket collected to the driver to read a cut
MAX_LEVEL_BUCKETS = 1 << 20   # bound on the per-level count table


def with_hash(df: DataFrame, seed: int = 42, salt: str = "", keys=("series", "day"),
              out: str = HASH) -> DataFrame:
    parts = [F.col(k).cast("string") for k in keys] + [F.lit(str(seed) + salt)]
    return df.withColumn(out, F.md5(F.concat_ws("|", *parts)))


def unit_fraction(h: str | Column = HASH) -> Column:
    """First 32 bits of the digest as a number in [0, 1)."""
    c = F.col(h) if isinstance(h, str) else h
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def _hash_bits(h: str = HASH) -> Column:
    return F.conv(F.substring(F.col(h), 1, 8), 16, 10).cast("bigint")


# ------------------------------------------------------------ exact cuts
def _tuple_gt(cols: list[str], values: tuple) -> Column:
    """Lexicographic ``(cols) > values``."""
    expr = None
    for c, v in reversed(list(zip(cols, values))):
        gt = F.col(c) > F.lit(v)
        expr = gt if expr is None else (gt | ((F.col(c) == F.lit(v)) & expr))
    return expr


def _match(cols: list[Column], values: tuple) -> Column:
    e = F.lit(True)
    for c, v in zip(cols, values):
        e = e & (c == F.lit(v))
    return e


def exact_cuts(df: DataFrame, order_cols: list[str], levels: list[list[Column]],
               positions, small: int = SMALL) -> dict[int, tuple]:
    """Order-key tuples of the rows at 1-based ``positions`` in the order of
    ``order_cols`` (which must be unique and non-null).

    ``levels`` are successively finer bucket keys, each consistent with the
    order (a prefix of it); the last level should be fine enough that a
    bucket is small.  ``positions`` may be a function of the row count n,
    which is then read off the first level's counts (no separate pass).
    """
    found: dict[int, tuple] = {}
    pending = None if callable(positions) else {p: (None, 0) for p in sorted({p for p in positions if p > 0})}
    prev: list[Column] | None = None
    for depth, key in enumerate(levels):
        if pending is not None and not pending:
            break
        names = [f"_k{i}" for i in range(len(key))]
        parents = {v[0] for v in pending.values()} if pending else {None}
        sub = df
        if prev is not None:
            cond = F.lit(False)
            for pv in parents:
                cond = cond | _match(prev, pv)
            sub = df.where(cond)
        pnames = [f"_p{i}" for i in range(len(prev))] if prev is not None else []
        grouped = sub.groupBy(*[c.alias(n) for c, n in zip(prev or [], pnames)],
                              *[c.alias(n) for c, n in zip(key, names)]).count()
        limit = MAX_LEVEL_BUCKETS * max(1, len(parents))
        rows = grouped.limit(limit + 1).collect()   # bounded: buckets of this level inside <= k parents
        if len(rows) > limit:
            raise RuntimeError("bucket level too fine; add a coarser level")
        if pending is None:        # first level: n is the sum of its counts
            n = sum(r["count"] for r in rows)
            pending = {p: (None, 0) for p in sorted({p for p in positions(n) if p > 0})}
            found["n"] = n
            if not pending:
                break
        by_parent: dict = {}
        for r in rows:
            pv = tuple(r[n] for n in pnames) if pnames else None
            by_parent.setdefault(pv, []).append((tuple(r[n] for n in names), r["count"]))
        for lst in by_parent.values():
            lst.sort(key=lambda kv: kv[0])
        last = depth == len(levels) - 1      # the whole hash: more rows than one are one repeated key
        nxt = {}
        for p, (pv, before) in pending.items():
            acc = before
            for bucket, cnt in by_parent.get(pv, []):
                if acc + cnt >= p:
                    if last and cnt > small:
                        raise ValueError(f"{cnt} rows share an order key; exact cuts need keys that tell rows apart")
                    if cnt <= small:
                        nxt[p] = ("collect", bucket, acc)
                    else:
                        nxt[p] = ("descend", bucket, acc)
                    break
                acc += cnt
            else:
                raise ValueError(f"position {p} beyond the {acc} rows")
        pending = {}
        collect = {}
        for p, (kind, bucket, acc) in nxt.items():
            if kind == "collect":
                collect.setdefault(bucket, []).append((p, acc))
            else:
                pending[p] = (bucket, acc)
        for bucket, items in collect.items():
            got = df.where(_match(key, bucket)).select(*order_cols).collect()
            tup = sorted(tuple(r) for r in got)
            for p, acc in items:
                found[p] = tup[p - acc - 1]
        prev = key
    return found


def _ntile_positions(n: int, k: int) -> list[int]:
    """Last rank of each of the first k-1 tiles of NTILE(k) over n rows."""
    q, big = divmod(n, k)
    pos, acc = [], 0
    for j in range(k - 1):
        acc += q + (1 if j < big else 0)
        pos.append(acc)
    return pos


def _hash_levels(extra_first: list[Column] | None = None) -> list[list[Column]]:
    first = list(extra_first or [])
    lv = [first] if first else []
    for width in (4, 8, 12, 16, 32):
        lv.append(first + [F.substring(F.col(HASH), 1, width)])
    return lv


def _assign_by_cuts(df: DataFrame, order_cols: list[str], cuts: list[tuple], out: str) -> DataFrame:
    fold = F.lit(0)
    for c in cuts:
        fold = fold + F.when(_tuple_gt(order_cols, c), 1).otherwise(0)
    return df.withColumn(out, fold.cast("int"))


# ---------------------------------------------------------------- holdout
def holdout(df: DataFrame, frac: float = 0.3, seed: int = 42, mode: str = "hash",
            salt: str = "", keys=("series", "day"), out: str = "is_test") -> DataFrame:
    """Flag about (``hash``) or exactly (``exact``, ``ceil(frac*n)``) ``frac``
    of the rows as held out.  Deterministic in the key and seed."""
    d = with_hash(df, seed, salt, keys)
    if mode == "hash":
        return d.withColumn(out, unit_fraction(HASH) < F.lit(frac)).drop(HASH)
    if mode != "exact":
        raise ValueError("mode must be 'hash' or 'exact'")
    order = [HASH] + list(keys)
    found = exact_cuts(d, order, _hash_levels(), lambda n: [math.ceil(frac * n)])
    n_test = math.ceil(frac * found["n"])
    if n_test <= 0:
        return d.withColumn(out, F.lit(False)).drop(HASH)
    return d.withColumn(out, ~_tuple_gt(order, found[n_test])).drop(HASH)


def validation(df: DataFrame, frac: float = 0.2, seed: int = 42, out: str = "is_valid",
               keys=("series", "day")) -> DataFrame:
    """Rows set aside for early stopping: a hash holdout with its own salt,
    independent of the test split."""
    return holdout(df, frac, seed, "hash", salt="|valid", keys=keys, out=out)


# ------------------------------------------------------------------ folds
def kfold(df: DataFrame, k: int = 5, seed: int = 42, mode: str = "hash", salt: str = "",
          keys=("series", "day"), out: str = "fold", order: str = "day") -> DataFrame:
    """Assign ``fold`` in ``[0, k)``.

    ``hash``: ``pmod(h, k)``, about equal sizes, map-only.
    ``exact``: NTILE(k) over ``(h, keys)``: sizes differ by at most one.
    ``blocks``: NTILE(k) over ``(day, h, keys)``: contiguous chronological
    blocks, the first ``n mod k`` one row larger.
    """
    d = with_hash(df, seed, salt, keys)
    if mode == "hash":
        return d.withColumn(out, F.pmod(_hash_bits(), F.lit(k)).cast("int")).drop(HASH)
    if mode == "exact":
        order_cols = [HASH] + list(keys)
        levels = _hash_levels()
    elif mode == "blocks":
        order_cols = [order, HASH] + [c for c in keys if c != order]
        levels = _hash_levels([F.col(order)])
    else:
        raise ValueError("mode must be 'hash', 'exact' or 'blocks'")
    found = exact_cuts(d, order_cols, levels, lambda n: _ntile_positions(n, k))
    cuts = [found[p] for p in _ntile_positions(found["n"], k) if p > 0]
    return _assign_by_cuts(d, order_cols, cuts, out).drop(HASH)


def nested_folds(df: DataFrame, k_outer: int = 5, k_inner: int = 5, seed: int = 42,
                 mode: str = "hash") -> DataFrame:
    """Outer ``fold`` and an independent ``inner`` fold (another salt), so
    that every inner search of every outer fold reads the same pass."""
    d = kfold(df, k_outer, seed, mode, out="fold")
    return kfold(d, k_inner, seed, mode, salt="|inner", out="inner")


# ------------------------------------------------------- grids and samples
def grid_candidates(grid: dict) -> list[dict]:
    """Candidates in grid order: parameter names sorted, the last varying
    fastest (the usual parameter-grid order, which decides ties)."""
    names = sorted(grid)
    return [dict(zip(names, vals)) for vals in itertools.product(*[list(grid[k]) for k in names])]


def _spark_type(values) -> T.DataType:
    vs = [v for v in values if v is not None]
    if vs and all(isinstance(v, bool) for v in vs):
        return T.BooleanType()
    if vs and all(isinstance(v, int) and not isinstance(v, bool) for v in vs):
        return T.LongType()
    if vs and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in vs):
        return T.DoubleType()
    return T.StringType()


def param_grid(spark: SparkSession, grid: dict) -> DataFrame:
    """One row per candidate (``candidate`` id in grid order); ``None``
    becomes NULL.  A grid is small by nature (the product of short lists)."""
    names = sorted(grid)
    types = {k: _spark_type(grid[k]) for k in names}
    schema = T.StructType([T.StructField("candidate", T.IntegerType(), False)]
                          + [T.StructField(k, types[k]) for k in names])
    rows = []
    for i, c in enumerate(grid_candidates(grid)):
        vals = []
        for k in names:
            v = c[k]
            if v is not None:
                v = {T.LongType: int, T.DoubleType: float, T.BooleanType: bool}.get(type(types[k]), str)(v)
            vals.append(v)
        rows.append((i, *vals))
    return spark.createDataFrame(rows, schema)


def param_sample(grid: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct candidates drawn without replacement, reproducibly:
    the first ``n`` by ``md5(candidate|seed)``.  The draw order is kept as
    ``draw`` (it decides ties)."""
    key = F.md5(F.concat_ws("|", F.col("candidate").cast("string"), F.lit(str(seed))))
    from pyspark.sql import Window
    ranked = grid.withColumn("_d", key).orderBy("_d").limit(n)
    return ranked.withColumn("draw", F.row_number().over(Window.orderBy("_d")) - 1).drop("_d")
