"""Dense ReLU regression network, trained data-parallel on Spark.

Rows are dealt, by a hash of their key, onto a fixed number of shards (a
setting, not the number of tasks).  In each epoch every shard starts from the
broadcast weights and runs mini-batch Adam over its rows, streamed in batches;
the shards' weights and Adam moments are then averaged by their row counts.
The sums are taken per chunk of the parameter vector (``groupBy(chunk)`` with a
vector sum), so the reduction is spread over as many tasks as there are chunks.
The driver keeps only the parameter vector and the Adam state.

A shard's rows are sorted by key and dropout masks are a hash of (row key,
epoch, layer, unit), so training does not depend on how rows are partitioned.
Early stopping and learning rate reduction follow ``val_loss`` on a
hash-selected validation share, taken with the averaged weights.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Task functions below call this module's helpers; ship them by value so
# executors need not import the package (spark-submit --py-files or
# session.ship_package make it importable as well).
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

CHUNK = 4096
SHARD_ROWS = 100_000           # of a shard, where their number follows from the rows
PASS_NUMBERS = 8_000_000       # weights and moments of the networks that train in one pass


@dataclass
class MLPConfig:
    hidden: list = field(default_factory=lambda: [128, 64])
    l2: list = field(default_factory=lambda: [1e-4, 1e-4])
    dropout: list = field(default_factory=lambda: [0.0, 0.0])
    learning_rate: float = 1e-3
    epochs: int = 400
    patience: int = 30            # early stopping on val_loss, best weights restored
    lr_patience: int = 10         # halve the rate after this many epochs without progress
    lr_factor: float = 0.5
    min_lr: float = 1e-5
    seed: int = 42
    batch: int = 32               # rows of a step
    shards: int = 8               # parts that are averaged; the result depends on it, not on the cluster; 0: from the counted rows


def _sizes(n_in: int, cfg: MLPConfig) -> list[tuple[int, int]]:
    dims = [n_in] + list(cfg.hidden) + [1]
    return [(dims[i], dims[i + 1]) for i in range(len(dims) - 1)]


def _unpack(theta: np.ndarray, shapes):
    out, o = [], 0
    for a, b in shapes:
        W = theta[o:o + a * b].reshape(a, b)
        o += a * b
        bias = theta[o:o + b]
        o += b
        out.append((W, bias))
    return out


def init_params(n_in: int, cfg: MLPConfig) -> np.ndarray:
    """Glorot-uniform kernels, zero biases."""
    rng = np.random.default_rng(cfg.seed)
    parts = []
    for a, b in _sizes(n_in, cfg):
        lim = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-lim, lim, a * b), np.zeros(b)]
    return np.concatenate(parts)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (vectorised, wrapping uint64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def dropout_mask(rowkey: np.ndarray, epoch: int, layer: int, units: int, rate: float) -> np.ndarray:
    if rate <= 0:
        return np.ones((len(rowkey), units))
    with np.errstate(over="ignore"):
        base = _mix(rowkey.astype(np.uint64) ^ np.uint64((epoch * 1000003 + layer * 7919) & 0xFFFFFFFF))
        u = _mix(base[:, None] + np.arange(units, dtype=np.uint64)[None, :])
    keep = (u >> np.uint64(11)).astype(np.float64) / float(1 << 53) >= rate
    return keep / (1.0 - rate)


def forward(params, X, masks=None):
    acts = [X]
    h = X
    for li, (W, b) in enumerate(params):
        z = h @ W + b
        if li < len(params) - 1:
            h = np.maximum(z, 0.0)
            if masks is not None:
                h = h * masks[li]
        else:
            h = z
        acts.append(h)
    return acts


def grad_sums(params, X, y, masks):
    """Sum over rows of d(err^2)/d(theta), and the summed squared error."""
    acts = forward(params, X, masks)
    out = acts[-1][:, 0]
    err = out - y
    delta = (2.0 * err)[:, None]
    grads = []
    for li in range(len(params) - 1, -1, -1):
        W, _ = params[li]
        a_prev = acts[li]
        grads.append((a_prev.T @ delta, delta.sum(axis=0)))
        if li > 0:
            delta = delta @ W.T
            if masks is not None:
                delta = delta * masks[li - 1]
            delta = delta * (acts[li] > 0)
    grads.reverse()
    flat = np.concatenate([np.concatenate([g.ravel(), gb]) for g, gb in grads])
    return flat, float((err ** 2).sum())


def _penalty(params, l2s):
    return sum(l * float((W ** 2).sum()) for (W, _), l in zip(params[:-1], l2s))


def _penalty_grad(params, l2s, shapes):
    parts = []
    for li, ((W, b), (a, c)) in enumerate(zip(params, shapes)):
        l = l2s[li] if li < len(l2s) else 0.0
        parts += [(2.0 * l * W).ravel(), np.zeros(c)]
    return np.concatenate(parts)


@dataclass
class MLPFit:
    features: list
    config: MLPConfig
    theta: np.ndarray
    history: list

    def shapes(self):
        return _sizes(len(self.features), self.config)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Only the features go through Python, in Arrow batches."""
        theta, shapes = self.theta, self.shapes()

        @F.pandas_udf("double")
        def predict(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            return pd.Series(forward(_unpack(theta, shapes), x)[-1][:, 0])

        return df.withColumn(out, predict(*self.features))


@dataclass
class NetworkModel:
    """A network behind its preprocessing (a ``PipelineModel`` of built-in
    stages, or none); saved, loaded and scored like any other model."""
    network: MLPFit
    pre: object = None
    drop: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        x = self.pre.transform(df) if self.pre is not None else df
        return self.network.transform(x).drop(*self.drop)

    def save(self, spark, path: str) -> str:
        net = self.network
        row = (json.dumps(net.features), json.dumps(asdict(net.config)), [float(x) for x in net.theta],
               json.dumps(net.history), json.dumps(self.drop), self.pre is not None)
        spark.createDataFrame([row], "features string, config string, theta array<double>, history string, "
                                     "dropped string, has_pre boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/network")
        if self.pre is not None:
            self.pre.write().overwrite().save(f"{path}/pre")
        return path

    @staticmethod
    def load(spark, path: str) -> "NetworkModel":
        from pyspark.ml import PipelineModel
        r = spark.read.parquet(f"{path}/network").first()
        net = MLPFit(json.loads(r["features"]), MLPConfig(**json.loads(r["config"])), np.array(r["theta"]), json.loads(r["history"]))
        return NetworkModel(net, PipelineModel.load(f"{path}/pre") if r["has_pre"] else None, json.loads(r["dropped"]))


def _adam(theta, m, v, t, grad, lr):
    b1, b2, eps = 0.9, 0.999, 1e-7
    m = b1 * m + (1 - b1) * grad
    v = b2 * v + (1 - b2) * grad * grad
    return theta - lr * (m / (1 - b1 ** t)) / (np.sqrt(v / (1 - b2 ** t)) + eps), m, v


def identity(df: DataFrame, *settings) -> str:
    """Hash of a table's rows (whatever their order) and of settings."""
    import hashlib
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha1(json.dumps([df.columns, n, str(total), *settings], sort_keys=True, default=str).encode()).hexdigest()


class Mismatch(ValueError):
    """Saved state belongs to other settings or other data."""


@dataclass
class Training:
    """State of one network's training between epochs."""
    config: MLPConfig
    theta: np.ndarray
    m: np.ndarray
    v: np.ndarray
    best_theta: np.ndarray
    lr: float
    best: float = np.inf
    since_best: int = 0
    since_lr: int = 0
    steps: int = 0
    epoch: int = 0
    stopped: bool = False
    history: list = field(default_factory=list)

    @staticmethod
    def begin(n_in: int, cfg: MLPConfig, mean: float) -> Training:
        theta = init_params(n_in, cfg)
        theta[-1] = mean                                    # start at the mean
        return Training(cfg, theta, np.zeros(len(theta)), np.zeros(len(theta)), theta.copy(), cfg.learning_rate)

    def state(self) -> dict:
        d = {k: x for k, x in self.__dict__.items() if k != "config"}
        return {k: x.tolist() if isinstance(x, np.ndarray) else x for k, x in d.items()}

    @staticmethod
    def resume(cfg: MLPConfig, state: dict) -> Training:
        arrays = {"theta", "m", "v", "best_theta"}
        return Training(cfg, **{k: np.asarray(x) if k in arrays else x for k, x in state.items()})

    def judge(self, val: float) -> bool:
        """Early stopping and rate reduction on the weights that gave ``val``;
        false when training ends."""
        cfg = self.config
        if val < self.best - 1e-12:
            self.best, self.best_theta, self.since_best, self.since_lr = float(val), self.theta.copy(), 0, 0
            return True
        self.since_best += 1
        self.since_lr += 1
        if self.since_lr >= cfg.lr_patience and self.lr > cfg.min_lr:
            self.lr, self.since_lr = max(self.lr * cfg.lr_factor, cfg.min_lr), 0
        self.stopped = self.since_best >= cfg.patience
        return not self.stopped


class Dealt:
    """Rows dealt onto shards once, for any number of networks."""

    def __init__(self, df: DataFrame, features: list[str], label: str, shards: int,
                 valid: str = "is_valid", rowkey: str = "_rowkey"):
        """``shards``: their number, or 0 for one per ``SHARD_ROWS`` counted
        rows (at least 8)."""
        self.features = list(features)
        self.shards = shards or max(8, -(-df.count() // SHARD_ROWS))
        data = df.select(*self.features, F.col(label).cast("double").alias("__y"),
                         F.col(valid).alias("__v"), F.col(rowkey).alias("__k"))
        data = data.withColumn("__s", F.pmod(F.xxhash64("__k"), F.lit(int(self.shards))).cast("int"))
        self.data = data.repartition("__s").sortWithinPartitions("__s", "__k", "__y", *self.features).persist()
        self.mean = self.data.where(~F.col("__v")).agg(F.avg("__y")).first()[0] or 0.0

    def unpersist(self) -> None:
        self.data.unpersist()


def groups(nets: list[Training]) -> list[list[Training]]:
    """Networks that share a pass: their numbers together stay in the bound."""
    out, held = [], 0
    for net in nets:
        size = 3 * len(net.theta)
        if not out or held + size > PASS_NUMBERS:
            out.append([])
            held = 0
        out[-1].append(net)
        held += size
    return out


def run_epoch(dealt: Dealt, nets: list[Training]) -> None:
    """One epoch of every network, in one pass over the rows."""
    spark, feats = dealt.data.sparkSession, dealt.features
    settings = []
    for net in nets:
        cfg, shapes = net.config, _sizes(len(feats), net.config)
        l2s = list(cfg.l2) + [0.0] * (len(cfg.hidden) - len(cfg.l2))
        drops = list(cfg.dropout) + [0.0] * (len(cfg.hidden) - len(cfg.dropout))
        settings.append((shapes, l2s, drops, net.lr, net.steps, net.epoch, cfg.batch))
    bc = spark.sparkContext.broadcast([(net.theta, net.m, net.v) for net in nets])

    def part(batches):
        shard, states, left = None, [], []

        def begin():
            return [[*(x.copy() for x in weights), settings[i][4], np.zeros(5)] for i, weights in enumerate(bc.value)]

        def step(i, x, y, key):
            shapes, l2s, drops, lr, _, epoch, _ = settings[i]
            th, mm, vv, t, st = states[i]
            params = _unpack(th, shapes)
            masks = [dropout_mask(key, epoch, li, shapes[li][1], drops[li]) for li in range(len(shapes) - 1)]
            g, sse = grad_sums(params, x, y, masks)
            st[:2] += sse, len(y)
            states[i][:4] = [*_adam(th, mm, vv, t + 1, g / len(y) + _penalty_grad(params, l2s, shapes), lr), t + 1]

        def end():
            rows = []
            for i, (th, mm, vv, t, st) in enumerate(states):
                if left[i] is not None and len(left[i][1]):
                    step(i, *left[i])
                    th, mm, vv, t, st = states[i]
                st[4] = (t - settings[i][4]) * st[1]
                whole = np.concatenate([th, mm, vv]) * st[1]
                if st[1]:
                    rows += [(i, c, whole[c * CHUNK:(c + 1) * CHUNK].tolist()) for c in range(-(-len(whole) // CHUNK))]
                rows.append((i, -1, st.tolist()))
            return pd.DataFrame(rows, columns=["net", "chunk", "g"])

        for pdf in batches:
            for s, rows in pdf.groupby("__s", sort=False):
                if s != shard:
                    if shard is not None:
                        yield end()
                    shard, states, left = s, begin(), [None] * len(settings)
                x, y = rows[feats].to_numpy(dtype=float), rows["__y"].to_numpy(dtype=float)
                isv = rows["__v"].to_numpy(dtype=bool)
                key = rows["__k"].to_numpy(dtype=np.int64).view(np.uint64)
                for i, (shapes, *_, batch) in enumerate(settings):
                    if isv.any():
                        e = forward(_unpack(bc.value[i][0], shapes), x[isv])[-1][:, 0] - y[isv]
                        states[i][4][2:4] += float((e ** 2).sum()), isv.sum()
                    now = (x[~isv], y[~isv], key[~isv])
                    if left[i] is not None:
                        now = tuple(np.concatenate(z) for z in zip(left[i], now))
                    full = len(now[1]) // batch * batch
                    for a in range(0, full, batch):
                        step(i, *(z[a:a + batch] for z in now))
                    left[i] = tuple(z[full:] for z in now)
        if shard is not None:
            yield end()

    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    summed = dealt.data.mapInPandas(part, "net int, chunk int, g array<double>").groupBy("net", "chunk") \
                  .agg(Summarizer.sum(array_to_vector("g")).alias("s")).collect()     # 3 P + 5 numbers a network
    bc.unpersist()
    parts = {(r["net"], r["chunk"]): r["s"].toArray() for r in summed}
    for i, net in enumerate(nets):
        shapes, l2s = settings[i][:2]
        st, P = parts[i, -1], len(net.theta)
        pen = _penalty(_unpack(net.theta, shapes), l2s)
        loss = st[0] / max(st[1], 1.0) + pen
        val = (st[2] / st[3] + pen) if st[3] > 0 else loss
        net.history.append({"epoch": net.epoch, "loss": float(loss), "val_loss": float(val), "lr": net.lr})
        net.epoch += 1
        if net.judge(val) and st[1] > 0:
            whole = np.concatenate([parts[i, c] for c in range(-(-3 * P // CHUNK))])[:3 * P] / st[1]
            net.theta, net.m, net.v = whole[:P], whole[P:2 * P], whole[2 * P:]
            net.steps += int(round(st[4] / st[1]))


def fit_mlp(df: DataFrame, features: list[str], label: str, cfg: MLPConfig,
            valid: str = "is_valid", rowkey: str = "_rowkey",
            snapshot: str | None = None, snapshot_every: int = 25) -> MLPFit:
    """Train on rows with ``valid`` false, monitor ``val_loss`` on the rest.

    ``snapshot``: a folder on shared storage where the training state
    (weights, Adam moments, rate, best weights, counters) is written every
    ``snapshot_every`` epochs, each into a folder of its own; a rerun resumes
    at the last finished one, and raises ``Mismatch`` if layers, features,
    settings (but the number of epochs) or rows are not the same."""
    spark = df.sparkSession
    dealt = Dealt(df, features, label, cfg.shards, valid, rowkey)
    cfg = replace(cfg, shards=dealt.shards)
    net, who = Training.begin(len(dealt.features), cfg, dealt.mean), None
    if snapshot:
        from ..session import list_names
        who = identity(dealt.data, dealt.features, {k: x for k, x in asdict(cfg).items() if k != "epochs"})
        done = sorted(n for n in list_names(spark, snapshot) if n.startswith("epoch="))
        if done:
            state = json.loads(spark.read.json(f"{snapshot}/{done[-1]}").first()["state"])
            if state.pop("who") != who:
                raise Mismatch(f"{snapshot} holds the training of another network, other settings or other rows")
            net = Training.resume(cfg, state)
    start = net.epoch
    while net.epoch < cfg.epochs and not net.stopped:
        if snapshot and net.epoch > start and net.epoch % snapshot_every == 0:
            spark.createDataFrame([(json.dumps({"who": who, **net.state()}),)], "state string").coalesce(1) \
                 .write.mode("overwrite").json(f"{snapshot}/epoch={net.epoch:06d}")
        run_epoch(dealt, [net])
    dealt.unpersist()
    return MLPFit(dealt.features, cfg, net.best_theta, net.history)


@dataclass
class Halving:
    """Result of ``halving_search``: the trained networks, each with the rung at
    which it was left out (the last one for those that stayed)."""
    fits: list
    rungs: list
    budgets: list

    @property
    def best(self) -> int:
        losses = [min(h["val_loss"] for h in f.history) for f in self.fits]
        last = max(self.rungs)
        return min((i for i, r in enumerate(self.rungs) if r == last), key=lambda i: (losses[i], i))


def budgets(first: int, most: int, factor: int = 3) -> list[int]:
    """Epochs at the end of each rung: ``first``, times ``factor``, ... ``most``."""
    out = []
    while first < most:
        out.append(first)
        first *= factor
    return [*out, most]


def halving_search(df: DataFrame, features: list[str], label: str, configs: list[MLPConfig], first: int = 15,
                   factor: int = 3, valid: str = "is_valid", rowkey: str = "_rowkey", progress: str | None = None) -> Halving:
    """Successive halving over trials: all train for ``first`` epochs, the best
    ``1 / factor`` of them (by their best ``val_loss``, at least one) go on to
    ``factor`` times as many, up to their own ``epochs``.

    Rows are dealt onto shards once for the whole search, and one pass trains
    all live networks (in groups of at most ``PASS_NUMBERS`` numbers).  A network
    is what ``fit_mlp`` gives for the same epochs.  ``progress``: a folder on
    shared storage; each finished rung is written there, and a rerun resumes
    behind the last one, or raises ``Mismatch`` for other trials or rows."""
    if not configs or len({c.shards for c in configs}) > 1:
        raise ValueError("trials of a search need the same number of shards")
    spark = df.sparkSession
    dealt = Dealt(df, features, label, configs[0].shards, valid, rowkey)
    configs = [replace(c, shards=dealt.shards) for c in configs]
    nets = [Training.begin(len(dealt.features), c, dealt.mean) for c in configs]
    steps = budgets(min(first, max(c.epochs for c in configs)), max(c.epochs for c in configs), factor)
    left, done, who = [len(steps) - 1] * len(nets), 0, None
    if progress:
        from ..session import list_names
        who = identity(dealt.data, dealt.features, [asdict(c) for c in configs], steps)
        names = sorted(n for n in list_names(spark, progress) if n.startswith("rung="))
        if names:
            rows = spark.read.parquet(f"{progress}/{names[-1]}").orderBy("net").collect()
            if len(rows) != len(nets) or any(r["who"] != who for r in rows):
                raise Mismatch(f"{progress} holds a search over other trials or other rows")
            nets = [Training.resume(c, json.loads(r["state"])) for c, r in zip(configs, rows)]
            left, done = [r["left"] for r in rows], len(names)
    live = [i for i in range(len(nets)) if left[i] >= done]
    for rung in range(done, len(steps)):
        while going := [nets[i] for i in live if not nets[i].stopped and nets[i].epoch < min(steps[rung], nets[i].config.epochs)]:
            for group in groups(going):
                run_epoch(dealt, group)
        if rung + 1 < len(steps):
            order = sorted(live, key=lambda i: (nets[i].best, i))
            keep = order[:max(1, len(order) // factor)]
            for i in set(live) - set(keep):
                left[i] = rung
            live = sorted(keep)
        if progress:
            rows = [(i, who, left[i], json.dumps(net.state())) for i, net in enumerate(nets)]
            spark.createDataFrame(rows, "net int, who string, left int, state string").coalesce(1) \
                 .write.mode("overwrite").parquet(f"{progress}/rung={rung:03d}")
    dealt.unpersist()
    return Halving([MLPFit(dealt.features, n.config, n.best_theta, n.history) for n in nets], left, steps)


def row_key(df: DataFrame, keys=("series", "day"), out: str = "_rowkey") -> DataFrame:
    """64-bit row key from the panel key (for dropout masks)."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return df.withColumn(out, F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"))


# The reference network's search space (fixed values): first layer 64..512
# step 64; 0..3 extra layers of 32..256 step 32; L2 one of 1e-4, 5e-4, 1e-3;
# dropout 0.2..0.5 step 0.1; learning rate one of 1e-3, 8e-4, 5e-4, 3e-4.
SPACE = {
    "units_1": list(range(64, 513, 64)),
    "extra_layers": [0, 1, 2, 3],
    "units_extra": list(range(32, 257, 32)),
    "l2": [1e-4, 5e-4, 1e-3],
    "dropout": [0.2, 0.3, 0.4, 0.5],
    "learning_rate": [1e-3, 8e-4, 5e-4, 3e-4],
}


def sample_configs(n: int, seed: int = 42, epochs: int = 400, space: dict | None = None) -> list[MLPConfig]:
    """``n`` random trials from the search space (reproducible)."""
    sp = space or SPACE
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        k = int(rng.choice(sp["extra_layers"]))
        hidden = [int(rng.choice(sp["units_1"]))] + [int(rng.choice(sp["units_extra"])) for _ in range(k)]
        out.append(MLPConfig(hidden=hidden,
                             l2=[float(rng.choice(sp["l2"])) for _ in hidden],
                             dropout=[float(rng.choice(sp["dropout"])) for _ in hidden],
                             learning_rate=float(rng.choice(sp["learning_rate"])),
                             epochs=epochs, seed=seed))
    return out
