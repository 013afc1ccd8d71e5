"""The learned router: an encoder shared by Bayesian linear heads, one per (configuration, subchallenge).

Heads are additive sums (z z', z y, n), so training them is one aggregate and their order does not matter.
The encoder (21 - 64 - 64 - 32, ReLU) is trained in NumPy on the corpus' tumours, some 10,000 rows of 21
numbers (train_router), or over a table of any number of rows, by gradients that Spark sums (train_router_on); scores of many
tumours go through an Arrow function with its weights."""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonal_spark.config import CONFIG_NAMES, DEFAULT_EXCLUDE_CONFIGS, FEATURE_NAMES, SUBCHALLENGES, SubChallenge
from clonal_spark.plans.sampler import uniforms
from clonal_spark.session import Scratch

DIM, HIDDEN, DROPOUT, JITTER = 32, 64, 0.1, 1e-6
SC_NAMES = [s.value for s in SUBCHALLENGES]


class Encoder:
    def __init__(self, weights: list[tuple[np.ndarray, np.ndarray]] | None = None, seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = (len(FEATURE_NAMES), HIDDEN, HIDDEN, DIM)
        self.layers = weights or [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(sizes, sizes[1:], strict=False)]

    def forward(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0)
        return x

    def input_gradient(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """d (out . encoder(x)) / dx for rows of x."""
        masks = []
        for w, b in self.layers[:-1]:
            x = x @ w + b
            masks.append(x > 0)
            x = np.maximum(x, 0)
        g = np.broadcast_to(out @ self.layers[-1][0].T, (len(x), HIDDEN))
        for (w, _), m in zip(self.layers[-2::-1], masks[::-1], strict=True):
            g = (g * m) @ w.T
        return g


@dataclass
class TrainResult:
    router: MetaRouter
    train_losses: list[float] = field(default_factory=list)
    val_losses: list[float] = field(default_factory=list)
    n_train: int = 0
    n_val: int = 0


class MetaRouter:
    """heads: (configs * subchallenges) of precision (DIM, DIM), zy (DIM) and counts."""

    def __init__(self, encoder: Encoder | None = None, seed: int = 0):
        self.encoder, self.rng = encoder or Encoder(), np.random.default_rng(seed)
        n = (len(CONFIG_NAMES), len(SC_NAMES))
        self.precision, self.zy, self.counts = np.tile(np.eye(DIM), (*n, 1, 1)), np.zeros((*n, DIM)), np.zeros(n, int)
        self._posterior: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def n_heads(self) -> int:
        return self.counts.size

    def posterior(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and covariances of all heads."""
        if self._posterior is None:
            cov = np.linalg.inv(self.precision)
            cov = (cov + np.swapaxes(cov, -1, -2)) / 2
            self._posterior = np.einsum("csij,csj->csi", cov, self.zy), cov
        return self._posterior

    def update(self, features, config: str, sc: SubChallenge | str, reward: float) -> None:
        z = self.encoder.forward(np.asarray(features, float)[None])[0]
        c, s = CONFIG_NAMES.index(config), SC_NAMES.index(SubChallenge.parse(sc).value)
        self.precision[c, s] += np.outer(z, z)
        self.zy[c, s] += z * reward
        self.counts[c, s] += 1
        self._posterior = None

    def scores(self, features, sc: SubChallenge | str, explore: bool = False) -> dict[str, float]:
        z = self.encoder.forward(np.asarray(features, float)[None])[0]
        s = SC_NAMES.index(SubChallenge.parse(sc).value)
        mu, cov = self.posterior()
        theta = mu[:, s]
        if explore:
            theta = theta + np.einsum("cij,cj->ci", np.linalg.cholesky(cov[:, s] + JITTER * np.eye(DIM)), self.rng.standard_normal((len(CONFIG_NAMES), DIM)))
        return dict(zip(CONFIG_NAMES, (theta @ z).tolist(), strict=True))

    def predict(self, features, sc: SubChallenge | str, explore: bool = False) -> str:
        found = self.scores(features, sc, explore)
        return max(found, key=found.get)  # the first of equals

    def predict_all(self, features) -> dict[str, str]:
        return {s: self.predict(features, s) for s in SC_NAMES}

    def uncertainty(self, features, sc: SubChallenge | str) -> dict[str, float]:
        z = self.encoder.forward(np.asarray(features, float)[None])[0]
        s = SC_NAMES.index(SubChallenge.parse(sc).value)
        return dict(zip(CONFIG_NAMES, np.einsum("i,cij,j->c", z, self.posterior()[1][:, s], z).tolist(), strict=True))

    def thompson_total(self, features, allowed: list[str]) -> str:
        """The configuration whose sampled rewards, summed over subchallenges, are highest."""
        totals = {c: 0.0 for c in allowed}
        for s in SC_NAMES:
            found = self.scores(features, s, explore=True)
            for c in allowed:
                totals[c] += found[c]
        return max(totals, key=totals.get)

    def explain(self, features, sc: SubChallenge | str, config: str | None = None, n_steps: int = 50, right_ends: bool = False) -> dict[str, float]:
        """Integrated gradients of the head's mean score from a zero baseline; right_ends: the steps' ends only."""
        x = np.asarray(features, float)
        config = config or self.predict(x, sc)
        mu = self.posterior()[0][CONFIG_NAMES.index(config), SC_NAMES.index(SubChallenge.parse(sc).value)]
        alphas = np.arange(1, n_steps + 1) / n_steps if right_ends else np.arange(n_steps + 1) / n_steps
        return dict(zip(FEATURE_NAMES, (x * self.encoder.input_gradient(alphas[:, None] * x, mu).mean(0)).tolist(), strict=True))

    def select_table(self, features: DataFrame) -> DataFrame:
        """(tumour_id, features) to (tumour_id, sc, selected, score, uncertainty): all tumours at once."""
        encoder, (mu, cov) = self.encoder, self.posterior()

        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                z = encoder.forward(np.stack(b["features"].to_numpy()))
                score = np.einsum("csi,ni->nsc", mu, z)
                best = score.argmax(2)
                spread = np.einsum("ni,csij,nj->nsc", z, cov, z)
                n, s = best.shape
                at = np.arange(n)[:, None], np.arange(s)[None, :], best
                yield pd.DataFrame({"tumour_id": np.repeat(b["tumour_id"].to_numpy(), s), "sc": SC_NAMES * n, "selected": [CONFIG_NAMES[i] for i in best.ravel()], "score": score[at].ravel(), "uncertainty": spread[at].ravel()})

        return features.select("tumour_id", "features").mapInPandas(run, "tumour_id long, sc string, selected string, score double, uncertainty double")

    # --- storage ---

    def heads_table(self, spark: SparkSession, version: int = 0) -> DataFrame:
        rows = [(version, c, s, int(self.counts[i, j]), self.precision[i, j].ravel().tolist(), self.zy[i, j].tolist()) for i, c in enumerate(CONFIG_NAMES) for j, s in enumerate(SC_NAMES)]
        return spark.createDataFrame(rows, "version long, config string, sc string, n_updates long, precision array<double>, zy array<double>")

    def save(self, spark: SparkSession, path: str, version: int = 0) -> None:
        buffer = io.BytesIO()
        np.savez(buffer, **{f"{n}{i}": x for i, layer in enumerate(self.encoder.layers) for n, x in zip("wb", layer, strict=True)})
        self.heads_table(spark, version).coalesce(1).write.mode("overwrite").parquet(f"{path}/heads")
        spark.createDataFrame([(bytearray(buffer.getvalue()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/encoder")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MetaRouter:
        stored = np.load(io.BytesIO(bytes(spark.read.parquet(f"{path}/encoder").first()[0])))
        router = cls(Encoder([(stored[f"w{i}"], stored[f"b{i}"]) for i in range(3)]))
        router.take(spark.read.parquet(f"{path}/heads"))
        return router

    def take(self, heads: DataFrame) -> None:
        """Heads from a table: one row per (config, sc), 60 at most."""
        for r in heads.collect():
            c, s = CONFIG_NAMES.index(r.config), SC_NAMES.index(r.sc)
            self.precision[c, s], self.zy[c, s], self.counts[c, s] = np.reshape(r.precision, (DIM, DIM)), r.zy, r.n_updates
        self._posterior = None


def head_sums(encoded: DataFrame, by: list[str], z: str = "z", reward: str = "reward") -> DataFrame:
    """Sufficient statistics in long form: (by, i, j, zz), and zy and n per (by, i) in `head_vectors`."""
    rows = encoded.select(*by, F.posexplode(z).alias("i", "zi"), F.col(z).alias("all"))
    return rows.select(*by, "i", "zi", F.posexplode("all").alias("j", "zj")).groupBy(*by, "i", "j").agg(F.sum(F.col("zi") * F.col("zj")).alias("zz"))


def head_vectors(encoded: DataFrame, by: list[str], z: str = "z", reward: str = "reward") -> DataFrame:
    return encoded.select(*by, reward, F.posexplode(z).alias("i", "zi")).groupBy(*by, "i").agg(F.sum(F.col("zi") * F.col(reward)).alias("zy"), F.count("*").alias("n"))


def fill_heads(router: MetaRouter, corpus: DataFrame) -> None:
    """Adds a corpus (features, sc, config, score) to the heads: sums per partition, then one row per head."""
    encoder = router.encoder

    def run(batches):
        sums: dict[tuple[str, str], list] = {}
        for b in batches:
            if len(b):
                z = encoder.forward(np.stack(b["features"].to_numpy()))
                for key, at in b.groupby(["config", "sc"]).indices.items():
                    one = sums.setdefault(key, [0, 0.0, 0.0])
                    one[0] += len(at)
                    one[1] = one[1] + z[at].T @ z[at]
                    one[2] = one[2] + b["score"].to_numpy()[at] @ z[at]
        if sums:
            yield pd.DataFrame([(c, s, n, np.concatenate([zz.ravel(), zy]).tolist()) for (c, s), (n, zz, zy) in sums.items()], columns=["config", "sc", "n", "sums"])

    parts = corpus.select("features", "sc", "config", "score").mapInPandas(run, "config string, sc string, n long, sums array<double>")
    totals = parts.groupBy("config", "sc").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(DIM * DIM + DIM)]).alias("sums"))
    for r in totals.collect():
        c, s = CONFIG_NAMES.index(r.config), SC_NAMES.index(r.sc)
        router.precision[c, s] += np.reshape(r.sums[: DIM * DIM], (DIM, DIM))
        router.zy[c, s] += r.sums[DIM * DIM :]
        router.counts[c, s] += r.n
    router._posterior = None


def train_encoder(x: np.ndarray, y: np.ndarray, epochs: int = 50, batch: int = 256, rate: float = 1e-3, seed: int = 0, val: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Encoder, list[float], list[float]]:
    """Cross-entropy on the best configuration with a linear head on top, by Adam; dropout while training."""
    rng = np.random.default_rng(seed)
    encoder = Encoder(seed=seed)
    n = len(CONFIG_NAMES)
    params = [p for layer in encoder.layers for p in layer] + [rng.uniform(-1, 1, (DIM, n)) / np.sqrt(DIM), np.zeros(n)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def logits_of(q: np.ndarray) -> np.ndarray:
        return Encoder([(params[0], params[1]), (params[2], params[3]), (params[4], params[5])]).forward(q) @ params[6] + params[7]

    def loss_of(lg: np.ndarray, labels: np.ndarray) -> float:
        lg = lg - lg.max(1, keepdims=True)
        return float((np.log(np.exp(lg).sum(1)) - lg[np.arange(len(labels)), labels]).mean())

    losses, val_losses = [], []
    for _ in range(epochs):
        order, total, batches = rng.permutation(len(x)), 0.0, 0
        for lo in range(0, len(x), batch):
            xb, yb = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
            a1 = xb @ params[0] + params[1]
            d1 = (rng.random(a1.shape) >= DROPOUT) / (1 - DROPOUT)
            h1 = np.maximum(a1, 0) * d1
            a2 = h1 @ params[2] + params[3]
            d2 = (rng.random(a2.shape) >= DROPOUT) / (1 - DROPOUT)
            h2 = np.maximum(a2, 0) * d2
            z = h2 @ params[4] + params[5]
            lg = z @ params[6] + params[7]
            total += loss_of(lg, yb)
            batches += 1
            p = np.exp(lg - lg.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            gz = p @ params[6].T
            g2 = (gz @ params[4].T) * d2 * (a2 > 0)
            g1 = (g2 @ params[2].T) * d1 * (a1 > 0)
            grads = [xb.T @ g1, g1.sum(0), h1.T @ g2, g2.sum(0), h2.T @ gz, gz.sum(0), z.T @ p, p.sum(0)]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        losses.append(total / max(batches, 1))
        if val is not None and len(val[0]):
            val_losses.append(loss_of(logits_of(val[0]), val[1]))
    encoder.layers = [(params[0], params[1]), (params[2], params[3]), (params[4], params[5])]
    return encoder, losses, val_losses


#: Tumours whose (features, best configuration) rows come to the driver for the encoder.
ENCODER_ROWS = 200_000


def labelled(corpus: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and best configuration of each (tumour, sc): at most ENCODER_ROWS rows, the first by a seeded hash."""
    index = F.array_position(F.array(*map(F.lit, CONFIG_NAMES)), F.col("config"))
    top = F.max(F.struct("score", (-index).alias("minus"))).alias("t")
    rows = corpus.groupBy("tumour_id", "sc").agg(top, F.first("features").alias("features")).orderBy(F.xxhash64("tumour_id", "sc")).limit(ENCODER_ROWS).select("features", (-F.col("t.minus") - 1).alias("y")).collect()
    return np.array([r.features for r in rows], float).reshape(-1, len(FEATURE_NAMES)), np.array([r.y for r in rows], int)


def best_of(corpus: DataFrame) -> DataFrame:
    """(row_key, features, y): the best configuration of every (tumour, sc); the first of equals."""
    index = F.array_position(F.array(*map(F.lit, CONFIG_NAMES)), F.col("config"))
    top = F.max(F.struct("score", (-index).alias("minus"))).alias("t")
    return corpus.groupBy("tumour_id", "sc").agg(top, F.first("features").alias("features")).select(F.xxhash64("tumour_id", "sc").alias("row_key"), "features", (-F.col("t.minus") - 1).cast("int").alias("y"))


def _kept(keys: np.ndarray, layer: int, step: int, seed: int, width: int, dropout: float) -> np.ndarray:
    """A dropout mask that depends on the row and the step only, however rows are dealt to tasks."""
    if not dropout:
        return np.ones((len(keys), width))
    unit = np.stack([uniforms(keys, seed, step, layer, j) for j in range(width)], 1)
    return (unit >= dropout) / (1 - dropout)


def loss_and_gradient(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Summed cross-entropy of rows, and its gradient by the encoder's and the linear head's parameters."""
    a1 = x @ params[0] + params[1]
    h1 = np.maximum(a1, 0) * d1
    a2 = h1 @ params[2] + params[3]
    h2 = np.maximum(a2, 0) * d2
    z = h2 @ params[4] + params[5]
    lg = z @ params[6] + params[7]
    lg = lg - lg.max(1, keepdims=True)
    p = np.exp(lg)
    loss = float((np.log(p.sum(1)) - lg[np.arange(len(y)), y]).sum())
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    gz = p @ params[6].T
    g2 = (gz @ params[4].T) * d2 * (a2 > 0)
    g1 = (g2 @ params[2].T) * d1 * (a1 > 0)
    return loss, [x.T @ g1, g1.sum(0), h1.T @ g2, g2.sum(0), h2.T @ gz, gz.sum(0), z.T @ p, p.sum(0)]


def train_encoder_on(rows: DataFrame, epochs: int = 50, batches: int = 1, rate: float = 1e-3, seed: int = 0, dropout: float = DROPOUT) -> tuple[Encoder, list[float]]:
    """train_encoder over a table (row_key, features, y) of any size: no row comes to the driver. Each epoch deals the rows to
    `batches` steps by a hash of row and epoch; a step is one job, in which partitions sum gradients and Spark adds them up, so
    the driver gets one number per parameter. Dropout is drawn by row and step."""
    sc, encoder, n = rows.sparkSession.sparkContext, Encoder(seed=seed), len(CONFIG_NAMES)
    rng = np.random.default_rng(seed)
    params = [p for layer in encoder.layers for p in layer] + [rng.uniform(-1, 1, (DIM, n)) / np.sqrt(DIM), np.zeros(n)]
    m, v, losses, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], [], 0

    def summed(sent, step: int):
        def run(them):
            weights, total = sent.value, None
            for b in them:
                if len(b):
                    keys, x = b["row_key"].to_numpy(), np.stack(b["features"].to_numpy())
                    loss, grads = loss_and_gradient(weights, x, b["y"].to_numpy(), _kept(keys, 1, step, seed, HIDDEN, dropout), _kept(keys, 2, step, seed, HIDDEN, dropout))
                    one = np.concatenate([*[g.ravel() for g in grads], [loss, len(b)]])
                    total = one if total is None else total + one
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "g": total})

        return run

    for epoch in range(epochs):
        total, used = 0.0, 0
        for k in range(batches):
            step += 1
            sent = sc.broadcast(params)
            part = rows if batches == 1 else rows.where(F.pmod(F.xxhash64("row_key", F.lit(epoch)), F.lit(batches)) == k)
            got = part.mapInPandas(summed(sent, step), "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy()
            sent.destroy()
            if not len(got):
                continue
            total, used, at = total + got[-2] / got[-1], used + 1, 0
            for i, p in enumerate(params):
                g = got[at : at + p.size].reshape(p.shape) / got[-1]
                at += p.size
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = p - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        losses.append(float(total / max(used, 1)))
    encoder.layers = [(params[0], params[1]), (params[2], params[3]), (params[4], params[5])]
    return encoder, losses


def train_router_on(corpus: DataFrame, epochs: int = 50, batches: int = 1, seed: int = 0) -> TrainResult:
    """train_router without a bound on the encoder's rows."""
    rows = Scratch(corpus.sparkSession, "encoder").write(best_of(corpus), "rows")
    if not (count := rows.count()):
        return TrainResult(MetaRouter(seed=seed))
    encoder, losses = train_encoder_on(rows, epochs, batches, seed=seed)
    router = MetaRouter(encoder, seed)
    fill_heads(router, corpus)
    return TrainResult(router, losses, [], count, 0)


def train_router(corpus: DataFrame, val: DataFrame | None = None, epochs: int = 50, seed: int = 0) -> TrainResult:
    """Encoder on the corpus' labels, then the heads from all its rows. corpus: (tumour_id, features, sc, config, score)."""
    x, y = labelled(corpus)
    if not len(x):
        return TrainResult(MetaRouter(seed=seed))
    held = labelled(val) if val is not None else None
    encoder, losses, val_losses = train_encoder(x, y, epochs, min(256, len(x)), seed=seed, val=held)
    router = MetaRouter(encoder, seed)
    fill_heads(router, corpus)
    return TrainResult(router, losses, val_losses, len(x), 0 if held is None else len(held[0]))


def active_configs(exclude=DEFAULT_EXCLUDE_CONFIGS) -> list[str]:
    return [c for c in CONFIG_NAMES if c not in exclude]
