"""A trainable pixel model: gradients summed over partitions, checkpoints as a table, the best one promoted and restored.

The model scores every pixel from its features (light, colours, contrast with near and far surroundings, top-hat, gradient),
standardised by the training patches' own means and deviations, by one hidden layer or by none. The loss of a patch is half
cross entropy, half one minus its soft Dice; a step's is the mean over its patches.

An epoch's patches come in the sampler's batches (weighted draws or a permutation), written once an epoch by batch. A step reads its
batch alone; each task adds up its patches' gradients and sends one row for each parameter sum, which meet in an aggregate with
map-side sums, so what reaches the driver is as long as the parameters, whatever the table's size. The driver keeps the parameters and
the optimiser's two moments.

Each epoch ends with a row of the checkpoint table: a run that stops goes on after its last row. The learning rate is cut and training stopped
by the rules of the recorded histories: strict improvement, patience, least number of epochs.

Defined cases: patches without pixels or mask are passed over; a batch without patches is no step; without any patch there is
nothing to train and an error says so; of equal epochs the first is the best.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import raster as K
from tessera.functions.graph import shared
from tessera.functions.kernels import pieces
from tessera.operators.engine import KEY, image
from tessera.operators.sampling import epoch_batches, weighted_batches
from tessera.registry import query
from tessera.sources.fixtures import duck, predictions

THRESHOLDS = np.linspace(0.3, 0.7, 41)
SMOOTH = 1.0


@dataclass(frozen=True)
class Training:
    epochs: int = 150
    batch: int = 256  #: patches a step
    rate: float = 0.02
    decay: float = 1e-5
    hidden: int = 12
    cross_entropy: float = 0.5
    dice: float = 0.5
    patience: int = 15
    least_epochs: int = 85
    plateau: int = 7
    factor: float = 0.5
    least_rate: float = 1e-7
    better: float = 1e-4  #: relative rise that the plateau rule takes for one
    seed: int = 42


def features(bgr: np.ndarray) -> np.ndarray:
    """Pixels by features."""
    gray = K.gray_of(bgr).astype(float)
    ok = gray > K.BORDER_GRAY
    ratio, _ = K.contrast_ratio(gray, ok, 30.0)
    planes = [gray, *np.moveaxis(bgr.astype(float), 2, 0), K.blur(gray, 2.0) - gray, K.blur(gray, 8.0) - gray, K.top_hat(gray, (4, 8), 2.0, 18.0), 255 * ratio, K.gradient(gray)]
    return np.stack([p.reshape(-1) for p in planes], axis=1) / 255


N_FEATURES = 9


@dataclass
class Model:
    """Parameters in one array: first layer, its offsets, second layer, its offset (only the last two without a hidden layer)."""

    theta: np.ndarray
    hidden: int
    mean: np.ndarray
    std: np.ndarray
    threshold: float = 0.5
    epoch: int = -1

    def parts(self):
        f, h = len(self.mean), self.hidden
        if not h:
            return None, None, self.theta[:f], self.theta[f]
        a = f * h
        return self.theta[:a].reshape(f, h), self.theta[a : a + h], self.theta[a + h : a + 2 * h], self.theta[-1]

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last layer's input and the logits of raw features."""
        w, b, v, c = self.parts()
        z = (x - self.mean) / self.std
        a = np.tanh(z @ w + b) if self.hidden else z
        return a, a @ v + c

    def gradient(self, x: np.ndarray, a: np.ndarray, dz: np.ndarray) -> np.ndarray:
        """Of a loss whose derivative by each logit is ``dz``."""
        _, _, v, _ = self.parts()
        if not self.hidden:
            return np.r_[a.T @ dz, dz.sum()]
        da = np.outer(dz, v) * (1 - a * a)
        return np.r_[(((x - self.mean) / self.std).T @ da).reshape(-1), da.sum(axis=0), a.T @ dz, dz.sum()]

    def score(self, bgr: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(features(bgr))[1]).reshape(bgr.shape[:2])

    def scorer(self):
        """A scorer of lists of patches, as the engine takes them."""
        return lambda batch: [self.score(p) for p in batch]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def patch_loss(model: Model, x: np.ndarray, y: np.ndarray, t: Training) -> tuple[float, np.ndarray]:
    """Loss of a patch (features, mask of 0 and 1) and its gradient."""
    a, z = model.logits(x)
    p = sigmoid(z)
    both, total = float((p * y).sum()), float(p.sum() + y.sum())
    entropy = float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).mean())
    dice = (2 * both + SMOOTH) / (total + SMOOTH)
    dz = t.cross_entropy * (p - y) / len(y)
    dz -= t.dice * (2 * y * (total + SMOOTH) - (2 * both + SMOOTH)) / (total + SMOOTH) ** 2 * p * (1 - p)
    return t.cross_entropy * entropy + t.dice * (1 - dice), model.gradient(x, a, dz)


# ---- sums over partitions

def summed(patches: DataFrame, kernel, size: int) -> np.ndarray:
    """The sum over all patches of the kernel's array of ``size`` numbers: one partial array a task, then partial sums by place."""

    def run(batches):
        total, some = np.zeros(size), False
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                if r["px"] is not None and r["mask"] is not None:
                    total += r.get("times", 1) * kernel(r)
                    some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["place", "value"])

    sums = patches.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # as many rows as places
    out = np.zeros(size)
    for r in sums:
        out[r.place] = r.value
    return out


def _truth(r: dict) -> np.ndarray:
    return (np.frombuffer(r["mask"], "u1") > 0).astype(float)


def feature_scale(patches: DataFrame, of=features, n: int = N_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the features over all pixels."""

    def kernel(r: dict) -> np.ndarray:
        x = of(image(r))
        return np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]

    s = summed(patches, kernel, 1 + 2 * n)
    if not s[0]:
        raise ValueError("no patches to train on")
    mean = s[1 : n + 1] / s[0]
    return mean, np.sqrt(np.maximum(s[n + 1 :] / s[0] - mean**2, 1e-8))


def gradient_sums(patches: DataFrame, model: Model, t: Training) -> tuple[int, float, np.ndarray]:
    """Patches (by their ``times``), mean loss and mean gradient."""

    def kernel(r: dict) -> np.ndarray:
        loss, g = patch_loss(model, features(image(r)), _truth(r), t)
        return np.r_[1, loss, g]

    s = summed(patches, kernel, 2 + len(model.theta))
    return int(s[0]), float(s[1] / max(1, s[0])), s[2:] / max(1, s[0])


def sweep(patches: DataFrame, model: Model) -> tuple[np.ndarray, float]:
    """Dice over all pixels at each of THRESHOLDS, and at a half, from histograms of the probabilities."""
    edges = np.sort(np.r_[THRESHOLDS, 0.5 + 1e-12])

    def kernel(r: dict) -> np.ndarray:
        p, y = model.score(image(r)).reshape(-1), _truth(r)
        at = np.searchsorted(edges, p, side="right")  # thresholds up to the probability
        return np.r_[np.bincount(at, minlength=len(edges) + 1), np.bincount(at, weights=y, minlength=len(edges) + 1), y.sum()]

    n = len(edges) + 1
    s = summed(patches, kernel, 2 * n + 1)
    above = lambda h: h[::-1].cumsum()[::-1][1:]
    found, both = above(s[:n]), above(s[n : 2 * n])
    dice = (2 * both + 1e-6) / (found + s[-1] + 1e-6)
    half = int(np.searchsorted(edges, 0.5 + 1e-12))
    return np.delete(dice, half), float(dice[half])


# ---- training

CHECKPOINT = "epoch int, loss double, val_dice double, rate double, threshold double, best_epoch int, best_dice double, stale int, peak double, steps long, hidden int, theta array<double>, first array<double>, second array<double>, mean array<double>, std array<double>"


@dataclass
class State:
    model: Model
    first: np.ndarray
    second: np.ndarray
    rate: float
    steps: int = 0
    best_epoch: int = -1
    best_dice: float = 0.0
    stale: int = 0
    peak: float = -1.0
    history: list = field(default_factory=list)

    def step(self, g: np.ndarray, t: Training) -> None:
        """Adam with decoupled decay."""
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        scale = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        self.model.theta = self.model.theta * (1 - self.rate * t.decay) - self.rate * scale * self.first / (np.sqrt(self.second) + 1e-8)

    def judge(self, epoch: int, dice: float, t: Training) -> bool:
        """Takes in an epoch's value: best so far, plateau; whether training stops here."""
        if dice > self.best_dice:
            self.best_epoch, self.best_dice = epoch, dice
        if self.peak < 0 or dice > self.peak * (1 + t.better):
            self.peak, self.stale = dice, 0
        else:
            self.stale += 1
            if self.stale > t.plateau:
                self.rate, self.stale = max(self.rate * t.factor, t.least_rate), 0
        return self.stops(epoch, t)

    def stops(self, epoch: int, t: Training) -> bool:
        return epoch - self.best_epoch >= t.patience and epoch >= t.least_epochs


def fresh(mean: np.ndarray, std: np.ndarray, t: Training) -> State:
    n, h = len(mean), t.hidden
    rng = np.random.default_rng(t.seed)
    theta = np.r_[rng.normal(0, 1 / np.sqrt(n), n * h), np.zeros(h), rng.normal(0, 1 / np.sqrt(h), h), 0.0] if h else np.zeros(n + 1)
    return State(Model(theta, h, mean, std), np.zeros(len(theta)), np.zeros(len(theta)), t.rate)


def _save(spark: SparkSession, at: str, epoch: int, loss: float, dice: float, s: State) -> None:
    m = s.model
    row = (epoch, loss, dice, s.rate, m.threshold, s.best_epoch, s.best_dice, s.stale, s.peak, s.steps, m.hidden, *[x.tolist() for x in (m.theta, s.first, s.second, m.mean, m.std)])
    spark.createDataFrame([row], CHECKPOINT).coalesce(1).write.mode("overwrite").parquet(f"{at}/checkpoints/at={epoch:06d}")


def checkpoints(spark: SparkSession, at: str) -> DataFrame:
    """A row an epoch; none before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/checkpoints")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CHECKPOINT)
    return spark.read.schema(CHECKPOINT).parquet(f"{at}/checkpoints")


def _state(r, t: Training | None = None) -> State:
    m = Model(np.array(r.theta), r.hidden, np.array(r.mean), np.array(r.std), r.threshold, r.epoch)
    return State(m, np.array(r.first), np.array(r.second), r.rate, r.steps, r.best_epoch, r.best_dice, r.stale, r.peak)


def load_model(spark: SparkSession, at: str, which: str | int = "best") -> Model:
    """The promoted model (``best``), that of the last epoch (``last``), or of an epoch; with its own threshold."""
    if which == "best":
        rows = spark.read.schema(CHECKPOINT).parquet(f"{at}/model").collect()
    else:
        c = checkpoints(spark, at)
        rows = (c.sort(F.desc("epoch")).limit(1) if which == "last" else c.filter(F.col("epoch") == which)).collect()
    if not rows:
        raise FileNotFoundError(f"no model {which!r} under {at}")
    return _state(rows[0]).model


def promote(spark: SparkSession, at: str) -> DataFrame:
    """Copies the best checkpoint to ``model``."""
    best = checkpoints(spark, at).sort(F.desc("val_dice"), "epoch").limit(1)
    shared(best).coalesce(1).write.mode("overwrite").parquet(f"{at}/model")
    return spark.read.schema(CHECKPOINT).parquet(f"{at}/model")


def fit(train: DataFrame, val: DataFrame, at: str, t: Training = Training(), weight: Column | None = None, augment=None) -> DataFrame:
    """Trains on ``train`` (patch_id, key, px, mask), judges by ``val``; returns the history (epoch, loss, val_dice, rate, threshold).

    Checkpoints are under ``at``; what is there is gone on with. ``weight`` draws patches in proportion; ``augment`` is a function
    of (patches, epoch) that gives an epoch's views.
    """
    spark = train.sparkSession
    last = checkpoints(spark, at).sort(F.desc("epoch")).limit(1).collect()
    columns = list(dict.fromkeys(["patch_id", *KEY, "h", "w", "bands", "px", "mask", *[c for c in ("coverage_pct",) if c in train.columns]]))
    train = train.select(columns)
    if last:
        s, start = _state(last[0]), last[0].epoch + 1
    else:
        s, start = fresh(*feature_scale(train), t), 0
    n = train.count()
    for epoch in range(start, t.epochs):
        if epoch and s.stops(epoch - 1, t):
            break
        views = augment(train, epoch) if augment else train
        if n <= t.batch and weight is None:
            batches = [views]
        else:
            draw = weighted_batches(train.select("patch_id", "coverage_pct") if "coverage_pct" in columns else train.select("patch_id"), "patch_id", weight, t.batch, epoch, t.seed, drop_last=n >= t.batch) if weight is not None else epoch_batches(train, "patch_id", t.batch, epoch, t.seed)
            times = draw.groupBy("patch_id", "batch").agg(F.count("*").alias("times"))
            path = f"{at}/epoch"
            views.join(times, "patch_id").write.mode("overwrite").partitionBy("batch").parquet(path)
            laid = spark.read.parquet(path)
            batches = [laid.filter(F.col("batch") == k) for k in range(-(-n // t.batch) if n < t.batch else n // t.batch)]
        losses = []
        for b in batches:
            size, loss, g = gradient_sums(b, s.model, t)
            if size:
                s.step(g, t)
                losses.append(loss)
        dice, half = sweep(val, s.model)
        s.model.threshold = float(THRESHOLDS[int(dice.argmax())])
        stop = s.judge(epoch, half, t)
        _save(spark, at, epoch, float(np.mean(losses)) if losses else 0.0, half, s)
        if stop:
            break
    promote(spark, at)
    return checkpoints(spark, at).select("epoch", "loss", "val_dice", "rate", "threshold").sort("epoch")


# ---- on the fixtures

_SLOPE, _SHIFT = 1.5, -0.25


@query("k02_gradient_sums", duck("pred", f"WITH z AS (SELECT pid, (p - 0.5) / 0.25 AS x, CAST(truth AS INT) AS y, {_SLOPE} * ((p - 0.5) / 0.25) + ({_SHIFT}) AS z FROM fx_pred), q AS (SELECT *, 1 / (1 + exp(-z)) AS s FROM z), i AS (SELECT pid, 2 * sum(s * y) + 1 AS a, sum(s + y) + 1 AS b, avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS e FROM q GROUP BY pid), d AS (SELECT q.pid, x, 0.5 * (s - y) / 64 - 0.5 * (2 * y * b - a) / (b * b) * s * (1 - s) AS dz FROM q JOIN i USING (pid)), g AS (SELECT pid, sum(dz * x) AS gw, sum(dz) AS gb FROM d GROUP BY pid) SELECT count(*) AS patches, round(avg(0.5 * e + 0.5 * (1 - a / b)), 6) AS loss, round(avg(gw), 6) AS slope, round(avg(gb), 6) AS shift FROM i JOIN g USING (pid)"))
def k02_gradients(spark, sf):
    """One step's loss and gradient over all patches: a linear model of one feature, the fixture's own probability."""
    p = predictions(spark, sf).select(F.transform("v", lambda e: e["p"]).alias("px"), F.transform("v", lambda e: e["truth"].cast("int")).alias("mask"))
    model, t = Model(np.array([_SLOPE, _SHIFT]), 0, np.array([0.5]), np.array([0.25])), Training()

    def run(batches):
        total = np.zeros(4)
        for b in pieces(batches):
            for px, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                loss, g = patch_loss(model, np.array(px)[:, None], np.array(mask, float), t)
                total += np.r_[1, loss, g]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], ["n", "loss", "slope", "shift"])

    s = p.mapInArrow(run, "n double, loss double, slope double, shift double").agg(*[F.sum(c).alias(c) for c in ("n", "loss", "slope", "shift")])
    return s.select(F.col("n").cast("bigint").alias("patches"), *[F.round(F.col(c) / F.col("n"), 6).alias(c) for c in ("loss", "slope", "shift")])
