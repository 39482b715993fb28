"""Unsupervised detectors: fitted on a bounded sample on the driver, scored on the executors in Arrow batches."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a fit takes at most; the samples below are drawn from these.
MOST_FIT_ROWS = 200_000


def first_rows(df: DataFrame, key: str, columns: list[str], most: int = MOST_FIT_ROWS) -> np.ndarray:
    """The `most` rows that come first by key, as a matrix."""
    rows = df.select(key, *columns).orderBy(key).limit(most).toPandas()
    return np.nan_to_num(rows[columns].to_numpy(np.float64), nan=0.0, posinf=0.0, neginf=0.0)


def drawn_rows(df: DataFrame, key: str, columns: list[str], most: int, seed: int = 42) -> np.ndarray:
    """The `most` rows that come first by a hash of the key, as a matrix: a uniform draw that repeats."""
    rows = df.select(key, *columns).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most).toPandas()
    return np.nan_to_num(rows[columns].to_numpy(np.float64), nan=0.0, posinf=0.0, neginf=0.0)


@dataclass
class IsolationForest:
    """Isolation trees over samples of 256 rows (or fewer); score = 2 ** -(mean depth / expected depth), near 1 for outliers."""

    trees: int = 300
    sample: int = 256
    seed: int = 42
    nodes: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    used: int = 0

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        self.used, self.nodes = min(self.sample, len(x)), []
        limit = int(np.ceil(np.log2(max(2, self.used))))
        for _ in range(self.trees):
            rows = x[rng.choice(len(x), self.used, replace=False)] if len(x) else x
            feature, cut, left, right, size = [], [], [], [], []

            def grow(part: np.ndarray, depth: int) -> int:
                at = len(feature)
                for a, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (size, len(part))):
                    a.append(v)
                if depth < limit and len(part) > 1:
                    lo, hi = part.min(0), part.max(0)
                    vary = np.flatnonzero(hi > lo)
                    if len(vary):
                        f = int(rng.choice(vary))
                        c = float(rng.uniform(lo[f], hi[f]))
                        below = part[:, f] < c
                        if below.any() and not below.all():
                            feature[at], cut[at] = f, c
                            left[at] = grow(part[below], depth + 1)
                            right[at] = grow(part[~below], depth + 1)
                return at

            grow(rows, 0)
            self.nodes.append(tuple(np.array(a) for a in (feature, cut, left, right, size)))
        return self

    @staticmethod
    def _expected(n: np.ndarray) -> np.ndarray:
        n = np.asarray(n, np.float64)
        out = np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, size in self.nodes:
            at, depth = np.zeros(len(x), np.int64), np.zeros(len(x))
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                a = at[inner]
                at[inner] = np.where(x[inner, f[inner]] < cut[a], left[a], right[a])
                depth[inner] += 1
            total += depth + self._expected(size[at])
        return 2.0 ** -(total / max(1, len(self.nodes)) / max(1e-9, float(self._expected(np.array([max(2, self.used)]))[0])))

    def to_json(self) -> str:
        return json.dumps({"kind": "isolation_forest", "used": self.used, "nodes": [[a.tolist() for a in t] for t in self.nodes]})


@dataclass
class OneClassSVM:
    """Schölkopf's one-class machine with an RBF kernel, solved by pairwise steps (SMO) over at most 20,000 rows; score = rho - f(x)."""

    nu: float = 0.05
    gamma: float | str = "scale"
    most: int = 20_000
    tolerance: float = 1e-3
    support: np.ndarray | None = None
    weights: np.ndarray | None = None
    rho: float = 0.0

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-self.gamma * np.maximum(d, 0))

    def fit(self, x: np.ndarray) -> OneClassSVM:
        if len(x) > self.most:
            raise ValueError(f"more than {self.most} rows")
        if self.gamma == "scale":
            v = float(x.var())
            self.gamma = 1.0 / (x.shape[1] * v) if v > 0 else 1.0
        n, top = len(x), 1.0
        bound = self.nu * n
        alpha = np.zeros(n)
        alpha[: int(bound)] = top
        if int(bound) < n:
            alpha[int(bound)] = bound - int(bound)
        gradient = np.zeros(n)
        for i in range(0, n, 1000):
            on = np.flatnonzero(alpha)
            gradient[i : i + 1000] = self._kernel(x[i : i + 1000], x[on]) @ alpha[on]
        for _ in range(200 * n):
            up, down = alpha < top - 1e-12, alpha > 1e-12
            i = int(np.argmin(np.where(up, gradient, np.inf)))
            j = int(np.argmax(np.where(down, gradient, -np.inf)))
            if gradient[j] - gradient[i] < self.tolerance:
                break
            k = self._kernel(x[[i, j]], x)
            step = min((gradient[j] - gradient[i]) / max(1e-12, 2 - 2 * k[0, j]), top - alpha[i], alpha[j])
            alpha[i] += step
            alpha[j] -= step
            gradient += step * (k[0] - k[1])
        free = (alpha > 1e-9) & (alpha < top - 1e-9)
        self.rho = float(gradient[free].mean()) if free.any() else float((gradient[alpha > 1e-9].max() + gradient[alpha < top - 1e-9].min()) / 2)
        on = alpha > 1e-9
        self.support, self.weights = x[on], alpha[on]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.rho - self._kernel(x, self.support) @ self.weights


@dataclass
class SGDOneClassSVM:
    """The linear one-class machine by stochastic gradient steps with averaging of the learning rate; score = -(w x - rho)."""

    nu: float = 0.01
    epochs: int = 20
    seed: int = 42
    w: np.ndarray | None = None
    offset: float = 0.0

    def fit(self, x: np.ndarray) -> SGDOneClassSVM:
        rng, alpha = np.random.default_rng(self.seed), self.nu / 2
        w, b, t = np.zeros(x.shape[1]), 1.0, 1.0
        start = 1.0 / (alpha * max(1.0, np.sqrt(1.0 / np.sqrt(alpha))))
        for _ in range(self.epochs):
            for i in rng.permutation(len(x)):
                rate = 1.0 / (alpha * (start + t - 1))
                inside = float(x[i] @ w) + b <= 1.0
                w *= max(0.0, 1.0 - rate * alpha)
                if inside:
                    w += rate * x[i]
                    b += rate
                b -= rate * 2 * alpha
                t += 1
        self.w, self.offset = w, 1.0 - b
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.offset - x @ self.w


def score_rows(df: DataFrame, columns: list[str], model, name: str) -> DataFrame:
    """df with the model's score of columns; values that aren't finite count as 0."""
    shared = df.sparkSession.sparkContext.broadcast(_state(model))

    @F.pandas_udf("double")
    def score(*parts: pd.Series) -> pd.Series:
        kind, state = shared.value
        m = {"IsolationForest": IsolationForest, "OneClassSVM": OneClassSVM, "SGDOneClassSVM": SGDOneClassSVM}[kind]()
        m.__dict__.update(state)
        x = np.stack([p.to_numpy(np.float64) for p in parts], axis=1)
        return pd.Series(m.score(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)))

    return df.withColumn(name, score(*[F.col(c).cast("double") for c in columns]))


def _state(model) -> tuple[str, dict]:
    return type(model).__name__, dict(vars(model))
