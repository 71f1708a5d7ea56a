"""Class-probability learners on distributed Spark ML estimators.

A learner has ``fit(df)`` and the fitted object ``proba(df)``, which adds ``p``, an
``array<double>`` over ``k`` classes. Rows carry ``features`` (vector), ``y`` (0..k-1) and
optionally ``w`` (a source weight that multiplies the class weight).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.functions.exprs import finite, hash_text
from sparktab.functions.proba import cascade_compose, ovr_combine
from sparktab.operators.encoders import class_weights
from sparktab.operators.folds import balanced_sample
from sparktab.operators.metrics import auc


def with_features(df: DataFrame, cols: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """``features`` vector from numeric columns; missing, NaN and infinite values count as 0."""
    cells = [
        F.coalesce(finite((F.col(c) if isinstance(c, str) else c).cast("double")), F.lit(0.0)) for c in cols
    ]
    return df.select(*keep, array_to_vector(F.array(*cells)).alias("features"))


def parallel(jobs: Sequence[Callable], threads: int) -> list:
    """Run independent fits from driver threads, so that their tasks share the cluster."""
    if threads <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    session = SparkSession.active()
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(session)(job)(), jobs))


def fit_known(learner, df: DataFrame, known: dict | None):
    """``learner.fit(df)``; ``known`` holds what learners found out about the same rows before.

    That is the number of rows a class and the scaling of the features, which do not depend on a learner's settings.
    """
    return learner.fit(df, known) if known is not None and getattr(learner, "shares", False) else learner.fit(df)


def _scaler(df: DataFrame, known: dict | None):
    """Fitted scaling of ``features`` to ``__f``."""
    found = {} if known is None else known
    if "scaler" not in found:
        found["scaler"] = StandardScaler(inputCol="features", outputCol="__f", withMean=True).fit(df)
    return found["scaler"]


def _weighted(
    df: DataFrame, balanced: bool, factors: dict | None = None, known: dict | None = None
) -> tuple[DataFrame, float]:
    """Rows with the weight ``__w`` and the total weight, from one count per class."""
    own = F.col("w") if "w" in df.columns else F.lit(1.0)
    found = {} if known is None else known
    if "sizes" not in found:
        # One row per class: classes are a fixed, small domain.
        found["sizes"] = df.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("mass")).collect()
    sizes = found["sizes"]
    rows = sum(r["n"] for r in sizes)
    weights = {
        r["y"]: (rows / (len(sizes) * r["n"]) if balanced else 1.0) * (factors or {}).get(r["y"], 1.0)
        for r in sizes
    }
    out = class_weights(df, "y", fixed=weights, out="__w").withColumn("__w", F.col("__w") * own)
    mass = sum(weights[r["y"]] * r["mass"] for r in sizes)
    return out.withColumn("y", F.col("y").cast("double")), mass


class _Fitted:
    """A fitted pipeline; classes the training rows lacked get probability 0."""

    def __init__(self, model, k: int):
        self.model, self.k = model, k

    def proba(self, df: DataFrame) -> DataFrame:
        helpers = ["__f", "rawPrediction", "probability", "prediction"]
        scored = self.model.transform(df)
        values = vector_to_array("probability")
        p = F.array(*[F.coalesce(F.get(values, F.lit(i)), F.lit(0.0)) for i in range(self.k)])
        return scored.withColumn("p", p).drop(*[c for c in helpers if c in scored.columns])


# Up to this many coefficients a logistic model is a column expression.
MAX_LINEAR_TERMS = 256


class _FittedLogistic(_Fitted):
    """Scores as column expressions of the model's coefficients: a vector is unpacked once and none is built."""

    def __init__(self, model, k: int):
        super().__init__(model, k)
        *scaling, fitted = model.stages
        w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
        self.w, self.b, self.shift = w, b, None
        if scaling:
            std = scaling[0].std.toArray()
            self.shift = [(float(m), 1.0 / float(s) if s != 0 else 0.0) for m, s in zip(scaling[0].mean.toArray(), std)]
        # Models of one class have infinite intercepts.
        self.short = w.size <= MAX_LINEAR_TERMS and bool(np.isfinite(w).all() and np.isfinite(b).all())

    def proba(self, df: DataFrame) -> DataFrame:
        if not self.short:
            return super().proba(df)
        n, width = self.w.shape
        rows = df.withColumn("__v", vector_to_array("features"))
        cells = [F.col("__v")[j] for j in range(width)]
        if self.shift is not None:
            cells = [(x - F.lit(m)) * F.lit(s) for x, (m, s) in zip(cells, self.shift)]
        rows = rows.withColumns({f"__v{j}": x for j, x in enumerate(cells)})
        raw = [
            sum((F.lit(float(c)) * F.col(f"__v{j}") for j, c in enumerate(row)), F.lit(0.0)) + F.lit(float(bias))
            for row, bias in zip(self.w, self.b)
        ]
        rows = rows.withColumns({f"__r{i}": x for i, x in enumerate(raw)})
        top = F.greatest(*[F.col(f"__r{i}") for i in range(n)])
        rows = rows.withColumns({f"__e{i}": F.exp(F.col(f"__r{i}") - top) for i in range(n)})
        mass = sum((F.col(f"__e{i}") for i in range(1, n)), F.col("__e0"))
        p = F.array(*[F.col(f"__e{i}") / mass if i < n else F.lit(0.0) for i in range(self.k)])
        helpers = ["__v", *[f"__v{j}" for j in range(width)], *[f"__{c}{i}" for c in "re" for i in range(n)]]
        return rows.withColumn("p", p).drop(*helpers)


@dataclass(frozen=True)
class Logistic:
    """Multinomial logistic regression with L2 strength ``c`` in the usual convention:
    the penalty is ``1/(c * sum of weights)`` because the loss here is a weighted mean."""

    k: int
    c: float = 1.0
    scale: bool = False
    balanced: bool = True
    iters: int = 100
    seed: int = 42
    shares = True

    def fit(self, df: DataFrame, known: dict | None = None) -> _Fitted:
        rows, mass = _weighted(df, self.balanced, known=known)
        stages = []
        if self.scale:
            stages.append(_scaler(df, known))
        stages.append(
            LogisticRegression(
                family="multinomial", featuresCol="__f" if self.scale else "features", labelCol="y",
                weightCol="__w", regParam=1.0 / (self.c * mass), standardization=False,
                maxIter=self.iters,
            )
        )
        return _FittedLogistic(Pipeline(stages=stages).fit(rows), self.k)


@dataclass(frozen=True)
class Forest:
    """Random forest, class balanced. ``extra=True`` weakens every tree (one random feature
    per split, half the rows) in place of extremely randomized splits."""

    k: int
    trees: int = 500
    depth: int = 10
    extra: bool = False
    seed: int = 42

    def fit(self, df: DataFrame) -> _Fitted:
        model = RandomForestClassifier(
            featuresCol="features", labelCol="y", weightCol="__w", numTrees=self.trees,
            maxDepth=self.depth, seed=self.seed,
            featureSubsetStrategy="1" if self.extra else "auto",
            subsamplingRate=0.5 if self.extra else 1.0,
        )
        return _Fitted(Pipeline(stages=[model]).fit(_weighted(df, True)[0]), self.k)


@dataclass(frozen=True)
class Perceptron:
    """Small network on standardized features. It takes no weights, so classes are evened
    out by sampling each down to ``per_class`` rows when that is given."""

    k: int
    hidden: tuple[int, ...] = (128, 64)
    iters: int = 100
    per_class: int | None = None
    key: str = "id"
    seed: int = 42
    shares = True

    def fit(self, df: DataFrame, known: dict | None = None) -> _Fitted:
        rows = df
        if self.per_class is not None:
            rows, known = balanced_sample(df, self.key, "y", self.per_class, self.seed), None
        width = len(rows.select("features").first()[0])
        stages = [
            _scaler(rows, known),
            MultilayerPerceptronClassifier(
                featuresCol="__f", labelCol="y", layers=[width, *self.hidden, self.k],
                maxIter=self.iters, seed=self.seed,
            ),
        ]
        return _Fitted(Pipeline(stages=stages).fit(rows), self.k)


# Booster settings: depth stands for the leaf counts 15, 31 and 63 (fixed values).
PRESETS = {
    "small": {"depth": 4, "step": 0.05, "min_rows": 50, "subsample": 0.8},
    "medium": {"depth": 5, "step": 0.05, "min_rows": 20, "subsample": 0.8},
    "large": {"depth": 6, "step": 0.1, "min_rows": 10, "subsample": 0.8},
}


def preset(name: str) -> dict:
    """Settings the caller names. They were tuned on fewer than 10,000 rows, fewer than 100,000, and more."""
    return dict(PRESETS[name])


def refit_rounds(best: Sequence[int], cap: int, default: int) -> int:
    """Rounds of the final refit: a tenth more than the folds' mean, at most ``cap``."""
    if not best:
        return default
    return min(int(sum(best) / len(best) * 1.1), cap)


@dataclass(frozen=True)
class Binary:
    """Gradient-boosted trees for a 0/1 label, early stopping on a hashed share of rows."""

    rounds: int = 200
    depth: int = 5
    step: float = 0.05
    min_rows: int = 20
    subsample: float = 0.8
    stop_share: float = 0.1
    key: str = "id"
    seed: int = 42
    balanced: bool = True

    def fit(self, df: DataFrame, label: Column) -> _FittedBinary:
        rows, _ = _weighted(df.withColumn("y", label.cast("int")), self.balanced)
        settings = {}
        if self.stop_share > 0:
            drawn = F.conv(F.substring(hash_text(self.key, self.seed), 1, 6), 16, 10).cast("long")
            rows = rows.withColumn("__stop", drawn < int(self.stop_share * 16**6))
            settings["validationIndicatorCol"] = "__stop"
        model = GBTClassifier(
            featuresCol="features", labelCol="y", weightCol="__w", maxIter=self.rounds,
            maxDepth=self.depth, stepSize=self.step, minInstancesPerNode=self.min_rows,
            subsamplingRate=self.subsample, seed=self.seed, **settings,
        )
        return _FittedBinary(model.fit(rows))


class _FittedBinary:
    def __init__(self, model):
        self.model = model

    @property
    def rounds(self) -> int:
        return self.model.getNumTrees

    def score(self, df: DataFrame, out: str) -> DataFrame:
        scored = self.model.transform(df)
        return scored.withColumn(out, vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction"
        )


@dataclass(frozen=True)
class OneVsRest:
    """One binary model per class against the rest, rows normalized afterwards.

    ``weights='ratio'`` gives positives ``n_neg/n_pos``; ``'balanced'`` balances both sides;
    ``factors`` multiply the weight of a class's rows (the specialist).
    """

    k: int
    binary: Binary = Binary()
    weights: str = "balanced"
    factors: dict | None = None
    threads: int = 3

    def fit(self, df: DataFrame) -> _FittedOneVsRest:
        rows = df
        if self.factors:
            base = class_weights(df, "y", 1.0, self.factors, out="__f")
            w = F.col("__f") * F.col("w") if "w" in df.columns else F.col("__f")
            rows = base.withColumn("w", w).drop("__f")
            binary = replace(self.binary, balanced=False)
        else:
            binary = self.binary
        jobs = [self._job(binary, rows, c) for c in range(self.k)]
        return _FittedOneVsRest(parallel(jobs, self.threads), self.k)

    def _job(self, binary: Binary, rows: DataFrame, c: int) -> Callable:
        def run():
            if self.weights == "ratio" and not self.factors:
                from sparktab.operators.encoders import one_vs_rest_weight

                marked = one_vs_rest_weight(rows, "y", c, "__r")
                w = F.col("__r") * F.col("w") if "w" in rows.columns else F.col("__r")
                return replace(binary, balanced=False).fit(
                    marked.withColumn("w", w).drop("__r"), F.col("y") == c
                )
            return binary.fit(rows, F.col("y") == c)

        return run


class _FittedOneVsRest:
    def __init__(self, models: list[_FittedBinary], k: int):
        self.models, self.k = models, k

    @property
    def rounds(self) -> list[int]:
        return [m.rounds for m in self.models]

    def proba(self, df: DataFrame) -> DataFrame:
        out = df
        for c, m in enumerate(self.models):
            out = m.score(out, f"__p{c}")
        names = [f"__p{c}" for c in range(self.k)]
        return out.withColumn("p", ovr_combine([F.col(n) for n in names])).drop(*names)


def boosted(k: int, preset_name: str | None = None, **settings) -> OneVsRest:
    """Boosted multiclass learner with a named preset, if any; ``settings`` come first."""
    chosen = {**(preset(preset_name) if preset_name is not None else {}), **settings}
    return OneVsRest(k, Binary(**chosen))


def specialist(k: int, factors: dict, **settings) -> OneVsRest:
    """Boosted learner whose class weights are multiplied: the confused pair up, the rest down."""
    return OneVsRest(k, Binary(**settings), factors=factors)


@dataclass(frozen=True)
class Cascade:
    """Three classes in two steps: one class against the rest, then the rest against each other.

    Without ``first`` a probe fit decides: the candidate with the better area under the curve
    on held-out rows, the first candidate unless another is better by more than 1e-4.
    """

    k: int = 3
    binary: Binary = Binary()
    first: int | None = None
    candidates: tuple[int, ...] = (2, 1)
    probe_rounds: int = 5

    def probe(self, df: DataFrame) -> int:
        drawn = F.conv(F.substring(hash_text(self.binary.key, 7), 1, 6), 16, 10).cast("long")
        marked = df.withColumn("__held", drawn < 16**6 // 5)
        rows, held = marked.where(~F.col("__held")), marked.where(F.col("__held"))
        quick = replace(self.binary, rounds=self.probe_rounds)
        areas = {}
        for c in self.candidates:
            model = quick.fit(rows, F.col("y") == c)
            scored = model.score(held.withColumn("__t", (F.col("y") == c).cast("int")), "__s")
            areas[c] = auc(scored, "__t", "__s").first()["auc"] or 0.0
        chosen = self.candidates[0]
        for c in self.candidates[1:]:
            if areas[c] > areas[chosen] + 1e-4:
                chosen = c
        return chosen

    def fit(self, df: DataFrame) -> _FittedCascade:
        first = self.probe(df) if self.first is None else self.first
        a, b = [c for c in range(3) if c != first]
        rest = df.where(F.col("y") != first)
        one, two = parallel(
            [
                lambda: self.binary.fit(df, F.col("y") == first),
                lambda: self.binary.fit(rest, F.col("y") == a),
            ],
            2,
        )
        return _FittedCascade(one, two, first, a, b)


class _FittedCascade:
    def __init__(self, one, two, first: int, a: int, b: int):
        self.one, self.two, self.first, self.a, self.b = one, two, first, a, b

    def proba(self, df: DataFrame) -> DataFrame:
        out = self.two.score(self.one.score(df, "__q1"), "__q2")
        p = cascade_compose(F.col("__q1"), F.col("__q2"), self.first, self.a, self.b)
        return out.withColumn("p", p).drop("__q1", "__q2")
