"""Evaluation protocols: out-of-fold prediction, stacking, nested validation, tuning."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.exprs import clip
from sparktab.functions.proba import BLEND_BOUNDS, METRIC_BOUNDS, Rule, apply_rule, logit_parts, normalize_parts, parts, rule_of
from sparktab.operators.ensemble import average, blend
from sparktab.operators.folds import confident_rows, fit_pool, stratified_folds, stratified_sample
from sparktab.operators.joins import model_cells, model_columns
from sparktab.operators.metrics import evaluate, score_labels
from sparktab.operators.search import nested_climb, search_rule
from sparktab.plans.learners import Logistic, Perceptron, boosted, fit_known, parallel, with_features
from sparktab.session import materialize


def fold_numbers(df: DataFrame, fold: str = "fold") -> list[int]:
    return sorted(r[0] for r in df.select(fold).distinct().collect())


def oof_predict(
    df: DataFrame, learner, k: int, model: str, test: DataFrame | None = None,
    test_mode: str = "average", pool: Callable[[DataFrame, int], DataFrame] | None = None,
    fold: str = "fold", threads: int = 4, seed: int = 42,
    metric: Callable[[DataFrame], DataFrame] | None = None, known: dict | None = None,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Predictions for every row by a model that never saw its fold.

    ``pool(df, f)`` chooses the training rows of fold f (default: all other folds). Test rows
    are averaged over the fold models or come from a refit on everything. The fits of
    different folds are submitted together. With ``metric`` its per-fold result is returned
    as well. Calls on the same rows and pools may share ``known``, which keeps what they find out
    about each fold's training rows (``learners.fit_known``).
    """
    shared = {} if known is None else known
    if "folds" not in shared:
        shared["folds"] = fold_numbers(df, fold)
    numbers = shared["folds"]
    choose = pool or (lambda rows, f: rows.where(F.col(fold) != f))
    about = [None if known is None else shared.setdefault(("pool", f), {}) for f in numbers]
    fitted = parallel([lambda f=f, a=a: fit_known(learner, choose(df, f), a) for f, a in zip(numbers, about)], threads)
    base = ["id", "y", fold]
    out: DataFrame | None = None
    for f, m in zip(numbers, fitted):
        part = m.proba(df.where(F.col(fold) == f)).select(*base, "p")
        out = part if out is None else out.unionByName(part)
    named = out.withColumns(
        {"model": F.lit(model), "split": F.lit("oof"), "seed": F.lit(seed)}
    )
    if test is not None:
        if test_mode == "refit":
            tested = learner.fit(df).proba(test).select("id", "p")
        else:
            all_folds: DataFrame | None = None
            for m in fitted:
                part = m.proba(test).select("id", "p")
                all_folds = part if all_folds is None else all_folds.unionByName(part)
            tested = average(all_folds, k, by=["id"], keep=[])
        named = named.unionByName(
            tested.withColumns(
                {"model": F.lit(model), "split": F.lit("test"), "seed": F.lit(seed)}
            ),
            allowMissingColumns=True,
        )
    return (named, metric(named.where(F.col("split") == "oof"))) if metric else named


def meta_frame(preds: DataFrame, models: Sequence[str], k: int, kind: str = "logit") -> DataFrame:
    """One row per id: ``features`` are logits or log probabilities of every model."""
    return _meta_features(model_columns(preds, models, keep=["y", "fold"], k=k), models, k, kind)


def _meta_features(wide: DataFrame, models: Sequence[str], k: int, kind: str) -> DataFrame:
    cols = []
    for m in models:
        if kind == "logit":
            cols += logit_parts(parts(m, k))
        elif kind == "log":
            cols += [F.ln(clip(c, *METRIC_BOUNDS)) for c in parts(m, k)]
        elif kind == "plain":
            cols += parts(m, k)
        else:
            raise ValueError("kind must be 'logit', 'log' or 'plain'")
    return with_features(wide, cols, ["id", "y", "fold"])


def stack(
    preds: DataFrame, models: Sequence[str], make_meta: Callable[[int], object], k: int,
    kind: str = "logit", seeds: Sequence[int] = (42,), folds: int = 5, rule: Rule | str = "bias",
    test: DataFrame | None = None, **search,
) -> tuple[DataFrame, list[float], DataFrame | None]:
    """Meta model on out-of-fold predictions.

    Per seed new stratified folds and one meta model per fold; the meta predictions are
    averaged over seeds, a decision rule is fitted on them, and test rows are predicted by a
    refit per seed. Returns meta predictions, rule parameters and test predictions.
    """
    frame = materialize(meta_frame(preds, models, k, kind).drop("fold"), "meta")
    return _stack(frame, models, make_meta, k, kind, seeds, folds, rule, test, **search)


def _stack(
    frame: DataFrame, models: Sequence[str], make_meta: Callable[[int], object], k: int, kind: str,
    seeds: Sequence[int], folds: int, rule: Rule | str, test: DataFrame | None = None, **search,
) -> tuple[DataFrame, list[float], DataFrame | None]:
    """``stack`` of rows with ``id``, ``y`` and ``features``, one for each id."""
    all_seeds: DataFrame | None = None
    tested: DataFrame | None = None
    test_frame = None
    if test is not None:
        test_frame = meta_frame(
            test.withColumns({"y": F.lit(0), "fold": F.lit(0)}), models, k, kind
        )
    known: dict = {}
    for seed in seeds:
        # A folder for each fold: fits and predictions read only the folds they need.
        rows = materialize(stratified_folds(frame, "id", "y", folds, seed), "meta-folds", ["fold"])
        one = oof_predict(rows, make_meta(seed), k, "meta", seed=seed)
        all_seeds = one if all_seeds is None else all_seeds.unionByName(one)
        if test_frame is not None:
            part = fit_known(make_meta(seed), frame, known).proba(test_frame).select("id", "p")
            tested = part if tested is None else tested.unionByName(part)
    # With one seed there is one row an id, so nothing is to be averaged.
    merged = average(all_seeds, k, by=["id"], keep=["y"]) if len(seeds) > 1 else all_seeds.select("id", "y", "p")
    merged = materialize(merged, "meta-oof")
    params, _ = search_rule(merged, "p", "y", k, rule, **search)
    final = average(tested, k, by=["id"], keep=[]) if tested is not None else None
    return merged, params, final


def nested_cv(
    frame: DataFrame, make_meta: Callable[[int], object], k: int, rule: Rule | str = "bias",
    inner: int = 5, seed: int = 42, fold: str = "fold", **search,
) -> DataFrame:
    """Labels for every outer fold from a meta model and a rule that never saw it.

    Inside each outer-train block new folds give inner predictions for the rule; the meta
    model is refitted on the whole block for the outer rows.
    """
    out: DataFrame | None = None
    for f in fold_numbers(frame, fold):
        train = frame.where(F.col(fold) != f).drop(fold)
        held = frame.where(F.col(fold) == f)
        rows = materialize(stratified_folds(train, "id", "y", inner, seed + f), "inner")
        inner_oof = materialize(
            oof_predict(rows, make_meta(seed), k, "inner", seed=seed), "inner-oof"
        )
        params, _ = search_rule(inner_oof, "p", "y", k, rule, **search)
        scored = make_meta(seed).fit(train).proba(held)
        part = scored.select("id", "y", fold, apply_rule("p", k, rule, params).alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def _one_row_each(preds: DataFrame, models: Sequence[str], fold: str, k: int | None = None) -> DataFrame | None:
    """(id, y, fold, an array for each model) from one exchange; an array is null where a model lacks the id.

    None if a model has several rows or an empty vector for an id, or the rows of an id are of several folds or
    labels, or of none. ``k`` as in ``joins.model_cells``.
    """
    aggs, made = model_cells(models, k)
    picked = preds.where(F.col("model").isin(list(models)))
    wide = picked.groupBy("id").agg(
        *[F.min(c).alias(c) for c in ("y", fold)], *[F.max(c).alias(f"__{c}_most") for c in ("y", fold)],
        *[F.count(c).alias(f"__{c}_n") for c in ("y", fold)], F.count(F.lit(1)).alias("__n"), *aggs,
    )
    checks = ["__n", *[f"__{c}_{end}" for c in ("y", fold) for end in ("most", "n")]]
    wide = materialize(wide.select("id", "y", fold, *checks, *made), "models")
    held = sum((F.col(m).isNotNull().cast("int") for m in models), F.lit(0))
    same = F.col("__n") == held
    for c in ("y", fold):
        same &= (F.col(c) == F.col(f"__{c}_most")) & (F.col(f"__{c}_n") == F.col("__n"))
    if not wide.where(~F.coalesce(same, F.lit(False))).isEmpty():
        return None
    return wide.select("id", "y", fold, *models)


def _blend_columns(wide: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """``blend`` of rows that have a column for each model: nothing moves."""
    size = sum(weights.values())
    used = weights if size > 0 else dict.fromkeys(weights, 1.0)
    size = sum(used.values())
    used = {m: w for m, w in used.items() if w}
    sums = [sum((F.lit(float(w)) / F.lit(size) * parts(m, k)[i] for m, w in used.items()), F.lit(0.0)) for i in range(k)]
    mixed = wide.dropna(subset=list(used)).select("id", "y", *[c.alias(f"__p{i}") for i, c in enumerate(sums)])
    p = normalize_parts([F.col(f"__p{i}") for i in range(k)], BLEND_BOUNDS)
    return mixed.select("id", "y", F.array(*p).alias("p"))


def _level_one(
    preds: DataFrame, models: Sequence[str], metas: dict,
    held: DataFrame | None, k: int, inner: int, seed: int, wide: bool,
) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold predictions of every meta on the training block, and its refit on ``held``.

    ``metas`` maps a name to ``(feature kind, learner factory)`` or ``('climb', options)``. With ``wide`` the rows
    have a column for each model (``_one_row_each``), else they are the long table.
    """
    oofs: DataFrame | None = None
    helds: DataFrame | None = None
    block = preds.dropna(subset=list(models)).select("id", "y", *models) if wide else model_columns(preds, models, keep=["y"], k=k)
    # All metas share the folds.
    rows = materialize(stratified_folds(block, "id", "y", inner, seed), "level1-folds")
    for name, (kind, made) in metas.items():
        if kind == "climb":
            weights, _, _ = nested_climb(rows, models, "y", k, "fold", seed=seed, **made)
            members = None if wide else preds.drop("fold").join(rows.select("id", "fold"), "id")
            part = None
            for f in fold_numbers(rows):
                chosen = dict(zip(models, weights[f]))
                if wide:
                    # As in a join on the key, rows without one are left out.
                    mixed = _blend_columns(rows.where((F.col("fold") == f) & F.col("id").isNotNull()), chosen, k)
                else:
                    mixed = blend(members.where(F.col("fold") == f), chosen, k)
                part = mixed if part is None else part.unionByName(mixed)
            if held is not None:
                chosen = dict(zip(models, weights[None]))
                after = _blend_columns(held, chosen, k) if wide else blend(held, chosen, k)
        else:
            framed = _meta_features(rows, models, k, kind)
            part = oof_predict(framed, made(seed), k, name).select("id", "y", "p")
            if held is not None:
                if wide:
                    held_frame = _meta_features(held.dropna(subset=list(models)).withColumn("fold", F.lit(0)), models, k, kind)
                else:
                    held_frame = meta_frame(held, models, k, kind)
                after = made(seed).fit(framed).proba(held_frame).select("id", "y", "p")
        part = part.select("id", "y", "p").withColumn("model", F.lit(name))
        oofs = part if oofs is None else oofs.unionByName(part)
        if held is not None:
            after = after.select("id", "y", "p").withColumn("model", F.lit(name))
            helds = after if helds is None else helds.unionByName(after)
    return materialize(oofs, "level1"), materialize(helds, "level1-held") if held is not None else None


def _level_two(kind, train: DataFrame, apply: DataFrame, names: Sequence[str], k: int):
    """Level-2 predictions: the metas' mean, or a logistic model on their log probabilities."""
    if kind == "mean":
        weights = dict.fromkeys(names, 1.0)
        return blend(train, weights, k), blend(apply, weights, k)

    def frame(rows):
        return meta_frame(rows.withColumn("fold", F.lit(0)), names, k, "log")

    block = materialize(frame(train), "level2-frame")
    fitted = Logistic(k, c=kind).fit(block)
    return fitted.proba(block), fitted.proba(frame(apply))


def multi_level(
    preds: DataFrame, models: Sequence[str], metas: dict, k: int,
    level2: Sequence = ("mean", 1.0, 0.3), rules: Sequence[Rule | str] = ("bias", "scale_shift"),
    inner: int = 5, seed: int = 42, fold: str = "fold", **search,
) -> pd.DataFrame:
    """Naive and nested balanced accuracy for every level-2 model and decision rule.

    By protocol the level-2 rule is fitted on the level-2 output of its own
    training block; only the outer fold is honest. The models of an id meet once; blocks, folds and blends
    are made from that table, unless ids have several rows of a model or several folds.
    """
    names = list(metas)
    each = _one_row_each(preds, models, fold, k)
    table = preds if each is None else each
    oof, _ = _level_one(table, models, metas, None, k, inner, seed, each is not None)
    naive: dict = {}
    for kind in level2:
        rows, _ = _level_two(kind, oof, oof, names, k)
        rows = materialize(rows.select("id", "y", "p"), "level2")
        for rule in rules:
            naive[(str(kind), rule)] = search_rule(rows, "p", "y", k, rule, **search)[1]
    labels: dict = {key: [] for key in naive}
    for f in fold_numbers(preds, fold):
        held = table.where(F.col(fold) == f)
        rest = table.where(F.col(fold) != f)
        block, after = _level_one(rest, models, metas, held, k, inner, seed + f, each is not None)
        for kind in level2:
            rows, scored = _level_two(kind, block, after, names, k)
            rows = materialize(rows.select("id", "y", "p"), "level2-block")
            for rule in rules:
                params, _ = search_rule(rows, "p", "y", k, rule, **search)
                pred = scored.select("y", apply_rule("p", k, rule, params).alias("pred"))
                labels[(str(kind), rule)].append(pred)
    out = []
    for (kind, rule), parts_ in labels.items():
        together = parts_[0]
        for p in parts_[1:]:
            together = together.unionByName(p)
        nested = score_labels(together, "y", "pred", k).first()["balanced_accuracy"]
        out.append((kind, rule_of(rule).name, naive[(kind, rule)], nested, naive[(kind, rule)] - nested))
    return pd.DataFrame(out, columns=["level2", "rule", "naive", "nested", "gap"])


def pseudo_label_train(
    train: DataFrame, test: DataFrame, learner, k: int, threshold: float = 0.995,
    cap: int | None = None, pseudo_weight: float = 0.1, aux: DataFrame | None = None,
    aux_weight: float = 0.3, external: DataFrame | None = None, fold: str = "fold",
) -> DataFrame:
    """Out-of-fold predictions of models that also learn from confident test rows.

    Pseudo labels of fold f come from a model of the other folds only, so no validation
    label reaches them. ``external`` labels are not fold-safe: the result is then flagged
    ``optimistic``.
    """
    out: DataFrame | None = None
    for f in fold_numbers(train, fold):
        if external is not None:
            marked = test.join(external.select("id", "y"), "id")
        else:
            known = fit_pool(train, f, "y", aux, aux_weight, fold_col=fold, balanced=False)
            first = learner.fit(known.select("id", "features", "y", "w"))
            scored = materialize(first.proba(test).select("id", "features", "p"), "scored")
            sure = confident_rows(scored, "id", "p", k, threshold, cap)
            marked = sure.select("id", "features", F.col("label").alias("y"))
        marked = materialize(marked.select("id", "features", "y"), "pseudo")
        pool = fit_pool(
            train, f, "y", aux, aux_weight, marked, pseudo_weight, fold, balanced=False
        )
        second = learner.fit(pool.select("id", "features", "y", "w"))
        part = second.proba(train.where(F.col(fold) == f)).select("id", "y", fold, "p")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("optimistic", F.lit(external is not None))


# Meta settings that are tried in order: kind, standardize, strength (fixed values).
META_GRID = (
    ("logistic", False, 1.0), ("logistic", True, 1.0), ("logistic", True, 3.0),
    ("logistic", True, 0.5), ("logistic", False, 3.0), ("mlp", True, 1e-3),
)


def meta_learner(kind: str, scale: bool, c: float, k: int, seed: int = 42, iters: int = 100):
    if kind == "logistic":
        return Logistic(k, c=c, scale=scale, seed=seed, iters=iters)
    if kind == "mlp":
        return Perceptron(k, hidden=(64, 32), seed=seed, iters=iters)
    if kind == "boosted":
        return boosted(k, rounds=iters, depth=3, step=0.03, min_rows=20, seed=seed)
    raise ValueError(f"unknown meta kind {kind!r}")


def tune_meta(
    frame: DataFrame, k: int, grid: Sequence[tuple] = META_GRID, rule: Rule | str = "bias", iters: int = 100, **search
) -> pd.DataFrame:
    """Balanced accuracy before and after the rule for every meta setting, best first.

    ``frame`` has ``features``, ``y``, ``fold``. The settings share the scaling and the class sizes of
    each fold's training rows.
    """
    rows = []
    known: dict = {}
    for kind, scale, c in grid:
        oof = materialize(
            oof_predict(frame, meta_learner(kind, scale, c, k, iters=iters), k, "meta", known=known), "tune"
        )
        plain = evaluate(oof, "y", "p", k).first()["balanced_accuracy"]
        _, ruled = search_rule(oof, "p", "y", k, rule, **search)
        rows.append((kind, scale, float(c), plain, ruled))
    table = pd.DataFrame(rows, columns=["kind", "scale", "c", "plain", "ruled"])
    return table.sort_values("ruled", ascending=False, kind="stable", ignore_index=True)


def select_subset(
    preds: DataFrame, subsets: dict[str, Sequence[str]], k: int, make_meta: Callable[[int], object],
    kind: str = "log", folds: int = 5, rule: Rule | str = "bias", **search,
) -> pd.DataFrame:
    """Score named model subsets with the meta learner, best first.

    The models of an id meet once for all subsets, unless ids have several rows of a model.
    """
    rows = []
    each = _one_row_each(preds, list(dict.fromkeys(m for models in subsets.values() for m in models)), "fold", k)
    for name, models in subsets.items():
        if each is None:
            made = meta_frame(preds, models, k, kind)
        else:
            made = _meta_features(each.dropna(subset=list(models)), models, k, kind)
        frame = materialize(made.drop("fold"), "meta")
        oof, params, _ = _stack(frame, models, make_meta, k, kind, (42,), folds, rule, **search)
        plain = evaluate(oof, "y", "p", k).first()["balanced_accuracy"]
        labelled = oof.withColumn("pred", apply_rule("p", k, rule, params))
        ruled = score_labels(labelled, "y", "pred", k).first()
        rows.append((name, len(models), plain, ruled["balanced_accuracy"],
                     *[ruled[f"recall_{c}"] for c in range(k)]))
    cols = ["subset", "models", "plain", "ruled", *[f"recall_{c}" for c in range(k)]]
    return pd.DataFrame(rows, columns=cols).sort_values(
        "ruled", ascending=False, kind="stable", ignore_index=True
    )


# Search ranges of the booster: kind, low, high (fixed values).
BOOSTER_SPACE = {
    "depth": ("int", 4, 12),
    "step": ("log", 0.02, 0.1),
    "min_rows": ("int", 10, 200),
    "subsample": ("float", 0.6, 1.0),
}


def draw(space: dict, rng: random.Random) -> dict:
    """One setting: integers and floats uniform, ``log`` ranges uniform in the logarithm."""
    out = {}
    for name, (kind, lo, hi) in space.items():
        if kind == "int":
            out[name] = rng.randint(lo, hi)
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
        else:
            out[name] = rng.uniform(lo, hi)
    return out


def random_search(
    df: DataFrame, k: int, make: Callable[[dict], object], space: dict, trials: int, folds: int = 3,
    rows: int | None = None, seed: int = 42,
) -> pd.DataFrame:
    """Cross-validated balanced accuracy of random settings, best first.

    ``rows`` limits the search (not the final model) to a stratified sample.
    """
    picked = materialize(stratified_sample(df, "id", "y", rows, seed), "sample") if rows else df
    folded = materialize(stratified_folds(picked, "id", "y", folds, seed), "search")
    rng = random.Random(seed)
    found = []
    for trial in range(trials):
        setting = draw(space, rng)
        oof = oof_predict(folded, make(setting), k, f"trial{trial}")
        found.append((trial, evaluate(oof, "y", "p", k).first()["balanced_accuracy"], setting))
    table = pd.DataFrame(found, columns=["trial", "score", "setting"])
    return table.sort_values("score", ascending=False, kind="stable", ignore_index=True)


def ablation(variants: dict[str, DataFrame], make: Callable[[], object], k: int) -> pd.DataFrame:
    """The same protocol on feature variants; best by log loss, then macro F1.

    Every variant has ``id``, ``y``, ``fold`` and ``features``.
    """
    rows = []
    for name, frame in variants.items():
        found = evaluate(oof_predict(frame, make(), k, name), "y", "p", k).first()
        rows.append((name, found["log_loss"], found["macro_f1"], found["balanced_accuracy"]))
    table = pd.DataFrame(rows, columns=["variant", "log_loss", "macro_f1", "balanced_accuracy"])
    table["order"] = np.round(table["log_loss"], 12)
    table = table.sort_values(
        ["order", "macro_f1"], ascending=[True, False], kind="stable", ignore_index=True
    )
    return table.drop(columns="order")


def pipeline(
    frame: DataFrame, learners: dict[str, Callable[[int], object]], k: int, path: str,
    seeds: Sequence[int] = (42,), folds: int = 5, steps: int = 5, log_path: str | None = None,
    recipe: str = "all",
) -> pd.DataFrame:
    """Per seed: folds, out-of-fold predictions of every learner, blend weights, class bias,
    a named snapshot and a log record."""
    from sparktab.operators.search import search_blend_weights
    from sparktab.sources.predictions import read_preds, snapshot, write_preds
    from sparktab.sources.records import RECORD, append_experiment

    spark = frame.sparkSession
    names = list(learners)
    rows = []
    for seed in seeds:
        folded = materialize(stratified_folds(frame, "id", "y", folds, seed), "pipeline", ["fold"])
        for name, make in learners.items():
            write_preds(oof_predict(folded, make(seed), k, name, seed=seed), path, k)
        current = read_preds(spark, path).where(F.col("split") == "oof")
        # One table serves both searches, unless ids have several rows of a model.
        each = _one_row_each(current, names, "fold", k)
        if each is None:
            wide = materialize(model_columns(current, names, k=k), "pipeline-wide")
        else:
            wide = each.dropna(subset=names)
        weights, before = search_blend_weights(wide, names, "y", k, steps, 2)
        chosen = dict(zip(names, weights))
        if each is None:
            mixed = materialize(blend(current, chosen, k), "pipeline-blend")
        else:
            mixed = _blend_columns(each, chosen, k)
        bias, after = search_rule(mixed, "p", "y", k, "bias", generations=2, population=12, seed=seed)
        snapshot(spark, path, f"seed{seed}")
        rows.append((seed, before, after, weights, bias))
        if log_path:
            record = [(
                None, f"seed{seed}", seed, recipe, ",".join(names), after, before, None, None, None,
                None, {n: float(w) for n, w in zip(names, weights)},
                {str(i): float(b) for i, b in enumerate(bias)}, False, None, None, None,
            )]
            append_experiment(spark.createDataFrame(record, RECORD), log_path)
    return pd.DataFrame(rows, columns=["seed", "before_bias", "after_bias", "weights", "bias"])
