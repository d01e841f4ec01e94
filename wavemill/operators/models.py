"""Folds, closed-form and library classifiers, single-feature and feature-set rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import broadcast_if_small, exact_quantiles, fresh, materialize, numbered
from . import candidates, codebank, metrics, neighbors


def shuffle_key(id_col: str, seed: int) -> Column:
    """A deterministic random order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def shuffled(df: DataFrame, *, id_col: str = "snippet_id", seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(id_col, seed), id_col)


def sample_rows(df: DataFrame, n: int, *, id_col: str = "snippet_id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, ordered by id."""
    return df.orderBy(shuffle_key(id_col, seed), id_col).limit(n).orderBy(id_col)


def balanced_sample(df: DataFrame, per_class: int, *, id_col: str = "snippet_id", label_col: str = "class_label", seed: int = 42) -> DataFrame:
    """The first ``per_class`` rows of every class in shuffled order; partial limits come before the shuffle."""
    r = fresh("r", df)
    w = W.partitionBy(label_col).orderBy(shuffle_key(id_col, seed), id_col)
    # a limit on the row number is kept per task first, so at most per_class rows of a class and task are moved
    return df.withColumn(r, F.row_number().over(w)).where(F.col(r) <= per_class).drop(r)


def _class_order(id_col: str, seed: int | None) -> list[Column]:
    return [F.col(id_col)] if seed is None else [shuffle_key(id_col, seed), F.col(id_col)]


def stratified_folds(df: DataFrame, k: int = 5, *, id_col: str = "snippet_id", label_col: str = "class_label", seed: int | None = 42) -> DataFrame:
    """``df`` with a fold number 0..k-1, equal within each class; in id order without a seed.

    The result is a written table: models read it once per fold.
    """
    r = fresh("r", df)
    return materialize(numbered(df, r, by=[label_col], order=_class_order(id_col, seed)).withColumn("fold", ((F.col(r) - 1) % k).cast("int")).drop(r))


def holdout_split(df: DataFrame, share: float = 0.25, *, id_col: str = "snippet_id", label_col: str = "class_label", seed: int = 42) -> DataFrame:
    """``df`` with ``is_test``: the first ``share`` of each class in shuffled order. The result is a written table."""
    r, n, key = fresh("r", df), fresh("n", df), fresh("key", df)
    rows = numbered(df, r, by=[label_col], order=_class_order(id_col, seed))
    sizes = df.groupBy(F.col(label_col).alias(key)).agg(F.count(F.lit(1)).alias(n))  # a row per class
    told = rows.join(broadcast_if_small(sizes, 100_000), F.col(label_col).eqNullSafe(F.col(key)))
    return materialize(told.withColumn("is_test", F.col(r) <= F.round(F.col(n) * share)).drop(r, n, key))


def standardized(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns shifted and scaled by mean and population deviation; constant columns become 0."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    return df.withColumns({c: (F.col(c) - row[f"m_{c}"]) / row[f"s_{c}"] if row[f"s_{c}"] else F.lit(0.0) for c in names})


# --- classifiers ------------------------------------------------------------------------------------
#
# A fit takes a training table in which column ``held`` numbers the model a row belongs to (a row may occur for
# several), and gives one score column per model; predicted is a score of 0.5 or more. Cross-validation thus fits
# all folds in the same passes.

Fits = dict[int, Column]
HELD = "held"


def _vector(names: list[str]) -> Column:
    return F.array(*[F.col(c) for c in names])


def _moments(train: DataFrame, names: list[str], label: str) -> dict[int, dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    """Per model and class: count, mean and population covariance, in two passes.

    The first gives the means of the table; the second adds up products of what
    is left after them, in numpy per task, so that no digits cancel.
    """
    d = len(names)
    center = np.array([float(x or 0.0) for x in train.agg(*[F.avg(c) for c in names]).first()])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            x = np.column_stack([pdf[names].to_numpy(float) - center, np.ones(len(pdf))])
            key = pdf[[HELD, label]].to_numpy()
            for m, y in np.unique(key, axis=0).tolist():
                own = x[(key[:, 0] == m) & (key[:, 1] == y)]
                held[m, y] = held.get((m, y), 0) + own.T @ own
        yield pd.DataFrame([(m, y, h.ravel()) for (m, y), h in held.items()], columns=[HELD, "y", "sums"], dtype=object)

    rows = train.select(*names, label, HELD).mapInPandas(sums, f"{HELD} long, y long, sums array<double>")
    found: dict = {}
    for r in rows.select(HELD, "y", F.posexplode("sums").alias("pos", "v")).groupBy(HELD, "y", "pos").agg(F.sum("v").alias("v")).collect():  # models x classes x features squared
        found.setdefault((r[HELD], r["y"]), np.zeros((d + 1) * (d + 1)))[r["pos"]] = r["v"]
    out: dict = {}
    for (m, y), v in found.items():
        v = v.reshape(d + 1, d + 1)
        n, mean = v[d, d], v[d, :d] / v[d, d]
        out.setdefault(int(m), {})[int(y)] = (int(n), mean + center, v[:d, :d] / n - np.outer(mean, mean))
    return out


def _linear(names: list[str], weights: np.ndarray, bias: float) -> Column:
    z = F.lit(float(bias))
    for c, w in zip(names, weights):
        z = z + F.col(c) * float(w)
    return 1 / (1 + F.exp(-z))


def nearest_centroid(train: DataFrame, names: list[str], label: str) -> Fits:
    out = {}
    for model, m in _moments(train, names, label).items():
        d0, d1 = (sum((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(names, m[k][1])) for k in (0, 1))
        out[model] = 1 / (1 + F.exp(d1 - d0))
    return out


def lda(train: DataFrame, names: list[str], label: str) -> Fits:
    """Gaussian classes with pooled covariance; means and covariances by aggregation, the solve on the driver."""
    out = {}
    for model, m in _moments(train, names, label).items():
        n = sum(x[0] for x in m.values())
        pooled = sum(x[0] * x[2] for x in m.values()) / max(1, n - len(m))
        inverse = np.linalg.pinv(pooled)
        w = inverse @ (m[1][1] - m[0][1])
        bias = -0.5 * (m[1][1] @ inverse @ m[1][1] - m[0][1] @ inverse @ m[0][1]) + np.log(m[1][0] / m[0][0])
        out[model] = _linear(names, w, bias)
    return out


def qda(train: DataFrame, names: list[str], label: str) -> Fits:
    def log_density(n: int, mean: np.ndarray, cov: np.ndarray) -> Column:
        cov = cov * n / max(1, n - 1)
        inverse, (_, logdet) = np.linalg.pinv(cov), np.linalg.slogdet(cov + 1e-12 * np.eye(len(names)))
        total = F.lit(float(np.log(n) - 0.5 * logdet))
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                total = total - 0.5 * float(inverse[i, j]) * (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j]))
        return total

    return {model: 1 / (1 + F.exp(log_density(*m[0]) - log_density(*m[1]))) for model, m in _moments(train, names, label).items()}


def _weighted_sums(train: DataFrame, names: list[str], label: str, weights: dict[int, np.ndarray], step: Callable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per model the sums of weight * x x' and weight * target * x, x with a constant 1 at the end.

    ``step(z, y)`` gives weight and target of rows with margin z. Tasks add up
    their rows in numpy; what is moved is one vector per task and model.
    """
    d = len(names) + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {m: np.zeros((d, d + 1)) for m in weights}
        for pdf in batches:
            x, y, model = np.column_stack([pdf[names].to_numpy(float), np.ones(len(pdf))]), pdf[label].to_numpy(float), pdf[HELD].to_numpy()
            for m in np.unique(model).tolist():
                xm, ym = x[model == m], y[model == m]
                w, t = step(xm @ weights[m], ym)
                held[m] += xm.T @ np.column_stack([xm * w[:, None], w * t])
        yield pd.DataFrame({HELD: list(held), "sums": [h.ravel() for h in held.values()]})

    rows = train.select(*names, label, HELD).mapInPandas(sums, f"{HELD} long, sums array<double>")
    total = rows.select(HELD, F.posexplode("sums").alias("pos", "v")).groupBy(HELD, "pos").agg(F.sum("v").alias("v")).collect()  # models x features squared
    out = {m: np.zeros(d * (d + 1)) for m in weights}
    for r in total:
        out[r[HELD]][r["pos"]] = r["v"]
    return {m: (v.reshape(d, d + 1)[:, :d], v.reshape(d, d + 1)[:, d]) for m, v in out.items()}


def _iterated(train: DataFrame, names: list[str], label: str, step: Callable, solve: Callable, max_iter: int) -> dict[int, np.ndarray]:
    """Repeats weighted sums and solves until no weight of any model moves by 1e-6; models that are done stay as they are."""
    weights = {int(r[HELD]): np.zeros(len(names) + 1) for r in train.select(HELD).distinct().collect()}  # a row per model
    moving = dict(weights)
    for _ in range(max_iter):
        for m, (h, g) in _weighted_sums(train.where(F.col(HELD).isin(list(moving))), names, label, moving, step).items():
            new = solve(h, g)
            if np.abs(new - weights[m]).max() < 1e-6:
                del moving[m]
            else:
                moving[m] = new
            weights[m] = new
        if not moving:
            break
    return weights


def logistic(train: DataFrame, names: list[str], label: str, *, c: float = 1.0, max_iter: int = 25) -> Fits:
    """Logistic regression with an L2 penalty on all but the intercept, by Newton steps of one pass each."""
    ridge = np.diag([1.0] * len(names) + [0.0])

    def step(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-9)
        return w, z + (y - p) / w

    fitted = _iterated(train, names, label, step, lambda h, g: np.linalg.lstsq(c * h + ridge, c * g, rcond=None)[0], max_iter)
    return {m: _linear(names, w[:-1], w[-1]) for m, w in fitted.items()}


def linear_svm(train: DataFrame, names: list[str], label: str, *, c: float = 1.0, max_iter: int = 50) -> Fits:
    """Linear machine with squared hinge loss and L2 penalty: each step solves for the rows inside the margin."""

    def step(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = 2 * y - 1
        return (side * z < 1).astype(float), side

    fitted = _iterated(train, names, label, step, lambda h, g: np.linalg.lstsq(2 * c * h + np.eye(len(g)), 2 * c * g, rcond=None)[0], max_iter)
    return {m: _linear(names, w[:-1], w[-1]) for m, w in fitted.items()}


def code_bank(train: DataFrame, names: list[str], label: str, *, n_bins: int = 10) -> Fits:
    """The population code of the positive rows; quantiles of all models and features from one exact ranking."""
    long = train.where(F.col(label) == 1).select(HELD, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([HELD], names, "feature", "value")
    found: dict = {}
    for r in exact_quantiles(long, [b / (n_bins - 1) for b in range(n_bins)], by=[HELD, "feature"], value="value").collect():  # a row per model and feature
        found.setdefault(int(r[HELD]), {})[r["feature"]] = r["quantiles"]
    return {m: codebank.score(codebank.from_centers(names, centers)) for m, centers in found.items()}


def threshold_rule(train: DataFrame, names: list[str], label: str, *, polarity: int = 1) -> Fits:
    """One feature against the threshold of the largest J, as a soft score of 0.5 at the threshold."""
    x = F.col(names[0]) * polarity
    rows = metrics.best_threshold(train.select(HELD, x.alias("score"), F.col(label).alias("class_label")), by=[HELD]).collect()
    return {int(r[HELD]): 1 / (1 + F.exp(-(x - float(r["threshold"])))) for r in rows}


Fit = Callable[[DataFrame, list[str], str], Fits]
KNN = "knn_k5"
# The names of the models, which configurations use.
MODELS: dict[str, Fit | None] = {
    "threshold_weight_bank": code_bank,
    "nearest_centroid": nearest_centroid,
    "lda": lda,
    "qda": qda,
    "logistic_regression": logistic,
    "linear_svm": linear_svm,
    KNN: None,  # has no score column: neighbours are searched
    "threshold_rule": threshold_rule,
}
RANKED_MODELS = ["threshold_weight_bank", "nearest_centroid", "lda", "logistic_regression", "linear_svm", KNN]
SCOREBOARD_MODELS = ["threshold_weight_bank", "lda", "logistic_regression", KNN]
_ALIASES = {
    "centroid": "nearest_centroid", "logistic": "logistic_regression", "logreg": "logistic_regression", "svm": "linear_svm", "knn": KNN,
    "code_bank": "threshold_weight_bank", "weight_bank": "threshold_weight_bank", "threshold_code_bank": "threshold_weight_bank", "threshold": "threshold_rule",
}


def model_name(name: str) -> str:
    """The name of a model given by name or alias (case, spaces and hyphens do not matter)."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    key = _ALIASES.get(key, key)
    if key not in MODELS:
        raise ValueError(f"unknown model {name!r}; choose from {sorted(MODELS)}")
    return key


def fit_one(train: DataFrame, names: list[str], model: str | Fit, label: str = "class_label") -> Column:
    """The score column of one model fitted on all of ``train``."""
    fit = MODELS[model_name(model)] if isinstance(model, str) else model
    if fit is None:
        raise ValueError(f"{KNN} has no score column; use cross_validated or neighbors.knn_classify")
    return fit(train.withColumn(HELD, F.lit(0).cast("long")), names, label)[0]


def cross_validated(df: DataFrame, names: list[str], model: str | Fit, *, k: int = 5, label: str = "class_label", id_col: str = "snippet_id") -> DataFrame:
    """Out-of-fold scores of a table with ``fold``: the input with score and predicted. All folds are fitted together."""
    if isinstance(model, str) and model_name(model) == KNN:
        votes = neighbors.fold_votes(df.withColumn("__v", _vector(names)), 5, id_col=id_col, vector_col="__v", label_col=label)
        scored = df.join(votes.select(F.col("id").alias(id_col), F.col("share").alias("score")), id_col)
    else:
        fit = MODELS[model_name(model)] if isinstance(model, str) else model
        others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda f: f != F.col("fold")))
        found = fit(df.select(*dict.fromkeys([*names, label, "fold"])).withColumn(HELD, others), names, label)
        score = None
        for m, c in sorted(found.items()):
            score = F.when(F.col("fold") == m, c) if score is None else score.when(F.col("fold") == m, c)
        scored = df.withColumn("score", score)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fold_summary(scored: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' balanced accuracies."""
    per = metrics.balanced_accuracy(scored, by=["fold"])
    return per.agg(F.avg("balanced_accuracy").alias("balanced_acc_mean"), F.stddev_pop("balanced_accuracy").alias("balanced_acc_std"))


def single_feature_ranks(long: DataFrame, *, label_col: str = "class_label") -> DataFrame:
    """Fisher score, mutual information and AUC of all features at once, ranked by Fisher score, then name."""
    f, m = metrics.fisher_scores(long, label_col=label_col), metrics.mutual_information(long, label_col=label_col)
    a = metrics.roc_auc(long.withColumnRenamed("value", "score"), label=label_col, by=["feature"])
    order = W.orderBy(F.desc("key"), "feature")  # one row per feature
    return f.join(m, "feature").join(a, "feature").withColumn("key", F.round("fisher_score", 12)).withColumn("rank", F.row_number().over(order)).drop("key")


def single_feature_models(df: DataFrame, names: list[str], *, models: tuple[str, ...] = ("lda", "logistic_regression", KNN), k: int = 5, label: str = "class_label", id_col: str = "snippet_id") -> DataFrame:
    """Per feature: mean and deviation of the folds' balanced accuracy of each model asked for, with its error if it has one,
    and the AUC of the out-of-fold logistic scores. Folds are stratified in id order; all features share their passes."""

    def known(name: str) -> str:
        try:
            return model_name(name)
        except ValueError:
            return name  # gets its error in the rows

    wanted = list(dict.fromkeys(map(known, models)))
    folds = stratified_folds(df.select(id_col, label, *names), k, id_col=id_col, label_col=label, seed=None)
    listed = [candidates.Candidate(n, [n]) for n in names]
    long, fitted = candidates.scores(folds, listed, [*wanted, "logistic_regression"], label=label, id_col=id_col, scaled=False)
    long = materialize(long)
    per = metrics.balanced_accuracy(long.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), actual="label", by=["candidate", "model", "fold"])
    columns = []
    for m in wanted:
        own = F.when(F.col("model") == m, F.col("balanced_accuracy"))
        columns += [F.avg(own).alias(f"{m}_balanced_acc_mean"), F.stddev_pop(own).alias(f"{m}_balanced_acc_std")]
    area = metrics.roc_auc(long.where(F.col("model") == "logistic_regression").withColumnRenamed("label", "class_label"), by=["candidate"])
    told = [(i, n, *[fitted.errors.get((i, m)) for m in wanted]) for i, n in enumerate(names)]
    table = df.sparkSession.createDataFrame(told, "candidate int, feature string, " + ", ".join(f"`{m}_error` string" for m in wanted))
    return table.join(area, "candidate", "left").join(per.groupBy("candidate").agg(*columns), "candidate", "left").drop("candidate")


def feature_set_ranks(df: DataFrame, sets: dict[str, list[str]], models: list[str], *, label: str = "class_label", id_col: str = "snippet_id") -> list[dict]:
    """One row per set and model with the set's silhouette, best balanced accuracy first; a failing fit is a row with its error.

    All sets, models and folds share their passes. Features are taken as they are.
    """
    told = candidates.board(df, [candidates.Candidate(n, f) for n, f in sets.items() if f], models, label=label, unit_col=None, id_col=id_col, scaled=False)
    rows = [
        {
            "set_name": r["candidate"], "n_features_in_set": r["n_features"], "features_used": ",".join(r["features"]), "model": r["model"],
            "balanced_acc_mean": r["balanced_acc_mean"], "balanced_acc_std": r["balanced_acc_std"], "silhouette": r["silhouette_class"], "error": r["error"],
        }
        for r in told.collect()  # sets x models
    ]
    rows.sort(key=lambda r: (-(r["balanced_acc_mean"] if r["balanced_acc_mean"] is not None else -1.0), r["set_name"], r["model"]))
    return [r | {"rank": i + 1} for i, r in enumerate(rows)]


def feature_combinations(names: list[str], largest: int, *, limit: int | None = None, seed: int = 42) -> list[tuple[str, ...]]:
    """All combinations of 1 to ``largest`` names, or a seeded sample of ``limit`` of them."""
    every = [c for r in range(1, largest + 1) for c in combinations(names, r)]
    if limit is None or len(every) <= limit:
        return every
    picked = np.random.default_rng(seed).choice(len(every), limit, replace=False)
    return [every[i] for i in sorted(picked)]


def pairwise_auc(df: DataFrame, *, unit_col: str = "unit_id", score_col: str = "score") -> DataFrame:
    """AUC of a score for every pair of units (first < second), the second as positive.

    Pairs come from the distinct units; the counts of a unit's distinct scores
    are joined to its pairs by equality, so their number grows with the number
    of units only.
    """
    units = df.select(F.col(unit_col).alias("u")).where("u is not null").distinct()
    pairs = units.alias("a").crossJoin(units.alias("b")).where(F.col("a.u") < F.col("b.u")).select(F.col("a.u").alias("unit_a"), F.col("b.u").alias("unit_b"))
    sides = materialize(pairs.select(F.explode(F.array("unit_a", "unit_b")).alias("u"), "unit_a", "unit_b"))  # units squared, not rows
    counts = df.groupBy(F.col(unit_col).alias("u"), F.col(score_col).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(broadcast_if_small(sides, 100_000), "u")
    return metrics.roc_auc(rows.withColumn("class_label", (F.col("u") == F.col("unit_b")).cast("int")), by=["unit_a", "unit_b"], weight="n")


knn_model = neighbors.knn_classify


def min_max_scaled(df: DataFrame, column: str = "score") -> DataFrame:
    """``column`` shifted and scaled to [0, 1] over the table; a constant column becomes 0.5."""
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if r["lo"] is None or r["lo"] == r["hi"]:
        return df.withColumn(column, F.lit(0.5))
    return df.withColumn(column, (F.col(column) - r["lo"]) / (r["hi"] - r["lo"]))


def holdout_scores(df: DataFrame, names: list[str], model: str | Fit, *, share: float = 0.25, label: str = "class_label", id_col: str = "snippet_id") -> DataFrame:
    """Scores and predictions of the held-out rows by a model fitted on the others; scores scaled to [0, 1]."""
    split = holdout_split(df, share, id_col=id_col, label_col=label)
    scored = split.where("is_test").withColumn("score", fit_one(split.where("not is_test"), names, model, label))
    return min_max_scaled(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def holdout_evaluation(df: DataFrame, names: list[str], model: str | Fit, **options) -> DataFrame:
    """Confusion counts, precision, recall, false-positive rate, F1, balanced accuracy and AUC on the held-out rows."""
    scored = holdout_scores(df, names, model, **options)
    label = options.get("label", "class_label")
    a, p = F.col(label), F.col("predicted")
    counts = scored.agg(*[c.alias(n) for n, c in metrics.confusion(a, p).items()], metrics.f1(a, p).alias("f1"))
    return counts.crossJoin(metrics.balanced_accuracy(scored, actual=label)).crossJoin(metrics.roc_auc(scored, label=label))
