"""Population code, metrics, neighbours, folds and classifiers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import cluster, codebank, metrics, models, neighbors


def table(spark, x, labels, units=None):
    rows = [(i, [float(v) for v in r], int(c), int(u)) for i, (r, c, u) in enumerate(zip(x, labels, units if units is not None else labels))]
    df = spark.createDataFrame(rows, "snippet_id long, w array<double>, class_label int, unit_id int")
    return df.select("*", *[F.col("w")[j].alias(f"x{j}") for j in range(len(x[0]))])


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-1, 0.3, (60, 3)), rng.normal(1, 0.3, (60, 3))])
    return table(spark, x, [0] * 60 + [1] * 60, [1] * 60 + [2] * 60).cache()


NAMES = ["x0", "x1", "x2"]


def test_code_bank(spark, blobs):
    bank = codebank.fit(blobs.where("class_label = 1"), NAMES)
    assert all(w > 0 for row in bank.widths for w in row) and len(bank.centers) == 3
    out = codebank.apply(blobs, bank).groupBy("class_label").agg(F.avg("score").alias("s"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    s = {r["class_label"]: r for r in out}
    assert s[1]["s"] > s[0]["s"] and all(0 <= r["lo"] and r["hi"] <= 1 + 1e-12 for r in out)
    assert codebank.CodeBank.from_json(bank.to_json()) == bank
    assert codebank.project(blobs, bank).select(F.size("activations")).first()[0] == 30
    assert bank.describe(spark).count() == 3
    with pytest.raises(ValueError):
        codebank.fit(blobs.limit(0), NAMES)
    with pytest.raises(ValueError):
        codebank.fit(blobs, NAMES, n_bins=1)


def test_constant_feature_fires_only_on_its_value(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    bank = codebank.fit(df, ["x"], n_bins=4)
    got = codebank.apply(spark.createDataFrame([(5.0,), (5.1,)], "x double"), bank).collect()
    assert got[0]["score"] == pytest.approx(1) and got[1]["score"] == pytest.approx(0)


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 5, 80), rng.integers(0, 2, 80)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, class_label int")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(want)
    assert metrics.roc_auc(df.where("class_label = 1")).first()["auc"] is None


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in ((3, 3), (4, 2), (2, 4), (5, 5)):
        t = rng.integers(0, 20, (n, m))
        counts = {(i, j): int(t[i, j]) for i in range(n) for j in range(m)}
        big, small = (range(n), m) if n >= m else (range(m), n)
        want = max(sum(t[p[j], j] if n >= m else t[j, p[j]] for j in range(small)) for p in itertools.permutations(big, small))
        assert metrics.assignment(counts)[0] == want


def test_clustering_metrics_on_equal_partitions(spark):
    df = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "unit_id int, cluster_id int")
    t = metrics.contingency(df)
    assert metrics.ari(t).first()["ari"] == pytest.approx(1) and metrics.nmi(t).first()["nmi"] == pytest.approx(1)
    assert metrics.purity(t).first()["purity"] == 1 and metrics.matched_accuracy(t)[0] == 1


def test_neighbours_over_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4))
    df = table(spark, x, rng.integers(0, 3, 90))
    got = {(r["id"], r["rank"]): r["neighbor_id"] for r in neighbors.knn(df, 3, block_rows=25).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)
    assert got == {(i, r + 1): order[i, r] for i in range(90) for r in range(3)}
    assert neighbors.silhouette(df, block_rows=25).first()[0] == pytest.approx(neighbors.silhouette(df).first()[0])


def test_purity_of_separated_and_tiny_sets(spark, blobs):
    r = neighbors.knn_purity_sweep(blobs, [1, 5]).first()
    assert r["knn_purity_k01"] == r["knn_purity_k05"] == 1
    two = table(spark, [[0.0], [1.0]], [0, 1])
    assert neighbors.knn_purity_sweep(two, [5]).first()[0] is None
    four = table(spark, [[0.0], [0.1], [10.0], [10.1]], [0, 0, 1, 1])
    assert neighbors.knn_purity_sweep(four, [1]).first()[0] == 1


@pytest.mark.parametrize("model", ["threshold_weight_bank", "nearest_centroid", "lda", "qda", "logistic_regression", "linear_svm", "knn_k5"])
def test_classifiers_separate_blobs(blobs, model):
    scored = models.cross_validated(models.stratified_folds(blobs, 3), NAMES, model, k=3)
    assert models.fold_summary(scored).first()["balanced_acc_mean"] > 0.85


def test_logistic_matches_the_gradient_condition(spark, blobs):
    noisy = blobs.withColumn("class_label", F.when(F.col("snippet_id") % 7 == 0, 1 - F.col("class_label")).otherwise(F.col("class_label")))
    p = noisy.withColumn("p", models.fit_one(noisy, ["x0"], "logistic_regression"))
    r = p.agg(F.sum(F.col("class_label") - F.col("p")).alias("b")).first()
    assert abs(r["b"]) < 1e-4


def test_threshold_rule(spark, blobs):
    scored = blobs.withColumn("score", models.fit_one(blobs, ["x0"], "threshold_rule"))
    assert scored.where("(score >= 0.5) = (class_label = 1)").count() >= 118


def test_names_of_models():
    assert models.model_name("  Logistic ") == "logistic_regression" and models.model_name("code-bank") == "threshold_weight_bank" and models.model_name("kNN") == "knn_k5"
    with pytest.raises(ValueError, match="choose from"):
        models.model_name("nope")


def test_folds_splits_and_samples(blobs):
    f = models.stratified_folds(blobs, 5).groupBy("class_label", "fold").count().collect()
    assert {r["count"] for r in f} == {12}
    assert models.holdout_split(blobs).where("is_test").groupBy("class_label").count().collect()[0]["count"] == 15
    assert models.balanced_sample(blobs, 7).count() == 14
    assert models.sample_rows(blobs, 9).count() == 9
    assert models.shuffled(blobs).first()["snippet_id"] == models.shuffled(blobs).first()["snippet_id"]


def test_feature_set_ranking_reports_failures(blobs):
    rows = models.feature_set_ranks(models.stratified_folds(blobs, 2), {"good": NAMES, "bad": ["absent"]}, ["nearest_centroid"])
    assert rows[0]["set_name"] == "good" and rows[1]["error"] and [r["rank"] for r in rows] == [1, 2]


def test_combinations():
    assert len(models.feature_combinations(list("abcd"), 2)) == 10
    assert models.feature_combinations(list("abcd"), 2, limit=4) == models.feature_combinations(list("abcd"), 2, limit=4)


def test_clustering_benchmark(spark, blobs, tmp_path):
    df = blobs.withColumn("class_label", F.lit(1))
    rows, summary = cluster.benchmark(df, NAMES, n_init=2, max_iter=20, ks=(1, 5), output=str(tmp_path / "a"))
    assert summary["status"] == "ok" and rows[0]["matched_accuracy"] > 0.95 and rows[0]["knn_purity_k01"] > 0.9
    assert spark.read.parquet(str(tmp_path / "a")).count() == 120 * len(rows)
    assert cluster.benchmark(df, NAMES, enabled=False)[1]["status"] == "disabled"
    assert cluster.benchmark(df.where("unit_id = 1"), NAMES)[1]["status"] == "skipped"


def test_folds_are_fitted_as_one_by_one(blobs):
    """Scores of all folds in the same passes equal those of each fold fitted alone."""
    noisy = blobs.withColumn("class_label", F.when(F.col("snippet_id") % 7 == 0, 1 - F.col("class_label")).otherwise(F.col("class_label")))
    df = models.stratified_folds(noisy, 3)
    for model in ("nearest_centroid", "lda", "qda", "logistic_regression", "linear_svm", "threshold_weight_bank", "threshold_rule"):
        got = {r["snippet_id"]: r["score"] for r in models.cross_validated(df, NAMES, model, k=3).collect()}
        for fold in range(3):
            one = df.where(F.col("fold") == fold).withColumn("s", models.fit_one(df.where(F.col("fold") != fold), NAMES, model))
            assert all(r["s"] == pytest.approx(got[r["snippet_id"]], abs=1e-6) for r in one.collect()), model


def test_single_feature_models_against_numpy(spark):
    rng = np.random.default_rng(5)
    y = np.arange(90) % 2
    x = np.stack([rng.normal(y * 1.2, 1.0), np.round(rng.normal(0, 1, 90), 1)], 1)
    df = table(spark, x, y)
    got = {r["feature"]: r for r in models.single_feature_models(df, ["x0", "x1"], models=("lda", "logistic", "knn", "svm", "unheard_of"), k=3).collect()}
    assert got["x0"]["unheard_of_error"] == "unknown model unheard_of" and got["x0"]["lda_error"] is None and got["x0"]["unheard_of_balanced_acc_mean"] is None
    assert 0.5 < got["x0"]["linear_svm_balanced_acc_mean"] <= 1
    fold = np.empty(90, int)
    for c in (0, 1):
        fold[np.flatnonzero(y == c)] = np.arange((y == c).sum()) % 3

    def lda(v, t, q):
        m0, m1 = v[t == 0].mean(), v[t == 1].mean()
        s = (((v[t == 0] - m0) ** 2).sum() + ((v[t == 1] - m1) ** 2).sum()) / (len(v) - 2)
        return (q - (m0 + m1) / 2) * (m1 - m0) / s + np.log((t == 1).sum() / (t == 0).sum()) >= 0

    def knn(v, t, q):
        return np.array([t[np.lexsort((np.arange(len(v)), np.round(np.abs(v - z), 9)))[:5]].mean() >= 0.5 for z in q])

    for j, name in enumerate(("x0", "x1")):
        for model, fit in (("lda", lda), ("knn_k5", knn)):
            scores = []
            for f in range(3):
                p, t = fit(x[fold != f, j], y[fold != f], x[fold == f, j]), y[fold == f]
                scores.append((p[t == 1].mean() + (~p[t == 0]).mean()) / 2)
            assert got[name][f"{model}_balanced_acc_mean"] == pytest.approx(np.mean(scores)) and got[name][f"{model}_balanced_acc_std"] == pytest.approx(np.std(scores))
    assert 0.6 < got["x0"]["auc"] <= 1 and got["x0"]["logistic_regression_balanced_acc_mean"] > 0.6


def test_exact_quantiles_at_any_split(spark):
    from wavemill.sources import scratch

    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=500), np.round(rng.normal(size=300), 1), [2.0] * 50])
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0), ("b", None), (None, 3.0), (None, 4.0)], "g string, v double")
    levels = [i / 9 for i in range(10)]
    got = {r["g"]: r["quantiles"] for r in scratch.exact_quantiles(df, levels, by=["g"], value="v").collect()}
    assert got["a"] == pytest.approx(list(np.quantile(v, levels))) and got["b"] == [1.0] * 10 and got[None][-1] == 4.0 and got[None][0] == 3.0


def test_no_single_partition_plans(spark, blobs):
    """Metrics over nearly distinct scores sort nothing in one task; pairs of units meet by equality."""
    df = blobs.select(F.col("x0").alias("score"), "class_label", "unit_id")
    for job in (metrics.roc_auc(df), metrics.roc_curve(df), models.pairwise_auc(df), models.stratified_folds(blobs, 3)):
        plan = job._jdf.queryExecution().executedPlan().toString()
        windows = plan.count("Window [")
        assert "BroadcastNestedLoopJoin" not in plan and (windows == 0 or "SinglePartition" not in plan)


def test_running_sums(spark):
    from wavemill.sources import scratch

    rows = [(g, i, i % 3) for g in ("a", "b", None) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, i int, x int").repartition(7)
    got = {(r["g"], r["i"]): r["s"] for r in scratch.running_sums(df, {"s": F.col("x")}, by=["g"], order=["i"]).collect()}
    assert all(got[g, i] == sum(j % 3 for j in range(i + 1)) for g, i, _ in rows)
    assert sorted(r["n"] for r in scratch.numbered(df, "n", by=[], order=["g", "i"]).collect()) == list(range(1, 301))
    assert scratch.numbered(df.limit(0), "n", by=[], order=["i"]).count() == 0
