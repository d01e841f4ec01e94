"""Registered queries: rankings, classifiers, neighbours, clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import kernels as k
from ..operators import candidates, cluster, codebank, metrics, models, neighbors
from ..operators.features import FEATURE_SETS, FeatureConfig, TemporalConfig, build_features, feature_names, resolve_names, to_long
from ..sources.scratch import materialize
from ..sources.snippets import snippets
from . import sql
from .registry import register

NAMES = feature_names(tier=3)
SCALARS = list(k.SCALAR_FEATURES)
_FEATURES = sql.features()
_SCALAR = sql.features(event=False, bins=None)
_LONG = f"{_FEATURES}, {sql.long_features(NAMES)}"
_SCORED = f"{_SCALAR}, {sql.long_features(SCALARS)}, {sql.code_bank(SCALARS)}, z AS (SELECT *, CAST(round(score, 9) >= 0.5 AS INTEGER) AS predicted FROM (SELECT snippet_id, unit_id, class_label, round(score, 9) AS score FROM sc))"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix, written once: rankings and fits read it several times."""
    return materialize(build_features(snippets(spark, sf_dir), tier=3))


def scalar_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(build_features(snippets(spark, sf_dir), FeatureConfig(temporal=TemporalConfig(enabled=False))))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(matrix(spark, sf_dir), NAMES, id_cols=["snippet_id", "unit_id", "class_label"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scalar_matrix(spark, sf_dir)
    out = codebank.apply(df, codebank.fit(df.where("class_label = 1"), SCALARS)).select("snippet_id", "unit_id", "class_label", F.round("score", 9).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_FISHER = "pow(avg(value) FILTER (class_label = 1) - avg(value) FILTER (class_label = 0), 2) / (var_pop(value) FILTER (class_label = 1) + var_pop(value) FILTER (class_label = 0) + 1e-12)"
_MI = """b AS (SELECT l.feature, class_label AS y, least(floor((value - lo) / ((hi - lo) / 20)), 20) AS bin FROM l JOIN (SELECT feature, min(value) AS lo, max(value) + 1e-10 AS hi FROM l GROUP BY feature) USING (feature)),
j AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY ALL),
mi AS (SELECT feature, greatest(0.0, sum(n / t * ln(n * t / (nb * ny)))) AS mutual_info FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY feature, bin) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY feature, y) AS DOUBLE) AS ny FROM j) GROUP BY feature)"""


def _auc(source: str, by: str = "", score: str = "score") -> str:
    """AUC by tie-averaged ranks."""
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}(sum(rk) FILTER (class_label = 1) - count(*) FILTER (class_label = 1) * (count(*) FILTER (class_label = 1) + 1) / 2.0)
  / (count(*) FILTER (class_label = 1) * count(*) FILTER (class_label = 0)) AS auc
FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {lead}{score}) - 1) / 2.0 AS rk FROM {source}) {group}"""


@register("a14_fisher_scores", f"WITH {_LONG} SELECT feature, round({_FISHER}, 6) AS fisher_score FROM l GROUP BY feature")
def fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fisher_scores(long(spark, sf_dir)).select("feature", r6("fisher_score").alias("fisher_score"))


@register("a15_mutual_information", f"WITH {_LONG}, {_MI} SELECT feature, round(mutual_info, 6) AS mutual_info FROM mi")
def mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mutual_information(long(spark, sf_dir)).select("feature", r6("mutual_info").alias("mutual_info"))


@register("m18_m19_single_feature_ranks", f"""WITH {_LONG}, {_MI}, fi AS (SELECT feature, {_FISHER} AS fisher_score FROM l GROUP BY feature), au AS ({_auc('l', 'feature', 'value')})
SELECT feature, round(fisher_score, 6) AS fisher_score, round(mutual_info, 6) AS mutual_info, round(auc, 6) AS auc, CAST(row_number() OVER (ORDER BY round(fisher_score, 12) DESC, feature) AS INTEGER) AS rank
FROM fi JOIN mi USING (feature) JOIN au USING (feature)""")
def single_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = models.single_feature_ranks(long(spark, sf_dir))
    return r.select("feature", *[r6(c).alias(c) for c in ("fisher_score", "mutual_info", "auc")], "rank")


@register("a16_confusion", f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (class_label = 1 AND predicted = 1) AS tp, count(*) FILTER (class_label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (class_label = 0 AND predicted = 0) AS tn, count(*) FILTER (class_label = 1 AND predicted = 0) AS fn FROM z)
SELECT tp, fp, tn, fn, round(tp / (tp + fp + 1e-12), 6) AS precision, round(tp / (tp + fn + 1e-12), 6) AS recall, round(fp / (fp + tn + 1e-12), 6) AS fpr FROM c""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.confusion(F.col("class_label"), F.col("predicted"))
    return scored(spark, sf_dir).agg(*[(v if n in ("tp", "fp", "tn", "fn") else r6(v)).alias(n) for n, v in c.items()])


@register("a17_balanced_accuracy", f"WITH {_SCORED} SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT class_label, avg(CAST(class_label = predicted AS DOUBLE)) AS r FROM z GROUP BY 1)")
def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.balanced_accuracy(scored(spark, sf_dir)).select(r6("balanced_accuracy").alias("balanced_accuracy"))


@register("a18_f1", f"""WITH {_SCORED}, c AS (SELECT k, count(*) FILTER (class_label = k AND predicted = k) AS tp, count(*) FILTER (class_label <> k AND predicted = k) AS fp, count(*) FILTER (class_label = k AND predicted <> k) AS fn
  FROM z, (VALUES (0), (1)) v(k) GROUP BY k)
SELECT round(max(2 * tp / (2 * tp + fp + fn)) FILTER (k = 1), 6) AS f1, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS f1_macro FROM c""")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    one = s.agg(r6(metrics.f1(F.col("class_label"), F.col("predicted"))).alias("f1"))
    return one.crossJoin(metrics.f1_macro(s, actual="class_label", predicted="predicted").select(r6("f1_macro").alias("f1_macro")))


@register("a19_w09_roc_auc", f"WITH {_SCORED} SELECT round(auc, 6) AS auc FROM ({_auc('z')})")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, sf_dir)).select(r6("auc").alias("auc"))


_STEPS = """st AS (SELECT score, CAST(count(*) FILTER (class_label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (class_label = 0) AS DOUBLE) AS n FROM z GROUP BY score),
ro AS (SELECT score AS threshold, sum(p) OVER o / sum(p) OVER () AS tpr, sum(n) OVER o / sum(n) OVER () AS fpr FROM st WINDOW o AS (ORDER BY score DESC))"""


@register("w10_roc_curve", f"WITH {_SCORED}, {_STEPS} SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(tpr - fpr, 6) + 0.0 AS youden_j FROM ro")
def roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_curve(scored(spark, sf_dir)).select(*[(r6(c) + 0.0).alias(c) for c in ("threshold", "tpr", "fpr", "youden_j")])


@register("m06_best_threshold", f"WITH {_SCORED}, {_STEPS} SELECT round(arg_max(threshold, (round(tpr - fpr, 12), threshold)), 6) AS threshold, round(max(tpr - fpr), 6) AS youden_j FROM ro")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(scored(spark, sf_dir)).select(r6("threshold").alias("threshold"), r6("youden_j").alias("youden_j"))


@register("a20_unit_recall", f"WITH {_SCORED} SELECT unit_id, count(*) AS n, round(avg(CAST(predicted AS DOUBLE)), 6) AS recall, round(avg(score), 6) AS mean_score FROM z WHERE class_label = 1 GROUP BY unit_id")
def unit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("class_label = 1").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("predicted").cast("double"))).alias("recall"), r6(F.avg("score")).alias("mean_score"))


_SOURCE = "'src' || (snippet_id % 7)"


@register("a21_source_accuracy", f"""WITH {_SCORED} SELECT {_SOURCE} AS source, round(avg(CAST(class_label = predicted AS DOUBLE)), 6) AS accuracy,
  round(avg(score) FILTER (class_label = 1), 6) AS mean_spike_score, round(avg(score) FILTER (class_label = 0), 6) AS mean_noise_score FROM z GROUP BY 1""")
def source_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("source", F.concat(F.lit("src"), (F.col("snippet_id") % 7).cast("string")))
    a = F.col("class_label")
    return s.groupBy("source").agg(r6(F.avg((a == F.col("predicted")).cast("double"))).alias("accuracy"), r6(F.avg(F.when(a == 1, F.col("score")))).alias("mean_spike_score"), r6(F.avg(F.when(a == 0, F.col("score")))).alias("mean_noise_score"))


# --- folds and closed-form classifiers ----------------------------------------------------------------

_KEY = "md5(snippet_id || ':42'), snippet_id"
_FOLDS = f"fo AS (SELECT *, (row_number() OVER (PARTITION BY class_label ORDER BY {_KEY}) - 1) % 5 AS fold FROM f)"


@register("t10_stratified_folds", f"WITH {_SCALAR}, {_FOLDS} SELECT snippet_id, CAST(fold AS INTEGER) AS fold FROM fo")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stratified_folds(snippets(spark, sf_dir)).select("snippet_id", "fold")


@register("t10_unshuffled_folds", f"WITH {sql.SNIPPETS} SELECT snippet_id, CAST((row_number() OVER (PARTITION BY class_label ORDER BY snippet_id) - 1) % 5 AS INTEGER) AS fold FROM s")
def plain_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stratified_folds(snippets(spark, sf_dir), seed=None).select("snippet_id", "fold")


@register("t09_holdout_split", f"WITH {sql.SNIPPETS} SELECT snippet_id, row_number() OVER (PARTITION BY class_label ORDER BY {_KEY}) <= round(count(*) OVER (PARTITION BY class_label) * 0.25) AS is_test FROM s")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.holdout_split(snippets(spark, sf_dir)).select("snippet_id", "is_test")


@register("m15_standardized", f"WITH {_SCALAR} SELECT snippet_id, " + ", ".join(f"round(({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER (), 6) + 0.0 AS {n}" for n in SCALARS) + " FROM f")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.standardized(scalar_matrix(spark, sf_dir), SCALARS).select("snippet_id", *[(r6(n) + 0.0).alias(n) for n in SCALARS])


def _cv(spark: SparkSession, sf_dir: str, model: str, names: list[str]) -> DataFrame:
    return models.cross_validated(models.stratified_folds(scalar_matrix(spark, sf_dir)), names, model)


def _centroid_sql(names: list[str]) -> str:
    means = ", ".join(f"avg({n}) FILTER (t.class_label = {c}) AS {n}_{c}" for n in names for c in (0, 1))
    dist = {c: " + ".join(f"pow(fo.{n} - ce.{n}_{c}, 2)" for n in names) for c in (0, 1)}
    return f"ce AS (SELECT k AS fold, {means} FROM fo t, (SELECT unnest(range(5)) AS k) WHERE t.fold <> k GROUP BY k), pr AS (SELECT fo.snippet_id, fo.class_label, fo.fold, CAST(1 / (1 + exp(({dist[1]}) - ({dist[0]}))) >= 0.5 AS INTEGER) AS predicted FROM fo JOIN ce USING (fold))"


@register("m09_nearest_centroid_cv", f"WITH {_SCALAR}, {_FOLDS}, {_centroid_sql(SCALARS)} SELECT snippet_id, CAST(fold AS INTEGER) AS fold, predicted FROM pr")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv(spark, sf_dir, "nearest_centroid", SCALARS).select("snippet_id", "fold", "predicted")


@register("a30_cv_summary", f"""WITH {_SCALAR}, {_FOLDS}, {_centroid_sql(SCALARS)}, ba AS (SELECT fold, avg(r) AS b FROM (SELECT fold, class_label, avg(CAST(class_label = predicted AS DOUBLE)) AS r FROM pr GROUP BY ALL) GROUP BY fold)
SELECT round(avg(b), 6) AS balanced_acc_mean, round(stddev_pop(b), 6) AS balanced_acc_std FROM ba""")
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = models.fold_summary(_cv(spark, sf_dir, "nearest_centroid", SCALARS))
    return s.select(*[r6(c).alias(c) for c in s.columns])


def _gauss_sql(kind: str) -> str:
    n, x = "peak_amplitude", "fo.peak_amplitude"
    stats = f"g AS (SELECT k AS fold, class_label AS c, count(*) AS n, avg({n}) AS m, var_samp({n}) AS v, var_pop({n}) AS vp FROM f2 GROUP BY ALL)"
    rows = "f2 AS (SELECT t.*, k FROM fo t, (SELECT unnest(range(5)) AS k) WHERE t.fold <> k)"
    if kind == "lda":
        score = f"(({x} - (a.m + b.m) / 2) * (b.m - a.m) / ((a.n * a.vp + b.n * b.vp) / (a.n + b.n - 2)) + ln(b.n / a.n))"
    else:
        score = f"((ln(b.n) - 0.5 * ln(b.v + 1e-12) - 0.5 * pow({x} - b.m, 2) / b.v) - (ln(a.n) - 0.5 * ln(a.v + 1e-12) - 0.5 * pow({x} - a.m, 2) / a.v))"
    return f"WITH {_SCALAR}, {_FOLDS}, {rows}, {stats} SELECT fo.snippet_id, CAST(fo.fold AS INTEGER) AS fold, round(1 / (1 + exp(-{score})), 6) AS score FROM fo JOIN g a ON a.fold = fo.fold AND a.c = 0 JOIN g b ON b.fold = fo.fold AND b.c = 1"


for _kind in ("lda", "qda"):

    def _gauss(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return _cv(spark, sf_dir, kind, ["peak_amplitude"]).select("snippet_id", "fold", r6("score").alias("score"))

    register(f"m10_m11_{_kind}_one_feature_cv", _gauss_sql(_kind))(_gauss)


def _bank_cv_sql() -> str:
    levels = ", ".join(str(b / 9) for b in range(10))
    return f"""WITH {_SCALAR}, {_FOLDS}, {sql.long_features(SCALARS, '(SELECT * FROM fo)').replace('SELECT snippet_id', 'SELECT fold, snippet_id')},
q AS (SELECT feature, k, quantile_cont(value, [{levels}]) AS c FROM l, (SELECT unnest(range(5)) AS k) WHERE fold <> k AND class_label = 1 GROUP BY ALL),
m AS (SELECT feature, k, c, list_transform(range(1, 11), lambda i: greatest(1e-6, 0.5 * ((c[greatest(i, 2)] - c[greatest(i, 2) - 1]) + (c[least(i + 1, 10)] - c[least(i + 1, 10) - 1])) / 2)) AS s FROM q)
SELECT snippet_id, CAST(fold AS INTEGER) AS fold, round(avg(list_max(list_transform(range(1, 11), lambda i: exp(-0.5 * ((value - c[i]) / (s[i] + 1e-10)) * ((value - c[i]) / (s[i] + 1e-10)))))), 6) AS score
FROM l JOIN m ON l.feature = m.feature AND l.fold = m.k GROUP BY snippet_id, fold"""


@register("m07_m23_code_bank_cv", _bank_cv_sql())
def bank_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv(spark, sf_dir, "threshold_weight_bank", SCALARS).select("snippet_id", "fold", r6("score").alias("score"))


@register("m12_logistic_cv")
def logistic_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv(spark, sf_dir, "logistic_regression", SCALARS).select("snippet_id", "fold", "predicted")


@register("m13_linear_svm_cv")
def svm_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv(spark, sf_dir, "linear_svm", SCALARS).select("snippet_id", "fold", "predicted")


@register("m18_single_feature_models")
def single_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.single_feature_models(matrix(spark, sf_dir), NAMES)


@register("m20_feature_set_ranks")
def set_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named sets, all ranked models, five folds."""
    sets = {n: resolve_names(NAMES, w) for n, w in FEATURE_SETS.items()}
    rows = models.feature_set_ranks(models.stratified_folds(matrix(spark, sf_dir)), sets, models.RANKED_MODELS)
    return spark.createDataFrame(rows, "set_name string, n_features_in_set int, features_used string, model string, balanced_acc_mean double, balanced_acc_std double, silhouette double, error string, rank int")


# --- neighbours ---------------------------------------------------------------------------------------

_PAIRS = f"{sql.SNIPPETS}, pd AS (SELECT a.snippet_id AS id, a.unit_id AS label, b.snippet_id AS nid, b.unit_id AS nlabel, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.w[i] - b.w[i], 2)))), 9) AS d FROM s a JOIN s b ON a.snippet_id <> b.snippet_id)"
_NEAR = f"{_PAIRS}, nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS rk FROM pd)"


@register("j04_w06_knn", f"WITH {_NEAR} SELECT id, nid AS neighbor_id, round(d, 6) AS distance, CAST(rk AS INTEGER) AS rank FROM nn WHERE rk <= 20")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.knn(snippets(spark, sf_dir), 20).select("id", "neighbor_id", r6("distance").alias("distance"), "rank")


_SWEEP = ", ".join(f"round(avg(k{n:02d}), 6) AS knn_purity_k{n:02d}" for n in (1, 5, 10, 20))
_PER = "per AS (SELECT id, label, " + ", ".join(f"count(*) FILTER (rk <= {n} AND label = nlabel) / {float(n)} AS k{n:02d}" for n in (1, 5, 10, 20)) + " FROM nn GROUP BY ALL)"


@register("a27_a28_knn_purity", f"WITH {_NEAR}, {_PER} SELECT {_SWEEP} FROM per")
def purity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = neighbors.knn_purity_sweep(snippets(spark, sf_dir), [1, 5, 10, 20])
    return r.select(*[r6(c).alias(c) for c in r.columns])


@register("a29_unit_knn_purity", f"WITH {_NEAR}, {_PER} SELECT label, " + ", ".join(f"round(avg(k{n:02d}), 6) AS knn_purity_k{n:02d}, round(stddev_pop(k{n:02d}), 6) AS std_k{n:02d}, round(min(k{n:02d}), 6) AS min_k{n:02d}" for n in (1, 5, 10, 20)) + " FROM per GROUP BY label")
def unit_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = neighbors.knn_purity_sweep(snippets(spark, sf_dir), [1, 5, 10, 20], by_label=True)
    return r.select("label", *[r6(c).alias(c) for c in r.columns if c != "label"])


@register("a26_silhouette", f"""WITH {_PAIRS}, mc AS (SELECT id, label, nlabel, sum(d) / count(*) AS m FROM pd GROUP BY ALL), ab AS (SELECT id, max(m) FILTER (label = nlabel) AS a, min(m) FILTER (label <> nlabel) AS b FROM mc GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.silhouette(snippets(spark, sf_dir)).select(r6("silhouette").alias("silhouette"))


@register("m14_knn_classifier", f"""WITH {sql.SNIPPETS}, h AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY {_KEY}) <= round(count(*) OVER (PARTITION BY class_label) * 0.25) AS is_test FROM s),
p AS (SELECT a.snippet_id AS id, b.class_label AS y, row_number() OVER (PARTITION BY a.snippet_id ORDER BY round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.w[i] - b.w[i], 2)))), 9), b.snippet_id) AS rk FROM h a JOIN h b ON a.is_test AND NOT b.is_test),
v AS (SELECT id, y, count(*) AS n FROM p WHERE rk <= 5 GROUP BY ALL)
SELECT id, arg_max(y, (n, -y)) AS predicted FROM v GROUP BY id""")
def knn_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = models.holdout_split(snippets(spark, sf_dir))
    return neighbors.knn_classify(split.where("not is_test"), split.where("is_test"), 5).select("id", F.col("predicted").cast("int").alias("predicted"))


@register("j05_m16_pairwise_auc", f"""WITH {_SCORED}, pr AS (SELECT a.u AS unit_a, b.u AS unit_b FROM (SELECT DISTINCT unit_id AS u FROM z) a JOIN (SELECT DISTINCT unit_id AS u FROM z) b ON a.u < b.u),
y AS (SELECT unit_a, unit_b, score, CAST(unit_id = unit_b AS INTEGER) AS class_label FROM z JOIN pr ON unit_id IN (unit_a, unit_b))
SELECT unit_a, unit_b, round(auc, 6) AS auc FROM ({_auc('y', 'unit_a, unit_b')})""")
def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.pairwise_auc(scored(spark, sf_dir)).select("unit_a", "unit_b", r6("auc").alias("auc"))


_UNIT_MEANS = ", ".join(f"avg({n}) AS {n}" for n in SCALARS)
_TO_MEANS = " + ".join(f"2 * f.{n} * (b.{n} - a.{n}) + a.{n} * a.{n} - b.{n} * b.{n}" for n in SCALARS)


@register("m16_pairwise_models", f"""WITH {_SCALAR}, mu AS (SELECT unit_id, {_UNIT_MEANS} FROM f GROUP BY unit_id),
y AS (SELECT a.unit_id AS unit_a, b.unit_id AS unit_b, CAST(f.unit_id = b.unit_id AS INTEGER) AS class_label, round({_TO_MEANS}, 6) AS score FROM mu a JOIN mu b ON a.unit_id < b.unit_id JOIN f ON f.unit_id IN (a.unit_id, b.unit_id))
SELECT CAST(unit_a AS BIGINT) AS unit_a, CAST(unit_b AS BIGINT) AS unit_b, round(auc, 6) AS auc FROM ({_auc('y', 'unit_a, unit_b')})""")
def pairwise_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nearest-centroid model per pair of units, from one pass of unit moments."""
    return candidates.pairwise_auc(scalar_matrix(spark, sf_dir), SCALARS, "nearest_centroid", digits=6).select("unit_a", "unit_b", r6("auc").alias("auc"))


@register("m16_pairwise_lda")
def pairwise_lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian classes with pooled covariance per pair of units on the whole feature matrix."""
    return candidates.pairwise_auc(matrix(spark, sf_dir), NAMES, "lda").select("unit_a", "unit_b", r6("auc").alias("auc"))


# --- clusterings (a fixed assignment, so that SQL can repeat it) ----------------------------------------

_CLUSTERED = f"{sql.SNIPPETS}, c AS (SELECT *, CAST(snippet_id * 7 % 10 AS INTEGER) AS cluster_id FROM s WHERE unit_id > 0), t AS (SELECT unit_id AS truth, cluster_id AS cluster, count(*) AS n FROM c GROUP BY ALL)"


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).where("class_label = 1 and unit_id > 0").withColumn("cluster_id", (F.col("snippet_id") * 7 % 10).cast("int"))


@register("a23_contingency", f"WITH {_CLUSTERED} SELECT truth, cluster, n FROM t")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contingency(clustered(spark, sf_dir))


@register("a22_purity", f"WITH {_CLUSTERED} SELECT round(sum(m) / sum(n), 6) AS purity FROM (SELECT cluster, max(n) AS m, sum(n) AS n FROM t GROUP BY cluster)")
def purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.purity(metrics.contingency(clustered(spark, sf_dir))).select(r6("purity").alias("purity"))


@register("a24_ari", f"""WITH {_CLUSTERED}, x AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS c, (SELECT sum(n) FROM t) AS t,
  (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM t GROUP BY truth)) AS a, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM t GROUP BY cluster)) AS b)
SELECT round((c - a * b / (t * (t - 1) / 2.0)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2.0)), 6) AS ari FROM x""")
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ari(metrics.contingency(clustered(spark, sf_dir))).select(r6("ari").alias("ari"))


@register("a25_nmi", f"""WITH {_CLUSTERED}, p AS (SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY truth) AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY cluster) AS DOUBLE) AS b FROM t)
SELECT round(2 * sum(n / t * ln(n * t / (a * b))) / (-sum(n / t * ln(a / t)) - sum(n / t * ln(b / t))), 6) AS nmi FROM p""")
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nmi(metrics.contingency(clustered(spark, sf_dir))).select(r6("nmi").alias("nmi"))


def _matched_sql(units: int = 9) -> str:
    """The best one-to-one matching by dynamic programming over sets of used clusters, one step per unit."""
    steps = ["m0 AS (SELECT CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS total)"]
    for i in range(1, units + 1):
        steps.append(
            f"m{i} AS (SELECT mask, max(total) AS total FROM (SELECT mask, total FROM m{i - 1} UNION ALL "
            f"SELECT mask + (1 << cluster), total + n FROM m{i - 1} JOIN t ON truth = {i} AND mask & (1 << cluster) = 0) GROUP BY mask)"
        )
    return f"WITH {_CLUSTERED}, {', '.join(steps)} SELECT matched, total, round(matched / total, 6) AS matched_accuracy FROM (SELECT CAST(max(total) AS BIGINT) AS matched FROM m{units}), (SELECT CAST(sum(n) AS BIGINT) AS total FROM t)"


@register("a23_matched_accuracy", _matched_sql())
def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = materialize(metrics.contingency(clustered(spark, sf_dir)))
    accuracy, _ = metrics.matched_accuracy(table)
    total = table.agg(F.sum("n")).first()[0]
    return spark.createDataFrame([(round(accuracy * total), total, round(accuracy, 6))], "matched long, total long, matched_accuracy double")


@register("m21_lloyd_step", f"""WITH {sql.SNIPPETS}, ce AS (SELECT CAST(snippet_id AS INTEGER) AS cluster_id, w AS center FROM s WHERE snippet_id < 5)
SELECT s.snippet_id, arg_min(cluster_id, (round(list_sum(list_transform(range(1, 65), lambda i: pow(s.w[i] - ce.center[i], 2))), 9), cluster_id)) AS cluster_id FROM s, ce GROUP BY s.snippet_id""")
def lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snippets(spark, sf_dir)
    centers = s.where("snippet_id < 5").select(F.col("snippet_id").cast("int").alias("cluster_id"), F.col("w").alias("center"))
    return cluster.lloyd_step(s, centers)


@register("m22_clustering_benchmark")
def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = cluster.benchmark(matrix(spark, sf_dir), NAMES)
    return spark.createDataFrame(rows)


_SPLIT = f"h AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY {_KEY}) <= round(count(*) OVER (PARTITION BY class_label) * 0.25) AS is_test FROM f)"
_MEANS = ", ".join(f"avg({n}) FILTER (class_label = {c} AND NOT is_test) AS {n}_{c}" for n in SCALARS for c in (0, 1))
_D0, _D1 = (" + ".join(f"pow(h.{n} - ce.{n}_{c}, 2)" for n in SCALARS) for c in (0, 1))
_HELD = f"""{_SCALAR}, {_SPLIT}, ce AS (SELECT {_MEANS} FROM h), hs AS (SELECT class_label, round(1 / (1 + exp(({_D1}) - ({_D0}))), 12) AS score FROM h, ce WHERE is_test),
hp AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS predicted FROM hs)"""


@register("m26_holdout_evaluation", f"""WITH {_HELD}, c AS (SELECT count(*) FILTER (class_label = 1 AND predicted = 1) AS tp, count(*) FILTER (class_label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (class_label = 0 AND predicted = 0) AS tn, count(*) FILTER (class_label = 1 AND predicted = 0) AS fn FROM hp), au AS ({_auc('hp')})
SELECT tp, fp, tn, fn, round(tp / (tp + fp + 1e-12), 6) AS precision, round(tp / (tp + fn + 1e-12), 6) AS recall, round(fp / (fp + tn + 1e-12), 6) AS fpr,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(auc, 6) AS auc FROM c, au""")
def holdout_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rounded_centroid(train: DataFrame, names: list[str], label: str) -> models.Fits:
        return {m: F.round(c, 12) for m, c in models.nearest_centroid(train, names, label).items()}

    r = models.holdout_evaluation(scalar_matrix(spark, sf_dir), SCALARS, rounded_centroid)
    return r.select("tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "fpr", "f1", "balanced_accuracy", "auc")])


def _closed_board_sql() -> str:
    """Single scalar features and their pairs: centroid, Gaussian classes of one or two features, and the code bank, by fold."""
    sets = [(a,) for a in SCALARS] + [(a, b) for i, a in enumerate(SCALARS) for b in SCALARS[i + 1 :]]
    rows = " UNION ALL ".join(
        f"SELECT '{' + '.join(c)}' AS candidate, {len(c)} AS n_features, snippet_id, class_label, fold, {c[0]} AS x, {c[1] if len(c) > 1 else '0.0'} AS y FROM fo" for c in sets
    )
    means = ", ".join(f"avg({v}) FILTER (t.class_label = {c}) AS {v}{c}" for v in "xy" for c in (0, 1))
    sizes = ", ".join(f"count(*) FILTER (t.class_label = {c}) AS n{c}" for c in (0, 1))
    pooled = ", ".join(
        f"(regr_count({a}, {b}) FILTER (t.class_label = 0) * covar_pop({a}, {b}) FILTER (t.class_label = 0) + regr_count({a}, {b}) FILTER (t.class_label = 1) * covar_pop({a}, {b}) FILTER (t.class_label = 1)) / (count(*) - 2) AS {a}{b}"
        for a, b in ("xx", "xy", "yy")
    )
    members = ", ".join(f"('{' + '.join(c)}', '{f}')" for c in sets for f in c)
    levels = ", ".join(str(b / 9) for b in range(10))
    return f"""WITH {_SCALAR}, {_FOLDS}, r AS ({rows}),
g AS (SELECT candidate, k, {means}, {sizes}, {pooled} FROM r t, (SELECT unnest(range(5)) AS k) WHERE t.fold <> k GROUP BY candidate, k),
w AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, CASE WHEN yy = 0 THEN 1.0 ELSE yy END AS yv FROM g),
v AS (SELECT *, (yv * dx - xy * dy) / (xx * yv - xy * xy) AS wx, (xx * dy - xy * dx) / (xx * yv - xy * xy) AS wy FROM w),
{sql.long_features(SCALARS, '(SELECT * FROM fo)').replace('SELECT snippet_id', 'SELECT fold, snippet_id')},
q AS (SELECT feature, k, quantile_cont(value, [{levels}]) AS c FROM l, (SELECT unnest(range(5)) AS k) WHERE fold <> k AND class_label = 1 GROUP BY ALL),
m AS (SELECT feature, k, c, list_transform(range(1, 11), lambda i: greatest(1e-6, 0.5 * ((c[greatest(i, 2)] - c[greatest(i, 2) - 1]) + (c[least(i + 1, 10)] - c[least(i + 1, 10) - 1])) / 2)) AS s FROM q),
act AS (SELECT snippet_id, class_label, fold, l.feature, list_max(list_transform(range(1, 11), lambda i: exp(-0.5 * ((value - c[i]) / (s[i] + 1e-10)) * ((value - c[i]) / (s[i] + 1e-10))))) AS a FROM l JOIN m ON l.feature = m.feature AND l.fold = m.k),
mem AS (SELECT * FROM (VALUES {members}) t(candidate, feature)),
sc AS (
  SELECT r.candidate, 'nearest_centroid' AS model, fold, class_label, 1 / (1 + exp(-(2 * x * dx + 2 * y * dy + x0 * x0 + y0 * y0 - x1 * x1 - y1 * y1))) AS score FROM r JOIN v ON r.candidate = v.candidate AND fold = k
  UNION ALL SELECT r.candidate, 'lda', fold, class_label, 1 / (1 + exp(-(x * wx + y * wy - 0.5 * ((x1 + x0) * wx + (y1 + y0) * wy) + ln(n1 / n0)))) FROM r JOIN v ON r.candidate = v.candidate AND fold = k
  UNION ALL SELECT candidate, 'threshold_weight_bank', fold, class_label, avg(a) FROM act JOIN mem USING (feature) GROUP BY candidate, snippet_id, fold, class_label),
z AS (SELECT candidate, model, fold, class_label, round(score, 9) AS score FROM sc),
ba AS (SELECT candidate, model, fold, avg(h) AS b FROM (SELECT candidate, model, fold, class_label, avg(CAST(class_label = CAST(score >= 0.5 AS INTEGER) AS DOUBLE)) AS h FROM z GROUP BY ALL) GROUP BY ALL),
au AS ({_auc('z', 'candidate, model, fold')})
SELECT candidate, model, CAST(any_value(n_features) AS INTEGER) AS n_features, round(avg(b), 6) AS balanced_acc_mean, round(stddev_pop(b), 6) AS balanced_acc_std, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std
FROM ba JOIN au USING (candidate, model, fold) JOIN (SELECT DISTINCT candidate, n_features FROM r) USING (candidate) GROUP BY candidate, model"""


CLOSED_BOARD = _closed_board_sql()


@register("m24_closed_form_board", CLOSED_BOARD)
def closed_form_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoreboard's rows for which SQL has closed forms: one and two scalar features, three models, five folds."""
    df = models.stratified_folds(scalar_matrix(spark, sf_dir))
    told = candidates.board(df, candidates.scalar_combinations(SCALARS, 2), list(candidates.CLOSED), silhouettes=False, digits=9)
    return told.select("candidate", "model", "n_features", *[r6(c).alias(c) for c in ("balanced_acc_mean", "balanced_acc_std", "auc_mean", "auc_std")])


_BINS = (3, 5, 8, 12, 16)


@register("m24_scoreboard")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature families alone and together, single scalar features and their pairs; scaled in the fold; five folds."""
    bins, events = list(k.temporal_bin_names(8)), list(k.EVENT_FEATURES)
    families = {"scalar": SCALARS, "event": events, "temporal": bins, "scalar_temporal": SCALARS + bins, "full": NAMES}
    listed = [candidates.Candidate(n, f, "family") for n, f in families.items()] + candidates.scalar_combinations(SCALARS, 2)
    return candidates.board(models.stratified_folds(matrix(spark, sf_dir)), listed, models.SCOREBOARD_MODELS)


@register("m25_temporal_sweep")
def temporal_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal features of 3 to 16 bins, alone and beside the scalar ones: one matrix of all bins, shared passes."""
    return candidates.board(models.stratified_folds(sweep_matrix(spark, sf_dir)), sweep_candidates(), models.SCOREBOARD_MODELS)


def sweep_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar features and the temporal ones of every bin count, named by it."""
    out = snippets(spark, sf_dir)
    for n in _BINS:
        w = out.columns if n == _BINS[0] else None  # scalar features come with the first
        made = build_features(out.withColumn("__w", F.col("w")), FeatureConfig(temporal=TemporalConfig(n_bins=n)), only=None if w else k.temporal_bin_names(n))
        # written after each, as every pass in one plan would hold a Python worker of its own
        out = materialize(made.withColumnsRenamed({b: f"bins{n:02d}_{b}" for b in k.temporal_bin_names(n)}).withColumnRenamed("__w", "w"))
    return out.drop("w")


def sweep_candidates() -> list[candidates.Candidate]:
    out = []
    for n in _BINS:
        own = [f"bins{n:02d}_{b}" for b in k.temporal_bin_names(n)]
        out += [candidates.Candidate(f"bins_{n:02d}", own, "temporal", n), candidates.Candidate(f"scalar_bins_{n:02d}", SCALARS + own, "scalar_temporal", n)]
    return out


def _sweep_sql() -> str:
    """The sweep's centroid rows: every feature adds its part to the difference of squared distances."""
    columns = dict(sql.SCALARS) | {f"bins{n:02d}_{b}": e for n in _BINS for b, e in sql.temporal(n).items()}
    long_rows = " UNION ALL ".join(f"SELECT snippet_id, class_label, '{n}' AS feature, {e} AS value FROM d" for n, e in columns.items())
    members = ", ".join(f"('{c.name}', {c.n_time_bins}, {len(c.features)}, '{f}')" for c in sweep_candidates() for f in c.features)
    return f"""WITH {sql.SNIPPETS}, {sql.STAGED}, {_FOLDS.replace('FROM f)', 'FROM s)')}, x AS ({long_rows}), l AS (SELECT x.*, fold FROM x JOIN (SELECT snippet_id, fold FROM fo) USING (snippet_id)),
mu AS (SELECT feature, k, avg(value) FILTER (class_label = 0) AS m0, avg(value) FILTER (class_label = 1) AS m1 FROM l, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY feature, k),
mem AS (SELECT * FROM (VALUES {members}) t(candidate, n_time_bins, n_features, feature)),
z AS (SELECT candidate, fold, class_label, round(1 / (1 + exp(-sum(2 * value * (m1 - m0) + m0 * m0 - m1 * m1))), 9) AS score FROM l JOIN mu ON l.feature = mu.feature AND fold = k JOIN mem ON mem.feature = l.feature GROUP BY candidate, snippet_id, fold, class_label),
ba AS (SELECT candidate, fold, avg(h) AS b FROM (SELECT candidate, fold, class_label, avg(CAST(class_label = CAST(score >= 0.5 AS INTEGER) AS DOUBLE)) AS h FROM z GROUP BY ALL) GROUP BY ALL),
au AS ({_auc('z', 'candidate, fold')})
SELECT candidate, CAST(any_value(n_time_bins) AS INTEGER) AS n_time_bins, CAST(any_value(n_features) AS INTEGER) AS n_features, round(avg(b), 6) AS balanced_acc_mean, round(stddev_pop(b), 6) AS balanced_acc_std, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std
FROM ba JOIN au USING (candidate, fold) JOIN (SELECT DISTINCT candidate, n_time_bins, n_features FROM mem) USING (candidate) GROUP BY candidate"""


@register("m25_sweep_centroids", _sweep_sql())
def sweep_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temporal sweep for the model that SQL can repeat at any number of features."""
    told = candidates.board(models.stratified_folds(sweep_matrix(spark, sf_dir)), sweep_candidates(), ["nearest_centroid"], silhouettes=False, digits=9)
    return told.select("candidate", "n_time_bins", "n_features", *[r6(c).alias(c) for c in ("balanced_acc_mean", "balanced_acc_std", "auc_mean", "auc_std")])
