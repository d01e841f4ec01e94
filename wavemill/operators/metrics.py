"""Classification, ranking and clustering metrics as aggregates; nothing but counts reaches one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import materialize, running_sums

EPS = 1e-12


def fisher(value: Column, label: Column) -> Column:
    """(difference of class means)^2 / (sum of population variances); 0 with fewer than two rows in a class."""
    one, zero = F.when(label == 1, value), F.when(label == 0, value)
    ratio = F.pow(F.avg(one) - F.avg(zero), F.lit(2)) / (F.var_pop(one) + F.var_pop(zero) + EPS)
    return F.when((F.count(one) >= 2) & (F.count(zero) >= 2), ratio).otherwise(F.lit(0.0))


def fisher_scores(long: DataFrame, *, label_col: str = "class_label") -> DataFrame:
    """Fisher score of every feature of a long table (feature, value, label) in one aggregate."""
    return long.groupBy("feature").agg(fisher(F.col("value"), F.col(label_col)).alias("fisher_score"))


def mutual_information(long: DataFrame, *, label_col: str = "class_label", n_bins: int = 20) -> DataFrame:
    """Mutual information (nats) of every feature, cut into equal-width bins, with the label."""
    span = long.groupBy("feature").agg(F.min("value").alias("lo"), (F.max("value") + 1e-10).alias("hi"))
    bin_ = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n_bins)), F.lit(n_bins)).cast("int")
    joint = long.join(F.broadcast(span), "feature").groupBy("feature", bin_.alias("bin"), F.col(label_col).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy
    p = joint.withColumns({"t": F.sum("n").over(by("feature")), "nb": F.sum("n").over(by("feature", "bin")), "ny": F.sum("n").over(by("feature", "y"))})
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))
    return p.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("mutual_info"))


def confusion(actual: Column, predicted: Column) -> dict[str, Column]:
    """Counts tp, fp, tn, fn and the ratios precision, recall and false-positive rate."""

    def n(a: int, p: int) -> Column:
        return F.count(F.when((actual == a) & (predicted == p), 1))

    tp, fp, tn, fn = n(1, 1), n(0, 1), n(0, 0), n(1, 0)
    return {
        "tp": tp, "fp": fp, "tn": tn, "fn": fn,
        "precision": tp / (tp + fp + EPS), "recall": tp / (tp + fn + EPS), "fpr": fp / (fp + tn + EPS),
    }


def balanced_accuracy(df: DataFrame, *, actual: str = "class_label", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Mean of the per-class recalls, per group."""
    by = by or []
    recall = df.groupBy(*by, actual).agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("r"))
    return recall.groupBy(*by).agg(F.avg("r").alias("balanced_accuracy"))


def f1(actual: Column, predicted: Column) -> Column:
    """F1 of class 1; 0 where it is undefined."""
    c = confusion(actual, predicted)
    denominator = 2 * c["tp"] + c["fp"] + c["fn"]
    return F.when(denominator > 0, 2 * c["tp"] / denominator).otherwise(F.lit(0.0))


def f1_macro(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    """Unweighted mean of the classes' F1 scores."""
    rows = df.select(F.explode(F.array_distinct(F.array(actual, predicted))).alias("c"), F.col(actual).alias("a"), F.col(predicted).alias("p"))
    per = rows.groupBy("c").agg(F.count(F.when((F.col("a") == F.col("c")) & (F.col("p") == F.col("c")), 1)).alias("tp"), F.count(F.lit(1)).alias("any"))
    # rows of a class are those where it is actual or predicted: tp + fp + fn
    return per.agg(F.avg(2 * F.col("tp") / (F.col("any") + F.col("tp"))).alias("f1_macro"))


def _score_steps(df: DataFrame, score: str, label: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score, then running counts from the highest score down, and the totals."""
    steps = df.groupBy(*by, F.col(score).alias("s")).agg(*[F.coalesce(F.sum(F.when(F.col(label) == k, F.col(weight) if weight else F.lit(1))), F.lit(0)).cast("long").alias(c) for k, c in ((1, "p"), (0, "n"))])
    ran = materialize(running_sums(steps, {"tp": F.col("p"), "fp": F.col("n")}, by=by, order=[F.desc("s")]))
    if not by:
        r = ran.agg(F.max("tp").alias("np"), F.max("fp").alias("nn")).first()
        return ran.withColumns({"np": F.lit(r["np"]).cast("long"), "nn": F.lit(r["nn"]).cast("long")})
    return ran.join(ran.groupBy(*by).agg(F.max("tp").alias("np"), F.max("fp").alias("nn")), by)


def roc_auc(df: DataFrame, *, score: str = "score", label: str = "class_label", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties averaged; null if a class is absent. Rows may stand for ``weight`` rows each."""
    by = by or []
    steps = _score_steps(df, score, label, by, weight)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return steps.groupBy(*by).agg(F.when((F.max("np") > 0) & (F.max("nn") > 0), area / (F.max("np") * F.max("nn"))).alias("auc"))


def roc_curve(df: DataFrame, *, score: str = "score", label: str = "class_label", by: list[str] | None = None) -> DataFrame:
    """Threshold, tpr, fpr and Youden's J at every distinct score."""
    by = by or []
    tpr, fpr = F.col("tp") / F.col("np"), F.col("fp") / F.col("nn")
    return _score_steps(df, score, label, by).where("np > 0 and nn > 0").select(*by, F.col("s").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("youden_j"))


def best_threshold(df: DataFrame, *, score: str = "score", label: str = "class_label", by: list[str] | None = None) -> DataFrame:
    """The highest threshold with the largest J."""
    by = by or []
    key = F.struct(F.round("youden_j", 12), F.col("threshold"))
    return roc_curve(df, score=score, label=label, by=by).groupBy(*by).agg(F.max_by("threshold", key).alias("threshold"), F.max("youden_j").alias("youden_j"))


# --- clusterings ----------------------------------------------------------------------------------


def contingency(df: DataFrame, *, truth: str = "unit_id", cluster: str = "cluster_id", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def purity(table: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """Share of rows in the majority class of their cluster."""
    by = by or []
    top = table.groupBy(*by, "cluster").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return top.groupBy(*by).agg((F.sum("m") / F.sum("n")).alias("purity"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def ari(table: DataFrame) -> DataFrame:
    """Adjusted Rand index; 1 when both sides are trivial."""
    cells = table.agg(F.sum(_pairs(F.col("n"))).alias("c"), F.sum("n").alias("t"))
    rows = table.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    cols = table.groupBy("cluster").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    expected, best = a * b / _pairs(F.col("t")), (a + b) / 2
    return cells.crossJoin(rows).crossJoin(cols).select(F.when(best == expected, F.lit(1.0)).otherwise((c - expected) / (best - expected)).alias("ari"))


def nmi(table: DataFrame) -> DataFrame:
    """Mutual information over the mean of both entropies; 1 when both entropies are 0."""
    p = table.withColumns({"t": F.sum("n").over(W.partitionBy()), "a": F.sum("n").over(W.partitionBy("truth")), "b": F.sum("n").over(W.partitionBy("cluster"))})
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b"))))
    # a cell's share of its row's entropy term is n / a of it: the sum over cells is the entropy
    ha = -F.sum(F.col("n") / F.col("t") * F.log(F.col("a") / F.col("t")))
    hb = -F.sum(F.col("n") / F.col("t") * F.log(F.col("b") / F.col("t")))
    return p.agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb")).select(
        F.when(F.col("ha") + F.col("hb") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 2 * F.col("mi") / (F.col("ha") + F.col("hb")))).alias("nmi")
    )


def assignment(counts: dict[tuple[int, int], int]) -> tuple[int, dict[int, int]]:
    """Best one-to-one matching of clusters to classes from a small contingency table (a driver-side solve).

    Successive shortest augmenting paths over the cost matrix; its side is the
    number of clusters, not of rows.
    """
    truths = sorted({t for t, _ in counts})
    clusters = sorted({c for _, c in counts})
    n = max(len(truths), len(clusters))
    top = max(counts.values(), default=0)
    cost = [[top - counts.get((truths[i], clusters[j]), 0) if i < len(truths) and j < len(clusters) else top for j in range(n)] for i in range(n)]
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        slack, used, way = [inf] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while True:
            used[j] = True
            row, delta, nxt = match[j], inf, 0
            for k in range(1, n + 1):
                if not used[k]:
                    d = cost[row - 1][k - 1] - u[row] - v[k]
                    if d < slack[k]:
                        slack[k], way[k] = d, j
                    if slack[k] < delta:
                        delta, nxt = slack[k], k
            for k in range(n + 1):
                if used[k]:
                    u[match[k]] += delta
                    v[k] -= delta
                else:
                    slack[k] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = {clusters[j - 1]: truths[match[j] - 1] for j in range(1, n + 1) if j <= len(clusters) and match[j] <= len(truths)}
    return sum(counts.get((t, c), 0) for c, t in pairs.items()), pairs


def matched_accuracy(table: DataFrame) -> tuple[float, dict[int, int]]:
    counts = {(r["truth"], r["cluster"]): r["n"] for r in table.collect()}  # classes x clusters rows
    matched, pairs = assignment(counts)
    return matched / max(1, sum(counts.values())), pairs
