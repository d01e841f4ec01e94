"""Metric index, seeding, shared fits, halo windows and the reordering detector against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import candidates, cluster, metric_index, models, neighbors, spikes
from wavemill.streaming import streams


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "snippet_id long, w array<double>")


def plain_neighbours(x, ids, k):
    out = set()
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    for i in range(len(x)):
        order = [j for j in np.lexsort((ids, d[i])) if j != i][:k]
        out |= {(int(ids[i]), int(ids[j]), r + 1) for r, j in enumerate(order)}
    return out


CLOUDS = {
    "clusters": lambda rng: np.concatenate([rng.normal(c * 30, 1, (80, 5)) for c in range(6)]),
    "uniform": lambda rng: rng.uniform(0, 1, (300, 8)),
    "copies": lambda rng: np.concatenate([np.tile(rng.normal(0, 1, 4), (150, 1)), rng.normal(0, 1, (120, 4)), np.tile(rng.normal(0, 1, 4), (40, 1))]),
    "grid": lambda rng: np.stack(np.meshgrid(np.arange(15), np.arange(15)), -1).reshape(-1, 2).astype(float),
    "few": lambda rng: rng.normal(0, 1, (3, 2)),
}


@pytest.mark.parametrize("name", CLOUDS)
def test_index_finds_the_exact_neighbours(spark, name):
    rng = np.random.default_rng(1)
    x = CLOUDS[name](rng)
    ids = rng.permutation(len(x)) * 3 - 50
    for block_rows in (16, 16_384):
        got = {(r["id"], r["neighbor_id"], r["rank"]) for r in neighbors.knn(vectors(spark, x, ids), 4, block_rows=block_rows).collect()}
        assert got == plain_neighbours(x, ids, 4)
    assert neighbors.knn(vectors(spark, x).limit(0), 4).count() == 0


def test_index_visits_few_blocks_where_there_are_clusters(spark):
    rng = np.random.default_rng(2)
    report: list = []
    x = np.concatenate([rng.normal(c * 100, 1, (100, 6)) for c in range(20)])
    neighbors.knn(vectors(spark, x), 5, block_rows=50, report=report).count()
    blocks = report[0][2]
    assert blocks >= 40 and sum(visits for _, visits, _ in report) < 0.25 * blocks * len(x)


def test_blocks_cover_every_vector_once(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((5, 3)), rng.normal(0, 1, (500, 3))])
    own, members, n = metric_index.distinct_vectors(vectors(spark, x), 3, id_col="snippet_id", vector_col="w")
    assert n == 501 and members.count() == 505 and own.where("rep = 0").first()["ids"] == [0, 1, 2]
    index = metric_index.build(own, n, block_rows=20)
    rows = index.rows.collect()
    assert sorted(r["rep"] for r in rows) == [0, *range(5, 505)]
    for r in rows:
        d = np.sqrt(((np.array(r["vec"]) - index.pivots[index.cell[r["block"]]]) ** 2).sum())
        assert index.low[r["block"]] - 1e-9 <= d <= index.high[r["block"]] + 1e-9


def test_classification_by_the_index(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (200, 3)), rng.integers(0, 3, 200)
    q = np.concatenate([rng.normal(0, 1, (40, 3)), x[:5], x[:5]])
    train = vectors(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "snippet_id long, class_label int"), "snippet_id")
    got = {r["id"]: r["predicted"] for r in neighbors.knn_classify(train, vectors(spark, q), 5, block_rows=16).collect()}
    for i, v in enumerate(q):
        near = np.lexsort((np.arange(200), np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)))[:5]
        votes = np.bincount(y[near], minlength=3)
        assert got[i] == votes.argmax()


def _plain_kmeans(x, k, starts=10):
    best = np.inf
    for s in range(starts):
        rng = np.random.default_rng(s)
        c = [x[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - np.array(c)[None]) ** 2).sum(-1).min(1)
            c.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() else 0])
        c = np.array(c)
        for _ in range(300):
            at = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
            if np.abs(new - c).max() < 1e-9:
                break
            c = new
        best = min(best, ((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum())
    return best


SHAPES = {
    "separate": (lambda rng: np.concatenate([rng.normal(c * 8, 1, (40, 3)) for c in range(8)]), 8),
    "uneven": (lambda rng: np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(20, 0.3, (15, 2)), rng.normal((20, -20), 0.3, (5, 2))]), 4),
    "loose": (lambda rng: rng.normal(0, 1, (250, 4)), 6),
    "copies": (lambda rng: np.repeat(np.eye(4) * 5, 30, axis=0), 4),
}


@pytest.mark.parametrize("name", SHAPES)
def test_seeding_from_all_rows_is_no_worse(spark, name):
    make, k = SHAPES[name]
    x = make(np.random.default_rng(6))
    out, inertia = cluster.kmeans(vectors(spark, x), k, vector_col="w")
    assert inertia <= _plain_kmeans(x, k) * (1.01 if name == "loose" else 1.0001) + 1e-9
    found = {r["snippet_id"]: r["cluster_id"] for r in out.collect()}
    assert len(found) == len(x) and set(found.values()) <= set(range(k))


def test_seeds_do_not_depend_on_the_partitions(spark):
    x = np.random.default_rng(7).normal(0, 1, (200, 3))
    df = vectors(spark, x).select(F.xxhash64("snippet_id").alias("h"), F.col("w").alias("v"))
    a, b = (cluster.seed_centers(df.repartition(n), 5, 2) for n in (1, 7))
    assert a == pytest.approx(b)
    with pytest.raises(ValueError):
        cluster.seed_centers(df.limit(0), 5, 2)


def labelled(spark, n=120, seed=8):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = np.stack([rng.normal(y * 1.5, 1), 1000 * rng.normal(y, 2) + 5000, rng.normal(0, 1e-3, n), np.full(n, 7.0)], 1)
    rows = [(i, int(y[i]), int(y[i] * (1 + i % 3)), *map(float, x[i])) for i in range(n)]
    return models.stratified_folds(spark.createDataFrame(rows, "snippet_id long, class_label int, unit_id int, a double, b double, c double, d double"), 4)


def test_scaling_belongs_to_the_fold(spark):
    """Weights folded into raw columns give the scores of models fitted on scaled copies of the training folds."""
    df = labelled(spark)
    rows = df.toPandas().sort_values("snippet_id").reset_index(drop=True)
    listed = [candidates.Candidate("ab", ["a", "b"]), candidates.Candidate("all", ["c", "a", "d", "b"])]
    long, fitted = candidates.scores(df, listed, ["lda", "logistic_regression", "linear_svm", "knn_k5", "nearest_centroid"])
    got = {(r["candidate"], r["model"], r["id"]): r["score"] for r in long.collect()}
    assert not fitted.errors and len(got) == 2 * 5 * 120
    for c, cand in enumerate(listed):
        for f in range(4):
            test, train = rows[rows.fold == f], rows[rows.fold != f]
            mean, sd = train[cand.features].mean().to_numpy(), train[cand.features].std(ddof=0).to_numpy()
            sd = np.where(sd < 1e-9, 1.0, sd)
            scaled = rows.assign(**{n: (rows[n] - mean[i]) / sd[i] for i, n in enumerate(cand.features)})
            copy = spark.createDataFrame(scaled)
            for m in ("lda", "logistic_regression", "linear_svm"):
                col = models.fit_one(copy.where(F.col("fold") != f), cand.features, m)
                for r in copy.where(F.col("fold") == f).withColumn("s", col).collect():
                    assert got[c, m, r["snippet_id"]] == pytest.approx(r["s"], abs=2e-5), (m, f)
            z = scaled.loc[train.index, cand.features].to_numpy()
            for i in test.index:
                d = np.round(np.sqrt(((z - scaled.loc[i, cand.features].to_numpy(float)) ** 2).sum(1)), 9)
                near = np.lexsort((train["snippet_id"], d))[:5]
                assert got[c, "knn_k5", rows.loc[i, "snippet_id"]] == pytest.approx(train["class_label"].to_numpy()[near].mean())


def test_board_measures_and_failures(spark):
    df = labelled(spark)
    listed = [candidates.Candidate("a", ["a"], "one"), candidates.Candidate("gone", ["a", "absent"]), candidates.Candidate("none", []), *candidates.scalar_combinations(["a", "b", "c"], 3, per_size=2)]
    out = candidates.board(df, listed, ["lda", "threshold_weight_bank", "unheard_of"])
    rows = {(r["candidate"], r["model"]): r for r in out.collect()}
    assert len(rows) == 3 * (3 + 2 + 2 + 1) - 3 * ("a" in [c.name for c in listed[3:]])
    assert rows["gone", "lda"]["error"] == "missing columns: absent" and rows["none", "lda"]["error"] and rows["gone", "lda"]["auc_mean"] is None
    assert rows["a", "unheard_of"]["error"] == "unknown model unheard_of"
    long, _ = candidates.scores(df, listed[:1], ["lda"])
    per = []
    for f in range(4):
        s = [(r["score"], r["label"]) for r in long.where(F.col("fold") == f).collect()]
        per.append(np.mean([(p > q) + 0.5 * (p == q) for p, y in s if y for q, z in s if not z]))
    r = rows["a", "lda"]
    assert r["auc_mean"] == pytest.approx(np.mean(per)) and r["auc_std"] == pytest.approx(np.std(per)) and r["error"] is None and r["n_features"] == 1
    one = df.where("class_label = 1")
    assert all(r["error"] for r in candidates.board(one, listed[:1], ["lda", "knn_k5"]).collect())


def test_silhouettes_of_many_sets_in_one_pass(spark):
    df = labelled(spark)
    out = {r["candidate"]: r for r in candidates.board(df, [candidates.Candidate("a", ["a"]), candidates.Candidate("ab", ["a", "b"])], ["nearest_centroid"]).collect()}
    for name, cols in (("a", ["a"]), ("ab", ["a", "b"])):
        for label, where, column in (("class_label", "true", "silhouette_class"), ("unit_id", "class_label = 1 and unit_id > 0", "silhouette_units")):
            own = models.standardized(df.where(where), cols).withColumn("w", F.array(*cols))
            assert out[name][column] == pytest.approx(neighbors.silhouette(own, label_col=label).first()["silhouette"])


@pytest.mark.parametrize("model", ["nearest_centroid", "lda", "logistic_regression", "linear_svm"])
def test_a_model_for_every_pair(spark, model):
    df = labelled(spark, 80).withColumn("unit_id", (F.col("snippet_id") % 4).cast("int")).withColumn("b", F.col("b") / 1000)
    got = {(r["unit_a"], r["unit_b"]): r["auc"] for r in candidates.pairwise_auc(df, ["a", "b"], model).collect()}
    assert set(got) == {(i, j) for i in range(4) for j in range(i + 1, 4)}
    for (i, j), auc in got.items():
        pair = df.where(F.col("unit_id").isin(i, j)).withColumn("class_label", (F.col("unit_id") == j).cast("int"))
        s = [(round(r["s"], 12), r["class_label"]) for r in pair.withColumn("s", models.fit_one(pair, ["a", "b"], model)).collect()]
        assert auc == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p, y in s if y for q, z in s if not z]), abs=0.01)
    with pytest.raises(ValueError):
        candidates.pairwise_auc(df, ["a"], model, max_units=3)


def test_rolling_threshold_of_one_channel_over_many_tasks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, 3000)
    df = spark.createDataFrame([("hot", int(i), float(v)) for i, v in enumerate(x)] + [("cold", 1, -2.0), (None, 5, 1.0)], "channel string, i int, value double")
    out = spikes.rolling_threshold(df, channel_col="channel", order_col="i", value_col="value", window=64, multiplier=1.5, block_rows=200)
    assert out.columns == ["channel", "i", "value", "rms", "crossing"] and out.count() == 3002
    for r in out.where("channel = 'hot'").collect():
        want = np.sqrt((x[max(0, r["i"] - 63) : r["i"] + 1] ** 2).mean())
        assert r["rms"] == pytest.approx(want) and r["crossing"] == (r["value"] < -1.5 * want)
    blocks = -(-3000 // 200)
    assert blocks > 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_samples_out_of_order_give_the_batch_rows(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows, want = [], set()
    for channel in ("a", "b"):
        x = rng.normal(0, 1, 3000)
        for p in (700, 1500, 1510, 2990):
            x[p : p + 5] -= [20, 30, 25, 15, 5]
        want |= {(channel, i, tuple(s)) for i, s in streams.Detector().step(([], [], -(1 << 60), []), np.arange(3000), x)[1]}
        rows += [(channel, i, float(v), 1_700_000_000 + i / 1000) for i, v in enumerate(x)]
    assert len(want) == 4
    order = np.argsort([r[3] + rng.uniform(0, 0.4) for r in rows], kind="stable")  # late by up to 0.4 seconds
    df = spark.createDataFrame([rows[i] for i in order], "channel string, sample_index long, value double, t double")
    df = df.select("channel", "sample_index", "value", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    for k in range(5):
        part = spark.createDataFrame(df.collect()[1200 * k : 1200 * (k + 1)], df.schema)
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    ends = spark.createDataFrame([("a", None, None), ("b", None, None)], "channel string, sample_index long, value double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_003)))
    ends.coalesce(1).write.parquet(str(tmp_path / "in/9"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    streams.state_store(spark)
    try:
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        got = streams.run_to_table(streams.detect(src, late="1 second"), "reordered").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {(r["channel"], r["trough_index"], tuple(r["snippet"])) for r in got} == want and len(got) == len(want)
