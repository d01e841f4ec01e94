"""The registered clustering benchmark ranks every family with the operator's own starts and rounds."""

import inspect

from wavemill.operators import cluster, neighbors
from wavemill.operators.features import families
from wavemill.plans import metric_queries


def test_silhouette_of_a_row_alone_is_zero(spark):
    rows = [(0, [0.0], 0), (1, [1.0], 0), (2, [9.0], 1)]
    df = spark.createDataFrame(rows, "snippet_id long, w array<double>, unit_id int")
    want = ((9 - 1) / 9 + (8 - 1) / 8 + 0) / 3
    assert abs(neighbors.silhouette(df).first()["silhouette"] - want) < 1e-12


def test_benchmark_covers_all_families(spark, sf_dir, monkeypatch):
    seen = []

    def quick(df, k, **options):
        seen.append((options["n_init"], options["max_iter"]))
        return kmeans(df, k, **options | {"n_init": 1, "max_iter": 2})

    kmeans = cluster.kmeans
    monkeypatch.setattr(cluster, "kmeans", quick)
    rows = metric_queries.benchmark(spark, sf_dir).collect()
    want = families(metric_queries.NAMES)
    assert {r["family"]: r["feature_names"] for r in rows} == {f: ",".join(m) for f, m in want.items()}
    assert {r["family"] for r in rows} == {"scalar", "temporal_mad", "event", "full"}
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4]
    defaults = inspect.signature(cluster.benchmark).parameters
    assert set(seen) == {(defaults["n_init"].default, defaults["max_iter"].default)} == {(10, 300)}
