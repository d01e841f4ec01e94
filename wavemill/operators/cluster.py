"""KMeans over encoded snippets and the clustering benchmark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.scratch import materialize
from . import codebank, features as feats, metrics, neighbors


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0.0)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from row hashes, others for each salt; fixed values are those of the published 64-bit finaliser."""
    x = h.astype(np.int64).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _draw(rows: DataFrame, chosen: list[np.ndarray], n: int, salt: int) -> list[np.ndarray]:
    """For every start ``n`` rows, drawn by squared distance from the start's chosen ones (evenly where there are none), in one pass.

    A row's key is log(u) / weight; the largest keys of all rows are a weighted
    draw without replacement, so tasks keep their largest only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list] = {}
        for pdf in batches:
            x, h = np.stack(pdf["v"].to_numpy()).astype(float), pdf["h"].to_numpy()
            for s, have in enumerate(chosen):
                weight = _squares(x, have).min(1) if len(have) else np.ones(len(x))
                if len(have):
                    weight[weight <= 1e-12 * (1 + (x * x).sum(1))] = 0  # rounding of the product
                at = np.flatnonzero(weight > 0)
                key = np.log(_uniform(h[at], salt + s)) / weight[at]
                old = best.get(s, [np.zeros(0), np.zeros(0, np.int64), np.zeros((0, x.shape[1]))])
                key, own, vec = np.concatenate([old[0], key]), np.concatenate([old[1], h[at]]), np.concatenate([old[2], x[at]])
                top = np.lexsort((own, -key))[:n]
                best[s] = [key[top], own[top], vec[top]]
        for s, (key, own, vec) in best.items():
            if not len(key):
                continue
            yield pd.DataFrame({"start": s, "key": key, "h": own, "v": list(vec)})

    order = W.partitionBy("start").orderBy(F.desc("key"), "h")
    top = rows.mapInPandas(run, "start int, key double, h long, v array<double>").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    out: list[list] = [[] for _ in chosen]
    for r in top.orderBy("start", "r").collect():  # starts x n
        out[r["start"]].append(r["v"])
    return [np.array(v, float).reshape(-1, have.shape[1]) for v, have in zip(out, chosen)]


def _weighted_seeds(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, steps: int = 20) -> np.ndarray:
    """``k`` centers of weighted points: drawn by weight and squared distance, best of a few tries each, then moved."""
    centers = points[[rng.choice(len(points), p=weights / weights.sum())]]
    near = _squares(points, centers)[:, 0]
    tries = 2 + int(np.log(max(k, 1)))
    while len(centers) < k:
        mass = weights * near
        total = mass.sum()
        picks = rng.choice(len(points), tries, p=mass / total) if total > 0 else rng.integers(len(points), size=1)
        after = np.minimum(near[:, None], _squares(points, points[picks]))
        best = int(np.argmin(weights @ after))
        centers, near = np.vstack([centers, points[picks[best]]]), after[:, best]
    for _ in range(steps):
        member = np.eye(k)[_squares(points, centers).argmin(1)] * weights[:, None]
        n = member.sum(0)[:, None]
        centers = np.where(n > 0, member.T @ points / np.maximum(n, 1e-300), centers)
    return centers


def seed_centers(rows: DataFrame, k: int, starts: int, *, rounds: int = 4, seed: int = 42) -> np.ndarray:
    """Starting centers (starts, k, dimensions) from all rows (h, v), by oversampling in parallel rounds.

    Each round draws 2 k rows per start, all starts in one pass; one more pass
    counts the rows nearest to every drawn one, and the few weighted rows are
    reduced to k on the driver (starts x (1 + 2 k rounds) vectors).
    """
    first = rows.select("v").first()
    if first is None:
        raise ValueError("no rows to cluster")
    chosen = [np.zeros((0, len(first["v"])))] * starts
    for r in range(rounds + 1):
        drawn = _draw(rows, chosen, 1 if r == 0 else 2 * k, seed * 1_000_003 + r * 1_009)
        chosen = [np.concatenate([a, b]) for a, b in zip(chosen, drawn)]
    size = max(len(c) for c in chosen)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((starts, size))
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            for s, have in enumerate(chosen):
                total[s] += np.bincount(_squares(x, have).argmin(1), minlength=size)
        yield pd.DataFrame({"n": [total.ravel()]})

    weights = np.zeros(starts * size)
    for r in rows.select("v").mapInPandas(count, "n array<double>").select(F.posexplode("n").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect():
        weights[r["pos"]] = r["n"]
    weights = weights.reshape(starts, size)
    return np.stack([_weighted_seeds(c, weights[s, : len(c)], k, np.random.default_rng(seed + s)) for s, c in enumerate(chosen)])


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _nearest_udf(centers: np.ndarray):
    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(_squares(np.stack(vectors.to_numpy()).astype(float), centers).argmin(1), dtype="int32")

    return nearest


def kmeans(
    df: DataFrame, k: int, *, id_col: str = "snippet_id", vector_col: str | list[str] = "activations", out_col: str | list[str] = "cluster_id", n_init: int = 10, max_iter: int = 300, seed: int = 42, rounds: int = 4
) -> tuple[DataFrame, float | list[float]]:
    """``df`` with a cluster number, and the inertia of the best of ``n_init`` starts.

    Starting centers come from all rows (``seed_centers``). All starts move in the
    same passes: a task adds up its rows per start and cluster, and a pass has no
    more tasks than cores, so few vectors are moved. Starts that stand still take
    no further part. Several vector columns are clustered each by itself in the
    same passes; inertias then come as a list.
    """
    columns, outs = ([vector_col], [out_col]) if isinstance(vector_col, str) else (list(vector_col), list(out_col))
    centers = [seed_centers(df.select(F.xxhash64(id_col).alias("h"), F.col(c).cast("array<double>").alias("v")), k, n_init, rounds=rounds, seed=seed) for c in columns]
    vectors = df.select(*[F.col(c).cast("array<double>").alias(f"v{i}") for i, c in enumerate(columns)]).coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))

    def passed(moving: dict[int, list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Sums (start, cluster, [rows, vector]) and inertia by start, of each column, of all rows at the present centers."""
        shapes = {i: (len(s), k, centers[i].shape[2] + 1) for i, s in moving.items()}
        at = np.cumsum([0, *[int(np.prod(x)) + x[0] for x in shapes.values()]])
        places = {i: slice(a, b) for i, a, b in zip(shapes, at, at[1:])}
        now = {i: centers[i][s].reshape(-1, centers[i].shape[2]) for i, s in moving.items()}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(at[-1])
            for batch in (b.slice(j, 4096) for b in batches for j in range(0, b.num_rows, 4096)):
                for n, (i, c) in enumerate(now.items()):
                    x = _rows_of(batch.column(n))
                    q = _squares(x, c).reshape(len(x), -1, k)
                    near = q.argmin(2)
                    member = np.zeros((len(x), len(c)))
                    member[np.arange(len(x))[:, None], near + k * np.arange(near.shape[1])] = 1
                    own = total[places[i]]
                    own[: -near.shape[1]] += (member.T @ np.column_stack([np.ones(len(x)), x])).ravel()
                    own[-near.shape[1] :] += np.take_along_axis(q, near[:, :, None], 2).sum(axis=(0, 2))
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

        told = vectors.select(*[f"v{i}" for i in moving]).mapInArrow(sums, "v binary").collect()  # a vector per core
        v = sum((np.frombuffer(r["v"]) for r in told), np.zeros(at[-1]))
        return {i: (v[places[i]][: -x[0]].reshape(x), v[places[i]][-x[0] :]) for i, x in shapes.items()}

    inertia = [np.full(n_init, np.inf) for _ in columns]
    moving = {i: list(range(n_init)) for i in range(len(columns))}
    for _ in range(max_iter):
        for i, (total, cost) in passed(moving).items():
            inertia[i][moving[i]] = cost
            n, old = total[:, :, :1], centers[i][moving[i]]
            new = np.where(n > 0, total[:, :, 1:] / np.maximum(n, 1), old)  # an empty cluster stays where it is
            centers[i][moving[i]] = new
            moving[i] = [s for s, moved in zip(moving[i], np.abs(new - old).max(axis=(1, 2)) >= 1e-9) if moved]
        moving = {i: s for i, s in moving.items() if s}
        if not moving:
            break
    if moving:
        for i, (_, cost) in passed(moving).items():
            inertia[i][moving[i]] = cost
    out = df
    for c, name, own, cost in zip(columns, outs, centers, inertia):
        out = out.withColumn(name, _nearest_udf(own[int(np.argmin(cost))])(F.col(c)))
    least = [float(c.min()) for c in inertia]
    return out, least[0] if isinstance(vector_col, str) else least


def lloyd_step(df: DataFrame, centers: DataFrame, *, id_col: str = "snippet_id", vector_col: str = "w") -> DataFrame:
    """(id, cluster_id): nearest center of a small table (cluster_id, center), the lowest number on ties."""
    distance = F.aggregate(F.zip_with(vector_col, "center", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x)
    pairs = df.select(id_col, vector_col).join(F.broadcast(centers), how="cross").withColumn("d", F.round(distance, 9))
    return pairs.groupBy(id_col).agg(F.min_by("cluster_id", F.struct("d", "cluster_id")).alias("cluster_id"))


def benchmark(features: DataFrame, names: list[str], *, id_col: str = "snippet_id", unit_col: str = "unit_id", label_col: str = "class_label", n_bins: int = 10, n_init: int = 10, max_iter: int = 300, seed: int = 42, ks: tuple[int, ...] = (1, 5, 10, 20), enabled: bool = True, output: str | None = None) -> tuple[list[dict], dict]:
    """Cluster every family's activations of known units and compare with the units.

    Returns one row per family, ranked by (matched accuracy, ari, nmi), and a
    summary. With fewer than two units, or disabled, there are no rows and the
    summary says so. ``output`` writes assignments partitioned by family.
    """
    if not enabled:
        return [], {"status": "disabled"}
    known = materialize(features.where((F.col(label_col) == 1) & (F.col(unit_col) > 0)))
    units = known.select(F.countDistinct(unit_col)).first()[0]
    if units < 2:
        return [], {"status": "skipped", "reason": "fewer than two units"}
    bank, rows, found = codebank.fit(known, names, n_bins=n_bins), [], feats.families(names)
    encoded = known.select(id_col, unit_col, *names)
    for i, members in enumerate(found.values()):
        encoded = codebank.project(encoded, bank, members, out_col=f"activations_{i}")
    encoded = materialize(encoded.drop(*names))
    activations, clusters = ([f"{c}_{i}" for i in range(len(found))] for c in ("activations", "cluster"))
    everything, inertias = kmeans(encoded, units, id_col=id_col, vector_col=activations, out_col=clusters, n_init=n_init, max_iter=max_iter, seed=seed)
    everything = materialize(everything)
    for i, ((family, members), inertia) in enumerate(zip(found.items(), inertias)):
        clustered = everything.select(id_col, unit_col, F.col(activations[i]).alias("activations"), F.col(clusters[i]).alias("cluster_id"))
        table = materialize(metrics.contingency(clustered, truth=unit_col))
        accuracy, mapping = metrics.matched_accuracy(table)
        sweep = neighbors.knn_purity_sweep(clustered, list(ks), id_col=id_col, vector_col="activations", label_col=unit_col).first().asDict()
        rows.append({
            "family": family, "n_input_features": len(members), "n_bins": n_bins, "flat_dim": len(members) * n_bins, "n_events": clustered.count(), "n_units": units, "n_clusters": units,
            "ari": metrics.ari(table).first()["ari"], "nmi": metrics.nmi(table).first()["nmi"], "matched_accuracy": accuracy, "purity": metrics.purity(table).first()["purity"],
            "silhouette": neighbors.silhouette(clustered, id_col=id_col, vector_col="activations", label_col="cluster_id").first()["silhouette"], "inertia": inertia,
            "feature_names": ",".join(members), "cluster_to_unit_map": json.dumps(mapping), **sweep,
        })
        if output:
            clustered.select(F.lit(family).alias("family"), id_col, unit_col, "cluster_id").write.mode("append").partitionBy("family").parquet(output)
    rows.sort(key=lambda r: (-r["matched_accuracy"], -r["ari"], -r["nmi"], r["family"]))
    rows = [r | {"rank": i + 1} for i, r in enumerate(rows)]
    return rows, {"status": "ok", "best_family": rows[0]["family"] if rows else None, "n_units": units}
