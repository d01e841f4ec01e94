"""Registered queries: kernels, reducers, features, the population code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import blocks, kernels as k
from ..operators import codebank
from ..operators.features import FeatureConfig, TemporalConfig, build_features, feature_names, families, to_long
from ..sources.scratch import materialize
from ..sources.snippets import snippets
from . import sql
from .registry import register

DIGITS = 6
IDS = ["snippet_id", "unit_id", "class_label"]


def rounded(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(F.col(n), DIGITS).alias(n) for n in names])


def rounded_sql(names: list[str], keep: list[str], source: str) -> str:
    return f"SELECT {', '.join(keep)}, " + ", ".join(f"round({n}, {DIGITS}) AS {n}" for n in names) + f" FROM {source}"


_F = {"amplitude": "f01", "first_derivative": "f02", "second_derivative": "f03", "absolute_window_sum": "f04", "short_window_energy": "f05", "teager_energy": "f06"}
for _name, _id in _F.items():

    def _kernel(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        series = blocks.kernel(name, F.col("w"), 16)
        return snippets(spark, sf_dir).select("snippet_id", F.posexplode(series).alias("pos", "v")).select("snippet_id", "pos", F.round("v", DIGITS).alias("value"))

    register(f"{_id}_{_name}", f"WITH {sql.SNIPPETS}, x AS (SELECT snippet_id, {sql.KERNEL[_name]} AS v, unnest(range(1, len(w) + 1)) AS i FROM s) SELECT snippet_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i], {DIGITS}) AS value FROM x")(_kernel)


@register("r01_reducers", f"WITH {sql.SNIPPETS} SELECT snippet_id, round(list_max(w), 6) AS largest, round(list_min(w), 6) AS smallest, round(list_max(list_transform(w, lambda x: abs(x))), 6) AS abs_max FROM s")
def reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return snippets(spark, sf_dir).select("snippet_id", F.round(F.array_max(w), 6).alias("largest"), F.round(F.array_min(w), 6).alias("smallest"), F.round(k.abs_max(w), 6).alias("abs_max"))


@register("r02_r03_r05_median_mad_edge", f"WITH {sql.SNIPPETS} SELECT snippet_id, round({sql.median('w')}, 6) AS median, round({sql.mad('w')}, 6) AS mad, round({sql.mad('list_concat(w[1:8], w[len(w) - 7:len(w)])')}, 6) AS edge_mad FROM s")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return snippets(spark, sf_dir).select("snippet_id", F.round(k.median(w), 6).alias("median"), F.round(k.mad(w), 6).alias("mad"), F.round(k.edge_noise_mad(w, 8), 6).alias("edge_mad"))


@register("r04_window_wta", f"WITH {sql.SNIPPETS} SELECT snippet_id, round({sql.wta(10, 26)}, 6) AS wta FROM s")
def wta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).select("snippet_id", F.round(k.window_wta(F.col("w"), 10, 26), 6).alias("wta"))


_EDGE = f"({sql.mad('list_concat(w[1:8], w[len(w) - 7:len(w)])')}) * 1.4826"
_MODES = {"none": ("1.0", {}), "global": ("0.05 * 1.4826", {"global_noise_mad": 0.05}), "snippet_edges": (_EDGE, {})}
for _mode, (_scale, _options) in _MODES.items():

    def _temporal(spark: SparkSession, sf_dir: str, mode: str = _mode, options: dict = _options) -> DataFrame:
        from ..operators.features import temporal_features

        columns, _ = temporal_features(F.col("w"), 64, TemporalConfig(noise_mode=mode, **options))
        return snippets(spark, sf_dir).select("snippet_id", *[F.round(c, DIGITS).alias(n) for n, c in columns.items()])

    _columns = ", ".join(f"round({e}, {DIGITS}) AS {n}" for n, e in sql.temporal(8, 64, _scale).items())
    register(f"r09_temporal_{_mode}", f"WITH {sql.SNIPPETS} SELECT snippet_id, {_columns} FROM s")(_temporal)

for _bins in (3, 5, 12, 16):

    def _sweep(spark: SparkSession, sf_dir: str, bins: int = _bins) -> DataFrame:
        df = build_features(snippets(spark, sf_dir), FeatureConfig(temporal=TemporalConfig(n_bins=bins)), tier=1)
        return rounded(df, k.temporal_bin_names(bins), ["snippet_id"])

    register(f"m25_temporal_bins_{_bins:02d}", f"WITH {sql.SNIPPETS}, t AS (SELECT snippet_id, " + ", ".join(f"{e} AS {n}" for n, e in sql.temporal(_bins).items()) + " FROM s) " + rounded_sql(k.temporal_bin_names(_bins), ["snippet_id"], "t"))(_sweep)


@register("r10_scalar_features", f"WITH {sql.features(event=False, bins=None)} {rounded_sql(list(sql.SCALARS), IDS, 'f')}")
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = FeatureConfig(temporal=TemporalConfig(enabled=False))
    return rounded(build_features(snippets(spark, sf_dir), off, tier=1), list(k.SCALAR_FEATURES), IDS)


@register("r23_event_features", f"WITH {sql.features(bins=None)} {rounded_sql(list(sql.EVENTS), IDS, 'f')}")
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build_features(snippets(spark, sf_dir), tier=3), list(k.EVENT_FEATURES), IDS)


@register("r24_feature_matrix", f"WITH {sql.features()} {rounded_sql(feature_names(tier=3), IDS, 'f')}")
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build_features(snippets(spark, sf_dir), tier=3), feature_names(tier=3), IDS)


@register("r24_feature_matrix_long", f"WITH {sql.features()}, {sql.long_features(feature_names(tier=3))} SELECT snippet_id, feature, round(value, 6) AS value FROM l")
def matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = feature_names(tier=3)
    return to_long(build_features(snippets(spark, sf_dir), tier=3), names, id_cols=["snippet_id"]).select("snippet_id", "feature", F.round("value", 6).alias("value"))


@register("r25_extra_features", f"WITH {sql.SNIPPETS}, {sql.STAGED} SELECT snippet_id, round(d2[p], 6) AS curvature_at_trough, round(sqrt(list_sum(list_transform(w[1:p], lambda x: x * x)) / p), 6) AS pre_rms, round(sqrt(list_sum(list_transform(w[p:len(w)], lambda x: x * x)) / (len(w) - p + 1)), 6) AS post_rms FROM d")
def extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, p = F.col("w"), F.array_position("w", F.array_min("w")).cast("int")

    def rms(part):
        return F.sqrt(k.total(F.transform(part, lambda x: x * x)) / F.size(part))

    return snippets(spark, sf_dir).select(
        "snippet_id",
        F.round(F.get(k.second_derivative(w), p - 1), 6).alias("curvature_at_trough"),
        F.round(rms(F.slice(w, F.lit(1), p)), 6).alias("pre_rms"),
        F.round(rms(F.slice(w, p, F.size(w) - p + 1)), 6).alias("post_rms"),
    )


_LONGW = f"{sql.SNIPPETS}, x AS (SELECT snippet_id, i - 1 AS pos, w[i] AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s))"


@register(
    "w01_w04_window_form",
    f"""WITH {_LONGW} SELECT snippet_id, CAST(pos AS INTEGER) AS pos,
  round(coalesce(v - lag(v) OVER o, 0), 6) AS d1, round(coalesce(v * v - lag(v) OVER o * lead(v) OVER o, 0), 6) AS teager,
  round(sum(abs(v)) OVER t, 6) AS aws, round(sum(v * v) OVER t, 6) AS energy
FROM x WINDOW o AS (PARTITION BY snippet_id ORDER BY pos), t AS (PARTITION BY snippet_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""",
)
def window_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    x = snippets(spark, sf_dir).select("snippet_id", F.posexplode("w").alias("pos", "v"))
    o = W.partitionBy("snippet_id").orderBy("pos")
    t, v = o.rowsBetween(-15, 0), F.col("v")
    return x.select(
        "snippet_id",
        "pos",
        F.round(F.coalesce(v - F.lag("v").over(o), F.lit(0.0)), 6).alias("d1"),
        F.round(F.coalesce(v * v - F.lag("v").over(o) * F.lead("v").over(o), F.lit(0.0)), 6).alias("teager"),
        F.round(F.sum(F.abs(v)).over(t), 6).alias("aws"),
        F.round(F.sum(v * v).over(t), 6).alias("energy"),
    )


# --- population code --------------------------------------------------------------------------------

_NAMES = feature_names(tier=3)
_CODE = f"{sql.features()}, {sql.long_features(_NAMES)}, {sql.code_bank(_NAMES)}"
_SCALAR_CODE = f"{sql.features(event=False, bins=None)}, {sql.long_features(list(k.SCALAR_FEATURES))}, {sql.code_bank(list(k.SCALAR_FEATURES))}"


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(build_features(snippets(spark, sf_dir), tier=3))


def _bank(df: DataFrame, names: list[str] = _NAMES) -> codebank.CodeBank:
    return codebank.fit(df.where("class_label = 1"), names)


@register("a13_m01_code_bank_fit", f"WITH {_CODE} SELECT feature, CAST(i - 1 AS INTEGER) AS bin, round(c[i], 6) AS center, round(s[i], 6) AS width FROM (SELECT *, unnest(range(1, 11)) AS i FROM m)")
def bank_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _bank(_all(spark, sf_dir)).to_frame(spark)
    rows = model.select("feature", F.posexplode(F.arrays_zip("centers", "widths")).alias("bin", "x"))
    return rows.select("feature", "bin", F.round("x.centers", 6).alias("center"), F.round("x.widths", 6).alias("width"))


@register("m02_m03_score_and_gate", f"WITH {_CODE} SELECT snippet_id, round(score, 6) AS score, round(score, 9) >= 0.5 AS is_spike FROM sc")
def bank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _all(spark, sf_dir)
    return codebank.apply(df, _bank(df)).select("snippet_id", F.round("score", 6).alias("score"), (F.round("score", 9) >= 0.5).alias("is_spike"))


@register("m04_projection", f"WITH {_SCALAR_CODE} SELECT snippet_id, feature, CAST(i - 1 AS INTEGER) AS bin, round(act[i], 6) AS activation FROM (SELECT *, unnest(range(1, 11)) AS i FROM a)")
def bank_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(k.SCALAR_FEATURES)
    df = materialize(build_features(snippets(spark, sf_dir), FeatureConfig(temporal=TemporalConfig(enabled=False))))
    flat = codebank.project(df, _bank(df, names)).select("snippet_id", F.posexplode("activations").alias("at", "v"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(F.col("at") / 10) + 1).cast("int"))
    return flat.select("snippet_id", name.alias("feature"), (F.col("at") % 10).alias("bin"), F.round("v", 6).alias("activation"))


@register("m05_code_bank_describe", f"WITH {_CODE} SELECT feature, CAST(1.0 AS DOUBLE) AS weight, round(list_min(c), 6) AS low, round(list_max(c), 6) AS high, round(list_sum(s) / 10, 6) AS mean_width FROM m")
def bank_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = codebank.CodeBank.from_json(_bank(_all(spark, sf_dir)).to_json())
    d = bank.describe(spark)
    return d.select("feature", "weight", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean_width")])


@register("flagship_unit_scores", f"WITH {_SCALAR_CODE} SELECT unit_id, count(*) AS n, round(avg(CAST(round(score, 9) >= 0.5 AS DOUBLE)), 6) AS recall, round(avg(score), 6) AS mean_score FROM sc WHERE class_label = 1 GROUP BY unit_id ORDER BY mean_score DESC, unit_id")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets to features, code bank on the spikes, score and gate, recall per unit."""
    df = materialize(build_features(snippets(spark, sf_dir), FeatureConfig(temporal=TemporalConfig(enabled=False))))
    scored = codebank.apply(df, _bank(df, list(k.SCALAR_FEATURES)))
    per = scored.where("class_label = 1").groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.round("score", 9) >= 0.5).cast("double")), 6).alias("recall"), F.round(F.avg("score"), 6).alias("mean_score")
    )
    return per.orderBy(F.desc("mean_score"), "unit_id")


_BOUNDS = [(b, i, s, e) for b in (3, 5, 8, 12, 16) for i, (s, e) in enumerate(k.window_bounds(64, b))]


@register("r07_window_bounds", f"WITH {sql.SNIPPETS}, b AS (SELECT * FROM (VALUES {', '.join(map(str, _BOUNDS))}) t(n_bins, bin, start_at, end_at)) "
          "SELECT n_bins, bin, start_at, end_at, count(snippet_id) AS troughs FROM b LEFT JOIN s ON list_position(w, list_min(w)) - 1 >= start_at AND list_position(w, list_min(w)) - 1 < end_at GROUP BY ALL")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of every bin count, and how many snippets have their trough in each."""
    windows = spark.createDataFrame(_BOUNDS, "n_bins int, bin int, start_at int, end_at int")
    places = snippets(spark, sf_dir).groupBy((F.array_position("w", F.array_min("w")) - 1).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    inside = windows.withColumn("place", F.explode(F.sequence(F.col("start_at").cast("long"), F.col("end_at").cast("long") - 1)))  # a row per window and sample
    return inside.join(places, "place", "left").groupBy("n_bins", "bin", "start_at", "end_at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("troughs"))


@register("p08_families", f"WITH {sql.features()}, {sql.long_features(_NAMES)}, fam AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{n}')" for f, m in families(_NAMES).items() for n in m) + ") t(family, feature)) SELECT family, feature, round(avg(value), 6) AS mean_value FROM fam JOIN l USING (feature) GROUP BY ALL")
def family_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix's own columns by family, with their means."""
    df = build_features(snippets(spark, sf_dir), tier=3)
    own = [c for c in df.columns if c not in IDS]
    means = df.agg(*[F.avg(c).alias(c) for c in own]).unpivot([], own, "feature", "mean_value")
    table = spark.createDataFrame([(f, n) for f, m in families(own).items() for n in m], "family string, feature string")
    return table.join(means, "feature").select("family", "feature", F.round("mean_value", DIGITS).alias("mean_value"))
