"""Registered queries: reports, joins, set operations, trains, alignment, validation, streams over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import catalog
from ..operators import align, candidates, models, profiling, spikes, synth, validate
from ..sources import sorted_units, storage
from ..sources.scratch import work_dir
from ..sources.snippets import snippets, table, trains
from ..streaming import streams
from . import sql
from .metric_queries import CLOSED_BOARD, NAMES, SCALARS, closed_form_board, long, scalar_matrix, scored
from .metric_queries import _LONG, _SCALAR, _SCORED
from .registry import register

_S, _E = sql.SNIPPETS, sql.TRAINS
_KEY = "md5(snippet_id || ':42'), snippet_id"
_SRC = "'src' || (snippet_id % 7)"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).withColumn("source", F.concat(F.lit("src"), (F.col("snippet_id") % 7).cast("string")))


# --- filters ------------------------------------------------------------------------------------------


@register("p01_p02_unit_mask", f"WITH {_S} SELECT snippet_id, unit_id FROM s WHERE class_label = 1 AND unit_id > 0 AND unit_id < 1000")
def unit_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).where("class_label = 1 and unit_id > 0 and unit_id < 1000").select("snippet_id", "unit_id")


@register("p03_p05_cluster_labels", f"WITH {_S} SELECT snippet_id, CASE WHEN unit_id IN (1, 2, 3) THEN 'SU' WHEN unit_id IN (4, 5) THEN 'EXCL' WHEN unit_id = 99999999 THEN 'NOISE' ELSE 'OTHER' END AS label FROM s")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).select("snippet_id", sorted_units.cluster_label(F.col("unit_id"), [1, 2, 3], [4, 5]).alias("label"))


@register("p04_v09_filtered_sample", f"WITH {_S} SELECT snippet_id, unit_id FROM (SELECT * FROM s WHERE unit_id = 3 AND class_label = 1 ORDER BY {_KEY} LIMIT 12)")
def filtered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.sample_rows(snippets(spark, sf_dir).where("unit_id = 3 and class_label = 1"), 12).select("snippet_id", "unit_id")


@register("p10_label_query", f"WITH {_E} SELECT event_id, unit_id FROM e WHERE event_type = 'click'")
def label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trains(spark, sf_dir).where("event_type = 'click'").select("event_id", "unit_id")


@register("p11_positive_onsets", f"WITH {_E} SELECT event_id, unit_id, round(value, 6) AS value FROM e WHERE value > 0")
def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_units.positive_onsets(trains(spark, sf_dir)).select("event_id", "unit_id", r6("value").alias("value"))


# --- joins --------------------------------------------------------------------------------------------


@register("j01_label_join", f"WITH {_S} SELECT s.snippet_id, s.unit_id, d.source FROM s JOIN documents d ON d.doc_id = s.snippet_id")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("snippet_id"), "source")
    return snippets(spark, sf_dir).join(d, "snippet_id").select("snippet_id", "unit_id", "source")


@register("j02_align_by_position", f"""WITH {_S}, a AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY snippet_id) AS n FROM s),
b AS (SELECT user_id % 10 AS u, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events)
SELECT a.snippet_id, a.unit_id, b.event_id FROM a JOIN b ON a.unit_id = b.u AND a.n = b.n""")
def by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("unit_id"), F.col("event_id").alias("snippet_id"), "event_id")
    out = sorted_units.align_by_position(snippets(spark, sf_dir).select("snippet_id", "unit_id"), e, by="unit_id", order="snippet_id")
    return out.select("snippet_id", "unit_id", "event_id")


@register("j06_recording_grid", f"""WITH {_S}, u AS (SELECT unit_id, avg(list_min(w)) AS trough FROM s WHERE class_label = 1 GROUP BY unit_id)
SELECT unit_id, d AS distance_um, a * 360.0 / 8 AS angle_deg, n AS noise_uv_rms, round(trough * 10.0 / d, 6) AS expected_trough FROM u, (SELECT unnest([10.0, 20.0, 50.0]::DOUBLE[]) AS d), (SELECT unnest(range(8)) AS a), (SELECT unnest([0.0, 5.0, 10.0]::DOUBLE[]) AS n)""")
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit of the table at every place of the recording grid, its mean trough falling with the distance."""
    units = snippets(spark, sf_dir).where("class_label = 1").groupBy("unit_id").agg(F.avg(F.array_min("w")).alias("trough"))
    places = synth.distance_grid(spark, [10.0, 20.0, 50.0], 8, [0.0, 5.0, 10.0])
    told = units.crossJoin(F.broadcast(places))  # the grid's size is fixed
    return told.select("unit_id", "distance_um", "angle_deg", "noise_uv_rms", r6(F.col("trough") * 10.0 / F.col("distance_um")).alias("expected_trough"))


@register("j07_set_model_grid", f"WITH {_S}, fo AS (SELECT *, (row_number() OVER (PARTITION BY class_label ORDER BY {_KEY}) - 1) % 5 AS fold FROM s), n AS (SELECT fold, count(*) AS n_test FROM fo GROUP BY fold) SELECT s AS set_name, m AS model, CAST(fold AS INTEGER) AS fold, n_test FROM (SELECT unnest(['A', 'B', 'C']) AS s), (SELECT unnest(['lda', 'qda']) AS m), n")
def set_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets x models x the table's folds, with the rows each fold holds out."""
    folds = models.stratified_folds(snippets(spark, sf_dir)).groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    s = spark.createDataFrame([(x, m) for x in "ABC" for m in ("lda", "qda")], "set_name string, model string")
    return folds.crossJoin(F.broadcast(s)).select("set_name", "model", "fold", "n_test")  # the list's size is fixed


_DEPTH = f"WITH {_S}, k AS (SELECT {_SRC} AS source, CASE WHEN unit_id IN (1, 2, 3) THEN 'SU' WHEN unit_id IN (4, 5) THEN 'EXCL' WHEN unit_id = 99999999 THEN 'NOISE' ELSE 'OTHER' END AS kind, list_min(w) AS depth FROM s)"


@register("j08_v06_hard_negatives", f"{_DEPTH} SELECT source, round(e / a, 6) AS depth_ratio FROM (SELECT source, avg(depth) FILTER (kind = 'EXCL') AS e, avg(depth) FILTER (kind = 'SU') AS a FROM k GROUP BY source) WHERE e IS NOT NULL AND a IS NOT NULL")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sourced(spark, sf_dir).select("source", sorted_units.cluster_label(F.col("unit_id"), [1, 2, 3], [4, 5]).alias("kind"), F.array_min("w").alias("depth"))
    return validate.hard_negatives(df).select("source", r6("depth_ratio").alias("depth_ratio"))


@register("j09_v11_metric_comparison", f"""WITH {_SCORED}, c AS (SELECT 'recall' AS metric, avg(CAST(predicted AS DOUBLE)) FILTER (class_label = 1) AS computed FROM z UNION ALL SELECT 'mean_score', avg(score) FROM z),
st AS (SELECT * FROM (VALUES ('recall', 0.5), ('mean_score', 0.9), ('lost', 1.0)) v(metric, stored))
SELECT coalesce(st.metric, c.metric) AS metric, CAST(stored AS DOUBLE) AS stored, round(computed, 6) AS computed, round(abs(stored - computed), 6) AS delta, coalesce(abs(stored - computed) < 1e-4, FALSE) AS matches FROM st FULL JOIN c ON st.metric = c.metric""")
def metric_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = scored(spark, sf_dir)
    computed = z.agg(F.avg(F.when(F.col("class_label") == 1, F.col("predicted").cast("double"))).alias("recall"), F.avg("score").alias("mean_score")).unpivot([], ["recall", "mean_score"], "metric", "value")
    stored = spark.createDataFrame([("recall", 0.5), ("mean_score", 0.9), ("lost", 1.0)], "metric string, value double")
    c = validate.compare_metrics(stored, computed)
    return c.select("metric", "stored", r6("computed").alias("computed"), r6("delta").alias("delta"), "matches")


@register("j10_default_labels", f"WITH {_S} SELECT s.snippet_id, coalesce(l.quality, 1) AS quality FROM s LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = s.snippet_id")
def default_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("snippet_id")).agg(F.min("quality").alias("quality"))
    return snippets(spark, sf_dir).join(labels, "snippet_id", "left").select("snippet_id", F.coalesce("quality", F.lit(1)).alias("quality"))


@register("j11_semi_and_anti", f"WITH {_S} SELECT snippet_id, snippet_id IN (SELECT doc_id FROM labels) AS accepted FROM s WHERE unit_id NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3)")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, known = snippets(spark, sf_dir).select("snippet_id", "unit_id"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("snippet_id"))
    dropped = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("unit_id"))
    rest = s.join(dropped, "unit_id", "left_anti")
    yes = rest.join(known, "snippet_id", "left_semi").select("snippet_id", F.lit(True).alias("accepted"))
    return yes.unionByName(rest.join(known, "snippet_id", "left_anti").select("snippet_id", F.lit(False).alias("accepted")))


# --- aggregates ---------------------------------------------------------------------------------------


@register("a01_v03_v04_dataset_summary", f"WITH {_S} SELECT count(*) AS n_snippets, count(*) FILTER (class_label = 1) AS n_spikes, count(*) FILTER (class_label = 0) AS n_noise, round(avg(class_label), 6) AS spike_share, count(DISTINCT unit_id) FILTER (unit_id > 0) AS n_units, CAST(max(len(w)) AS INTEGER) AS n_samples FROM s")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_snippets"), F.count_if(F.col("class_label") == 1).alias("n_spikes"), F.count_if(F.col("class_label") == 0).alias("n_noise"), r6(F.avg("class_label")).alias("spike_share"), F.countDistinct(F.when(F.col("unit_id") > 0, F.col("unit_id"))).alias("n_units"), F.max(F.size("w")).alias("n_samples"))


@register("a02_w11_unit_shares", f"WITH {_S} SELECT unit_id, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM s GROUP BY unit_id")
def unit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = snippets(spark, sf_dir).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("percent", r6(100.0 * F.col("n") / F.sum("n").over(W.partitionBy())))


@register("a03_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@register("a04_v01_source_summary", f"WITH {_S} SELECT {_SRC} AS source, count(*) AS n, count(*) FILTER (class_label = 1) AS n_spikes, string_agg(DISTINCT CAST(unit_id AS VARCHAR), ',' ORDER BY CAST(unit_id AS VARCHAR)) FILTER (unit_id > 0) AS units FROM s GROUP BY 1")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.array_join(F.array_sort(F.collect_set(F.when(F.col("unit_id") > 0, F.col("unit_id").cast("string")))), ",")
    return sourced(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class_label") == 1).alias("n_spikes"), units.alias("units"))


@register("a05_t03_multi_key_sizes", "SELECT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year, CAST(l_linenumber AS BIGINT) AS line, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ALL ORDER BY l_returnflag, n DESC")
def multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("ship_year"), F.col("l_linenumber").cast("long").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most")).orderBy("l_returnflag", F.desc("n"))


@register("a06_two_level_count", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY user_id, n DESC, event_type")
def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("user_id", F.desc("n"), "event_type")


@register("a07_area_summary", "SELECT event_type, user_id % 6 AS subject, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY ALL")
def area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 6).alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value")).alias("mean"), r6(F.median("value")).alias("median"))


@register("a08_crosstab_margins", f"WITH {_S} SELECT coalesce(CAST(c AS VARCHAR), 'Total') AS cluster, coalesce(CAST(unit_id AS VARCHAR), 'Total') AS unit, count(*) AS n FROM (SELECT unit_id, snippet_id * 7 % 10 AS c FROM s) GROUP BY CUBE (c, unit_id)")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snippets(spark, sf_dir).select("unit_id", (F.col("snippet_id") * 7 % 10).alias("c"))
    out = s.cube("c", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce(F.col("c").cast("string"), F.lit("Total")).alias("cluster"), F.coalesce(F.col("unit_id").cast("string"), F.lit("Total")).alias("unit"), "n")


_TYPES = ("click", "view", "purchase")


@register("a09_pivot_mean", "SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", list(_TYPES)).agg(F.avg("value"))
    return p.select("user_id", *[r6(t).alias(t) for t in _TYPES])


@register("a10_mean_waveforms", f"WITH {_S}, x AS (SELECT unit_id, i - 1 AS pos, w[i] AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s)) SELECT unit_id, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM x GROUP BY ALL")
def mean_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.mean_waveform(snippets(spark, sf_dir), ["unit_id"]).select("unit_id", "pos", (r6("mean") + 0.0).alias("mean"), r6("std").alias("std"), "n")


@register("a11_v05_trough_depths", f"WITH {_S} SELECT class_label, round(avg(list_min(w)), 6) AS mean_depth, round(stddev_pop(list_min(w)), 6) AS std_depth, count(*) AS n FROM s GROUP BY class_label")
def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.array_min("w")
    return snippets(spark, sf_dir).groupBy("class_label").agg(r6(F.avg(low)).alias("mean_depth"), r6(F.stddev_pop(low)).alias("std_depth"), F.count(F.lit(1)).alias("n"))


@register("a12_v12_feature_stats", f"WITH {_LONG} SELECT feature, class_label, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max FROM l GROUP BY ALL")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.feature_stats(long(spark, sf_dir))


_ISI = f"{_E}, i AS (SELECT *, t - lag(t) OVER (PARTITION BY unit_id ORDER BY t, event_id) AS isi FROM e)"


@register("w07_intervals", f"WITH {_ISI} SELECT event_id, unit_id, round(isi, 3) AS isi FROM i")
def isi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.intervals(trains(spark, sf_dir)).select("event_id", "unit_id", F.round("isi", 3).alias("isi"))


@register("a31_train_summary", f"""WITH {_ISI} SELECT unit_id, count(*) AS n_spikes, round(max(t) - min(t), 3) AS duration_s, round(CASE WHEN max(t) > min(t) THEN count(*) / (max(t) - min(t)) ELSE 0 END, 9) AS mean_fr_hz,
  round(coalesce(median(isi * 1000), 0), 2) AS median_isi_ms, round(CASE WHEN count(isi) > 1 AND avg(isi) > 0 THEN stddev_pop(isi) / avg(isi) ELSE 0 END, 6) AS cv_isi FROM i GROUP BY unit_id""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spikes.train_summary(trains(spark, sf_dir))
    return s.select("unit_id", "n_spikes", F.round("duration_s", 3).alias("duration_s"), F.round("mean_fr_hz", 9).alias("mean_fr_hz"), F.round("median_isi_ms", 2).alias("median_isi_ms"), r6("cv_isi").alias("cv_isi"))


@register("a32_session_totals", "SELECT count(DISTINCT user_id) AS n_units, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(DISTINCT (user_id, CAST(ts AS DATE))) AS n_unit_days, count(*) AS n_events FROM events")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("n_units"), F.countDistinct(day).alias("n_days"), F.countDistinct("user_id", day).alias("n_unit_days"), F.count(F.lit(1)).alias("n_events"))


@register("a33_operation_counts", "SELECT kernel, a AS arith_per_sample, m AS mem_per_sample, CAST(a * n AS BIGINT) AS arith_total, CAST(m * n AS BIGINT) AS mem_total FROM (VALUES " + ", ".join(f"('{n}', {a}, {m})" for n, (a, m) in profiling.OPERATIONS.items()) + ") v(kernel, a, m), (SELECT sum(len(embedding)) AS n FROM embeddings)")
def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.operation_counts(spark, snippets(spark, sf_dir))


@register("a36_array_summary", f"WITH {_S} SELECT count(*) AS n_rows, CAST(min(len(w)) AS INTEGER) AS shortest, CAST(max(len(w)) AS INTEGER) AS longest, round(min(list_min(w)), 6) AS least, round(max(list_max(w)), 6) AS most FROM s")
def array_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("w")
    return snippets(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.min(n).alias("shortest"), F.max(n).alias("longest"), r6(F.min(F.array_min("w"))).alias("least"), r6(F.max(F.array_max("w"))).alias("most"))


@register("a37_train_checks", f"WITH {_ISI} SELECT unit_id, round(coalesce(avg(CAST(isi < 60 AS DOUBLE)), 0), 6) AS refractory_share, count(*) FILTER (isi = 0) AS n_duplicates, count(*) FILTER (isi > 86400) AS n_gaps FROM i GROUP BY unit_id")
def train_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spikes.train_checks(trains(spark, sf_dir), refractory_s=60.0, gap_s=86400.0)
    return c.withColumn("refractory_share", r6("refractory_share"))


@register("a38_best_feature", f"WITH {_LONG} SELECT feature, round(max(value), 6) AS best FROM l GROUP BY feature ORDER BY round(max(value), 9) DESC, feature LIMIT 1")
def best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir).groupBy("feature").agg(F.max("value").alias("b")).orderBy(F.desc(F.round("b", 9)), "feature").limit(1).select("feature", r6("b").alias("best"))


# --- windows, order, sampling ---------------------------------------------------------------------------


@register("w05_t01_t02_ranking", "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS INTEGER) AS rank FROM customer")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), F.row_number().over(w).alias("rank"))


@register("t04_top_rows", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@register("w08_session_offset", f"WITH {_E} SELECT event_id, round(t - min(t) OVER (PARTITION BY unit_id), 3) AS t_rel FROM e")
def session_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trains(spark, sf_dir).select("event_id", F.round(F.col("t") - F.min("t").over(W.partitionBy("unit_id")), 3).alias("t_rel"))


@register("w12_rolling_threshold", f"WITH {_E}, x AS (SELECT event_id, value, sqrt(avg(value * value) OVER (PARTITION BY unit_id ORDER BY t, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)) AS rms FROM e) SELECT event_id, round(rms, 6) AS rms, value < -1.5 * rms AS crossing FROM x")
def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trains(spark, sf_dir).withColumn("o", F.struct("t", "event_id"))
    r = spikes.rolling_threshold(e, channel_col="unit_id", order_col="o", value_col="value", window=32, multiplier=1.5)
    return r.select("event_id", r6("rms").alias("rms"), "crossing")


@register("t05_shuffle", f"WITH {_S} SELECT snippet_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY {_KEY}) AS INTEGER) AS place FROM s")
def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("unit_id").orderBy(models.shuffle_key("snippet_id", 42), "snippet_id")
    return snippets(spark, sf_dir).select("snippet_id", F.row_number().over(w).alias("place"))


@register("t06_balanced_sample", f"WITH {_S} SELECT snippet_id, class_label FROM (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY {_KEY}) AS r FROM s) WHERE r <= 20")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.balanced_sample(snippets(spark, sf_dir), 20).select("snippet_id", "class_label")


@register("t07_t08_row_sample", f"WITH {_S} SELECT snippet_id FROM s ORDER BY {_KEY} LIMIT 25")
def row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.sample_rows(snippets(spark, sf_dir), 25).select("snippet_id")


_COMBOS = ", ".join(f"('{','.join(c)}', '{f}')" for c in models.feature_combinations(SCALARS, 2) for f in c)


@register("t11_feature_combinations", f"WITH {_SCALAR}, {sql.long_features(SCALARS)}, c AS (SELECT * FROM (VALUES {_COMBOS}) t(features, feature)) SELECT features, round(avg(value), 6) AS mean_value FROM c JOIN l USING (feature) GROUP BY features")
def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of the matrix's columns, with the mean over all their values."""
    df = scalar_matrix(spark, sf_dir)
    own = [c for c in df.columns if c not in ("snippet_id", "unit_id", "class_label")]
    combos = models.feature_combinations(own, 2)
    means = df.agg(*[F.avg(c).alias(c) for c in own]).unpivot([], own, "feature", "m")
    table = spark.createDataFrame([(",".join(c), f) for c in combos for f in c], "features string, feature string")
    return table.join(means, "feature").groupBy("features").agg(r6(F.avg("m")).alias("mean_value"))  # all columns have as many values


# --- set operations -------------------------------------------------------------------------------------


@register("u01_union_by_name", f"WITH {_S} SELECT snippet_id, unit_id, NULL AS kind FROM s WHERE class_label = 1 UNION ALL SELECT snippet_id, NULL, 'noise' FROM s WHERE class_label = 0")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snippets(spark, sf_dir)
    return s.where("class_label = 1").select("snippet_id", "unit_id").unionByName(s.where("class_label = 0").select("snippet_id", F.lit("noise").alias("kind")), allowMissingColumns=True)


@register("u02_column_stack", f"WITH {_SCALAR} SELECT snippet_id, round(peak_amplitude, 6) AS peak_amplitude, round(peak_amplitude - trough_amplitude, 6) AS span FROM f")
def column_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scalar_matrix(spark, sf_dir).withColumn("span", F.col("peak_amplitude") - F.col("trough_amplitude"))
    return f.select("snippet_id", r6("peak_amplitude").alias("peak_amplitude"), r6("span").alias("span"))


@register("u04_distinct_units", f"WITH {_S} SELECT DISTINCT unit_id FROM s")
def distinct_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).select("unit_id").distinct()


@register("u05_missing_features", f"WITH {_S} SELECT 'unknown_feature' AS missing, count(*) AS n_rows FROM s")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted features that the table's matrix does not have, with the rows they are missing for."""
    df = scalar_matrix(spark, sf_dir)
    wanted, have = F.array(*[F.lit(x) for x in [*SCALARS, "unknown_feature"]]), F.array(*[F.lit(x) for x in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array_except(wanted, have)).alias("missing"), "n_rows")


# --- sources --------------------------------------------------------------------------------------------


@register("s02_s04_snippet_scan", f"WITH {_S} SELECT snippet_id, unit_id, class_label, CAST(len(w) AS INTEGER) AS n FROM s")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).select("snippet_id", "unit_id", "class_label", F.size("w").alias("n"))


@register("s07_sorted_units", f"WITH {_S} SELECT 'f' || (snippet_id % 3) AS file, unit_id, count(*) AS n, round(avg(list_sum(w)), 6) + 0.0 AS mean_area FROM s WHERE snippet_id % 11 <> 0 AND unit_id <= 5 GROUP BY ALL")
def sorted_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = snippets(spark, sf_dir).select(
        F.concat(F.lit("f"), (F.col("snippet_id") % 3).cast("string")).alias("file"), F.col("snippet_id").alias("spike_index"),
        F.when(F.col("snippet_id") % 11 != 0, F.col("snippet_id") / 30000.0).alias("newspiketimes"), F.col("w").alias("snippets"), F.col("unit_id").cast("double").alias("unitIDs"),
    )
    u = sorted_units.load_units(raw, highest=5)
    area = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return u.groupBy("file", "unit_id").agg(F.count(F.lit(1)).alias("n"), (r6(F.avg(area)) + 0.0).alias("mean_area"))


@register("s09_curated_scaling", f"WITH {_S} SELECT snippet_id, round(list_max(list_transform(w, lambda x: x * 2.5e-6 * 1e6)), 6) AS peak_uv, round((snippet_id * 1000 - min(snippet_id * 1000) OVER (PARTITION BY snippet_id % 3)) / 1e6, 6) AS t_rel FROM s")
def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = snippets(spark, sf_dir).withColumns({"scale": F.lit(2.5e-6), "file": F.col("snippet_id") % 3, "ts_us": F.col("snippet_id") * 1000})
    return align.curated(raw).select("snippet_id", r6(F.array_max("uv")).alias("peak_uv"), r6("t_rel").alias("t_rel"))


_SHEET = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Ch' ELSE ' ' || (doc_id % 100) || ' ' END AS channel, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE CAST(doc_id % 9 AS VARCHAR) END AS quality_code, CAST(doc_id % 3 AS VARCHAR) AS n_sua, (doc_id % 50) || ', ' || (doc_id % 70) || '+' || (doc_id % 30) || ',' AS raw FROM documents"


@register("s10_curation_sheet", f"WITH r AS ({_SHEET}) SELECT CAST(trim(channel) AS INTEGER) AS channel, coalesce(TRY_CAST(quality_code AS INTEGER), 0) AS quality_code, coalesce(TRY_CAST(n_sua AS INTEGER), 0) AS n_sua, (doc_id % 50) || '|' || (doc_id % 70) AS ids FROM r WHERE doc_id % 5 <> 0")
def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        F.when(d % 5 == 0, "Ch").otherwise(F.concat(F.lit(" "), (d % 100).cast("string"), F.lit(" "))).alias("channel"),
        F.when(d % 4 == 0, "x").otherwise((d % 9).cast("string")).alias("quality_code"),
        (d % 3).cast("string").alias("n_sua"),
        F.concat((d % 50).cast("string"), F.lit(", "), (d % 70).cast("string"), F.lit("+"), (d % 30).cast("string"), F.lit(",")).alias("cluster_ids_raw"),
    )
    s = sorted_units.curation_sheet(raw)
    return s.select("channel", "quality_code", "n_sua", F.array_join(F.col("cluster_ids").cast("array<string>"), "|").alias("ids"))


@register("s12_procedural_counts", f"""WITH {_S}, c AS (SELECT count(DISTINCT unit_id) FILTER (class_label = 1) AS units, count(*) FILTER (class_label = 1) AS spikes, count(*) FILTER (class_label = 0) AS noise FROM s)
SELECT CAST(unit_id AS INTEGER) AS unit_id, 1 AS class_label, (['fast-spiking', 'regular-spiking', 'intermediate'])[(unit_id - 1) % 3 + 1] AS kind, CAST(spikes // units AS BIGINT) AS n, TRUE AS in_range FROM (SELECT *, unnest(range(1, units + 1)) AS unit_id FROM c)
UNION ALL SELECT 0, 0, kind, CAST(greatest(1, noise // 4) AS BIGINT), TRUE FROM c, (VALUES ('gaussian'), ('colored'), ('clipped'), ('irregular')) v(kind)""")
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set with as many units, spikes and noise rows as the table: rows per unit and noise type, and whether all drawn parameters lie in the ranges of their kind."""
    spikes = F.col("class_label") == 1
    c = snippets(spark, sf_dir).agg(F.count_distinct(F.when(spikes, F.col("unit_id"))).alias("units"), F.count_if(spikes).alias("spikes"), F.count_if(~spikes).alias("noise")).first()
    inside = F.lit(True)
    for name, ranges in synth.CELL_TYPES.items():
        for parameter, (low, high) in ranges.items():
            inside = inside & F.when(F.col("kind") == name, F.col(parameter).between(low, high)).otherwise(F.lit(True))
    inside = inside & F.coalesce(F.col("amplitude").between(*synth.NOISE_AMPLITUDE), F.lit(True)) & F.coalesce(F.col("noise_std").between(0, 10), F.lit(True)) & (F.size("w") == 64)
    made = synth.generate(spark, n_units=c["units"], per_unit=c["spikes"] // max(1, c["units"]), n_noise=c["noise"])
    return made.groupBy("unit_id", "class_label", "kind").agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside).alias("in_range"))


# --- alignment and generation -----------------------------------------------------------------------------


def _cut(center: str) -> str:
    return f"w[greatest(0, least(greatest({center} - 8, 0), len(w) - 32)) + 1 : greatest(0, least(greatest({center} - 8, 0), len(w) - 32)) + 32]"


@register("g01_align_to_mean", f"""WITH {_S}, c AS (SELECT arg_min(pos, (round(m, 12), pos)) AS c FROM (SELECT i - 1 AS pos, avg(w[i]) AS m FROM (SELECT w, unnest(range(1, 65)) AS i FROM s) GROUP BY 1)),
a AS (SELECT snippet_id, {_cut('c')} AS v FROM s, c) SELECT snippet_id, round(list_sum(v), 6) + 0.0 AS area, round(v[1], 6) AS first, round(v[32], 6) AS last FROM a""")
def align_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(align.align_to_mean(snippets(spark, sf_dir), 32))


def _aligned(a: DataFrame) -> DataFrame:
    v = F.col("aligned")
    return a.select("snippet_id", (r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)) + 0.0).alias("area"), r6(F.get(v, F.lit(0))).alias("first"), r6(F.get(v, F.lit(31))).alias("last"))


@register("g02_align_each", f"WITH {_S}, a AS (SELECT snippet_id, {_cut('(list_position(w, list_min(w)) - 1)')} AS v FROM s) SELECT snippet_id, round(list_sum(v), 6) + 0.0 AS area, round(v[1], 6) AS first, round(v[32], 6) AS last FROM a")
def align_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(align.align_each(snippets(spark, sf_dir), 32))


@register("g03_cut_around_trough", f"""WITH {_S}, p AS (SELECT *, 8 + list_position(w[9:64], list_min(w[9:64])) - 1 AS tp FROM s WHERE list_min(w[9:64]) <= -0.2),
a AS (SELECT snippet_id, w[greatest(0, tp - 20) + 1 : least(64, tp + 44)] AS v FROM p) SELECT snippet_id, CAST(64 AS INTEGER) AS n, round(list_sum(v), 6) + 0.0 AS area, round(coalesce(v[64], 0), 6) AS last FROM a""")
def cut_trough(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = align.cut_around_trough(snippets(spark, sf_dir), 20, 44, search_from=8, flat_above=-0.2)
    v = F.col("aligned")
    return a.select("snippet_id", F.size(v).alias("n"), (r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)) + 0.0).alias("area"), r6(F.get(v, F.lit(63))).alias("last"))


_KERNEL0 = "20 - 3.0 * fall / (fall - 3.0) * ln(fall / 3.0)"
_PULSE = "list_transform(range(64), lambda t: CASE WHEN t >= t0 THEN exp(-(t - t0) / fall) - exp(-(t - t0) / 3.0) ELSE 0.0 END)"


@register("g04_double_exponential", f"""WITH {_S}, p AS (SELECT *, CAST(6.0 + 1.5 * (unit_id % 9) AS DOUBLE) AS fall FROM s), k AS (SELECT *, {_PULSE} AS r FROM (SELECT *, {_KERNEL0} AS t0 FROM p))
SELECT snippet_id, fall, round(list_sum(list_transform(range(1, 65), lambda i: r[i] / list_max(r) * w[i])), 6) + 0.0 AS overlap FROM k""")
def kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snippet against the kernel of its unit's decay."""
    p = snippets(spark, sf_dir).withColumn("fall", 6.0 + 1.5 * (F.col("unit_id") % 9))
    fall, rise = F.col("fall"), F.lit(3.0)
    series = synth.double_exponential(synth.time_axis(64), F.lit(20.0) - synth.peak_offset(rise, fall), rise, fall)
    product = F.aggregate(F.zip_with(series, "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return p.select("snippet_id", "fall", (r6(product) + 0.0).alias("overlap"))


def _shape_sql(amp: str, delay_pos: int, width_pos: float, amp_pre: float, pre_offset: int, width_pre: float) -> str:
    def bell(a: str, mu: float, s: float) -> str:
        return f"{a} * exp(-0.5 * pow((i - 1 - {mu}) / {s}, 2))"

    sample = f"amp * r[i] / list_max(r) + {bell('40.0', 20 + delay_pos, width_pos)} + {bell('8.0', 48, 10.0)} + {bell(str(amp_pre), 20 + pre_offset, width_pre)}"
    return f"""WITH {_S}, k AS (SELECT *, {_PULSE} AS r FROM (SELECT *, {_KERNEL0} AS t0 FROM (SELECT snippet_id, w, 12.0 AS fall, 100 * list_min(w) AS amp FROM s)))
SELECT snippet_id, round(list_sum(list_transform(range(1, 65), lambda i: pow(100 * w[i] - ({sample}), 2))) / 64, 4) AS mean_square FROM k"""


def _misfit(spark: SparkSession, sf_dir: str, shape: Column) -> DataFrame:
    """Mean squared difference of every snippet (in hundredths) from the shape of its own trough."""
    s = snippets(spark, sf_dir).withColumn("w", F.transform("w", lambda x: 100 * x)).withColumn("amp", F.array_min("w"))
    squares = F.aggregate(F.zip_with("w", shape, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return s.select("snippet_id", F.round(squares / 64, 4).alias("mean_square"))


@register("g05_realistic_waveform", _shape_sql("amp", 14, 7.0, 5.0, -6, 3.0))
def realistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _misfit(spark, sf_dir, synth.waveform(amp_neg=F.col("amp")))


@register("g06_biphasic_waveform", _shape_sql("amp", 12, 8.0, 10.0, -8, 4.0))
def biphasic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _misfit(spark, sf_dir, synth.biphasic(amp_neg=F.col("amp")))


def _u(*keys: object) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', 42, {', '.join(map(str, keys))})), 1, 13) AS BIGINT) / 4503599627370496.0"


def _n(*keys: object) -> str:
    return f"sqrt(-2 * ln(1 - {_u(1, *keys)})) * cos(2 * pi() * {_u(2, *keys)})"


_NOISE_SQL = f"""WITH {_S}, i AS (SELECT snippet_id AS id FROM s WHERE class_label = 0), x AS (SELECT id, CAST(unnest(range(64)) AS DOUBLE) AS t FROM i),
ga AS (SELECT id, max(({_n('id', 't')}) * 50 / 3) AS peak FROM x GROUP BY id),
st AS (SELECT id, (({_n('id', 't + 1')}) - ({_n('id', 't')})) * 50 / 3 AS v FROM x),
co AS (SELECT id, max(v) * 50 / (stddev_pop(v) + 1e-12) AS peak FROM st GROUP BY id),
cl AS (SELECT id, max(sign(sin(2 * pi() * t / p)) * l) AS peak FROM (SELECT *, floor(8 + 12 * ({_u('id', 3)})) AS p, 50 * (0.3 + 0.7 * ({_u('id', 4)})) AS l FROM x) GROUP BY id),
bu AS (SELECT id, unnest(range(1, 4 + CAST(floor(4 * ({_u('id', 5)})) AS INTEGER))) AS b FROM i),
bp AS (SELECT id, 64 * ({_u('id', 'b', 6)}) AS mu, 2 + 8 * ({_u('id', 'b', 7)}) AS s, 50 * (2 * ({_u('id', 'b', 8)}) - 1) AS a FROM bu),
ir AS (SELECT id, max(v) AS peak FROM (SELECT x.id, t, sum(a * exp(-0.5 * pow((t - mu) / s, 2))) AS v FROM x JOIN bp USING (id) GROUP BY ALL) GROUP BY id)
SELECT kind, id, round(peak, 6) + 0.0 AS peak FROM (SELECT 'gaussian' AS kind, * FROM ga UNION ALL SELECT 'colored', * FROM co UNION ALL SELECT 'clipped', * FROM cl UNION ALL SELECT 'irregular', * FROM ir)"""


@register("g07_noise_types", _NOISE_SQL)
def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snippets(spark, sf_dir).where("class_label = 0").select(F.col("snippet_id").alias("id"))  # noise of every type for each noise row
    parts = [rows.select(F.lit(n).alias("kind"), "id", (r6(F.array_max(synth.noise(n, F.col("id")))) + 0.0).alias("peak")) for n in synth.NOISE_TYPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("g08_stress_levels", f"""WITH {_S}, lv AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS scale), nv AS (SELECT unnest([0.0, 0.05]::DOUBLE[]) AS noise),
x AS (SELECT snippet_id, w[i + 1] AS v, i FROM (SELECT *, unnest(range(len(w))) AS i FROM s))
SELECT scale, noise, count(*) AS n, round(avg(m), 6) AS mean_trough FROM (SELECT snippet_id, scale, noise, min(v * scale + noise * ({_n('snippet_id', 'scale', 'noise', 'i')})) AS m FROM x, lv, nv GROUP BY ALL) GROUP BY scale, noise""")
def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = synth.stressed(snippets(spark, sf_dir), [0.5, 1.0, 2.0], [0.0, 0.05])
    return s.groupBy("scale", "noise").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.array_min("w"))).alias("mean_trough"))


# --- validation and report surface ------------------------------------------------------------------------


@register("v02_v07_plausibility", f"""WITH {_S}, mw AS (SELECT unit_id, min(m) AS trough FROM (SELECT unit_id, i, avg(w[i]) AS m FROM (SELECT unit_id, w, unnest(range(1, 65)) AS i FROM s WHERE class_label = 1) GROUP BY ALL) GROUP BY unit_id),
c AS (SELECT 'morphology' AS check_, max(trough) AS value, max(trough) < -5 AS passed FROM mw UNION ALL SELECT 'class_balance', avg(class_label), avg(class_label) BETWEEN 0.25 AND 0.75 FROM s
UNION ALL SELECT 'unit_count', count(DISTINCT unit_id) FILTER (class_label = 1), count(DISTINCT unit_id) FILTER (class_label = 1) = 10 FROM s
UNION ALL SELECT 'amplitude_range', stddev_pop(list_min(w)) FILTER (class_label = 0) - stddev_pop(list_min(w)) FILTER (class_label = 1), stddev_pop(list_min(w)) FILTER (class_label = 0) >= stddev_pop(list_min(w)) FILTER (class_label = 1) FROM s)
SELECT check_ AS "check", round(value, 6) AS value, passed FROM c""")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.plausibility(snippets(spark, sf_dir)).select("check", r6("value").alias("value"), "passed")


@register("v08_evaluate_model", f"WITH {_SCORED} SELECT unit_id, round(avg(CAST(predicted AS DOUBLE)), 6) AS recall, round(avg(score), 6) AS mean_score, count(*) AS n FROM z WHERE class_label = 1 GROUP BY unit_id")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import codebank

    df = scalar_matrix(spark, sf_dir)
    bank = codebank.CodeBank.from_json(codebank.fit(df.where("class_label = 1"), SCALARS).to_json())
    return validate.evaluate(df, bank)["per_unit"].select("unit_id", r6("recall").alias("recall"), r6("mean_score").alias("mean_score"), "n")


_MEANINGS = ", ".join("('{}', '{}', '{}')".format(*r) for r in [("feature", n, t) for n, t in catalog.FEATURES.items()] + [("feature", f"mad_wta_bin_{i:02d}", "largest distance from the window''s median") for i in range(8)] + [("metric", n, t) for n, t in catalog.METRICS.items()])


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n, low, high) of every column of the table's feature matrix."""
    stats = long(spark, sf_dir).groupBy(F.col("feature").alias("name"))
    return stats.agg(F.count("value").alias("n"), r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"))


_RANGES = f"{_LONG}, rg AS (SELECT feature AS name, count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM l GROUP BY feature)"


@register("v16_catalog", f"WITH {_RANGES} SELECT kind, name, meaning, n, low, high FROM (VALUES {_MEANINGS}) v(kind, name, meaning) LEFT JOIN rg USING (name)")
def meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meanings of features and metrics, with the range that each feature has in the table."""
    return catalog.catalog(spark).join(_ranges(spark, sf_dir), "name", "left").select("kind", "name", "meaning", "n", "low", "high")


_GUIDE = ", ".join("('{}', {}, '{}', '{}', '{}', '{}')".format(*[str(x).replace("'", "''") for x in (n, *g)]) for n, g in catalog.GUIDE.items()) + ", " + ", ".join(
    f"('mad_wta_bin_{i:02d}', 2, 'max |x - median| in the window', 'uV', 'largest distance from the window''s median', 'where in time an event stands out from its surroundings')" for i in range(8)
)


@register("v16_feature_guide", f"WITH {_RANGES} SELECT name, tier, formula, unit, meaning, reason, n, low, high FROM (VALUES {_GUIDE}) v(name, tier, formula, unit, meaning, reason) JOIN rg USING (name)")
def feature_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per feature of the table's matrix, with its range there."""
    return catalog.guide(spark).join(_ranges(spark, sf_dir), "name").select("name", "tier", "formula", "unit", "meaning", "reason", "n", "low", "high")


@register("v18_top_features", f"""WITH {_LONG}, fi AS (SELECT feature, pow(avg(value) FILTER (class_label = 1) - avg(value) FILTER (class_label = 0), 2) / (var_pop(value) FILTER (class_label = 1) + var_pop(value) FILTER (class_label = 0) + 1e-12) AS fs FROM l GROUP BY feature)
SELECT feature, round(fs, 6) AS fisher_score FROM fi ORDER BY round(fs, 12) DESC, feature LIMIT 14""")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import metrics

    f = metrics.fisher_scores(long(spark, sf_dir))
    return f.orderBy(F.desc(F.round("fisher_score", 12)), "feature").limit(14).select("feature", r6("fisher_score").alias("fisher_score"))


# --- streams, batch form (a stream gives the same rows; see the tests) --------------------------------------


@register("x02_hourly_rates", "SELECT user_id AS unit_id, time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) + INTERVAL 1 HOUR AS \"end\", count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.rates(trains(spark, sf_dir)).withColumn("total", r6("total"))


@register("x03_sessions", f"""WITH {_E}, m AS (SELECT *, CASE WHEN t - lag(t) OVER o < 3600 THEN 0 ELSE 1 END AS n0 FROM e WINDOW o AS (PARTITION BY unit_id ORDER BY t, event_id)), g AS (SELECT *, sum(n0) OVER (PARTITION BY unit_id ORDER BY t, event_id) AS b FROM m)
SELECT unit_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) AS TIMESTAMP) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM g GROUP BY unit_id, b""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(trains(spark, sf_dir), gap="1 hour")


@register("x03_bursts", f"""WITH {_E}, m AS (SELECT *, CASE WHEN t - lag(t) OVER o < 3600 THEN 0 ELSE 1 END AS n0 FROM e WINDOW o AS (PARTITION BY unit_id ORDER BY t, event_id)), g AS (SELECT *, sum(n0) OVER (PARTITION BY unit_id ORDER BY t, event_id) AS b FROM m)
SELECT unit_id, CAST(b AS BIGINT) AS burst, count(*) AS n, round(min(t), 3) AS start_t, round(max(t), 3) AS end_t FROM g GROUP BY unit_id, b""")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spikes.bursts(trains(spark, sf_dir), 3600.0)
    return b.select("unit_id", "burst", "n", F.round("start_t", 3).alias("start_t"), F.round("end_t", 3).alias("end_t"))


@register("x04_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.deduplicated(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@register("ext_peri_event", f"WITH {_E} SELECT a.event_id, o.event_id AS onset_id, round(a.t - o.t, 3) AS lag_s FROM e a JOIN e o ON a.unit_id = o.unit_id AND o.event_type = 'purchase' AND a.t - o.t BETWEEN -600 AND 1800")
def peri(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trains(spark, sf_dir)
    on = e.where("event_type = 'purchase'").select("unit_id", F.col("event_id").alias("onset_id"), F.col("t").alias("onset_t"))
    return spikes.peri_event(e.select("unit_id", "event_id", "t"), on, 600, 1800).select("event_id", "onset_id", F.round("lag_s", 3).alias("lag_s"))


@register("s11_array_trains", f"WITH {_E}, u AS (SELECT unit_id, list(t) AS times FROM e GROUP BY unit_id) SELECT unit_id, round(unnest(times), 3) AS t FROM u")
def array_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an array per unit and hour: no unit is gathered into one row
    units = trains(spark, sf_dir).groupBy("unit_id", F.floor(F.col("t") / 3600)).agg(F.collect_list("t").alias("spike_times"))
    return sorted_units.explode_trains(units).select("unit_id", F.round("t", 3).alias("t"))


@register("p09_column_exclusion", "SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def column_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kept = sorted_units.without_columns(c, [x for x in c.columns if x not in ("c_custkey", "c_nationkey", "c_acctbal")] + ["absent"])
    return kept.withColumn("c_acctbal", F.round("c_acctbal", 2))


@register("v18_set_model_pivot", f"SELECT candidate, " + ", ".join(f"max(balanced_acc_mean) FILTER (model = '{m}') AS {m}" for m in candidates.CLOSED) + f" FROM ({CLOSED_BOARD}) GROUP BY candidate")
def set_model_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board as the dashboard groups it: a row per set, a column per model."""
    rows = closed_form_board(spark, sf_dir)
    return rows.groupBy("candidate").agg(*[F.max(F.when(F.col("model") == m, F.col("balanced_acc_mean"))).alias(m) for m in candidates.CLOSED])


@register("v18_gallery", f"WITH {_S}, g AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY {_KEY}) AS place FROM s) SELECT class_label, CAST(place AS INTEGER) AS place, snippet_id, unit_id, round(list_min(w), 6) AS trough, round(list_max(w), 6) AS peak FROM g WHERE place <= 12")
def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve snippets of each class in shuffled order, with their extremes."""
    place = F.row_number().over(W.partitionBy("class_label").orderBy(models.shuffle_key("snippet_id", 42), "snippet_id"))
    told = models.balanced_sample(snippets(spark, sf_dir), 12).withColumn("place", place)
    return told.select("class_label", "place", "snippet_id", "unit_id", r6(F.array_min("w")).alias("trough"), r6(F.array_max("w")).alias("peak"))


@register("s17_run_listing", "SELECT strftime(min(ts), '%Y%m%d_%H%M%S') || '_' || event_type AS run, CAST(row_number() OVER (ORDER BY strftime(min(ts), '%Y%m%d_%H%M%S') || '_' || event_type DESC) AS INTEGER) AS place, event_type, count(*) AS n_events, round(sum(value), 2) AS total, CAST(2 AS BIGINT) AS n_files FROM events GROUP BY event_type")
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per event type: folders and results are written, then listed newest first and read back."""
    base = work_dir(spark)
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.date_format(F.min("ts"), "yyyyMMdd_HHmmss").alias("at"), F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("total"))
    for r in per.collect():  # a row per type
        run = f"{base}/{r['at']}_{r['event_type']}"
        storage.write_json(spark, f"{run}/run_summary.json", {"event_type": r["event_type"], "n_events": r["n_events"], "total": r["total"]})
        storage.save_config(spark, run, {"source": "events", "event_type": r["event_type"]})
    told = storage.runs(spark, base, "event_type string, n_events long, total double")
    return told.select("run", "place", "event_type", "n_events", F.round("total", 2).alias("total"), "n_files")
