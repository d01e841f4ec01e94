"""Intermediate tables in the shared checkpoint folder, and exact positions in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructField, StructType


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a single-process session without the setting (tests) gets a folder of its own machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/wavemill-checkpoints"
    return f"{base.rstrip('/')}/wavemill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: read often, computed once, and safe when an executor is lost."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if a count shows at most ``max_rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= max_rows else df


def few_rows(df: DataFrame, max_rows: int) -> list | None:
    """The rows of a small table in one run of its plan, None if there are more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def fresh(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` is called so (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_sums(df: DataFrame, sums: dict[str, Column], *, by: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` with running sums of whole numbers in a global order, the row itself included, per group ``by``.

    Rows are range-partitioned by group and order and written; each range is
    summed by a window of its own and starts from the totals of the ranges
    before it, a table of ranges x groups. No group is sorted in one task. Rows
    that are equal in ``order`` have any order among themselves.
    """
    spark, place = df.sparkSession, fresh("range", df)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {fresh(f"add_{n}", df): c for n, c in sums.items()}
    ranged = materialize(df.withColumns(values).repartitionByRange(parts, *by, *order).withColumn(place, F.spark_partition_id()))
    totals = ranged.groupBy(*by, place).agg(*[F.sum(v).alias(v) for v in values])
    starts = {v: f"{v}_start" for v in values}
    rows = few_rows(totals, 100_000)
    if rows is not None:  # a row per range and group, few enough to send
        at, out = {}, []
        for r in sorted(rows, key=lambda r: r[place]):
            own = at.setdefault(tuple(r[k] for k in by), dict.fromkeys(values, 0))
            out.append((*[r[k] for k in by], r[place], *[own[v] for v in values]))
            for v in values:
                own[v] += r[v] or 0
        fields = [*[totals.schema[k] for k in (*by, place)], *[StructField(x, totals.schema[v].dataType) for v, x in starts.items()]]
        offsets = F.broadcast(spark.createDataFrame(out, StructType(fields)))
    else:
        before = W.partitionBy(*by).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
        offsets = totals.select(*by, place, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(s) for v, s in starts.items()])
    inside = W.partitionBy(*by, place).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = ranged.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in zip(sums, values)})
    keys = [place, *by]
    right = offsets.withColumnsRenamed({k: f"{k}__k" for k in keys})
    meet = [F.col(k).eqNullSafe(F.col(f"{k}__k")) for k in keys]
    joined = summed.join(right, meet)
    return joined.withColumns({n: F.col(n) + F.col(starts[v]) for n, v in zip(sums, values)}).select(*df.columns, *sums)


def numbered(df: DataFrame, name: str, *, by: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` with the position of every row in its group, from 1. ``order`` should tell all rows apart."""
    return running_sums(df, {name: F.lit(1).cast("long")}, by=by, order=order)


def exact_quantiles(df: DataFrame, levels: list[float], *, by: list[str], value: str) -> DataFrame:
    """(by, quantiles): interpolated quantiles of every group, exact for any number of rows. Nulls are ignored.

    Distinct values are counted, running counts give their ranks, and only the
    values at the ranks on both sides of a quantile are kept.
    """
    steps = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = materialize(running_sums(steps, {"upto": F.col("c")}, by=by, order=["v"]))
    sizes = ranked.groupBy(*by).agg(F.max("upto").alias("total"))
    rows = few_rows(sizes, 50_000)  # a row per group
    if rows is not None:
        sizes = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in rows], sizes.schema))
    wanted = sizes.select(*by, F.posexplode(F.array(*[F.lit(float(q)) for q in levels])).alias("level", "q"), "total")
    at = (F.col("total") - 1) * F.col("q")
    side = F.explode(F.array(F.struct(F.floor(at).alias("rank"), F.lit(0).alias("side")), F.struct(F.ceil(at).alias("rank"), F.lit(1).alias("side"))))
    wanted = wanted.select(*by, "level", (at - F.floor(at)).alias("share"), side.alias("x"))
    right = wanted.withColumnsRenamed({k: f"{k}__k" for k in by})
    meet = [F.col(k).eqNullSafe(F.col(f"{k}__k")) for k in by]
    hits = ranked.join(F.broadcast(right) if rows is not None and len(rows) * len(levels) <= 500_000 else right, meet).where((F.col("x.rank") < F.col("upto")) & (F.col("x.rank") >= F.col("upto") - F.col("c")))
    each = hits.groupBy(*by, "level", "share").agg(F.max(F.when(F.col("x.side") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("x.side") == 1, F.col("v"))).alias("high"))
    told = each.select(*by, "level", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("value"))
    rows = told.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("level", "value"))).alias("x"))  # one entry per level
    return rows.select(*by, F.transform("x", lambda s: s["value"]).alias("quantiles"))
