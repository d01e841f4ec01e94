"""Jump consistent hashing of stable keys to shards, with DataFrame functions only.

The hash needs no ring table: shard numbers follow from the key and the shard
count, and appending a shard moves rows into the new shard only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import broadcast_if_small, materialize

_MASK32 = 0xFFFFFFFF
# The multiplier of the generator in the published jump hash, and its increment 1.
_MULTIPLIER = 2862933555777941757
_C_HIGH, _C_LOW = _MULTIPLIER >> 32, _MULTIPLIER & _MASK32
_C_LOW_LOW, _C_LOW_HIGH = _C_LOW & 0xFFFF, _C_LOW >> 16
#: More jumps than this have a chance below 1e-40 for any count up to 2**31.
_MAX_JUMPS = 128


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (int, from 0) of a 64-bit key; null keys count as key 0.

    The generator works modulo 2**64. Spark's ANSI arithmetic raises on
    overflow, so the state is held as two 32-bit halves in non-negative longs
    and the product is summed from 16-bit limbs, none of which can overflow.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    mask, half = F.lit(_MASK32).cast("long"), F.lit(0xFFFF).cast("long")
    start = F.struct(
        F.shiftrightunsigned(state, 32).alias("hi"),
        state.bitwiseAND(mask).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def times_low(x: Column) -> tuple[Column, Column]:
        """x * low half of the multiplier as (sum below 2**49, part to add at bit 32)."""
        high = x * F.lit(_C_LOW_HIGH).cast("long")
        return x * F.lit(_C_LOW_LOW).cast("long") + F.shiftleft(high.bitwiseAND(half), 16), F.shiftright(high, 16)

    def jump(s: Column, _: Column) -> Column:
        low, carry = times_low(s["lo"])
        low = low + 1
        high, _unused = times_low(s["hi"])
        cross = (s["lo"] * F.lit(_C_HIGH).cast("long")).bitwiseAND(mask)
        hi = (F.shiftright(low, 32) + carry + cross + high).bitwiseAND(mask)
        step = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")
        live = s["j"] < F.lit(shards)
        return F.when(
            live,
            F.struct(
                hi.alias("hi"),
                low.bitwiseAND(mask).alias("lo"),
                s["j"].alias("b"),
                F.floor((s["j"] + 1).cast("double") * step).cast("long").alias("j"),
            ),
        ).otherwise(s)

    rounds = F.sequence(F.lit(1), F.lit(min(shards, _MAX_JUMPS)))
    # a key that were not done after all jumps stops the job instead of losing its row
    unfinished = F.raise_error(F.lit(f"over {_MAX_JUMPS} jumps")).cast("int")
    return F.aggregate(rounds, start, jump, lambda s: F.when(s["j"] >= shards, s["b"].cast("int")).otherwise(unfinished))


def assign_shards(df: DataFrame, key: str, shards: int, *, shard_col: str = "shard", grown_col: str | None = None) -> DataFrame:
    """``df`` with its shard, and on request the shard after one more is appended. No shuffle.

    Integer keys are used as they are, others by their 64-bit hash. Null keys
    count as key 0. Repeated keys share a shard. Columns of ``df`` with the new
    names are replaced.
    """
    kind = dict(df.dtypes)[key]
    k = F.col(key) if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    new = {shard_col: jump_hash(k, shards)} | ({grown_col: jump_hash(k, shards + 1)} if grown_col else {})
    return df.withColumns(new)


#: Repeats of one row are numbered in stretches of this many, so that no task makes them all.
_STRETCH = 10_000


def shard_slots(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 1_000_000) -> DataFrame:
    """Every row with its shard and a gapless place in it, in the order of id, size and checksum (null ids first).

    Returns id, size, text_crc32, law, shard, slot, grown_shard. Null text has no
    bytes: size 1, checksum 0. Null ids count as key 0. Texts of any length are
    read whole; other columns are not read; an empty table gives an empty result.

    Equal rows are counted before the shuffle. The counted rows are
    range-partitioned by their order, about ``range_rows`` to a partition; a
    small table of rows per partition and shard gives the offsets. Repeats of a
    row are numbered in stretches that are dealt over all tasks, so that a
    repeated row makes no hot task.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    order = ["doc_id", "size", "text_crc32"]
    groups = materialize(rows.groupBy(*order).agg(F.count(F.lit(1)).alias("n")).transform(lambda d: assign_shards(d, "doc_id", shards, grown_col="grown_shard")))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // range_rows))
    # written, so that the ranges stay as they are when a task is repeated
    ranged = materialize(groups.repartitionByRange(ranges, "shard", *order).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sums.select("shard", "range", (F.sum("rows").over(before) - F.col("rows")).alias("offset"))
    within = W.partitionBy("shard", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranged.withColumn("first", F.sum("n").over(within) - F.col("n"))
    # at most a row per shard and range: the rows of the table over range_rows
    first = placed.join(broadcast_if_small(offsets, 1_000_000), ["shard", "range"]).withColumn("first", F.col("offset") + F.col("first"))
    columns = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard"]
    single = first.where("n = 1").select(*columns, F.col("first").alias("slot"), "grown_shard")
    several = materialize(first.where("n > 1"))
    if several.isEmpty():
        return single
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _STRETCH)))
    dealt = several.withColumn("stretch", stretch).repartition(*order, "stretch").withColumn("start", F.col("first") + F.col("stretch") * _STRETCH)
    end = F.least(F.col("start") + _STRETCH, F.col("first") + F.col("n")) - 1
    return single.unionByName(dealt.select(*columns, F.explode(F.sequence(F.col("start"), end)).alias("slot"), "grown_shard"))
