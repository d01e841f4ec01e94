"""Links between texts by the exact Jaccard similarity of their word shingles.

MinHash bands of distinct shingle sets find the candidates, and every candidate
is checked exactly on the sets by joins. The sets of a band are compared with
one of them first, a pivot, and in further rounds with other pivots; only sets
that are then still in different groups meet each other, and of those only the
pairs that their known distances from the pivot leave open: the Jaccard distance
is a metric. Where a band still holds many groups, its sets meet by their rarest
shingles instead. So a tight group of near copies makes some 30 pairs a set, and
a loose one, whose sets were each changed in places of their own, not many more.

The pipeline and ``simhash.keep_first`` do not go this way but by SimHash tiles
(``near_copies``); a test compares the two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, materialize, utf8
from .simhash import connected, shingle_hashes

_SEED = 42
_ROWS = 5  # minima per band
_MISS = 1e-6  # chance that a pair at the similarity shares no band
_ROUNDS = 3  # of pivots, before the rest meets
_CROWD = 16  # groups in a band beyond which shingles find the pairs; only speed depends on it
_MAP_WORDS = 16  # 64-bit words of a set's bit map; only speed depends on it


def band_count(similarity: float) -> int:
    """Bands such that a pair at ``similarity`` shares none with a chance of at most one in a million."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    hit = similarity**_ROWS
    return 1 if hit == 1 else math.ceil(math.log(_MISS) / math.log1p(-hit))


def band_hashes(hashes: list[list[int]], bands: int) -> list[np.ndarray]:
    """One array of ``bands`` hashes (int64) per list of shingle hashes; an empty list gives an empty array."""
    rng = np.random.default_rng(_SEED)
    flip, odd, mix = rng.integers(0, 2**64, (3, bands * _ROWS), np.uint64)
    odd, mix = odd | np.uint64(1), mix | np.uint64(1)
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = [np.zeros(0, np.int64)] * len(hashes)
    if not sizes.sum():
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
    some = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[some]
    keys = np.empty((len(some), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(some), flip[b] ^ mix[b])
        for k in range(b * _ROWS, (b + 1) * _ROWS):
            key = (key ^ np.minimum.reduceat((flat ^ flip[k]) * odd[k], first)) * mix[k]
            key ^= key >> np.uint64(29)
        keys[:, b] = key
    for i, row in zip(some.tolist(), keys.view(np.int64)):
        out[i] = row
    return out


def _set_of(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64)).view(np.int64)


def _sketch_udf(width: int, bands: int):
    @F.pandas_udf("fingerprint long, size int, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest as digest

        for texts in batches:
            keys, sizes, rows, held, n = [], [], [], [], 0
            for text in texts:
                held.append(shingle_hashes(text, width))
                own = _set_of(held[-1])
                keys.append(digest(own.tobytes(), _SEED))
                sizes.append(len(own))
                n += len(held[-1])
                if n >= 1 << 15:
                    rows += band_hashes(held, bands)
                    held, n = [], 0
            rows += band_hashes(held, bands)
            yield pd.DataFrame({"fingerprint": np.array(keys, np.uint64).view(np.int64), "size": sizes, "bands": rows})

    return sketch.asNondeterministic()


def _set_udf(width: int):
    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([_set_of(shingle_hashes(t, width)) for t in texts], dtype=object)

    return sets.asNondeterministic()


def sketches(rows: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """Written table (doc_id, text_hash, fingerprint, size, bands) of rows (doc_id, text, text_hash).

    Equal shingle sets have equal fingerprints; null and wordless texts have the
    empty set and no bands.
    """
    made = rows.select("doc_id", "text_hash", _sketch_udf(width, band_count(similarity))(utf8("text")).alias("s"))
    return materialize(made.select("doc_id", "text_hash", "s.fingerprint", "s.size", "s.bands"))


def _sets_of(rows: DataFrame, prints: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Written sets (fingerprint, shingles) of the fingerprints ``wanted``, each from the text of one row."""
    least = prints.join(wanted, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"))
    chosen = materialize(least.select("fingerprint", F.col("m.doc_id").alias("i"), F.col("m.text_hash").alias("h")))
    texts = rows.join(broadcast_if_small(chosen, 500_000), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    made = materialize(texts.select("fingerprint", _set_udf(width)(utf8("text")).alias("shingles")))
    repeated = materialize(made.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"))
    if repeated.isEmpty():
        return made
    # rows with one id and one text: only their sets are moved
    told = broadcast_if_small(repeated, 500_000)
    return materialize(made.join(told, "fingerprint", "left_anti").unionByName(made.join(told, "fingerprint", "left_semi").dropDuplicates(["fingerprint"])))


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the Jaccard similarity j of their sets, written."""
    one = pairs.join(sets.select(F.col("fingerprint").alias("b"), F.col("shingles").alias("sb")), "b")
    both = one.join(sets.select(F.col("fingerprint").alias("a"), F.col("shingles").alias("sa")), "a")
    told = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return materialize(told.select("a", "b", (F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))).alias("j")))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _fits(x: str, y: str, similarity: float) -> Column:
    return F.least(x, y) >= F.greatest(x, y) * similarity


def _crowd_pairs(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``crowd`` (fingerprint, size, root) in different groups, all that are similar among them.

    Similar sets differ in at most (1 - s) / (1 + s) of the sum of their sizes. So
    with the shingles of all sets in one order, the rarest first, they share one of
    the first few; those of a shingle's largest group meet only sets outside it.
    Each set also has a bit map that every shingle flips a bit of: maps differ in no
    more bits than the sets in shingles, which excludes most of what meets.
    """
    bit = F.col("shingle").bitwiseAND(_MAP_WORDS * 64 - 1)
    flips = [F.coalesce(F.bit_xor(F.when(F.shiftright(bit, 6) == w, F.expr("shiftleft(1L, cast(shingle & 63 as int))"))), F.lit(0)).alias(f"w{w}") for w in range(_MAP_WORDS)]
    each = materialize(sets.join(crowd.select("fingerprint"), "fingerprint").select("fingerprint", F.explode("shingles").alias("shingle")))
    # a set's own shingles come first in the order and lead to none: their number is enough
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = each.join(often, "shingle").groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("shingles"))
    known = each.groupBy("fingerprint").agg(*flips).join(crowd, "fingerprint")
    maps = [f"w{w}" for w in range(_MAP_WORDS)]
    probe = (F.col("size") - F.ceil(F.col("size") * similarity - 1e-6) + 1).cast("int")
    own = F.col("size") - F.size("shingles")
    early = F.slice("shingles", F.lit(1), F.greatest(probe - own, F.lit(0)))
    first = order.join(known, "fingerprint").select("fingerprint", "size", "root", *maps, own.alias("own"), F.posexplode(early).alias("pos", "s"))
    first = materialize(first.withColumn("pos", F.col("pos") + F.col("own")).withColumn("shingle", F.col("s.shingle")).drop("s", "own"))
    roots = first.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "root")).alias("m"))
    held = materialize(first.join(roots.where("groups > 1").select("shingle", F.col("m.root").alias("main")), "shingle"))
    x, y = (held.withColumnsRenamed({k: f"{c}_{k}" for k in held.columns if k != "shingle"}) for c in "xy")
    common = (F.col("x_size") + F.col("y_size")) * (similarity / (1 + similarity)) - 1e-6  # at least, of similar sets
    reach = (F.col("x_size") - F.col("x_pos") >= common) & (F.col("y_size") - F.col("y_pos") >= common)
    apart = sum((F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in maps), F.lit(0))
    near = reach & _fits("x_size", "y_size", similarity) & (apart <= F.col("x_size") + F.col("y_size") - 2 * common)
    met = x.where("x_root <> x_main").join(y, (x["shingle"] == y["shingle"]) & (F.col("x_root") != F.col("y_root")) & near)
    return met.select(*_pair("x_fingerprint", "y_fingerprint")).distinct()


def similar_links(rows: DataFrame, prints: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) between fingerprints that span every group of pairs with at least ``similarity``.

    ``rows`` has (doc_id, text, text_hash), ``prints`` their written sketches.
    Repeated rows have one fingerprint and are compared once; of equal choices
    for a pivot the smallest fingerprint or hash is taken.
    """
    distinct = prints.groupBy("fingerprint").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    buckets = distinct.select("fingerprint", "size", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min(F.struct("fingerprint", "size")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(buckets.join(shared.select("band", F.col("p.fingerprint").alias("pivot"), F.col("p.size").alias("pivot_size")), "band"))
    sets = _sets_of(rows, prints, members.select("fingerprint").distinct(), width)

    def fits(x: str, y: str) -> Column:
        return _fits(x, y, similarity)

    tried = _similarities(members.where((F.col("fingerprint") != F.col("pivot")) & fits("size", "pivot_size")).select(*_pair("pivot", "fingerprint")).distinct(), sets)
    close = F.col("j") >= similarity
    labels = connected(tried.where(close).select("a", "b"))
    for turn in range(1, _ROUNDS + 1):
        roots = labels.select(F.col("node").alias("fingerprint"), "root")
        rooted = members.select("band", "fingerprint", "size").join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
        # bands whose sets are still in several groups
        groups = F.approx_count_distinct("root").alias("groups")  # tells crowded bands only
        mixed = rooted.groupBy("band").agg(groups, F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.struct(F.xxhash64("fingerprint", F.lit(turn)).alias("h"), "fingerprint", "size", "root")).alias("p")).where("r0 <> r1")
        left = materialize(rooted.join(mixed.select("band", "groups", F.col("p.fingerprint").alias("pivot"), F.col("p.size").alias("pivot_size"), F.col("p.root").alias("pivot_root")), "band"))
        if left.isEmpty():
            return tried.where(close).select("a", "b")
        if turn == _ROUNDS:
            break
        open_pairs = left.where((F.col("root") != F.col("pivot_root")) & fits("size", "pivot_size")).select(*_pair("pivot", "fingerprint")).distinct()
        more = _similarities(open_pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), sets)
        tried = materialize(tried.unionByName(more))
        labels = connected(tried.where(close).select("a", "b"))
    # bands of many groups go by their shingles, the others by their distances
    crowded = F.col("groups") > _CROWD
    crowd = materialize(left.where(crowded).select("fingerprint", "size", "root").distinct())
    left = left.where(~crowded)
    # distances from a band's first pivot, where known; the pivot itself is at 0
    known = tried.select(F.col("a").alias("x"), F.col("b").alias("y"), (1 - F.col("j")).alias("d"))
    known = known.unionByName(known.select(F.col("y").alias("x"), F.col("x").alias("y"), "d"))
    pivots = members.select("band", "fingerprint", "pivot").join(known.withColumnsRenamed({"x": "pivot", "y": "fingerprint"}), ["pivot", "fingerprint"], "left")
    placed = materialize(left.join(pivots.select("band", "fingerprint", F.when(F.col("fingerprint") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("d")).alias("d")), ["band", "fingerprint"]))
    # two sets of the pivot's group need not meet; each set outside it meets all of other groups
    outside = placed.where("root <> pivot_root")
    x = outside.select("band", F.col("fingerprint").alias("fx"), F.col("size").alias("nx"), F.col("root").alias("rx"), F.col("d").alias("dx"))
    y = placed.select("band", F.col("fingerprint").alias("fy"), F.col("size").alias("ny"), F.col("root").alias("ry"), F.col("d").alias("dy"))
    near = F.coalesce(F.abs(F.col("dx") - F.col("dy")) <= 1 - similarity + 1e-9, F.lit(True))
    pairs = x.join(y, (x["band"] == y["band"]) & (F.col("rx") != F.col("ry")) & fits("nx", "ny") & near).select(*_pair("fx", "fy")).distinct()
    pairs = pairs.unionByName(_crowd_pairs(crowd, sets, similarity)).distinct()
    rest = _similarities(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), sets)
    return tried.unionByName(rest).where(close).select("a", "b")
