"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are computed per row in Arrow batches. Distinct fingerprints are
laid into tiles by population count; only tile pairs whose counts differ by at
most the radius are compared, with numpy exclusive-or and bit counts.
Each tile pair emits a spanning forest of what it linked, never all its pairs,
and the forests are joined by contraction rounds of DataFrame joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import broadcast_if_small, fresh, materialize, utf8

_SEED = 42
_SEGMENT = 65535  # a 16-bit lane counts this far


def shingle_hashes(text: bytes | None, width: int = 4) -> list[int]:
    """XXH64 (seed 42) of the lower-cased word shingles; fewer words give one shingle, none gives none."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split() if text else []  # bytes: ASCII case and ASCII white space only
    n = len(words)
    if n <= width:
        return [digest(b" ".join(words), _SEED)] if n else []
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: n - width + 1].tolist()
    return [digest(joined[a:b], _SEED) for a, b in zip(start, end[width - 1 :].tolist())]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """One fingerprint (uint64) per list: a bit is 1 if set in over half its hashes; an empty list gives 0.

    Bits are counted sixteen bit planes at a time in four 16-bit lanes of each
    word, so that no list is expanded to 64 columns.
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    if not sizes.sum():
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    starts, owner = [], []
    for i in np.flatnonzero(sizes):
        cuts = range(int(first[i]), int(first[i] + sizes[i]), _SEGMENT)
        starts.extend(cuts)
        owner.extend([i] * len(cuts))
    counts = np.zeros((len(hashes), 64), np.int64)
    lane = np.uint64(0x0001000100010001)
    for k in range(16):
        part = np.add.reduceat((flat >> np.uint64(k)) & lane, starts).astype("<u8").view("<u2").reshape(-1, 4)
        np.add.at(counts[:, k::16], owner, part.astype(np.int64))
    bits = 2 * counts > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprint_udf(width: int):
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            done, held, n = [], [], 0
            for text in texts:
                held.append(shingle_hashes(text, width))
                n += len(held[-1])
                if n >= 1 << 16:
                    done.append(majority_bits(held))
                    held, n = [], 0
            done.append(majority_bits(held))
            yield pd.Series(np.concatenate(done).view(np.int64))

    return fingerprint.asNondeterministic()


def fingerprints(docs: DataFrame, *, text_col: str = "text", width: int = 4, out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with a signed 64-bit SimHash column. Null and wordless texts have fingerprint 0."""
    return docs.withColumn(out_col, _fingerprint_udf(width)(utf8(text_col)))


def _blocks(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.astype("<u8").view("<u2").reshape(-1, 4)).astype(np.int16)


def link_tiles(left: np.ndarray, right: np.ndarray | None, radius: int, sub: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links within ``radius`` bits between two tiles, or within one.

    Both tiles are ordered by the population counts of their four 16-bit
    quarters and cut into sub-tiles; a pair of sub-tiles is compared only if the
    ranges of their quarter counts are within the radius of each other.
    """

    def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q = _blocks(x)
        order = np.lexsort(q.T[::-1])
        x, q = x[order], q[order]
        at = np.arange(0, len(x), sub)
        return x, at, np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)

    a, a_at, a_lo, a_hi = ordered(left)
    b, b_at, b_lo, b_hi = (a, a_at, a_lo, a_hi) if right is None else ordered(right)
    nodes = a if right is None else np.concatenate([a, b])
    shift = 0 if right is None else len(a)
    root = np.arange(len(nodes))
    for i, s in enumerate(a_at):
        first = i if right is None else 0
        gap = np.maximum(0, np.maximum(b_lo[first:] - a_hi[i], a_lo[i] - b_hi[first:])).sum(axis=1)
        x = a[s : s + sub, None]
        for j in np.flatnonzero(gap <= radius) + first:
            t = b_at[j]
            near = np.bitwise_count(x ^ b[None, t : t + sub]) <= radius
            p, q = np.nonzero(near)
            p, q = root[p + s], root[q + t + shift]
            differ = p != q
            if differ.any():
                pairs = np.unique(np.sort(np.stack([p[differ], q[differ]], 1), axis=1), axis=0)
                for u, v in pairs.tolist():
                    while root[u] != u:
                        u = root[u]
                    while root[v] != v:
                        v = root[v]
                    if u != v:
                        root[max(u, v)] = min(u, v)
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


#: Values that one task compares at the most useful size: about 0.1 s of work in numpy.
_TASK_PAIRS = 100_000_000


def _quarters(fingerprint: Column) -> list[Column]:
    """Population counts of the four 16-bit quarters, the highest first."""
    return [F.bit_count(F.shiftrightunsigned(fingerprint, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int") for k in (3, 2, 1, 0)]


def _code(fingerprint: Column) -> Column:
    """One number for (population count, quarter counts), in that order."""
    q = _quarters(fingerprint)
    code = q[0] + q[1] + q[2] + q[3]
    for x in q[:3]:
        code = code * 17 + x
    return code.cast("int")


def lay_tiles(codes: np.ndarray, sizes: np.ndarray, tile_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tiles of about ``tile_rows`` values from the sorted cells (code, size).

    Neighbouring small cells share a tile; a large cell is cut into chunks.
    Returns each cell's first tile and number of chunks, and per tile its size
    and the least and largest (population, quarter counts) in it.
    """
    first, chunks = np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64)
    rest, parts = codes.copy(), []
    for _ in range(3):
        parts.append(rest % 17)
        rest = rest // 17
    counts = np.stack([rest, *parts[::-1], rest - sum(parts)], 1)
    rows, low, high = [], [], []
    for k, n in enumerate(sizes.tolist()):
        if rows and n <= tile_rows and rows[-1] + n <= tile_rows and chunks[k - 1] == 1:
            rows[-1] += n
            low[-1], high[-1] = np.minimum(low[-1], counts[k]), np.maximum(high[-1], counts[k])
            first[k] = len(rows) - 1
            continue
        first[k], chunks[k] = len(rows), -(-n // tile_rows)
        rows += [n / chunks[k]] * chunks[k]
        low += [counts[k]] * chunks[k]
        high += [counts[k]] * chunks[k]
    return first, chunks, np.array(rows), (np.stack(low), np.stack(high))


def pair_tiles(rows: np.ndarray, box: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile pairs (i <= j) that can hold a link: population counts within the radius, quarter counts within it in sum."""
    low, high = box
    left, right = [], []
    for i in range(len(rows)):
        gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:]))
        j = np.flatnonzero((gap[:, 0] <= radius) & (gap[:, 1:].sum(axis=1) <= radius)) + i
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def deal_tasks(work: np.ndarray, tasks: int) -> np.ndarray:
    """A task for every pair, the largest first and always to the task with the least work so far."""
    out, heap = np.zeros(len(work), np.int64), [(0.0, t) for t in range(tasks)]
    for k in np.argsort(-work, kind="stable").tolist():
        load, t = heapq.heappop(heap)
        out[k] = t
        heapq.heappush(heap, (load + float(work[k]), t))
    return out


def _keys_of_tasks(spark: SparkSession, tasks: int) -> list[int]:
    """For every task a number that Spark's hash partitioning puts into that partition alone."""
    keys: dict[int, int] = {}
    start, step = 0, 16 * tasks + 64
    while len(keys) < tasks:
        found = spark.range(start, start + step, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("t")).agg(F.min("id").alias("k")).collect()  # a row per task
        for r in found:
            keys.setdefault(r["t"], r["k"])
        start += step
    return [keys[t] for t in range(tasks)]


def near_links(distinct: DataFrame, *, radius: int = 4, tile_rows: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span every group of the link graph.

    ``distinct`` has one row per value in column ``fingerprint``. Values are
    ordered by population count, then by the counts of their four quarters, and
    laid into tiles of about ``tile_rows``; tile pairs whose counts are too far
    apart for any link are skipped before the shuffle. The other pairs are dealt
    to tasks by the work they make, and a value is copied (8 bytes) to the pairs
    of its tile. Without ``tile_rows`` small tables have some two dozen tiles,
    for even tasks, and large ones at most about 512 while a tile stays under
    8 MB, so that copies stay few. Only speed depends on it.
    """
    spark = distinct.sparkSession
    # at most 17**4 rows, one per combination of quarter counts
    cells = sorted((r["c"], r["n"]) for r in distinct.groupBy(_code(F.col("fingerprint")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not cells:
        return spark.createDataFrame([], "a long, b long")
    codes, sizes = (np.array(x, np.int64) for x in zip(*cells))
    if tile_rows is None:
        tile_rows = int(max(2048, min(32768, sizes.sum() / 24), min(1 << 20, sizes.sum() / 512)))
    first, chunks, rows, box = lay_tiles(codes, sizes, tile_rows)
    left, right = pair_tiles(rows, box, radius)
    work = rows[left] * rows[right] + 2000 * (rows[left] + rows[right])
    tasks = int(max(1, min(len(left), -(-work.sum() // _TASK_PAIRS))))
    keys = np.array(_keys_of_tasks(spark, tasks))[deal_tasks(work, tasks)]
    tile = spark.createDataFrame(pd.DataFrame({"code": codes.astype(np.int32), "first": first.astype(np.int32), "chunks": chunks.astype(np.int32)}))
    own = left == right
    takes = pd.DataFrame({
        "tile": np.concatenate([left, right[~own]]).astype(np.int32), "task": np.concatenate([keys, keys[~own]]),
        "i": np.concatenate([left, left[~own]]).astype(np.int32), "j": np.concatenate([right, right[~own]]).astype(np.int32),
    })
    taken = spark.createDataFrame(takes)
    dealt = distinct.select("fingerprint", _code(F.col("fingerprint")).alias("code")).join(F.broadcast(tile), "code")  # at most 17**4 rows
    placed = dealt.select("fingerprint", (F.col("first") + F.pmod(F.xxhash64("fingerprint"), "chunks")).cast("int").alias("tile"))
    copied = placed.join(F.broadcast(taken) if len(takes) <= 1_000_000 else taken, "tile").select("task", "i", "j", (F.col("tile") == F.col("i")).alias("is_left"), "fingerprint")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        values, is_left = pdf["fingerprint"].to_numpy(np.int64).view(np.uint64), pdf["is_left"].to_numpy()
        same = pdf["i"].iat[0] == pdf["j"].iat[0]
        one, other = values[is_left], values[~is_left]
        if not len(one) or not (same or len(other)):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = link_tiles(one, None if same else other, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    # every task has a key of its own; grouping by it and the pair needs no further shuffle
    return copied.repartition(tasks, "task").groupBy("task", "i", "j").applyInPandas(compare, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b), by rounds of hooking and contraction.

    Each round hooks every node to its smallest neighbour if that is smaller,
    shortens the chains by pointer jumping and keeps the edges between different
    roots. All steps are joins and partial aggregates on written tables, so a
    node with very many links is split by skew handling, not gathered.
    """
    edges = materialize(edges.where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")))
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialize(hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.select("node", "up")
            if not moved:
                break
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("root"))
        else:
            labels = materialize(
                labels.join(hooks.withColumnsRenamed({"node": "root"}), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            )
        left = hooks.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        half = materialize(edges.join(left, "a").select("b", F.col("ra").alias("a")))
        right = hooks.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = materialize(half.join(right, "b").where("a <> rb").select("a", F.col("rb").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, tile_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Written tables (doc_id, text_hash, fingerprint) per row and (fingerprint, root, component_id) per value."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    prints = materialize(fingerprints(rows, width=width).select("doc_id", "text_hash", "fingerprint"))
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    labels = connected(near_links(distinct, radius=radius, tile_rows=tile_rows))
    return prints, _rooted(distinct, labels)


def _similar_components(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """As ``_components``, with candidates from tiles of wider SimHashes and links at an exact Jaccard similarity of the shingle sets; equal sets share a fingerprint."""
    from . import near_copies

    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    prints = near_copies.sketches(rows, width=width)
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    labels = connected(near_copies.similar_links(rows, prints, width=width, similarity=similarity))
    return prints.drop("size", "bits"), _rooted(distinct, labels)


def _rooted(distinct: DataFrame, labels: DataFrame) -> DataFrame:
    rooted = materialize(
        distinct.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    )
    lowest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return materialize(rooted.join(lowest, "root").select("fingerprint", "root", "component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, tile_rows: int | None = None) -> DataFrame:
    """One row per document: doc_id, signed ``fp`` and ``component_id``, the smallest id reachable over links.

    Null and wordless texts have fingerprint 0 and link like any other. Rows
    without an id take part and get the smallest id of their group (null if
    none has one). Repeated rows are returned as often as they occur. An empty
    table gives an empty result. Other columns are not read.
    """
    prints, component = _components(docs, id_col, text_col, width, radius, tile_rows)
    return prints.join(component, "fingerprint").select("doc_id", F.col("fingerprint").alias("fp"), "component_id")


def keep_first(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, tile_rows: int | None = None, similarity: float | None = None
) -> DataFrame:
    """One document of every near-duplicate group, all its columns kept: that of the smallest id.

    With ``similarity``, links are pairs of texts whose sets of word shingles
    have at least that Jaccard similarity, found among the pairs whose SimHashes
    of 512 bits are near enough; ``radius`` is then not read. Rows
    without an id come after all others; of rows with equal ids that with the
    smallest text hash stays, and of wholly repeated rows one. Texts without
    words, null ones too, are one group; texts of any length are read whole; an
    empty table gives an empty result. The rows that go are joined away, so the
    texts that stay are not shuffled while those rows are few enough to send.
    """
    if similarity is None:
        prints, component = _components(docs, id_col, text_col, width, radius, tile_rows)
    else:
        prints, component = _similar_components(docs, id_col, text_col, width, similarity)
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    counted = prints.join(component, "fingerprint").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    least = counted.groupBy("root").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("keys"), F.max("rows").alias("rows"))
    crowded = materialize(least.where("keys > 1 or rows > 1").select("root", "least"))
    # the rows of groups of several: those that go, and those of which one of several equal rows stays
    members = materialize(counted.join(crowded, "root").select("doc_id", "text_hash", "rows", (key == F.col("least")).alias("stays")).where("not stays or rows > 1"))
    own_id, own_hash, once = fresh("id", docs), fresh("hash", docs), fresh("once", docs)
    named = members.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("stays").alias(once))
    text_hash, same = F.xxhash64(text_col), F.col(id_col).eqNullSafe(F.col(own_id))
    gone = broadcast_if_small(named.where(~F.col(once)), 500_000)
    kept = docs.join(gone, same & (text_hash == F.col(own_hash)), "left_anti")
    repeated = named.where(once)
    if repeated.isEmpty():
        return kept
    # only repeated rows are shuffled by key; all others stay where they are
    told = broadcast_if_small(repeated, 500_000)
    marked = same & (text_hash == F.col(own_hash))
    several = kept.join(told, marked, "left_semi").withColumn(own_hash, text_hash).dropDuplicates([id_col, own_hash]).drop(own_hash)
    return kept.join(told, marked, "left_anti").unionByName(several)
