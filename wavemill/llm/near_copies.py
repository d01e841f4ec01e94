"""Near copies: tiles of SimHash fingerprints find the candidates, exact Jaccard similarities decide.

Fingerprints of 512 bits are made of the distinct word shingles of a text, the
first 64 bits as plain SimHash has them. Distinct sets are laid into tiles by
size; only tiles whose sizes can belong to similar sets meet, with numpy
exclusive-or and bit counts, at a radius that misses a similar pair with a
chance of at most one in a million. A tile pair emits a spanning forest of its
candidates. What hangs together is then checked on the whole sets, in blocks of
bounded size, which emit a spanning forest of the similar pairs: pairs are never
rows of a table, however many copies a text has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, materialize, utf8
from .similar import _set_of, _sets_of
from .simhash import _TASK_PAIRS, _keys_of_tasks, connected, deal_tasks, shingle_hashes

_SEED = 42
_WORDS = 8  # 64-bit words of a fingerprint
_FIRST = 2  # of them are compared for every pair, the others for what is left
_MISS = 5e-7  # chance that one of the two comparisons leaves a similar pair out
_SIZES = 64  # sets of this size or more have one radius
_CELLS = 64  # of sizes, per doubling
_BLOCK = 200_000  # shingles of the groups that are checked in one block
_CHUNK = 1_000_000  # shingles of a chunk of a larger group, at most
_SPREAD = 8  # chunks that a larger group is cut into at least, if each has a quarter of a block


def _mixed(flat: np.ndarray, word: int) -> np.ndarray:
    """Hashes for a word of the fingerprint; the first takes them as they are."""
    if not word:
        return flat
    z = flat + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_bits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``_WORDS`` words (uint64) per set of hashes: a bit is 1 if set in over half of them; an empty set gives 0.

    Bits are counted eight bit planes at a time in the eight bytes of a word, at
    most 255 hashes together.
    """
    out = np.zeros((len(sets), _WORDS), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat, sizes = np.concatenate([sets[i] for i in some]).view(np.uint64), sizes[some]
    cuts = -(-sizes // 255)
    own = np.cumsum(cuts) - cuts
    starts = np.repeat(np.cumsum(sizes) - sizes - 255 * own, cuts) + 255 * np.arange(cuts.sum())
    counts, lane = np.empty((len(starts), 64), np.uint8), np.uint64(0x0101010101010101)
    for w in range(_WORDS):
        mixed = _mixed(flat, w)
        for k in range(8):
            counts[:, k::8] = np.add.reduceat((mixed >> np.uint64(k)) & lane, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(counts, own, axis=0, dtype=np.int64)
        out[some, w] = np.packbits(2 * total > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def bit_chances(similarity: float) -> np.ndarray:
    """By size of the smaller set: the greatest chance that a bit differs between sets of at least ``similarity``.

    Exact up to ``_SIZES`` shingles. Beyond, the chance falls towards
    arccos(2 s / (1 + s)) / pi, so the last entry, the greatest of the upper half,
    holds for all larger sets.
    """
    chance, most = np.zeros(_SIZES + 1), int(_SIZES * (1 - similarity) / similarity + 1e-9)
    tails = []  # of binomials of n fair bits: the chance of k ones or more
    for n in range(most + 1):
        tails.append(np.append(np.cumsum([math.comb(n, k) / 2**n for k in range(n, -1, -1)])[::-1], 0.0))
    for c in range(1, _SIZES + 1):
        x = np.arange(c + 1)
        weight = np.array([math.comb(c, k) / 2**c for k in range(c + 1)])
        extra = int(c * (1 - similarity) / similarity + 1e-9)
        # by further shingles n and ones x among the common: the chance that the bit is set
        over = np.stack([tails[n][np.clip((c + n) // 2 - x + 1, 0, n + 1)] for n in range(extra + 1)])
        mean = over @ weight
        differ = mean[:, None] + mean - 2 * (over * weight) @ over.T
        for a in range(min(extra // 2, _SIZES - c) + 1):
            chance[c + a] = max(chance[c + a], differ[a, a : extra - a + 1].max())
    chance[_SIZES] = max(chance[_SIZES // 2 :].max(), math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return np.clip(chance, 0, 1)


def _radius(chance: float, bits: int) -> int:
    """The least radius that a binomial of ``bits`` exceeds with a chance of at most ``_MISS``."""
    tail = 0.0
    for r in range(bits, 0, -1):
        tail += math.comb(bits, r) * chance**r * (1 - chance) ** (bits - r)
        if tail > _MISS:
            return r
    return 0


def radii(similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Radii of the first words and of all, for pairs whose smaller set has at least so many shingles (the last: or more)."""
    found = [[_radius(float(p), 64 * words) for p in bit_chances(similarity)] for words in (_FIRST, _WORDS)]
    first, full = (np.maximum.accumulate(np.array(r)[::-1])[::-1] for r in found)
    return first, full


def _words(bits: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bits), "<u8").reshape(-1, _WORDS)


def _fit(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(x, y) >= np.maximum(x, y) * similarity - 1e-6


def link_candidates(
    left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray] | None, similarity: float, reach: tuple[np.ndarray, np.ndarray], sub: int = 256
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the candidates between two tiles (keys, sizes, words), or within one.

    Tiles are ordered by size and cut into sub-tiles; a pair of sub-tiles is
    compared only if sizes in them fit.
    """

    def ordered(tile: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        order = np.argsort(tile[1], kind="stable")
        keys, sizes, words = (x[order] for x in tile)
        at = np.arange(0, len(keys), sub)
        return keys, sizes, words, at, sizes[at], np.maximum.reduceat(sizes, at)

    keys, sizes, words, at, low, high = ordered(left)
    keys_b, sizes_b, words_b, at_b, low_b, high_b = (keys, sizes, words, at, low, high) if right is None else ordered(right)
    nodes, shift = (keys, 0) if right is None else (np.concatenate([keys, keys_b]), len(keys))
    root = np.arange(len(nodes))
    out_a, out_b = [], []
    for i, s in enumerate(at):
        x, n = words[s : s + sub], sizes[s : s + sub]
        fits = (low_b * similarity <= high[i]) & (low[i] * similarity <= high_b)
        if right is None:
            fits[:i] = False
        for j in np.flatnonzero(fits):
            t = at_b[j]
            y, m = words_b[t : t + sub], sizes_b[t : t + sub]
            least = min(low[i], low_b[j], _SIZES)
            apart = sum(np.bitwise_count(x[:, None, w] ^ y[None, :, w]) for w in range(_FIRST))
            p, q = np.nonzero(apart <= reach[0][least])
            new = root[p + s] != root[q + t + shift]
            p, q = p[new], q[new]
            near = _fit(n[p], m[q], similarity) & (np.bitwise_count(x[p] ^ y[q]).sum(axis=1, dtype=np.int64) <= reach[1][least])
            for u, v in zip((p[near] + s).tolist(), (q[near] + t + shift).tolist()):
                if root[u] != root[v]:
                    out_a.append(u)
                    out_b.append(v)
                    root[root == root[v]] = root[u]
    return nodes[np.array(out_a, np.int64)], nodes[np.array(out_b, np.int64)]


def lay_sizes(cells: list[tuple[int, int, int, int]], tile_rows: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Tiles of about ``tile_rows`` sets from sorted cells (cell, rows, least, greatest size).

    Returns each cell's first tile and number of chunks, and per tile its rows
    and the least and greatest size in it.
    """
    laid, rows, low, high, whole = [], [], [], [], False
    for cell, n, least, most in cells:
        if whole and rows[-1] + n <= tile_rows:
            rows[-1], high[-1] = rows[-1] + n, most
            laid.append((cell, len(rows) - 1, 1))
            continue
        chunks = -(-n // tile_rows)
        whole = chunks == 1
        laid.append((cell, len(rows), chunks))
        rows += [n / chunks] * chunks
        low += [least] * chunks
        high += [most] * chunks
    return pd.DataFrame(laid, columns=["cell", "first", "chunks"], dtype=np.int32), np.array(rows), np.array(low), np.array(high)


def candidates(distinct: DataFrame, *, similarity: float, tile_rows: int | None = None) -> DataFrame:
    """Edges (a, b) that span every group of candidates among sets (fingerprint, size, bits), one row per set.

    Comparing is quadratic in the sets of about one size; a set is copied (80
    bytes) to the pairs of its tile. Without ``tile_rows`` small tables have some
    two dozen tiles, large ones about 128 while a tile stays under 80 MB. Only
    speed depends on it.
    """
    spark = distinct.sparkSession
    cell = F.floor(F.log2("size") * _CELLS).cast("int")
    # at most 31 * _CELLS rows
    found = distinct.where("size > 0").groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).collect()
    cells = sorted((r["cell"], r["n"], r["least"], r["most"]) for r in found)
    if not cells:
        return spark.createDataFrame([], "a long, b long")
    total = sum(c[1] for c in cells)
    if tile_rows is None:
        tile_rows = int(max(2048, min(32768, total / 24), min(1 << 20, total / 128)))
    laid, rows, low, high = lay_sizes(cells, tile_rows)
    left, right = np.nonzero(np.triu(low[None, :] * similarity <= high[:, None] + 1e-6))
    work = rows[left] * rows[right] + 2000 * (rows[left] + rows[right])
    tasks = int(max(1, min(len(left), -(-work.sum() // _TASK_PAIRS))))
    keys = np.array(_keys_of_tasks(spark, tasks))[deal_tasks(work, tasks)]
    own = left == right
    takes = pd.DataFrame({
        "tile": np.concatenate([left, right[~own]]).astype(np.int32), "task": np.concatenate([keys, keys[~own]]),
        "i": np.concatenate([left, left[~own]]).astype(np.int32), "j": np.concatenate([right, right[~own]]).astype(np.int32),
    })
    taken = spark.createDataFrame(takes)
    placed = distinct.where("size > 0").withColumn("cell", cell).join(F.broadcast(spark.createDataFrame(laid)), "cell")
    placed = placed.select("fingerprint", "size", "bits", (F.col("first") + F.pmod(F.xxhash64("fingerprint"), "chunks")).cast("int").alias("tile"))
    copied = placed.join(F.broadcast(taken) if len(takes) <= 1_000_000 else taken, "tile").select("task", "i", "j", (F.col("tile") == F.col("i")).alias("is_left"), "fingerprint", "size", "bits")
    reach = radii(similarity)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = pdf["fingerprint"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64), _words(pdf["bits"])
        is_left, same = pdf["is_left"].to_numpy(), pdf["i"].iat[0] == pdf["j"].iat[0]
        if not is_left.any() or not (same or not is_left.all()):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = link_candidates(tuple(x[is_left] for x in tile), None if same else tuple(x[~is_left] for x in tile), similarity, reach)
        return pd.DataFrame({"a": a, "b": b})

    # every task has a key of its own; grouping by it and the pair needs no further shuffle
    return copied.repartition(tasks, "task").groupBy("task", "i", "j").applyInPandas(compare, "a long, b long")


def exact_links(keys: np.ndarray, words: np.ndarray, sets: list[np.ndarray], left: np.ndarray | None, similarity: float, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the similar pairs among ``sets``; with ``left`` of those between its rows and the others."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    end = np.cumsum(sizes)
    held = [ids[e - n : e] for e, n in zip(end.tolist(), sizes.tolist())]
    mark, root = np.zeros(len(ids), bool), np.arange(len(sets))
    others = None if left is None else np.flatnonzero(~left)
    out_a, out_b = [], []
    for p in range(len(sets)) if left is None else np.flatnonzero(left).tolist():
        q = np.arange(p + 1, len(sets)) if others is None else others
        q = q[(root[q] != root[p]) & _fit(sizes[q], sizes[p], similarity)]
        q = q[np.bitwise_count(words[q] ^ words[p]).sum(axis=1, dtype=np.int64) <= reach[np.minimum(np.minimum(sizes[q], sizes[p]), _SIZES)]]
        if not len(q):
            continue
        mark[held[p]] = True
        common = np.array([np.count_nonzero(mark[held[k]]) for k in q.tolist()])
        mark[held[p]] = False
        q = q[common / (sizes[p] + sizes[q] - common) >= similarity]
        if len(q):
            joined, at = np.unique(root[q], return_index=True)
            out_a.append(np.full(len(at), keys[p]))
            out_b.append(keys[q[at]])
            root[np.isin(root, joined)] = root[p]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))


def _blocks(groups: DataFrame) -> DataFrame:
    """Rows (fingerprint, size, root) dealt to blocks (root or a number of small groups, i, j, is_left).

    Small groups share blocks. A larger one is cut into chunks and each row is
    copied to the blocks of its chunk with every other, so that all pairs meet:
    at most ``_SPREAD`` copies up to that many full chunks, then one per chunk.
    """
    summed = materialize(groups.groupBy("root").agg(F.sum("size").alias("shingles")))
    small = F.col("shingles") <= _BLOCK
    held = summed.where(small).agg(F.sum("shingles").alias("n")).first()["n"] or 0
    spread = F.least(F.lit(_SPREAD), F.ceil(F.col("shingles") / (_BLOCK // 4)))
    chunks = F.when(small, 1).otherwise(F.greatest(F.ceil(F.col("shingles") / _CHUNK), spread)).cast("int")
    number = F.when(small, F.pmod(F.xxhash64("root"), F.lit(-(-int(held) // _BLOCK) or 1))).otherwise(F.col("root"))
    told = summed.select("root", small.alias("small"), number.alias("block"), chunks.alias("chunks"))
    dealt = groups.join(broadcast_if_small(told, 500_000), "root")
    chunk = F.pmod(F.xxhash64("fingerprint", F.lit(1)), "chunks").cast("int")
    copied = dealt.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    i, j = F.least("chunk", "other"), F.greatest("chunk", "other")
    return copied.select("fingerprint", "small", "block", i.alias("i"), j.alias("j"), (F.col("chunk") == i).alias("is_left"))


def sketches(rows: DataFrame, *, width: int) -> DataFrame:
    """Written table (doc_id, text_hash, fingerprint, size, bits) of rows (doc_id, text, text_hash).

    Equal shingle sets have equal fingerprints; null and wordless texts have the
    empty set. ``bits`` is the SimHash of the set.
    """

    @F.pandas_udf("fingerprint long, size int, bits binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest as digest

        for texts in batches:
            keys, sizes, bits, held, n = [], [], [], [], 0
            for text in texts:
                held.append(_set_of(shingle_hashes(text, width)))
                keys.append(digest(held[-1].tobytes(), _SEED))
                sizes.append(len(held[-1]))
                n += sizes[-1]
                if n >= 1 << 15:
                    bits += [r.tobytes() for r in wide_bits(held).astype("<u8")]
                    held, n = [], 0
            bits += [r.tobytes() for r in wide_bits(held).astype("<u8")]
            yield pd.DataFrame({"fingerprint": np.array(keys, np.uint64).view(np.int64), "size": sizes, "bits": bits})

    made = rows.select("doc_id", "text_hash", sketch.asNondeterministic()(utf8("text")).alias("s"))
    return materialize(made.select("doc_id", "text_hash", "s.fingerprint", "s.size", "s.bits"))


def similar_links(rows: DataFrame, prints: DataFrame, *, width: int, similarity: float, tile_rows: int | None = None) -> DataFrame:
    """Edges (a, b) between fingerprints that span every group of pairs with at least ``similarity``.

    ``rows`` has (doc_id, text, text_hash), ``prints`` their written sketches.
    Repeated rows have one fingerprint and are compared once. Meant for
    similarities of 0.5 or more: at lower ones unrelated texts become candidates.
    """
    distinct = materialize(prints.groupBy("fingerprint").agg(F.first("size").alias("size"), F.first("bits").alias("bits")))
    labels = connected(candidates(distinct, similarity=similarity, tile_rows=tile_rows))
    groups = materialize(distinct.join(broadcast_if_small(labels.withColumnRenamed("node", "fingerprint"), 500_000), "fingerprint"))
    sets = _sets_of(rows, prints, groups.select("fingerprint"), width)
    known = groups.select("fingerprint", "bits").join(sets, "fingerprint")
    dealt = _blocks(groups.drop("bits")).join(known, "fingerprint")
    reach = radii(similarity)[1]

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        left = None if pdf["i"].iat[0] == pdf["j"].iat[0] else pdf["is_left"].to_numpy()
        a, b = exact_links(pdf["fingerprint"].to_numpy(np.int64), _words(pdf["bits"]), list(pdf["shingles"]), left, similarity, reach)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("small", "block", "i", "j").applyInPandas(check, "a long, b long")
