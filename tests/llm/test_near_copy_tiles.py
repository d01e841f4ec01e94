"""SimHash tiles and the exact check behind the pipeline's near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_copies import _classes, _copies, corpus

from wavemill.llm import near_copies, similar, simhash


def _hashes(rng, n):
    return rng.integers(-(2**63), 2**63, n)


def _pair(rng, common, a, b):
    both = _hashes(rng, common)
    return [np.unique(np.concatenate([both, _hashes(rng, n)])) for n in (a, b)]


def _classes_of(spark, texts, similarity=0.8):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints, component = simhash._similar_components(df, "doc_id", "text", 5, similarity)
    got = {r["doc_id"]: r["component_id"] for r in prints.join(component, "fingerprint").collect()}
    return [got[i] for i in range(len(texts))]


def test_stage_goes_by_simhash(spark, monkeypatch):
    """The links come from SimHash tiles: the MinHash bands are not called."""

    def refuse(*args, **named):
        raise AssertionError("MinHash bands in place of SimHash")

    for name in ("sketches", "similar_links", "band_hashes", "_crowd_pairs"):
        monkeypatch.setattr(similar, name, refuse)
    texts = _copies(random.Random(1), 20, 200, 1) + _copies(random.Random(2), 2, 100, 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_first(docs, width=5, similarity=0.8).collect()} == {0, 20}


def test_bits_are_majorities():
    rng = np.random.default_rng(1)
    sets = [_hashes(rng, n) for n in (1, 2, 254, 255, 256, 510, 700)] + [np.zeros(0, np.int64)]
    bits = near_copies.wide_bits(sets)
    assert (bits[:, 0] == simhash.majority_bits([s.view(np.uint64).tolist() for s in sets])).all()
    for s, row in zip(sets, bits):
        for w in range(8):
            mixed = near_copies._mixed(s.view(np.uint64), w).tolist()
            assert int(row[w]) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in mixed) > len(mixed))
    assert not near_copies.wide_bits([np.zeros(0, np.int64)]).any()


@pytest.mark.parametrize("sizes", [(4, 0, 1), (8, 1, 1), (12, 0, 3), (36, 4, 5), (160, 20, 20)])
def test_chances_and_radii(sizes):
    """Measured shares of differing bits at the limit stay under the chance, and no pair is beyond the radii."""
    rng, (common, a, b) = np.random.default_rng(2), sizes
    sets = [s for _ in range(1000) for s in _pair(rng, common, a, b)]
    apart = np.bitwise_count(np.bitwise_xor(*near_copies.wide_bits(sets).reshape(-1, 2, 8).swapaxes(0, 1))).astype(int)
    least = min(common + min(a, b), 64)
    assert apart.sum() / apart.size / 64 <= near_copies.bit_chances(0.8)[least] + 0.003
    first, full = near_copies.radii(0.8)
    assert (apart[:, :2].sum(1) <= first[least]).all() and (apart.sum(1) <= full[least]).all()
    assert full[64] < 512 * 0.25  # unrelated pairs are at half


@pytest.mark.parametrize("tile_rows", [None, 50])
def test_candidates_hold_all_similar_pairs(spark, tile_rows):
    rng, held = np.random.default_rng(3), []
    for n in (5, 9, 20, 80, 300):
        for _ in range(25):
            held += _pair(rng, n * 8, n, n) + _pair(rng, n * 5, 0, n)
    held += [_hashes(rng, 100) for _ in range(200)]
    rows = [(i, len(s), bits.tobytes()) for i, (s, bits) in enumerate(zip(held, near_copies.wide_bits(held)))]
    edges = near_copies.candidates(spark.createDataFrame(rows, "fingerprint long, size int, bits binary"), similarity=0.8, tile_rows=tile_rows)
    got = [tuple(sorted((r["a"], r["b"]))) for r in edges.collect()]
    pairs = {(2 * i, 2 * i + 1) for i in range(250)}
    assert pairs <= set(got)
    # the few others are pairs of one origin whose similarity is under the limit
    assert len(set(got)) < 260


def test_loose_group_in_chunks(spark, monkeypatch):
    """A group with many pairs under the limit is cut into chunks; its rows are copied a few times and no link is lost."""
    monkeypatch.setattr(near_copies, "_BLOCK", 4000)
    monkeypatch.setattr(near_copies, "_CHUNK", 40_000)
    texts = _copies(random.Random(3), 250, 150, 10) + _copies(random.Random(4), 5, 60, 1)
    want = _classes(texts, 0.8)
    assert 40 < len(set(want)) < 200
    assert _classes_of(spark, texts) == want
    groups = spark.createDataFrame([(i, 146, 0) for i in range(250)] + [(250 + i, 56, 250) for i in range(5)], "fingerprint long, size int, root long")
    dealt = near_copies._blocks(groups).collect()
    assert len(dealt) == 250 * near_copies._SPREAD + 5
    met = {(r["i"], r["j"]) for r in dealt if not r["small"]}
    assert met == {(i, j) for i in range(8) for j in range(i, 8)}


def test_same_classes_as_bands(spark):
    """An independent search by MinHash bands finds the same classes."""
    docs = spark.createDataFrame([(i, t) for i, t in corpus()], "doc_id long, text string")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = similar.sketches(rows, width=5, similarity=0.8)
    labels = simhash.connected(similar.similar_links(rows, prints, width=5, similarity=0.8))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    want = {r["doc_id"]: r["component_id"] for r in prints.join(simhash._rooted(distinct, labels), "fingerprint").collect()}
    assert _classes_of(spark, [t for _, t in corpus()]) == [want[i] for i in range(len(want))]
