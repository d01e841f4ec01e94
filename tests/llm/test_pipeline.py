"""The pipeline against a plain computation on a small fixture."""

import os

import corpus_pipeline
import pytest

from wavemill.llm import decontam, secrets

WORDS = [f"w{i}" for i in range(2000)]


def sentence(start, n):
    return " ".join(WORDS[(start + 7 * i) % 2000] for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("corpus"))
    passage = " ".join(f"bench{i}" for i in range(14))
    docs = [
        (1, sentence(1, 120), "en"), (2, sentence(1, 120), "en"), (3, sentence(300, 90) + " " + passage + " " + sentence(900, 40), "en"),
        (4, "too short", "en"), (5, "same five words here now " * 30, "en"), (6, sentence(50, 80) + " password=abcdefghijklmnop end", "en"), (7, passage, "en"), (8, None, None),
    ]
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept == [{1, 2, 3, 6, 7}, {1, 3, 6, 7}, {1, 3, 6}, {1, 3, 6}]
    text = {r["doc_id"]: r for r in docs.collect()}
    assert "bench" not in text[3]["text"] and text[3]["text"].startswith(sentence(300, 90)) and text[3]["text"].endswith(sentence(900, 40))
    assert text[6]["text"] == sentence(50, 80) + " [SECRET] end"
    assert all(r["n_chars"] == len(r["text"]) for r in text.values())
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontam.contamination(docs, bench).where("contaminated").count() == 0
    assert secrets.scan(docs).where("spans <> ''").count() == 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} == {1, 3, 6}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secrets", "packing"]


def test_stages_on_edge_rows(spark, folder):
    """Nulls, empty texts, repeated rows, ties, further columns with clashing names, and an empty table."""
    long = " ".join(f"u{i}" for i in range(30_000))
    rows = [(1, sentence(1, 120), "en", "s", None, "c", "c"), (1, sentence(1, 120), "en", "s", None, "c", "c"), (1, sentence(700, 90), "en", "s", None, "c", "c"), (None, sentence(40, 50), None, None, None, "c", "c")]
    rows += [(5, None, None, None, None, None, None), (6, "", "en", "s", 0, "c", "c"), (7, long, "fr", "s", len(long), "c", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, metrics string, fingerprint string")
    for start in (docs, docs.limit(0)):
        got = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, got, folder)
            assert got.columns == docs.columns, name
        texts = sorted(r["text"] for r in got.collect())
        assert texts == (sorted([sentence(1, 120), sentence(700, 90), sentence(40, 50), long]) if start is docs else [])
    assert corpus_pipeline.pack(spark, docs.limit(0), folder).count() == 0


def test_scratch_is_dropped(spark):
    from wavemill.llm import common

    df = common.materialize(spark.range(5))
    assert df.count() == 5
    folder = common._scratch(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    common.drop_scratch(spark)
    assert not os.path.exists(folder)
