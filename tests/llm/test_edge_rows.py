"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
import public_tokenizers

from wavemill.llm import chat, decontam, langid, packing, pii, quality, secrets, sharding, simhash, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, kept string, metrics int, fingerprint string, __key string, __kinds string, __spans string, __leaks string, __id string, __hash string, __metrics string, sequence_id string, shard string, personal string, leaks string, secrets string"
LONG = "the quick brown fox jumps over the lazy dog. " * 5000
TEXTS = [
    (1, "hello world this is a plain text of some ten words or so", "en"),
    (1, "hello world this is a plain text of some ten words or so", "en"),
    (2, None, "en"),
    (None, "no id at all but text of reasonable length to be kept in here", None),
    (None, None, None),
    (3, "", "fr"),
    (4, " \n\t ", None),
    (5, LONG, "en"),
    (6, "x", "de"),
    (7, "naïve café 中文 🙂 password=abcdefghijkl12 a@b.co +1 (555) 123-4567", "fr"),
    (-9, "negative id with enough words to pass the base rules of the filter", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, "s", None, 1, "c", "c", 1, *"ccccccccccccc") for i, t, g in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0), (6, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, "hello world this is a plain text of some ten words"), (2, None), (None, "lazy dog the quick brown fox jumps over the lazy dog"), (3, ""), (3, "café")]
    return spark.createDataFrame(items, "item_id long, text string")


QUERIES = {
    "secrets": lambda d, l, b: secrets.scan(d),
    "packing": lambda d, l, b: packing.pack_documents(d, PATH),
    "quality": lambda d, l, b: quality.judge(d, l),
    "pii": lambda d, l, b: pii.scan(d),
    "langid": lambda d, l, b: langid.predict_languages(d),
    "decontam": lambda d, l, b: decontam.contamination(d, b),
    "sharding": lambda d, l, b: sharding.shard_slots(d),
    "simhash": lambda d, l, b: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", QUERIES)
def test_rows_are_neither_lost_nor_added(name, docs, labels, benchmark):
    out = QUERIES[name](docs, labels, benchmark)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    key = lambda x: (x is None, x or 0)
    if name == "packing":
        assert set(ids) == {i for i, _, _ in TEXTS}
    else:
        assert sorted(ids, key=key) == sorted([i for i, _, _ in TEXTS], key=key)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(name, docs, labels, benchmark):
    assert QUERIES[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0


def test_filters_keep_all_columns(docs, labels, benchmark):
    for out in (quality.keep_good(docs, labels), simhash.keep_first(docs), decontam.remove_spans(docs, benchmark), secrets.redact(docs)):
        assert out.columns == docs.columns
        assert out.count() <= len(TEXTS)
        extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars", "n_words", "metrics")]
        assert {tuple(r) for r in out.select(*extra).distinct().collect()} == {("c",) * len(extra)}
    assert secrets.redact(docs).count() == len(TEXTS)


def test_defined_results(docs, labels, benchmark):
    q = {r["doc_id"]: r for r in quality.judge(docs, labels).collect() if r["doc_id"] is not None}
    assert q[2]["n_words"] == 0 and q[2]["base_failed"] and not q[2]["kept"]
    assert q[1]["kept"] and q[-9]["kept"] and q[5]["base_failed"]
    d = [r for r in decontam.contamination(docs, benchmark).collect()]
    assert [r["n_hit"] for r in d if r["doc_id"] == 1] == [11, 11]
    assert [(r["n_hit"], r["n_items"]) for r in d if r["doc_id"] == 7] == [(1, 1)]
    s = [r for r in sharding.shard_slots(docs).collect()]
    assert {r["size"] for r in s if r["doc_id"] in (2, 3)} == {1}
    assert len({(r["shard"], r["slot"]) for r in s}) == len(TEXTS)
    lang = {r["doc_id"]: r for r in langid.predict_languages(docs).collect()}
    assert lang[2]["lang_pred"] == lang[3]["lang_pred"] == lang[4]["lang_pred"] == "und"
    p = {r["doc_id"]: r for r in pii.scan(docs).collect() if r["doc_id"] == 7}[7]
    assert (p["n_email"], p["n_phone"]) == (1, 1)
    c = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert c[1] == 1 and c[3] == c[4] == c[2] == 2


def test_one_of_each_group_stays(docs):
    kept = simhash.keep_first(docs).select("doc_id", "text").collect()
    assert len([r for r in kept if r["doc_id"] == 1]) == 1
    assert len([r for r in kept if not (r["text"] or "").strip()]) == 1


def test_extra_columns_survive_redaction(docs):
    r = secrets.redact(docs).where("doc_id = 7").first()
    assert r["text"] == "naïve café 中文 🙂 [SECRET] a@b.co +1 (555) 123-4567" and r["secrets"] == "c"


def test_pages(spark):
    rows = [(1, "http://a.example.com/x", "y" * 2000, 1), (2, "http://a.example.com/x", "y" * 2000, 1), (2, "http://a.example.com/x", "y" * 2000, 1), (3, None, None, 1), (None, "http://b", "z", 1), (4, "http://[bad", "short", 1), (5, "http://c", "y" * 2000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str)
    want = [(1, 2000, "revisit", 5), (2, 2000, "revisit", 5), (2, 2000, "revisit", 5), (3, 0, "response", None), (None, 1, "response", None), (4, 5, "response", None), (5, 2000, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(0, 0, "user", "a", 1), (0, 1, "assistant", "bcd", 1), (1, 0, "user", "a", 1), (1, 1, "assistant", "c", 1), (1, 1, "assistant", "c", 1), (1, 2, "user", "thanks", 1)]
    rows += [(2, 0, "user", None, 1), (2, None, "user", "x", 1), (None, 0, "user", "x", 1), (5, 0, None, "only", 1), (7, 0, "assistant", "", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {r["pair_id"]: r for r in chat.format_preferences(turns).collect()}

    def said(role, text):
        return f"<|im_start|>{role}\n{text}<|im_end|>\n"

    assert set(got) == {0, 1, 2, 5, 7} and chat.format_preferences(turns.limit(0)).count() == 0
    r = got[0]
    assert (r["prompt"], r["chosen"], r["rejected"]) == (said("user", "a"), said("assistant", "bcd"), said("assistant", "c"))
    assert [tuple(x) for x in r["chosen_trained"]] == [(0, len(r["chosen"]))]
    r = got[1]  # no neighbour with a reply: half of "c" is empty
    assert (r["chosen"], r["rejected"]) == (said("assistant", "c") + said("user", "thanks"), said("assistant", ""))
    assert [tuple(x) for x in r["chosen_trained"]] == [(0, len(said("assistant", "c")))]
    for k, role, text in ((2, "user", ""), (5, "", "only")):
        assert (got[k]["prompt"], got[k]["chosen"], got[k]["rejected"], got[k]["chosen_trained"]) == ("", said(role, text), "", [])
    assert (got[7]["chosen"], got[7]["rejected"]) == (said("assistant", ""), "")


def test_long_conversations_come_in_chunks(spark):
    said = [("user" if i % 2 == 0 else "assistant", f"turn {i} " + "x" * (300_000 if i == 3 else i % 7)) for i in range(700)]
    turns = spark.createDataFrame([(4, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    rows = chat.format_preferences(turns).orderBy("chunk").collect()
    assert [r["chunk"] for r in rows] == [0, 1, 2]
    whole = [f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in said]
    assert "".join(r["prompt"] for r in rows) == "".join(whole[:-1]) and "".join(r["chosen"] for r in rows) == whole[-1]
    assert rows[2]["rejected"] == whole[-1].replace(said[-1][1], said[-1][1][: len(said[-1][1]) // 2])


def test_common_prefix_of_any_two_sides(spark):
    sides = [(1, c, t, "assistant" if t % 2 else "user", f"{t}" if t < 3 else f"{t}{c}") for c in (True, False) for t in range(5 if c else 4)]
    df = spark.createDataFrame(sides, "pair_id long, is_chosen boolean, turn long, role string, text string")
    got = sorted((r["part"], r["turn"], r["trained"]) for r in chat.preference_turns(df).collect())
    assert got == [("chosen", 3, True), ("chosen", 4, False), ("prompt", 0, False), ("prompt", 1, False), ("prompt", 2, False), ("rejected", 3, True)]
