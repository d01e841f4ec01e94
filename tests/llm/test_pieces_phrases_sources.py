"""Pieces with spans, phrases and source divergence against the library and plain loops, and on edge rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from wavemill.llm import divergence, perfect_hash, phrases, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b ", "  ", " ", "\n", "\t", "é", "é", "ｶﾞ", "①", "㍿", "ﬁ", "Å", "​", " ", "▁", "中", "🙂", "½ ", "　", "<ab>", "<abc>", "<a", "\x01", "\0", "¨", "hello", "</s>", "<unk>", "<0x41>", "ﷺ"]


def _variant(squeeze: bool, prefix: bool, escape: bool, fallback: bool) -> bytes:
    """The public model with the library's own compatibility map and other settings."""
    model, source = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    source.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    spec = model.normalizer_spec
    spec.precompiled_charsmap = source.normalizer_spec.precompiled_charsmap
    spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces = squeeze, prefix, escape
    model.trainer_spec.byte_fallback = fallback
    for p in model.pieces:
        if p.type == 6 and not fallback:
            p.type = 5
    for i, symbol in ((500, "<ab>"), (501, "<abc>")):
        model.pieces[i].piece, model.pieces[i].type = symbol, 4
    return model.SerializeToString()


VARIANTS = [(s, p, e, f) for s in (False, True) for p in (False, True) for e in (False, True) for f in (False, True)]


@pytest.mark.parametrize("settings", [None, *VARIANTS])
def test_ids_and_spans_are_the_librarys(settings):
    blob = open(MODEL, "rb").read() if settings is None else _variant(*settings)
    model, rng = pieces.PieceModel(blob), random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 12)))
        want = [(p.id, p.begin, p.end) for p in model.whole.encode(text, return_type="proto").pieces]
        ids, begins, ends = model.encode(text, end=False)
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == want, text
        assert ids.tolist() == model.whole.encode(text)


def test_longest_prefix_of_the_character_map():
    model = pieces.PieceModel(_variant(False, False, False, True))
    raw = "xéﬁ①".encode()
    out, source = model.normalizer.run(raw)
    assert out.tobytes().decode() == "xéfi1" and source.tolist() == [0, 1, 1, 4, 4, 7, 10]


def test_texts_of_the_table(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = pieces.piece_digests(docs, MODEL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]]) + [2]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))


def test_pieces_on_edge_rows(spark):
    long = "naïve ①  text 🙂 " * 60_000
    rows = [(1, None, 7), (1, "", 7), (None, " a", 7), (2, long, 7), (2, long, 7), (3, "x▁y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = pieces.decode_pieces(pieces.encode_pieces(df, MODEL), MODEL, ids_col="ids_", name="text")
    assert out.columns == ["doc_id", "text", "IDS", "ids_", "begins", "ends", "text_"]
    got = sorted(out.collect(), key=str)
    assert [r["ids_"] for r in got if not r["text"]] == [[2], [2]] and {r["text_"] for r in got if not r["text"]} == {""}
    assert [r["text_"] for r in got if r["doc_id"] == 2] == [long, long]
    assert [r["text_"] for r in got if r["doc_id"] == 3] == ["x y"] and [r["IDS"] for r in got if r["doc_id"] == 3] == [None]
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["ends"][-1] == len(raw) and b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"])) == raw
    assert pieces.encode_pieces(df.limit(0), MODEL).count() == 0
    assert pieces.piece_digests(df.limit(0), MODEL).count() == 0
    assert pieces.encode_pieces(df, MODEL, end=False).where("doc_id = 1 and size(ids_) = 0").count() == 2


def test_perfect_hash_is_minimal_and_complete():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        table = perfect_hash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
        other = np.setdiff1d(rng.integers(0, 2**63, 1000, dtype=np.uint64), keys)
        assert (table.slots(other) < max(1, len(keys))).all()
    assert perfect_hash.build(np.array([5, 5], np.uint64)) is None


def _plain_phrases(docs, least, top):
    """{lang: rows} by dictionaries of all phrases."""
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang, low = lang if lang is not None else "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, 6) for i in range(len(ws) - k + 1))
    longer = Counter()
    for (lang, ws), c in f.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                longer[lang, ws[i : i + k]] = max(longer[lang, ws[i : i + k]], c if c >= least else 0)
    out = {}
    for (lang, ws), a in f.items():
        if len(ws) > 1 and a >= least and not 100 * longer[lang, ws] >= 100 * a:
            score, k = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
            out.setdefault(lang, []).append((" ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score))
    return {g: sorted(rows, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top] for g, rows in out.items()}


def _texts(seed=1, count=120):
    rng, words = random.Random(seed), ["New", "york", "city", "of", "the", "éa", "中文", "a-b", "x", "Z"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\r\n"]
    docs = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(count)]
    return docs + [("en", None), ("de", ""), (None, " . "), ("fr", "one"), ("en", "\x0b\x0c"), ("en", docs[0][1])] + [("en", "new york city of the x " * 300)]


@pytest.mark.parametrize("options", [{}, {"buckets": 16}, {"block_keys": 40}, {"most": 50}, {"most": 7, "block_keys": 100, "buckets": 64}, {"top": 5}])
def test_phrases_by_plain_counts(spark, options):
    docs = _texts()
    df = spark.createDataFrame([(g, t, 1, "w", 2) for g, t in docs], "lang string, text string, l int, w1 string, n int")
    got = {}
    for r in phrases.collocations(df, min_count=6, **options).collect():
        got.setdefault(r["lang"], []).append(r)
    want = _plain_phrases(docs, 6, options.get("top", 2000))
    assert set(got) == set(want) and len(want) == 3
    for g, rows in got.items():
        rows = sorted(rows, key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert [(r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows] == want[g]


def test_words_that_share_a_code_are_coded_anew(spark):
    def weak(word: str, salt: int) -> int:  # all words share seven codes under the first salt
        return phrases.word_hash(word, 0) % 7 if salt == 0 else phrases.word_hash(word, salt)

    docs = _texts(2, 40)
    df = spark.createDataFrame(docs, "lang string, text string")
    got = {(r["lang"], r["phrase"], r["a"], r["score"]) for r in phrases.collocations(df, min_count=5, hashed=weak).collect()}
    assert got == {(g, r[0], r[1], r[5]) for g, rows in _plain_phrases(docs, 5, 2000).items() for r in rows} and got


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.limit(0)).count() == 0


def test_index_drops_what_is_no_candidate(spark):
    """Stored keys decide: phrases of other words that fall on a slot are not counted there."""
    keys = np.array([[9, i, i + 1, 0, 0, 0] for i in range(1, 400)], np.int64)
    table = perfect_hash.build(phrases.phrase_hash(keys, 0))
    stored = np.empty_like(keys)
    stored[table.slots(phrases.phrase_hash(keys, 0))] = keys
    index = (0, table, stored)
    assert sorted(phrases.find_slots(index, keys).tolist()) == list(range(399))
    other = keys.copy()
    other[:, 0] = 8
    assert (phrases.find_slots(index, other) == -1).all()
    assert (table.slots(phrases.phrase_hash(other, 0)) >= 0).any()


def test_scores_beyond_64_bits(spark):
    big = 10**15
    rows = spark.createDataFrame([(1, 11, 12, 0, 0, 0, big)], "l long, w1 long, w2 long, w3 long, w4 long, w5 long, f long")
    cuts = spark.createDataFrame([(1, 11, 12, 0, 0, 0, 1, s, big + s) for s in (0, 1)], "l long, w1 long, w2 long, w3 long, w4 long, w5 long, cut int, side int, value long")
    words = spark.createDataFrame([(1, 11, "a", "en"), (1, 12, "b", "en")], "l long, code long, word string, lang string")
    r = phrases._ranked(rows, cuts, words, spark.createDataFrame([(1, 9 * big)], "l long, n long"), 10).first()
    assert (r["phrase"], r["l"], r["r"]) == ("a b", big, big + 1) and r["score"] == 1000 * big * 9 * big // (big * (big + 1))


def _plain_audit(docs, least, top):
    groups, by_group, by_lang, seen = set(), Counter(), Counter(), Counter()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        ts = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        by_group.update((lang, source, t) for t in ts)
        by_lang.update((lang, t) for t in ts)
        seen.update((lang, t) for t in set(ts))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), c in seen.items() if g == lang and c >= least]
        v, sources = len(kept), [s for g, s in groups if g == lang]

        def share(count):
            total = sum(count(t) for t in kept)
            return {t: 1 + 10**9 * (count(t) + 1) // (total + v) for t in kept}

        p = {s: share(lambda t, s=s: by_group[lang, s, t]) for s in sources}
        q = share(lambda t: by_lang[lang, t])
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if by_group[lang, s, t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(3, 200), (2, 3), (50, 200)])
def test_divergence_by_plain_counts(spark, least, top):
    rng = random.Random(4)
    words = [f"w{c}" for c in "abcdefghijkl"] + ["É", "中文", "Ab-c", "1x2", "@[`{", "it's"]
    docs = [(rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", "c", None, ""]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for _ in range(90)]
    docs += [("xx", "only", "rare"), ("xx", "other", None), ("de", "one", "a a a a"), ("en", "empty", ""), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, 1, 2, "t") for d in docs], "lang string, source string, text string, count int, p int, term string")
    got = sorted(tuple(r) for r in divergence.audit(df, least_docs=least, top_terms=top).collect())
    want = _plain_audit(docs, least, top)
    assert got == want and {r[2] for r in got} >= {"pair"}
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**18, 8 * 10**18, 5)], "c long, n long, v long")
    assert df.select(divergence._share("c", "n", "v")).first()[0] == 1 + 10**9 * (4 * 10**18 + 1) // (8 * 10**18 + 5)


def test_a_hot_source_and_a_very_long_text(spark):
    df = spark.createDataFrame([("en", "hot", "alpha beta " * 50_000)] * 3 + [("en", "cold", "alpha gamma")] * 3, "lang string, source string, text string")
    got = sorted(tuple(r) for r in divergence.audit(df).collect())
    assert got == _plain_audit([tuple(r) for r in df.collect()], 3, 200)
    out = phrases.collocations(df, min_count=100).where(F.col("phrase") == "beta alpha beta alpha beta").first()
    assert (out["a"], out["n"]) == (3 * 49_998, 300_006)


def test_counting_task_holds_one_array_and_stops_at_the_cap(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_OVERFLOW", 50)  # cut to the cap again and again
    df = spark.range(0, 4000, 1, 3)
    for cap in (None, 7):
        sums = phrases.tree_sum(df, lambda batch: iter(batch["id"].to_numpy().reshape(-1, 1) % 900 // 300), 900, cap, 2)
        want = [sum(i % 900 // 300 == p for i in range(4000)) for p in range(3)]
        assert phrases._array(sums, 900, np.dtype(np.int64 if cap is None else np.uint8))[:4].tolist() == [*(min(w, cap or w) for w in want), 0]
