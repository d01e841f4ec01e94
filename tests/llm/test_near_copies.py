"""Near copies at a word-shingle similarity of 0.8 or more, in the pipeline stage and against brute force."""

import random
from collections import defaultdict

import corpus_pipeline

from wavemill.llm import similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Originals, edited copies around the limit, chains of edits, one large group, empty and short texts."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 35))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            words = copy if k % 3 == 0 else words
    base = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += ["", None, " ", "two words", "Two  words", "two other words", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def close(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if close(sets[i], sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    found = defaultdict(set)
    for i, (d, _) in enumerate(rows):
        found[top(i)].add(d)
    return list(found.values())


def test_stage_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = {min(g) for g in groups(rows)}
    assert len(want) < len(rows) - 150
    assert {r["doc_id"] for r in out.collect()} == want
    # the radius of op8 leaves many of them
    assert simhash.keep_first(docs).count() > len(want) + 50


def test_limit_is_exact(spark):
    words = [f"a{i}" for i in range(22)]  # 18 shingles
    exact = words[:20] + ["x", "y"]  # 16 in common of 20
    below = words[:19] + ["x", "y", "z"]  # 15 in common of 21
    assert 5 * len(shingles(" ".join(words)) & shingles(" ".join(exact))) == 4 * len(shingles(" ".join(words)) | shingles(" ".join(exact)))
    for other, kept in ((exact, 1), (below, 2)):
        docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
        assert simhash.keep_first(docs, width=5, similarity=0.8).count() == kept


def test_bands_find_pairs_at_the_limit():
    rng = random.Random(3)
    bands, missed = similar.band_count(0.8), 0
    for _ in range(2000):
        both, a, b = ([rng.getrandbits(64) for _ in range(n)] for n in (80, 10, 10))
        x, y = similar.band_hashes([both + a, both + b], bands)
        missed += not (x == y).any()
    assert missed == 0


def test_texts_with_a_common_passage_stay(spark):
    """Texts that share a passage, none similar to another, stay."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " " + passage) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.keep_first(docs, width=5, similarity=0.8).count() == 400


def _copies(rng, n, words, changes):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def _classes(texts, similarity, width=5):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_tight_and_loose_groups_lose_no_link(spark):
    rng = random.Random(3)
    tight, loose = _copies(rng, 300, 200, 2), _copies(rng, 60, 100, 6)
    texts = tight + loose
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints, component = simhash._similar_components(df, "doc_id", "text", 5, 0.8)
    got = {r["doc_id"]: r["component_id"] for r in prints.join(component, "fingerprint").collect()}
    assert [got[i] for i in range(len(texts))] == _classes(texts, 0.8)


def test_crowd_pairs_lose_no_pair(spark):
    """Pairs by rarest shingles and bit maps hold all similar pairs of different groups, for sets of many sizes."""
    rng, sets = random.Random(5), {}
    for base in range(4):
        words = rng.sample(range(1, 10**6), 60)
        for _ in range(60):
            own = set(rng.sample(words, rng.randint(40, 60)))
            own |= {rng.randrange(-2000, 0) for _ in range(rng.randint(0, 12))}
            sets[len(sets)] = sorted(own)
    sets[len(sets)] = [7]
    roots = {i: i if i % 3 else i - i % 60 for i in sets}
    crowd = spark.createDataFrame([(i, len(x), roots[i]) for i, x in sets.items()], "fingerprint long, size int, root long")
    made = similar._crowd_pairs(crowd, spark.createDataFrame(list(sets.items()), "fingerprint long, shingles array<long>"), 0.8)
    got = [(r["a"], r["b"]) for r in made.collect()]
    want = {
        (a, b)
        for a, x in sets.items()
        for b, y in sets.items()
        if a < b and roots[a] != roots[b] and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))
    }
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 100
    assert len(got) < 4 * len(want)
    assert similar._crowd_pairs(crowd.limit(0), spark.createDataFrame([], "fingerprint long, shingles array<long>"), 0.8).isEmpty()
