import random
from itertools import combinations

import corpus_pipeline
from gaugeflow.llm import near_copies

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def expected(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if root[i] != root[j] and similar(sets[i], sets[j]):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def edited_texts():
    draw, texts = random.Random(4), []
    for _ in range(12):
        words = [f"w{draw.randint(0, 5000)}" for _ in range(200)]
        for edits in range(8):
            own = list(words)
            for at in draw.sample(range(200), edits):  # an edit changes five shingles
                own[at] = f"x{draw.randint(0, 10**9)}"
            texts.append(" ".join(own))
    return [*texts, None, "", "one two", "ONE two", texts[0].upper()]


def test_groups_match_brute_force(spark):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "place long, text string").repartition(3)
    for crowded in (near_copies.CROWDED, 3):
        assert {r["place"] for r in near_copies.first_copies(docs, crowded).collect()} == expected(texts)


def test_the_stage_keeps_the_first_of_edited_copies(spark):
    texts = edited_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()} == expected(texts)


def test_fingerprints_alone_propose_what_the_bands_miss(spark, monkeypatch):
    """Without a band key, texts within the bits are still found, and none that aren't similar."""
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "place long, text string").repartition(3)
    monkeypatch.setattr(near_copies, "band_keys", lambda shingles: [])
    kept = {r["place"] for r in near_copies.first_copies(docs).collect()}
    fps = [near_copies.fingerprint(near_copies.shingle_set((t or "").encode())) for t in texts]
    sets = [shingles(t) for t in texts]
    near = {j for i, j in combinations(range(len(texts)), 2) if sets[i] != sets[j] and similar(sets[i], sets[j]) and ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= near_copies.MOST_BITS}
    assert len(near) > 10 and not near & kept
    assert expected(texts) <= kept
