import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import katz


def words_of(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def corpus():
    draw = random.Random(2)
    rows = []
    for i in range(150):
        words, at = [], 0
        for _ in range(draw.randint(0, 120)):
            at = (at * 3 + draw.choice([1, 1, 1, 2, 5])) % 97
            words.append(f"W{at}" if draw.random() < 0.9 else f"r{draw.randint(0, 3000)}")
        rows.append((i, " ".join(words)))
    return rows + [(None, "w1 w2 w3"), (7, None), (9, ""), (11, "w1 " * 4000), (11, "w1 w4 w13"), (11, "w1 w4 w13")]


@pytest.mark.parametrize("limits", [{}, {"shared_words": 40, "bucket_tokens": 300}])
def test_base_matches_brute_force(spark, limits):
    rows = corpus()
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    counts = Counter(t for (_, text), own in zip(rows, learn) if own for t in [*words_of(text), "end"])
    total, types = sum(counts.values()), len(counts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).repartition(3)
    found = katz.score_text(docs, keep=["doc_id", "text"], **limits).collect()
    assert len(found) == len(rows)
    for r in found:
        tokens = [*words_of(r["text"]), "end"]
        expected = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert math.isclose(r["base_score"], expected, rel_tol=1e-9)
        assert r["score"] < 0


def test_model_beats_the_base_on_unseen_rows(spark):
    docs = spark.createDataFrame([r for r in corpus() if r[0] != 11], "doc_id long, text string")  # 11: one word, over and over
    held = katz.score_text(docs, keep=["doc_id"]).filter(katz.fold("doc_id") == katz.HELD_OUT)
    row = held.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > row["b"]


def test_distributions_sum_to_one():
    draw = np.random.default_rng(3)
    counts = np.sort(draw.geometric(0.05, 300))[::-1].astype(np.int64)
    histogram = Counter(counts.tolist())
    lower = katz.fit_unigrams({c: (n, n * c) for c, n in histogram.items()})
    single = lower.probability(counts)
    assert math.isclose(single.sum() + lower.unknown, 1, rel_tol=1e-12)
    table = Counter()
    for a, word in enumerate(counts.tolist()):
        for b in draw.integers(0, 60, word).tolist():
            table[a << 16 | b] += 1
    pairs = np.array(sorted(p for p, c in table.items() if c > 1))
    c = np.array([table[p] for p in pairs])
    model = katz.fit_bigrams(pairs, c, counts, katz.discounts(dict(Counter(table.values()))), single)
    for a in range(300):
        own = pairs >> 16 == a
        kept = (10 ** model.log10[own]).sum()
        backed = 10 ** model.weights[a] * (1 - single[pairs[own] & 0xFFFF].sum())
        assert math.isclose(kept + backed, 1, rel_tol=1e-9)


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = katz.score_text(docs, training=F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in rows)
    assert katz.score_text(docs.limit(0)).count() == 0


def test_cut_off():
    assert katz.cut_off({1: 100, 2: 10, 5: 3}, 13) == 2 and katz.cut_off({1: 100, 2: 10}, 9) == 3 and katz.cut_off({}, 5) == 1


@pytest.mark.parametrize("limits", [{}, {"shared_words": 10, "bucket_tokens": 100}, {"shared_words": 1}])
def test_scores_take_all_bigrams_whatever_is_sent(spark, limits):
    rows = [(i, text) for i, text in corpus() if i is not None]
    learned = [[*words_of(text), "end"] for i, text in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, pairs = Counter(t for ts in learned for t in ts), Counter(p for ts in learned for p in zip(ts, ts[1:]))
    order = [w for w, _ in counts.most_common()]
    rank, c = {w: i for i, w in enumerate(order)}, np.array([counts[w] for w in order])
    history = c.copy()
    history[rank["end"]] = 0
    lower = katz.fit_unigrams({n: (k, n * k) for n, k in Counter(counts.values()).items()})
    table = sorted((rank[a] << 16 | rank[b], n) for (a, b), n in pairs.items())
    keys, n = (np.array(x) for x in zip(*table))
    model = katz.fit_bigrams(keys, n, history, katz.discounts(dict(Counter(pairs.values()))), lower.probability(c))
    seen = dict(zip(keys.tolist(), model.log10))

    def expected(tokens):
        out = 0.0
        for a, b in zip([None, *tokens], tokens):
            single = math.log10(lower.probability(np.array([counts[b]]))[0])
            backed = model.weights[rank[a]] + single if a in rank else single
            out += seen[rank[a] << 16 | rank[b]] if (a, b) in pairs else backed
        return out

    found = katz.score_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep=["text"], **limits).collect()
    assert len(found) == len(rows)
    for r in found:
        assert math.isclose(r["score"], expected([*words_of(r["text"]), "end"]), rel_tol=1e-9)
