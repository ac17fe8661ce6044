import random

import numpy as np
import pytest

from gaugeflow.llm import phrases


def corpus():
    draw = random.Random(5)
    word = lambda: f"w{draw.randint(0, 400)}"
    passage = [word() for _ in range(60)]
    line = [word() for _ in range(20)]
    texts = []
    for i in range(60):
        words = [word() for _ in range(draw.randint(0, 150))]
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[draw.randint(0, 20) : draw.randint(40, 60)]
        if i % 4 == 0:
            words += line
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1] + " more", None, "", "few words"]
    texts += ["same " * 200, " ".join(passage + ["gap"] + passage), "é ü " * 40, "A " * 34, "A " * 35]
    return texts


@pytest.mark.parametrize("settings", [{}, {"shard_passages": 3}, {"crowded": 1, "shard_passages": 10}])
def test_matches_brute_force(spark, settings):
    texts = corpus()
    rows = [(i if i % 9 else None, t, "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(4)
    found = phrases.remove_repeats(docs, keep=["text"], **settings).collect()
    expected = sorted(((t or ""), *b) for t, b in zip(texts, phrases.brute_force(texts)))
    assert sorted((r["text"] or "", r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == expected
    for r in found:
        assert r["n_removed"] == 0 or len(r["kept_text"].split()) == r["n_words"] - r["n_removed"]


def test_empty_table(spark):
    assert phrases.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_choose_the_same_anchor():
    draw = np.random.default_rng(0)
    shared = draw.integers(0, 1 << 63, 50).astype(np.uint64)
    seen = []
    for n in (0, 13, 40):
        words = np.concatenate([draw.integers(0, 1 << 63, n).astype(np.uint64), shared, draw.integers(0, 1 << 63, 30).astype(np.uint64)])
        anchors, first, last = phrases.anchor_runs(words)
        own = {int(s - n): int(a) for a, f, l in zip(anchors, first, last) for s in range(f, l + 1)}
        seen.append([own[s] for s in range(50 - phrases.WINDOW + 1)])
    assert seen[0] == seen[1] == seen[2]


def test_automaton_finds_partial_passages():
    passage = " ".join(f"p{i}" for i in range(80))
    part = " ".join(["x"] + [f"p{i}" for i in range(20, 60)] + ["y"])
    shard = phrases.ShardAutomaton({passage: 1, part: 1})
    assert shard.covered(passage) == [(20, 60)] and shard.covered(part) == [(1, 41)]
    assert phrases.ShardAutomaton({passage: 1}).covered(passage) == []
    assert phrases.ShardAutomaton({passage: 2}).covered(passage) == [(0, 80)]
