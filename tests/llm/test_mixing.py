import random

from pyspark.sql import functions as F

from gaugeflow.llm import mixing


def plain_targets(sizes):
    """Reshare by weight until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s] + 1e-9}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def documents(spark, n=1500):
    draw = random.Random(1)
    rows = [(i, " ".join("w" * draw.randint(1, 200)), f"s{draw.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(n)]
    rows += [(None, "a b c", None), (1, "a", None), (1, "a", None), (7, None, "s1"), (8, "", "empty"), (9, "x " * 4000, "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("own"))


def test_targets_totals_and_copies(spark):
    docs = documents(spark)
    for block_docs in (4096, 50):  # the second takes several rounds of flights
        rows = mixing.mix_sources(docs, keep=["doc_id", "source"], block_docs=block_docs).collect()
        assert len(rows) == docs.count()
        sizes = {}
        for r in rows:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        expected = plain_targets(sizes)
        for source, size in sizes.items():
            own = [r for r in rows if r["source"] == source]
            assert all(r["source_size"] == size and abs(r["target"] - expected[source]) < 1e-6 for r in own)
            assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
            assert abs(sum(r["taken"] for r in own) - expected[source]) <= max(0.01 * size, 3)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(7), keep=["doc_id", "source"], block_docs=block_docs).collect()))


def test_flight_keeps_the_balance():
    draw = random.Random(3)
    sizes = [draw.randint(0, 500) for _ in range(1000)]
    chances = [0.37] * 1000
    moved = mixing.flight(sizes, chances, draw)
    undecided = [c for c in moved if 0 < c < 1]
    assert len(undecided) <= 2 and all(0 <= c <= 1 for c in moved)
    assert abs(sum(s * c for s, c in zip(sizes, moved)) - 0.37 * sum(sizes)) < 1e-3
    assert abs(sum(moved) - 370) < 1e-6


def test_landing_is_the_best_way():
    assert mixing.landed([5, 7, 20], [0.5, 0.5, 1.0]) in ([0.0, 1.0, 1.0], [1.0, 0.0, 1.0])
    assert mixing.landed([3, 4], [0.0, 1.0]) == [0.0, 1.0]


def test_empty_table(spark):
    assert mixing.mix_sources(documents(spark, 3).limit(0)).count() == 0
