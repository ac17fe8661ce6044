import random

from gaugeflow.operators.topics import topic_gaps


def test_gaps_and_repeats_across_chunks(spark):
    draw = random.Random(4)
    rows, want = [], []
    for partition in range(4):
        offsets = sorted(draw.sample(range(50, 400), 250))
        doubled = draw.sample(offsets, 20)
        rows += [(partition, o, "x") for o in offsets + doubled + doubled[:5]]
        want += [(partition, "gap", a + 1, b - 1, b - a - 1) for a, b in zip(offsets, offsets[1:]) if b > a + 1]
        want += [(partition, "repeat", o, o, 2 if o in doubled[:5] else 1) for o in doubled]
    draw.shuffle(rows)
    table = spark.createDataFrame([*rows, (None, 3, "x"), (1, None, "x")], "partition int, offset long, value string")
    for per_chunk in (1_000_000, 7, 1):
        assert sorted(tuple(r) for r in topic_gaps(table, per_chunk).collect()) == sorted(want)
    assert topic_gaps(table.limit(0)).count() == 0
