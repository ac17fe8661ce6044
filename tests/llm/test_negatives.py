import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import negatives


def vectors(n=900, size=20, labels=3):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(labels, size)) + 0.8
    rows = []
    for i in range(n):
        label = i % labels
        v = centres[label] + centres[0] * (i % 5 == 0) + draw.normal(size=size) * 0.6
        rows.append((i, (v / np.linalg.norm(v)).tolist(), label))
    for i in range(40):  # ties and repeated rows
        rows.append((n + i, rows[10][1], i % 2))
    rows += [rows[50], rows[50], (100, rows[3][1], 2)]
    odd = [None, [None] + [1.0] * (size - 1), [float("nan")] * size, [float("inf")] * size]
    rows += [(2_000 + i * 100, v, 0) for i, v in enumerate(odd)]
    return rows + [(None, rows[0][1], 0), (3_000, rows[0][1], None), (3_100, [], 0), (3_200, [0.5, -0.25], 1), (3_300, [-1.0] * size, 9)]


def integers(v):
    return [min(max(int(np.floor(256 * float(x))), -negatives.LARGEST), negatives.LARGEST) for x in v]


def score(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)


def brute_force(rows, step=100):
    ok = [(i, integers(v), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    anchors = {}
    for i, v, lab in ok:
        if i % step == 0:
            size = max(len(x[1]) for x in ok)
            packed = np.array(v + [0] * (size - len(v)), np.int32).tobytes()
            anchors[i] = min(anchors.get(i, (lab, packed, v)), (lab, packed, v))
    for i, (lab, _, v) in sorted(anchors.items()):
        scored = [(-score(v, w), j, other) for j, w, other in ok if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:5]:
            inside = sorted(x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block", [1_000, 3])
def test_against_brute_force(spark, block):
    rows = vectors()
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string").repartition(5)
    out = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, block=block)
    assert out.schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"
    expected = brute_force(rows)
    assert len(expected) > 50
    assert sorted(tuple(r) for r in out.collect()) == expected


def test_huge_components_saturate(spark):
    rows = [(0, [1e300, -1e300], 1), (1, [1e300, -1e290], 1), (2, [1e9, -1e9], 2), (3, [8e6, 1.0], 1), (4, [8e6, -8e6], 2), (100, [3.0, 4.0], 2)]
    out = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in out.collect()) == brute_force(rows)


def test_intervals_hold_every_score_and_drop_most():
    draw = np.random.default_rng(5)
    data = draw.integers(-300, 300, size=(2_000, 96))
    data[:40] = data[40] + draw.integers(-20, 20, size=(40, 96))
    anchors = negatives.Anchors(data[:50], negatives.rotation(96))
    low, high = anchors.intervals(negatives.coded(data, negatives.rotation(96)))
    exact = data @ data[:50].T
    assert (low <= exact).all() and (exact <= high).all()
    near = exact[:, 0].max() * 0.8
    assert (high[:, 0] >= near).mean() < 0.2


def test_no_rows_no_anchors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(table, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [0.5], 1), (7, [0.5], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(one, F.col("vec_id") % 100 == 0).count() == 0
