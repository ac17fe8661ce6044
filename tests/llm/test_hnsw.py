import numpy as np
import pytest

from gaugeflow.llm import hnsw


def vectors():
    draw = np.random.default_rng(7)
    rows = []
    for label in range(3):
        points = draw.normal(size=(400, 16))
        centre = draw.normal(size=16)
        near = centre + draw.normal(size=(60, 16)) * 0.08
        chain = np.stack([np.cos(t) * points[0] / np.linalg.norm(points[0]) + np.sin(t) * points[1] / np.linalg.norm(points[1]) for t in np.linspace(0, 1.2, 6)])
        for v in np.concatenate([points, near, chain, near[:5], near[:1]]).astype(np.float32):
            rows.append((len(rows) + 1, v.tolist(), label))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(5000 + i, v, 0) for i, v in enumerate(odd)]
    rows += [(None, rows[0][1], 0), (6000, rows[0][1], None), (6001, [1.0, 2.0], 0), (None, None, None), (1, rows[0][1], 0)]
    return rows


def brute_force(rows):
    ok = [v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = [set() for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            _, w, other = rows[j]
            if ok[i] and ok[j] and label == other and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, open_ = {i}, [i]
        while open_:
            new = links[open_.pop()] - seen
            seen |= new
            open_ += new
        out.append((len(links[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return out


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_links_and_components(spark, shard_rows):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = hnsw.near_vectors(table, shard_rows=shard_rows).collect()
    expected = sorted((str(r[0]), *b) for r, b in zip(rows, brute_force(rows)))
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in found) == expected
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def test_empty_table(spark):
    assert hnsw.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_search_finds_the_nearest():
    draw = np.random.default_rng(5)
    points = draw.normal(size=(3000, 24)).astype(np.float32)
    graph = hnsw.Graph(points)
    sample = np.arange(0, 3000, 50)
    width = graph.audited_beam(sample, 0.93)
    ids, _ = graph.search(graph.points[:500], max(width, 64))
    exact = np.argsort(-(graph.points[:500] @ graph.points.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:64])) / 10 for a, b in zip(exact.tolist(), ids.tolist())]) > 0.9
