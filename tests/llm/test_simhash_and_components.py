import numpy as np
import pytest
import xxhash

from gaugeflow.llm import simhash
from gaugeflow.llm.components import connected_components


def components_of(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    draw = np.random.default_rng(1)
    links = {
        "chain": [(i, i + 1) for i in range(300)] + [(5, 5), (3, 4)],
        "star": [(1000, i) for i in range(200)] + [(2000, 2001)],
        "random": [tuple(map(int, draw.integers(0, 400, 2))) for _ in range(300)],
        "none": [],
    }[kind]
    found = connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    label = components_of(links, {x for link in links for x in link})
    assert {r["id"]: r["component"] for r in found} == {n: c for n, c in label.items() if n != c}


def slow_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_groups_match_brute_force(spark):
    draw = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in draw.integers(0, 50, 80)) for _ in range(6)]
    texts = list(base)
    for text in base[:3]:
        for _ in range(12):
            words = text.split()
            words[int(draw.integers(0, len(words)))] = "changed"
            texts.append(" ".join(words))
    texts += [None, "", "  \n", "One two", "one\ttwo", texts[0], "x y z " * 3000]
    rows = [(None if i == 7 else 1000 - i, t, "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    found = simhash.near_duplicate_components(docs, keep=["doc_id", "text"]).select("doc_id", "text", simhash.fingerprint_text().alias("f"), "component_id").collect()
    assert len(found) == len(rows)
    prints = [slow_fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    label = components_of(links, range(len(texts)))
    lowest = {}
    for i, (doc_id, _, _) in enumerate(rows):
        lowest[label[i]] = min(x for x in (doc_id, lowest.get(label[i])) if x is not None) if doc_id is not None or label[i] in lowest else None
    expected = sorted((str(r[0]), r[1] or "", f"{prints[i]:016x}", lowest[label[i]]) for i, r in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["text"] or "", r["f"], r["component_id"]) for r in found) == expected
    assert simhash.near_duplicate_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 7])
def test_every_close_pair_shares_a_bucket(spark, crowded):
    """Fingerprints at every distance up to four from a few centres come out as one component each."""
    draw = np.random.default_rng(8)
    values = set()
    for centre in draw.integers(-(1 << 62), 1 << 62, 5).tolist():
        for distance in range(5):
            for _ in range(20):
                flips = sum(1 << int(b) for b in draw.choice(64, distance, replace=False))
                values.add(int(np.int64(np.uint64((centre ^ flips) & ((1 << 64) - 1)))))
    values |= set(draw.integers(-(1 << 62), 1 << 62, 2000).tolist())
    fps = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    found = {r["id"]: r["component"] for r in connected_components(simhash.near_links(fps, crowded=crowded)).collect()}
    array = np.array(sorted(values))
    near = np.argwhere(np.bitwise_count(array[:, None].view(np.uint64) ^ array[None, :].view(np.uint64)) <= 4)
    label = components_of([(int(array[a]), int(array[b])) for a, b in near if a < b], map(int, array))
    assert found == {n: c for n, c in label.items() if n != c}


def test_thresholds_cover_the_distance():
    draw = np.random.default_rng(2)
    bits = draw.integers(0, 2, (500, 64)).astype(float)
    joint = bits.T @ bits
    for parts in simhash.PART_COUNTS:
        layout = simhash.correlated_parts(500, joint, parts)
        assert sorted(b for group in layout for b in group) == list(range(64))
        _, thresholds = simhash.allocate(500, joint, layout, [500.0] * parts, 4)
        assert sum(t + 1 for t in thresholds) == 5
