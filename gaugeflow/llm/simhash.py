"""SimHash near-dedup by the generalised pigeonhole principle.

Bits that vary together are grouped into parts. Two fingerprints within ``k`` bits must be within ``t[i]`` bits
in some part ``i`` whenever the thresholds satisfy ``sum(t[i] + 1) = k + 1``; -1 leaves a part out. The thresholds
come from dynamic programming over estimated candidate counts: measured collisions of the part, widened by how
often its bits differ. Each distinct fingerprint is filed under its part values, probes the values within the
threshold, and candidates are verified by the full distance. A bucket passes on a spanning forest of its links,
never its pairs; components follow.

Edge cases: a null or wordless text has fingerprint zero and links like any other; fewer words than a shingle make
one shingle; a missing id never becomes a component's id (a component of rows without ids has none); repeated
rows share a component; an empty table gives no rows; a column named like a result column is replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from gaugeflow.functions.sizes import broadcast_if_few
from gaugeflow.llm.common import append_columns, stored, utf8
from gaugeflow.llm.components import connected_components, contracted

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
#: Numbers of parts that the plan chooses from.
PART_COUNTS = (3, 4, 5)
#: Relative costs of a filed or probed row and of a candidate pair.
ROW_COST, PAIR_COST = 1.0, 0.01
#: Filed rows of a bucket, from which on it is split; splits are at most ``MOST_SLOTS`` ways.
CROWDED, MOST_SLOTS = 20_000, 4_096
#: Pairs compared at once.
PAIRS_AT_ONCE = 1_000_000

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    words = text.translate(_FOLD).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    size = min(size, len(words))
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[size - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is set if more than half of the hashes have it."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, size: int = SHINGLE_WORDS, name: str = "fp") -> DataFrame:
    def make():
        return lambda batch: [pa.array([fingerprint(shingle_hashes(t, size)) for t in utf8(batch, text_col)], pa.int64())]

    wanted = list(dict.fromkeys([*(docs.columns if keep is None else keep), text_col]))
    return append_columns(docs.select(wanted), make, [StructField(name, LongType())], wanted if keep is None else keep)


def bits_of(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per fingerprint, highest bit first."""
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _joint_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        bits = bits_of(batch.column("fp").to_numpy()).astype(np.float32)
        total += bits.T @ bits
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["cell", "n"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 table of how often two bits are set together."""
    rows = fps.mapInArrow(_joint_counts, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    joint = np.zeros(BITS * BITS)
    for row in rows:
        joint[row["cell"]] = row["n"]
    return fps.count(), joint.reshape(BITS, BITS)


def correlated_parts(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size, each grown by the bit that is most correlated with it."""
    share = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    strength = np.abs(joint / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    free, out = set(range(BITS)), []
    for number in range(parts):
        width = BITS // parts + (number < BITS % parts)
        group = [max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: strength[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def part_values(values: np.ndarray, group: list[int]) -> np.ndarray:
    bits = bits_of(values)[:, group].astype(np.int64)
    return bits @ (1 << np.arange(len(group), dtype=np.int64))


def part_collisions(fps: DataFrame, layouts: list[list[list[int]]]) -> dict[tuple[int, int], float]:
    """Ordered pairs of equal value (a fingerprint with itself included) per layout and part."""
    flat = [(i, j, group) for i, layout in enumerate(layouts) for j, group in enumerate(layout)]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            for number, (_, _, group) in enumerate(flat):
                keys = part_values(values, group) * 64 + number
                yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    per_value = fps.mapInArrow(file, "key long").groupBy("key").count()
    squares = per_value.groupBy(F.pmod("key", F.lit(64)).alias("part")).agg(F.sum(F.col("count").cast("double") ** 2).alias("s"))
    return {flat[r["part"]][:2]: r["s"] for r in squares.collect()}


def allocate(n: int, joint: np.ndarray, layout: list[list[int]], squares: list[float], k: int) -> tuple[float, list[int]]:
    """Cheapest thresholds with ``sum(t + 1) = k + 1`` and their cost, by dynamic programming over the parts."""
    share = np.diag(joint) / max(n, 1)
    differ = 2 * share * (1 - share)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group, square in zip(layout, squares):
        at_distance = np.zeros(k + 2)
        at_distance[0] = 1.0
        for d in differ[group]:  # Poisson-binomial distances of two fingerprints in this part
            at_distance[1:] = at_distance[1:] * (1 - d) + at_distance[:-1] * d
            at_distance[0] *= 1 - d
        widened = np.cumsum(at_distance) / max(at_distance[0], 1e-300)
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(k - used, 2) + 1):
                rows = n * (1 + sum(math.comb(len(group), i) for i in range(1, t + 1))) if t >= 0 else 0
                pairs = square * widened[t] / 2 if t >= 0 else 0
                total = cost + ROW_COST * rows + PAIR_COST * pairs
                if total < new.get(used + t + 1, (math.inf,))[0]:
                    new[used + t + 1] = (total, [*chosen, t])
        best = new
    return best.get(k + 1, (math.inf, []))


def plan_parts(fps: DataFrame, k: int = MOST_BITS) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of the parts to file and probe."""
    n, joint = bit_statistics(fps)
    layouts = [correlated_parts(n, joint, parts) for parts in PART_COUNTS]
    squares = part_collisions(fps, layouts)
    options = []
    for i, layout in enumerate(layouts):
        cost, thresholds = allocate(n, joint, layout, [squares.get((i, j), 0.0) for j in range(len(layout))], k)
        if thresholds:
            options.append((cost, i, thresholds))
    _, i, thresholds = min(options)
    return [(group, t) for group, t in zip(layouts[i], thresholds) if t >= 0]


def _probes(plan: list[tuple[list[int], int]]):
    masks = []
    for number, (group, threshold) in enumerate(plan):
        flips = [sum(1 << b for b in chosen) for size in range(threshold + 1) for chosen in itertools.combinations(range(len(group)), size)]
        masks.append((number, group, flips))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for number, group, flips in masks:
                values = part_values(fps, group)
                for flip in flips:
                    keys = (values ^ flip) * 64 + number
                    flag = np.full(len(fps), flip != 0)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(flag), pa.array(fps)], names=["key", "probe", "fp"])

    return file


def _bucket_links(keys: np.ndarray, probe: np.ndarray, fps: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contracted links among whole buckets (rows sorted by key, filed rows first): filed rows against all later ones."""
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    end = np.repeat(edges[1:], np.diff(edges))
    filed = np.flatnonzero(~probe)
    partners = end[filed] - filed - 1
    filed, partners = filed[partners > 0], partners[partners > 0]
    total = np.cumsum(partners)
    at = 0
    while at < len(filed):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        rows, sizes = filed[at:upto], partners[at:upto]
        left = np.repeat(rows, sizes)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        near = np.bitwise_count(fps[left].view(np.uint64) ^ fps[right].view(np.uint64)) <= k
        if near.any():
            yield contracted(fps[left[near]], fps[right[near]])
        at = upto


def _linked(k: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def results(keys, probe, fps):
            found = [x for x in _bucket_links(keys, probe, fps, k) if len(x[0])]
            if found:
                a, b = contracted(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append((batch.column("key").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy()))
            rows += batch.num_rows
            if rows < 100_000 or waiting[-1][0][-1] == waiting[0][0][0]:
                continue
            keys, probe, fps = (np.concatenate(x) for x in zip(*waiting))
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last bucket may go on
            yield from results(keys[:cut], probe[:cut], fps[:cut])
            waiting, rows = [(keys[cut:], probe[cut:], fps[cut:])], len(keys) - cut
        if waiting:
            yield from results(*(np.concatenate(x) for x in zip(*waiting)))

    return link


def near_links(fps: DataFrame, k: int = MOST_BITS, crowded: int = CROWDED) -> DataFrame:
    """Links ``(a, b)`` that span every group of distinct fingerprints (``fp``) within ``k`` bits of one another.

    The rows of a bucket with more than ``crowded`` filed ones are dealt to slots by hash, and every pair of slots is
    a bucket of its own.
    """
    plan = plan_parts(fps, k)
    filed = fps.select("fp").mapInArrow(_probes(plan), "key long, probe boolean, fp long")
    sizes = fps.select("fp").mapInArrow(_probes([(group, 0) for group, _ in plan]), "key long, probe boolean, fp long").groupBy("key").count()
    slots = F.least(F.ceil(F.col("count") / F.lit(crowded)), F.lit(MOST_SLOTS))
    full = broadcast_if_few(sizes.filter(F.col("count") > crowded).select("key", slots.cast("long").alias("slots")))
    placed = filed.join(full, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("slots", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slots", F.lit(1).cast("long")) - 1))
    paired = placed.withColumn("other", other)
    bucket = (F.col("key") * MOST_SLOTS + F.least("own", "other")) * MOST_SLOTS + F.greatest("own", "other")
    dealt = paired.select(bucket.alias("key"), "probe", "fp").repartition("key").sortWithinPartitions("key", "probe")
    return dealt.mapInArrow(_linked(k), "a long, b long")


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, k: int = MOST_BITS, size: int = SHINGLE_WORDS
) -> DataFrame:
    """``keep`` (the id by default), ``fp`` and ``component_id``, the smallest id reachable over links."""
    kept = [c for c in ([id_col] if keep is None else keep) if c not in ("fp", "component_id")]
    carried = list(dict.fromkeys([id_col, *kept]))
    marked = stored(with_fingerprints(docs, text_col, carried, size), "simhash-fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min(id_col).cast("long").alias("low_id")), "simhash-classes")
    roots = connected_components(near_links(classes, k)).withColumnsRenamed({"id": "fp", "component": "root"})
    rooted = classes.join(roots, "fp", "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(*kept, "fp", "component_id")


def fingerprint_text(column: str = "fp"):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
