"""Near copies by exact similarity of word shingles.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of at least ``SIMILARITY``.
Texts of equal sets are one class. Of every class the set's SimHash goes through the parts, thresholds and probes of
``simhash``: the groups of fingerprints that ``MOST_BITS`` bits link are candidates. Similarity 0.8 alone leaves about ten bits of
64 different, more than parts can tell apart, so bands of smallest hashes propose the rest: two sets of similarity s
meet with probability ``1 - (1 - s ** BAND_ROWS) ** BANDS``, 0.9998 at 0.8 and more above. Candidates of both are verified by
their sets; a bucket passes on a spanning forest of its links, never its pairs, and the rows of a bucket of more than
``CROWDED`` texts are dealt to slots, every pair of which is a bucket of its own. Components follow.

Edge cases: texts without words are copies of one another; fewer words than a shingle make one shingle; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import ROWS_PER_BATCH, sliced, stored, utf8
from gaugeflow.llm.components import connected_components, contracted
from gaugeflow.llm.simhash import SEED, fingerprint, near_links, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits in which the fingerprints of candidates may differ.
MOST_BITS = 6
BANDS, BAND_ROWS = 16, 4
#: Texts of a bucket, from which on it is split.
CROWDED = 500
SHINGLES_AT_ONCE = 2_048

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _draw.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def band_keys(shingles: np.ndarray) -> list[int]:
    if not len(shingles):
        return []
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        mixed = (shingles[None, at : at + SHINGLES_AT_ONCE] ^ _MASKS[:, None]) * _FACTORS[:, None]
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(low.reshape(BANDS, BAND_ROWS))]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingle_set(t) for t in utf8(batch, "text")]
        same = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
        fps = pa.array([fingerprint(s) for s in sets], pa.int64())
        keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(same, pa.int64()), fps, keys], names=["place", "same", "fp", "keys"])


def similar_links(places: np.ndarray, sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of a bucket; texts that are linked already are not compared."""
    size, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    for i in range(len(sets)):
        near = (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]) - 1e-9) & (label != label[i])
        for j in i + 1 + np.flatnonzero(near[i + 1 :]):
            if label[j] != label[i]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= least * (size[i] + size[j] - common) - 1e-9:
                    label[label == label[j]] = label[i]
    return contracted(places, places[label])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, places, sets = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        if len(places) > 1:
            a, b = similar_links(np.array(places), sets)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in sliced(batches):
        for own, place, text in zip(batch.column("bucket").to_pylist(), batch.column("place").to_pylist(), utf8(batch, "text")):
            if own != key:
                yield from links()
                key, places, sets = own, [], []
            places.append(place)
            sets.append(shingle_set(text))
    yield from links()


def fingerprint_groups(classes: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """``(place, key)``: the classes whose fingerprints (``fp``) chains of at most ``bits`` bits a step link have one key."""
    fps = stored(classes.select("fp").distinct(), "copies-fingerprints")
    roots = connected_components(near_links(fps, bits)).withColumnsRenamed({"id": "fp", "component": "root"})
    return classes.join(roots, "fp", "left").select("place", F.xxhash64(F.coalesce("root", "fp")).alias("key"))


def first_copies(texts: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``place`` of the first text of each group; ``texts`` has place (long, unique) and text."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    marked = stored(texts.select("place", "text").mapInArrow(_marks, "place long, same long, fp long, keys array<long>"), "copies-marks")
    first = stored(marked.groupBy("same").agg(F.min_by("keys", "place").alias("keys"), F.min("fp").alias("fp"), F.min("place").alias("place")), "copies-classes")
    bands = stored(fingerprint_groups(first).unionByName(first.select("place", F.explode("keys").alias("key"))), "copies-candidates")
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.bit_xor(F.xxhash64("place")).alias("members")).filter("n > 1")
    different = buckets.groupBy("n", "low", "members").agg(F.min("key").alias("key"))  # one bucket of those with the same texts
    slots = F.ceil(F.col("n") / F.lit(crowded)).cast("long")
    placed = bands.join(different.select("key", slots.alias("slots")), "key").withColumn("own", F.pmod(F.xxhash64("place"), F.col("slots")))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    bucket = F.struct("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    members = stored(paired.select(F.to_json(bucket).alias("bucket"), "place"), "copies-members")
    with_text = members.join(texts.select("place", "text"), "place").select("bucket", "place", "text")
    links = with_text.repartition("bucket").sortWithinPartitions("bucket", "place").mapInArrow(_verified, "a long, b long")
    later = connected_components(links).select(F.col("id").alias("place"))
    return first.select("place").join(later, "place", "left_anti")
