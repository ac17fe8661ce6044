"""Hard negatives: wrong-label vectors that score nearly as high as an anchor's positives.

Vectors become integers, floor(256 * x). Each is rotated by a fixed random rotation and coded by the signs of its
rotated components; with the code go the vector's alignment with it (inner product with the unit sign vector) and the
length of the residual. An anchor's rotated components are rounded to a few bit planes, so a popcount per plane gives
its inner product with a code up to the known rounding error. By Cauchy-Schwarz, the residual adds at most its length
times the length of the anchor's part across the code: together an interval that surely holds the score. Intervals
below the fifth best positive, or beside the window of every positive, drop a vector; the others are scored in integers.

Anchors are taken in blocks of ``ANCHORS`` in id order; a block is broadcast and meets all rows in two scans, one for
the positives and one for the negatives. A scan gives at most a few rows per anchor and task, whatever labels are common.

Edge cases: rows without id, label or vector, or with a null or non-finite component, take no part; an empty vector
scores 0, a shorter one counts as if zeros followed; components saturate at plus or minus 2**31 - 1 and scores at the
limits of a long; ties go to the smaller id, then label and vector; repeated rows are candidates each by itself, rows with the
anchor's own id never; of anchors that share an id the first by label and vector counts; an anchor without positives
gives no rows; negative positive scores leave no window; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gaugeflow.llm.common import ROWS_PER_BATCH, sliced, stored
from gaugeflow.session import scratch_dir

SCALE, LARGEST = 256, 2**31 - 1
POSITIVES, NEGATIVES = 5, 5
#: Anchors of a block, rows compared with it at once, bit planes of an anchor, pairs scored at once.
ANCHORS, ROWS, PLANES, PAIRS = 1_024, 512, 4, 65_536
SEED = 7
#: Relative slack for rounding in the intervals.
SLACK = 1e-9

CODED = "vec_id long, label long, vector binary, code binary, align double, rest double"
PAIR = "anchor_id long, slot int, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def rotation(size: int) -> np.ndarray:
    if not size:
        return np.zeros((0, 0))
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), max(1, -(-bits.shape[1] // 64)) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def integers(rows: list, size: int) -> np.ndarray:
    """``floor(256 * x)`` of the vectors' components, padded with zeros."""
    out = np.zeros((len(rows), size))
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * out), -LARGEST, LARGEST).astype(np.int64)


@dataclass
class Codes:
    """One-bit codes of rotated vectors with their alignments and residual lengths."""

    words: np.ndarray
    align: np.ndarray
    rest: np.ndarray


def coded(vectors: np.ndarray, turn: np.ndarray) -> Codes:
    turned = vectors @ turn
    align = np.abs(turned).sum(axis=1) / np.sqrt(max(len(turn), 1))
    rest = np.sqrt(np.maximum((turned**2).sum(axis=1) - align**2, 0.0))
    return Codes(packed(turned > 0), align, rest)


class Anchors:
    """A block of anchors, rounded to bit planes."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.vectors, self.size = vectors, max(vectors.shape[1], 1)
        turned = vectors @ turn if vectors.shape[1] else np.zeros((len(vectors), 1))
        self.low = turned.min(axis=1)
        span = turned.max(axis=1) - self.low
        self.step = np.where(span > 0, span / (2**PLANES - 1), 1.0)
        steps = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        rounded = self.low[:, None] + self.step[:, None] * steps
        self.planes = [packed((steps >> j) & 1 == 1) for j in range(PLANES)]
        self.steps = steps.sum(axis=1)
        self.norm = np.sqrt((turned**2).sum(axis=1))
        self.error = np.abs(turned - rounded).sum(axis=1) / np.sqrt(self.size) + SLACK * self.norm

    def intervals(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, rows by anchors."""
        ones = np.bitwise_count(codes.words).sum(axis=1, dtype=np.int64)
        count = np.zeros((len(ones), len(self.norm)), np.int64)
        for j, plane in enumerate(self.planes):
            for w in range(codes.words.shape[1]):
                count += np.bitwise_count(codes.words[:, w, None] & plane[None, :, w]).astype(np.int64) << j
        along = (self.low * (2 * ones[:, None] - self.size) + self.step * (2 * count - self.steps)) / np.sqrt(self.size)
        least = np.maximum(np.abs(along) - self.error, 0.0)
        across = np.sqrt(np.maximum(self.norm**2 - least**2, 0.0))
        length = np.sqrt(codes.align**2 + codes.rest**2)
        half = codes.align[:, None] * self.error + codes.rest[:, None] * across + SLACK * length[:, None] * self.norm + SLACK
        middle = codes.align[:, None] * along
        return middle - half, middle + half

    def scores(self, vectors: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products of pairs."""
        out = np.zeros(len(row), np.int64)
        if not vectors.size or not self.vectors.size:
            return out
        most = int(np.abs(vectors).max()) * int(np.abs(self.vectors).max()) * self.size
        for at in range(0, len(row), PAIRS):
            left, right = vectors[row[at : at + PAIRS]], self.vectors[anchor[at : at + PAIRS]]
            if most < 2**63:
                out[at : at + PAIRS] = np.einsum("ij,ij->i", left, right)
            else:
                exact = (left.astype(object) * right.astype(object)).sum(axis=1)
                out[at : at + PAIRS] = [min(max(x, -(2**63)), 2**63 - 1) for x in exact]
        return out


def best(key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each key: higher scores, then smaller ids."""
    order = np.lexsort((vec_id, -score.astype(object) if len(score) and score.min() == -(2**63) else -score, key))
    sorted_key = key[order]
    start = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - first < k]


class Kept:
    """The best rows of each key so far, and each key's last kept score once it has enough."""

    def __init__(self, keys: int, k: int):
        self.key, self.score, self.vec_id = (np.zeros(0, np.int64) for _ in range(3))
        self.k, self.bar = k, np.full(keys, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        key, score, vec_id = np.r_[self.key, key], np.r_[self.score, score], np.r_[self.vec_id, vec_id]
        at = best(key, score, vec_id, self.k)
        self.key, self.score, self.vec_id = key[at], score[at], vec_id[at]
        full = np.bincount(self.key, minlength=len(self.bar)) == self.k
        low = np.full(len(self.bar), np.inf)
        np.minimum.at(low, self.key, self.score.astype(float))
        self.bar[full] = low[full]

    def rows(self, anchor_ids: np.ndarray, slots: int) -> pa.RecordBatch:
        columns = [anchor_ids[self.key // slots], (self.key % slots).astype(np.int32), self.vec_id, self.score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "slot", "vec_id", "score"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Codes]]:
    for batch in sliced(batches, ROWS):
        if batch.num_rows:
            vectors = np.array([np.frombuffer(v, np.int32) for v in batch.column("vector").to_pylist()]).reshape(batch.num_rows, size).astype(np.int64)
            words = np.array([np.frombuffer(c, np.uint64) for c in batch.column("code").to_pylist()])
            codes = Codes(words, batch.column("align").to_numpy(), batch.column("rest").to_numpy())
            yield batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), vectors, codes


def usable(embeddings: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """``(vec_id, label, vector)`` of the rows that take part."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def code_table(rows: DataFrame, size: int) -> DataFrame:
    """Integers, codes, alignments and residuals of all rows, stored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(size)
        for batch in sliced(batches):
            vectors = integers(batch.column("vector").to_pylist(), size)
            codes = coded(vectors, turn)
            binary = [pa.array([v.tobytes() for v in x], pa.binary()) for x in (vectors.astype(np.int32), codes.words)]
            columns = [batch.column("vec_id"), batch.column("label"), *binary, pa.array(codes.align), pa.array(codes.rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vector", "code", "align", "rest"])

    return stored(rows.mapInArrow(run, CODED), "negatives-codes")


def _scan(codes: DataFrame, anchors: Anchors, ids: np.ndarray, labels: np.ndarray, size: int, positives: list[list[tuple[int, int]]] | None) -> DataFrame:
    """Each task's best pairs: the anchors' positives, or the negatives in the windows of the given positives (by slot)."""
    slots = 1 if positives is None else POSITIVES
    high = np.zeros((len(ids), POSITIVES), np.int64)
    low = np.ones((len(ids), POSITIVES), np.int64)  # low above high: no window
    for a, of in enumerate(positives or []):
        for s, (_, score) in enumerate(of):
            high[a, s], low[a, s] = score, -(-80 * score // 100)
    shared = codes.sparkSession.sparkContext.broadcast((anchors, ids, labels, high, low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, ids, labels, high, low = shared.value
        kept = Kept(len(ids) * slots, POSITIVES if positives is None else NEGATIVES)
        for vec_ids, row_labels, vectors, codes in _blocks(batches, size):
            least, most = anchors.intervals(codes)
            same = row_labels[:, None] == labels[None, :]
            if positives is None:
                asked = same & (vec_ids[:, None] != ids[None, :])
                bar = kept.bar
                if len(vec_ids) >= POSITIVES:
                    bar = np.maximum(bar, np.partition(np.where(asked, least, -np.inf), -POSITIVES, axis=0)[-POSITIVES])
                row, anchor = np.nonzero(asked & (most >= bar))
                kept.add(anchor, anchors.scores(vectors, row, anchor), vec_ids[row])
                continue
            bars = kept.bar.reshape(-1, slots)
            near = np.zeros(same.shape, bool)
            for s in range(slots):
                window = low[:, s] <= high[:, s]
                near |= window & (most >= np.maximum(low[:, s], bars[:, s])) & (least <= high[:, s])
            row, anchor = np.nonzero(near & ~same)
            scores = anchors.scores(vectors, row, anchor)
            inside = [np.nonzero((scores >= low[anchor, s]) & (scores <= high[anchor, s]))[0] for s in range(slots)]
            keys = np.concatenate([anchor[x] * slots + s for s, x in enumerate(inside)])
            at = np.concatenate(inside)
            kept.add(keys, scores[at], vec_ids[row[at]])
        yield kept.rows(ids, slots)

    return codes.mapInArrow(run, PAIR)


def _first(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label: Column | None = None,
    vector_col: str = "embedding",
    block: int = ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition over ``vec_id`` and ``label``, ``label`` a column of ``embeddings``.
    """
    spark = embeddings.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    rows = usable(embeddings, id_col, F.col("label") if label is None else label, vector_col)
    size = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    codes = code_table(rows, size)
    anchors = stored(codes.filter(is_anchor).select("vec_id", "label", "vector"), "negatives-anchors")
    root, last, blocks = scratch_dir(spark, "negatives"), None, 0
    while True:
        rest = anchors if last is None else anchors.filter(F.col("vec_id") > last)
        taken = rest.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own")).orderBy("vec_id").limit(block).collect()  # a block at most
        if not taken:
            break
        ids, labels = (np.array(x, np.int64) for x in ([r["vec_id"] for r in taken], [r["own"]["label"] for r in taken]))
        vectors = np.array([np.frombuffer(r["own"]["vector"], np.int32) for r in taken]).reshape(len(taken), size).astype(np.int64)
        own = Anchors(vectors, rotation(size))
        found: dict[int, list] = {i: [] for i in ids.tolist()}
        for r in _first(_scan(codes, own, ids, labels, size, None), POSITIVES).orderBy("anchor_id", "rank").collect():  # POSITIVES rows per anchor
            found[r["anchor_id"]].append((r["vec_id"], r["score"]))
        positives = list(found.values())
        named = spark.createDataFrame([(i, s, v, x) for i, of in found.items() for s, (v, x) in enumerate(of)], "anchor_id long, slot int, positive_id long, positive_score long")
        negatives = _first(_scan(codes, own, ids, labels, size, positives), NEGATIVES)
        pairs = negatives.join(F.broadcast(named), ["anchor_id", "slot"])
        pairs.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{root}/block={blocks}")
        last, blocks = int(ids[-1]), blocks + 1
    return _read(spark, root, blocks)


def _read(spark: SparkSession, root: str, blocks: int) -> DataFrame:
    if not blocks:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(root)
