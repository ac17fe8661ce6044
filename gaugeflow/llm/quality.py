"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word's index vector is sparse and ternary, derived from its hash. Its context vector is the sum of its
neighbours' index vectors over the whole corpus: a task adds integers into one table of fixed size, the tables
are summed by a shuffle, so the sums do not depend on the order of tasks. Words share a fixed number of
slots by hash; besides words, the shape of each word and lines that a document repeats are counted as tokens.
A document is the mean of its tokens' vectors. The network is fitted in numpy on a bounded sample of labelled
rows (``SAMPLE_ROWS``, chosen by hash), and a temperature fitted on rows left out of the fit calibrates it.

Edge cases: null and empty texts are scored (all-zero vector); several labels of a document are averaged; null
labels are ignored; without labels of both kinds every score is the share of ones (0.5 without any); rows without id
are scored and count as held out; a column named like a result column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from gaugeflow.llm.common import append_columns, sliced, utf8

SLOTS = 16_384
#: Slots for word shapes and marks; words use the others.
SHAPE_SLOTS = 1_024
DIMS = 48
NONZERO = 4
REACH = 2
CHUNK_SLOTS = 256
SAMPLE_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN = 32
KNOWN_WORDS = 300_000  # of a task's cache

_KIND = bytes(
    ord("A") if 0x41 <= c <= 0x5A else ord("0") if 0x30 <= c <= 0x39 else ord("a") if 0x61 <= c <= 0x7A or c >= 0x80 else c
    for c in range(256)
)
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_EDGES = b"\"'.,;:!?()[]{}<>#$%&*+-/=@\\^_`|~"


def shape(word: bytes) -> bytes:
    """Kinds of characters, runs as one, eight at most."""
    kinds, out = word.translate(_KIND), bytearray()
    for kind in kinds:
        if not out or out[-1] != kind:
            out.append(kind)
            if len(out) == 8:
                break
    return bytes(out)


def shape_slot(mark: bytes) -> int:
    return xxhash.xxh64_intdigest(mark, 7) % SHAPE_SLOTS


class Slots(dict):
    """``word slot * SHAPE_SLOTS + shape slot`` of a word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        plain = word.translate(_FOLD).strip(_EDGES)
        own = SHAPE_SLOTS + xxhash.xxh64_intdigest(plain, 3) % (SLOTS - SHAPE_SLOTS)
        value = self[word] = own * SHAPE_SLOTS + shape_slot(b"s" + shape(word))
        return value


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of every slot's index vector."""
    draw = np.random.default_rng(11)
    places = np.argsort(draw.random((SLOTS, DIMS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), draw.choice(np.array([-1.0, 1.0]), size=(SLOTS, NONZERO))


def document_tokens(text: bytes, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Word slots in order, and slots of shapes and marks."""
    words = text.split()
    both = np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=len(words))
    seen: set[bytes] = set()
    marks = []
    for line in text.split(b"\n"):
        line = line.strip()
        if line in seen:
            marks.extend([shape_slot(b"repeated line")] * len(line.split()))
        elif line:
            seen.add(line)
    marks.extend([shape_slot(b"repeated word")] * int((both[1:] == both[:-1]).sum()))
    variety = 8 * len(set(words)) // len(words) if words else 9
    for mark in (b"length %d" % len(words).bit_length(), b"different %d" % variety):
        marks.extend([shape_slot(mark)] * (1 + len(words) // 8))  # marks of the whole text keep a fixed weight
    return both // SHAPE_SLOTS, np.concatenate([both % SHAPE_SLOTS, np.array(marks, dtype=np.int64)])


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    slots, sums = Slots(), np.zeros(SLOTS * DIMS, dtype=np.int64)

    def add(left: np.ndarray, right: np.ndarray) -> None:
        for j in range(NONZERO):
            flat = np.bincount(left * DIMS + places[right, j], weights=signs[right, j], minlength=SLOTS * DIMS)
            np.add(sums, flat.astype(np.int64), out=sums)

    def flush(words: list[np.ndarray], owners: list[np.ndarray], marks: list[tuple[np.ndarray, np.ndarray]]) -> None:
        ids, owner = np.concatenate(words), np.concatenate(owners)
        for step in range(1, REACH + 1):
            inside = owner[step:] == owner[:-step]
            near, far = ids[:-step][inside], ids[step:][inside]
            add(near, far)
            add(far, near)
        add(np.concatenate([m for m, _ in marks]), np.concatenate([w for _, w in marks]))

    words, owners, marks, count, number = [], [], [], 0, 0
    for batch in sliced(batches):
        for text in utf8(batch, "text"):
            own, shapes = document_tokens(text, slots)
            words.append(own)
            owners.append(np.full(len(own), number))
            marks.append((shapes[: len(own)], own))  # a word's shape has the word as its context
            number, count = number + 1, count + len(own)
            if count >= 1_000_000:
                flush(words, owners, marks)
                words, owners, marks, count = [], [], [], 0
    if words:
        flush(words, owners, marks)
    table = sums.reshape(-1, CHUNK_SLOTS * DIMS)
    if np.any(table):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(table))), pa.array([row.tobytes() for row in table], pa.binary())], names=["chunk", "sums"]
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, sums in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
            part = np.frombuffer(sums, dtype=np.int64)
            total[chunk] = total[chunk] + part if chunk in total else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "sums"]
    )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all slots over the whole corpus, each of length one plus its own index vector."""
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(_context_sums, "chunk long, sums binary")
    added = sums.repartition(F.col("chunk")).mapInArrow(_added, "chunk long, sums binary")
    table = np.zeros((SLOTS // CHUNK_SLOTS, CHUNK_SLOTS * DIMS))
    for row in added.collect():  # SLOTS x DIMS numbers in all
        table[row["chunk"]] = np.frombuffer(row["sums"], dtype=np.int64)
    table = table.reshape(SLOTS, DIMS)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.maximum(norm, 1.0)
    places, signs = index_vectors()
    np.add.at(table, (np.arange(SLOTS)[:, None], places), signs / np.sqrt(NONZERO))
    return table.astype(np.float32)


def pooled(text: bytes, slots: Slots, vectors: np.ndarray) -> np.ndarray:
    out = []
    for tokens in document_tokens(text, slots):
        total = np.zeros(DIMS)
        for at in range(0, len(tokens), 50_000):
            total += vectors[tokens[at : at + 50_000]].sum(axis=0, dtype=np.float64)
        out.append(total / max(len(tokens), 1))
    return np.concatenate(out)


class Network:
    """Two layers in numpy; ``temperature`` divides the last value before the logistic function."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.layers = [draw.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.temperature = 1.0
        self.constant: float | None = None

    def value(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((x - self.mean) / self.scale @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.value(x) / self.temperature, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, rest: np.ndarray, rounds: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 9) -> Network:
        """Adam on the rows not in ``rest``; the temperature on ``rest``."""
        if not len(y) or not 0 < y.mean() < 1:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        fit_x, fit_y = (x[~rest], y[~rest]) if 0 < rest.sum() < len(y) else (x, y)
        self.mean, self.scale = fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-6
        draw = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.layers]
        second = [np.zeros_like(p) for p in self.layers]
        step = 0
        for _ in range(rounds):
            order = draw.permutation(len(fit_y))
            for at in range(0, len(order), 128):
                rows = order[at : at + 128]
                z, t = (fit_x[rows] - self.mean) / self.scale, fit_y[rows]
                w, b, v, c = self.layers
                h = np.tanh(z @ w + b)
                off = (1 / (1 + np.exp(-np.clip(h @ v + c[0], -60, 60))) - t) / len(rows)
                back = np.outer(off, v) * (1 - h * h)
                slopes = [z.T @ back + decay * w, back.sum(axis=0), h.T @ off + decay * v, np.array([off.sum()])]
                step += 1
                for k, slope in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    self.layers[k] = self.layers[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if 0 < rest.sum() < len(y) and 0 < y[rest].mean() < 1:
            value, wanted = self.value(x[rest]), y[rest]

            def loss(temperature: float) -> float:
                p = np.clip(1 / (1 + np.exp(-np.clip(value / temperature, -60, 60))), 1e-9, 1 - 1e-9)
                return float(-(wanted * np.log(p) + (1 - wanted) * np.log(1 - p)).mean())

            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return self


def fold(id_col: str, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """``(text, label, fold)`` of at most ``sample`` labelled documents outside fold 0, chosen by the hash of the id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    one = known.groupBy(F.col(id_col).alias("of")).agg(F.avg(F.col(label_col).cast("double")).alias("label")).withColumn("fold", fold("of"))
    chosen = one.filter(F.col("fold") != 0).orderBy(F.xxhash64("of"), "of").limit(sample)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.join(F.broadcast(chosen), F.col("id") == F.col("of")).select("text", "label", "fold", "id")  # sample rows at most


def fit_classifier(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS
) -> tuple[np.ndarray, Network]:
    """Word vectors of the corpus and the fitted network."""
    vectors = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        slots = Slots()

        def compute(batch: pa.RecordBatch) -> list:
            return [pa.array([pooled(t, slots, shared.value).tobytes() for t in utf8(batch, "text")], pa.binary())]

        return compute

    rows = training_rows(docs, labels, id_col, text_col, label_col, sample)
    features = append_columns(rows, make, [StructField("vector", BinaryType())], ["id", "label", "fold"])
    got = sorted(((r["id"], r["vector"], r["label"], r["fold"]) for r in features.collect()), key=lambda r: (r[0], r[1]))
    x = np.array([np.frombuffer(r[1]) for r in got]).reshape(len(got), 2 * DIMS)
    y = np.array([r[2] for r in got])
    rest = np.array([r[3] == 1 for r in got], dtype=bool)
    return vectors, Network(2 * DIMS).fit(x, y, rest)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    keep: list[str] | None = None,
    sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """The rows of ``docs`` with ``score``, the calibrated probability of label 1."""
    vectors, network = fit_classifier(docs, labels, id_col, text_col, label_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def make():
        slots = Slots()

        def compute(batch: pa.RecordBatch) -> list:
            table, model = shared.value
            rows = [pooled(t, slots, table) for t in utf8(batch, text_col)]
            return [pa.array(model.score(np.array(rows)) if rows else np.empty(0), pa.float64())]

        return compute

    wanted = list(dict.fromkeys([*(docs.columns if keep is None else keep), text_col]))
    return append_columns(docs.select(wanted), make, [StructField("score", DoubleType())], wanted if keep is None else keep)
