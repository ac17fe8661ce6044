"""Language-model scoring with a Katz backoff model of words.

Unigram counts cover every training token, bigram counts every pair of neighbouring words. Counts up to ``DISCOUNTED``
are discounted by Good-Turing estimates from the counts of counts of all n-grams. Every history's backoff weight is what
its bigrams leave of the mass, divided by what their words leave of the lower order, so each history's distribution sums to
one. The mass of unseen words is one event of the unigram distribution. Words are known by a hash of 64 bits.

The pairs of all documents are dealt once, packed, to buckets by their first word; the pairs of a frequent first word are dealt to
several. A bucket counts its pairs over the training rows, so it knows for each document which of its pairs were seen and
how often, and passes on sums per document, the counts of counts per history, and the pairs of unscored rows that need
their history's weight. No pair is looked up a second time. The most frequent words (``shared_words``) go to every task; the
others are joined with the stored table of words. Neither limit changes the model.

A document's score is the unigram of its first token, for each later token that was seen after its history
``log10(discounted count / history count)``, and for each other one the history's weight and the token's unigram.

Edge cases: a null or empty text is its end token alone; without training rows only the unknown event remains;
rows without id take part in the training; repeated rows count repeatedly; a column named like a result column is
replaced; an empty table gives no rows. A pair that most documents hold has one entry per document in its bucket.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from gaugeflow.llm.common import ROWS_PER_BATCH, reads_files_only, sliced, stored, utf8
from gaugeflow.session import scratch_dir

FOLDS, HELD_OUT = 7, 2
#: Words sent to every task, the most frequent ones; others are joined.
SHARED_WORDS = 262_144
#: Training tokens per bucket of pairs; a first word with more than a quarter of that is dealt to several buckets.
BUCKET_TOKENS, FEWEST_BUCKETS = 600_000, 12
DISCOUNTED = 5
#: What a task holds before it passes it on: words, and documents and pairs of a packed block.
HELD_WORDS, HELD_DOCS, HELD_PAIRS = 200_000, 60_000, 800_000
#: Words whose figures a scoring task remembers.
KNOWN_WORDS = 150_000
#: Rows of a bucket that are passed on at once.
OUTCOME_ROWS = 20_000
TABLE_PARTS = 16

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: No word contains a space.
END = xxhash.xxh64_intdigest(b" end ") - (1 << 63)


def fold(id_col: str, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def unigram_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` of the rows of ``docs`` (text), the end token included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: Counter, ends: int) -> pa.RecordBatch:
            keys = pa.array([*map(word_key, held), *[END] * bool(ends)], pa.int64())
            return pa.RecordBatch.from_arrays([keys, pa.array([*held.values(), *[ends] * bool(ends)], pa.int64())], names=["word", "c"])

        held, ends = Counter(), 0
        for batch in sliced(batches):
            for text in utf8(batch, "text"):
                held.update(words_of(text))
                ends += 1
                if len(held) > HELD_WORDS:
                    yield rows(held, ends)
                    held, ends = Counter(), 0
        yield rows(held, ends)

    return docs.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def discounts(counts_of_counts: dict[int, int], top: int = DISCOUNTED) -> np.ndarray:
    """Factors for the counts 0 to ``top``: Katz's discounts, or half a count off where they are no proper estimate."""
    out = np.ones(top + 1)
    n = [counts_of_counts.get(r, 0) for r in range(top + 2)]
    tail = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
    for r in range(1, top + 1):
        factor = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = factor if 0 < factor < 1 else (r - 0.5) / r
    return out


@dataclass
class Unigrams:
    """Counts of all training tokens and their discounted distribution."""

    total: int
    types: int
    factors: np.ndarray
    unknown: float  # probability of the event that a word is new
    scale: float

    def probability(self, c: np.ndarray) -> np.ndarray:
        factor = self.factors[np.minimum(c, len(self.factors) - 1)]
        factor = np.where(c < len(self.factors), factor, 1.0)
        return np.where(c > 0, self.scale * factor * c / max(self.total, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.types + 1))


def fit_unigrams(of_counts: dict[int, tuple[int, int]]) -> Unigrams:
    """From ``count: (number of words, tokens)``; a distribution without room for new words gets one part in total + 1."""
    total, types = sum(t for _, t in of_counts.values()), sum(n for n, _ in of_counts.values())
    factors = discounts({c: n for c, (n, _) in of_counts.items()})
    left = sum((1 - factors[c]) * tokens for c, (_, tokens) in of_counts.items() if c < len(factors)) / max(total, 1)
    if total == 0:
        return Unigrams(0, 0, factors, 1.0, 1.0)
    if left <= 0:
        return Unigrams(total, types, factors, 1 / (total + 1), total / (total + 1))
    return Unigrams(total, types, factors, left, 1.0)


class Vocabulary(dict):
    """Small numbers for the words of a block, and their keys; 0 is the end token."""

    def __init__(self):
        super().__init__()
        self.keys_of = [END]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.keys_of)
        self.keys_of.append(word_key(word))
        return number

    def tokens(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        out = np.zeros(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out


def places(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


@dataclass
class Bigrams:
    pairs: np.ndarray  # ascending
    log10: np.ndarray
    weights: np.ndarray  # log10 of the backoff weight of each word as history


def fit_bigrams(pairs: np.ndarray, c: np.ndarray, history: np.ndarray, factors: np.ndarray, lower: np.ndarray) -> Bigrams:
    """The model of few words in memory, pairs as ``first * 2**16 + second``; ``word_table`` and the buckets are the same for any number.

    ``history``: tokens after each word; ``lower``: unigram probabilities of the words.

    A history whose bigrams would use up the mass gives one part in its tokens + 1 back; one whose words
    cover the whole lower order cannot occur, as the unknown event has mass.
    """
    first, second = pairs >> 16, pairs & 0xFFFF
    factor = np.where(c < len(factors), factors[np.minimum(c, len(factors) - 1)], 1.0)
    share = factor * c / np.maximum(history[first], 1)
    used = np.bincount(first, weights=share, minlength=len(history))
    full = used >= 1 - 1e-12
    if full.any():
        shrink = np.where(full, history / (history + 1) / np.maximum(used, 1e-12), 1.0)
        share, used = share * shrink[first], used * shrink
    covered = np.bincount(first, weights=lower[second], minlength=len(history))
    weights = (1 - used) / np.maximum(1 - covered, 1e-12)
    return Bigrams(pairs, np.log10(share), np.log10(weights))


def cut_off(of_counts: dict[int, int], kept: int) -> int:
    """Smallest count whose n-grams, with all more frequent ones, are at most ``kept``."""
    total, low = 0, max(of_counts, default=0) + 1
    for c in sorted(of_counts, reverse=True):
        total += of_counts[c]
        if total > kept:
            break
        low = c
    return low


def _table(df: DataFrame, key: str, label: str) -> DataFrame:
    """Stored and partitioned by the hash of its key."""
    return stored(df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(TABLE_PARTS))), label)


def _chance(c: Column, lower: Unigrams) -> Column:
    factors = F.array(*[F.lit(float(x)) for x in lower.factors])
    top = len(lower.factors) - 1
    factor = F.when(c <= top, F.element_at(factors, (F.least(c, F.lit(top)) + 1).cast("int"))).otherwise(1.0)
    known = F.lit(float(lower.scale)) * factor * c / F.lit(float(max(lower.total, 1)))
    return F.when(c > 0, known).otherwise(F.lit(float(lower.unknown)))


@dataclass
class Shared:
    """The most frequent words, ascending by key, their counts, and over how many buckets their pairs are dealt."""

    word: np.ndarray
    c: np.ndarray
    spread: np.ndarray
    buckets: int

    def home(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first bucket of each first word, and over how many its pairs are dealt."""
        at, sure = places(self.word, first)
        return first.view(np.uint64) % np.uint64(self.buckets), np.where(sure, self.spread[at], 1).astype(np.uint64)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


#: Bits of a word's number in a block.
PAIR_BITS = 32
BLOCK = "bucket int, places binary, learn binary, firsts binary, pairs_of_first binary, seconds binary, docs_of_pair binary, doc binary, times binary"


def _packed(shared: Shared, words: Vocabulary, place: np.ndarray, learn: np.ndarray, tokens: list[np.ndarray]) -> pa.RecordBatch:
    """The pairs of a block of documents, one row per bucket: each first word once, each pair once, and its documents."""
    first, second = (np.concatenate([t[s] for t in tokens]).astype(np.uint64) for s in (slice(None, -1), slice(1, None)))
    doc = np.repeat(np.arange(len(tokens), dtype=np.uint16), [len(t) - 1 for t in tokens])
    keys = np.array(words.keys_of, np.int64)
    home, spread = shared.home(keys)
    bucket = home[first]
    many = np.flatnonzero(spread[first] > 1)
    bucket[many] = (bucket[many] + keys.view(np.uint64)[second[many]] % spread[first[many]]) % np.uint64(shared.buckets)
    pair = first << np.uint64(PAIR_BITS) | second
    order = np.argsort(pair, kind="stable")  # documents stay in order
    order = order[np.argsort(bucket[order].astype(np.uint32), kind="stable")]
    pair, doc, bucket = pair[order], doc[order], bucket[order].astype(np.int32)
    entry = starts(bucket, pair, doc)
    times = np.diff(np.r_[entry, len(pair)]).astype(np.uint32)
    pair, doc, bucket = pair[entry], doc[entry], bucket[entry]
    columns: list[list] = [[] for _ in range(9)]
    begins = starts(bucket)
    for b, e in zip(begins, np.r_[begins[1:], len(bucket)]):
        own = pair[b:e]
        at = starts(own)
        first, second = own[at] >> np.uint64(PAIR_BITS), own[at] & np.uint64(2**PAIR_BITS - 1)
        one = starts(first)
        used, local = np.unique(doc[b:e], return_inverse=True)
        parts = (
            place[used], learn[used], keys[first[one]], np.diff(np.r_[one, len(at)]).astype(np.uint32), keys[second],
            np.diff(np.r_[at, e - b]).astype(np.uint32), local.astype(np.uint16), times[b:e],
        )
        for column, part in zip(columns, (int(bucket[b]), *[x.tobytes() for x in parts])):
            column.append(part)
    names = ["bucket", "places", "learn", "firsts", "pairs_of_first", "seconds", "docs_of_pair", "doc", "times"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "bucket" else pa.binary()) for n, c in zip(names, columns)], names=names)


def packed_pairs(placed: DataFrame, shared: Broadcast) -> DataFrame:
    """The pairs of all documents (place, text, learn), packed by bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tokens, place, learn, size = Vocabulary(), [], [], [], 0

        def block() -> pa.RecordBatch:
            return _packed(shared.value, words, np.array(place), np.array(learn, np.uint8), tokens)

        for batch in sliced(batches):
            for text, at, own in zip(utf8(batch, "text"), batch.column("place").to_pylist(), batch.column("learn").to_pylist()):
                found = words.tokens(text)
                for begin in range(0, len(found) - 1, HELD_PAIRS):  # a very long text has several entries
                    part = found[begin : begin + HELD_PAIRS + 1]
                    tokens.append(part)
                    place.append(at)
                    learn.append(own)
                    size += len(part)
                    if size >= HELD_PAIRS or len(tokens) >= HELD_DOCS:
                        yield block()
                        tokens, place, learn, size = [], [], [], 0
                if not tokens:
                    words = Vocabulary()
        if tokens:
            yield block()

    return placed.select("place", "text", "learn").mapInArrow(pack, BLOCK)


#: What a bucket passes on: sums of a document, counts of a history, pairs with a rare second word, unseen pairs.
OF_DOC, OF_HISTORY, RARE_SECOND, UNSEEN = range(4)
CLASSES = DISCOUNTED + 1
OUTCOME = "kind int, place long, a long, b long, n long, " + ", ".join(f"c{r} long" for r in range(1, CLASSES + 1)) + ", x double"


def _outcomes(shared: Shared, single: np.ndarray, blocks: list[dict]) -> Iterator[pa.RecordBatch]:
    """Everything about the pairs of one bucket."""

    def of(name: str, kind) -> list[np.ndarray]:
        return [np.frombuffer(b[name], kind) for b in blocks]

    firsts, per_first, seconds, per_pair, docs = of("firsts", np.int64), of("pairs_of_first", np.uint32), of("seconds", np.int64), of("docs_of_pair", np.uint32), of("places", np.int64)
    first, second = np.concatenate([np.repeat(f, n) for f, n in zip(firsts, per_first)]), np.concatenate(seconds)
    before = np.r_[0, np.cumsum([len(x) for x in docs])]
    doc = np.concatenate([d.astype(np.int64) + b for d, b in zip(of("doc", np.uint16), before)])
    place, learn = np.concatenate(docs), np.concatenate(of("learn", np.uint8)).astype(bool)
    times, per_pair = np.concatenate(of("times", np.uint32)).astype(np.int64), np.concatenate(per_pair)

    order = np.lexsort((second, first))
    begins = starts(first[order], second[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(order)]))
    first, second = first[order][begins], second[order][begins]
    own = np.repeat(group, per_pair)  # of each entry
    n = np.bincount(own[learn[doc]], weights=times[learn[doc]], minlength=len(first)).astype(np.int64)

    def rows(kind: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ["place", "a", "b", "n", *[f"c{r}" for r in range(1, CLASSES + 1)]]
        for at in range(0, len(next(iter(columns.values()))), OUTCOME_ROWS):
            some = {c: x[at : at + OUTCOME_ROWS] for c, x in columns.items()}
            size = len(next(iter(some.values())))
            none = np.zeros(size, np.int64)
            arrays = [pa.array(np.full(size, kind, np.int32)), *[pa.array(some.get(c, none)) for c in names], pa.array(some.get("x", none).astype(float))]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", *names, "x"])

    # histories
    seen = n > 0
    f, w, c = first[seen], second[seen], n[seen]
    if len(f):
        at, sure = places(shared.word, w)
        begin = starts(f)
        counted = {f"c{r}": np.add.reduceat((c == r).astype(np.int64), begin) for r in range(1, CLASSES + 1)}
        yield from rows(OF_HISTORY, a=f[begin], n=np.add.reduceat(c, begin), x=np.add.reduceat(np.where(sure, single[at], 0.0), begin), **counted)
        yield from rows(RARE_SECOND, a=f[~sure], b=w[~sure])
    # documents: pairs seen once need no mention in a training row
    count = n[own]
    told = (count > 1) | ((count == 1) & ~learn[doc])
    which, local = np.unique(doc[told], return_inverse=True)
    often, count = times[told], count[told]

    def added(weights: np.ndarray) -> np.ndarray:
        return np.bincount(local, weights=weights, minlength=len(which))

    classes = {f"c{r}": added(often * (count == r)).astype(np.int64) for r in range(1, DISCOUNTED + 1)}
    yield from rows(OF_DOC, place=place[which], n=added(often).astype(np.int64), x=added(often * np.log10(count)), **classes)
    new = n[own] == 0
    yield from rows(UNSEEN, place=place[doc[new]], a=first[own[new]], b=second[own[new]], n=times[new])


def bucket_outcomes(packed: DataFrame, shared: Broadcast, lower: Unigrams) -> DataFrame:
    """The buckets' outcomes, stored by kind."""
    spark = packed.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        words = shared.value
        single = lower.probability(words.c)
        for batch in batches:
            for block in batch.to_pylist():
                if held and block["bucket"] != at:
                    yield from _outcomes(words, single, held)
                    held = []
                at = block["bucket"]
                held.append(block)
        if held:
            yield from _outcomes(words, single, held)

    path = scratch_dir(spark, "katz-outcomes")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "8")  # the few kinds are written side by side, not sorted first
    dealt = packed.repartition(shared.value.buckets, "bucket").sortWithinPartitions("bucket")
    dealt.mapInArrow(run, OUTCOME).write.partitionBy("kind").parquet(path)
    return spark.read.schema(OUTCOME).parquet(path)


def word_table(unigrams: DataFrame, outcomes: DataFrame, lower: Unigrams, factors: np.ndarray) -> DataFrame:
    """``(word, c, single, weight, scale)``: log10 of a word's unigram, of its backoff weight, and of its part in the share of its bigrams.

    A history whose bigrams would use up the mass gives one part in its tokens + 1 back.
    """
    chances = unigrams.select("word", "c", _chance(F.col("c"), lower).alias("chance"))
    far = outcomes.filter(F.col("kind") == RARE_SECOND).select(F.col("a").alias("first"), F.col("b").alias("word"))
    covered = far.join(chances, "word").groupBy("first").agg(F.sum("chance").alias("rare"))
    counted = [f"c{r}" for r in range(1, DISCOUNTED + 1)]
    sums = outcomes.filter(F.col("kind") == OF_HISTORY).groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("h"), F.sum("x").alias("near"), *[F.sum(c).alias(c) for c in counted])
    left = sum((F.col(c) * float(r * (1 - factors[r])) for r, c in enumerate(counted, 1)), F.lit(0.0)) / F.col("h")
    full = sum((F.col(c) for c in counted), F.lit(0)) == 0
    left = F.when(full, 1 / (F.col("h") + 1)).otherwise(left)
    spoken = F.col("near") + F.coalesce("rare", F.lit(0.0))
    histories = sums.join(covered, "first", "left").select(
        F.col("first").alias("word"),
        F.log10(left / F.greatest(1 - spoken, F.lit(1e-12))).alias("weight"),
        F.log10(F.when(full, F.col("h") / (F.col("h") + 1)).otherwise(1.0) / F.col("h")).alias("scale"),
    )
    none = F.lit(0.0)
    return chances.join(histories, "word", "left").select(
        "word", "c", F.log10("chance").alias("single"), F.coalesce("weight", none).alias("weight"), F.coalesce("scale", none).alias("scale")
    )


def _of_words(parts: DataFrame, asked: DataFrame, words: DataFrame, low: int, lower: Unigrams) -> DataFrame:
    """Sums per place of what is asked of words: rare words of the documents, and both words of unseen pairs (frequent ones by broadcast)."""
    none = F.lit(0).cast("long")
    rare = parts.select("place", F.explode("rare").alias("r")).select("place", "r.word", "r.n", "r.first", none.alias("as_history"))
    unseen = asked.select(
        "place", F.explode(F.array(F.struct(F.col("a").alias("word"), none.alias("first"), F.col("n").alias("as_history")), F.struct(F.col("b").alias("word"), F.col("n").alias("first"), none.alias("as_history")))).alias("r")
    ).groupBy("place", "r.word").agg(F.sum("r.first").alias("first"), F.sum("r.as_history").alias("as_history")).select("place", "word", none.alias("n"), "first", "as_history")
    wanted = rare.unionByName(unseen)
    top = F.broadcast(words.filter((F.col("c") >= low) | (F.col("word") == END)))
    others = words.filter((F.col("c") < low) & (F.col("word") != END))
    near, far = wanted.join(top, "word"), wanted.join(F.broadcast(top.select("word")), "word", "left_anti").join(others, "word", "left")
    count, zero = F.coalesce("c", none), F.lit(0.0)
    single = F.coalesce("single", F.log10(F.lit(float(lower.unknown))))
    weight, scale = F.coalesce("weight", zero), F.coalesce("scale", zero)
    of_word = F.col("first") * single + F.col("n") * scale + F.col("as_history") * (weight - scale)
    base = F.col("n") * F.log10((count + 1) / F.lit(float(lower.total + lower.types + 1)))
    told = near.unionByName(far).select("place", F.when(count > 0, F.col("n")).otherwise(none).alias("known"), base.alias("base"), of_word.alias("log10"))
    return told.groupBy("place").agg(*[F.sum(c).alias(f"more_{c}") for c in ("known", "base", "log10")])


def score_text(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    training: Column | None = None,
    shared_words: int = SHARED_WORDS,
    bucket_tokens: int = BUCKET_TOKENS,
) -> DataFrame:
    """The rows of ``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``keep`` names the columns to return besides (all but the text by default). ``training`` marks the rows to learn from.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new and (keep is not None or c != text_col)]
    training = fold(id_col) != HELD_OUT if training is None else training
    plain = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    placed = plain.withColumn("place", F.monotonically_increasing_id())
    if not reads_files_only(docs):  # the rows must have one place in all scans
        placed = stored(placed, "katz-documents")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    context = docs.sparkSession.sparkContext

    unigrams = _table(unigram_counts(placed.filter("learn")), "word", "katz-unigrams")
    of_counts = {r["c"]: (r["n"], r["c"] * r["n"]) for r in unigrams.groupBy("c").agg(F.count("*").alias("n")).collect()}
    lower = fit_unigrams(of_counts)
    low = cut_off({c: n for c, (n, _) in of_counts.items()}, shared_words - 1)
    is_top = (F.col("c") >= low) | (F.col("word") == END)  # shared_words rows at most

    top = unigrams.filter(is_top).select("word", "c").toArrow()
    order = np.argsort(top["word"].to_numpy())
    word, c = (top[name].to_numpy()[order] for name in ("word", "c")) if len(order) else (np.array([END]), np.array([0]))
    buckets = max(FEWEST_BUCKETS, -(-lower.total // bucket_tokens))
    spread = np.minimum(np.maximum(1, 4 * c // max(lower.total // buckets, 1)), buckets)
    shared = context.broadcast(Shared(word, c, spread, buckets))

    outcomes = bucket_outcomes(packed_pairs(placed, shared), shared, lower)
    classes = [f"c{r}" for r in range(1, CLASSES + 1)]
    pair_counts = outcomes.filter(F.col("kind") == OF_HISTORY).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes]).first()
    factors = discounts({r: pair_counts[f"c{r}"] for r in range(1, CLASSES + 1)})
    words = _table(word_table(unigrams, outcomes, lower, factors), "word", "katz-words")
    top = words.filter(is_top).select("word", "scale").toArrow()
    scale = np.zeros(len(word))
    scale[np.searchsorted(word, top["word"].to_numpy())] = top["scale"].to_numpy()
    scales = context.broadcast(scale)

    rare_type = ArrayType(StructType().add("word", "long").add("n", "long").add("first", "long"))
    schema = placed.select("row", "learn", "place").schema
    schema = schema.add("n_tokens", "long").add("n_known", "long").add("base", "double").add("log10", "double").add("rare", rare_type)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scale = shared.value, scales.value
        base, single = lower.base(held.c), np.log10(lower.probability(held.c))
        words = Vocabulary()
        own = np.zeros((5, 0))  # of each word: is shared, is known, base, scale, single
        for batch in sliced(batches):
            if not batch.num_rows:
                continue
            if len(words.keys_of) > KNOWN_WORDS:
                words, own = Vocabulary(), own[:, :0]
            tokens = [words.tokens(text) for text in utf8(batch, "text")]
            sizes = np.array([len(t) for t in tokens])
            keys = np.array(words.keys_of[own.shape[1] :], np.int64)
            at, sure = places(held.word, keys)
            own = np.concatenate([own, np.where(sure, np.stack([sure, held.c[at] > 0, base[at], scale[at], single[at]]), 0.0)], axis=1)
            number, begin = np.concatenate(tokens), np.r_[0, np.cumsum(sizes)[:-1]]
            sums = np.add.reduceat(own[1:4, number], begin, axis=1)
            logs = sums[2] + own[4, number[begin]]
            far = np.flatnonzero(own[0, number] == 0)
            doc = np.repeat(np.arange(len(tokens)), sizes)
            asked, n = np.unique(doc[far] << 32 | number[far], return_counts=True)
            doc, word = asked >> 32, asked & 0xFFFFFFFF
            columns = [np.array(words.keys_of, np.int64)[word], n, (word == number[begin][doc]).astype(np.int64)]
            offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(tokens)))]
            lists = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["word", "n", "first"])
            arrays = [pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(logs), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "learn", "place")], *arrays], names=schema.names)

    parts = stored(placed.select("row", "learn", "place", "text").mapInArrow(score, schema), "katz-parts")
    of_words = _of_words(parts, outcomes.filter(F.col("kind") == UNSEEN), words, low, lower)
    of_pairs = outcomes.filter(F.col("kind") == OF_DOC).groupBy("place").agg(F.sum("n").alias("told"), F.sum("x").alias("logs"), *[F.sum(c).alias(c) for c in classes[:-1]])
    none, zero = F.lit(0.0), F.lit(0).cast("long")
    more = of_words.withColumns({"told": zero, "logs": none, **dict.fromkeys(classes[:-1], zero)}).unionByName(of_pairs.withColumns({"more_known": zero, "more_base": none, "more_log10": none}))
    sums = more.groupBy("place").agg(*[F.sum(c).alias(c) for c in more.columns if c != "place"])
    discounted = sum((F.coalesce(F.col(c), zero) * math.log10(factors[r]) for r, c in enumerate(classes[:-1], 1)), none)
    once = F.when(F.col("learn"), F.col("n_tokens") - 1 - F.coalesce("told", zero)).otherwise(zero) * math.log10(factors[1])
    return parts.drop("rare").join(sums, "place", "left").select(
        *[F.col("row")[c].alias(c) for c in kept],
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(lower.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("log10") + F.coalesce("more_log10", none) + F.coalesce("logs", none) + discounted + once).alias("score"),
    )
