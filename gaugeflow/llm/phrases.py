"""Substring dedup: passages of ``WINDOW`` words that recur are removed wherever they stand.

1. Every document's windows choose an anchor each, the twelve-word phrase of smallest hash inside them. Windows with
   the same words choose the same phrase at the same place, so only documents that share an anchor can share a window.
   Anchors are counted by hash over all documents; documents with the same words count as one.
2. Around each recurring anchor the document's passage (all windows with that anchor) goes to the anchor's shard;
   equal passages of a batch go once, with their number. Crowded anchors are split: each of their windows goes to a
   shard of its own hash.
3. A shard confirms the recurring windows by their words and compiles an Aho-Corasick automaton of phrases of
   eighteen words laid end to end along the recurring passages, so every recurring window holds one. All passages
   of the shard stream through it; the windows around a hit are compared with the confirmed ones.
4. The places found go back to the documents and the covered words are removed.

A document with the words of another one is covered as a whole if it has a window at all.

Edge cases: null, empty and short texts have no window and stay whole; a window that recurs inside one document
counts; repeated rows are copies of one another; ids may be null; a column named like a result column is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from gaugeflow.llm.common import append_columns, reads_files_only, sliced, stored, utf8

WINDOW = 35
ANCHOR = 12
#: Two chunks less one word fit in a window, so a window on a passage holds a whole one.
CHUNK = (WINDOW + 1) // 2
SHARD_PASSAGES = 4_000
#: Documents that share an anchor, from which on its windows are dealt out one by one.
CROWDED = SHARD_PASSAGES // 2
KNOWN_WORDS = 300_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def phrase_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (at most as many as there are), put together from runs of powers of two."""
    with np.errstate(over="ignore"):
        run, length, scale = words * _STEP + np.uint64(1), 1, _STEP
        whole, have = None, 0
        while True:
            if size & length:
                n = len(words) - have - length + 1
                whole = run if whole is None else whole[:n] * scale + run[have : have + n]
                have += length
            if 2 * length > size:
                break
            n = len(words) - 2 * length + 1
            run = run[:n] * scale + run[length : length + n]
            scale, length = scale * scale, 2 * length
        whole = (whole ^ (whole >> np.uint64(29))) * _MIX
        return whole ^ (whole >> np.uint64(32))


def anchor_runs(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """``(hash, first window, last window)`` of each anchor, from the word hashes of a document."""
    if len(hashes) < window:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    phrases = phrase_hashes(hashes, anchor)
    seen = np.lib.stride_tricks.sliding_window_view(phrases, window - anchor + 1)
    chosen = seen.argmin(axis=1) + np.arange(len(seen))
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:] - 1, len(chosen) - 1]
    return phrases[chosen[first]], first, last


def _word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


ANCHORS = ArrayType(LongType())


def _outlines(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per document its number of words, the digest of its words and its anchors in order."""

    def make():
        known = WordHashes()

        def compute(batch: pa.RecordBatch) -> list:
            sizes, digests, anchors = [], [], []
            for text in utf8(batch, "text"):
                words = text.split()
                sizes.append(len(words))
                digests.append(digest(words))
                anchors.append(anchor_runs(_word_hashes(words, known), window, anchor)[0].view(np.int64) if len(words) >= window else [])
            return [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(anchors, pa.list_(pa.int64()))]

        return compute

    fields = [StructField("n_words", LongType()), StructField("digest", StringType()), StructField("anchors", ANCHORS)]
    return append_columns(docs, make, fields, ["row", "place"])


PASSAGE = StructType(
    [
        StructField("place", LongType()),
        StructField("text", StringType()),
        StructField("passages", ArrayType(StructType([StructField("passage", LongType()), StructField("start", IntegerType())]))),
        StructField("shard", LongType()),
        StructField("passage", LongType()),
        StructField("words", StringType()),
        StructField("n", LongType()),
    ]
)


def _passages(docs: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    """From ``(place, text, wanted)``: rows of documents with their passages' hashes, and rows of passages with their words.

    ``wanted`` holds twice the number of each recurring anchor, plus one if it is crowded.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in sliced(batches, 500):
            places, found, seen = batch.column("place").to_pylist(), [], {}
            for text, wanted in zip(utf8(batch, "text"), batch.column("wanted").to_pylist()):
                words = text.split()
                phrases, first, last = anchor_runs(_word_hashes(words, known), window, anchor)
                own = []
                for code in sorted(wanted):
                    number, crowded = divmod(code, 2)
                    low, high = int(first[number]), int(last[number])
                    spans = [(s, s) for s in range(low, high + 1)] if crowded else [(low, high)]
                    for a, b in spans:
                        piece = b" ".join(words[a : b + window])
                        key = xxhash.xxh64_intdigest(piece) - (1 << 63)
                        shard = (key if crowded else int(phrases[number])) % shards
                        own.append({"passage": key, "start": a})
                        seen[shard, key] = (piece, seen.get((shard, key), (b"", 0))[1] + 1)
                found.append(own)
            n, m = len(places), len(seen)
            keys = list(seen)
            columns = [
                pa.array([*places, *[None] * m], pa.int64()),
                pa.array([*batch.column("text").to_pylist(), *[None] * m], pa.string()),
                pa.array([*found, *[None] * m], pa.list_(pa.struct([("passage", pa.int64()), ("start", pa.int32())]))),
                pa.array([*[None] * n, *[k[0] for k in keys]], pa.int64()),
                pa.array([*[None] * n, *[k[1] for k in keys]], pa.int64()),
                pa.array([*[None] * n, *[seen[k][0].decode() for k in keys]], pa.string()),
                pa.array([*[None] * n, *[seen[k][1] for k in keys]], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=PASSAGE.names)

    return docs.mapInArrow(cut, PASSAGE)


def word_ends(passage: str) -> np.ndarray:
    """Offset after each word."""
    return np.cumsum([len(w) + 1 for w in passage.split(" ")]) - 1


def window_at(passage: str, ends: np.ndarray, start: int, window: int) -> str:
    return passage[ends[start - 1] + 1 if start else 0 : ends[start + window - 1]]


class ShardAutomaton:
    """The recurring windows of a shard's passages and an automaton that locates them."""

    def __init__(self, passages: dict[str, int], window: int = WINDOW):
        self.window, self.chunk = window, (window + 1) // 2
        counts: Counter[str] = Counter()
        first: dict[str, str] = {}
        for passage, n in passages.items():
            ends = word_ends(passage)
            for start in range(len(ends) - window + 1):
                text = window_at(passage, ends, start, window)
                counts[text] += n
                first.setdefault(text, passage)
        self.recurring = {text for text, n in counts.items() if n > 1}
        self.automaton = ahocorasick.Automaton()
        for passage in dict.fromkeys(first[text] for text in self.recurring):
            for phrase in self.phrases(passage):
                self.automaton.add_word(phrase, True)
        if len(self.automaton):
            self.automaton.make_automaton()

    def phrases(self, passage: str) -> Iterator[str]:
        """Chunks laid end to end along each run of recurring windows."""
        ends = word_ends(passage)
        flags = [window_at(passage, ends, s, self.window) in self.recurring for s in range(len(ends) - self.window + 1)]
        at = 0
        while at < len(flags):
            if not flags[at]:
                at += 1
                continue
            stop = at
            while stop < len(flags) and flags[stop]:
                stop += 1
            for start in range(at, stop - 1 + self.window - self.chunk + 1, self.chunk):
                yield f" {window_at(passage, ends, start, self.chunk)} "
            at = stop

    def covered(self, passage: str) -> list[tuple[int, int]]:
        """Word ranges, end exclusive, covered by the recurring windows found in the passage."""
        if not len(self.automaton):
            return []
        ends = word_ends(passage)
        windows, found = len(ends) - self.window + 1, set()
        for at, _ in self.automaton.iter(f" {passage} "):
            last = int(np.searchsorted(ends, at - 1))  # the chunk's last word; the text is one character to the right
            start = last - self.chunk + 1
            for s in range(max(0, start + self.chunk - self.window), min(start, windows - 1) + 1):
                if s not in found and window_at(passage, ends, s, self.window) in self.recurring:
                    found.add(s)
        return merged((s, s + self.window) for s in found)


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _located(window: int):
    """For rows sorted by shard: the covered ranges of each passage, as a flat list."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(held: dict[str, int], keys: dict[str, int]) -> pa.RecordBatch:
            shard = ShardAutomaton(held, window)
            ranges = {keys[p]: [x for pair in shard.covered(p) for x in pair] for p in held}
            ranges = {k: r for k, r in ranges.items() if r}
            return pa.RecordBatch.from_arrays([pa.array(list(ranges), pa.int64()), pa.array(list(ranges.values()), pa.list_(pa.int32()))], names=["passage", "ranges"])

        current, held, keys = None, {}, {}
        for batch in batches:
            for shard, key, words, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "passage", "words", "n"))):
                if shard != current and held:
                    yield results(held, keys)
                    held, keys = {}, {}
                current, keys[words] = shard, key
                held[words] = held.get(words, 0) + n
        if held:
            yield results(held, keys)

    return locate


def remove_repeats(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, anchor: int = ANCHOR, shard_passages: int = SHARD_PASSAGES, crowded: int = CROWDED
) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_removed``, ``kept_text`` (null: nothing removed, the text as it is) and ``kept_sha256``.

    ``keep`` names the columns to return besides; all but the text by default. ``kept_text`` joins the kept words by a space.
    """
    new = ("n_words", "n_removed", "kept_text", "kept_sha256")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new and (keep is not None or c != text_col)]
    plain = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text")).withColumn("place", F.monotonically_increasing_id())
    if not reads_files_only(docs):  # the rows must have one place in both readings
        plain = stored(plain, "phrases-documents")
    outlines = stored(_outlines(plain, window, anchor), "phrases-outlines")

    copies = outlines.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    copies = stored(copies, "phrases-copies")
    own = outlines.select("place", "digest", "anchors").join(copies, "digest").filter(F.col("place") == F.col("first"))
    spread = own.select("place", F.posexplode("anchors").alias("number", "anchor"))
    # stored, so that the join below reads two plain shuffles, whose crowded parts Spark splits
    common = stored(spread.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "phrases-common")
    code = (F.col("number") * 2 + (F.col("n") > crowded).cast("int")).alias("code")
    wanted = stored(spread.join(common, "anchor").select("place", code).groupBy("place").agg(F.collect_list("code").alias("wanted")), "phrases-anchors")
    total = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    shards = max(1, -(-total // shard_passages))

    cut = stored(_passages(plain.select("place", "text").join(wanted, "place"), shards, window, anchor), "phrases-passages")
    passages = cut.filter(F.col("shard").isNotNull()).select("shard", "passage", "words", "n")
    dealt = passages.repartition("shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(_located(window), "passage long, ranges array<int>")  # one row a passage: equal words share anchor and shard
    held = cut.filter(F.col("shard").isNull())
    places = held.select("place", F.explode("passages").alias("p")).select("place", "p.passage", "p.start").join(found, "passage")
    covers = places.groupBy("place").agg(F.flatten(F.collect_list(F.transform("ranges", lambda x: x + F.col("start")))).alias("covers"))

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            removed, texts, digests = [], [], []
            for text, flat in zip(utf8(batch, "text"), batch.column("covers").to_pylist()):
                words, left, at, gone = text.split(), [], 0, 0
                for start, end in merged(zip(flat[::2], flat[1::2])):
                    left += words[at:start]
                    at, gone = end, gone + end - start
                left += words[at:]
                removed.append(gone)
                texts.append(b" ".join(left).decode())
                digests.append(digest(left))
            return [pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.string())]

        return compute

    fields = [StructField("cut_words", LongType()), StructField("cut_text", StringType()), StructField("cut_digest", StringType())]
    changed = append_columns(held.select("place", "text").join(covers, "place"), make, fields, ["place"])
    twice = F.coalesce(F.col("copies") > 1, F.lit(False))
    every = outlines.select("row", "place", "n_words", "digest").join(copies.select("digest", "copies"), "digest", "left").join(changed, "place", "left")
    return every.select(
        *[F.col("row")[c].alias(c) for c in kept],
        "n_words",
        F.when(twice, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).alias("n_removed"),
        F.when(twice, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text"),
        F.when(twice, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_digest", "digest")).alias("kept_sha256"),
    )


def brute_force(docs: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """``(words, removed, digest of the rest)`` by counting every window; for tests."""
    words = [(t or "").encode().split() for t in docs]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), digest([x for i, x in enumerate(w) if i not in gone])))
    return out
