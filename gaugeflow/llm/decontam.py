"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Benchmark texts are cut into windows of ten words (a shorter text is one window). Windows of one
length form a class with its own tables: block shifts say how far the search may jump, buckets keyed
by the last block hold the windows that may end there, and a direct comparison of the words confirms.
The documents pass the tables in one map without a shuffle. A larger benchmark is taken in passes of about
``WINDOWS_PER_PASS`` windows: each reads the documents, stores the hits it found and takes its tables back before the
next one begins, so an executor holds the tables of one pass; the hits are merged in the end.

Edge cases: a null or wordless document has no words and no hits; a null or wordless benchmark text
has no window; a benchmark text without id marks words as hit but is in no id list; equal windows of
several items count for each item; an empty benchmark leaves every document clean; repeated documents
give repeated rows; a column named like a result column is replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from gaugeflow.functions.sizes import broadcast_if_few
from gaugeflow.llm.common import append_columns, reads_files_only, sliced, stored, utf8

WINDOW_WORDS = 10
#: Words per block of the shift tables.
BLOCK_WORDS = 2
#: Windows per pass over the documents, about 30 MB of tables.
WINDOWS_PER_PASS = 100_000

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def fold_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_FOLD).split()


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Distinct ``(words, item)``: the windows of each benchmark text, words joined by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            found, items = [], []
            for item, text in zip(batch.column("item").to_pylist(), utf8(batch, "text")):
                words = fold_words(text)
                pieces = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
                found.extend(p.decode() for p in pieces)
                items.extend([item] * len(pieces))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(items, pa.string())], names=["words", "item"])

    chosen = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, "words string, item string").distinct()


class ShiftTables:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], length: int):
        self.length = length
        self.block = min(BLOCK_WORDS, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
        for words, items in windows.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.buckets[words[length - self.block :]].append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """``(position of the first word, items)`` of every occurrence."""
        length, block, jump, shift = self.length, self.block, self.jump, self.shift
        at, size = length, len(words)
        while at <= size:
            key = tuple(words[at - block : at])
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            start = at - length
            for candidate, items in self.buckets[key]:
                if words[start:at] == candidate:
                    yield start, items
            at += 1


def build_tables(rows: list[tuple[str, str | None]]) -> list[ShiftTables]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for joined, item in rows:
        words = tuple(joined.encode().split(b" "))
        by_length[len(words)][words].extend([item] if item is not None else [])
    return [ShiftTables(windows, length) for length, windows in sorted(by_length.items())]


def _union(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(intervals):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    per_pass: int = WINDOWS_PER_PASS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_hit``, ``hit_items`` (sorted ids) and ``contaminated``.

    ``keep`` names the columns to return besides (all by default). ``per_pass`` bounds the windows whose
    tables an executor holds at once.
    """
    windows = stored(benchmark_windows(benchmark, item_id_col, item_text_col, window), "benchmark-windows")
    passes = max(1, -(-windows.count() // per_pass))
    new = ("n_words", "n_hit", "hit_items", "contaminated")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text"))

    if passes == 1:
        marked = append_columns(rows, _search(_tables(windows, 1, 0)[0]), [SPANS, ITEMS, StructField("n_words", LongType())], ["row"])
    else:
        placed = rows.withColumn("place", F.monotonically_increasing_id())
        if not reads_files_only(docs):  # the rows must have one place in all passes
            placed = stored(placed, "benchmark-documents")
        found = None
        for number in range(passes):
            tables, release = _tables(windows, passes, number)
            hits = append_columns(placed.select("place", "text"), _search(tables), [SPANS, ITEMS, StructField("n_words", LongType())], ["place"])
            hits = stored(hits.filter(F.size(SPANS.name) > 0).select("place", SPANS.name, ITEMS.name), "benchmark-hits")
            release()
            found = hits if found is None else found.unionByName(hits)
        spans, items = F.flatten(F.collect_list(SPANS.name)), F.flatten(F.collect_list(ITEMS.name))  # one entry per pass
        found = stored(found.groupBy("place").agg(spans.alias(SPANS.name), items.alias(ITEMS.name)), "benchmark-found")
        joined = placed.join(broadcast_if_few(found), "place", "left").select("row", "text", SPANS.name, ITEMS.name)
        marked = append_columns(joined, _merged, [SPANS, ITEMS, StructField("n_words", LongType())], ["row"])

    # the covered words are the ends minus the starts of the merged spans
    signed = F.transform(SPANS.name, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    own = [F.col("row")[c].alias(c) for c in kept]
    return marked.select(*own, "n_words", n_hit.alias("n_hit"), F.col(ITEMS.name).alias("hit_items"), (F.size(SPANS.name) > 0).alias("contaminated"))


SPANS = StructField("__hit_words", ArrayType(LongType()))
ITEMS = StructField("__hit_items", ArrayType(StringType()))


def _tables(windows: DataFrame, passes: int, number: int) -> tuple[Broadcast, Callable[[], None]]:
    """The windows of one pass, about ``per_pass`` of them, sent to the executors; and what takes them back."""
    chosen = windows if passes == 1 else windows.filter(F.pmod(F.xxhash64("words"), F.lit(passes)) == number)
    tables = windows.sparkSession.sparkContext.broadcast(sorted((r["words"], r["item"] or "", r["item"]) for r in chosen.collect()))
    return tables, tables.destroy


def _columns(spans: list[list[tuple[int, int]]], items: list, sizes: list[int]) -> list[pa.Array]:
    flat = [[x for pair in _union(found) for x in pair] for found in spans]
    return [pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(sizes, pa.int64())]


def _search(tables: Broadcast) -> Callable[[], Callable]:
    """Spans, items and words of a batch of texts, by the tables of one pass."""

    def make():
        built = build_tables([(words, item) for words, _, item in tables.value])

        def compute(batch: pa.RecordBatch) -> list:
            spans, items, sizes = [], [], []
            for text in utf8(batch, "text"):
                words, found, ids = fold_words(text), [], set()
                for part in built:
                    for start, found_items in part.search(words):
                        found.append((start, start + part.length))
                        ids.update(found_items)
                spans.append(found)
                items.append(ids)
                sizes.append(len(words))
            return _columns(spans, items, sizes)

        return compute

    return make


def _merged() -> Callable:
    """What all passes found, merged; and the number of words."""

    def compute(batch: pa.RecordBatch) -> list:
        spans = [list(zip((x or [])[::2], (x or [])[1::2])) for x in batch.column(SPANS.name).to_pylist()]
        items = [x or [] for x in batch.column(ITEMS.name).to_pylist()]
        return _columns(spans, items, [len(fold_words(text)) for text in utf8(batch, "text")])

    return compute


def items_digest(column: str = "hit_items"):
    return F.sha2(F.concat_ws(",", column), 256)


def brute_force(docs: list[str | None], benchmark: list[tuple[int, str | None]], window: int = WINDOW_WORDS) -> list[tuple]:
    """``(n_words, n_hit, n_items, digest)`` by testing every window at every place; for tests."""
    out = []
    cut = [(item, fold_words((text or "").encode())) for item, text in benchmark]
    for text in docs:
        words, hit, found = fold_words((text or "").encode()), set(), set()
        for item, own in cut:
            size = min(window, len(own))
            for i in range(len(own) - size + 1) if own else ():
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == own[i : i + size]:
                        hit.update(range(j, j + size))
                        found.add(str(item))
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out

