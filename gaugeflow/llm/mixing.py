"""Mixing sources to target sizes with the cube method of balanced sampling.

A source's target is its weight's share of the wanted total, at most twice its size; what a full source
cannot take is shared again by weight. Documents are taken whole: every document of a source is repeated
``floor(target / size)`` times and the rest is an inclusion probability. Which documents get the extra
copy is drawn by the cube method: probabilities move along the null space of the balancing equations (words
and documents of the source stay as they are) until they are 0 or 1. The flight runs in blocks of bounded
size in parallel; each leaves at most two documents undecided, these meet in the next round's blocks, and the
last dozen of a source are landed so that its word count is nearest to the target.

Edge cases: a null text has size 0; documents without source form the last source; a source without words
has target 0; repeated rows are documents of their own; ids may be null; reruns give the same rows, as the
draws depend on the contents only; an empty table gives no rows; a column named like a result column is replaced.
"""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField

from gaugeflow.functions.sizes import broadcast_if_few
from gaugeflow.llm.common import append_columns, stored, utf8

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents per block of the flight.
BLOCK_DOCS = 4096
#: Documents that a source's last flight keeps back for the landing, which tries all their combinations.
LANDING_DOCS = 12
NEAR_ZERO = 1e-9


def with_sizes(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``size``: number of words between ASCII white space."""

    def make():
        return lambda batch: [pa.array([len(t.split()) for t in utf8(batch, text_col)], pa.int64())]

    wanted = list(dict.fromkeys([*(docs.columns if keep is None else keep), text_col]))
    return append_columns(docs.select(wanted), make, [StructField("size", LongType())], wanted if keep is None else keep)


def source_targets(sizes: DataFrame, source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``(source, source_number, n_docs, source_size, target)``: one row per source.

    Sources in code point order, null last, get ``weights`` in turn. With the caps divided by the weights in
    ascending order, a source is full if its cap is at most its weight's part of what the earlier, full ones leave.
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("source_number", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(turn, (F.pmod("source_number", F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_number")
    everything = Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (wanted - before) / weights_left)
    # the level rises with every full source and falls after the first open one
    target = F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything))
    return per.withColumn("target", target).select("source", "source_number", "n_docs", "source_size", "target")


def flight(sizes: list[int], chances: list[float], draw: random.Random) -> list[float]:
    """Move the chances to 0 or 1, words and documents balanced; at most two stay between.

    Three undecided documents at a time: their null space is spanned by the cross product of the two
    balancing rows. The step goes either way with the odds that keep every chance's mean.
    """
    state = list(chances)
    held: list[int] = []
    for i, chance in enumerate(state):
        if not NEAR_ZERO < chance < 1 - NEAR_ZERO:
            state[i] = float(round(chance))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (sizes[k] for k in held)
        way = (b - c, c - a, a - b) if (a != b or b != c) else (1, -1, 0)
        up = min((1 - state[k]) / w if w > 0 else state[k] / -w for k, w in zip(held, way) if w)
        down = min(state[k] / w if w > 0 else (1 - state[k]) / -w for k, w in zip(held, way) if w)
        step = up if draw.random() * (up + down) < down else -down
        for k, w in zip(held, way):
            state[k] += step * w
            if state[k] < NEAR_ZERO or state[k] > 1 - NEAR_ZERO:
                state[k] = float(round(state[k]))
        held = [k for k in held if 0 < state[k] < 1]
    return state


def landed(sizes: list[int], chances: list[float]) -> list[float]:
    """The 0/1 values whose words, then documents, come nearest to what the chances say."""
    undecided = [i for i, c in enumerate(chances) if 0 < c < 1]
    if not undecided:
        return chances
    held = np.array([sizes[i] for i in undecided], dtype=np.int64)
    wanted = np.array([chances[i] for i in undecided])
    ways = (np.arange(1 << len(undecided))[:, None] >> np.arange(len(undecided))) & 1
    words_off = np.abs(ways @ held - held @ wanted).round(6)
    best = np.lexsort((np.abs(ways.sum(axis=1) - wanted.sum()).round(6), words_off))[0]
    out = list(chances)
    for i, taken in zip(undecided, ways[best]):
        out[i] = float(taken)
    return out


def _fly(rows: DataFrame, block_docs: int, rounds: int, last: bool) -> DataFrame:
    """One round: rows get a block of their source by hash; ``chance`` is moved inside each block."""
    blocks = F.greatest(F.ceil(F.col("expected") / F.lit(block_docs)), F.lit(1)).cast("long")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("place", F.lit(rounds)), blocks))

    def move(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["place", "size", "chance"], kind="stable").reset_index(drop=True)
        key = f"{rounds}:{block['source_number'].iat[0]}:{block['block'].iat[0]}"
        sizes = block["size"].tolist()
        chances, kept_back = block["chance"].tolist(), LANDING_DOCS if last else 0
        moved = flight(sizes[kept_back:], chances[kept_back:], random.Random(zlib.crc32(key.encode())))
        block["chance"] = landed(sizes, chances[:kept_back] + moved) if last else moved
        return block

    moved = dealt.groupBy("source_number", "block").applyInPandas(move, dealt.schema).drop("block")
    return moved.withColumn("expected", F.ceil(F.col("expected") / F.lit(block_docs)) * 2)


def mix_sources(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    keep: list[str] | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``source_size``, ``target`` (both of the source) and ``taken`` words.

    ``keep`` names the columns to return besides; all but the text by default.
    """
    new = ("size", "source_size", "target", "taken")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new and (keep is not None or c != text_col)]
    plain = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sized = stored(with_sizes(plain, keep=["row", "source"]), "mixing-sizes")
    targets = source_targets(sized, "source", weights, share, most)
    small = broadcast_if_few(targets.withColumnRenamed("source", "of"))
    joined = sized.join(small, F.col("source").eqNullSafe(F.col("of")), "left")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(NEAR_ZERO)).cast("long")
    place = F.xxhash64(F.to_json(F.struct("row")), "size")
    rows = joined.select(
        "row", "size", "source_number", "source_size", "target", whole.alias("whole"),
        F.greatest(ratio - whole, F.lit(0.0)).alias("chance"), place.alias("place"), F.col("n_docs").alias("expected"),
    )

    parts = []
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    for rounds in itertools.count():
        blocks = math.ceil(largest / block_docs)
        moved = _fly(rows, block_docs, rounds, last=blocks <= 1)
        if blocks <= 1:
            parts.append(moved)
            break
        moved = stored(moved, f"mixing-round-{rounds}")
        undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
        parts.append(moved.filter(~undecided))
        rows = moved.filter(undecided)
        largest = blocks * 2
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    taken = (F.col("size") * (F.col("whole") + F.round("chance").cast("long"))).alias("taken")
    return done.select(*[F.col("row")[c].alias(c) for c in kept], "size", "source_size", "target", taken)
