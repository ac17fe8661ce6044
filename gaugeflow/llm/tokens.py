"""Token counts of a byte-level BPE tokenizer by the whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone by the tokenizer's library; those that come
out as exactly their own token are proven. A text is split at special strings and into pre-tokens; a pre-token that is a
proven string counts one, and only the rest are merged, once per distinct string while a task remembers it. A
pre-token's merges don't depend on its neighbours and a pre-token alone is one again, so the counts are the library's.

The split is the library's own pattern in another regular-expression engine. Whether the engines class a character
alike (letter, number, white space, other) is tried once per character and task; a text holding one that they class
differently is split by the library. The tokenizer and the proven strings are broadcast: their size is that of the
vocabulary, not of the data.

Edge cases: a null or empty text has no bytes and no tokens; special strings inside texts count as the library's default
has it (one token); very long texts are cut between words where no pre-token can cross, so a task holds the pre-tokens of
about ``PIECE`` characters; repeated rows count each by itself; a column named like a result column is replaced; an empty
table gives no rows. A tokenizer of another build (normalizer, other pre-tokenizer, special strings that take in white
space) is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField
from tokenizers import Tokenizer

from gaugeflow.llm.common import append_columns, texts

# Fixed value: the pattern by which byte-level tokenizers of this build split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY_FILE = "byte_bpe_50k.json"
LIMIT = 1_024
#: Characters whose pre-tokens are held at once; merged strings remembered by a task, and the longest of them.
PIECE, REMEMBERED, LONGEST = 1_000_000, 500_000, 64

_SPLIT = regex.compile(PATTERN)
_BETWEEN_WORDS = regex.compile(r"(?<=\S) (?=\S)")
_CLASSES = [(regex.compile(p), probe) for p, probe in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"[^\s\p{L}\p{N}]", "!"))]


def checked_tokenizer(file_text: str) -> Tokenizer:
    """The library's tokenizer, if it is of the build that the shortcut is proven for."""
    plan = json.loads(file_text)
    split = plan.get("pre_tokenizer") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in plan.get("added_tokens", []))
    if plan.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or not plain:
        raise ValueError("the whole-token shortcut takes byte-level tokenizers without normalizer and prefix space only")
    tokenizer = Tokenizer.from_str(file_text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """Strings of the vocabulary that, encoded alone, are proven to be one token; special strings are left out."""
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = sorted(tokenizer.get_vocab().values())
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return [s for i, s, e in zip(ids, strings, encoded) if e.ids == [i] and s not in special and _SPLIT.fullmatch(s)]


class TokenCounter(dict):
    """Tokens of each pre-token; as a function, of a text."""

    def __init__(self, tokenizer: Tokenizer, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.tokenizer, self.whole = tokenizer, whole
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=lambda s: (-len(s), s))
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.same, self.odd = set(), set()

    def merged(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.whole) + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n

    def _classed_alike(self, char: str) -> bool:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return all((kind.fullmatch(char) is not None) == (len(split(probe + char)) == 1) for kind, probe in _CLASSES)

    def splits_alike(self, text: str) -> bool:
        """Whether both engines class every character of the text alike."""
        chars = set(text)
        for char in chars - self.same - self.odd:
            (self.same if self._classed_alike(char) else self.odd).add(char)
        return self.odd.isdisjoint(chars)

    def of_plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not self.splits_alike(text):
            return self.merged(text)
        n, begin = 0, 0
        while len(text) - begin > PIECE:
            cut = _BETWEEN_WORDS.search(text, begin + PIECE)
            if cut is None:
                break
            n += sum(map(self.__getitem__, _SPLIT.findall(text, begin, cut.start())))
            begin = cut.start()
        return n + sum(map(self.__getitem__, _SPLIT.findall(text, begin)))

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.of_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.of_plain, parts))


def file_text(docs: DataFrame, path: str) -> str:
    """The tokenizer file, read by the driver: as a local file, or by Spark where the path names another store."""
    if "://" in path:
        return docs.sparkSession.read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as file:
        return file.read()


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path``: the tokenizer's file; ``keep``: the columns to return besides (all by default).
    """
    plan = file_text(docs, path)
    whole = whole_tokens(checked_tokenizer(plan))
    shared = docs.sparkSession.sparkContext.broadcast((plan, whole))

    def make():
        plan, whole = shared.value
        count = TokenCounter(checked_tokenizer(plan), whole)

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(map(count, texts(batch, "__text")), pa.int64())]

        return columns

    names = docs.columns if keep is None else keep
    names = [c for c in names if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(F.struct(*names).alias("row"), F.col(text_col).alias("__text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = append_columns(rows, make, [StructField("n_tokens", LongType())], keep=["row", "n_bytes"])
    over = (F.col("n_tokens") > limit).cast(BooleanType()).alias("over_limit")
    return counted.select(*[F.col("row")[c].alias(c) for c in names], "n_bytes", "n_tokens", over)
