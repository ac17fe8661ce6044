"""Secret scans with a trigram inverted index.

Each rule is a regular expression. From its parsed form a Boolean trigram query is derived: every match
must contain the trigrams of the literals the rule cannot avoid. Documents are indexed in blocks: a block
maps each trigram that any rule asks for to the sorted numbers of its documents. A rule's query intersects
and unites these postings, and only the documents left are searched with the expression. Rules without
mandatory trigrams scan every document. A block's index lives and dies in its task, so nothing is shuffled
and a lost executor costs one block.

Edge cases: a null or empty text has no spans; repeated rows give repeated results; spans count code
points, end exclusive; a column named like a result column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from gaugeflow.llm.common import append_columns, texts

# Names of the settings that hold secrets, in either case.
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``valid`` gets the match; a match that fails it is dropped without another try."""

    kind: str
    pattern: str
    valid: Callable[[re.Match], bool] = lambda m: True
    base: bool = False


# The base rules, in their order, then the further ones. The base lengths are part of the pattern where a
# longest run either has them or has no match inside.
RULES = (
    Rule("assign", "(" + "|".join(map(_either_case, ASSIGN_NAMES)) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:[^\s/@:]{4,}@[A-Za-z0-9.-]+"),
)
BASE_KINDS = tuple(r.kind for r in RULES if r.base)

# A query is True (no condition), a trigram, or ("and" | "or", parts).
MOST_STRINGS = 64


def _joined(op: str, parts: list):
    parts = list(dict.fromkeys(parts))
    if op == "or" and (not parts or True in parts):
        return True
    if op == "and":
        parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _grams(strings: set[str]):
    """Condition that one of ``strings`` occurs."""
    return _joined("or", [_joined("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else True for s in sorted(strings)])


def trigram_query(pattern: str):
    """Boolean trigram query that the ASCII-lower-cased form of every text with a match satisfies."""

    def exact(items) -> list:
        """The items as a list of string sets (all that may stand there) and sub-queries."""
        out: list = []
        for op, arg in items:
            if op is sre.LITERAL:
                out.append({chr(arg).lower() if arg < 128 else chr(arg)})
            elif op is sre.IN:
                chars = [chr(a).lower() for o, a in arg if o is sre.LITERAL and a < 128]
                out.append(set(chars) if len(chars) == len(arg) and len(set(chars)) <= 2 else None)
            elif op is sre.SUBPATTERN:
                out.extend(exact(arg[3]))
            elif op is sre.BRANCH:
                ways = [exact(way) for way in arg[1]]
                if all(all(isinstance(x, set) for x in way) for way in ways):
                    out.append(set().union(*(product(way) for way in ways)))
                else:
                    out.append(_joined("or", [query(way) for way in ways]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                low, high, inner = arg
                own = exact(inner)
                if (low, high) == (0, 1) and all(isinstance(x, set) for x in own):
                    out.append(product(own) | {""})
                else:
                    out.append(query(own) if low else None)
                    if low:
                        out.append(None)
            else:
                out.append(None)
        return out

    def product(sets: list) -> set[str]:
        found = {""}
        for x in sets:
            found = {a + b for a in found for b in x}
        return found

    def query(parts: list):
        found, run = [], {""}
        for part in [*parts, None]:
            if isinstance(part, set) and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a in run for b in part}
                continue
            found.append(_grams(run))
            run = part if isinstance(part, set) else {""}
            if part is not None and not isinstance(part, set):
                found.append(part)
        return _joined("and", found)

    return query(exact(sre_parser.parse(pattern)))


def grams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(grams_of, query[1]))


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


class BlockIndex:
    """Postings of one block of documents for the wanted trigrams."""

    def __init__(self, lowered: list[str], wanted: list[str]):
        self.size = len(lowered)
        self.postings = {g: np.array([i for i, text in enumerate(lowered) if g in text], dtype=np.int64) for g in wanted}

    def matching(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        op, parts = query
        if op == "or":
            return np.unique(np.concatenate([self.matching(p) for p in parts]))
        found = None
        for ids in sorted((self.matching(p) for p in parts), key=len):  # shortest first
            found = ids if found is None else np.intersect1d(found, ids, assume_unique=True)
        return found


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with ``secrets``: spans ordered by start, then by the rules' order."""
    plan = [(rule.kind, rule.pattern, rule.valid, trigram_query(rule.pattern)) for rule in rules]
    wanted = sorted(set().union(*(grams_of(q) for *_, q in plan)))

    def make():
        compiled = [(kind, re.compile(pattern), valid, query) for kind, pattern, valid, query in plan]

        def compute(batch: pa.RecordBatch) -> list:
            rows = texts(batch, text_col)
            index = BlockIndex([ascii_lower(t) for t in rows], wanted)
            found: list[list] = [[] for _ in rows]
            for order, (kind, expression, valid, query) in enumerate(compiled):
                for i in index.matching(query).tolist():
                    found[i].extend((m.start(), order, m.end(), kind) for m in expression.finditer(rows[i]) if valid(m))
            spans = [[{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(own)] for own in found]
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            return [pa.array(spans, kinds)]

        return compute

    kept = list(dict.fromkeys([*(docs.columns if keep is None else keep), text_col]))
    out = append_columns(docs.select(kept), make, [StructField("secrets", SPANS)], kept if keep is None else keep)
    return out


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; overlapping spans are replaced as one."""
    found = find_secrets(docs, text_col, rules)

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            out = []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column("secrets").to_pylist()):
                out.append(text if not spans else cut_out(text, [(s["start"], s["end"]) for s in spans], mark))
            return [pa.array(out, pa.string())]

        return compute

    kept = [c for c in docs.columns if c != "secrets"]
    return append_columns(found, make, [StructField(text_col, StringType())], kept).select(kept)


def cut_out(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    pieces, at = [], 0
    for start, end in spans:
        if end <= at:
            continue
        if start >= at:
            pieces += [text[at:start], mark]
        at = end
    return "".join([*pieces, text[at:]])


def span_text(column, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans, comma-joined in their order."""
    chosen = column if kinds is None else F.filter(column, lambda s: s["kind"].isin(*kinds))
    shown = F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", shown)


def count_kind(column, kind: str):
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast(LongType())


def brute_force(text: str | None) -> tuple:
    """Base results of one text by plain search with the stated patterns; for tests."""
    text = text or ""
    stated = (
        ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    )
    spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(stated) for m in re.finditer(p, text) if ok(m))
    shown = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
    counts = [sum(kind == s[3] for s in spans) for kind in ("assign", "access", "hex")]
    return (*counts, hashlib.sha256(shown.encode()).hexdigest())
