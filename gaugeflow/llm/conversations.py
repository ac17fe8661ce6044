"""Repair of conversation structure: the cheapest edits after which the roles read ``(s?(ua)+)?``.

A Viterbi search over four states (nothing yet, after the system row, after a user row, after an assistant row) takes
one row at a time. Each state keeps one survivor, a leaf of a tree of back pointers; a node without children or survivor is
released. As soon as all survivors share an ancestor, the edits up to it are emitted and forgotten. A survivor that costs
more than another plus the most that their continuations can differ by is let go; without that, the path that deletes
everything would hold the root for ever. Equal costs are settled by the whole unresolved audits, ASCII-least first:
survivors carry the rank of their audit among all survivors, so a comparison takes constant time. Two survivors whose audits
are prefixes of each other have used the same rows and differ in trailing inserts alone, which the rank keeps as a number.

Rows are dealt by conversation and sorted inside the task, which reads them as a stream: memory holds the unresolved
edits, not the conversation. A hash of a conversation's repaired text has to be computed in order, so one
conversation is one stream however long it is. Earlier rows of the same role and text are found beforehand by an
aggregate of digests; only the marks of later ones are sent along.

Edge cases: null role or text is one space; null turns come first; a null ``conv_id`` is a conversation of its own; rows of
one turn are taken by role and digest of their text; repeated rows are duplicates; a role is judged by its first
character, so unknown, empty and blank roles must be changed or deleted; a conversation without rows has zeros, an empty
audit and the hash of the empty text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gaugeflow.llm.common import ROWS_PER_BATCH, sliced

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
REROLED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: ``BEHIND[b][a]``: the most that going on from ``a`` can cost more than going on from ``b``.
BEHIND = {
    START: {SYSTEM: 2 * INSERT, USER: INSERT + DELETE, ASSISTANT: DELETE},
    SYSTEM: {START: 0, USER: INSERT, ASSISTANT: 0},
    USER: {START: INSERT, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: 0, SYSTEM: 2 * INSERT, USER: INSERT},
}
#: What a sorted row is; marks come before their rows.
MARK, PRESENT, DROPPED = range(3)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, own, copy, gone)``: rows dropped, emptied, unpunctuated, repeated or given to the user.

    The kind of damage is ``crc32(conv_id:turn) % 20``. ``own`` is the digest of role and text before it; dropped rows stay as ``gone``.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), space), F.coalesce(F.col(turn_col).cast("string"), space))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role0"), text.alias("text0"), kind.alias("kind"))
    kind = F.col("kind")
    return rows.withColumn("copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role0")).alias("role"),
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit("")).when(kind == 2, F.translate("text0", ".!?", "")).otherwise(F.col("text0")).alias("text"),
        F.struct(F.col("role0").alias("role"), digest("text0").alias("text")).alias("own"),
        "copy",
        (kind == 0).alias("gone"),
    )


def as_given(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of a table as ``repair`` takes them, undamaged."""
    space = F.lit(" ")
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
    return rows.select("*", F.struct("role", digest("text").alias("text")).alias("own"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def later_repeats(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, own, copy)`` of the rows whose role and text an earlier row of the conversation has.

    Equal rows of one place count once here; all but the first of them are repeats too.
    """
    places = rows.filter(~F.col("gone")).select("conv_id", "role", digest("text").alias("said"), F.struct("turn", "own", "copy").alias("place"))
    places = places.distinct()
    again = places.groupBy("conv_id", "role", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    a, b = places.alias("a"), again.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.said") == F.col("b.said"))
    return a.join(b, same & (F.col("a.place") > F.col("b.first"))).select("a.conv_id", "a.place.turn", "a.place.own", "a.place.copy")


class Node:
    """An edit and the edits before it; children and survivors hold it."""

    __slots__ = ("parent", "edit", "kids", "held")

    def __init__(self, parent: Node | None, edit: tuple[str, str, str] | None):
        self.parent, self.edit, self.kids, self.held = parent, edit, set(), 0
        if parent is not None:
            parent.kids.add(self)


class Search:
    """Survivors of one conversation. ``emit`` gets the edits ``(initial, role, text)`` in order, once they are settled."""

    def __init__(self, emit: Callable[[tuple[str, str, str]], None]):
        self.emit = emit
        self.root = Node(None, None)
        self.root.held = 1
        # state: (cost, rank of the audit, trailing inserts beyond the ranked audit, node)
        self.alive = {START: (0, 0, 0, self.root)}
        self._settle(self._with_inserts({START: (0, 0, "", START, ())}))

    def _with_inserts(self, found: dict) -> dict:
        for sources, role, target in (((START, SYSTEM, ASSISTANT), "user", USER), ((USER,), "assistant", ASSISTANT)):
            for source in sources:
                if source in found:
                    cost, rank, tail, old, path = found[source]
                    self._offer(found, target, (cost + INSERT, rank, tail + "I", old, (*path, ("I", role, ""))))
        return found

    @staticmethod
    def _offer(found: dict, state: int, offer: tuple) -> None:
        if state not in found or offer[:3] < found[state][:3]:
            found[state] = offer

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        found: dict = {}
        extra = TRUNCATED if truncated else 0
        initial = role[:1]
        for state, (cost, rank, inserts, _) in self.alive.items():
            tail = "I" * inserts
            self._offer(found, state, (cost + DELETE, rank, tail + "D", state, (("D", "", ""),)))
            if must_go:
                continue
            target = NEXT[state].get(initial)
            if target is not None:
                self._offer(found, target, (cost + KEEP + extra, rank, tail + "K", state, (("K", role, text),)))
            new_role, target = REROLED[state]
            self._offer(found, target, (cost + REROLE + extra, rank, tail + "R", state, (("R", new_role, text),)))
        self._settle(self._with_inserts(found))

    def _settle(self, found: dict) -> None:
        kept = {b: x for b, x in found.items() if not any(a != b and y[0] + BEHIND[b][a] < x[0] for a, y in found.items())}
        ranks, place, base = {}, -1, None
        for rank, tail in sorted({x[1:3] for x in kept.values()}):
            if base is None or rank != base[0] or tail != base[1] + "I" * (len(tail) - len(base[1])):
                base, place = (rank, tail), place + 1
            ranks[rank, tail] = (place, len(tail) - len(base[1]))
        before = [x[3] for x in self.alive.values()]
        nodes = {state: x[3] for state, x in self.alive.items()}
        after = {}
        for state, (cost, rank, tail, old, path) in kept.items():
            node = nodes[old]
            for edit in path:
                node = next((kid for kid in node.kids if kid.edit is edit), None) or Node(node, edit)
            node.held += 1
            after[state] = (cost, *ranks[rank, tail], node)
        self.alive = after
        for node in before:
            node.held -= 1
            while not node.held and not node.kids and node.parent is not None:
                node.parent.kids.discard(node)
                node = node.parent
        while not self.root.held and len(self.root.kids) == 1:
            (self.root,) = self.root.kids
            self.root.parent = None
            self.emit(self.root.edit)

    def finish(self) -> int:
        """Emit what is left; the cost."""
        ends = [(*x[:2], "I" * x[2], x[3]) for state, x in self.alive.items() if state in (START, ASSISTANT)]
        cost, _, _, node = min(ends, key=lambda x: x[:3])
        left = []
        while node is not self.root:
            left.append(node.edit)
            node = node.parent
        for edit in reversed(left):
            self.emit(edit)
        return cost

    def unresolved(self) -> int:
        """Nodes in memory."""
        seen, open_ = 0, [self.root]
        while open_:
            seen += 1
            open_ += open_.pop().kids
        return seen


class Conversation:
    """Counts and repair of one conversation whose rows come in order."""

    def __init__(self, emit: Callable[[tuple[str, str, str]], None]):
        self.search = Search(emit)
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.initial = self.place = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str, place: tuple, repeated: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        said = text.rstrip(BLANKS)
        blank = not said
        duplicate = not blank and (repeated or place == self.place)
        truncated = not blank and not duplicate and said[-1] not in ".!?"
        for name, is_so in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.counts[name] += is_so
        self.counts["illegal"] += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial, self.place = role[:1], place
        self.search.row(role, text, blank or duplicate, truncated)

    def finish(self) -> dict[str, int]:
        self.counts["cost"] = self.search.finish()
        if self.turns:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        return self.counts


class Summary:
    """Audit and hash of what a search emits."""

    def __init__(self):
        self.audit, self.hash, self.any = bytearray(), hashlib.sha256(), False

    def __call__(self, edit: tuple[str, str, str]) -> None:
        initial, role, text = edit
        self.audit += initial.encode()
        if initial != "D":
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True


def _streams(batches: Iterator[pa.RecordBatch], begin: Callable) -> Iterator[tuple | None]:
    """Walk sorted rows: ``begin(id)`` gives a conversation's emit. Yields ``(id, emit, counts)`` of each conversation, and None now and then."""
    current = emit = mark = None
    key = ()
    for batch in sliced(batches):
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "own", "copy", "kind")]
        for conv_id, turn, role, text, own, copy, kind in zip(*columns):
            if key != (conv_id,):
                if current is not None:
                    yield key[0], emit, current.finish()
                key, emit, mark = (conv_id,), begin(conv_id), None
                current = Conversation(emit)
            if kind == DROPPED:
                continue
            place = (turn, own["role"], own["text"], copy)
            if kind == MARK:
                mark = place
            else:
                current.row(turn, role, text, place, place == mark)
        yield None
    if current is not None:
        yield key[0], emit, current.finish()


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows and marks of repeats, a conversation in one task, in order; a mark comes before its row."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    marks = later_repeats(rows).select("conv_id", "turn", F.lit("").alias("role"), F.lit("").alias("text"), "own", "copy", F.lit(MARK).alias("kind"))
    given = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "own", "copy", F.when(F.col("gone"), DROPPED).otherwise(PRESENT).alias("kind"))
    return given.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "own.role", "own.text", "copy", "kind")


def _passed_on(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    types = to_arrow_schema(schema).types
    columns = list(zip(*rows)) or [()] * len(types)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation.

    ``rows`` come from ``damage`` or ``as_given``.
    """
    schema = StructType([rows.schema["conv_id"], *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for done in _streams(batches, lambda conv_id: Summary()):
            if done is None:
                yield _passed_on(found, schema)
            else:
                conv_id, emit, counts = done
                found.append((conv_id, *[counts[c] for c in COUNTS], emit.audit.decode(), emit.hash.hexdigest()))
        yield _passed_on(found, schema)

    return _sorted(rows).mapInArrow(run, schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, position, edit, role, text)``: the rows of the repaired conversations (edits K, R and I), from position 0."""
    schema = StructType([rows.schema["conv_id"], StructField("position", LongType()), *[StructField(c, StringType()) for c in ("edit", "role", "text")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def begin(conv_id) -> Callable[[tuple[str, str, str]], None]:
            position = count()
            return lambda edit: found.append((conv_id, next(position), *edit)) if edit[0] != "D" else None

        for done in _streams(batches, begin):
            if done is None:
                yield _passed_on(found, schema)
        yield _passed_on(found, schema)

    return _sorted(rows).mapInArrow(run, schema)
