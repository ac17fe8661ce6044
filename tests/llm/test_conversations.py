import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from gaugeflow.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least (cost, audit) from each row and state on, by trying every edit."""

    @lru_cache(None)
    def rest(i, state, inserts):
        found = []
        if i == len(rows):
            if state in "0a":
                found.append((0, ""))
        else:
            initial, must_go, more = rows[i]
            cost, audit = rest(i + 1, state, 0)
            found.append((cost + 3, "D" + audit))
            wanted = {"0": "su", "s": "u", "u": "a", "a": "u"}[state]
            if not must_go and initial and initial in wanted:
                cost, audit = rest(i + 1, initial, 0)
                found.append((cost + more, "K" + audit))
            if not must_go:
                cost, audit = rest(i + 1, wanted[-1], 0)
                found.append((cost + 2 + more, "R" + audit))
        if inserts < 3:
            cost, audit = rest(i, {"0": "u", "s": "u", "u": "a", "a": "u"}[state], inserts + 1)
            found.append((cost + 2, "I" + audit))
        return min(found, default=(10**9, ""))

    return rest(0, "0", 0)


def applied(rows, audit):
    """The repaired lines."""
    lines, waiting = [], list(rows)
    for edit in audit:
        last = lines[-1][0][0] if lines else ""
        turn = "assistant" if last == "u" else "user"
        if edit == "I":
            lines.append((turn, ""))
            continue
        role, text = waiting.pop(0)
        if edit != "D":
            lines.append((role if edit == "K" else turn, text))
    return "\n".join(f"{r}:{t}" for r, t in lines)


def repaired(rows):
    """Expected row of one conversation from its rows (turn, role, text) in order."""
    seen, flags = set(), []
    for _, role, text in rows:
        said = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        flags.append(fault)
    cost, audit = cheapest(tuple((r[:1], f in ("blank", "duplicate"), int(f == "truncated")) for (_, r, _), f in zip(rows, flags)))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = applied([(r, t) for _, r, t in rows], audit)
    return (gaps, flags.count("blank"), flags.count("duplicate"), flags.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)


def damaged(conv_id, rows):
    out = []
    for turn, role, text in in_order(rows):
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def drawn(n, longest, seed):
    draw = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "ärzte"]
    texts = ["Yes.", "No!", "Why?", "so", "", " \n", None, "a. b", "ends. ", "ü."]
    return {c: [(draw.choice([t, t, t, t + 1, None]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"Text {draw.random()}.") for t in range(draw.randint(1, longest))] for c in [*range(n), None]}


@pytest.mark.parametrize("damage", [True, False])
def test_against_every_edit(spark, damage):
    given = drawn(150, 14, 5)
    rows = [(c, *r) for c, of in given.items() for r in of]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS audit", "1 AS own").repartition(3)
    taken = conversations.damage(table) if damage else conversations.as_given(table)
    found = {r[0]: tuple(r)[1:] for r in conversations.repair(taken).collect()}
    expected = {c: repaired(damaged(c, of) if damage else in_order(of)) for c, of in given.items()}
    assert found == expected
    assert {a for r in expected.values() for a in r[6]} == set("KRDI")


def test_repaired_rows_are_what_was_hashed(spark):
    table = spark.createDataFrame([(c, *r) for c, of in drawn(40, 9, 8).items() for r in of], SCHEMA)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repair(conversations.as_given(table)).collect()}
    rows = {}
    for r in conversations.repaired_rows(conversations.as_given(table)).orderBy("position").collect():
        rows.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert hashes == {c: hashlib.sha256("\n".join(rows.get(c, [])).encode()).hexdigest() for c in hashes}


def test_a_long_conversation_holds_little_and_ties_come_out(spark):
    draw, edits, most = random.Random(1), [], 0
    search = conversations.Search(edits.append)
    rows = [("user", "assistant")[(i + (draw.random() < 0.2)) % 2] for i in range(6_000)]
    for i, role in enumerate(rows):
        search.row(role, f"{i}.", draw.random() < 0.05, False)
        most = max(most, search.unresolved())
    search.finish()
    assert most < 60 and len(edits) >= len(rows)
    tied = tuple((r, False, 0) for r in "aauuaauussuuaa" * 3)
    edits = []
    search = conversations.Search(edits.append)
    for role, _, _ in tied:
        search.row(role, "x.", False, False)
    assert (search.finish(), "".join(e[0] for e in edits)) == cheapest(tied)


def test_hot_conversation_and_repeats(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "Hello." if i % 3 else f"Row {i}.") for i in range(3_000)] + [(2, 0, "user", "Hello.")] * 50
    found = {r["conv_id"]: r for r in conversations.repair(conversations.as_given(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert found[1]["duplicate"] == 1_998 and found[2]["duplicate"] == 49
    assert (found[2]["audit"], found[2]["cost"]) == ("K" + "D" * 49 + "I", 2 + 49 * 3)


def test_empty_table(spark):
    assert conversations.repair(conversations.damage(spark.createDataFrame([], SCHEMA))).count() == 0
