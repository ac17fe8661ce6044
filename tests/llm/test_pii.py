import hashlib
import re

from pyspark.sql import functions as F

from gaugeflow.llm import pii

# The stated base patterns.
STATED = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in STATED for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    "mail a.b+c@x-y.example.org, then b@c or c@d. and a@b.c%d@e.f",
    "hosts 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4012888888881881 12345",
    "call +1 (555) 123-4567 or +49 30 1234567, +1 2 or +" + "9" * 30,
    "\U0001f600 ä@b.de é x@y.zz",
    "call 555-123-4567 now, SSN 123-45-6789, IBAN DE89370400440532013000, joe (at) site (dot) com",
    "1 " * 20 + "9" * 20_000,
    "x" * 20_000 + "@",
    "+1" + " " * 5_000,
    "a" * 50 + "@" + "c." * 5_000 + "d",
    "",
    None,
]


def documents(spark):
    rows = [(i, t, "own") for i, t in enumerate([*TEXTS, TEXTS[0]])]
    return spark.createDataFrame(rows, "doc_id long, text string, pii string")


def test_base_spans_match_the_stated_patterns(spark):
    rows = pii.find_pii(documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 1
    for row in rows:
        found = [(s["kind"], s["start"], s["end"]) for s in row["pii"] if s["kind"] in pii.BASE_KINDS]
        assert found == base(row["text"]), (row["text"] or "")[:40]


def test_digest_and_counts(spark):
    found = pii.find_pii(documents(spark), keep=["doc_id", "text"])
    shown = found.select("text", pii.count_kind(F.col("pii"), "ip").alias("n"), F.sha2(pii.span_text(pii.base_spans(F.col("pii"))), 256).alias("h"))
    for row in shown.collect():
        spans = base(row["text"])
        assert row["n"] == sum(k == "ip" for k, *_ in spans)
        assert row["h"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_main_path_has_no_python(spark):
    plan = pii.find_pii(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table_and_redaction(spark):
    assert pii.find_pii(documents(spark).limit(0)).count() == 0
    rows = pii.redact_pii(spark.createDataFrame([(1, "at 10.0.0.1 now"), (2, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: "at xxxxxxxx now", 2: None}


def test_boosted_trees_learn_a_rule_of_two_features():
    counts = []
    for kind in range(4):
        for digits in range(5):
            for half in (0, 1):
                right = 100 if (kind == 2 and digits >= 2) or (kind == 1 and digits < 2) else 0
                counts.append(((kind, digits, 0, 0, 0, 0), half, 100, right))
    model = pii.fit(counts)
    for features, _, _, right in counts:
        assert (model.score(features) >= model.threshold) == (right == 100)
    assert pii.fit([]).trees == () and pii.fit([]).threshold == float("inf")


def test_spans_without_adjacent_digits_or_lower_case_at(spark):
    rows = ["pay 4 1 1 1-1 1 1 1-1 1 1 1-1 1 1 1 now", "4 1-1 1", "NAME [AT] HOST [DOT] COM", "joe (at) site (dot) com"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string")
    found = {r["doc_id"]: r["pii"] for r in pii.find_pii(docs).collect()}
    for i, text in enumerate(rows):
        assert [tuple(s) for s in found[i] if s["kind"] in pii.BASE_KINDS] == base(text)
    assert [s["kind"] for s in found[0]][:1] == ["card"]
    spans = {r["doc_id"]: [(c["kind"], c["start"], c["end"]) for c in r["candidates"]] for r in pii.with_candidates(docs).collect()}
    assert spans[2] == [("mail_words", 0, len(rows[2]))] and spans[3] == [("mail_words", 0, len(rows[3]))]


def test_many_spans_in_one_text(spark):
    import time

    for n in (300, 100_000):
        text = " ".join(f"u{i}@example.org" for i in range(n)) + " 010.1.2.3 +1 (555) 123 4567"
        docs = spark.createDataFrame([(1, text), (2, "a@b.c")], "doc_id long, text string")
        began = time.time()
        found = {r["doc_id"]: r["pii"] for r in pii.find_pii(docs, keep=["doc_id"]).collect()}
        assert time.time() - began < 200
        assert len(found[1]) >= n + 2 and [found[1][i]["start"] for i in (0, n - 1)] == [0, text.index(f"u{n - 1}@")]
        assert all(text[s["start"] : s["end"]].endswith("@example.org") for s in found[1][:n:97])
