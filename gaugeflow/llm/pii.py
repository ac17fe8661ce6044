"""Personal data in texts by candidate gradient boosting, in DataFrame expressions only.

High-recall patterns propose spans that may overlap. Each candidate has a few small integer features of its
format and of the text around it. Their joint counts, with labels from checks that a pattern cannot express
(check digits, number ranges), form one aggregate whose size is bounded by the number of feature values.
Trees of depth two are boosted on that table and become one SQL expression; the threshold is the lowest score
whose precision on the half of the documents left out of the fit is high enough. The stated base spans always
stay, the model adds candidates. Nothing is shuffled but the counts: spans live in an array of their row.

Positions come from the pieces between matches: pieces and matches alternate, so their lengths add up.

Edge cases: a null or empty text has no spans; spans count code points, end exclusive; an empty table or one
without candidates fits no tree and adds nothing; repeated rows give repeated results; very long digit runs are
matched without backtracking; a column named like a result column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,label:boolean,features:array<int>>>"
#: Wanted share of right candidates above the threshold.
PRECISION = 0.95
ROUNDS = 20
RATE = 0.4
CONTEXT_CHARS = 24
#: Matches of a text beyond which its positions are added up by chunks.
LONG_LIST = 256
# Words that often come before personal data.
CONTEXT_WORDS = r"mail|tel|phone|call|fax|mobil|card|visa|ip|host|addr|iban|konto|account|ssn|contact"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _has_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda found: F.length(_digits(found)).between(low, high)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit text is right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(doubled, F.lit(0), lambda total, v: total + v) % 10 == 0


def _is_card(found: Column) -> Column:
    return F.when(_has_digits(16, 19)(found), luhn(_digits(found))).otherwise(F.lit(False))


def _is_ip(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda part: part.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))


def _is_iban(found: Column) -> Column:
    plain = F.translate(found, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(c == "", -1).when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(codes, F.lit(0), lambda r, v: F.when(v < 0, r).when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97).cast("int"))
    return rest == 1


@dataclass(frozen=True)
class Generator:
    """``label``: the check on a match; for a base kind it decides the base spans. ``needs``: text every match has, ``holds``: a pattern in every match."""

    kind: str
    pattern: str
    label: Callable[[Column], Column]
    base: bool = False
    needs: str | None = None
    holds: str = "[0-9]{2}"


# The base kinds in their order. Quantifiers are possessive where nothing follows that could need the text
# back, so that a match is the same and long runs need no stack; an address starts where its run of characters does.
GENERATORS = (
    Generator("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda f: F.lit(True), True, "@"),
    Generator("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _is_ip, True, "."),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", _is_card, True, holds=r"[0-9][\x20-]?[0-9]"),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _has_digits(8, 15), True, "+"),
    Generator("mail_words", r"[A-Za-z0-9._-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++", lambda f: f.rlike("[a-z]{2,}$"), holds=r"[\[(](?:at|AT)[\])]"),
    Generator("phone_plain", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])", _has_digits(9, 12)),
    Generator("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda f: ~f.rlike("^(000|666|9)|-00-|0000$"), needs="-"),
    Generator("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])", _is_iban),
)
BASE_KINDS = tuple(g.kind for g in GENERATORS if g.base)
#: Number of values of each feature: kind, digits, separators, character before, character after, context word.
FEATURE_VALUES = (len(GENERATORS), 5, 3, 3, 3, 2)


def _bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    out = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        out = F.when(value < bounds[i], i).otherwise(out)
    return out


def _neighbour(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"[\p{L}0-9]"), 1).otherwise(2)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What ``add`` makes of all earlier values, for each of an array of whole numbers.

    A fold that appends to an array copies it every time. The array is cut into chunks of about the root of its length, so
    that what is copied stays near the length of the array times its root.
    """
    none = F.array().cast("array<int>")

    def fold(part: Column) -> Column:
        state = F.struct(start.alias("at"), none.alias("all"))
        step = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.array_append(s["all"], s["at"]).alias("all"))
        return F.aggregate(part, state, step, lambda s: s["all"])

    def by_chunks(given: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(given))).cast("int"), F.lit(1))
        chunks = F.transform(F.sequence(F.lit(1), F.size(given), size), lambda at: F.slice(given, at, size))
        return _once(chunks, lambda parts: F.flatten(F.zip_with(fold(F.transform(parts, lambda part: F.aggregate(part, start, add))), parts, lambda before, part: F.transform(fold(part), lambda x: add(before, x)))))

    return _once(values, lambda given: F.when(F.size(given) > LONG_LIST, by_chunks(given)).otherwise(fold(given)))


def candidate_spans(text: Column, generator: Generator) -> Column:
    """Array of the generator's spans in their order, with features; failing base matches without a model's use are left out."""
    gaps = F.split(text, generator.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(generator.pattern), F.lit(0))
    after = F.slice(gaps, F.lit(2), F.size(gaps))
    pieces = F.zip_with(
        F.zip_with(gaps, found, lambda g, f: F.struct(g.alias("gap"), f.alias("found"))), after, lambda p, n: F.struct(p["gap"].alias("gap"), p["found"].alias("found"), n.alias("next"))
    )
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: F.length(g) + F.length(f))
    pieces = F.zip_with(pieces, _before(lengths, F.lit(0), lambda total, x: total + x), lambda p, at: F.struct(p["gap"].alias("gap"), p["found"].alias("found"), p["next"].alias("next"), at.alias("at")))

    def span(piece: Column) -> Column:
        match = piece["found"]
        start = piece["at"] + F.length(piece["gap"])
        end = start + F.length(match)
        label = generator.label(match)
        before = F.right(piece["gap"], F.lit(CONTEXT_CHARS))
        features = F.array(
            F.lit(GENERATORS.index(generator)),
            _bucket(F.length(_digits(match)), (8, 12, 16, 20)),
            _bucket(F.length(F.regexp_replace(match, r"[A-Za-z0-9]", "")), (1, 4)),
            _neighbour(F.right(piece["gap"], F.lit(1))),
            _neighbour(F.left(F.coalesce(piece["next"], F.lit("")), F.lit(1))),
            F.lower(before).rlike(CONTEXT_WORDS).cast("int"),
        )
        base = label if generator.base else F.lit(False)
        return F.struct(
            F.lit(generator.kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), base.alias("base"), label.alias("label"), features.alias("features")
        )

    def wanted(piece: Column) -> Column:
        if generator.kind == "card":  # short runs of digits are no candidates
            return piece["found"].isNotNull() & (F.length(_digits(piece["found"])) >= 12)
        return piece["found"].isNotNull()

    empty = F.array().cast(SPAN)
    spans = F.transform(F.filter(pieces, wanted), span).cast(SPAN)
    possible = text.rlike(generator.holds) if generator.needs is None else F.contains(text, F.lit(generator.needs))
    return F.when(possible, spans).otherwise(empty)


def with_candidates(docs: DataFrame, text_col: str = "text", name: str = "candidates") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(name, F.concat(*[candidate_spans(text, g) for g in GENERATORS]))


def feature_counts(candidates: DataFrame) -> list[tuple[tuple[int, ...], int, int, int]]:
    """``(features, half, rows, right ones)``: at most two rows per combination of feature values."""
    one = candidates.select(F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"), F.explode("candidates").alias("c"))
    counts = one.groupBy("c.features", "half").agg(F.count("*").alias("n"), F.sum(F.col("c.label").cast("long")).alias("right"))
    return sorted((tuple(r["features"]), r["half"], r["n"], r["right"]) for r in counts.collect())


@dataclass(frozen=True)
class Tree:
    """Depth two: a test, a test on each side, four values. A test is (feature, value): at most that value."""

    first: tuple[int, int]
    second: tuple[tuple[int, int], tuple[int, int]]
    values: tuple[tuple[float, float], tuple[float, float]]

    def value(self, features: tuple[int, ...]) -> float:
        side = features[self.first[0]] > self.first[1]
        test = self.second[side]
        return self.values[side][features[test[0]] > test[1]]

    def expression(self, features: Column) -> Column:
        def chosen(test: tuple[int, int], low: Column, high: Column) -> Column:
            return F.when(features[test[0]] <= test[1], low).otherwise(high)

        sides = [chosen(t, F.lit(low), F.lit(high)) for t, (low, high) in zip(self.second, self.values)]
        return chosen(self.first, *sides)


def boost(rows: list[tuple[tuple[int, ...], int, int]], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[Tree]]:
    """Start value and trees, by second-order boosting of the logistic loss on counted feature rows."""
    n, right = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not rows or not 0 < right < n:
        return (6.0 if rows and right == n else -6.0), []
    start = math.log(right / (n - right))
    scores, trees = {r[0]: start for r in rows}, []
    tests = [(f, v) for f, values in enumerate(FEATURE_VALUES) for v in range(values - 1)]

    def best(part: list) -> tuple[float, tuple[int, int], tuple[float, float]]:
        options = []
        for f, v in tests:
            sides = [[sum(x[1] for x in part if (x[0][f] > v) == s), sum(x[2] for x in part if (x[0][f] > v) == s)] for s in (False, True)]
            gain = sum(g * g / (h + 1.0) for g, h in sides)
            options.append((gain, (f, v), tuple(rate * g / (h + 1.0) for g, h in sides)))
        return max(options)

    for _ in range(rounds):
        part = []
        for features, count, good in rows:
            p = 1 / (1 + math.exp(-scores[features]))
            part.append((features, good - count * p, count * p * (1 - p)))
        first = best(part)[1]
        second = [best([x for x in part if (x[0][first[0]] > first[1]) == side]) for side in (False, True)]
        trees.append(Tree(first, (second[0][1], second[1][1]), (second[0][2], second[1][2])))
        scores = {features: value + trees[-1].value(features) for features, value in scores.items()}
    return start, trees


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    threshold: float

    def score(self, features: tuple[int, ...]) -> float:
        return self.start + sum(t.value(features) for t in self.trees)

    def expression(self, features: Column) -> Column:
        out = F.lit(self.start)
        for tree in self.trees:
            out = out + tree.expression(features)
        return out


def fit(counts: list[tuple[tuple[int, ...], int, int, int]], precision: float = PRECISION) -> Model:
    start, trees = boost([(f, n, right) for f, half, n, right in counts if half == 0])
    model = Model(start, tuple(trees), math.inf)
    rest = sorted(((model.score(f), n, right) for f, half, n, right in counts if half == 1), reverse=True)
    threshold, rows, good = math.inf, 0, 0
    for i, (score, n, right) in enumerate(rest):
        rows, good = rows + n, good + right
        if (i + 1 == len(rest) or rest[i + 1][0] < score) and good >= precision * rows:
            threshold = score
    return Model(start, tuple(trees), threshold)


def find_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with ``pii``: spans by kind as listed, then start; base spans and those the model adds."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    wanted = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    candidates = with_candidates(wanted)
    model = fit(feature_counts(candidates))
    base = F.filter("candidates", lambda c: c["base"])
    chosen = base
    if model.threshold < math.inf:
        # by start, base spans first: a candidate is inside a base span if an earlier one reaches its end
        placed = F.array_sort(F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), (~c["base"]).alias("added"), c.alias("span"))))
        candidates = candidates.withColumn("placed", placed)
        ends = F.transform("placed", lambda p: F.when(p["added"], 0).otherwise(p["span"]["end"]))
        reached = F.zip_with("placed", _before(ends, F.lit(0), lambda end, x: F.greatest(end, x)), lambda p, end: F.struct(p["span"].alias("span"), (p["span"]["end"] <= end).alias("inside")))
        likely = lambda p: (model.expression(p["span"]["features"]) >= F.lit(model.threshold - 1e-9)) & ~p["inside"]
        kept_spans = F.filter(reached, lambda p: p["span"]["base"] | likely(p))
        by_kind = F.array_sort(F.transform(kept_spans, lambda p: F.struct(p["span"]["features"][0].alias("generator"), p["span"]["start"].alias("start"), p["span"].alias("span"))))
        chosen = F.transform(by_kind, lambda x: x["span"])
    spans = F.transform(chosen, lambda c: F.struct(F.when(c["base"] | ~c["kind"].isin(*BASE_KINDS), c["kind"]).otherwise(F.concat(c["kind"], F.lit("_like"))).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    found = candidates.withColumn("pii", spans)
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "pii")


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; every character of a span becomes an x, positions stay."""
    found = find_pii(docs, text_col)

    def cover(text: Column, span: Column) -> Column:
        return F.overlay(text, F.repeat(F.lit("x"), span["end"] - span["start"]), span["start"] + 1)

    covered = F.aggregate("pii", F.col(text_col), cover)
    return found.withColumn(text_col, covered).select(*[c for c in docs.columns if c != "pii"])


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
