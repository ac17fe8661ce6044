"""Risk columns derived from class probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gaugeflow.constants import LOW_RISK_SENTENCE, NO_EVENT, NORMAL_CLASS, RISK_BANDS


def parse_probabilities(text: Column) -> Column:
    """JSON object to map; anything else, null included, becomes the empty map."""
    return F.coalesce(F.from_json(text, "map<string,double>"), F.expr("map()").cast("map<string,double>"))


def risk_score(normal_probability: Column) -> Column:
    return F.round(F.lit(1.0) - normal_probability, 4)


def risk_level(score: Column) -> Column:
    level = None
    for name, low, high in RISK_BANDS:
        inside = (score >= low) & (score < high)
        level = F.when(inside, F.lit(name)) if level is None else level.when(inside, F.lit(name))
    return level.otherwise(F.lit("CRITICAL"))


def strongest_event(probabilities: dict[str, Column]) -> Column:
    """Most probable class other than normal; of equal ones the first listed."""
    ranked = [
        F.struct(p.alias("p"), F.lit(-i).alias("place"), F.lit(label).alias("label"))
        for i, (label, p) in enumerate(probabilities.items())
        if label != NORMAL_CLASS
    ]
    return F.array_max(F.array(*ranked))["label"] if ranked else F.lit(NO_EVENT)


def predicted_event(level: Column, probabilities: dict[str, Column]) -> Column:
    return F.when(level == "LOW", F.lit(NO_EVENT)).otherwise(strongest_event(probabilities))


def risk_sentence(level: Column, event: Column, horizon: Column) -> Column:
    warning = F.concat(
        F.lit("Model predicts "),
        F.lower(level),
        F.lit(" risk of "),
        F.translate(event, "_", " "),
        F.lit(" within the next "),
        horizon.cast("string"),
        F.lit(" minutes."),
    )
    return F.when(level == "LOW", F.lit(LOW_RISK_SENTENCE)).otherwise(warning)


def probabilities_json(labels: Sequence[str], probabilities: dict[str, Column]) -> Column:
    """JSON object with sorted keys and four-decimal values."""
    return F.to_json(F.struct(*[F.round(probabilities[x], 4).alias(x) for x in sorted(labels)]))
