"""Usage-state scores of a memory card."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from memjoin.functions.text import clamp

# Outcome weights, age and count scales, staleness limit.
OUTCOME_VALUE = {"helpful": 1.0, "corrected": 0.35, "ignored": -0.65}
AGE_SCALE = 365.0
USE_SCALE = 100.0
EVIDENCE_SCALE = 50.0
STALE_DAYS = 180.0


def falsy_default(value: Column, default: float) -> Column:
    """Null and zero both read as the default."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value.cast("double"))


def numeric_with_fallback(card: Column, metadata: Column, key: str, default: float) -> Column:
    return F.coalesce(card.try_cast("double"), F.try_element_at(metadata, F.lit(key)).try_cast("double"), F.lit(default))


def outcome_value(outcome: Column) -> Column:
    out = F.lit(0.0)
    for name, value in OUTCOME_VALUE.items():
        out = F.when(F.lower(outcome) == name, F.lit(value)).otherwise(out)
    return out


def state_parts(age: Column, use: Column, evidence: Column, outcome: Column, protected: Column) -> dict[str, Column]:
    """The eight state features except the anchor's age."""
    age, use, evidence = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (age, use, evidence))
    age_norm = clamp(age / AGE_SCALE, 0.0, 1.0)
    guarded = F.coalesce(protected, F.lit(False))
    return {
        "age_norm": age_norm,
        "use_norm": clamp(F.log1p(use) / math.log1p(USE_SCALE), 0.0, 1.0),
        "evidence_norm": clamp(F.log1p(evidence) / math.log1p(EVIDENCE_SCALE), 0.0, 1.0),
        "outcome": outcome_value(F.coalesce(outcome, F.lit(""))),
        "protected": guarded.cast("double"),
        "stale": ((age >= STALE_DAYS) & (use <= 0) & ~guarded).cast("double"),
        "recency": 1.0 - age_norm,
    }


def card_state(card: str = "") -> dict[str, Column]:
    """`state_parts` over the standard column names, with an optional prefix."""
    names = ("age_days", "use_count", "evidence_count", "last_outcome", "protected")
    return state_parts(*(F.col(f"{card}{n}") for n in names))


def state_score(parts: dict[str, Column]) -> Column:
    zero = F.lit(0.0)
    return (
        0.18 * parts["use_norm"]
        + 0.16 * parts["evidence_norm"]
        + 0.12 * F.greatest(zero, parts["outcome"])
        + 0.08 * parts["protected"]
        + 0.07 * parts["recency"]
        - 0.22 * parts["stale"]
        - 0.10 * F.greatest(zero, -parts["outcome"])
    )


def state_adjustment(parts: dict[str, Column]) -> Column:
    zero = F.lit(0.0)
    return (
        0.08 * parts["use_norm"]
        + 0.06 * parts["evidence_norm"]
        + 0.05 * parts["protected"]
        + 0.08 * F.greatest(zero, parts["outcome"])
        - 0.16 * parts["stale"]
        - 0.10 * F.greatest(zero, -parts["outcome"])
    )
