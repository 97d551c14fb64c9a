"""Token and text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = "[a-z0-9]+"  # fixed value: ASCII letters and digits only


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_cost(text: Column) -> Column:
    """Budget cost of a text: its token count, at least one."""
    return F.greatest(token_count(text), F.lit(1)).cast("bigint")


def word_cost(text: Column) -> Column:
    """Budget cost by whitespace words, at least one."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 1).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("bigint")


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 1))


def jaccard_sets(left: Column, right: Column) -> Column:
    """Jaccard of two distinct arrays, 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(left) + F.size(right) - shared)
    )


def jaccard(left: Column, right: Column) -> Column:
    return jaccard_sets(token_set(left), token_set(right))


def mask_overlap(left: Column, right: Column) -> Column:
    union = F.bit_count(left.bitwiseOR(right))
    shared = F.bit_count(left.bitwiseAND(right))
    return F.when((left == 0) | (right == 0), F.lit(0.0)).otherwise(shared / union)


def mask_coverage(query: Column, candidate: Column) -> Column:
    shared = F.bit_count(query.bitwiseAND(candidate))
    return F.when((query == 0) | (candidate == 0), F.lit(0.0)).otherwise(shared / F.bit_count(query))


def contains_any(text: Column, markers: list[str]) -> Column:
    lowered = F.lower(text)
    hit = F.lit(False)
    for marker in markers:
        hit = hit | lowered.contains(marker)
    return hit


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_text(text: Column, length: int) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) > length, F.concat(flat.substr(1, length - 3), F.lit("..."))).otherwise(flat)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
