"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside, as columns of the input.
CLASHES = "__loc string, file string, `row` bigint, digest string, rid bigint, seed bigint, kept boolean, key string, n bigint, fp bigint, loc string, block int"


def prose(rng: random.Random, count: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(count))


def rows(seed: int = 5) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    shared, other = prose(rng, 70), prose(rng, 120)
    out = [(i, prose(rng, rng.randrange(1, 150))) for i in range(20)]
    out += [(20 + i, f"{prose(rng, 20)} {shared} {prose(rng, 20)}") for i in range(5)]
    out += [(30 + i, other) for i in range(4)] + [(34, other.upper()), (35, other.replace("w1", "W1"))]
    edited = other.split()
    edited[60] = "changed"
    out += [(36, " ".join(edited)), (37, f"{other} {other}"), (38, "x " * 500), (39, "y" * 900), (40, "y" * 900 + "z")]
    out += [(50, None), (51, ""), (52, "   \n\t "), (53, "one"), (54, "One"), (55, "one two")]
    out += [(60, prose(rng, 3000)), (61, "Été Ünï ÇA été ünï ça"), (62, "été Ünï ÇA été ünï ça")]
    out += [(0, out[0][1]), (0, out[0][1]), (None, "no number"), (None, other), (None, "no number")]
    return out


def table(spark, data=None, clashes: bool = False):
    data = rows() if data is None else data
    full = [(d, t, "en" if d is None or d % 3 else None, "s", len(t or "")) for d, t in data]
    if not clashes:
        return spark.createDataFrame(full, SCHEMA)
    extra = ("x", "y", 7, "z", 8, 9, True, "k", 10, 11, "l", 12)
    return spark.createDataFrame([r + extra for r in full], f"{SCHEMA}, {CLASHES}")
