"""PII: exact patterns, and a skip-chain conditional random field that adds spans.

Tokens that hold a digit or an at sign are the nodes of a document's field; every other word is surely outside. Edges join
neighbouring nodes (chain) and each node to the next node of the document with the same or a similar form, that is the same
text without punctuation, or the same seven or more digits (skip chain). Edges grow with the nodes: a form that stands a
thousand times makes a chain of skips, not all pairs. Weights are fitted by pseudo-likelihood on a bounded sample of
documents (`TRAIN_DOCS`, the smallest hashes of doc_id) whose labels are the exact patterns; damped loopy sum-product
messages then bring the labels of distant equal tokens together, and tokens that reach `CERTAIN` become spans.

Defined cases: null and empty texts have no spans; repeated rows give equal rows; a sample without tokens fits nothing and
adds nothing; an empty table gives no rows; other columns are not read. Every step is linear in the length of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.llm.common import documents

KINDS = ("email", "ip", "card", "phone")  # fixed order of the contract
OUTSIDE = len(KINDS)
LABELS = OUTSIDE + 1
PHONE_KIND = KINDS.index("phone")
TRAIN_DOCS = 3000
CERTAIN = 0.95
ROUNDS, DAMPING = 10, 0.5
NODES_AT_ONCE = 20_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns of the contract; possessive repeats and the look-behind change no match, they only avoid retries that must fail.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GAP = re.compile(r"[\x20\t-\r]")
MARKED = re.compile(r"[0-9@]")
PUNCTUATION = ".,;:!?()[]{}<>\"'|*&#$%="


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, by start and kind."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() < 38:
            digits = match[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((match.start(), 2, match.end()))
    for match in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in match[0]) <= 15:
            found.append((match.start(), 3, match.end()))
    return sorted(found)


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of the words that hold a digit or an at sign."""
    out, match = [], MARKED.search(text)
    end = 0
    while match:
        at = match.start()
        start = max(end, 1 + max(text.rfind(c, end, at) for c in " \t\n\x0b\x0c\r"))
        gap = GAP.search(text, at)
        end = gap.start() if gap else len(text)
        out.append((start, end))
        match = MARKED.search(text, end)
    return out


FEATURES = 34


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the binary features that hold for a token: shape, digits, marks, and the word before it."""
    token = text[start:end]
    core = token.strip(PUNCTUATION)
    digits = sum(c in "0123456789" for c in core[:64])
    letters = sum(c.isalpha() for c in core[:64])
    on = [0, 1 + int(np.searchsorted((1, 2, 4, 7, 9, 10, 12, 13, 15, 16, 17, 20), digits, side="right"))]  # 1..13
    dots = core.count(".")
    on.append(14 + min(dots, 4))  # 14..18
    if "@" in core:
        on.append(19 + (1 if DOMAIN.search(core, core.find("@") + 1) else 0))  # 19, 20
    on.append(21 + (0 if not letters else 1 if letters < digits else 2))  # 21..23
    if token.startswith("+"):
        on.append(24)
    if "(" in token:
        on.append(25)
    if "-" in core:
        on.append(26)
    if ":" in core or "/" in core or "=" in core:
        on.append(27)
    on.append(28 + (0 if len(core) < 8 else 1 if len(core) < 20 else 2))  # 28..30
    before = text[max(0, start - 3) : start].rstrip()
    if before.endswith(("=", ":", '"')):
        on.append(31)
    if dots == 3 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in core.split(".")):
        on.append(32)
    if core.isdigit() and len(core) < 20 and luhn(core):
        on.append(33)
    return on


def skip_key(token: str) -> str:
    """Tokens with one key are the same or similar."""
    core = token.strip(PUNCTUATION).lower()
    digits = re.sub("[^0-9]", "", core)
    return f"#{digits}" if len(digits) >= 7 and not any(c.isalpha() for c in core) else core


class Field:
    """Nodes and edges of several documents: features, edges (0 chain, 1 skip), document and place of each node."""

    def __init__(self):
        self.on: list[list[int]] = []
        self.edges: list[tuple[int, int, int]] = []
        self.nodes: list[tuple[int, int, int]] = []

    def add(self, row: int, text: str) -> None:
        last: dict[str, int] = {}
        previous = -2
        for start, end in tokens(text):
            node = len(self.nodes)
            self.nodes.append((row, start, end))
            self.on.append(features(text, start, end))
            if previous >= 0 and not text[previous:start].strip(" \t\n\x0b\x0c\r"):
                self.edges.append((node - 1, node, 0))
            previous = end
            key = skip_key(text[start:end])
            if key in last:
                self.edges.append((last[key], node, 1))
            last[key] = node

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        shape = np.zeros((len(self.nodes), FEATURES))
        for node, on in enumerate(self.on):
            shape[node, on] = 1.0
        return shape, np.array(self.edges, dtype=np.int64).reshape(-1, 3)


def neighbours(edges: np.ndarray, onehot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the one-hot labels before, after and across a skip from each node."""
    before, after, skip = np.zeros_like(onehot), np.zeros_like(onehot), np.zeros_like(onehot)
    chain, far = edges[edges[:, 2] == 0], edges[edges[:, 2] == 1]
    np.add.at(before, chain[:, 1], onehot[chain[:, 0]])
    np.add.at(after, chain[:, 0], onehot[chain[:, 1]])
    np.add.at(skip, far[:, 1], onehot[far[:, 0]])
    np.add.at(skip, far[:, 0], onehot[far[:, 1]])
    return before, after, skip


def fit(shape: np.ndarray, edges: np.ndarray, labels: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-4):
    """Pseudo-likelihood: unary weights, chain potentials and symmetric skip potentials, by Adam."""
    unary, chain, skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    if not len(labels):
        return unary, chain, skip
    onehot = np.eye(LABELS)[labels]
    before, after, far = neighbours(edges, onehot)
    weights = [unary, chain, skip]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        unary, chain, skip = weights
        score = shape @ unary + before @ chain + after @ chain.T + far @ skip
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        wrong = (p - onehot) / len(labels)
        across = far.T @ wrong
        slopes = [shape.T @ wrong, before.T @ wrong + wrong.T @ after, (across + across.T) / 2]
        for i, slope in enumerate(slopes):
            slope = slope + decay * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope**2
            weights[i] = weights[i] - rate * 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return tuple(weights)


def marginals(shape: np.ndarray, edges: np.ndarray, weights) -> np.ndarray:
    """Loopy sum-product: damped messages both ways along every edge for a fixed number of rounds."""
    unary, chain, skip = weights
    local = shape @ unary
    if len(edges):
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.stack([chain, skip])[edges[:, 2]]
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        half = len(edges)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        messages = np.zeros((2 * half, LABELS))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, messages)
            out = (belief[source] - messages[back])[:, :, None] + tables
            top = out.max(axis=1)
            out = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            out -= out.max(axis=1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * out
        local = local.copy()
        np.add.at(local, target, messages)
    local -= local.max(axis=1, keepdims=True)
    p = np.exp(local)
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, nodes: list[tuple[int, int, int]], p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Certain tokens as spans (start, kind, end), unless a base span meets them; the groups of a phone number are joined."""
    spans: list[list[int]] = []
    for (_, start, end), belief in zip(nodes, p):
        kind = int(belief.argmax())
        if kind == OUTSIDE or belief[kind] < CERTAIN:
            continue
        token = text[start:end]
        start += len(token) - len(token.lstrip(PUNCTUATION))
        end -= len(token) - len(token.rstrip(PUNCTUATION))
        if start >= end or any(s < end and start < e for s, _, e in base):
            continue
        if kind == PHONE_KIND and spans and spans[-1][1] == kind and not text[spans[-1][2] : start].strip(" \t\n\x0b\x0c\r" + PUNCTUATION):
            spans[-1][2] = end
        else:
            spans.append([start, kind, end])
    return [tuple(s) for s in spans]


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def training_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, on, edges, labels) of the documents with tokens; features and labels only, no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for at, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                field = Field()
                field.add(at, text)
                if not field.nodes:
                    continue
                base = base_spans(text)
                labels = [next((k for s, k, e in base if s < end and start < e), OUTSIDE) for _, start, end in field.nodes]
                keep.append(at)
                out.append((field.on, [list(e) for e in field.edges], labels))
            kinds = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32())]
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), *columns], ["doc_id", "on", "edges", "labels"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, on array<array<int>>, edges array<array<int>>, labels array<int>")


def train(docs: DataFrame, sample: int = TRAIN_DOCS, nodes: int = 60_000):
    """Weights fitted on at most `sample` documents, chosen by the hash of doc_id, and at most `nodes` tokens of them."""
    place = F.xxhash64("doc_id")
    last = docs.select(place.alias("place")).distinct().orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    if last is None:
        return fit(np.zeros((0, FEATURES)), np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    chosen = docs.select("doc_id", "text").where(place <= last)
    shapes, edges, labels, total = [], [], [], 0
    for row in training_rows(chosen).dropDuplicates(["doc_id"]).toLocalIterator():
        if total + len(row["labels"]) > nodes:
            continue
        shape = np.zeros((len(row["on"]), FEATURES))
        for node, on in enumerate(row["on"]):
            shape[node, on] = 1.0
        shapes.append(shape)
        edges += [(a + total, b + total, kind) for a, b, kind in row["edges"]]
        labels += row["labels"]
        total += len(row["labels"])
    return fit(np.concatenate(shapes) if shapes else np.zeros((0, FEATURES)), np.array(edges, dtype=np.int64).reshape(-1, 3), np.array(labels, dtype=np.int64))


def find_pii(docs: DataFrame, sample: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the counts are those of the exact patterns."""
    weights = train(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bases, extra = [], [], []
            field, begun = Field(), 0

            def settle():
                nonlocal field, begun
                shape, edges = field.arrays()
                p = marginals(shape, edges, weights)
                cuts = np.searchsorted([n[0] for n in field.nodes], np.arange(begun, len(texts) + 1))
                for row in range(begun, len(texts)):
                    a, b = cuts[row - begun], cuts[row - begun + 1]
                    extra.append(added_spans(texts[row], field.nodes[a:b], p[a:b], bases[row]))
                    texts[row] = ""
                field, begun = Field(), len(texts)

            for row, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                texts.append(text)
                bases.append(base_spans(text))
                field.add(row, text)
                if len(field.nodes) > NODES_AT_ONCE:
                    settle()
            settle()
            columns = [pa.array([sum(k == kind for _, k, _ in base) for base in bases], pa.int64()) for kind in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base in bases], pa.string()))
            columns.append(pa.array([said(sorted(base + more)) for base, more in zip(bases, extra)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{name} bigint" for name in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
