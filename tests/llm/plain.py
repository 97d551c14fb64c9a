"""Plain versions of the operators, one text at a time, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def exact(rows):
    """(doc_id, keep_id, group_size, text_sha256) of (doc_id, text) rows."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lower(text)].append(doc)
    out = []
    for doc, text in rows:
        ids = [d for d in groups[lower(text)] if d is not None]
        out.append((doc, max(ids, default=None), len(groups[lower(text)]), sha(lower(text).encode())))
    return out


def passages(rows, window=50):
    """(doc_id, n_words, n_removed, kept_sha256)."""
    first = {}
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    for doc, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((doc, len(words), len(gone), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def strings(rows, window=200):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    count = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for doc, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def simhash(rows, radius=2, size=3):
    """(doc_id, fingerprint, component_id)."""
    from xxhash import xxh64_intdigest

    prints = []
    for _, text in rows:
        words = lower(text).encode().split()
        shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [b" ".join(words)] if words else []
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc), doc)
    return [(doc, f"{prints[i]:016x}", smallest.get(find(i))) for i, (doc, _) in enumerate(rows)]


def pii(text):
    """(start, kind, end) by the patterns as they are written."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def licenses(text, base, templates, threshold, block=64, stride=32):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    places, labels = [], set()
    for phrase, label in base.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    every, score = set(labels), 1.0 if places else 0.0
    for at in range(0, max(1, len(words)), stride):
        held = set(words[at : at + block])
        for label, notice in templates:
            notice = set(notice.split())
            part = len(held & notice) / len(notice)
            if part >= threshold:
                every.add(label)
                score = max(score, part)
    return (len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), sorted(every), score)


def pieces(doc, text, tokenizer, capacity=4096):
    """(doc_id, piece, start, length, ids_crc32)."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    cut = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
    return [(doc, k, k * capacity, len(p), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p))) for k, p in enumerate(cut)]


def align(item, text):
    """Best local alignment score of two word lists: match 2, mismatch -1, gap -1."""
    above, best = [0] * (len(text) + 1), 0
    for word in item:
        here = [0]
        for j, other in enumerate(text, 1):
            here.append(max(0, above[j - 1] + (2 if word == other else -1), above[j] - 1, here[-1] - 1))
        best, above = max(best, *here), here
    return best
