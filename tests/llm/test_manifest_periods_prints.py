"""Merkle manifest, periodic runs and edit fingerprints against plain versions on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memjoin.llm import edit_prints, merkle, periods
from memjoin.llm.common import WORD_BASE, Rolling
from tests.llm import cases


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "clashing"])
def docs(spark, request):
    return cases.table(spark, clashes=request.param)


@pytest.fixture(scope="module")
def empty(spark):
    return cases.table(spark, [])


# ---------------------------------------------------------------- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """The root and, for each node, its siblings up to it with the side they stand on."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, place in enumerate(at):
            sibling = place ^ 1
            paths[k].append("" if sibling >= len(level) else ("<" if sibling < place else ">") + level[sibling])
            at[k] = place // 2
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: plain_tree([g[2] for g in sorted(groups[lang], key=lambda g: g[:3])]) for lang in order}
    root, tops = plain_tree([trees[lang][0] for lang in order])
    for lang, top in zip(order, tops):
        for (_, _, leaf, row), path in zip(sorted(groups[lang], key=lambda g: g[:3]), trees[lang][1]):
            yield (row[0], leaf, trees[lang][0], root, tuple(path + top))


def records(df):
    return [tuple(r[:5]) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest(docs, levels):
    found = merkle.document_manifest(docs, levels=levels).collect()
    expected = Counter(plain_manifest(records(docs)))
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.witness)) for r in found) == expected


def test_manifest_null_columns_and_one_group(spark):
    rows = [(1, None, None, None, None), (2, "a", None, "s", 1), (None, "b", None, "s", 2)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    found = merkle.document_manifest(df).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.witness)) for r in found) == Counter(plain_manifest(rows))
    assert all(r.subroot == r.root for r in found)
    one = merkle.document_manifest(df.where("doc_id = 2")).collect()
    assert [(r.root, r.witness) for r in one] == [(plain_leaf(rows[1]), [])]


def test_manifest_tampering_shows(docs):
    struck = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, F.lit(False))
    rows = merkle.document_manifest(docs, {"n_chars": F.col("n_chars") + 1}, struck, levels=3)
    found = rows.select("doc_id", "root", merkle.folded(F.col("witness"), F.col("other")).alias("folded")).collect()
    assert {r.doc_id for r in found if r.folded != r.root} == {r.doc_id for r in found if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert any(r.folded != r.root for r in found)


def test_manifest_of_nothing(empty):
    assert merkle.document_manifest(empty).collect() == []


@pytest.mark.parametrize("count", range(1, 20))
def test_append_extends_witnesses(count):
    nodes = [h(str(k)) for k in range(count)]
    assert merkle.appended(nodes, 5, True) == plain_tree(nodes)
    root, paths = merkle.appended(nodes, 5, False)
    assert all(len(p) == 5 for p in paths)
    for leaf, path in zip(nodes, paths):
        for step in path:
            leaf = h(leaf) if not step else h(step[1:], leaf) if step[0] == "<" else h(leaf, step[1:])
        assert leaf == root


# ---------------------------------------------------------------- periodic runs


def plain_runs(words):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        start = 0
        while start < len(words) - q:
            end = start
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(12, 2 * q):
                best.setdefault((start, end + q), q)
            start = end + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def plain_collapse(words, runs):
    dropped = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def binary_texts(rng):
    """Texts over two or three words: random, periodic with faults, Fibonacci, Thue-Morse, touching regions of one period."""
    for _ in range(60):
        block = [rng.randrange(3) for _ in range(rng.randrange(1, 20))]
        yield (block * 30)[: rng.randrange(120)] + [rng.randrange(2)] + (block * 30)[rng.randrange(9) :][:60]
        yield [rng.randrange(2) for _ in range(rng.randrange(150))]
        root = [rng.randrange(2) for _ in range(rng.randrange(1, 4))]
        half = (root * 30)[: rng.randrange(1, 50)] + [rng.randrange(3)] * rng.randrange(2)
        yield half * rng.randrange(2, 4) + [rng.randrange(3) for _ in range(5)]
        yield [w for _ in range(4) for w in (root * 30)[rng.randrange(3) :][: rng.randrange(1, 60)]]
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    yield b
    yield [bin(k).count("1") % 2 for k in range(256)]
    yield []


def test_runs_of_small_alphabets():
    texts = [[f"w{v}".encode() for v in text] for text in binary_texts(random.Random(3))]
    found = periods.text_runs(texts, Rolling(WORD_BASE))
    for text, runs in zip(texts, found):
        assert runs == plain_runs(text)
    assert sum(map(len, found)) > 300


def test_runs_survive_colliding_hashes(monkeypatch):
    """With hashes of ten bits the proposals are poor and stretched; what is returned is still a run word by word."""
    monkeypatch.setattr(Rolling, "slices", lambda self, prefix, starts, ends, old=Rolling.slices: old(self, prefix, starts, ends) & 1023)
    for text in binary_texts(random.Random(4)):
        words = [str(v).encode() for v in text]
        assert set(periods.text_runs([words], Rolling(WORD_BASE))[0]) <= set(plain_runs(words))


def test_periodic_runs(docs):
    mark = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    found = Counter((r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periods.periodic_runs(docs, mark).collect())
    expected, planted = Counter(), 0
    for doc_id, text in cases.rows():
        words = (text or "").encode().split()
        checksum = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if checksum is not None and checksum % 10 == 0 and words:
            n, g = len(words), checksum // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        words = [w.decode() for w in words]
        runs = plain_runs(words)
        expected[(doc_id, tuple(runs), plain_collapse(words, runs))] += 1
    assert found == expected and planted


def test_runs_of_long_text_and_nothing(spark, empty):
    rng = random.Random(9)
    block = [f"w{rng.randrange(10**6)}" for _ in range(7000)]
    df = cases.table(spark, [(1, " ".join(block * 3 + block[:50])), (2, " ".join(["x"] * 50_000))])
    rows = {r.doc_id: r for r in periods.periodic_runs(df).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 21_050, 7000)] and rows[1].collapsed == " ".join(block)
    assert [tuple(x) for x in rows[2].runs] == [(0, 50_000, 1)] and rows[2].collapsed == "x"
    assert periods.periodic_runs(empty).collect() == []


# ---------------------------------------------------------------- edit fingerprints


@pytest.fixture(scope="module")
def walk():
    return edit_prints.Walk()


def plain_print(walk, text):
    """The whole embedding, step by step, then its samples."""
    embedded, step = [], 0
    for c in text:
        stay = int(walk.wait[walk.kind[ord(c)], step % edit_prints.CYCLE])
        embedded += [c] * stay
        step += stay
    levels = 0
    while levels == 0 and embedded or len(embedded) > edit_prints.FIRST << max(levels - 1, 0) and levels:
        levels += 1
    walk.need(levels)
    places = walk.places[: levels * edit_prints.SAMPLES]
    return "".join(chr(walk.digit[ord(embedded[p])]) if p < len(embedded) else "-" for p in places)


def ordered(rows):
    return sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_fingerprints(docs, walk):
    rows = edit_prints.fingerprints(docs, rows=5).collect()
    plain = Counter((d, len(t or ""), plain_print(walk, t or "")) for d, t in cases.rows())
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in rows) == plain
    # Ids that occur once, followed by an id that occurs once, have one right edited text.
    data = ordered(cases.rows())
    ids = Counter(d for d, _ in data)
    by_id = {r.doc_id: r for r in rows}
    checked = 0
    for (d, text), (e, following) in zip(data, data[1:]):
        if ids[d] == ids[e] == 1:
            half = len(text) // 2
            changed = text[: len(text) - half] + following[:half]
            assert by_id[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert by_id[d].edited_fingerprint == plain_print(walk, changed)
            assert by_id[d].near_next == pytest.approx(walk.likeness(by_id[d].fingerprint.encode(), by_id[e].fingerprint.encode()))
            checked += 1
    assert checked > 30
    last = [r for r in rows if r.doc_id == max(d for d in ids if d is not None)][0]
    assert last.near_next in {walk.likeness(last.fingerprint.encode(), plain_print(walk, t or "").encode()) for d, t in cases.rows() if d is None}


def test_fingerprints_do_not_depend_on_slices(spark):
    rng = random.Random(2)
    df = cases.table(spark, [(k, cases.prose(rng, rng.randrange(200))) for k in range(60)])
    few, many = (sorted(map(tuple, edit_prints.fingerprints(df, rows=n).drop("bands").collect())) for n in (1, 1000))
    assert few == many and len(few) == 60


def test_fingerprints_of_one_row_and_nothing(spark, empty):
    (row,) = edit_prints.fingerprints(cases.table(spark, [(7, "abcd")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert edit_prints.fingerprints(empty).collect() == []
    assert edit_prints.near_documents(edit_prints.fingerprints(empty)).collect() == []


def test_likeness_follows_edits(walk):
    """Held-out texts: the likeness falls with the number of edits and is near nothing for other texts."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(2000)) for _ in range(30)]

    def print_(text):
        points = edit_prints.code_points(text)
        return walk.sampled(points, walk.entered([0], [points])[0])

    def edit(text, count):
        for _ in range(count):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice(["", "x", "xy"]) + text[k + rng.randrange(2) :]
        return text

    means = [sum(walk.likeness(print_(t), print_(edit(t, count))) for t in texts) / len(texts) for count in (0, 2, 20, 100)]
    other = sum(walk.likeness(print_(a), print_(b)) for a, b in zip(texts, texts[1:])) / 29
    assert means[0] == 1.0 and means[0] > means[1] > means[2] > means[3] > other and means[1] > 0.9 and other < 0.2


def test_near_documents(spark):
    """Copies and lightly edited copies come under the first of them; other texts stay alone."""
    rng = random.Random(6)
    texts = [cases.prose(rng, 300, 5000) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts[:10])]
    rows += [(200 + k, t[:-30] + " end") for k, t in enumerate(texts[:20])]
    prints = edit_prints.fingerprints(cases.table(spark, rows)).cache()
    named = prints.withColumn("print", edit_prints.digest_of("fingerprint")).join(edit_prints.near_documents(prints), "print", "left")
    near = {r.doc_id: r.doc_id if r.near_id is None else r.near_id for r in named.collect()}
    assert all(near[k] == k for k in range(40)) and all(near[100 + k] == k for k in range(10))
    assert sum(near[200 + k] == k for k in range(20)) >= 16 and all(near[200 + k] in (k, 200 + k) for k in range(20))


def test_near_documents_leave_out_no_link(spark):
    """Every pair of at least the threshold is linked, also of members that are not alike to their bands' first."""
    rng = random.Random(41)
    rows = []
    for k in range(12):
        words = cases.prose(rng, 250, 5000).split()
        for step in range(6):
            rows.append((100 * step + k, " ".join(words)))
            for at in rng.sample(range(len(words)), 5):
                words[at] = cases.prose(rng, 1, 5000)
    prints = edit_prints.fingerprints(cases.table(spark, rows)).cache()
    walk, data = edit_prints.Walk(), {r.doc_id: r.fingerprint.encode() for r in prints.collect()}
    root = {d: d for d in data}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(data)
    linked = 0
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if walk.likeness(data[a], data[b]) >= edit_prints.ALIKE:
                linked += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert linked > 40
    for most in (4096, 2):
        named = prints.withColumn("print", edit_prints.digest_of("fingerprint")).join(edit_prints.near_documents(prints, most=most), "print", "left")
        near = {r.doc_id: r.doc_id if r.near_id is None else r.near_id for r in named.collect()}
        assert near == {d: top(d) for d in ids}


def test_last_digits_rule_out_no_pair_that_is_alike():
    walk, rng = edit_prints.Walk(), random.Random(12)
    prints = []
    for size in (1, 3, 40, 64, 65, 700, 5000):
        for _ in range(6):
            text = "".join(rng.choice("abcdefgh ") for _ in range(size))
            for edits in (0, 1, size // 12, size // 4, size):
                changed = [rng.choice("abcdefgh ") if rng.random() * size < edits else c for c in text][: size - rng.randrange(1 + size // 10)]
                points = edit_prints.code_points("".join(changed))
                prints.append(walk.sampled(points, walk.entered([0], [points])[0]))
    pairs = [(a, b) for a in prints for b in prints]
    digits = {a: a.decode().rstrip("-") for a in prints}
    last = {a: bytes.fromhex(digits[a][-edit_prints.LAST :].rjust(edit_prints.LAST, "0")) for a in prints}
    sides = [edit_prints.last_digits(edit_prints.pa.array([last[pair[k]] for pair in pairs])) for k in range(2)]
    ends = [np.array([len(digits[pair[k]]) for pair in pairs]) for k in range(2)]
    likeness = np.array([walk.likeness(a, b) for a, b in pairs])
    for least in (0.0, 0.3, 0.8, 1.0):
        out = edit_prints.ruled_out(*sides, *ends, least)
        assert not (out & (likeness >= least)).any()
        assert least < 0.8 or out.sum() >= 0.5 * (likeness < least).sum()


def test_whole_fingerprints_travel_only_where_the_last_digits_leave_it_open(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(60)]
    texts += [texts[0][:200] + "b" + texts[0][201:], texts[1] + "a"]
    prints = edit_prints.stored(edit_prints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    rows = prints.collect()
    firsts: dict[int, list] = {}
    for r in rows:
        for band in r.bands:
            firsts.setdefault(band, []).append(r.doc_id)
    met = {(ids[0], other) for ids in firsts.values() for other in ids[1:]}
    sent, small = {}, edit_prints.small

    def counted(df, label, *more):
        table = small(df, label, *more)
        sent[label] = table.count()
        return table

    monkeypatch.setattr(edit_prints, "small", counted)
    found = {r.near_id for r in edit_prints.near_documents(prints).collect()}
    assert found == {0, 1}
    assert len(met) > 100 and sent["meetings"] < len(met) / 2


def test_bands_of_unlike_texts_do_not_meet_past_their_ends(walk):
    """Texts that reach little of their last level share bands no more often than others; alike ones still do."""
    rng = random.Random(15)

    def bands(text):
        points = edit_prints.code_points(text)
        print_ = walk.sampled(points, walk.entered([0], [points])[0])
        return print_, set(walk.bands(print_))

    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(520, 620))) for _ in range(200)]
    made = [bands(text) for text in texts]
    met = sum(bool(made[a][1] & made[b][1]) for a in range(200) for b in range(a))
    assert all(len(b) in (edit_prints.BANDS, 2 * edit_prints.BANDS) for _, b in made) and met < 40
    for text, (print_, own) in zip(texts, made):
        other, near = bands(text[:-20] + "xyz")
        assert walk.likeness(print_, other) < 0.85 or own & near
    assert all(len(bands(text)[1]) == edit_prints.BANDS for text in ("a", "ab", "abc" * 5))
