"""Each operator against its plain version on a small table of awkward rows, with and without clashing column names."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memjoin.llm import decontaminate, exact_dedup, licenses, packing, perplexity, phrases, pii, repeats, sharding, simhash
from memjoin.llm.common import components
from tests.llm import cases, plain


def bag(rows):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in row) for row in rows)


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "clashing"])
def docs(spark, request):
    return cases.table(spark, clashes=request.param)


@pytest.fixture(scope="module")
def empty(spark):
    return cases.table(spark, [])


def test_exact_dedup(docs):
    found = exact_dedup.exact_groups(docs).collect()
    expected = plain.exact(cases.rows())
    assert bag((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in found) == bag(expected)
    kept = Counter(bytes(r.digest).hex() for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({e[3] for e in expected})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_dedup_with_colliding_digests(docs):
    weak = exact_dedup.exact_groups(docs, digest=lambda text: F.lpad(F.hex(F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(5))), 64, "0"))
    expected = Counter((e[0], e[1], e[2]) for e in plain.exact(cases.rows()))
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in weak.collect()) == expected


def test_drop_copies_keeps_columns(docs):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(plain.lower(r.text) for r in left.collect()) == sorted({plain.lower(t) for _, t in cases.rows()})


def test_sharding(docs):
    rows = sharding.shard_documents(docs).collect()
    expected = bag((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in cases.rows())
    assert bag((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    by_shard: dict[int, list[int]] = {}
    for r in rows:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_sharding_moves_few_and_follows_weights(spark):
    keys = spark.range(20000)
    picked = keys.select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0]).alias("a"), sharding.rendezvous(F.col("id"), [1.0, 2.0]).alias("b")).collect()
    share = Counter(r.a for r in picked)
    assert abs(share[1] / 20000 - 0.5) < 0.02
    assert all(r.a == r.b for r in picked if r.a != 2)


def test_slots_do_not_depend_on_buckets(docs):
    sized = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.lit(0).alias("shard"))
    one = bag(sharding.slots(sized, "shard", "doc_id", ["doc_id", "t"]).collect())
    assert one == bag(sharding.slots(sized, "shard", "doc_id", ["doc_id", "t"], rows_per_bucket=3).collect())


def test_packing(docs):
    tokenizer = packing.WordIds(packing.default_vocabulary()).tokenizer
    for rows_per_group in (packing.GROUP_ROWS, 9):
        rows = packing.pack_documents(docs, group_rows=rows_per_group).collect()
        expected = bag(p for d, t in cases.rows() for p in plain.pieces(d, t, tokenizer))
        assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
        held: dict[int, list] = {}
        for r in rows:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in held.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
            assert sum(n for _, n in parts) <= 4096


def test_sum_of_squares_follows_its_rule():
    lengths = np.random.default_rng(1).integers(1, 31, 200)
    bins, offsets, gaps = packing.sum_of_squares(lengths, 30)
    left: dict[int, int] = {}
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        options = {}
        for gap in {30, *(g for g in left.values() if g >= size)}:
            open_bins = Counter(g for g in left.values() if g)
            if gap < 30:
                open_bins[gap] -= 1
            if gap - size:
                open_bins[gap - size] += 1
            options[gap] = sum(n * n for n in open_bins.values())
        was = left.get(int(bins[item]), 30)
        assert options[was] == min(options.values())
        left[int(bins[item])] = was - size
    assert [left[b] for b in range(len(gaps))] == gaps.tolist()
    assert len(gaps) <= 1.06 * lengths.sum() / 30


def test_words_have_the_ids_of_their_texts():
    ids = packing.WordIds(packing.default_vocabulary())
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x20, 0x180)] + list(" \t\n'.,") * 30
    texts = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(400)]
    texts += ["it's we'll x's 'S", "a.b'S THE,END!!'s", "<|endoftext|>", "Στ ΣΑΣ", "é é", "a\x1cb \x85 c", "x\x7fy"]
    assert [ids.of(t) for t in texts] == [ids.whole(t) for t in texts]


def test_new_words_of_many_texts_are_learnt_together(monkeypatch):
    texts = [f"Word{k}. it's {'ab' * (k % 7)}, <|x {chr(0x3A3)}" if k % 9 == 0 else f" Stone{'x' * (k % 5)}!! {'é' * (k % 4)}\tend{'z' * k} " for k in range(60)] + ["", " \n"]
    ids = packing.WordIds(packing.default_vocabulary())
    expected = [ids.whole(t) for t in texts]
    calls = []
    monkeypatch.setattr(ids, "learn", lambda words, learn=ids.learn: (calls.append(len(words)), learn(words)))
    assert list(ids.each(texts)) == expected and len(calls) == 1
    assert list(ids.each(texts)) == expected and len(calls) == 1
    for limit in (3, 70):  # too small for the words of all texts; emptied between texts
        monkeypatch.setattr(packing, "CACHE_WORDS", limit)
        assert list(ids.each(texts)) == [ids.of(t) for t in texts] == expected


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(8)
    good = [" ".join(rng.choice(["the", "of", "and", "river", "stone", "green"]) + rng.choice(["", "s", "."]) for _ in range(rng.randrange(20, 60))) for _ in range(200)]
    bad = ["".join(rng.choice("XQZ#%!&0189") for _ in range(200)) for _ in range(20)]
    return good, bad


def test_quality_classifier(spark, languages):
    good, bad = languages
    data = [(i, t) for i, t in enumerate([*good, *bad, None, "", good[0], good[0]])] + [(None, good[1])]
    docs = cases.table(spark, data, clashes=True)
    labels = spark.createDataFrame([(i, 1 if i < 200 else 0, 0) for i in range(0, 210, 2)] + [(0, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = perplexity.classified(docs, labels).collect()
    assert len(rows) == len(data)
    judged = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert not any(judged[i].kept for i in range(200, 220))
    assert sum(judged[i].kept for i in range(200)) >= 190
    assert judged[220].kept and judged[220].perplexity is None and judged[221].kept
    again = {r.doc_id: r.perplexity for r in perplexity.classified(docs, labels, shard_terms=60).collect()}
    assert all(again[i] == pytest.approx(judged[i].perplexity) for i in range(220))
    left = perplexity.keep_good(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in rows)


def test_model_is_a_distribution(spark, languages):
    docs = cases.table(spark, list(enumerate(languages[0][:30])))
    counts = perplexity.ngram_counts(docs, 3)
    total = Counter()
    for text in languages[0][:30]:
        padded = b"\n\n" + text.encode()
        total.update(int.from_bytes(padded[i - 2 : i + 1], "big") for i in range(2, len(padded)))
    assert {r.key: r.c for r in counts.collect()} == total
    model = perplexity.Model.of(3, perplexity.model_terms(counts, 3).toArrow())
    for context in (b"th", b"e ", b"\n\n", b"zz"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        assert np.exp(model.log_p(keys)).sum() == pytest.approx(1.0)


def test_no_trusted_documents(spark):
    docs = cases.table(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = perplexity.classified(docs, labels).collect()
    assert len(rows) == len(cases.rows()) and all(r.kept for r in rows)


def test_repeated_phrases(docs):
    assert bag(phrases.repeated_passages(docs).collect()) == bag(plain.passages(cases.rows()))
    assert bag(phrases.repeated_passages(docs, window=8, gram=4).collect()) == bag(plain.passages(cases.rows(), 8))


def test_repeated_strings(docs):
    assert bag(repeats.repeated_strings(docs).collect()) == bag(plain.strings(cases.rows()))
    small = repeats.repeated_strings(docs, frequent=1, block_bytes=2000).collect()
    assert bag(small) == bag(plain.strings(cases.rows()))


def test_interleave_refinement():
    rng = random.Random(3)
    for _ in range(150):
        runs = list(dict.fromkeys(bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 25))) for _ in range(rng.randint(1, 8))))
        copies = np.array([rng.choice([1, 1, 2]) for _ in runs])
        window, step = rng.choice([(4, 2), (6, 3), (5, 1), (10, 2), (3, 3)])
        count = Counter()
        for r, n in zip(runs, copies):
            for i in range(len(r) - window + 1):
                count[r[i : i + window]] += n
        expected = [[i for i in range(len(r) - window + 1) if count[r[i : i + window]] > 1] for r in runs]
        assert [s.tolist() for s in repeats.repeated_starts(runs, copies, window, step, shard_bytes=10)] == expected


def test_simhash(docs):
    found = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert bag(found) == bag(plain.simhash(cases.rows()))


def test_bk_trees_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (60, 2))]))
    keys = (values % np.uint64(3)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    found = {(int(q), int(n)) for query, node in simhash.within(values, simhash.forest(keys, values), np.arange(len(values)), 2) for q, n in zip(query, node)}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if keys[i] == keys[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 2}


def test_near_copies(spark):
    rng = random.Random(11)
    base = [cases.prose(rng, 150, 5000) for _ in range(12)]
    data = list(enumerate(base))
    for i, text in enumerate(base[:6]):
        words = text.split()
        words[70] = "edited"
        data.append((100 + i, " ".join(words)))
    data += [(200, None), (201, ""), (202, None)]
    left = simhash.drop_near_copies(cases.table(spark, data, clashes=True))
    assert sorted(r.doc_id for r in left.collect()) == [*range(12), 200, 201, 202]


def shingle_jaccard(x, y, size=5):
    a, b = ({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} for words in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def test_near_copies_with_contiguous_edits(spark):
    rng = random.Random(17)
    data, pairs = [], 0
    for i in range(40):
        n = rng.randrange(100, 600)
        words, other = cases.prose(rng, n, 3000).split(), cases.prose(rng, n, 3000).split()
        copies = [words[: int(n * 0.83)], words + other[: int(n * 0.22)], words[: n // 2] + other[: n // 16] + words[n // 2 + n // 16 :]]
        data.append((i, " ".join(words)))
        for copy, edited in enumerate(copies):
            assert shingle_jaccard(data[-1 - copy][1], " ".join(edited)) >= 0.8
            data.append((1000 * (copy + 1) + i, " ".join(edited)))
            pairs += 1
    left = sorted(r.doc_id for r in simhash.drop_near_copies(cases.table(spark, data)).collect())
    assert pairs == 120 and left == list(range(40))


def test_near_copies_behind_nearer_bags(spark):
    """Rows with the words of others in another order, and a crowd that shares a band but not the similarity."""
    rng = random.Random(18)
    data = []
    for i in range(12):
        words = cases.prose(rng, 200, 3000).split()
        shuffled = [rng.sample(words, len(words)) for _ in range(3)]
        edited = words[:90] + [f"e{j}" for j in range(4)] + words[94:]
        data += [(100 * i + j, " ".join(w)) for j, w in enumerate([*shuffled, words, edited])]
    shared = cases.prose(rng, 150, 3000)
    crowd = [f"{shared} {cases.prose(rng, 50, 3000)}" for _ in range(30)]  # 0.6 alike
    data += [(5000 + j, text) for j, text in enumerate(crowd)] + [(6000 + j, text + " more words") for j, text in enumerate(crowd)]
    left = sorted(r.doc_id for r in simhash.drop_near_copies(cases.table(spark, data)).collect())
    assert left == sorted([100 * i + j for i in range(12) for j in range(4)] + [5000 + j for j in range(30)])


def test_near_copies_are_whole_components(spark):
    """Chains in which only neighbours are alike: one row of each connected group stays, also where the ends of a chain differ."""
    rng = random.Random(23)
    data = []
    for chain in range(8):
        words = cases.prose(rng, 240, 4000).split()
        for step in range(8):
            data.append((100 * chain + rng.randrange(1000) * 1000 + step, " ".join(words)))
            at = rng.randrange(200)
            words[at : at + 14] = cases.prose(rng, 14, 4000).split()
    root = {d: d for d, _ in data}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    links = [(a, b) for i, (a, x) in enumerate(data) for b, y in data[:i] if shingle_jaccard(x, y) >= 0.8]
    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    left = sorted(r.doc_id for r in simhash.drop_near_copies(cases.table(spark, data)).collect())
    assert left == sorted({top(d) for d, _ in data}) and len(left) < 20


@pytest.mark.parametrize("most", [30])
def test_links_of_a_crowd_grow_with_its_rows(spark, monkeypatch, most):
    """A crowd that shares a band but not the similarity, and a crowd of near copies, in shards of any size."""
    verified = []
    alike = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda links, sets, least: verified.append(links.count()) or alike(links, sets, least))
    counts = []
    for size in (60, 180):
        rng, verified[:] = random.Random(29), []
        shared, base = cases.prose(rng, 150, 3000), cases.prose(rng, 200, 3000)
        crowd = [f"{shared} {cases.prose(rng, 50, 3000)}" for _ in range(size)]  # 0.6 alike
        copies = [f"{base} tail{j}" for j in range(size)]
        data = list(enumerate(crowd)) + [(10_000 + j, text) for j, text in enumerate(copies)]
        gone = simhash.near_copies(cases.table(spark, data), most=most).count()
        assert gone == size - 1
        counts.append(sum(verified))
    assert counts[1] < 6 * counts[0] and counts[1] < 180 * 12


def test_components(spark):
    chain = spark.range(1, 300).selectExpr("id as a", "id - 1 as b")
    other = spark.createDataFrame([(1000, 1001), (1002, 1001), (5000, 5000)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(chain.unionByName(other), "a", "b").collect()}
    assert {roots[i] for i in range(300)} == {0} and roots[1002] == 1000 and 5000 not in roots


def test_pii_patterns():
    rng = random.Random(1)
    sets = ["0123456789" * 2 + " -.", "ab@.-+ ", "+1 ()-.0123456789", "@a.b1", "é٣ \n1"]
    for _ in range(5000):
        text = "".join(rng.choice(rng.choice(sets)) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain.pii(text)


def test_pii(spark, docs):
    found = Counter((r.doc_id, r.n_card, r.base_sha256, r.spans) for r in pii.find_pii(docs).collect())
    assert sum(found.values()) == len(cases.rows())
    card = "4111111111111111"
    texts = [f"pay {card} now, mail a{i}@b.org or +1 (555) 010-99{i:02d}, host 10.0.0.{i}, code {i}" for i in range(60)] + ["4111111111111111 4111111111111111", None, ""]
    rows = {r.doc_id: r for r in pii.find_pii(cases.table(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        base = plain.pii(text)
        assert rows[i].base_sha256 == plain.sha(pii.said(base).encode())
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(sum(k == kind for _, k, _ in base) for kind in range(4))
        assert set(pii.said(base).split(",")) <= set(rows[i].spans.split(",")) | {""}
    assert rows[60].spans == "card:0:16,card:17:33"  # two numbers side by side are no exact match; the field finds both


def test_skip_edges_carry_labels():
    field = pii.Field()
    field.add(0, "77@x.org and later 77@x.org")
    assert field.edges == [(0, 1, 1)]
    weights = (np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 2 * np.eye(pii.LABELS))
    shape = np.zeros((2, pii.FEATURES))
    shape[0, 1] = 1.0
    weights[0][1, 2] = 4.0  # only the first token has evidence
    p = pii.marginals(shape, np.array(field.edges), weights)
    assert p[1, 2] > 0.5 and p[0, 2] > p[1, 2]


def test_decontamination(spark, docs):
    rng = random.Random(6)
    item = cases.prose(rng, 40)
    words = item.split()
    edited = words[:10] + ["new"] + words[11:25] + words[26:]
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "tiny"), (5, "")], "item_id bigint, text string")
    data = [(i, cases.prose(rng, 80)) for i in range(30)] + [(40, f"{cases.prose(rng, 30)} {item} end"), (41, " ".join(edited)), (42, "so Tiny!"), (43, None), (44, " ".join(words[:8]))]
    rows = decontaminate.contaminated(cases.table(spark, data, clashes=True).drop("loc"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(40, 1), (40, 2), (41, 1), (41, 2), (42, 4)}
    score = {(r.doc_id, r.item_id): r.score for r in rows}
    assert score[40, 1] == 1.0 and score[41, 1] == pytest.approx(plain.align(words, edited) / (2 * len(words)))
    blocks = decontaminate.contaminated(cases.table(spark, data), bench, block_items=2).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == set(score)
    left = decontaminate.drop_contaminated(cases.table(spark, data, clashes=True), bench)
    assert sorted(r.doc_id for r in left.collect()) == [*range(30), 43, 44]


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(11)

    def edit(words, share):
        out = []
        for word in words:
            out += [word] if rng.random() >= share else rng.choice([[], [f"x{rng.randrange(10**6)}"], [word, f"y{rng.randrange(10**6)}"]])
        return out

    items = [cases.prose(rng, rng.randrange(20, 50)) for _ in range(24)] + [cases.prose(rng, n) for n in (4, 5, 6, 7)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    data = [(i, cases.prose(rng, 200)) for i in range(20)]
    for number, item in enumerate(items):
        words = item.split()
        texts = [edit(words, share) for share in (0.15, 0.2, 0.3)]
        texts.append([w for word in words for w in (word, "between")])
        texts.append(words[: len(words) // 2] + cases.prose(rng, len(words) // 2).split() + words[len(words) // 2 :])
        texts += [words] * 3 if number % 2 else []  # alone, and beside exact copies
        data += [(len(data) + i, f"{cases.prose(rng, 15)} {' '.join(text)} {cases.prose(rng, 15)}") for i, text in enumerate(texts)]
    expected = {}
    for doc, text in data:
        for number, item in enumerate(items):
            share = plain.align(item.split(), text.split()) / (2 * len(item.split()))
            if share >= decontaminate.THRESHOLD:
                expected[doc, number] = pytest.approx(share)
    found = decontaminate.contaminated(cases.table(spark, data), bench).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == expected
    assert len(expected) > 100


def test_alignment():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    regions = [rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64) for _ in range(40)]
    assert decontaminate.align(items, regions).tolist() == [plain.align(a.tolist(), b.tolist()) for a, b in zip(items, regions)]


def test_licenses(spark, docs):
    found = licenses.scan_licenses(docs)
    expected = [(d, *plain.licenses(t, licenses.BASE, licenses.TEMPLATES, licenses.THRESHOLD)) for d, t in cases.rows()]
    assert bag(found.collect()) == bag((d, *[tuple(v) if isinstance(v, list) else v for v in rest]) for d, *rest in expected)
    rng = random.Random(9)
    words = [w for _, text in licenses.TEMPLATES for w in text.split()] + ["the", "MIT", "License", "GNU", "é"]
    data = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(150)))) for i in range(60)]
    data += [(100, "Licensed under the Apache License, Version 2.0."), (101, licenses.TEMPLATES[7][1].upper()), (102, "CC-BY cc by nc 4.0 licensed under")]
    found = licenses.scan_licenses(cases.table(spark, data)).collect()
    expected = [(d, *plain.licenses(t, licenses.BASE, licenses.TEMPLATES, licenses.THRESHOLD)) for d, t in data]
    assert bag(found) == bag((d, *[tuple(v) if isinstance(v, list) else v for v in rest]) for d, *rest in expected)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    made = [
        exact_dedup.exact_groups(empty), sharding.shard_documents(empty), packing.pack_documents(empty), perplexity.classified(empty, labels),
        phrases.repeated_passages(empty), repeats.repeated_strings(empty), simhash.near_duplicates(empty), simhash.drop_near_copies(empty),
        pii.find_pii(empty), decontaminate.contaminated(empty, bench), licenses.scan_licenses(empty),
    ]
    assert [m.count() for m in made] == [0] * len(made)


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """The BK-trees of op7 bring copies together, also where no band of minima would."""
    monkeypatch.setattr(simhash, "shards", lambda prints, most, radius, plain=simhash.shards: plain(prints.withColumn("keys", F.transform("keys", lambda k: F.xxhash64(k, "rid"))), most, radius))
    rng = random.Random(31)
    base = [cases.prose(rng, 400, 5000) for _ in range(10)]
    data = list(enumerate(base)) + [(100 + i, text.upper() + " end") for i, text in enumerate(base)] + [(200, ""), (201, "")]
    left = sorted(r.doc_id for r in simhash.drop_near_copies(cases.table(spark, data)).collect())
    assert left == [*range(10), 200, 201]


def test_rows_of_a_crowd_are_joined_once(spark, monkeypatch):
    """Texts that are all a little less alike than near copies: each row meets its shards twice, whatever the number of pairs."""
    verified = []
    alike = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda links, sets, least: verified.append(links.count()) or alike(links, sets, least))
    for size in (40, 160):
        rng, verified[:] = random.Random(37), []
        shared = cases.prose(rng, 180, 3000)
        crowd = [f"{shared} {cases.prose(rng, 24, 3000)}" for _ in range(size)]
        assert 0.7 < shingle_jaccard(*crowd[:2]) < 0.8
        data = list(enumerate(crowd)) + [(10_000 + j, text + " end") for j, text in enumerate(crowd)]
        assert simhash.near_copies(cases.table(spark, data)).count() == size
        assert sum(verified) < 20 * 2 * size


def test_near_copies_leave_out_no_pair(spark):
    """Pairs at the similarity that share none of 20 bands of 5 minima of their shingles."""
    data = []
    for k, seed in enumerate((2206, 11374, 12900, 16030, 17910, 23609, 23953)):
        rng = random.Random(seed)
        words = cases.prose(rng, 49, 100000).split()
        data += [(k, " ".join(words)), (100 + k, " ".join(words[:44] + cases.prose(rng, 5, 100000).split()))]
        assert shingle_jaccard(data[-2][1], data[-1][1]) == 0.8
    left = sorted(r.doc_id for r in simhash.drop_near_copies(cases.table(spark, data)).collect())
    assert left == list(range(7))


@pytest.mark.parametrize("most", [4, 4096])
def test_near_copies_against_every_pair(spark, most):
    """Crowds on common passages, from half alike to copies, in shards of any size."""
    rng = random.Random(43)
    passages = [cases.prose(rng, 60, 300) for _ in range(3)]
    data = []
    for k in range(150):
        words = f"{passages[k % 3]} {cases.prose(rng, rng.randrange(6, 30), 300)}".split()
        data.append((k, " ".join(words)))
        for step in range(k % 3):
            at = rng.randrange(len(words) - 2)
            words[at : at + 2] = cases.prose(rng, rng.randrange(5), 300).split()
            data.append((1000 * (step + 1) + k, " ".join(words)))
    root = {d: d for d, _ in data}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(data):
        for b, y in data[:i]:
            if shingle_jaccard(x, y) >= 0.8:
                root[max(top(a), top(b))] = min(top(a), top(b))
    left = sorted(r.doc_id for r in simhash.drop_near_copies(cases.table(spark, data), most=most).collect())
    assert left == sorted({top(d) for d, _ in data}) and 20 < len(left) < len(data) - 20


def test_shingles_are_those_of_the_words():
    rng = random.Random(44)
    texts = [b"", b" \t", b"one", b"A b\nc\x0bd", "Été ünï ÇA x y z".encode(), *(cases.prose(rng, n, 9).upper().encode() for n in (5, 6, 80, 300))]
    names: dict[int, int] = {}
    for text, found in zip(texts, simhash.Shingles(5).of(texts)):
        plain = np.unique(simhash.shingle_hashes(text, 5)) if text.split() else []
        assert len(found) == len(plain)
        for word in range(len(text.split()) - 4):
            part = b" ".join(text.lower().split()[word : word + 5])
            (one,) = simhash.Shingles(5).of([part])
            assert one[0] in found and names.setdefault(int(one[0]), part) == part
