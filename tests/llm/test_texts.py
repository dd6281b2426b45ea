import random
import re

import numpy as np
import pytest

from siftlake.llm import hashing, leakage, mixing, spans

WORD = re.compile("[A-Za-z0-9]+")


def brute_leaks(docs, items, least):
    grams = {}
    for i, t in items:
        w = [x.lower() for x in WORD.findall(t or "")]
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = [x.lower() for x in WORD.findall(t or "")]
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "GAMMA", "d3lta", "ü", "eps", "zeta"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n", " -- "]) for _ in range(n))
    items = [(i, text(rng.randrange(5, 40))) for i in range(12)] + [(50, None), (51, ""), (0, None)]
    items = [x for x in items if x != (0, None)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100, "x " + items[3][1].upper().replace(" ", "_") + " y"), (101, None), (102, ""), (103, "word " * 5000 + items[4][1])]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), min_words=9, k=4)
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute_leaks(docs, items, 9)
    for r in rows:
        d = [w.lower() for w in WORD.findall(dict(docs)[r.doc_id])]
        i = [w.lower() for w in WORD.findall(dict(items)[r.item_id])]
        assert d[r.doc_word : r.doc_word + r.n_words] == i[r.item_word : r.item_word + r.n_words] and r.n_words >= 9


def test_leaks_of_empty_tables_and_extra_columns(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string, h long"), spark.createDataFrame([(1, "a b c", "x")], "item_id long, text string, doc_id string")
    assert leakage.leaks(docs, items).count() == 0


def test_windows_hash_alike_wherever_they_stand():
    values = np.array([ord(c) for c in "abcXYabcZ"], np.uint32)
    s = hashing.prefix(values)
    a, b, c = hashing.span(s, np.array([0, 5, 1]), np.array([3, 8, 4]))
    assert a == b != c


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13, 17])
def test_difference_covers(q):
    v, d = spans.difference_cover(q)
    assert v == q * q + q + 1 and len(d) == q + 1 and {(i - j) % v for i in d for j in d} == set(range(v))


def brute_pairs(docs, n):
    out = set()
    docs = [(i, t) for i, t in docs if t is not None]
    grams = [(i, {t[k : k + n] for k in range(len(t) - n + 1)}) for i, t in docs]
    for x in range(len(grams)):
        for y in range(x):
            if grams[x][1] & grams[y][1]:
                out.add((min(grams[x][0], grams[y][0]), max(grams[x][0], grams[y][0])))
    return out


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh é\n😀") for _ in range(n))
    passages = [text(n) for n in (39, 40, 41, 60, 150)]
    docs = []
    for i in range(60):
        t = text(rng.randrange(0, 120))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            t += p[rng.randrange(0, 3) :] + text(rng.randrange(0, 30))
        docs.append((i, t))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, None), (103, ""), (104, "a" * 500), (105, "ba" + "a" * 300), (106, "short"), (107, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, classes = spans.shared_spans(df, min_chars=40)
    got = {(r.doc_a, r.doc_b) for r in spans.pairs_of_documents(pairs, classes, df, "doc_id", "text", 40).collect()}
    assert got == brute_pairs(docs, 40)
    texts = dict(docs)
    for r in pairs.collect():
        for s in r.spans:
            assert s.n_chars >= 40 and texts[r.a][s.start_a : s.start_a + s.n_chars] == texts[r.b][s.start_b : s.start_b + s.n_chars]
    part = {r.id: r for r in spans.shared_part(pairs, classes, df, "doc_id", "text").collect()}
    for i, t in docs:
        if t is None:
            continue
        others = [u for j, u in docs if j != i and u is not None and u != t]
        cover = set()
        for k in range(len(t) - 39):
            if any(t[k : k + 40] in u for u in others):
                cover |= set(range(k, k + 40))
        copies = sum(u == t for _, u in docs)
        assert part[i].n_copies == copies
        assert part[i].shared_chars == (len(t) if copies > 1 else len(cover)), i


def test_shared_spans_of_an_empty_table(spark):
    pairs, classes = spans.shared_spans(spark.createDataFrame([], "doc_id long, text string"))
    assert pairs.count() == 0 and classes.count() == 0


def test_flight_keeps_totals_and_lands():
    rng = random.Random(2)
    sizes = [float(rng.randrange(1, 900)) for _ in range(4000)]
    pi = [0.37] * 4000
    x = mixing.fly(list(range(4000)), sizes, pi, 11)
    assert sum(0 < p < 1 for p in x) <= 2
    assert abs(sum(x) - 0.37 * 4000) < 1e-6 and abs(sum(a * b for a, b in zip(x, sizes)) - 0.37 * sum(sizes)) < 1e-3
    y = mixing.land(sizes, x, 11)
    assert set(y) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(y, sizes)) - 0.37 * sum(sizes)) <= 900


def test_flight_is_unbiased():
    sizes, pi, hits = [1.0, 5.0, 9.0, 2.0, 7.0, 4.0], [0.3, 0.6, 0.5, 0.2, 0.8, 0.6], [0.0] * 6
    for seed in range(4000):
        for k, p in enumerate(mixing.fly(list(range(6)), sizes, pi, seed)):
            hits[k] += p / 4000
    assert all(abs(h - p) < 0.03 for h, p in zip(hits, pi))


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    rows = [(i, "a" if i % 3 else " B-c ", rng.randrange(1, 500)) for i in range(6000)] + [(6001, None, 5), (None, "a", 5), (6002, "other", 7)]
    df = spark.createDataFrame(rows, "id long, source string, n_tokens long")
    sized = df.withColumn("source", mixing.source_key(df.source))
    targets = spark.createDataFrame([("A", 0.5, 2), ("b_c", 0.3, 3), ("none", 0.2, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.mixing_plan(sized, targets)
    used = mixing.balanced_mix(sized, plan, block=500)
    assert {r.source: r.most_repeats for r in mixing.shares_reached(used, plan).collect()}["none"] == 0
    for r in mixing.shares_reached(used, plan).collect():
        want = {"a": 0.625, "b_c": 0.375, "none": 0.0}[r.source]
        assert abs(r.actual_share - want) < 0.003 and r.most_repeats <= r.max_repeats
    assert used.orderBy("id").collect() == mixing.balanced_mix(sized.repartition(7), plan, block=500).orderBy("id").collect()


def test_mix_of_nothing(spark):
    sized = spark.createDataFrame([], "id long, source string, n_tokens long")
    plan = mixing.mixing_plan(sized, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert mixing.balanced_mix(sized, plan).count() == 0 and mixing.shares_reached(mixing.balanced_mix(sized, plan), plan).first().actual_share == 0.0


def test_tokens_are_counted_whole(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x " * 20000), (5, "<|endoftext|>")], "doc_id long, text string")
    n = {r.id: r.n_tokens for r in mixing.count_tokens(docs, "doc_id", "text", []).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] >= 20000 and n[5] > 1


def test_a_passage_just_short_of_the_bound_makes_no_pairs(spark):
    """A third of all texts share 390 characters, a few others 400: only the latter come out, as brute force has it."""
    import random

    from siftlake.llm import spans

    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short, full = noise(390), noise(400)
    docs = [(i, noise(300) + short + noise(200) if i % 3 == 0 else noise(900)) for i in range(60)] + [(100 + i, noise(50 * i) + full + noise(30)) for i in range(12)] + [(200, None), (201, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, _ = spans.shared_spans(df)
    texts = {i: t for i, t in docs if t}
    grams = {i: {t[k : k + 400] for k in range(len(t) - 399)} for i, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and grams[a] & grams[b]}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) == 66


def test_a_document_that_many_items_hit(spark):
    from siftlake.llm import leakage

    items = [(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(40)]
    docs = [(1, " . ".join(t for _, t in items)), (2, " ".join(items[3][1].split()[5:20])), (3, " ".join(items[3][1].split()[5:19])), (4, None), (5, items[7][1] + " " + items[7][1])]
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_words) for r in found.collect()} == {(1, k, 30) for k in range(40)} | {(2, 3, 15), (5, 7, 30)}
