import random

import numpy as np
import pytest

from quire.llm.leakage import RADIUS, Group, Passage, PassageIndex, _Windows, aligned_share, find_leaks, search, width_of, words

STOCK = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return " ".join(rng.choice(STOCK) for _ in range(n))


def indexed(texts, common=frozenset(), least_share=0.5):
    tokens = [words(t) for t in texts]
    pairs = [set(zip(t, t[1:])) for t in tokens]
    return PassageIndex([Passage(i, t, [sum(p in q for q in pairs) for p in zip(t, t[1:])]) for i, t in enumerate(tokens)], common, least_share)


def test_candidates_equal_brute_force():
    rng = random.Random(2)
    prints = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    owners = np.arange(300) // 3
    flips = [sum(1 << b for b in rng.sample(range(64), n)) for n in (0, 3, 7, 10, 11, 12, 14) for _ in range(60)]
    probe = np.array([int(rng.choice(prints)) ^ f for f in flips] + [rng.getrandbits(64) for _ in range(300)], np.uint64)
    at, owner = _Windows(prints, owners).candidates(probe)
    near = np.bitwise_count(probe[:, None] ^ prints[None, :]) <= RADIUS
    assert set(zip(at.tolist(), owner.tolist())) == {(int(i), int(owners[j])) for i, j in zip(*np.nonzero(near))} and len(at) > 290


def test_widths():
    assert [width_of(n) for n in (1, 4, 12, 16, 24, 31, 50, 100, 147, 400)] == [1, 1, 3, 4, 6, 6, 12, 24, 32, 96]


def test_shares():
    a = words("one two three four five six seven eight nine ten")
    assert aligned_share(a, a) == 1.0 and aligned_share(a, ["zero", *a[:5], "x"]) == 0.5
    assert aligned_share(a, [*a[:4], "changed", *a[5:]]) == 1.0
    assert aligned_share(a, [*a[:3], *["gap"] * 50, *a[3:6]]) == 0.3
    assert aligned_share(a, a[::-1]) < 0.3


def test_verification_loses_nothing():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(2, 90)
        item = [rng.choice(STOCK) for _ in range(n)]
        index = indexed([" ".join(item), passage(rng, 60), " ".join(item[: n // 2 + 1])])
        at = rng.randrange(n)
        part = [rng.choice(STOCK) if rng.random() < rng.choice((0, 0.2, 0.4)) else w for w in item[at // 2 :]]
        stretch = words(passage(rng, 20)) + part + words(passage(rng, 20))
        if aligned_share(item, stretch) >= 0.5:
            assert index.verified(0, index.shingles_in(0, stretch))


@pytest.mark.parametrize("many", [1, 2, 5, 20, 100])
def test_part_that_many_passages_share(many):
    rng = random.Random(8)
    shared = passage(rng, 48)
    index = indexed([f"{shared} {passage(rng, 32)}" for _ in range(many)])
    found = {item: share for _, item, share, _ in search(index, Group([f"{passage(rng, 70)} {shared} {passage(rng, 70)}"], frozenset()))}
    assert set(found) == set(range(many)) and min(found.values()) >= 0.6


@pytest.mark.parametrize("every", [5, 6, 7, 8, 9, 12])
@pytest.mark.parametrize("part", [1.0, 0.6])
def test_recall_with_changed_words(every, part):
    rng = random.Random(every)
    texts = [passage(rng, rng.randint(50, 140)) for _ in range(60)]
    index, found, wanted = indexed(texts), 0, 0
    for i, text in enumerate(texts):
        ws = text.split()
        n = int(len(ws) * part)
        at = rng.randrange(len(ws) - n + 1)
        own = [f"new{j}" if j % every == every - 1 else w for j, w in enumerate(ws[at : at + n])]
        doc = f"{passage(rng, rng.randint(10, 60))} {' '.join(own)} {passage(rng, 40)}"
        if aligned_share(ws, doc.split()) >= 0.5:
            wanted += 1
            found += any(item == i for _, item, _, _ in search(index, Group([doc], frozenset())))
    assert wanted > 50 and found >= 0.9 * wanted


def test_repeated_passage_is_cheap():
    rng = random.Random(9)
    text = passage(rng, 60)
    assert [(d, i) for d, i, _, _ in search(indexed([text]), Group([" ".join([text] * 400)], frozenset()))] == [(0, 0)]


def test_operator(spark):
    rng = random.Random(5)
    items = [(i, passage(rng, rng.randint(40, 90))) for i in range(40)]
    docs, want = [], set()
    for d in range(150):
        body = [passage(rng, rng.randint(0, 60))]
        if d % 3 == 0:
            i, text = items[d % 40]
            ws = text.split()
            share = rng.choice((0.3, 0.7, 1.0))
            n = int(len(ws) * share)
            at = rng.randrange(len(ws) - n + 1)
            part = ws[at : at + n]
            if n > 30:
                part[n // 2] = "changed"
            body.append(",\n".join(part).upper())
            if share >= 0.7:
                want.add((i, d))
        body.append(passage(rng, rng.randint(0, 60)))
        docs.append((d, ". ".join(body), 1))
    docs += [(900, None, 1), (901, "", 1), (902, items[3][1] + " filler" * 60_000, 1), (903, items[3][1], 1), (903, items[3][1], 1)]
    want |= {(3, 902), (3, 903)}
    df = spark.createDataFrame(docs, "doc_id long, text string, share int")
    it = spark.createDataFrame([*items, (98, None), (99, ""), (97, "too short")], "item_id long, passage string")
    got = find_leaks(df, it)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == want
    assert got.filter("doc_id = 903").count() == 2
    assert find_leaks(df.limit(0), it).count() == 0 and find_leaks(df, it.limit(0)).count() == 0


def test_blocks_of_passages_change_nothing(spark):
    rng = random.Random(6)
    shared = passage(rng, 30)
    items = [(i, f"{shared} {passage(rng, 25)}") for i in range(12)] + [(3, shared)]
    df = spark.createDataFrame([(i, f"{passage(rng, 30)} {t}") for i, t in items], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, passage string")
    whole = sorted(map(tuple, find_leaks(df, it).collect()))
    assert len(whole) >= 144 and whole == sorted(map(tuple, find_leaks(df, it, block_words=60).collect()))


def test_changed_words_around_a_common_window(spark):
    common = [f"c{i}" for i in range(8)]
    item = [*common, *(f"a{i}" for i in range(72))]
    items = [(0, " ".join(item)), *((i, " ".join([*common, *(f"b{i}x{j}" for j in range(40))])) for i in range(1, 30))]
    part = item[:44]
    for at in range(10, 44, 4):  # no shingle outlives this, but most words do
        part[at] = "changed"
    df = spark.createDataFrame([(7, "before it " + " ".join(part) + " after it")], "doc_id long, text string")
    got = find_leaks(df, spark.createDataFrame(items, "item_id long, passage string")).collect()
    assert [(r.item_id, r.doc_id) for r in got] == [(0, 7)]
    assert got[0].share >= 0.5 and got[0].shingles < 0.5
