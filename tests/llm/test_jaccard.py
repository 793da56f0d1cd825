"""Near duplicates against the exact similarity of all pairs."""

import random

import numpy as np

from corvane.llm import jaccard, simhash


def brute_force(texts, similarity=0.8):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return dict(enumerate(label))


def edited(rng, words, edits):
    copy = list(words)
    for k in rng.sample(range(1, len(words) // 5 - 1), edits):  # edits far apart: five shingles each
        copy[5 * k + 2] = f"e{rng.random()}"
    return copy


def components(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}


def test_links_below_the_similarity_do_not_count(spark):
    rng, texts = random.Random(3), []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(304)]
        texts += [" ".join(base), " ".join(edited(rng, base, 8))]  # 260 of 340 shingles: 0.765
    assert components(spark, texts) == brute_force(texts) == {i: i for i in range(len(texts))}


def test_set_components_by_brute_force():
    rng, texts = random.Random(5), []
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(204)]
        for _ in range(rng.randrange(1, 9)):
            base = base if rng.random() < 0.5 else edited(rng, base, rng.randrange(1, 7))
            texts.append(" ".join(edited(rng, base, rng.randrange(6))))
    texts, kept = list(dict.fromkeys(texts)), {}
    want = brute_force(texts)
    label = jaccard.set_components([simhash.shingle_set(t, 5) for t in texts], 0.8).tolist()
    for i, x in enumerate(label):
        kept.setdefault(x, i)
    assert {i: kept[x] for i, x in enumerate(label)} == want and 12 < len(set(want.values())) < len(texts)
    assert jaccard.set_components([np.empty(0, np.uint64), np.arange(3, dtype=np.uint64)], 0.8).tolist() == [0, 1]


def test_no_link_at_the_similarity_is_lost(spark, monkeypatch):
    rng, texts = random.Random(7), []
    for _ in range(100):
        base = [f"w{rng.randrange(5000)}" for _ in range(364)]
        texts += [" ".join(base), " ".join(edited(rng, base, 8))]  # 320 of 400 shingles: just 0.8
    want = {i: i - i % 2 for i in range(len(texts))}
    assert brute_force(texts) == want
    for shingles in (1 << 21, 3000):  # one part, and many
        monkeypatch.setattr(jaccard, "PART_SHINGLES", shingles)
        assert components(spark, texts) == want


def test_sets_are_compared_by_their_fingerprints(spark, monkeypatch):
    rng, texts = random.Random(9), []
    for _ in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(364)]
        texts += [" ".join(base), " ".join(edited(rng, base, 8))]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    assert jaccard.set_components(sets, 0.8).tolist() == [i - i % 2 for i in range(40)]
    monkeypatch.setattr(jaccard, "print_radius", lambda similarity: 0)  # no two fingerprints are near
    assert jaccard.set_components(sets, 0.8).tolist() == list(range(40))
    assert components(spark, texts) == {i: i for i in range(40)}


def test_no_set_at_the_similarity_is_beyond_the_radius():
    rng, radius, far = np.random.default_rng(2), simhash.print_radius(0.8), []
    for shared, a, b in ((4, 0, 1), (12, 1, 2), (16, 2, 2), (320, 40, 40)):  # all just 0.8
        for _ in range(500):
            x = rng.permutation(np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)))
            one, other = x[: shared + a], np.concatenate((x[:shared], x[shared + a : shared + a + b]))
            prints = [simhash.set_fingerprint(s) for s in (one, other, x[400:])]
            bits = [sum(int(v).bit_count() for v in prints[0] ^ p) for p in prints[1:]]
            assert bits[0] <= radius
            far.append(bits[1] > radius)
    assert np.mean(far) > 0.99 and simhash.print_radius(1.0) == 0


def test_large_and_many_groups_by_brute_force(monkeypatch):
    rng, texts, groups = random.Random(6), [], []
    for group in range(6):
        own = []
        for _ in range(4):
            base = [f"w{rng.randrange(300)}" for _ in range(204)]
            for _ in range(rng.randrange(1, 9)):
                base = base if rng.random() < 0.5 else edited(rng, base, rng.randrange(1, 7))
                own.append(" ".join(edited(rng, base, rng.randrange(6))))
        own = list(dict.fromkeys(own))
        texts += own
        groups += [group] * len(own)
    sets = [simhash.shingle_set(t, 5) for t in texts]
    want = brute_force(texts)
    for rows in (256, 3):  # rows beyond which a group takes pivots
        monkeypatch.setattr(simhash, "LARGE_GROUP", rows)
        label, kept = jaccard.set_components(sets, 0.8, np.array(groups)).tolist(), {}
        for i, x in enumerate(label):
            kept.setdefault(x, i)
        assert {i: kept[x] for i, x in enumerate(label)} == want and 6 < len(kept) < len(texts)


def test_adder_tree_counts_as_the_bits_do():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, (70, 4), dtype=np.uint64)
    prints[1::2] = prints[::2] ^ (prints[1::2] & prints[::-2] & np.roll(prints[::2], 1, axis=0))
    planes = simhash.BitPlanes(prints)
    for radius in (0, 31, 64, 103, 127, 255, 256):
        for row in (0, 13, 69):
            assert planes.near(row, radius).tolist() == [i for i in range(70) if sum(int(v).bit_count() for v in prints[i] ^ prints[row]) <= radius]
        assert planes.within(9, radius).tolist() == [i for i in range(61) if sum(int(v).bit_count() for v in prints[i] ^ prints[i + 9]) <= radius]
