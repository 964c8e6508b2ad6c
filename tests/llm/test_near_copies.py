import random

import numpy as np

import corpus_pipeline
from graphloom.llm import near_copies
from tests.llm.test_simhash import brute_fp


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """Smallest index of each text's component over all pairs with a Jaccard of 0.8 or more."""
    sets = [shingle_set(t) for t in texts]
    label, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[j] < label[i] and (len(a & b) >= 0.8 * len(a | b)):
                    label[i], changed = label[j], True
    return label


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "One two", "one TWO", "one two three"]
    for n in (12, 60, 300):
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        texts += [" ".join(edited(base, rng, rng.randint(0, n // 30 + 1))) for _ in range(14)]
        for _ in range(8):  # a chain, of which the ends are no pair
            base = edited(base, rng, max(1, n // 60))
            texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    want = brute_groups(texts)
    assert [got[i] for i in range(len(texts))] == want and 8 < len(set(want)) < len(texts) - 20
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_prefixes_meet_for_all_pairs_that_are_alike(spark):
    rng = random.Random(7)
    base = rng.sample(range(-(10**6), 10**6), 120)
    sets = [(0, 0, [5])] + [(i, i, sorted({rng.randrange(10**6) if rng.random() < share else v for v in base[: rng.randint(80, 120)]})) for i, share in enumerate([0.02, 0.1, 0.16] * 14, 1)]
    same = [(100, 7, sets[4][2]), (101, 8, sets[4][2])]  # equal shingles, all of them shared
    got = {(r.a, r.b) for r in near_copies.prefix_pairs(spark.createDataFrame(sets + same, "name long, c long, own array<long>")).collect()}
    both = [((a, b), len({*x} & {*y}) / len({*x} | {*y})) for a, c, x in sets + same for b, d, y in sets + same if a < b and c != d]
    assert {p for p, j in both if j >= 0.8} <= got and (100, 101) in got
    assert sum(j >= 0.8 for _, j in both) > 20 and len(got) < len(both) / 2


def test_stage_drops_near_copies_beyond_three_bits(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = [(5, " ".join(base)), (3, " ".join(edited(base, rng, 3))), (8, " ".join(edited(base, rng, 3))), (1, " ".join(f"v{i}" for i in range(200))), (None, " ".join(base))]
    docs = spark.createDataFrame([(a, b, len(b)) for a, b in rows], "doc_id long, text string, name int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_parity_sketches_never_tell_more_than_the_sets_differ():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 4000, np.uint64)
    for n in (1, 30, 400, 3000):
        for share in (0.0, 0.05, 0.5):
            a = np.unique(rng.choice(pool, n))
            b = np.unique(np.r_[a[rng.random(len(a)) >= share], rng.choice(pool, int(n * share))])
            bits = sum(int(x).bit_count() for x in (near_copies.parity(a) ^ near_copies.parity(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b)) and (bits > 0 or share < 0.5 or n == 1)


def test_a_crowded_shingle_is_dealt_to_several_tasks(spark, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(near_copies, "MEETING", 4)
    base = list(range(100))
    sets = [(i, i, sorted(base[: 100 - i % 9] + [1000 * i + k for k in range(i % 9 + rng.randint(0, 20))])) for i in range(1, 60)]
    found = {(r.a, r.b) for r in near_copies.prefix_pairs(spark.createDataFrame(sets, "name long, c long, own array<long>")).collect()}
    alike = {(a, b) for a, _, x in sets for b, _, y in sets if a < b and len({*x} & {*y}) >= 0.8 * len({*x} | {*y})}
    assert alike <= found and len(alike) > 100


def test_stage_drops_what_simhash_links_and_what_only_shingles_tell(spark):
    rng = random.Random(5)
    often, base = "one line that comes again and again " * 60, [f"w{rng.randrange(900)}" for _ in range(200)]
    ends = [" ".join(f"{c}{i}" for i in range(9)) for c in "pq"]
    texts = {6: often + ends[0], 4: often + ends[1], 9: " ".join(base), 2: " ".join(edited(base, rng, 4)), 7: " ".join(edited(base[:60], rng, 25))}
    fp = {i: brute_fp(t) for i, t in texts.items()}
    near = lambda a, b: len(shingle_set(texts[a]) & shingle_set(texts[b])) / len(shingle_set(texts[a]) | shingle_set(texts[b]))
    assert (fp[6] ^ fp[4]).bit_count() <= 3 and near(6, 4) < 0.8 and (fp[9] ^ fp[2]).bit_count() > 3 and near(9, 2) >= 0.8
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [2, 4, 7]
