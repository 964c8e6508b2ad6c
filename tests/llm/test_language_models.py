import math
from collections import Counter, defaultdict

import numpy as np

from graphloom.llm import chars, kneser_ney, masked_lm


def brute_kn(trusted, order, codes):
    """p(key) by the recursive definition, over the same codes."""
    grams = [Counter() for _ in range(order + 1)]
    for t in trusted:
        line = [0] * (order - 1) + codes(t)
        grams[order].update(tuple(line[i : i + order]) for i in range(len(line) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k].update(g[1:] for g in grams[k + 1])
    ds = []
    for k in range(order + 1):
        n = [sum(a == i for a in grams[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        clip = lambda d, most: min(max(d, 0.1), most)
        ds.append([0, clip(1 - 2 * y * n[2] / n[1], 0.9) if n[1] else 0.5, clip(2 - 3 * y * n[3] / n[2], 1.9) if n[2] else 1.0, clip(3 - 4 * y * n[4] / n[3], 2.9) if n[3] else 1.5])
    by = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, a in grams[k].items():
            by[k][g[:-1]].append(a)

    def p(g):
        k = len(g)
        if not k:
            return 1 / chars.CODES
        own = by[k].get(g[:-1])
        if not own:
            return p(g[1:])
        d = lambda a: ds[k][min(a, 3)]
        a = grams[k].get(g, 0)
        return (a - d(a) if a else 0) / sum(own) + sum(map(d, own)) / sum(own) * p(g[1:])

    return p


def own_codes(letters):
    """Symbols of a text by the alphabet's definition, character by character."""
    code = {c: 1 + i for i, c in enumerate(letters.characters)}
    first = 1 + len(code)
    return lambda text: [x for c in text for x in ([code[ord(c)]] if ord(c) in code else [first + b for b in c.encode()] if letters.spelled else [first])]


TEXTS = {1: "the cat sat on the mat and the hat", 2: "a cat and a rat sat on that mat", 3: "the hat of the rat", 4: "xqz xqz ##", 5: "", 6: None, 7: "unseen Ωord the"}


def test_kneser_ney_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, 1) for i, t in TEXTS.items()] + [(1, TEXTS[1], "en", 1)], "doc_id long, text string, lang string, key int")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0), (3, None), (None, 1)], "doc_id long, quality int")
    codes = own_codes(chars.alphabet(docs))
    p = brute_kn([TEXTS[1], TEXTS[1], TEXTS[2], TEXTS[3]], 4, codes)
    total = sum(p((*codes("the"), c)) for c in range(chars.CODES))
    assert math.isclose(total, 1, rel_tol=1e-9)
    for bound in (10**6, 0):  # summed in place, and joined by a shuffle
        out = kneser_ney.classify(docs, labels, folds=0, broadcast_rows=bound).collect()
        assert len(out) == 8
        for r in out:
            t = TEXTS[r.doc_id] or ""
            if not t:
                assert r.log_perplexity is None and not r.kept
                continue
            line = [0, 0, 0] + codes(t)
            want = -sum(math.log(p(tuple(line[i : i + 4]))) for i in range(len(t))) / len(t)
            assert math.isclose(r.log_perplexity, want, rel_tol=1e-9)
    nothing = kneser_ney.classify(docs, labels.limit(0)).collect()
    assert {r.doc_id for r in nothing if r.kept} == {1, 2, 3, 4, 7}
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0


def test_kneser_ney_tells_junk_from_clean_text(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held_out = labels.filter("doc_id % 2 = 1")
    got = kneser_ney.classify(spark.read.parquet(f"{d}/documents.parquet"), labels.filter("doc_id % 2 = 0")).join(held_out, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.3


def test_window_keys_and_sums():
    letters = chars.Alphabet((ord("a"), ord("b")), True)
    keys, sizes = chars.windows(["ab", "", "bz"], letters, letters.table(), 2, 2)
    parts = [[int(k >> (chars.BITS * i)) & (chars.CODES - 1) for i in range(4, -1, -1)] for k in keys]
    z = 3 + ord("z")
    assert parts == [[0, 0, 1, 2, 0], [0, 1, 2, 0, 0], [0, 0, 2, z, 0], [0, 2, z, 0, 0]] and sizes.tolist() == [2, 0, 2]
    assert chars.summed_by_text(np.arange(4.0), sizes).tolist() == [1, 0, 5]


def test_characters_beyond_the_alphabet_are_spelled(spark):
    texts = ["aa bb", None, "Привет", "日本語 𐍈", "", "ñÿ\x00\x7f"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for own in (1, 4, 9, 200):
        letters = chars.alphabet(docs, own)
        assert letters.spelled == (own < 100) and len(letters.characters) == min(own, len({c for t in texts for c in t or ""}))
        found, sizes = chars.symbols([t or "" for t in texts], letters.table(), 1 + len(letters.characters))
        want = [own_codes(letters)(t or "") for t in texts]
        assert found.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want] and letters.size <= chars.CODES
    few = chars.Alphabet((ord("a"),), False)
    assert chars.symbols(["ab"], few.table(), 2)[0].tolist() == [1, 2] and few.size == 3


def test_scripts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(chars.alphabet, "__defaults__", (20,))  # as in a corpus of so many scripts that these letters have no codes
    latin = "the cat sat on the mat and a rat sat on that hat " * 3
    good, bad = "слово за слово идёт ", "воло сза воосл ётди "
    docs = spark.createDataFrame([(i, latin, "en") for i in range(20)] + [(30 + i, good * 5, "ru") for i in range(4)] + [(50, good * 3, "ru"), (51, bad * 3, "ru")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in [*range(20), 30, 31, 32, 33]], "doc_id long, quality int")
    lp = {r.doc_id: r.log_perplexity for r in kneser_ney.classify(docs, labels, folds=0).collect()}
    assert lp[51] > lp[50] + 1


def brute_pll(net, codes, text):
    """Sum of log-probabilities, position by position, from the network's definition."""
    line, total = [0, 0, *codes(text), 0, 0], 0.0
    for i in range(2, len(line) - 2):
        around = [line[i - 2], line[i - 1], line[i + 1], line[i + 2]]
        emb = [v for j, c in enumerate(around) for v in net["e"][j][c].tolist()]
        hidden = [math.tanh(sum(x * float(net["w1"][k][u]) for k, x in enumerate(emb)) + float(net["b1"][u])) for u in range(len(net["b1"]))]
        z = [sum(x * float(net["w2"][u][c]) for u, x in enumerate(hidden)) + float(net["b2"][c]) for c in range(len(net["b2"]))]
        total += z[line[i]] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))
    return total


def test_masked_lm_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "abab ab", "p"), (2, None, "p"), (3, "", "p"), (3, "b" * 50_000, "p"), (None, "ab", "p")], "doc_id long, text string, pll string")
    model = masked_lm.fit(docs, least_steps=20)
    codes = own_codes(model[0])
    rows = masked_lm.score(docs, model).collect()
    assert len(rows) == 5 and sorted(r.n_tokens for r in rows) == [0, 0, 2, 7, 50_000]
    for r in rows:
        if r.n_tokens in (2, 7):
            assert math.isclose(r.pll, brute_pll(model[1], codes, "ab" if r.n_tokens == 2 else "abab ab"), rel_tol=1e-4)
        assert r.n_tokens or r.pll == 0
    assert masked_lm.score(docs.limit(0), masked_lm.fit(docs.limit(0))).count() == 0


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(2)
    p = {k: x.astype(np.float64) for k, x in masked_lm.initial(7).items()}
    key = np.array([sum(int(c) << (chars.BITS * i) for i, c in enumerate(row)) for row in rng.integers(0, 7, (12, 5))], np.int64)
    w = rng.random(12)
    _, g = masked_lm.gradient(p, key, w)
    for k in masked_lm.NAMES:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            lo, hi = ({n: x.copy() for n, x in p.items()} for _ in range(2))
            lo[k][at] -= 1e-5
            hi[k][at] += 1e-5
            assert math.isclose((masked_lm.gradient(hi, key, w)[0] - masked_lm.gradient(lo, key, w)[0]) / 2e-5, g[k][at], rel_tol=1e-4, abs_tol=1e-7)


def test_all_windows_enter_the_training(spark, monkeypatch):
    counts = spark.createDataFrame([(i, 1 + i % 5) for i in range(900)], "key long, n long")
    seen = {}
    monkeypatch.setattr(masked_lm, "BATCH", 64)
    monkeypatch.setattr(masked_lm.Adam, "take", lambda self, keys, weights: [seen.__setitem__(int(k), seen.get(int(k), 0) + w) for k, w in zip(keys, weights)])
    batch = [b for b in counts.toArrow().to_batches()]
    list(masked_lm._trained(masked_lm.packed(masked_lm.initial(512)), 512, 0.01, 3.0, 1)(iter(batch)))
    assert seen.keys() == set(range(900)) and all(math.isclose(seen[i], 1 + i % 5) for i in seen)


def test_masked_lm_learns_held_out_text(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    letters, net = masked_lm.fit(d.filter("doc_id % 2 = 0"))
    held = d.filter("doc_id % 2 = 1")
    loss = lambda m: (lambda p: p.pll.sum() / p.n_tokens.sum())(masked_lm.score(held, m).toPandas())
    assert loss((letters, net)) > loss((letters, masked_lm.initial(letters.size))) + 1.5


def test_thresholds_take_all_trusted_documents_without_counts(spark):
    words = ["the cat", "a rat sat", "on that mat", "and the hat of it"]
    docs = spark.createDataFrame([(i, " ".join(words[(i * k) % 4] for k in range(1, 4)) + f" {i}", "rare" if i % 10 == 0 else "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    rows = kneser_ney.classify(docs, labels, trusted_docs=12).collect()
    # 40 trusted documents of the rare language, of which a few give counts: it has a threshold of its own
    assert len({r.threshold for r in rows}) == 2 and len({r.threshold for r in rows if r.lang == "rare"}) == 1
    trusted = docs.select(docs.doc_id.alias("trusted_id"), "lang")
    ids = [r.trusted_id for r in kneser_ney.sampled(trusted, 120).collect()]
    assert sum(i % 10 == 0 for i in ids) == 40 and 80 < len(ids) < 160  # 120 by chance
    assert kneser_ney.sampled(trusted, 400).count() == 400


def test_all_trusted_documents_give_counts_and_thresholds(spark):
    words = ["the cat", "a rat sat", "on that mat", "and the hat of it", "who knew"]
    texts = {i: " ".join(words[(i * k) % 5] for k in range(1, 4 + i % 3)) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in texts], "doc_id long, quality int")
    codes = own_codes(chars.alphabet(docs))

    def measure(text, p):
        line = [0, 0, 0] + codes(text)
        return -sum(math.log(p(tuple(line[i : i + 4]))) for i in range(len(text))) / len(text)

    rows = kneser_ney.classify(docs, labels).collect()
    p = brute_kn(texts.values(), 4, codes)
    assert all(math.isclose(r.log_perplexity, measure(texts[r.doc_id], p), rel_tol=1e-9) for r in rows) and len(rows) == 40
    fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {kneser_ney.FOLDS}) AS f").collect()}
    others = {f: brute_kn([t for i, t in texts.items() if fold[i] != f], 4, codes) for f in set(fold.values())}
    worst = max(measure(t, others[fold[i]]) for i, t in texts.items())  # 0.995 of 40 rows are all of them
    assert len(others) > 1 and {r.threshold for r in rows} == {(math.floor(worst * kneser_ney.BINS) + 1) / kneser_ney.BINS}
