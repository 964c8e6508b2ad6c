import re

import numpy as np

from graphloom.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), failed)


TEXTS = [None, "", " \n\t", "one two", "a b c d e f a b c d e f g h i j k l m n o p", "é b\nc\nc\n\n\nc   x\x0b y # $ <",
         "Of the words that are in it, none is new.\nSo it goes on and on here.\n" * 2, "x " * 40_000, "THE!! DOG!! IS!! UP!! " * 3 + "one two three"]


def test_base_counts_against_brute_force():
    for t in TEXTS[:7] + TEXTS[8:]:
        assert q.measure(t)[0] == brute(t)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        e, t = rng.normal(size=n), rng.normal(size=(2, 2))
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        score = lambda p: sum(e[i] * p[i] for i in range(n)) + sum(t[a, b] for a, b in zip(p, p[1:]))
        assert q.viterbi(e, t).tolist() == max(paths, key=score)


def test_operator_and_edges(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string")
    got = q.judge(docs, q.PRIOR).orderBy("doc_id").collect()
    assert [tuple(r)[1:7] for r in got if r.doc_id != 7] == [brute(t) for i, t in enumerate(TEXTS) if i != 7]
    assert got[7].n_words == 40_000 and got[7].base_failed
    assert q.judge(docs.limit(0), q.PRIOR).count() == 0
    kept = q.keep_content(docs, q.PRIOR)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_learns_from_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = q.fit(docs, labels)
    both = q.judge(docs, model).join(labels, "doc_id").toPandas()
    clean, junk = both[both.quality == 1], both[both.quality == 0]
    assert clean.kept.mean() > 0.98 and junk.kept.mean() < 0.5
    assert q.fit(docs, labels.limit(0)) == q.PRIOR
    prior = q.judge(docs, q.PRIOR).join(labels, "doc_id").toPandas()
    assert prior[prior.quality == 1].kept.mean() > 0.98
    # lines put into good documents are told from those around them, and the chain has learned to stay
    weights, transition = np.asarray(model[0]), np.asarray(model[1])
    assert transition[1, 1] > transition[1, 0] and transition[0, 0] > transition[0, 1]
    rng, found, planted, wrong, own, shares = np.random.default_rng(4), 0, 0, 0, 0, []
    ads = ["home | cart | login | help |", "BUY NOW!! CLICK HERE!! GREAT DEAL!!", "*** ### $$$ *** %%% &&&", "MENU| NEWS| SHOP| ABOUT| CONTACT|"]
    for r in docs.join(labels.filter("quality = 1"), "doc_id").orderBy("doc_id").limit(400).collect():
        lines = [x for x in r.text.split("\n") if x.split()]
        if len(lines) >= 3:
            at, run = int(rng.integers(0, len(lines) + 1)), [ads[i] for i in rng.integers(0, 4, int(rng.integers(2, 5)))]
            _, rows, chars = q.measure("\n".join(lines[:at] + run + lines[at:]))
            got = q.viterbi(np.asarray(rows) @ weights, transition)
            found, planted = found + (got[at : at + len(run)] == 0).sum(), planted + len(run)
            rest = np.concatenate((got[:at], got[at + len(run) :]))
            wrong, own = wrong + (rest == 0).sum(), own + len(rest)
            shares.append(np.dot(got, chars) / sum(chars))
    assert planted > 200 and found >= 0.9 * planted and wrong <= 0.05 * own
    assert np.mean([0 < x < 1 for x in shares]) > 0.9


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(3)
    size = np.array([5, 4, 2, 1])
    x, y, share = rng.normal(size=(5, 4, 3)), rng.integers(0, 2, (5, 4)), rng.random(4)
    theta = rng.normal(size=7)
    _, grad = q.likelihood(theta, x, y, size, share)
    for i in range(7):
        step = np.eye(7)[i] * 1e-5
        want = (q.likelihood(theta + step, x, y, size, share)[0] - q.likelihood(theta - step, x, y, size, share)[0]) / 2e-5
        assert abs(want - grad[i]) < 1e-6
    # the likelihood itself, over all paths
    total = 0.0
    for d in range(4):
        e, t = x[: size[d], d] @ theta[:3], theta[3:].reshape(2, 2)
        score = lambda p: sum(a * b for a, b in zip(e, p)) + sum(t[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        paths = [[(k >> i) & 1 for i in range(size[d])] for k in range(2 ** size[d])]
        total += share[d] * (score(y[: size[d], d].tolist()) - np.log(sum(np.exp(score(p)) for p in paths)))
    assert abs(total - q.likelihood(theta, x, y, size, share)[0]) < 1e-9


def test_lines_that_recur_are_boilerplate_and_copies_are_left_out():
    row = lambda *hashes: (1, np.ones((len(hashes), 2)) * np.array(hashes)[:, None], np.array(hashes))
    sample = [row(1, 2, 3, 99), row(4, 5, 6, 99), row(7, 8, 9, 99), *[row(20, 21, 22, 23 + i) for i in range(4)], (0, np.zeros((2, 2)), np.array([50, 51]))]
    got = q.line_labels(sample)
    whole = {tuple(rows[:, 0].astype(int)): labels.tolist() for rows, labels, _ in got}
    assert whole[1, 2, 3, 99] == [1, 1, 1, 0] and not any(20 in k for k in whole) and whole[0, 0] == [0, 0]
    mixed = [(k, v) for k, v in whole.items() if 0 in k and len(k) > 2]
    assert len(mixed) == 3 and all(v[i] == 0 for k, v in mixed for i in range(len(k)) if k[i] == 0)
