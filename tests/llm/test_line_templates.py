from graphloom.llm import line_templates as lt


import re
from collections import Counter, defaultdict


def brute(docs, min_docs=None, general=True):
    """Each document's remaining text, by the docstring's definition on tokens themselves."""
    exact_docs, long_docs, form_docs = (lt.MIN_DOCS, lt.LONG_DOCS, lt.FORM_DOCS) if min_docs is None else (min_docs,) * 3
    lines = []  # id, position, text, tokens
    for doc_id, text in docs:
        for pos, line in enumerate((text or "").split("\n")):
            tokens = tuple(re.sub("[0-9]+", "<*>", line).split())
            if tokens:
                lines.append((doc_id, pos, text, tokens))
    texts = defaultdict(set)
    for _, _, text, tokens in lines:
        texts[tokens].add(text)
    template = {t: t for t, x in texts.items() if len(x) >= (long_docs if len(t) >= lt.LONG_TOKENS else exact_docs)}
    fields = {}
    for t in texts if general else ():
        rest = len(t) - lt.DEPTH
        if len(t) >= lt.FORM_TOKENS:
            k = min(rest, lt.RUNS)
            lead = tuple("<*>" if "<*>" in x else x for x in t[: lt.DEPTH])
            fields[t] = [(len(t), lead, i, t[lt.DEPTH + rest * i // k : lt.DEPTH + rest * (i + 1) // k]) for i in range(k)]
    often = Counter(x for own in fields.values() for x in own)
    form = {}
    for t, own in fields.items():
        constant = tuple(x for x in own if often[x] >= lt.FORM_LINES)
        variable = len(own) - len(constant)
        if variable and (variable <= max(1, len(t) // 5) if len(t) - lt.DEPTH <= lt.RUNS else 2 * variable <= lt.RUNS):
            form[t] = (own[0][:2], constant)
    size, where = Counter(form.values()), defaultdict(set)
    for t, f in form.items():
        where[f] |= texts[t]
    template |= {t: f for t, f in form.items() if size[f] >= lt.FORM_LINES and len(where[f]) >= form_docs}
    found, drop = defaultdict(list), defaultdict(set)
    for doc_id, pos, _, tokens in lines:
        if tokens in template:
            found[template[tokens]].append((doc_id, pos))
    for places in found.values():
        for d, p in places:
            if (d, p) != min(places):
                drop[d].add(p)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop[d]) for d, t in docs}


def test_masked_lines_against_brute_force(spark):
    docs = [(i, f"own words number {'abcdefgh'[i]} here\nposted on day {i} at noon\n\nshort {i}\nall rights are reserved" + "\nposted on day 7 at noon" * (i % 2)) for i in range(8)]
    docs += [(8, None), (9, ""), (10, "x y z " * 30_000 + "\nall rights are reserved"), (11, "copied text of one line"), (12, "copied text of one line"), (13, "copied text of one line")]
    df = spark.createDataFrame([(a, b, "s", 1) for a, b in docs], "doc_id long, text string, line string, n int")
    for n in (3, 8, 20):
        got = lt.drop_recurring_lines(df, min_docs=n)
        assert got.columns == [*df.columns, "__n_lines", "__n_dropped"]
        rows = {r.doc_id: r for r in got.collect()}
        want = brute(docs, n)
        assert {d: r.text for d, r in rows.items()} == want
        assert sum(r["__n_dropped"] for r in rows.values()) == sum((t or "").count("\n") - (want[d] or "").count("\n") for d, t in docs)


def test_general_forms_with_word_fields(spark):
    fields = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    docs = [(i, f"some own line of doc {w}{w}\nThe user named {w} has joined the group today and may now read all posts") for i, w in enumerate(fields)]
    docs.append((9, "The user named somebody went away from here because it was late and quite dark outside"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lt.drop_recurring_lines(df, min_docs=4).collect()}
    # "user named": the leaf's third leading token differs from none; only the first document keeps the line
    assert got[0].count("\n") == 1 and got[9] == docs[-1][1]
    assert [got[i].count("\n") for i in range(1, 6)] == [0] * 5


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "a line with words\nx"), (1, "a line with words\ny"), (1, "a line with words\ny"), (2, "a line with words\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in lt.drop_recurring_lines(df, min_docs=3).collect())
    assert got == [(0, "a line with words\nx"), (1, "y"), (1, "y"), (2, "z")]
    assert lt.drop_recurring_lines(df.limit(0)).count() == 0


def test_short_lines_and_lines_of_few_texts_recur(spark):
    passage = " ".join(f"word{'abcdefgh'[i % 8]}{'xyz' * (i % 5)}" for i in range(60))
    docs = [(i, f"text {w} of its own\nLes.\nAll rights reserved.\n \n{w}") for i, w in enumerate(["one", "two", "three"])]
    docs += [(8, f"begin\n{passage}"), (9, f"end\n{passage}\nin two texts only"), (10, "in two texts only")]
    got = {r.doc_id: r.text for r in lt.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and got[1] == "text two of its own\n \ntwo" and got[2] == "text three of its own\n \nthree"
    assert got[8] == docs[3][1] and got[9] == "end\nin two texts only" and got[10] == "in two texts only"


def test_several_forms_in_a_leaf_against_brute_force(spark):
    names, days = ["ann", "bob", "cy", "dee", "eve", "fay", "gus", "hal"], ["monday", "friday"]
    docs = []
    for i, w in enumerate(names):
        docs.append((i, f"only {w}\nPlease log in as {w} to read more\nPlease log in with {w} to write more\nposted by {w} on {days[i % 2]}\nPlease log quite other words than those"))
    docs += [(20, "Please log into some system of ours now"), (21, "posted by nobody at all"), (22, None), (23, "")]
    docs.append((24, "A line of many words, of which " + "this " * 12 + "ends " + "here " * 12))
    docs += [(30 + i, f"A line of many words, of which {x} is the one that varies, while all the others are as they are in {i % 3} texts") for i, x in enumerate(names)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (4, 9, 100):
        got = {r.doc_id: r.text for r in lt.drop_recurring_lines(df, min_docs=n).collect()}
        assert got == brute(docs, n)
        if n == 4:
            assert got[1] == "only bob\nposted by bob on friday" and got[2] == "only cy" and got[20] and got[21]


def test_hot_lines_meet_their_templates_over_salted_keys(spark, monkeypatch):
    from graphloom.llm import shared

    docs = [(i, f"same line in all of them\nown {'abcdefgh'[i % 8] * (i // 8 + 1)}\nvisit no {i} of {'xyzuvw'[i % 6]} today") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(shared.meet, "__kwdefaults__", {"broadcast_rows": -1})
    got = {r.doc_id: r.text for r in lt.drop_recurring_lines(df).collect()}
    assert got == brute(docs)


def test_columns_with_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(1, "a b\nc", 5, "h", [1])], "doc_id long, text string, `__h` int, `row` string, lines array<int>")
    got = lt.drop_recurring_lines(df)
    assert got.columns == [*df.columns, "__n_lines", "__n_dropped"] and tuple(got.first()) == (1, "a b\nc", 5, "h", [1], 2, 0)
