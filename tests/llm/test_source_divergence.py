import os
import re
from collections import Counter, defaultdict

import duckdb

from graphloom.llm import ascii_words, source_divergence
from graphloom.llm.source_divergence import OP11_SQL, divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, lang string, source string, text string, term string, p long"


def brute(rows, min_docs, top=10):
    """rows: lang, source, text."""
    seen, count, groups = defaultdict(set), Counter(), set()
    for k, (lang, source, text) in enumerate((a or "", b or "", c or "") for a, b, c in rows):
        groups.add((lang, source))
        for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOWER)):
            seen[lang, w].add(k)
            count[lang, source, w] += 1
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g for g, _ in groups}:
        terms, sources = [w for (g, w), s in seen.items() if g == lang and len(s) >= min_docs], [s for g, s in groups if g == lang]
        p = {}
        for s in [*sources, None]:
            n = {w: sum(count[lang, x, w] for x in ([s] if s is not None else sources)) for w in terms}
            p[s] = {w: 1 + 10**9 * (c + 2) // (sum(n.values()) + 2 * len(terms)) for w, c in n.items()}
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[x][w]) for w in terms), x.encode(), x) for x in sources if x != s)
            own = sorted((-f(p[s][w], p[None][w]), w.encode(), w) for w in terms if count[lang, s, w] and p[s][w] > p[None][w])[:top]
            out += [(lang, s, "pair", x, -v, i) for i, (v, _, x) in enumerate(pairs, 1)] + [(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(own, 1)]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat. THE cat's é́ Éa 123 x_y"), ("en", "a", "the dog the dog the"), ("en", "b", "a cat and the dog"), ("en", "c", None), ("en", "b", "the the the cat"), ("en", None, "dog 日本 the"),
    ("de", "a", ""), ("de", "b", "der die das"), (None, "a", "der"), (None, None, "der"), ("fr", "only", "le le la"), ("en", "a", "The cat. THE cat's é́ Éa 123 x_y"), ("en", "z", "x" * 3000 + " cat" * 500),
]


def test_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(i, a, b, t, "clash", 7) for i, (a, b, t) in enumerate(ROWS)], SCHEMA)
    for min_docs in (1, 2, 100):
        assert sorted(map(tuple, divergence(docs, min_docs=min_docs).collect())) == brute(ROWS, min_docs)
    monkeypatch.setattr(source_divergence, "meet", lambda *a, **b: __import__("graphloom.llm.shared", fromlist=["meet"]).meet(*a, **b, broadcast_rows=0))
    assert sorted(map(tuple, divergence(docs, min_docs=1).collect())) == brute(ROWS, 1)  # over salted keys


def test_empty_table_and_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([], SCHEMA)
    assert divergence(docs).count() == 0
    letters = ascii_words.table(ascii_words.LETTERS)
    text = "aB" * 5 + " é1x " * 7
    whole = [w for p in ascii_words.words(text, letters) for w in p]
    monkeypatch.setattr(ascii_words, "PIECE", 3)
    assert [w for p in ascii_words.words(text, letters) for w in p] == whole == [b"ab" * 5] + ["é".encode(), b"x"] * 7


def test_sql_says_the_same_of_null_rows(spark, tmp_path):
    rows = [(i, *ROWS[i % len(ROWS)]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(tmp_path, 'documents', '*.parquet')}'")
    assert sorted(con.sql(OP11_SQL).fetchall()) == sorted(map(tuple, divergence(docs).collect())) == brute([r[1:] for r in rows], 10)
