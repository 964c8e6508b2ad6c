import hashlib
import re

from graphloom.llm import fingerprints as fp


def brute(rows):
    """rows: (doc_id, text), in order."""
    texts = [t or "" for _, t in rows]
    pieces = lambda t: set(re.findall(fp.PATTERN, t))
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i, (d, _) in enumerate(rows):
        t, after = texts[i], texts[(i + 1) % len(texts)]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        yield d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(pieces(t), pieces(edited)), 9), round(like(pieces(t), pieces(after)), 9)


def test_against_brute_force(spark):
    line = lambda i: f"Line é{i} says that {i * i % 97} things. It goes on. Then more of it! " * 3
    rows = [(None, "null id")] + [(i * i, "\n".join(line(j % (i + 3)) for j in range(i))) for i in range(24)]
    rows += [(1000, ""), (1001, None), (1002, "same text. " * 9), (1003, "same text. " * 9), (1004, "\n".join(f"{j} words" for j in range(600))), (1004, "zz repeated id"), (1004, "zz repeated id")]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, r string, rn int")
    for ranges, first in ((50, 40), (2, 4)):
        out = fp.likeness(docs, range_rows=ranges, first_cells=first).collect()
        got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out), key=str)
        assert got == sorted(brute(rows), key=str)
        prints = {r.doc_id: r.fingerprint for r in out}
        assert prints[1002] == prints[1003] and prints[1000] == prints[1001] and prints[1] != prints[4]


def test_recovers_the_differing_digests(spark):
    kept = spark.createDataFrame([(0, 1, list(range(100)), list(range(50, 120)), []), (0, 2, [5, 6], [6, 5], [5, 6]), (1, 1, [], [9], [])], "r long, rn int, own array<long>, edit array<long>, next array<long>")
    got = {}
    for part in fp.differences(kept, first_cells=2):
        for row in part.collect():
            assert (row.r, row.rn, row.kind) not in got
            got[row.r, row.rn, row.kind] = {(x.digest, x.side) for x in row.found}
    assert got == {(0, 1, 0): {(i, 1) for i in range(50)} | {(i, -1) for i in range(100, 120)}, (0, 1, 1): {(i, 1) for i in range(100)}, (1, 1, 0): {(9, -1)}}


def test_two_stored_sketches_are_enough(spark, tmp_path):
    versions = {"old": [(1, list(range(400))), (2, [7])], "new": [(1, [i for i in range(406) if i % 80]), (2, [7])]}
    for name, rows in versions.items():
        fp.sketched(spark.createDataFrame(rows, "id long, digests array<long>"), 40, ["id"]).write.parquet(str(tmp_path / name))
    read = {name: spark.read.parquet(str(tmp_path / name)) for name in versions}
    signed = read["old"].selectExpr("id", "1 AS sign", "cell", "n", "x", "c").union(read["new"].selectExpr("id", "-1 AS sign", "cell", "n", "x", "c"))
    rows = fp.peel(fp.subtracted(signed, ["id"]), 40, ["id"]).collect()
    assert [(r.id, r.rest) for r in rows] == [(1, 0)]
    assert {(x.digest, x.side) for x in rows[0].found} == {(i, 1) for i in range(0, 400, 80)} | {(i, -1) for i in range(400, 406) if i % 80}
    prints = {name: {r.id: (r["size"], r.fingerprint) for r in fp.fingerprints(df, 40, ["id"]).collect()} for name, df in read.items()}
    assert prints["old"][2] == prints["new"][2] and prints["old"][1] != prints["new"][1] and prints["old"][1][0] == 400


def test_many_null_ids_are_several_ranges_and_no_table_is_left(spark):
    rows = [(None, f"null {i}. more") for i in range(60)] + [(i // 2, f"text {i}. again") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = fp.with_range(docs, range_rows=5)
    assert ranges.filter("doc_id IS NULL").select("r").distinct().count() > 5 and ranges.filter("r < 0 AND doc_id IS NOT NULL").isEmpty()
    order = [(r.doc_id, r.text) for r in ranges.orderBy("r", "doc_id", "text").collect()]
    assert [d for d, _ in order[60:]] == sorted(i // 2 for i in range(90))
    after = {(r.doc_id, r.text): r.next_text for r in fp.with_next(docs, range_rows=5).collect()}
    assert after == {order[i]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    before = {t.name for t in spark.catalog.listTables()}
    assert fp.likeness(docs, range_rows=5).count() == 150 and {t.name for t in spark.catalog.listTables()} == before


def test_empty_table(spark):
    assert fp.likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0
