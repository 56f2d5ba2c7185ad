from __future__ import annotations

import random
from collections import defaultdict

from tallyframe.llm.line_dedup import LineRuns, dedup_lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, length=20, least=3):
    """What stays of each row, with the number of its lines and of those dropped."""
    rank = lambda d: (d is not None, d or 0)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= length:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [len(holders.get(key(x), ())) >= least and rank(doc) < max(map(rank, holders[key(x)])) for x in lines]
        out.append((doc, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


def run(frame, **how):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(frame, **how).collect()), key=repr)


LONG = "this line has more than twenty letters"


def test_edges(spark, docs):
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, LONG), (5, f"\t{LONG.upper()} \n{LONG}\nown"), (6, f"a\n{LONG}\r\nb\n"), (6, "again"),
        (7, f"{LONG}\n{LONG}"), (None, LONG), (None, "x"), (8, "short line"), (9, "short line"), (10, "short line"),
        (11, "é" * 19 + "É"), (12, "é" * 19 + "É"), (13, "é" * 19 + "É"), (14, "é" * 20), (15, "\n" + "é" * 20), (-3, " " + "é" * 20 + "\x1f"),
        (16, "k" * 19), (17, "k" * 19), (18, "k" * 19), (20, LONG[:20] + " "), (21, LONG[:20] + " "),
        (30, "w " * 70000 + "\n" + "\n".join(f"line number {i} of a long text" for i in range(3000))),
        (31, "\n".join(f"line number {i} of a long text" for i in range(0, 3000, 2))),
        (32, "\n".join(f"Line number {i} of a long text" for i in range(0, 3000, 3))),
    ]
    for batches in (1, 3, 4):
        assert run(docs(*rows), batches=batches) == brute(rows)
    assert run(docs(*rows), least_length=1, least_docs=2) == brute(rows, 1, 2)


def test_repeated_rows_and_one_document(spark, docs):
    rows = [(5, LONG)] * 4 + [(5, f"{LONG}\nmore")]
    assert run(docs(*rows)) == brute(rows)
    rows += [(3, LONG), (4, f"x\n{LONG}")] * 2
    assert run(docs(*rows)) == brute(rows)
    assert run(docs((1, LONG))) == brute([(1, LONG)])


def test_columns_and_empty_table(spark, docs):
    clash = docs((1, "a\nb"), (2, None)).selectExpr("*", "'q' AS n_lines", "7 AS h1", "8 AS at", "9 AS digest", "'z' AS batch", "1 AS keeper")
    out = dedup_lines(clash)
    assert out.columns == [c for c in clash.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r.bucket, r.h1, r.batch) for r in out.collect()} == {(1, "a\nb", "x", 7, "z"), (2, "", "x", 7, "z")}
    empty = dedup_lines(docs())
    assert empty.collect() == [] and empty.columns[-2:] == ["n_lines", "n_dropped"]


def test_random_texts(spark, docs):
    draw = random.Random(5)
    pool = [f"{'Common' if i % 2 else 'common'} line that is number {i % 20}{' ' * (i % 3)}" for i in range(60)] + ["tiny", ""]
    rows = [(draw.randrange(50), "\n".join(draw.choices(pool, k=draw.randrange(7)))) for _ in range(120)]
    assert run(docs(*rows).repartition(5)) == brute(rows)


def test_runs_stand_on_levels_and_settled_hashes_stay_out(spark):
    runs = LineRuns(spark, 3)
    try:
        for i in range(5):
            # hash 1 is in every document: settled by the first batch; each batch has a hash of its own
            rows = [(1, 1, 100 - 10 * i - j) for j in range(4)] + [(2 + i, 0, 100 - 10 * i)]
            runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc_id long"))
            assert sorted(runs.levels) == [k for k in range(3) if (i + 1) >> k & 1]
        newest = spark.table(runs.levels[0]).collect()
        assert [(r.h1, r.n_docs) for r in newest] == [(6, 1)]
        tables = lambda: spark.sql("SHOW TABLES").where(f"tableName LIKE '{runs.name}%'").count()
        assert tables() == 2
        whole = {r.h1: (r.n_docs, r.keeper) for r in runs.compacted().collect()}
        assert whole == {1: (4, 100), **{2 + i: (1, 100 - 10 * i) for i in range(5)}}
        assert tables() == 1
    finally:
        runs.close()
    assert tables() == 0
    # a batch that holds a later document than the keeper isn't settled
    runs = LineRuns(spark, 2)
    for ids in ([1, 2], [9], [4]):
        runs.add(spark.createDataFrame([(7, 7, i) for i in ids], "h1 long, h2 long, doc_id long"))
    assert [(r.n_docs, r.keeper) for r in runs.compacted().collect()] == [(3, 9)]
    runs.close()
