"""Line dedup against a plain Python version."""

import random

from maskwright.llm.line_runs import LineRuns, drop_repeated_lines

BLANK = " \t\n\x0b\x0c\r"


def plain(rows, least=20, docs=3):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    key = lambda line: line.strip(BLANK).translate(lower)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                holders.setdefault(key(line), set()).add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common or common[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.row.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_random_texts_equal_the_plain_version(spark):
    rng = random.Random(5)
    pool = [f"A line of many words number {k}" for k in range(30)] + ["short", "", "  ", "x" * 19, "É" * 20]
    rows = []
    for k in range(120):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r"]) for _ in range(rng.randint(1, 9))]
        rows.append((rng.randint(0, 90), "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    rows += [(None, "A line of many words number 1\nown"), (None, None), (7, None), (8, ""), (9, "\n\n"), rows[0], rows[0]]
    rows.append((200, "\n".join(["A line of many words number 2"] * 3000)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        assert got(drop_repeated_lines(df, batches=batches, fanout=fanout)) == plain(rows)


def test_runs_are_compacted_and_settled_lines_add_nothing(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    rows = [[(1, 1, d) for d in (50, 60, 70)], [(1, 1, 10), (2, 2, 10)], [(1, 1, 90)], [(2, 2, 5), (2, 2, 6)]]
    for batch in rows:
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long, doc long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {(r.h1, r.holder) for r in runs.settled().collect()} == {(1, 90), (2, 10)}
    assert {(r.h1, r.docs) for r in runs.entries().collect()} == {(1, 4), (2, 3)}  # document 10 of line 1 was skipped


def test_clashing_columns_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for name in ("row", "doc", "version", "gone", "lines", "holder", "kept_text", "batch"):
        df = df.withColumn(name, df.text)
    out = drop_repeated_lines(df)
    assert got(out) == [(1, "a", 1, 0), (2, "", 1, 0)]
    assert set(out.select("row.*").columns) == set(df.columns)
    assert drop_repeated_lines(df.limit(0)).collect() == []
