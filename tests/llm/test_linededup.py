import random

import duckdb

from tapeworks.llm.linededup import dedup_lines
from tapeworks.llm.queries import oracle_sql, queries


def expected(rows, k=3):
    """Rows in order of doc_id; windows seen before are covered."""
    seen, out = set(), []
    for d, t in rows:
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        n = min(k, len(at))
        gone, new = set(), []
        for i in range(len(at) - n + 1 if n else 0):
            w = tuple(lines[j] for j in at[i : i + n])
            if w in seen:
                gone |= set(at[i : i + n])
            seen.add(w)
        out.append((d, t if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(at), len(gone)))
    return out


def test_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "é"]) for _ in range(rng.randrange(9)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "x"), (83, "x"), (84, "x\ny"), (85, "x\ny\n"), (86, "l\n" * 50), (None, "x\ny")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "z"), (1, "a\nb\nc", "z")], "doc_id long, text string, extra string")
    assert [(r.text, r.n_removed) for r in dedup_lines(docs).collect()] == [("a\nb\nc", 0)] * 2
    assert dedup_lines(docs.limit(0)).collect() == []


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({oracle_sql()['op8_line_dedup']})").fetchall()
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in queries()["op8_line_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
