"""Line dedup against a plain pass over all chunks, and against its SQL."""

import hashlib
import random

from kinetrail.llm import lines


def plain(rows, cut=lines.CUT, long=lines.LONG, most=lines.MOST):
    def spans(text):
        """(start, stop, body) of every chunk of a text."""
        every = text.split("\n")
        at = [k for k, line in enumerate(every) if line.strip(" \t\r")]
        solid, at = [every[k] for k in at], at + [len(every)]
        h = [int(hashlib.md5(line.encode()).hexdigest()[:7], 16) for line in solid]
        anchor = [(h[k + 1] + lines.MIX * h[k]) % cut == 0 or len(solid[k] + solid[k + 1]) >= long for k in range(len(solid) - 1)]
        found = set()
        for u in range(len(solid)):
            b = u + 1
            while b < len(solid) and b < u + most and not (b > u + 1 and anchor[b - 2]):
                b += 1
            a = u
            while a > 0 and a > u + 1 - most and not (a < u and anchor[a]):
                a -= 1
            found |= {(u, b), (a, u + 1)}
        return [(at[a], at[b], "\n".join(solid[a:b])) for a, b in sorted(found) if b - a > 1]

    seen, result = {}, {}
    rows = sorted(rows, key=lambda r: r[0])
    for i, text in rows:
        if text is None:
            result[i] = (None, 0)
            continue
        every, gone = text.split("\n"), set()
        for start, stop, body in spans(text):
            if seen.setdefault(body, (i, start)) != (i, start):
                gone.update(range(start, stop))
        result[i] = ("\n".join(x for k, x in enumerate(every) if k not in gone), len(gone))
    return result


def test_dedup_lines(spark):
    rng = random.Random(4)
    pool = [f"line {k} é" for k in range(400)] + ["", " "]
    passage = pool[:12]
    texts = [None, "", "\n", "\n\n\n", "\r\n\r\n", *["\n".join(["same"] * 9)] * 3]
    for _ in range(80):
        body = rng.choices(pool, k=rng.randrange(1, 30))
        if rng.random() < 0.5:
            at = rng.randrange(len(body))
            body[at:at] = passage
        texts.append("\n".join(body) + "\n" * rng.randrange(2))
    texts.append("\n".join(rng.choices(pool, k=5000)))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, i, "c") for i, t in rows], "doc_id long, text string, rid long, chunks string").repartition(5)
    got = lines.dedup_lines(docs).collect()
    assert {r.doc_id: (r.text, r._n_removed) for r in got} == plain(rows)
    assert sum(r._n_removed for r in got) > 100 and all(r.rid == r.doc_id and r.chunks == "c" for r in got)
    twice = lines.dedup_lines(docs.filter("doc_id = 30").union(docs.filter("doc_id = 30"))).collect()
    assert len(twice) == 2
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_sql_agrees(spark):
    import duckdb
    from oracle import rows_of

    from kinetrail.llm.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = con.execute(ORACLES["op3_line_dedup"])
    names = [c[0] for c in rel.description]
    got = QUERIES["op3_line_dedup"](spark, d)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, rel.fetchall())


def test_passages_go_whole(spark):
    """Passages between foreign lines: of over 50 words whole, however few their lines; of ten short lines nearly always."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(60 // m) for _ in range(m)] for m in (2, 3, 4) for _ in range(20)] + [[line(3) for _ in range(10)] for _ in range(40)]
    rows = [(2 * k + copy, "\n".join([line(4), line(5), "", *p, "", "", line(6), line(3)])) for k, p in enumerate(passages) for copy in (0, 1)]
    got = {r.doc_id: r.text.split("\n") for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("\n".join(got[2 * k]) == rows[2 * k][1] for k in range(len(passages)))
    left = [sum(x in got[2 * k + 1] for x in p) for k, p in enumerate(passages)]
    assert not any(left[:60]) and sum(n == 0 for n in left[60:]) >= 38
    assert all(len(got[2 * k + 1]) >= 5 for k in range(len(passages)))  # foreign lines and the blank line before the passage stay


def test_runs_without_an_anchor(spark):
    """Thousands of lines of which no two are an anchor: chunks end after ``most`` lines; every line of the copy goes."""
    pool = [str(k) for k in range(200)]
    odd = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:7], 16) % 2
    x, y = next(p for p in pool if odd(p)), next(p for p in pool if not odd(p))
    text = "\n".join([x, y] * 10_000)
    rows = [(1, text), (2, text), (3, "x\n\n\n\ny"), (4, "z\n\n\n\nw")]
    got = {r.doc_id: (r.text, r._n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows) and got[2] == ("", 20_000) and got[4] == (rows[3][1], 0)


def test_hot_chunk(spark, monkeypatch):
    """One passage in all documents, dealt to many groups: it stays in the first document only."""
    monkeypatch.setattr(lines, "GROUP", 4)
    passage = ["a passage of " * 6, "three long lines that " * 4, "everyone quotes " * 5]
    rows = [(k, "\n".join([f"own {k}", *passage, f"end {k}"])) for k in range(300)]
    got = {r.doc_id: (r.text, r._n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == plain(rows) and got[0][1] == 0 and all(got[k][1] == 3 for k in range(1, 300))
