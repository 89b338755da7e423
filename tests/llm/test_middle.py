"""Fill-in-middle against tokens matched one by one."""

import hashlib
import random
import re

import numpy as np

from kinetrail.llm import middle
from pyspark.sql import functions as F


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    passage = "".join(rng.choice("abc de\n.é漢🙂") for _ in range(3000))
    words = [" ".join("".join(rng.choice("abXYé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    odd = [None, "", " ", "a", "é", "<", "x<P>y", "a <P", "P>b", "<M>", "<S", "a<" * 50, "S>" * 60, "a" * 70_000, "é" * 30_000, "🙂" * 9_000,
           "1a" * 40_000, "\n" * 500, "z\u0000z"]
    return odd + words + [w + passage + w[::-1] for w in words] + [passage] * 5


def test_outputs_and_restored_texts(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "of no id"), (7, "same id"), (7, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    got = middle.fill_in_middle(docs).withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((repr((i, *plain(i, t))), t or "") for i, t in rows)
    assert sorted((repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_shared_passages_are_cut_alike_and_read_once():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ,.") for _ in range(20_000)).encode()
    both = [b"one begins so " + passage, b"the other, longer: " * 9 + passage]
    raw, ends = np.frombuffer(b"".join(both), np.uint8), np.array([0, len(both[0]), len(both[0]) + len(both[1])])
    starts = middle.boundaries(raw, ends)
    tail = [{int(len(b) - (s - e)) for s in starts if e <= s < e + len(b)} for b, e in zip(both, ends)]
    near = {x for x in tail[0] if x < len(passage) - middle.WINDOW}
    assert len(near) > 40 and near == {x for x in tail[1] if x < len(passage) - middle.WINDOW}

    known = middle.Summaries(1 << 20)
    read = []
    known._read = lambda chunks: read.append(len(chunks)) or middle.Summaries._read(chunks)
    middle.Cutter(raw[:ends[1]], ends[:2], known)
    middle.Cutter(raw[ends[1]:], ends[1:] - ends[1], known)
    assert read[1] < 8 < 40 < read[0]


def test_memory_is_bounded_and_does_not_change_results():
    raw = np.frombuffer("".join(x or "" for x in texts()).encode(), np.uint8)
    ends = np.array([0, len(raw)])
    small, large = middle.Summaries(500), middle.Summaries(1 << 26)
    for _ in range(2):
        a, b = middle.Cutter(raw, ends, small), middle.Cutter(raw, ends, large)
        assert (a.tokens == b.tokens).all() and (a.points == b.points).all()
    assert not small.young
