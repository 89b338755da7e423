"""Repeated strings against counting every window."""

import random
from collections import Counter

import pytest

from kinetrail.llm import repeats


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        reach = 0
        for i in range(len(r)):
            if i + length <= len(r) and seen[r[i:i + length]] > 1:
                reach = i + length
            gone[i] = i < reach
        edges = [i for i in range(len(r) + 1) if (i > 0 and gone[i - 1]) != (i < len(r) and gone[i])]
        out.append((len(r), list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(r, gone) if not g)))
    return out


def test_windows_of_strings():
    rng = random.Random(0)
    for length in (3, 6, 20):
        for _ in range(40):
            strings = [bytes(rng.choices(b"ab" if rng.random() < .5 else b"abcdefgh", k=rng.randrange(0, 60))) for _ in range(rng.randrange(1, 6))]
            if rng.random() < .6:
                strings.append(strings[0][3:40] + b"z" + strings[0][:30])
            seen = Counter(s[i:i + length] for s in strings for i in range(len(s) - length + 1))
            for s, flags in zip(strings, repeats.repeated_windows(strings, length)):
                assert flags.tolist() == [seen[s[i:i + length]] > 1 for i in range(max(0, len(s) - length + 1))]


def corpus(rng):
    def noise(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz é\n", k=n))

    shared = noise(700)
    texts = [None, "", "short", "x" * 1000, "ab" * 400, noise(199), noise(200), shared[:200], shared[:199], shared * 2]
    for _ in range(30):
        texts.append(noise(rng.randrange(0, 900)) + shared[rng.randrange(300):][:rng.randrange(400)] + noise(rng.randrange(600)))
    for _ in range(6):
        base = list(noise(1500))
        for _ in range(rng.randrange(1, 5)):
            texts.append("".join(base))
            base[rng.randrange(len(base))] = "#"
    line = noise(150)  # longer than a name, shorter than a window
    texts += [noise(120) + line + noise(120) for _ in range(25)]
    texts += [texts[-1], texts[-1]]
    return texts


@pytest.mark.parametrize("most", [2048, 3])
def test_remove_repeats(spark, most):
    texts = corpus(random.Random(7))
    rows = [(i if i != 12 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, start int").repartition(4)
    got = {r.doc_id: (r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in repeats.remove_repeats(docs, most=most).collect()}
    want = {r[0]: w for r, w in zip(rows, plain(texts, 200))}
    assert got == want


def test_long_texts_in_parts(monkeypatch):
    """Runs of a text longer than a slice name every window once."""
    import numpy as np

    monkeypatch.setattr(repeats, "_SLICE", 1000)
    rng = np.random.default_rng(0)
    x = rng.integers(97, 122, 5321).astype(np.uint8)
    seen = []
    for part, ends, number, begins in repeats._sliced(np.concatenate([x, x[:50]]), np.array([0, 5321, 5371]), 199):
        text, start, count, *_ = repeats.runs_of(part, ends, 200)
        seen += [int(s + begins[t] + k) for t, s, c in zip(text, start, count) for k in range(c)]
    assert sorted(seen) == list(range(5321 - 199))


def test_repeated_rows_and_empty_table(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=260))
    docs = spark.createDataFrame([(1, t), (1, t), (2, t[:230])], "doc_id long, text string")
    got = sorted((r.doc_id, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect())
    assert got == [(1, b""), (1, b""), (2, b"")]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2048, 0])
def test_many_equal_rows(spark, most):
    """A third of the rows equal in id and text: their spans stay few, results stay those of every row."""
    rng = random.Random(11)
    long = "".join(rng.choices("abcdefgh ", k=3000))
    rows = [(7, long)] * 300 + [(1000 + n, "".join(rng.choices("abcdefgh ", k=300)) + (chr(65 + n // 50) + long[200:450] if n % 50 == 0 else "")) for n in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = repeats.remove_repeats(df, most=most).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 7:
            assert [tuple(s) for s in r.spans] == [(0, 3000)] and r.kept == b""
        else:
            assert [s.stop - s.start for s in r.spans] == ([250] if (r.doc_id - 1000) % 50 == 0 else [])
