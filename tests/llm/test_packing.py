"""Packing against whole-text tokenising."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import packing
from kinetrail.llm.queries import tokenizer_path

ODD = ["It's. a 'B' C'S'. naïve, Straße. ΣΑΣ. İx, é, 12. a1. a_b. <|endoftext|> b,\x0bc.\x1cd 'LL. 漢字。 don't'. x's,",
       "a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y, <|ENDOFTEXT|> <|end", "İ, aİ-- İ", "Anblewh'd \r\n\tend`",
       "", "  ", "\n", None, "same", "same", "word " * 9000, "A, b. " * 1500]


def test_words_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ours = packing.WordTokens(tokenizer_path())
    for text in filter(None, ODD):
        assert ours.ids([text])[0] == np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_cover_documents_and_sequences(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = [(i, x, "k", 1) for i, x in enumerate(ODD * 5)] + [(None, "lost id", "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string, slice int").repartition(3)
    got = packing.pack(docs, tokenizer_path(), 2).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for doc, text, *_ in rows:
        ids = np.asarray(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert spark.createDataFrame([], docs.schema).transform(lambda e: packing.pack(e, tokenizer_path(), 2)).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_uses_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    h = np.bincount(np.minimum(rng.geometric(0.02, 40000), 128), minlength=129)
    h[0] = 0
    used, sequences = np.zeros(129, int), 0
    for shape, times in packing.packing_plan(h, 128):
        assert sum(shape) <= 128 and times > 0
        sequences += times
        for b in shape:
            used[b] += times
    assert (used == h).all()
    assert (h * np.arange(129)).sum() / (sequences * 128) > 0.98


def test_latin_words_give_the_ids_of_the_file():
    """Merges applied to pieces agree with the untouched tokenizer, added tokens included."""
    import random
    import string

    from tokenizers import Tokenizer

    random.seed(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "İ", "Σ", "é", "\u0300", "'s", "'", "-", "<|", "|>", " ", "\n", "\x1c", "1", "漢", "the", "ing"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 14))) for _ in range(3000)]
    letters = string.ascii_letters + "".join(map(chr, range(0xC0, 0x100)))
    texts += ["".join(random.choices(letters, k=random.randint(1, 25))) + "".join(
        random.choices(string.punctuation, k=random.randint(0, 6))) for _ in range(3000)]
    wanted = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    for ours, plain in zip(packing.WordTokens(tokenizer_path()).ids(texts), wanted):
        assert ours == np.asarray(plain.ids, "<u4").tobytes()


@pytest.mark.parametrize("most", [0, 1, 10])
def test_short_documents_fill_their_sequences(spark, most):
    """Texts of no, one, or one to ten words leave little padding."""
    docs = spark.range(20000).selectExpr("id AS doc_id", f"repeat('word ', cast(id % {max(most, 1)} + {int(most > 0)} AS int)) AS text")
    got = packing.pack(docs, tokenizer_path(), 2).agg(F.sum("length"), F.countDistinct("sequence_id"), F.max(F.col("offset") + F.col("length"))).first()
    assert got[2] <= 4096
    assert got[1] <= -(-got[0] // 4096) * 1.05
