import random
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sediment.llm import token_counts

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["'", "'s", "'re", "'r", "'ll", "'l", "é", "ß", "İ", "Σ", "ﬁ", "́", "漢", "字", "😀", "9", "½", "Ⅷ", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", " ", "\n", "a", "tion", "the", "QU", "$$", "!", "‍", "ñ", "ct", "Z"]


def counts(texts):
    machine = token_counts.Transducer(PATH)
    return machine.counts([token_counts.normalised(t, machine.special) for t in texts]).tolist()


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_random_texts():
    rng = random.Random(5)
    texts = ["", None, "x" * 5000, "'" * 50, "don't we'll 'tis'sam"] + ["".join(rng.choices(ODD, k=rng.randint(1, 60))) for _ in range(1500)]
    assert counts(texts) == library(texts)


def test_documents_and_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("n_chars", "n_tokens")
    rows = token_counts.count_tokens(docs, PATH).collect()
    assert [r["n_tokens"] for r in rows] == library([r["text"] for r in rows])
    assert all(r["n_bytes"] == len(r["text"].encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def test_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PATH).collect()) == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 3, 2)]
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_long_chunks_without_space_compose():
    text = "ab9" * 40_000 + " c " + "漢字" * 5000
    machine = token_counts.Transducer(PATH)
    assert machine.counts([text.encode()] * 2).tolist() == library([text] * 2)
    assert np.array_equal(machine.counts([]), [])


def test_maps_of_small_chunks(monkeypatch):
    """Chunks and segments so short that most hold no settled symbol, and few rounds before only the true path goes on."""
    rng = random.Random(7)
    texts = ["".join(rng.choices(ODD, k=rng.randint(1, 80))) for _ in range(150)] + ["x" * 300, "漢字" * 90, "'" * 70, "".join(rng.choices("acgt", k=400)), "".join(rng.choices("漢字語學生", k=200))]
    want = library(texts)
    for chunk, segment, rounds in ((8, 64, 2), (16, 10_000, 1), (5, 10_000, 40), (64, 128, 40)):
        for name, value in (("CHUNK", chunk), ("SEGMENT", segment), ("ROUNDS", rounds), ("WARM", min(4, chunk))):
            monkeypatch.setattr(token_counts, name, value)
        assert counts(texts) == want


def test_a_megabyte_without_spaces_in_seconds():
    rng = random.Random(1)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(333_333)), "漢字" * 166_666]
    machine = token_counts.Transducer(PATH)
    began = time.process_time()
    got = machine.counts([t.encode() for t in texts])
    assert time.process_time() - began < 10
    assert got.tolist() == library(texts)
