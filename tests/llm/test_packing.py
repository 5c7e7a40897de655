import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sediment.llm import packing, tokens

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    "", " ", None, "It's he'll o'clock 'twas we've 12 a1b2", "İstanbul ΣΑΣ ﬁne é é ́x", "a\x1cb\x1dc\x85d　e f",
    "<|endoftext|>x<|startoftext|> y<|ENDOFTEXT|>", "漢字かな交じり文 😀😀 ''' '' 's's", "x" * 3000 + " y", "word " * 5000, "same", "same", "a b c",
]


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_chunk_encoder_equals_library():
    got = tokens.ChunkEncoder(PATH).encode(TEXTS)
    for text, ids in zip(TEXTS, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(text), text


def check_bins(rows, max_tokens=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= max_tokens
    return len(by)


def test_pack_whole(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])], "doc_id long, text string")
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    by = defaultdict(dict)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["doc_id"]][r["piece"]] = r
    for i, t in enumerate(TEXTS):
        ids = library_ids(t) + [0]
        assert [x for _, r in sorted(by[i].items()) for x in r["ids"]] == ids
        assert len(by[i]) == -(-len(ids) // 2048)
        assert [r["start"] for _, r in sorted(by[i].items())] == list(range(0, len(ids), 2048))
    check_bins(rows)


def test_pack_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, length string"), PATH).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    lengths = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 100, 500), return_counts=True), strict=True)}
    plan = packing.plan_bins(lengths, (128, 3, 10000), (1.0, 0.5, 0.5), rule)
    bins = defaultdict(list)
    for length, _, n, first, offset in plan.tolist():
        for k in range(n):
            bins[first + k].append((offset, length))
    assert sum(len(b) for b in bins.values()) == 500
    for own in bins.values():
        assert sum(x for _, x in own) <= 128 and len(own) <= 3 and sum(x * x for _, x in own) <= 10000


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_equal_pieces_fill_sequences(rule):
    plan = packing.plan_bins({600: 1000, 1: 5000}, (2048, 2048, 2048 * 2048), (1.0, 1.0, 1.0), rule)
    assert (plan[:, 3] + plan[:, 2]).max() == 334 and (plan[plan[:, 0] == 1, 2]).sum() == 5000


def test_few_sequences_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    assert check_bins(rows) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_chunk_encoder_on_random_texts():
    rng = random.Random(3)
    odd = ["'", "'s", "'re", "'ll", ".'", "É", "é", "ß", "İ", "Σ", "ﬁ", "\u0301", "\u0338", "×", "÷", "漢", "😀", "9", "12", "½", "<|endoftext|>", "<|", "|>", "\x1c", "\x85", "\xa0", "\u3000", " ", "\n", "a", "The", "QU", "$$", "!", ",", "-", "_", "(", "J", "\u030c", "<", ">"]
    texts = ["".join(rng.choices(odd, k=rng.randint(1, 50))) for _ in range(3000)]
    library = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, packing.encoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_the_other_capacities_bind(spark):
    """All documents in pieces of 512 tokens at most: at most 6 pieces and an attention cost of 600,000 in a sequence of 2048."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("length", F.lit("clash"))
    by = defaultdict(list)
    for r in packing.pack(docs, PATH, piece_tokens=512, max_docs=6, max_attention=600_000).collect():
        by[r["sequence_id"]].append(r["length"])
    cost = [sum(x * x for x in own) for own in by.values()]
    assert max(map(len, by.values())) == 6 and sum(map(len, by.values())) >= docs.count()
    assert 580_000 < max(cost) <= 600_000 and max(map(sum, by.values())) <= 2048
    assert len(by) <= 1.25 * max(sum(map(sum, by.values())) / 2048, sum(map(len, by.values())) / 6, sum(cost) / 600_000)
