import random
from collections import Counter

import numpy as np

from sediment.llm import substring_dedup


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(t) else 0))
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return out


def check(spark, texts, length=200, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(substring_dedup.remove_repeats(docs, length, **more).collect(), key=lambda r: r["doc_id"])
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows]
    for i, (g, w) in enumerate(zip(got, brute(texts, length), strict=True)):
        assert g == w, (i, g[:3], w[:3])


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 8))) for _ in range(n))


def test_planted_repeats(spark):
    rng = random.Random(1)
    passage, other = prose(rng, 60), prose(rng, 35)
    texts = ["", None, "short", "a" * 199, "b" * 200, "c" * 201, "d" * 900, passage, passage]
    for k in range(60):
        body = prose(rng, 80)
        cut = rng.randrange(len(body))
        extra = passage if k % 3 == 0 else other if k % 3 == 1 else passage[: rng.randrange(150, 260)]
        texts.append(body[:cut] + extra + body[cut:] + (extra if k % 10 == 0 else ""))
    base = prose(rng, 120)
    for _ in range(40):
        words = base.split()
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    check(spark, texts)
    check(spark, texts, shard_contexts=3)


def test_documents(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x" + "yz" * 150), (1, "x" + "yz" * 150), (None, None)], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 0), (301, 301), (301, 301)]
    assert substring_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_suffix_order_and_common_prefixes():
    """Against sorted suffixes; a context ends with a symbol above all bytes, the earlier the smaller."""
    rng = np.random.default_rng(6)
    for letters in (1, 2, 4, 256):
        contexts = [bytes(rng.integers(0, letters, int(n)).astype("u1")) for n in rng.integers(1, 60, 12)] * 2
        sizes = np.array([len(c) for c in contexts])
        data = np.frombuffer(b"".join(contexts), "u1")
        ends = np.cumsum(sizes)
        room = np.repeat(ends, sizes) - np.arange(len(data))
        text = [int(b) for b in data]
        keys = [[*text[i : i + r], 256 + i + r] for i, r in enumerate(room.tolist())]
        value = substring_dedup.packed_symbols(data, room)
        order = substring_dedup.suffix_order(value, room)
        assert order.tolist() == sorted(range(len(data)), key=keys.__getitem__)
        before = np.full(len(data), -1)
        before[order[1:]] = order[:-1]
        got = substring_dedup.common_prefixes(value, room, before, ends - sizes, sizes, 40)
        for i, j in enumerate(before.tolist()):
            n = 0
            while j >= 0 and n < 40 and keys[i][n] == keys[j][n]:
                n += 1
            assert got[i] == n


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "q" * 450, 7, "x"), (2, "r" * 10, 8, None)], "doc_id long, text string, n_bytes long, uid string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["uid"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: (450, 450, "x"), 2: (10, 0, None)}
