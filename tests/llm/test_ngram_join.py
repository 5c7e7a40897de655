import random
import re
from collections import defaultdict

from sediment.llm import ngram_join


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, num, den):
    """Components over all pairs that share a shingle."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holds = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].add(i)
    seen = set()
    for own in holds.values():
        own = sorted(own)
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                i, j = own[a], own[b]
                if (i, j) not in seen and find(i) != find(j):
                    seen.add((i, j))
                    common = len(sets[i] & sets[j])
                    if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                        root[find(i)] = find(j)
    low = defaultdict(lambda: 1 << 60)
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], doc)
    return sorted((doc, len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows))


def got(spark, rows, size, num, den):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, size, num, den).collect())


def test_groups_of_near_copies(spark):
    rng = random.Random(3)
    rows = [(0, "One two"), (1, "one  TWO"), (2, ""), (3, None), (4, "a b c d"), (5, "A B c D"), (5, "A B c D"), (6, "é à ü"), (7, "É à ü")]
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    other = [f"v{rng.randrange(5000)}" for _ in range(40)]
    for i in range(10, 190):
        words = list(base if i % 4 else other)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 5, 9])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        if i % 7 == 0:
            words = words[: -rng.randrange(1, 12)]
        rows.append((i, " ".join(words)))
    line = " ".join(f"c{k}" for k in range(30))
    rows += [(i, line + " " + " ".join(f"u{rng.randrange(9000)}" for _ in range(60))) for i in range(200, 320)]
    assert got(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert got(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect())
    assert out[2] == (4, 2, 4) and {r[2] for r in out[:2]} == {None}
    assert ngram_join.jaccard_components(docs.limit(0)).collect() == []
    assert ngram_join.drop_near_copies(docs).count() == 3


def test_pairs_of_which_one_has_more_words(spark):
    """Lone pairs and threes, x and x with 5 to 17 % more words: what x shares can lie beyond the prefix of the larger one."""
    rng = random.Random(8)
    rows = []
    for n in range(600):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([20, 60, 103, 140, 250]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(1 + n % 2):
            more = [f"m{rng.randrange(10**9)}" for _ in range(round(len(words) * rng.choice([0.05, 0.1, 0.14, 0.16, 0.17])))]
            rows.append((len(rows), " ".join(words + more if n % 3 else more + words)))
    want = brute(rows, 4, 85, 100)
    assert sum(r[0] != r[2] for r in want) > 500
    assert got(spark, rows, 4, 85, 100) == want
    assert got(spark, rows, 5, 80, 100) == brute(rows, 5, 80, 100)
