"""Source divergence, the Merkle manifest and fingerprints beside brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sediment.llm import divergence, fingerprints, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark, seed=3, n=120):
    rng = random.Random(seed)
    words = ["Alpha", "alpha", "bÉta", "gamma9delta", "é", "İx", "zeta-eta", "漢字", "\x00q", "𝄞a"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 30))), "x" * rng.randint(1, 5)])
        rows.append((i if i % 17 else None, text, rng.choice([None, "", "en", "en", "de"]), rng.choice([None, "a", "b", "é", "Z"]), len(text) if text and i % 5 else None))
    rows += rows[3:6] + [(200, "long word " * 20_000, "en", "a", None), (201, None, "solo", "x", 0)]
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("size", F.lit(7)).withColumn("root", F.lit("clash"))


def expected_divergence(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, groups = Counter(), defaultdict(Counter)
        for doc_lang, source, words in docs:
            if doc_lang == lang:
                held.update(set(words))
                groups[source].update(words)
        kept = [t for t, n in held.items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, f(p[s][t], whole[t])) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *item, n) for n, item in enumerate(ranked, 1) if part == "pair" or n <= top]
    return sorted(out)


def test_divergence(spark):
    rows, df = odd_docs(spark)
    for least, top in ((10, 3), (2, 10), (1000, 10)):
        got = divergence.source_divergence(df, least, top).collect()
        assert sorted(tuple(r) for r in got) == expected_divergence(rows, least, top)
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_share_is_exact(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(1, n + 1), n) for n in (rng.randrange(1, 9 * 10**15) for _ in range(200))]
    got = spark.createDataFrame(rows, "c long, n long").select("c", "n", divergence.share(F.col("c"), F.col("n")).alias("x")).collect()
    assert all(r["x"] == 10**9 * r["c"] // r["n"] for r in got)


def test_divergence_reads_terms_once(spark):
    plan = divergence.term_counts(odd_docs(spark)[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("Exchange") == 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def trees(leaves, arity):
    """Levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + arity])) for k in range(0, len(last), arity)])
    return levels


def path_of(levels, pos, arity):
    path = []
    for level in levels[:-1]:
        first = pos // arity * arity
        path.append(("".join(level[first:pos]), "".join(level[pos + 1 : first + arity])))
        pos //= arity
    return path


def expected_manifest(rows, arity):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = lambda t: sha("".join(map(field, (doc_id, source, lang, n_chars, t))))  # noqa: B023, E731
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text) if text is not None else None
        groups[lang].append((doc_id, leaf(text), leaf(lowered) if bad else leaf(text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: trees([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], arity) for g in order}
    upper = trees([built[g][-1][0] for g in order], arity)
    out = []
    for at, g in enumerate(order):
        for pos, (doc_id, leaf, folded) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            path = path_of(built[g], pos, arity) + path_of(upper, at, arity)
            for before, after in path:
                folded = sha(before + folded + after)
            out.append((str(doc_id), leaf, built[g][-1][0], upper[-1][0], sha("".join(a + b for a, b in path)), folded))
    return sorted(out)


def manifest_rows(df, arity):
    fields = ("doc_id", "source", "lang", "n_chars")
    lowered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf_digest(*fields, merkle.lowered_copy(F.col("text"))))
    df = df.withColumn("leaf", merkle.leaf_digest(*fields, "text")).withColumn("tampered", lowered)
    made = merkle.build(df, "doc_id", "lang", "leaf", arity)
    return made, merkle.prove(made).withColumn("folded", merkle.fold(F.coalesce("tampered", "digest"), F.col("path")))


def test_manifest(spark):
    rows, df = odd_docs(spark)
    for arity, some in ((8, rows), (2, rows[:40]), (3, [r for r in rows if r[2] == "en"]), (8, rows[:1])):
        keep = spark.createDataFrame(some, SCHEMA).withColumn("size", F.lit(7)).withColumn("root", F.lit("clash")).withColumn("extra", F.lit("x"))
        made, got = manifest_rows(keep, arity)
        assert "extra" in got.columns
        got = got.select(F.col("doc_id").cast("string"), "digest", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), "folded").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == expected_manifest(some, arity)
        assert [r["root"] for r in made.root().collect()] == [got[0]["root"]]
        assert made.nodes().where("level = 0").count() == len(some)
    made, got = manifest_rows(df.limit(0), 8)
    assert got.collect() == [] and made.root().collect() == []


def test_tampering_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, got = manifest_rows(docs, 8)
    assert got.where("tampered is null and folded <> root").count() == 0
    changed = got.where("tampered is not null and tampered <> digest")
    assert changed.count() > 0 and changed.where("folded = root").count() == 0


def words_of(data):
    return [w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]


def true_shingles(data):
    w = words_of(data)
    return {tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} if w else set()


def test_word_hashes(monkeypatch):
    rng = random.Random(1)
    texts = [b"", b" ", b"a", b"One two\tTHREE\x0bfour \r\n five SIX", "  é漢 x".encode(), bytes(rng.choices(b"ab \n", k=5000)), b"q" * 3000]
    whole = [fingerprints.word_hashes(np.frombuffer(t, "u1")) for t in texts]
    by_word = {}
    for t, (h, starts) in zip(texts, whole, strict=True):
        w = words_of(t)
        assert len(h) == len(starts) == len(w)
        for x, y in zip(w, h.tolist(), strict=True):
            assert by_word.setdefault(x, y) == y
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(fingerprints, "BLOCK", 7)  # words over the ends of blocks
    for t, (h, starts) in zip(texts, whole, strict=True):
        cut, at = fingerprints.word_hashes(np.frombuffer(t, "u1"))
        assert cut.tolist() == h.tolist() and at.tolist() == starts.tolist()


def test_sketches_hold_all_below_the_threshold():
    rng = random.Random(2)
    vocabulary = [f"w{n}" for n in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=n)).encode() for n in (0, 1, 4, 5, 30, 68, 69, 70, 2000, 30_000)] + [b"same " * 1000, b"same " * 1000]
    found = fingerprints.sketches(texts)
    for t, s in zip(texts, found, strict=True):
        every = np.unique(fingerprints.shingle_hashes(fingerprints.word_hashes(np.frombuffer(t, "u1"))[0]))
        assert len(every) == len(true_shingles(t))
        assert s[1:].tolist() == every[every <= s[0]].tolist() and len(s) - 1 >= min(len(every), fingerprints.LEAST)
        assert int(s[0]) >= (1 << 64) // fingerprints.SCALE - 1
        assert fingerprints.from_text(fingerprints.to_text(s)).tolist() == s.tolist()
    assert found[-1].tolist() == found[-2].tolist()


def test_estimates():
    rng = random.Random(4)
    vocabulary = [f"w{n}" for n in range(3000)]
    long, short = rng.choices(vocabulary, k=20_000), rng.choices(vocabulary, k=40)
    mixed = long[:12_000] + rng.choices(vocabulary, k=8_000)
    part = long[3000:5000]
    a, b, c, d, e = fingerprints.sketches([" ".join(x).encode() for x in (long, mixed, part, short, short[:30] + ["new"] * 10)])
    assert abs(fingerprints.likeness(a, b) - 3 / 7) < 0.05
    assert fingerprints.containment(c, a) > 0.95 and abs(fingerprints.containment(a, c) - 0.1) < 0.03
    one, two = (true_shingles(" ".join(x).encode()) for x in (short, short[:30] + ["new"] * 10))
    assert fingerprints.likeness(d, e) == len(one & two) / len(one | two)  # short texts are held whole
    both = fingerprints.merge(c, d)
    assert fingerprints.containment(c, both) == 1
    nothing = fingerprints.sketches([b"", b"  "])
    assert fingerprints.likeness(*nothing) == 1 and fingerprints.likeness(nothing[0], a) == 0


def expected_successors(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()), reverse=True)
    out = []
    for n, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((str(doc_id), len(text), sha(edited), *fingerprint_row(text, edited, after)))
    return sorted(out)


def fingerprint_row(text, edited, after):
    a, b, c = fingerprints.sketches([x.encode() for x in (text, edited, after)])
    return fingerprints.to_text(a), fingerprints.to_text(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)


def test_successors(spark):
    rows, df = odd_docs(spark)
    df = df.withColumn("fingerprint", F.lit("clash")).withColumn("range", F.lit(1))
    columns = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for some in (df, df.repartition(7), df.coalesce(1)):
        got = fingerprints.successor_fingerprints(some)
        assert "term" in got.columns and "range" in got.columns and "text" not in got.columns
        assert sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in got.collect()) == expected_successors(rows)
    assert fingerprints.successor_fingerprints(df.limit(0)).collect() == []
    one = fingerprints.successor_fingerprints(spark.createDataFrame([(5, "a b")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    nulls = spark.createDataFrame([(None, "a"), (None, None), (None, "b c")], "doc_id long, text string")
    assert fingerprints.successor_fingerprints(nulls).count() == 3


def test_small_ranges_equal_large(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    got = fingerprints.successor_fingerprints(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], *(r[c] for c in ("fingerprint", "edited_fingerprint", "near_edited", "near_next"))) for r in got) == expected_successors(rows)


def test_groups(spark):
    rng = random.Random(6)
    vocabulary = [f"w{n}" for n in range(2000)]
    base = [" ".join(rng.choices(vocabulary, k=3000)) for _ in range(6)]
    rows = [("a", base[0]), ("a", base[1]), ("b", base[0]), ("b", base[1]), ("b", base[2]), ("b", base[3]), ("c", base[4]), (None, base[0])]
    prints = fingerprints.fingerprint(spark.createDataFrame(rows, "source string, text string"))
    got = {(r["a"], r["b"]): r["contained"] for r in fingerprints.group_containment(prints, "source").collect()}
    assert set(got) == {("a", "b"), ("b", "a")} and got["a", "b"] == 1 and abs(got["b", "a"] - 0.5) < 0.05
    pairs = prints.where("source = 'a'").select(F.col("fingerprint").alias("x")).withColumn("y", F.col("x"))
    assert {(r["jaccard"], r["contained"]) for r in fingerprints.compare(pairs, "x", "y").collect()} == {(1.0, 1.0)}
