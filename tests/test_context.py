import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sediment.functions import formats as fm
from sediment.operators import catalog, context
from sediment.plans import registry


def one(spark, f, *values):
    cols = [f"c{n}" for n in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols)).select(f(*map(F.col, cols))).first()[0]


def test_formats(spark):
    table = "<table><tr><th>a</th><th>b|c</th></tr><tr><td> <b>1</b> </td></tr></table>"
    assert one(spark, tx.html_table, table) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    reply = "<|channel|>analysis<|message|>think<|end|><|channel|>final<|message|>yes<|return|>"
    assert one(spark, lambda c: fm.channel(c, "final"), reply) == "yes" and one(spark, lambda c: fm.channel(c, "analysis"), reply) == "think"
    assert one(spark, fm.is_complete, reply)
    assert one(spark, fm.math_dollars, r"a \(x\) \[y\]") == "a $x$ $$y$$"
    assert [one(spark, fm.cell_value, v) for v in ("12", "1,5", "1.234", "1.23", "x")] == [12.0, 1.5, None, 1.23, None]
    assert one(spark, fm.memory_append, "- likes tea in cups", "Likes TEA in cups.")["status"] == "duplicate"
    assert one(spark, fm.memory_append, None, "drinks coffee")["memory"] == "- drinks coffee"
    assert one(spark, fm.memory_append, None, "short")["status"] == "invalid"
    assert one(spark, fm.title_of, 'x {"title": "My title"}') == "My title" and one(spark, fm.title_of, "Plain\nmore") == "Plain"
    assert [one(spark, fm.match_priority, "org/Big-Model", x) for x in ("org/Big-Model", "big_model", "big-model-7b", "other")] == [1, 2, 3, None]
    assert len(one(spark, fm.routing_key, "a-b")) == 24 and one(spark, fm.overflowed, "Maximum CONTEXT length is 5")
    assert fm.complete_objects('[{"a": "}{"}, {"b": {"c": 1}}, {"d"') == ([{"a": "}{"}, {"b": {"c": 1}}], 29)


CHUNK = "chunk_id long, file_name string, page_number int, start_line int, end_line int, content string, embedding array<double>"


def test_build_context(spark):
    rows = [(n, f"f{n}.txt", n, None, None, f"engine part {n} " + "text. " * 30, [1.0, n / 100]) for n in range(40)]
    scope = spark.createDataFrame(rows + [(90, "copy.txt", None, None, None, rows[0][5], [1.0, 0.0])], CHUNK)
    talk = spark.createDataFrame([(500, "talk.txt", None, 3, 9, "the engine of the talk", [1.0, 0.0])], CHUNK)
    asked = spark.createDataFrame([(1, "what is the engine", [1.0, 0.0]), (2, "merhaba", [1.0, 0.0])], "question_id long, query string, vector array<double>")
    got = {r["question_id"]: r for r in context.build_context(asked, [talk, scope], budget=300).collect()}
    assert set(got) == {1} and got[1]["tokens_estimate"] <= 300
    assert 500 in got[1]["sources"] and not {0, 90} <= set(got[1]["sources"]) and "[talk.txt:3-9]" in got[1]["content"]


def test_fit_budget_always_fits(spark):
    rows = [(n, "s" * 70, ["b" * 700, "c" * 350], [("user", "u" * 350), ("assistant", "a" * 350), ("user", "z" * 700)], c) for n, c in enumerate((2000, 400, 250, 120, 40))]
    df = spark.createDataFrame(rows, "id long, system string, blocks array<string>, history array<struct<role:string,content:string>>, ceiling int")
    for r, row in zip(context.fit_budget(df).orderBy("id").collect(), rows, strict=True):
        assert r["tokens"] <= row[4] and r["history"][-1]["content"][:1] in ("z", "")


def test_fallback(spark):
    ctx = spark.createDataFrame([(1, [5])], "question_id long, sources array<long>")
    chunks = spark.createDataFrame([(1, 9, 0, "x"), (2, 7, 0, "a" * 35), (2, 8, 1, "b" * 35)], "question_id long, chunk_id long, chunk_index int, content string")
    assert [r["chunk_id"] for r in context.with_fallback(ctx, chunks, 15).collect()] == [7]


def test_match_models_equals_all_pairs(spark):
    names = ["org/Big-Model", "big_model", "big-model-7b", "BIG", "b", "bi g", "other", "x/other", "o-t-h-e-r 2", "", "--", None, "other", "alone9", "Big-Model"]
    offered = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    asked = spark.createDataFrame([(100 + n, x) for n, x in enumerate([*names, "BIGM", "zzz", "other"])], "id long, name string")
    for some in (offered, offered.where("length(name) > 2")):
        pairs = asked.crossJoin(some.select(F.col("id").alias("best"), F.col("name").alias("o")))
        pairs = pairs.withColumn("priority", fm.match_priority(F.col("name"), F.col("o"))).where("priority is not null")
        want = pairs.groupBy("id").agg(F.min(F.struct("priority", "best")).alias("m")).select("id", "m.best", "m.priority")
        assert sorted(map(tuple, catalog.match_models(asked, some).collect())) == sorted(map(tuple, want.collect()))


def test_model_match_covers_all_parts(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["p_partkey"]: (r["best"], r["priority"]) for r in registry.QUERIES["model_match"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/part.parquet").where("p_name is not null").count()


def test_hybrid_equals_plain_scores(spark):
    """Both legs against a plain restatement: ties by id, copies, vectors of other lengths, zero and null components, no terms."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(30)]
    rows = []
    for n in range(900):
        text = " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(30)], k=rng.choice([0, 2, 9, 40])))
        rows.append((n * 37 % 1009, text, [float(rng.randint(-2, 2)) for _ in range(3)]))
    rows += [(2000 + n, rows[7][1] + " w3", [1.0, 1.0, 0.0]) for n in range(100)]
    rows += [(3000, "w1 w2", [0.0, 0.0, 0.0]), (3001, "w1", [1.0, None, 1.0]), (3002, "w2", [1.0, 2.0]), (3003, "w2 w2", []), (3004, "w3", None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, embedding array<double>").repartition(6)
    asked = [(n, " ".join(rng.sample(words, 4)), [float(rng.randint(-1, 2)) for _ in range(3)], 1 + n % 4, 0.3, n == 5) for n in range(12)]
    asked += [(50, "nothing", [1.0, 1.0, 0.0], 3, 0.2, False), (51, "w2", [1.0, 2.0], 2, 0.2, False), (52, "nothing", None, 2, 0.2, False)]
    kind = "question_id long, query string, vector array<double>, top_k int, threshold double, skip_retrieval boolean"
    got = {(r[0], r[1]): r[2] for r in context.batch_hybrid(spark.createDataFrame(asked, kind), chunks).collect()}

    def norm(v):
        return math.sqrt(sum(x * x for x in v))

    rows = [r for r in rows if r[2]]
    counts = {i: Counter(t.split()) for i, t, _ in rows}
    avg = sum(sum(c.values()) for c in counts.values()) / len(rows)
    df = Counter(t for c in counts.values() for t in c)
    want = {}
    for q, query, v, k, least, skip in asked:
        if skip:
            continue
        near = {i: (sum(a * b for a, b in zip(e, v)) / (norm(e) * norm(v)) if norm(e) * norm(v) else 0.0) for i, _, e in rows if v and len(e) == len(v) and None not in e}
        near = {i: s for i, s in near.items() if s >= least}
        lex = {i: sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for t in sorted(set(query.split())) if t in c) for i, c in counts.items()}
        lex = {i: s for i, s in lex.items() if s}
        legs = [{i: r + 1 for r, i in enumerate(sorted(x, key=lambda i: (-x[i], i))[: 4 * k])} for x in (near, lex)]
        fused = {i: sum(1 / (60 + g[i]) for g in legs if i in g) for i in legs[0] | legs[1]}
        want |= {(q, i): s / max(fused.values()) if legs[1] else near[i] for i, s in fused.items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_no_pairs_are_made(spark):
    """A task sends on the best of each question, not a row for each question and chunk."""
    chunks = spark.range(0, 4000, 1, 2).selectExpr("id as chunk_id", "concat('engine part ', id) as content", "array(1.0D, id / 4000.0D) as embedding")
    asked = spark.createDataFrame([(n, "the engine part", [1.0, 0.0], 2, 0.1, False) for n in range(20)], "question_id long, query string, vector array<double>, top_k int, threshold double, skip_retrieval boolean")
    found = context.batch_hybrid(asked, chunks)
    assert found.count() <= 20 * 16 and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
