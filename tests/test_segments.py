import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sediment.functions import text as tx
from sediment.operators import citations, conversation, segments, select, usage
from sediment.operators.segments import Segments


@pytest.fixture(scope="module")
def hot(spark):
    """Groups, one with a third of all rows, one null; with ties and nulls."""
    rng = random.Random(5)
    rows = []
    for n in range(6000):
        g = "hot" if n % 3 == 0 else None if n % 50 == 1 else f"g{rng.randrange(40)}"
        rows.append((g, rng.randrange(5000), rng.choice([None, 1, 2, 30]), n))
    return spark.createDataFrame(rows, "g string, at int, v int, id int").repartition(6)


@pytest.fixture
def many_parts(spark, monkeypatch):
    monkeypatch.setattr(segments, "WHOLE_ROWS", 100)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize(("before", "whole"), [(False, False), (True, False), (True, True)])
def test_scans_equal_windows(spark, hot, many_parts, monkeypatch, before, whole):
    if whole:
        monkeypatch.setattr(segments, "WHOLE_ROWS", 10_000)
    parts = Segments(hot, ["g"], ["at", "id"])
    assert parts.whole == whole
    got = parts.scan(sums={"s": F.col("v"), "n": F.lit(1)}, maxima={"m": F.col("v")}, lasts={"l": F.when(F.col("v") > 1, F.col("v"))}, before=before)
    w = Window.partitionBy("g").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = F.when(F.col("v") > 1, F.col("v"))
    want = hot.select("g", "at", "v", "id", F.sum("v").over(w).alias("s"), F.sum(F.lit(1)).over(w).alias("n"), F.max("v").over(w).alias("m"), F.last(own, ignorenulls=True).over(w).alias("l"))
    assert rows_of(parts.plain(got).select(*want.columns)) == rows_of(want)
    assert parts.plain(Segments(hot.limit(0), ["g"], ["at"]).scan(sums={"s": F.col("v")})).collect() == []


def test_a_hot_group_is_cut(spark, hot, many_parts):
    parts = Segments(hot, ["g"], ["at"])
    sizes = sorted(r["count"] for r in parts.rows.groupBy("_part").count().collect())
    held = parts.rows.where("g = 'hot'").groupBy("_part").count().collect()
    assert len(held) >= 4 and sizes[-1] <= 3 * sizes[len(sizes) // 2]  # no task has more than three times the median


def merged(rows):
    out = {}
    for g, a, b in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        own = out.setdefault(g, [])
        if own and a <= own[-1][1] + 1:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return sorted(str((g, a, b)) for g, some in out.items() for a, b in some)


def test_ranges_pages_and_windows_of_hot_groups(spark, hot, many_parts):
    ranges = hot.select("g", F.col("at").alias("a"), (F.col("at") + F.coalesce("v", F.lit(0))).alias("b"))
    assert rows_of(citations.merge_ranges(ranges, ["g"], "a", "b")) == merged([tuple(r) for r in ranges.collect()])
    pages = {r["g"]: r["pages"] for r in citations.page_ranges(hot.select("g", "at"), ["g"], "at").collect()}
    for g in ("hot", None, "g1"):
        own = sorted({r["at"] for r in hot.where(F.col("g").eqNullSafe(g)).collect()})
        runs = [[p, p] for p in own[:1]]
        for p in own[1:]:
            if p == runs[-1][1] + 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        assert pages[g] == ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)
    talk = hot.select(F.col("g").alias("conv_id"), F.col("id").alias("turn"), F.repeat(F.lit("x"), F.col("at") % 40).alias("text"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    want = talk.withColumn("tokens", tx.token_estimate(F.col("text")) + 4).withColumn("used", F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    want = want.withColumn("n", F.row_number().over(back)).where("used <= 500 or n <= 3").drop("n")
    assert rows_of(conversation.message_window(talk, 500, 3).select(*want.columns)) == rows_of(want)


def test_days_merge_into_weeks(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"2024-03-{1 + n % 20:02d}", rng.choice("ab"), rng.randrange(3000), rng.randrange(100)) for n in range(20_000)]
    logs = spark.createDataFrame(rows, "day string, app string, user long, cents long").withColumn("day", F.col("day").cast("date"))
    partials = lambda some: usage.daily_partials(some, F.col("day"), ["app"], "user", {"cents": F.col("cents")})
    store = usage.UsageStore(spark, str(tmp_path / "usage"))
    store.put(partials(logs.where("day < '2024-03-20'")))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "usage").rglob("*.parquet")}
    store.put(partials(logs.where("day = '2024-03-20'")))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # a day added rewrites nothing
    week = F.to_date(F.date_trunc("week", F.col("day")))
    keyed = lambda df: {(r["period"], r["app"]): r for r in df.collect()}
    got, whole = keyed(usage.merged(store.read(), week, ["app"], ["cents"])), keyed(usage.merged(partials(logs), week, ["app"], ["cents"]))
    exact = keyed(logs.groupBy(week.alias("period"), "app").agg(F.count("*").alias("n"), F.sum("cents").alias("c"), F.countDistinct("user").alias("u")))
    assert got == whole  # stored days, the last added alone, give what one run over the log gives
    for key, r in exact.items():
        assert (got[key]["requests"], got[key]["cents"]) == (r["n"], r["c"]) and abs(got[key]["users"] - r["u"]) <= 0.05 * r["u"]
    assert usage.merged(store.read("2024-03-04", "2024-03-05"), None, [], ["cents"]).first()["requests"] == 2000
    plan = store.read("2024-03-20")._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_packs_in_an_order_of_text(spark, hot, many_parts):
    rows = hot.select("g", F.format_string("%05d", "id").alias("name"), (F.col("at") % 7).alias("cost"))
    w = Window.partitionBy("g").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("used", F.sum("cost").over(w)).where("used <= 500")
    assert rows_of(select.pack_stop(rows, ["g"], ["name"], "cost", 500).select(*want.columns)) == rows_of(want)
