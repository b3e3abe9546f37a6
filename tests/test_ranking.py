"""Places over ranges against a sort: ties, nulls, one large group, repeated rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import catalog, ranking


def made(n):
    r = random.Random(8)
    return [(r.choice(["a", "b", "b", "b", None]), r.choice([None, *range(5)]), r.choice("xyz")) for _ in range(n)] + [("b", 3, "x")] * 200


@pytest.mark.parametrize("within", [None, ["g"], ["g", "v"]])
def test_places_as_a_sort_gives_them(spark, within):
    rows = made(400)
    t = spark.createDataFrame(rows, "g string, k int, v string").repartition(5)
    got = ranking.placed(t, [F.col("k").asc_nulls_last(), F.col("v").desc(), F.col("g").asc_nulls_first()], within)
    assert got.columns == ["g", "k", "v", "place"]
    groups = {}
    for g, k, v in rows:
        groups.setdefault(tuple({"g": g, "v": v}[c] for c in within or []), []).append((g, k, v))
    want = Counter()
    for members in groups.values():
        members.sort(key=lambda x: (x[1] is None, x[1] or 0, -ord(x[2]), x[0] or ""))
        want.update((*m, i) for i, m in enumerate(members, 1))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert ranking.placed(t.where("false"), [F.col("k").asc()], within).collect() == []


def test_a_large_group_is_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    t = spark.range(20_000).select(F.lit("one").alias("g"), (F.col("id") % 3).alias("k"))
    got = ranking.placed(t, [F.col("k").asc()], ["g"])
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().replace("_n", "").split("Join")[0]
    spread = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 15_000
    assert got.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first()[:] == (20_000, 1, 20_000)


def test_siblings_of_families_of_any_size(spark):
    r = random.Random(9)
    rows = [(i, f"n{r.randint(0, 999):03d}", r.choice([1, 1, 1, 2, 3, None])) for i in range(60)] + [(100, "alone", 9)]
    order = catalog.listing_order("id", "name", "name")
    got = {}
    for x in catalog.siblings(spark.createDataFrame(rows, "id int, name string, fam int"), "fam", "id", "name", order, 4).orderBy("id", "nth").collect():
        got.setdefault(x.id, []).append((x.nth, x.sibling, x.total))
    want = {}
    for i, _, f in rows:
        others = [n for j, n, g in sorted(rows) if g == f and j != i]
        if others:
            want[i] = [(k + 1, n, len(others)) for k, n in enumerate(others[:4])]
    assert got == want


def test_first_rows_of_a_group_are_kept_by_each_task(spark):
    t = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    first = ranking.first_k(t, [F.col("id").desc()], ["g"], 3)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.g, r.id, r.place) for r in first.collect()) == [(0, 994, 3), (0, 996, 2), (0, 998, 1), (1, 995, 3), (1, 997, 2), (1, 999, 1)]
