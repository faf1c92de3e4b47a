"""Global numbers along an order."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from threadloom.functions.ordered import lower_medians, nearest_others, number_rows


def numbered(spark, rows):
    df = spark.createDataFrame(rows, "k int, id long, number string").repartition(5)
    out = number_rows(df, [F.desc("k"), F.asc_nulls_last("id")], lambda t: t.checkpoint())
    return sorted((r["number"], r["k"], r["id"]) for r in out.collect())


def test_numbers_with_ties_and_repeated_rows(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, 1, 2, 7, 7, 7]), draw.choice([None, 1, 2, 3, i]), "x") for i in range(3000)]
    want = sorted(((k, i) for k, i, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0))
    assert numbered(spark, rows) == [(n + 1, *r) for n, r in enumerate(want)]


def test_no_rows(spark):
    assert numbered(spark, []) == []


def others(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    out = []
    for i, (host, place, text) in enumerate(rows):
        near = []
        for side in (range(i - 1, -1, -1), range(i + 1, len(rows))):
            j = next((j for j in side if (rows[j][0], rows[j][2]) != (host, text)), None)
            near.append(rows[j][1] if j is not None and rows[j][0] == host else None)
        out.append((place, *near))
    return sorted(out)


def test_nearest_others_over_ranges(spark):
    """Long runs over several ranges, groups of one kind, nulls."""
    draw = random.Random(4)
    for n, kinds in ((1, 2), (40, 1), (60, 2), (400, 3), (400, 40)):
        rows = [(draw.choice([None, "a", "a", "b"]), i, draw.choice([None, *range(kinds)]) if i % 90 < 30 else 0) for i in range(n)]
        df = spark.createDataFrame(rows, "host string, place long, text long").repartition(3).withColumn("before", F.lit(1))
        out = nearest_others(df, [F.asc_nulls_first("host"), F.col("place")], ["host"], ["text"], "place", lambda t: t.checkpoint())
        assert sorted((r["place"], r["before"], r["after"]) for r in out.collect()) == others(rows)
    assert nearest_others(df.where("false"), [F.asc("host"), F.col("place")], ["host"], ["text"], "place", lambda t: t.checkpoint()).collect() == []


def test_lower_medians(spark):
    """Groups of all rows and of one, all values different, ties, null keys and values."""
    draw = random.Random(2)
    rows = [(draw.choice([None, "a", "b"]), draw.choice([1, 2]), draw.choice([None, float(i), 3.5, -1.0])) for i in range(500)] + [("one", 1, 7.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(3)
    for keys in ([], ["k"], ["k", "j"]):
        groups = {}
        for k, j, v in rows:
            groups.setdefault(tuple({"k": k, "j": j}[c] for c in keys), []).extend([] if v is None else [v])
        want = {g: sorted(v)[(len(v) + 1) // 2 - 1] for g, v in groups.items() if v}
        got = lower_medians(df, keys, "v", lambda t: t.checkpoint()).collect()
        assert len(got) == len(want) and {tuple(r)[:-1]: r["lower_median"] for r in got} == want
    ids = lower_medians(spark.range(10_001), [], "id", lambda t: t.checkpoint())
    assert [tuple(r) for r in ids.collect()] == [(5000,)] and lower_medians(df.where("false"), ["k"], "v", lambda t: t.checkpoint()).collect() == []
