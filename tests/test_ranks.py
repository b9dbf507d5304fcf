"""Distributed ranks and quantiles against Spark's own, and workspaces that are removed."""

from __future__ import annotations

import os
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from listingspark.functions import text_fr
from listingspark.operators import ranks
from listingspark.plans.shared import Workspace, in_order, made_here, shared_dir


def numbers(spark):
    """One key with most rows, ties, nulls among keys and values."""
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, float(r.randint(0, 40)), r.random()]), i) for i in range(3000)] + [("lone", 5.0, -1), ("void", None, -2)]
    return spark.createDataFrame(rows, "k string, x double, id long").repartition(7)


def test_quantiles(spark):
    df, probs = numbers(spark), [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: (r["n"], list(r["q"])) for r in ranks.spread_quantiles(df, ["k"], "x", probs).collect()}
    want = {r["k"]: (r["n"], list(r["q"])) for r in df.filter("x is not null").groupBy("k").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, probs))).alias("q")).collect()}
    assert got.keys() == want.keys() and None in got and "void" not in got
    for k, (n, q) in want.items():
        assert got[k][0] == n and all(abs(a - b) < 1e-12 for a, b in zip(got[k][1], q, strict=True))
    assert ranks.spread_quantiles(df.limit(0), ["k"], "x", probs).count() == 0


def test_quantile_between_equal_values(spark):
    """A value that fills all places near a quantile is that quantile to the last bit, so that a trim keeps its rows."""
    values = [x / 100 for x in range(100_000, 100_400, 7)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values) for _ in range(59)], "k int, x double")
    probs = [0.01, 0.1, 0.33, 0.99]
    got = ranks.spread_quantiles(df, ["k"], "x", probs).collect()
    assert {r["k"]: list(r["q"]) for r in got} == {i: [x] * len(probs) for i, x in enumerate(values)}


def test_rank(spark):
    df = numbers(spark)
    order = [F.desc_nulls_last("x"), F.asc("id")]
    got = {r["id"]: r["rank"] for r in ranks.spread_rank(df, ["k"], order).collect()}
    want = {r["id"]: r["rank"] for r in df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
    assert got == want


def test_numbers_grow_in_order(spark):
    ws = Workspace(spark, "order")
    rows = in_order(ws, numbers(spark), [F.desc("k"), "id"], "t").orderBy("number").collect()
    key = lambda r: (r["k"] is None, tuple(-ord(x) for x in r["k"] or ""), r["id"])
    assert len({r["number"] for r in rows}) == len(rows) and sorted(rows, key=key) == rows


def test_workspaces_are_removed(spark):
    with made_here() as made:
        with made_here() as inner:
            out = ranks.spread_rank(numbers(spark), ["k"], [F.asc("id")]).count()
        last = Workspace(spark, "last")
    assert out == 3002 and len(inner) == 1 and made == [*inner, last] and os.path.isdir(made[0].path)
    made[0].remove()
    assert not os.path.isdir(made[0].path) and made[0].path.startswith(shared_dir(spark))


def test_quick_patterns():
    """A look at the first letter changes no match."""
    r = random.Random(1)
    words = [w for p in text_fr.FLAGS.values() for w in re.findall(r"[a-z]{3,}(?: [a-z]+)*", p)]
    for name, pattern in text_fr.FLAGS.items():
        fast = text_fr.quick(pattern)
        assert fast.startswith("(?=[")
        for _ in range(200):
            text = " ".join(r.choice(words) for _ in range(6))
            assert [m.span() for m in re.finditer(pattern, text)] == [m.span() for m in re.finditer(fast, text)], name
    assert text_fr.quick(r"\bx|y") == r"\bx|y" and text_fr.quick("a(b|c)|d") == "(?=[ad])(?:a(b|c)|d)"
