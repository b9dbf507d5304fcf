"""Saved searches as rows, comparables kept up, tables merged in buckets, sketches: beside the ways that they stand for."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from listingspark.operators import comparables, percolator, search, sketches, tables, text_index, upkeep
from listingspark.plans import adverts
from listingspark.sources import buckets

SF = "/root/testdata/sf0.001"


# --- saved searches --------------------------------------------------------------------------------------------------

QUERIES = [q for q, _ in adverts.SEARCHES.values()] + [
    "", None, "&&=&x", "q=a%5Cb", "q=%25maison", "q=LAC+1_", "city=+LYON+", "city=N%C3%AEmes", "city=%ZZ", "department=2B", "department=974", "department=7", "postal_code=690",
    "price_min=1e5", "price_max=200000&price_min=100000", "price_min=0", "price_max=-5", "price_min=5&price_max=1", "price_min=nan", "price_min=abc&price_max=150000",
    "segment=&segment=murs", "segment=nothing", "type_bien=maison&type_bien=terrain&segment=residentiel", "new_days=10", "new_days=3.7", "auctions=no", "auctions=only", "scored_only=True", "scored_only=true",
    "level=bonne&department=20&price_max=90000.5", "include_inactive=true&include_duplicates=true", "unknown=1&source=s3", "surface_max=60&land_min=10&yield_min=5.5",
]


def test_percolator_is_the_predicate(spark):
    """Each search finds what its own predicate finds, from one plan."""
    df = adverts.deals(spark, SF).cache()
    searches = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)] + [(None, "")], "search int, query string")
    got = {}
    for r in percolator.percolate(df, searches, keep=["external_id", "titre"]).collect():
        got.setdefault(r["search"], []).append(r["external_id"])
    for i, q in enumerate(QUERIES):
        want = {k: v for k, v in search.criteria_of(q or "").items() if v == v}  # a bound that isn't a number is none
        assert sorted(got.get(i, [])) == sorted(r[0] for r in search.deal_filter(df, **want).select("external_id").collect()), q
    assert sum(map(bool, got.values())) > 20
    df.unpersist()


def test_percolator_plan_does_not_grow(spark):
    df = adverts.deals(spark, SF)
    sizes = [len(percolator.percolate(df, spark.range(n).select(F.col("id").alias("search"), F.lit("segment=murs").alias("query")), keep=["external_id"])._jdf.queryExecution().optimizedPlan().toString()) for n in (10, 10_000)]
    assert abs(sizes[0] - sizes[1]) < 1000
    empty = spark.createDataFrame([], "search int, query string")
    assert percolator.percolate(df, empty, keep=["external_id"]).count() == 0 and percolator.percolate(df.limit(0), spark.createDataFrame([(1, "")], "search int, query string"), keep=["external_id"]).count() == 0


def test_percolator_of_adverts_with_nulls(spark):
    """Places that an advert lacks are met by searches that don't ask for them, and by no other."""
    df = adverts.deals(spark, SF).limit(5).withColumns({x: F.lit(None).cast("string") for x in ("segment", "type_bien", "code_postal")} | {x: F.lit(None).cast("double") for x in ("prix", "loyer")})
    searches = spark.createDataFrame([(1, "include_inactive=true&include_duplicates=true"), (2, "include_inactive=true&include_duplicates=true&price_max=9e99"), (3, "department=69"), (4, "segment=murs")], "search int, query string")
    assert {r["search"] for r in percolator.percolate(df, searches, keep=["external_id"]).collect()} == {1}


# --- comparables -----------------------------------------------------------------------------------------------------


def near(a, b):
    return comparables.nearest(a, b, subject_key=["id"], pool_key=["v_id"], on=[([("p", "v_p")], None)], where=F.lit(True), distance=F.abs(F.col("x") - F.col("v_x")), k=3, band=("s", "v_s", 0.5, 2.0, 0.2))


KEYS = {"subject_key": ["id"], "pool_key": ["v_id"]}


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_batches_and_losses(spark, tmp_path):
    a = spark.range(40).select("id", (F.col("id") % 3).alias("p"), (F.col("id") * 7 % 11).cast("double").alias("x"), (F.col("id") % 5 + 2.0).alias("s"))
    b = spark.range(90).select(F.col("id").alias("v_id"), (F.col("id") % 3).alias("v_p"), (F.col("id") * 5 % 13).cast("double").alias("v_x"), (F.col("id") % 7 + 1.0).alias("v_s"))
    written = lambda df, n: (df.write.parquet(f"{tmp_path}/{n}"), spark.read.parquet(f"{tmp_path}/{n}"))[1]
    kept = written(upkeep.first_nearest(a, b.filter("v_id < 50"), near), "a")
    more = written(upkeep.add_to_nearest(kept, a, b.filter("v_id >= 50"), near, k=3, **KEYS), "b")
    assert rows(more, "id", "v_id", "rank", "distance") == rows(near(a, b), "id", "v_id", "rank", "distance")
    before, after = ({i: {(v, d) for k, v, d in rows(x, "id", "v_id", "distance") if k == i} for i in range(40)} for x in (kept, more))
    touched = dict(rows(more.select("id", "touched").distinct(), "id", "touched"))
    assert {i for i, n in touched.items() if n == 2} == {i for i in range(40) if after[i] != before[i] and before[i]} and set(touched.values()) == {1, 2}
    assert rows(upkeep.add_to_nearest(more, a, b.limit(0), near, k=3, **KEYS), *more.columns) == rows(more, *more.columns)
    first = upkeep.add_to_nearest(kept.limit(0), a, b, near, k=3, **KEYS)
    assert rows(first, "id", "v_id", "rank") == rows(near(a, b), "id", "v_id", "rank") and {r[0] for r in first.select("touched").collect()} == {1}
    less = upkeep.drop_from_nearest(more, a, b, b.filter("v_id % 4 = 1"), near, **KEYS)
    assert rows(less, "id", "v_id", "rank") == rows(near(a, b.filter("v_id % 4 <> 1")), "id", "v_id", "rank")
    moved = a.filter("id < 5").withColumn("x", F.col("x") + 4).unionByName(a.filter("id = 7").withColumn("id", F.lit(99).cast("long")))
    new = a.filter("id >= 5").unionByName(moved)
    assert rows(upkeep.change_subjects(more, moved, b, near, subject_key=["id"]), "id", "v_id", "rank") == rows(near(new, b), "id", "v_id", "rank")


# --- buckets ---------------------------------------------------------------------------------------------------------


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/{buckets.BUCKET}=*/*.parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.col("id").alias("first"))
    assert len(buckets.merge_buckets(spark, path, old, ["k"], 16)) == 16
    before = files(path)
    batch = spark.createDataFrame([(3, None, 1), (500, "new", 2), (3, "later", 9)], "k long, v string, first long")
    numbers = buckets.merge_buckets(spark, path, batch, ["k"], 16, {"v": "keep", "first": "insert"}, newest=[F.desc("first")])
    changed = {f for f in before.keys() | files(path).keys() if before.get(f) != files(path).get(f)}
    assert 1 <= len(numbers) <= 2 and {int(f.split(f"{buckets.BUCKET}=")[1].split("/")[0]) for f in changed} == set(numbers)
    got = {r["k"]: (r["v"], r["first"]) for r in buckets.read_buckets(spark, path).collect()}
    assert len(got) == 201 and got[3] == ("later", 3) and got[500] == ("new", 2) and got[4] == ("old", 4)
    assert buckets.merge_buckets(spark, path, batch.limit(0), ["k"], 16) == [] and len(buckets.read_buckets(spark, path, numbers).collect()) < 40


def test_merge_that_runs_again(spark, tmp_path):
    path = f"{tmp_path}/t"
    batch = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for _ in range(3):
        buckets.merge_buckets(spark, path, batch, ["k"], 4)
    assert rows(buckets.read_buckets(spark, path).na.fill("-"), "k", "v") == [(1, "a"), (2, "-")]


def test_update_from(spark, tmp_path):
    target = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 20, "c"), (None, 30, "d")], "k long, n int, s string")
    source = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (3, 9, 1), (None, 1, 1)], "k long, n int, o int")
    values = {"n": F.col("n") + F.col("new_n"), "s": F.lit("up")}
    assert rows(tables.update_from(target, source, ["k"], values, [F.desc("o")]).na.fill(0, ["k"]), "k", "n", "s") == [(0, 30, "d"), (1, 17, "up"), (1, 18, "up"), (2, 20, "c")]
    path = f"{tmp_path}/t"
    buckets.replace_buckets(buckets.with_bucket(target, ["k"], 8), path)
    before = files(path)
    numbers = buckets.update_buckets(spark, path, source, ["k"], 8, values, [F.desc("o")])
    assert rows(buckets.read_buckets(spark, path).na.fill(0, ["k"]), "k", "n", "s") == [(0, 30, "d"), (1, 17, "up"), (1, 18, "up"), (2, 20, "c")]
    same = {f for f in before if files(path).get(f) == before[f]}
    assert {int(f.split(f"{buckets.BUCKET}=")[1].split("/")[0]) for f in before.keys() - same} <= set(numbers)


# --- sketches --------------------------------------------------------------------------------------------------------


def test_refresh_reads_new_months_only(spark, tmp_path):
    """Sales of months that are written may be gone: the reference is the same."""
    day = F.expr("date_add(date '2020-01-15', cast(id % 700 as int))")
    sales = spark.range(20000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 1000).cast("double").alias("v"), day.alias("day"), (F.col("id") % 50).alias("town"))
    jan, end = 2020 * 12, 2022 * 12
    at = [f"{tmp_path}/{x}" for x in "ab"]
    sketches.add_months(spark, at[0], sales, ["k"], "v", "day", range(jan, end), ["town"])
    sketches.add_months(spark, at[1], sales, ["k"], "v", "day", range(jan, jan + 12), ["town"])
    sketches.add_months(spark, at[1], sales.filter("day >= date '2021-01-01'"), ["k"], "v", "day", range(jan + 12, end), ["town"])
    said = lambda p: sketches.merged_reference(spark.read.parquet(p), ["k"], F.lit("2021-07-20").cast("date"), 12, [0.0, 0.5, 1.0], trim=(0.01, 0.99))
    a, b = ({r["k"]: r for r in said(p).collect()} for p in at)
    exact = sales.filter("day >= date '2020-07-01' and day < date '2021-07-01'")
    want = {r["k"]: r for r in exact.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile("v", F.array(*map(F.lit, (0.01, 0.5, 0.99)))).alias("q")).collect()}
    for k in (0, 1):
        assert [a[k][x] == b[k][x] == want[k][x] for x in ("n", "least", "most")] == [True] * 3 and a[k]["mean"] == pytest.approx(want[k]["mean"]) == b[k]["mean"]
        assert all(abs(x - y) <= 10 for x, y in zip(a[k]["q"], want[k]["q"], strict=True)) and abs(a[k]["n_town"] - 25) <= 1
    part = spark.read.parquet(at[0]).filter(F.col(sketches.MONTH) == jan + 3)
    assert "PartitionFilters: [isnotnull(month_" in part._jdf.queryExecution().executedPlan().toString()


def test_sketches_odd(spark):
    odd = spark.createDataFrame([("a", None, "2020-01-01"), ("a", float("nan"), "2020-01-01"), ("b", 1.0, None), (None, 2.0, "2020-01-31")], "k string, v double, day string").withColumn("day", F.col("day").cast("date"))
    months = sketches.monthly_sketches(odd, ["k"], "v", "day", ["k"])
    assert [(r["k"], r["n"]) for r in months.collect()] == [(None, 1)]
    assert sketches.merged_reference(months, ["k"], F.lit("2020-02-01").cast("date"), 1, [0.5]).first()["q"] == [2.0]
    assert sketches.merged_reference(months.limit(0), ["k"], F.lit("2020-02-01").cast("date"), 1, [0.5]).count() == 0


# --- substrings ------------------------------------------------------------------------------------------------------


def test_terms_are_found_as_ilike_finds_them(spark, tmp_path):
    texts = ["Vue sur le LAC", "abcabc", "ab", "a", "", None, "éÉ x\ny z", "tail of ab", "İstanbul", "a\\b_%c", "👍 up 👍👍", "x" * 5000 + "needle"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "another text of key 0"), (None, "lac")], "id long, body string").withColumns({x: F.lit(1) for x in ("gram", "term", "key")})
    terms = ["lac", "LAC", "le lac", "abc", "bca", "ab", "b", "é", "ÉÉ", "x\ny", "nothing", "xyzabc", "", None, "\\b_", "_%", "👍", "👍 u", "needle", "key 0", "ab", "aaa"]
    text_index.write_index(df, f"{tmp_path}/i", "id", "body")
    got = {(r["term"], r["id"]) for r in text_index.find_terms(df, spark.createDataFrame([(t,) for t in terms], "term string"), f"{tmp_path}/i", "id", "body").collect()}
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "another text of key 0")]
    assert got == {(t, i) for t in terms if t for i, x in rows if x is not None and t.lower() in x.lower()}
    assert text_index.find_terms(df, spark.createDataFrame([], "term string"), f"{tmp_path}/i", "id", "body").count() == 0


def test_candidates_are_few(spark, tmp_path):
    """Texts without a term's rarest trigrams are never searched."""
    df = spark.createDataFrame([(i, f"common words in all texts {i * 7919 % 997:03d}q") for i in range(400)], "id long, body string")
    text_index.write_index(df, f"{tmp_path}/i", "id", "body")
    found = text_index.candidates(spark, f"{tmp_path}/i", spark.createDataFrame([("texts 123q",), ("all texts",)], "term string"))
    counts = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}
    assert counts.get("texts 123q", 0) <= 2 and counts["all texts"] == 400
