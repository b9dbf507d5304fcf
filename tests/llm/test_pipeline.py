"""Each stage of the pipeline against plain Python on what the stage before kept."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listingspark.llm import quality

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("sf")
    rows = brute.corpus(7, 150)
    spark.createDataFrame(rows, brute.SCHEMA).repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    passages = [(k, " ".join(brute.words(rows[j][1])[:25])) for k, j in enumerate((11, 40, 77))]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to)


def by_id(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()}


def test_stages(spark, folder, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near-duplicates", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [by_id(docs)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.columns[:5] == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(by_id(docs))
    start, judged, lined, alone, clean, mixed = kept
    verdict = quality.judge_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r["doc_id"] for r in verdict.filter("kept").collect()}
    assert judged == {i: x for i, x in start.items() if i in good}
    assert all(brute.statistics(x[1])[0] >= 50 for x in judged.values()) and len(judged) > 30
    want = {i: (n, gone, t) for i, (n, gone, t) in brute.line_dedup(list(judged.values()), 2, 50).items() if gone == 0 or gone < n}
    assert {i: x[1] for i, x in lined.items()} == {i: t for i, (_, _, t) in want.items()}
    assert all(x[4] == len(x[1]) for x in lined.values()) and sum(gone > 0 for _, gone, _ in want.values()) > 0
    near = brute.near(list(lined.values()))
    assert alone == {i: x for i, x in lined.items() if near[i][2]}
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = brute.leaks(list(alone.values()), bench)
    assert clean == {i: x for i, x in alone.items() if leaks[i][1] == 0} and len(clean) < len(alone)
    assert set(mixed) <= set(clean) and all(clean[i] == x for i, x in mixed.items())
    copies = {r["doc_id"]: r["copies"] for r in docs.collect()}
    sizes = {i: len(brute.words(x[1])) for i, x in clean.items()}
    taken = sum(sizes[i] * c for i, c in copies.items())
    assert all(1 <= c <= 3 for c in copies.values()) and math.isclose(taken, sum(sizes.values()), rel_tol=0.1)


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*COLUMNS, "copies"] and out.count() > 10
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, out.select("doc_id", "copies").collect())) == sorted(map(tuple, again.select("doc_id", "copies").collect()))


def odd_table(spark):
    good, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "wv")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (None, good, "en", "s", 9), (2, "a " * 60, "en", None, 120), (3, "word " * 20000, "en", "s", 100000), (4, other, None, None, None), (4, other, None, None, None), (4, good + " x " + other, "en", "s", 9)]
    return spark.createDataFrame(rows, brute.SCHEMA).withColumns({c: F.lit(5) for c in ("copies", "id", "fp", "row", "kept", "doc", "_gone", "_lines", "a.b")})


def test_stages_on_odd_tables(spark, folder):
    """Nulls, repeated rows, one doc_id with two texts and columns of the operators' own names."""
    odd = odd_table(spark)
    base = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        found = out.collect()
        assert sorted(out.columns) == sorted(odd.columns) and all(r["a.b"] == r["_gone"] == 5 for r in found)
        base[name] = sorted(((r["doc_id"], r["text"]) for r in found), key=str)
        assert stage(spark, odd.limit(0), folder).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    by = lambda *ks: sorted((rows[k] for k in ks), key=str)
    assert base["quality rules"] == by(2, 5, 6, 7)
    lined = [(i, t) for i, t in rows]
    lined[7] = (4, rows[7][1])
    assert base["line dedup"] == sorted(lined, key=str)
    assert base["near-duplicates"] == by(*range(8)) and base["decontamination"] == by(*range(8))
    assert set(base["mixing"]) <= set(rows) and {t for _, t in base["mixing"]} and (None, None) not in base["mixing"]


def test_null_ids_are_judged_by_their_texts(spark, folder):
    """A null doc_id with a benchmark passage goes; one with a clean text stays through all stages but the mix."""
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    clean = " ".join(f"q{k}" for k in range(80))
    docs = spark.createDataFrame([(None, f"{clean} {leak}", "en", "s", 1), (None, clean, "en", "s", 1), (None, clean + "\n" + clean.upper(), "en", "s", 1)], brute.SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
    assert sorted(r["text"] for r in docs.collect()) == sorted([clean, clean + "\n" + clean.upper()])
