"""Variants keep types over batches; places meet whatever their spelling."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingspark.operators import places, variants

def at():
    return F.lit("2024-01-01").cast("timestamp")


def files_of(path: Path) -> dict[str, int]:
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_number_then_list_keep_their_types(spark, tmp_path):
    path = str(tmp_path / "bronze")
    variants.append_batch(variants.packed(spark.createDataFrame([(1, 5.5, "x")], "id long, price double, only_old string"), ["id"]), path, "a", at())
    before = files_of(tmp_path / "bronze")
    variants.append_batch(variants.packed(spark.createDataFrame([(2, [1, 2]), (3, None)], "id long, price array<int>"), ["id"]), path, "b", at())
    assert before.items() <= files_of(tmp_path / "bronze").items()
    for _ in range(2):
        variants.append_batch(variants.packed(spark.createDataFrame([(4, "12.5"), (5, "call us")], "id long, price string"), ["id"]), path, "7", at())
    out = variants.read_batches(spark, path)
    price = F.try_variant_get("raw", "$.price", "variant")
    rows = out.select("id", "batch", variants.kind_of(price), variants.field("raw", "price", "double"), variants.field("raw", "price", "string"), variants.field("raw", "only_old", "string")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "a", "NUMBER", 5.5, "5.5", "x"), (2, "b", "ARRAY", None, "[1,2]", None), (3, "b", "NULL", None, None, None), (4, "7", "STRING", 12.5, "12.5", None), (5, "7", "STRING", None, "call us", None),
    ]
    wanted = T.StructType([T.StructField("price", T.ArrayType(T.IntegerType())), T.StructField("id", T.StringType())])
    flat = variants.as_columns(out, wanted)
    assert flat.columns == ["_collected_at", "batch", "price", "id"]
    assert [r["price"] for r in flat.filter("batch = 'b'").orderBy(F.col("price").isNull()).collect()] == [[1, 2], None]


def test_lines_that_are_no_objects(spark):
    long = json.dumps({"long": "x" * 1_000_000, "a.b": 1, "it's": 2})
    lines = [("{}",), ("[1, 2]",), ("3",), ("null",), (None,), ("",), ("{broken",), ('{"a": 1}',), ('{"a": 1}',), ('{"a": null, "b": {"c": [true]}}',), (long,)]
    out = variants.parsed(spark.createDataFrame(lines, "line string").withColumn("raw", F.lit("clash")), "line")
    assert out.columns == ["raw", "broken"]
    assert sorted(r["broken"] for r in out.filter("broken is not null").collect()) == ["", "{broken"]
    said = {(r["key"], r["kind"]): (r["n"], r["type"]) for r in variants.variant_coverage(out).collect()}
    assert said == {("a", "NUMBER"): (2, "BIGINT"), ("a", "NULL"): (1, "VOID"), ("b", "OBJECT"): (1, "OBJECT<c: ARRAY<BOOLEAN>>"), ("long", "STRING"): (1, "STRING"), ("a.b", "NUMBER"): (1, "BIGINT"), ("it's", "NUMBER"): (1, "BIGINT")}
    assert out.select(F.max(F.length(variants.field("raw", "long", "string")))).first()[0] == 1_000_000
    assert out.select(F.sum(variants.field("raw", "a.b", "int")), F.sum(variants.field("raw", "it's", "int"))).first() == (1, 2)


def test_variants_of_nothing(spark, tmp_path):
    none = variants.packed(spark.createDataFrame([], "id long, price double"), ["id"])
    variants.append_batch(none, str(tmp_path / "b"), "a", at())
    assert variants.read_batches(spark, str(tmp_path / "b")).count() == 0
    assert variants.variant_coverage(none).collect() == []
    assert variants.packed(spark.createDataFrame([(1,)], "id long"), ["id"]).select(F.to_json("raw")).first()[0] == "{}"


def test_places_meet_in_any_spelling(spark):
    spellings = [("Œuilly", 1), ("OEUILLY", 1), ("œuilly", 1), ("St-Étienne", 2), ("SAINT ETIENNE", 2), ("saint étienne", 2), ("Ste. Foy", 3), ("sainte-foy", 3), ("Estaing", 4), ("L'Haÿ", 5), ("l’hay", 5), ("Ærø", 6), ("AERØ", 6), (None, None), ("", None), (" - ", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(spellings)], "id int, city string, want int")
    right = spark.createDataFrame([("oeuilly", 1), ("saint-etienne", 2), ("SAINTE FOY", 3), ("ESTAING", 4), ("L HAY", 5), ("aerø", 6), ("Paris", 7), (None, 8), ("", 9)], "city string, want int")
    out = places.join_by_place(df, right, ("city", "city"))
    assert out.columns == ["id", "city", "want", "right_city", "right_want"]
    rows = out.collect()
    assert len(rows) == len(spellings) and all(r["want"] == r["right_want"] for r in rows)
    counts = {r["city"]: r["n"] for r in places.count_by_place(df.filter("want is not null"), "city", [F.count("*").alias("n")]).collect()}
    assert counts == {"OEUILLY": 3, "SAINT ETIENNE": 3, "Ste. Foy": 2, "Estaing": 1, "L'Haÿ": 2, "AERØ": 2}


def test_collation_is_the_fold_on_latin_letters(spark):
    """Places are equal by collation where their folded keys are, on names of the letters that the fold knows."""
    from listingspark.functions.text_fr import MARKED, city_key

    names = sorted({f"{a}{x}{b}" for x in MARKED.strip() for a, b in (("Ch", "teau"), ("St ", " bois"))} | {"Chateau", "saint-a-bois", "CHÉTEAU"})
    df = spark.createDataFrame([(n,) for n in names], "city string")
    by = lambda key: sorted(sorted(r[0]) for r in df.groupBy(key.alias("k")).agg(F.collect_list("city")).select("collect_list(city)").collect())
    assert by(places.place_name(F.col("city"))) == by(city_key(F.col("city")))


def test_imputed_by_place(spark):
    df = spark.createDataFrame([(1, "Évreux", "27000", "x"), (2, "EVREUX", "27000", "x"), (3, "evreux", "27001", "x"), (4, "évreux", None, "x"), (5, "Évreux", None, "y"), (6, None, None, "x"), (7, "Lac", None, "x"), (8, "Pau", "64001", "x"), (9, "PAU", "64000", "x"), (10, "pau", None, "x")], "id int, city string, code string, _n string")
    out = places.impute_by_place(df, df, "city", "code", ["_n"])
    assert out.columns == df.columns
    assert {r["id"]: r["code"] for r in out.filter("id in (1, 3, 4, 5, 6, 7, 10)").collect()} == {1: "27000", 3: "27001", 4: "27000", 5: None, 6: None, 7: None, 10: "64000"}
    none = df.limit(0)
    assert places.impute_by_place(none, none, "city", "code").count() == 0
