"""Every query with SQL gives what its SQL gives, on the smallest tables; the others run."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

from .compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    queries, oracles = entry.queries(), entry.oracle_sql()
    if name in oracles:
        assert difference(spark, SF, queries[name], oracles[name]) == ""
    else:
        assert queries[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert not set(entry.oracle_sql()) - set(entry.queries())


def other_tables(spark, tmp_path, **replaced):
    """A folder of the smallest tables, some of them replaced."""
    for file in os.listdir(SF):
        if file.removesuffix(".parquet") not in replaced:
            os.symlink(f"{SF}/{file}", tmp_path / file)
    for name, df in replaced.items():
        df.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_html_words_of_entities_cut_off(spark, tmp_path):
    """Pages whose text ends within an entity."""
    html = ["<p>a&amp;&amp</p><p>b</p>", "<p>&quot;c &quot</p>", "<p>&copy</p>&middot; d", "&amp;copy; &amp;amp", "<p>e &am</p>&", "<script>f&amp</script>&amp;g"]
    sf = other_tables(spark, tmp_path, pages=spark.createDataFrame([(i, f"https://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string"))
    assert difference(spark, sf, entry.queries()["html_words"], entry.oracle_sql()["html_words"]) == ""


def test_notices_are_read_in_many_tasks(spark):
    """Though the parts are in one file, of one partition."""
    assert entry.queries()["auction_lots"](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
