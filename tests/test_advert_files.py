"""Sales, rents and inventories read as a data source."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from listingspark.sources import advert_files


@pytest.fixture
def source(spark, tmp_path):
    advert_files.register(spark)

    def load(kind: str, files: dict[str, bytes], **options):
        for name, said in files.items():
            at = tmp_path / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(said)
        return spark.read.format("advert_files").options(kind=kind, **options).load(str(tmp_path))

    return load


def test_sales(source):
    long = "x" * 3_000_000
    files = {
        "2020/departements/59.csv.gz": gzip.compress(b'id_mutation,valeur_fonciere,nom_commune\n1,"1000,5","a ""b""\nc"\n2,,\n'),
        "2021/2A.csv": f"unknown,nom_commune,id_mutation\nz,{long},3\nz,Œuilly,4\n".encode(),
        "2021/60.csv": b"",
        "2021/61.csv": b"id_mutation\n",
        "2021/readme.txt": b"no table",
        "notes.csv": b"no,table\n",
    }
    rows = {r["id_mutation"]: r for r in source("sales", files).collect()}
    assert {k: (r["annee"], r["departement"], r["valeur_fonciere"]) for k, r in rows.items()} == {"1": ("2020", "59", "1000,5"), "2": ("2020", "59", None), "3": ("2021", "2A", None), "4": ("2021", "2A", None)}
    assert rows["1"]["nom_commune"] == 'a "b"\nc' and rows["2"]["nom_commune"] is None and rows["3"]["nom_commune"] == long and rows["4"]["nom_commune"] == "Œuilly"
    assert rows["1"]["type_local"] is None


def test_only_chosen_files_are_opened(source):
    """A file that can't be read does no harm to those who ask for others; who asks for it learns of it."""
    files = {"2020/59.csv": b"id_mutation\n1\n", "2021/59.csv": b"id_mutation\n2\n", "2021/60.csv": b"id_mutation\n3\n", "2022/59.csv.gz": b"broken"}
    df = source("sales", files)
    assert [r["id_mutation"] for r in df.filter("annee = '2020'").collect()] == ["1"]
    chosen = df.filter("annee in ('2020', '2021') and departement = '59' and id_mutation > 1")
    assert [r["id_mutation"] for r in chosen.collect()] == ["2"]
    assert df.filter("annee = '2020'").rdd.getNumPartitions() == 1
    assert df.filter("annee = '1999'").count() == 0 and df.filter("annee = '2020' and annee = '2021'").count() == 0
    with pytest.raises(Exception, match="(?i)zlib|gzip|header"):
        df.filter("annee = '2022'").collect()


def test_rents(source):
    header = "LIBGEO;INSEE_C;loypredm2;lwr.IPm2;upr.IPm2;TYPPRED;nbobs_com;R2_adj\n"
    said = (header + '"Œuilly – l’Été €";"80000";"12,5";"10,1";"";"commune";"7";"0,8"\n').encode("cp1252") + b'"\x81";"1";"n.c.";;"-3";;"7,5";"1e1"\n'
    df = source("rents", {"appartement/tous.csv": said, "maison/tous.csv": header.encode()})
    assert dict(df.dtypes)["n"] == "int" and dict(df.dtypes)["loyer_m2"] == "double"
    a, b = df.orderBy(F.desc("code_commune")).collect()
    assert tuple(a) == ("appartement", "tous", "80000", "Œuilly – l’Été €", 12.5, 10.1, None, "commune", 7, 0.8)
    assert tuple(b) == ("appartement", "tous", "1", "\x81", None, None, -3.0, None, None, 10.0)


def test_inventories(source):
    long = "http://x/" + "y" * (advert_files.BLOCK + 5)
    df = source("inventory", {"s/2024-01-01.txt": f"http://x/1\n\n  http://x/é \r\nhttp://x/1\n{long}\nlast".encode(), "s/2024-01-02.txt.gz": gzip.compress(b"\n"), "t/2024-01-02.txt": b""})
    assert sorted(map(tuple, df.collect())) == sorted([("s", "2024-01-01", x) for x in ("http://x/1", "http://x/é", "http://x/1", long, "last")])


def test_no_files(spark, tmp_path):
    advert_files.register(spark)
    for kind in ("sales", "rents", "inventory"):
        for at in (tmp_path, tmp_path / "nowhere"):
            assert spark.read.format("advert_files").options(kind=kind).load(str(at)).count() == 0


def test_paths():
    assert advert_files.place("file:/a/b")[1] == advert_files.place("file:///a/b")[1] == advert_files.place("/a/b")[1] == "/a/b"
