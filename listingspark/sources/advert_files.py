"""Files of sales, rents and inventories as a data source: spark.read.format("advert_files")."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..plans.shared import ship_package
from .files import CP1252, SALES

# Columns of rent files, and the names that they get.
RENTS = {"INSEE_C": "code_commune", "LIBGEO": "commune", "loypredm2": "loyer_m2", "lwr.IPm2": "loyer_m2_bas", "upr.IPm2": "loyer_m2_haut", "TYPPRED": "niveau", "nbobs_com": "n", "R2_adj": "r2"}
NUMBERS = {"loyer_m2": "double", "loyer_m2_bas": "double", "loyer_m2_haut": "double", "r2": "double", "n": "int"}

#: By kind: where files are below the path (named groups become the first columns), and how they are read.
LAYOUTS = {
    "sales": r"(?P<annee>\d{4})/(?:departements/)?(?P<departement>\w+)\.csv(?:\.gz)?",
    "rents": r"(?P<type_bien>\w+)/(?P<typologie>\w+)\.csv",
    "inventory": r"(?P<source>[^/]+)/(?P<jour>\d{4}-\d{2}-\d{2})\.txt(?:\.gz)?",
}
#: What CP1252 has where ISO-8859-1 has control characters; bytes that it leaves free stay as they are.
WESTERN = str.maketrans(CP1252)
BLOCK = 1 << 23


class OneFile(InputPartition):
    def __init__(self, at: str, fields: dict[str, str]):
        self.at, self.fields = at, fields


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it: of a uri, or of a local path; Hadoop's ``file:/x`` too."""
    if re.match(r"file:/(?!/)", path):
        path = path.removeprefix("file:")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class AdvertFilesReader(DataSourceReader):
    """A partition for each file. Filters of equality on the fields of the path choose files before any is opened."""

    def __init__(self, options, kind: str, names: list[str]):
        self.path, self.kind, self.names = options["path"].rstrip("/"), kind, names
        self.layout = re.compile(options.get("layout", LAYOUTS[kind]))
        self.encoding = options.get("encoding", "cp1252" if kind == "rents" else "utf-8")
        self.chosen: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]):
        for x in filters:
            values = (x.value,) if isinstance(x, EqualTo) else x.value if isinstance(x, In) else None
            if values is None or len(x.attribute) != 1 or x.attribute[0] not in self.layout.groupindex:
                yield x
                continue
            name = x.attribute[0]
            self.chosen[name] = self.chosen.get(name, set(values)) & set(values)

    def partitions(self) -> list[InputPartition]:
        system, root = place(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out = []
        for x in sorted(found, key=lambda x: x.path):
            said = self.layout.fullmatch(x.path.removeprefix(root).lstrip("/")) if x.type == fs.FileType.File else None
            if said and all(said[k] in v for k, v in self.chosen.items()):
                out.append(OneFile(x.path, said.groupdict()))
        return out or [OneFile("", {})]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Arrow batches of a file, read in blocks of 8 MB; a row of a table must fit into one."""
        if not partition.at:
            return
        system, _ = place(self.path)
        with system.open_input_stream(partition.at, compression="detect") as stream:
            western = self.encoding == "cp1252"
            encoding = "latin-1" if western else self.encoding
            read = lines_of(stream, encoding) if self.kind == "inventory" else rows_of(stream, self.kind, encoding)
            for columns, n in read:
                if western:
                    columns = {k: translated(v) if pa.types.is_string(v.type) else v for k, v in columns.items()}
                columns |= {k: pa.array([v] * n, pa.string()) for k, v in partition.fields.items()}
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], names=self.names)


def rows_of(stream, kind: str, encoding: str) -> Iterator[tuple[dict[str, pa.Array], int]]:
    """Columns of a file with a header, found by their names; missing ones are null, and so are empty values."""
    names = list(RENTS) if kind == "rents" else list(SALES)
    convert = pc.ConvertOptions(column_types={c: pa.string() for c in names}, include_columns=names, include_missing_columns=True, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
    parse = pc.ParseOptions(delimiter=";" if kind == "rents" else ",", newlines_in_values=True)
    try:
        batches = pc.open_csv(stream, pc.ReadOptions(block_size=BLOCK, encoding=encoding, use_threads=False), parse, convert)
    except pa.ArrowInvalid as e:
        if "Empty CSV" in str(e):
            return
        raise
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        if kind == "rents":
            columns = {RENTS[c]: number(v, NUMBERS[RENTS[c]]) if RENTS[c] in NUMBERS else v for c, v in columns.items()}
        yield columns, batch.num_rows


def number(values: pa.Array, of: str) -> pa.Array:
    """Decimal commas as points; what is no number is null."""
    convert = {"double": float, "int": int}[of]

    def one(x: str | None):
        try:
            return None if x is None else convert(x.strip().replace(",", "."))
        except ValueError:
            return None

    return pa.array([one(x) for x in values.to_pylist()], pa.float64() if of == "double" else pa.int32())


def translated(values: pa.Array) -> pa.Array:
    """Text that was read as ISO-8859-1 as CP1252 means it."""
    return pa.array([x if x is None or x.isascii() else x.translate(WESTERN) for x in values.to_pylist()], pa.string())


def lines_of(stream, encoding: str) -> Iterator[tuple[dict[str, pa.Array], int]]:
    """The urls of a file, one a line, without blanks around them; empty lines are none."""
    left = b""
    while True:
        block = stream.read(BLOCK)
        lines = (left + block).split(b"\n")
        left = lines.pop() if block else b""
        urls = [x for x in (y.decode(encoding).strip() for y in lines) if x]
        yield {"url": pa.array(urls, pa.string())}, len(urls)
        if not block:
            return


class AdvertFiles(DataSource):
    """Options: path, kind (sales, rents or inventory), layout (a pattern with named groups, below the path), encoding. Files that
    aren't there have no rows, nor have other files below the path. A file is a partition: the publishers cut them by year and
    department. Tables come as strings but for the numbers of rents; inventories have a row for each line, repeated ones too."""

    @classmethod
    def name(cls) -> str:
        return "advert_files"

    def schema(self) -> T.StructType:
        kind = self.options["kind"]
        fields = list(re.compile(self.options.get("layout", LAYOUTS[kind])).groupindex)
        columns = {"sales": list(SALES), "rents": list(RENTS.values()), "inventory": ["url"]}[kind]
        of = {"double": T.DoubleType(), "int": T.IntegerType()}
        return T.StructType([T.StructField(c, of[NUMBERS[c]] if kind == "rents" and c in NUMBERS else T.StringType()) for c in [*fields, *columns]])

    def reader(self, schema: T.StructType) -> AdvertFilesReader:
        return AdvertFilesReader(dict(self.options), self.options["kind"], schema.names)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with its filters pushed down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AdvertFiles)
