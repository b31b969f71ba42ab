"""Documents as tables: delimited text, spreadsheets (XLSX, ODS), text documents (ODT), GeoJSON.

Spreadsheets and ODT files are ZIP archives of XML; a Python data source reads a file a partition and yields cells, and
everything after that (headers, roles, cleaning) is DataFrame work.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

CELLS = "path string, sheet string, row int, col int, value string"
# How often a repeated cell is written out, filled and empty.
REPEAT_FILLED, REPEAT_EMPTY = 15, 2


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of the filled cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tag = lambda e: e.tag.rpartition("}")[2]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if tag(s) == "sheet"]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]
        for i, name in enumerate(names, 1):
            for cell in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter():
                if tag(cell) != "c":
                    continue
                value = "".join(x.text or "" for x in cell.iter() if tag(x) in ("v", "t"))
                if cell.get("t") == "s" and value:
                    value = shared[int(value)]
                if value:
                    yield name, int(re.search(r"\d+", cell.get("r"))[0]) - 1, _column(cell.get("r")), value


def odf_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Cells of the tables of an ODS or ODT file; repeated cells are written out up to a limit."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    local = lambda e: e.tag.rpartition("}")[2]
    get = lambda e, k: next((v for a, v in e.attrib.items() if a.rpartition("}")[2] == k), None)
    for n, table in enumerate(t for t in root.iter() if local(t) == "table"):
        for r, row in enumerate(x for x in table.iter() if local(x) == "table-row"):
            col = 0
            for cell in (c for c in row if local(c) in ("table-cell", "covered-table-cell")):
                value = "\n".join("".join(p.itertext()) for p in cell if local(p) == "p").strip()
                times = min(int(get(cell, "number-columns-repeated") or 1), REPEAT_FILLED if value else REPEAT_EMPTY)
                for k in range(times):
                    if value:
                        yield get(table, "name") or f"table{n + 1}", r, col + k, value
                col += times


def cells(spark: SparkSession, paths: str) -> DataFrame:
    """Cells of spreadsheets and documents, read by Spark's binary reader, so any store that Spark reaches will do."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                read = xlsx_cells if path.lower().endswith((".xlsx", ".xlsm")) else odf_cells
                rows = [(path, *c) for c in read(content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["path", "sheet", "row", "col", "value"])

    return files.mapInArrow(run, CELLS)


def records(found: DataFrame) -> DataFrame:
    """(path, sheet, row, fields map<header, value>): the first row of a sheet names the columns; blank headers count on."""
    first = found.groupBy("path", "sheet").agg(F.min("row").alias("head"))
    named = found.join(first, ["path", "sheet"])
    headers = named.where("row = head").select("path", "sheet", "col", F.trim("value").alias("header"))
    body = named.where("row > head").join(headers, ["path", "sheet", "col"], "left").withColumn("header", F.coalesce(F.nullif("header", F.lit("")), F.concat(F.lit("column_"), F.col("col").cast("string"))))
    return body.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "value")))).alias("fields"))


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, values array): text lines cut by the mark that cuts each file's first line most often."""
    lines = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).where("trim(text) <> ''")
    mark = lines.groupBy("path").agg(F.min_by("text", "line").alias("head")).select("path", T.delimiter(F.col("head")).alias("mark"))
    return lines.join(mark, "path").select("path", "line", F.expr("split(text, concat('\\\\Q', mark, '\\\\E'))").alias("values"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, every column a string, rows of nulls left out."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return rows.dropna("all")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, properties, x, y) of points; of other shapes the first vertex."""
    feature = "array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.schema(f"type string, features {feature}").option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f"))
    pair = lambda i: F.regexp_extract("f.geometry.coordinates", r"(-?[\d.]+(?:[eE][+-]?\d+)?)\s*,\s*(-?[\d.]+(?:[eE][+-]?\d+)?)", i).cast("double")
    return f.select(F.coalesce("f.id", F.col("f.properties")["id"]).alias("id"), F.coalesce(F.col("f.properties")["name"], F.col("f.properties")["nombre"]).alias("name"), F.col("f.properties").alias("properties"), pair(1).alias("x"), pair(2).alias("y")).where(F.col("x").isNotNull() & (F.col("x") != 0) & (F.col("y") != 0))


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Bulk upsert: the last row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file by its ending: delimited text and plain text as tables, spreadsheets and text documents as records; an error for other endings and for an empty file."""
    from . import structure

    kind = structure.reader_of(path)
    if kind == "delimited":
        found = csv(spark, path)
    elif kind == "text":
        found = delimited(spark, path)
    else:
        found = structure.records(cells(spark, path))
    if not found.columns or not found.limit(1).count():
        raise ValueError(f"no data in {path!r}")
    return found
