"""Located records as CSV, GeoJSON and KML, and the bytes of a workbook.

Text sinks are one column of lines that Spark writes in parallel: a file a partition, each complete in itself. ``exports.write_workbooks`` writes
workbooks the same way.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_xml


def write_csv(rows: DataFrame, path: str, x: str = "x", y: str = "y", separator: str = ";") -> None:
    """X_UTM30 and Y_UTM30 first, two decimals, rows without a place left out."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rest = [c for c in rows.columns if c not in (x, y)]
    ok.select(F.format_string("%.2f", x).alias("X_UTM30"), F.format_string("%.2f", y).alias("Y_UTM30"), *rest).write.option("header", True).option("sep", separator).option("quoteAll", True).mode("overwrite").csv(path)


def write_lines(rows: DataFrame, path: str, separator: str = ";") -> None:
    """Delimited text as spreadsheets want it: a byte order mark and the header in front of each file, quotes only where they are needed."""
    quoted = lambda c: F.when(c.rlike(f'[{separator}"\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    lines = rows.select(F.concat_ws(separator, *(quoted(F.col(c).cast("string")) for c in rows.columns)).alias("value"))
    _framed(lines, "\ufeff" + separator.join(rows.columns) + "\n", "", "").where("value <> ''").write.mode("overwrite").text(path)


def features(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One GeoJSON feature a row, as a column ``value``."""
    properties = F.struct(*(c for c in rows.columns if c not in (x, y)))
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_geojson(rows: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    """A feature collection a file."""
    head = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:25830"}},"features":['
    _framed(features(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y), head, "]}", ",").write.mode("overwrite").text(path)


def write_kml(rows: DataFrame, path: str, name: str, lon: str, lat: str) -> None:
    data = F.concat(*(F.concat(F.lit(f'<Data name="{escape(c)}"><value>'), escape_xml(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</value></Data>")) for c in rows.columns))
    mark = F.concat(F.lit("<Placemark><name>"), escape_xml(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit("</name><ExtendedData>"), data, F.lit("</ExtendedData><Point><coordinates>"), F.col(lon).cast("string"), F.lit(","), F.col(lat).cast("string"), F.lit(",0</coordinates></Point></Placemark>"))
    lines = rows.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(mark.alias("value"))
    _framed(lines, '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>", "").write.mode("overwrite").text(path)


def _framed(lines: DataFrame, head: str, tail: str, between: str) -> DataFrame:
    """Puts head, separators and tail around the lines of each partition."""

    def run(batches):
        import pyarrow as pa

        fresh = True
        for batch in batches:
            values = [(between if i or not fresh else head) + v for i, v in enumerate(batch.column("value").to_pylist())]
            fresh = fresh and not values
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([head + tail if fresh else tail])], names=["value"])

    return lines.mapInArrow(run, "value string")


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """An XLSX file of sheets (columns, rows); all cells are inline strings or numbers."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{part}.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        for i, (columns, rows) in enumerate(sheets.values(), 1):
            body = []
            for r, values in enumerate([tuple(columns), *rows], 1):
                cells = []
                for c, v in enumerate(values):
                    ref = f"{_letters(c)}{r}"
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>')
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def _letters(c: int) -> str:
    out = ""
    while c >= 0:
        out, c = chr(65 + c % 26) + out, c // 26 - 1
    return out
