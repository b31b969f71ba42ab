"""From the cells of a document's tables to records: header, roles of columns, rows that name a place, coordinates.

A table's header is within its first rows, so structure is an aggregate of a handful of rows a table; rows are then judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, coords, fused_text

# Headings of columns by role (patterns, lower case).
ROLES = {
    "name": r"\b(nombre|denominaci[oó]n|descripci[oó]n|elemento|infraestructura|instalaci[oó]n)\b",
    "address": r"\b(direcci[oó]n|ubicaci[oó]n|localizaci[oó]n|domicilio|emplazamiento)\b",
    "type": r"\b(tipo|tipolog[ií]a|categor[ií]a|clase|naturaleza)\b",
    "x": r"\b(longitud|este|easting)\b|coord[^y]*x|^x\s*[-_]|^x$",
    "y": r"\b(latitud|norte|northing)\b|coord[^x]*y|^y\s*[-_]|^y$",
    "both": r"coordenadas?",
}
_SECOND = {"x": r"^x$|^x\s*[-_]|\blongitud\b|\beste\b", "y": r"^y$|^y\s*[-_]|\blatitud\b|\bnorte\b"}
# Names of rows that name no place.
NO_PLACE = [
    r"^[xy][-_\s]*(longitud|latitud|utm|coord)?$", r"^(longitud|latitud|este|norte|easting|northing)$", r"^(indicar|completar|rellenar|ejemplo|muestra|-+|\.+|_+|n/a|sin\s*datos?)$",
    r"^(movimiento|incendio|accidente|inundaci|sequ[ií]a|terremoto|epidemia|tipolog[ií]a)s?\s", r"aforo:\s*\d+\s*personas?", r"^(no existe|suplente|pendiente|sin\s*(constancia|determinar)|otros?)$",
]
_PERSON = r"^[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){2}$"
# Headings of lists of staff, and those that show that a table is none.
STAFF_TABLE, PLACE_TABLE = r"cargo|tel[eé]fono\s*(de)?\s*contacto|disponibilidad|suplente|titular|responsable", r"coordenada|utm|direcci[oó]n|ubicaci[oó]n"
#: Rows that may hold the header; least trust in a table without coordinates.
HEADER_ROWS, LEAST = 3, 50


def grid(cells: DataFrame) -> DataFrame:
    """(path, sheet, row, cells) of cells (path, sheet, row, col, value); missing ones are empty texts. Rows without any cell aren't there."""
    wide = cells.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"), F.max("col").alias("last"))
    return wide.select("path", "sheet", "row", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.col("m")[i], F.lit(""))).alias("cells"))


def _first(cells: Column, pattern: str) -> Column:
    """Place of the first cell that fits; null without."""
    return F.nullif(F.array_position(F.transform(cells, lambda c: F.lower(F.trim(c)).rlike(pattern)), F.lit(True)) - 1, F.lit(-1)).cast("int")


def structure(rows: DataFrame) -> DataFrame:
    """(path, sheet, name, address, type, x, y, start, trust, staff) of tables (path, sheet, row, cells): places of the columns, null if there is none.

    The header is the first of the first rows that names a column for names, addresses or coordinates; a row behind it of only "X" and "Y", or of up to four
    cells that speak of both or of latitude, longitude or a grid, belongs to it. A heading "coordinates" stands for its column and the next one. Trust: 30 for a
    name, 30 for an address, 40 for coordinates. Without a heading for names the first column holds them.
    """
    at = {role: _first(F.col("cells"), pattern) for role, pattern in ROLES.items()}
    x = F.least(at["x"], at["both"])
    y = F.when(at["both"].isNull() | (at["y"] <= at["both"]), at["y"]).otherwise(at["both"] + 1)
    judged = rows.select(
        "path", "sheet", "row", "cells", at["name"].alias("name"), at["address"].alias("address"), at["type"].alias("type"), x.alias("x"), y.alias("y"),
        F.dense_rank().over(_by_row()).alias("n"),
    ).where(F.col("n") <= HEADER_ROWS + 1)
    some = F.coalesce("name", "address", "x", "y").isNotNull() & (F.col("n") <= HEADER_ROWS)
    per = judged.groupBy("path", "sheet").agg(F.array_sort(F.collect_list(F.struct("n", "row", "cells", "name", "address", "type", "x", "y", some.alias("some")))).alias("r"), F.count("*").alias("rows"))
    head = per.withColumn("h", F.get(F.filter("r", lambda q: q["some"]), 0)).withColumn("next", F.get(F.filter("r", lambda q: q["n"] == F.col("h.n") + 1), 0))
    filled = F.filter("next.cells", lambda c: F.trim(c) != "")
    said = F.lower(F.trim(F.array_join(filled, " ")))
    second = F.coalesce(said.rlike(r"^[xy\s\-_]+$") | (F.size(filled) <= 4) & said.rlike(r"\bx\b.*\by\b|longitud|latitud|utm"), F.lit(False))
    kind = F.get(F.filter(F.transform(F.filter("r", lambda q: q["n"] <= F.coalesce(F.col("h.n"), F.lit(HEADER_ROWS))), lambda q: q["type"]), lambda t: t.isNotNull()), 0)
    return head.select(
        "path", "sheet", F.coalesce("h.name", F.lit(0)).alias("name"), F.col("h.address").alias("address"), kind.alias("type"),
        F.coalesce("h.x", F.when(second, _first(F.col("next.cells"), _SECOND["x"]))).alias("x"), F.coalesce("h.y", F.when(second, _first(F.col("next.cells"), _SECOND["y"]))).alias("y"),
        F.coalesce(F.when(second, F.col("next.row") + 1).otherwise(F.col("h.row") + 1), F.lit(1)).alias("start"),
        (F.when(F.col("h.name").isNotNull(), 30).otherwise(0) + F.when(F.col("h.address").isNotNull(), 30).otherwise(0) + F.when(F.coalesce("h.x", "h.y").isNotNull(), 40).otherwise(0)).cast("long").alias("trust"),
    )


def _by_row():
    from pyspark.sql import Window as W

    return W.partitionBy("path", "sheet").orderBy("row")


def names_place(cells: Column, name: Column) -> Column:
    """Whether a row's cells name a place: a name of three letters at least that is no heading, placeholder, risk, person or resource, and one cell more."""
    n = F.trim(F.coalesce(name, F.lit("")))
    low = F.lower(n)
    bad = low.rlike(ROLES["name"]) | low.rlike(ROLES["address"]) | n.rlike(_PERSON)
    for pattern in NO_PLACE:
        bad = bad | low.rlike(pattern)
    return (F.length(n) >= 3) & ~bad & (F.size(F.filter(cells, lambda c: F.length(F.trim(c)) > 1)) >= 2)


def table_facts(rows: DataFrame) -> DataFrame:
    """(path, sheet, staff, utm): whether a table is a list of staff by its first five rows, and whether any cell is a northing."""
    northing = F.exists("cells", lambda c: coords.is_utm(coords.clean_cell(c), "y"))
    first = rows.withColumn("n", F.dense_rank().over(_by_row()))
    text = F.lower(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "cells")))), lambda r: r["cells"])), " "))
    return first.groupBy("path", "sheet").agg(text.alias("t"), F.max(northing).alias("utm")).select("path", "sheet", (F.col("t").rlike(STAFF_TABLE) & ~F.col("t").rlike(PLACE_TABLE)).alias("staff"), "utm")


def records(cells: DataFrame, words: list[str] = ()) -> DataFrame:
    """Records (path, sheet, row, name, type, address, x_text, y_text, has_coordinates, status, address_kind) of the tables of documents that list places.

    Tables of staff are left out, and such of less trust than ``LEAST`` without a northing; without headings for coordinates the columns are found by their values in
    the first three rows of data.
    """
    rows = grid(cells)
    found, facts = structure(rows), table_facts(rows)
    seen = rows.join(found.select("path", "sheet", "start"), ["path", "sheet"]).where((F.col("row") >= F.col("start")) & (F.col("row") < F.col("start") + 3))
    place = lambda which: F.min(F.nullif(F.array_position(F.transform("cells", lambda c: coords.is_utm(coords.clean_cell(c), which)), F.lit(True)) - 1, F.lit(-1)).cast("int"))
    by_value = seen.groupBy("path", "sheet").agg(place("x").alias("vx"), place("y").alias("vy"))
    good = found.join(facts, ["path", "sheet"]).where(~F.col("staff") & ((F.col("trust") >= LEAST) | F.col("utm"))).join(by_value, ["path", "sheet"], "left")
    good = good.withColumn("x", F.coalesce("x", "vx")).withColumn("y", F.coalesce("y", "vy")).drop("vx", "vy", "staff", "utm", "trust")
    cell = lambda at: F.trim(F.coalesce(F.get("cells", F.col(at)), F.lit("")))
    data = rows.join(good.withColumnsRenamed({c: f"at_{c}" for c in ("name", "address", "type", "x", "y")}), ["path", "sheet"]).where(F.col("row") >= F.col("start"))
    data = data.where(names_place(F.col("cells"), F.get("cells", F.col("at_name"))))
    clear = lambda at: F.coalesce(fused_text.separate(cell(at), words)["text"], F.lit(""))
    out = data.select("path", "sheet", "row", clear("at_name").alias("name"), clear("at_type").alias("said"), clear("at_address").alias("address"), coords.clean_cell(cell("at_x")).alias("x_text"), coords.clean_cell(cell("at_y")).alias("y_text"))
    has = coords.is_utm(F.col("x_text"), "x") & coords.is_utm(F.col("y_text"), "y")
    kind = F.when(F.col("said") != "", F.col("said")).otherwise(classify.record_kind(F.col("name"), F.col("said"), F.col("sheet")))
    return out.select("path", "sheet", "row", "name", kind.alias("type"), "address", "x_text", "y_text", has.alias("has_coordinates"), F.when(has, "original").otherwise("pending").alias("status"), classify.address_kind(F.col("address"), F.col("name")).alias("address_kind"))


def record_stats(found: DataFrame) -> DataFrame:
    """(grouping, label, n): records in all, with and without coordinates, by type and by table."""
    each = F.explode(F.array(
        F.struct(F.lit("total").alias("grouping"), F.lit("").alias("label")),
        F.struct(F.lit("coordinates").alias("grouping"), F.when(F.col("has_coordinates"), "with").otherwise("without").alias("label")),
        F.struct(F.lit("type").alias("grouping"), F.col("type").alias("label")), F.struct(F.lit("table").alias("grouping"), F.col("sheet").alias("label")),
    )).alias("s")
    return found.select(each).groupBy("s.grouping", "s.label").agg(F.count("*").alias("n"))


#: File endings and what reads them.
READERS = {"csv": "delimited", "xlsx": "cells", "xls": "cells", "xlsb": "cells", "xlsm": "cells", "ods": "cells", "fods": "cells", "doc": "text", "docx": "text", "odt": "cells", "rtf": "text", "txt": "text"}


def reader_of(path: str) -> str:
    """Name of the reader for a file; an error for an ending that none reads."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ending not in READERS:
        raise ValueError(f"no reader for {path!r}")
    return READERS[ending]
