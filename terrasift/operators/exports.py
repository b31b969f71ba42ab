"""What an export holds: its columns, its sheets, its summary; and a workbook a partition as a sink."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords

# Sheets by kind of place.
SHEETS = {
    "Sanitario": ["SANITARIO"], "Educativo": ["EDUCATIVO"], "Cultural": ["CULTURAL"], "Seguridad": ["POLICIAL", "BOMBEROS", "EMERGENCIAS"], "Religioso": ["RELIGIOSO"], "Deportivo": ["DEPORTIVO"],
    "Municipal": ["MUNICIPAL", "SOCIAL"], "Otros": ["GENERICO"],
}
# Texts of an export: missing, yes, no; why a record has no place.
MISSING, YES, NO = "-", "Sí", "No"
REASONS = {"failed": "Geocodificación fallida", "pending": "Pendiente de geocodificación", "": "Sin coordenadas originales"}


def _text(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING))


def projected(records: DataFrame, municipality: str = "", province: str = "", system: str = "") -> DataFrame:
    """The 23 columns of an export, from records (id, name, kind, said_type, address, municipality, province, phone, email, notes, x0, y0, system, x, y, lon, lat,
    score, geocoded_by, confirmed_by array, alerts array).

    Sources are the original, whoever placed it and whoever confirmed that, each once. Located: both coordinates (a zero is none) and a score of 40 at least.
    """
    here = F.coalesce((F.col("x") != 0) & (F.col("y") != 0), F.lit(False))
    one = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(F.when(here, F.array(F.lit("Original"))).otherwise(F.array().cast("array<string>")), one(F.col("geocoded_by")), F.coalesce("confirmed_by", F.array().cast("array<string>"))))
    score = F.coalesce("score", F.lit(0.0))
    return records.select(
        "id", _text(F.col("name")).alias("name"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("GENERICO")).alias("kind"), _text(F.col("said_type")).alias("said_type"), _text(F.col("address")).alias("address"),
        _text(F.coalesce(F.nullif("municipality", F.lit("")), F.lit(municipality))).alias("municipality"), _text(F.coalesce(F.nullif("province", F.lit("")), F.lit(province))).alias("province"),
        _text(F.col("phone")).alias("phone"), _text(F.col("email")).alias("email"), _text(F.col("notes")).alias("notes"), "x0", "y0", _text(F.coalesce(F.nullif("system", F.lit("")), F.lit(system))).alias("system"),
        "x", "y", "lon", "lat", score.alias("score"), coords.band_of(score, "export").alias("band"), _text(F.array_join(found, ", ")).alias("sources"), F.size(found).cast("long").alias("n_sources"),
        F.when(here & (score >= 40), YES).otherwise(NO).alias("located"), _text(F.array_join(F.coalesce("alerts", F.array().cast("array<string>")), " | ")).alias("alerts"),
    )


def sheets(export: DataFrame) -> DataFrame:
    """Rows of ``export`` with ``sheet``, once for each that holds them: all, the one of the kind, and those without a place or with a score under 40."""
    of = None
    for name, kinds in SHEETS.items():
        of = F.when(F.col("kind").isin(kinds), name) if of is None else of.when(F.col("kind").isin(kinds), name)
    failed = F.when((F.col("located") == NO) | (F.col("score") < 40), F.lit("Sin_Geolocalizar"))
    return export.withColumn("sheet", F.explode(F.array_compact(F.array(F.lit("General"), of, failed))))


def summary(export: DataFrame) -> DataFrame:
    """(grouping, label, value): totals, mean score, alerts, bounds, and counts by kind, band and number of sources (bands also at zero)."""
    alerts = F.when(F.col("alerts") != MISSING, F.size(F.split("alerts", r" \| "))).otherwise(0)
    yes = F.count_if(F.col("located") == YES)
    total = export.agg(
        F.count("*").alias("records"), yes.alias("located"), (F.count("*") - yes).alias("not_located"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.coalesce(F.sum(alerts), F.lit(0)).alias("alerts"),
        *(F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))),
    )
    names = total.columns
    flat = total.select(F.explode(F.array(*(F.struct(F.lit("total").alias("grouping"), F.lit(n).alias("label"), F.col(n).cast("double").alias("value")) for n in names))).alias("s")).select("s.*")
    each = F.array(*(F.struct(F.lit(g).alias("grouping"), c.cast("string").alias("label")) for g, c in (("kind", F.col("kind")), ("band", F.col("band")), ("sources", F.col("n_sources")))))
    counts = export.select(F.explode(each).alias("s")).groupBy("s.grouping", "s.label").agg(F.count("*").cast("double").alias("value"))
    bands = export.sparkSession.createDataFrame([("band", b) for b, _ in coords.BANDS["export"]], "grouping string, label string")
    empty = bands.join(counts, ["grouping", "label"], "left_anti").select("grouping", "label", F.lit(0.0).alias("value"))
    return flat.unionByName(counts).unionByName(empty)


def unplaced(records: DataFrame) -> DataFrame:
    """(id, name, reason) of records (id, name, x, y, status) without a place, and why."""
    reason = F.when(F.col("status") == "failed", REASONS["failed"]).when(F.col("status") == "pending", REASONS["pending"]).otherwise(REASONS[""])
    return records.where("coalesce(x, 0) = 0 or coalesce(y, 0) = 0").select("id", "name", reason.alias("reason"))


def by_kind(records: DataFrame) -> DataFrame:
    """(n, kind, place_no, heading, name): records (id, kind, name) under a heading a kind, the most frequent kind first, with a number in its kind."""
    from pyspark.sql import Window as W

    counts = records.groupBy("kind").agg(F.count("*").alias("n"))
    heads = counts.select("kind", "n", F.lit(0).alias("place_no"), F.format_string("=== %s (%d elementos) ===", "kind", "n").alias("heading"), F.lit(None).cast("string").alias("name"))
    rows = records.join(counts, "kind").select("kind", "n", F.row_number().over(W.partitionBy("kind").orderBy("id")).alias("place_no"), F.lit(None).cast("string").alias("heading"), "name")
    return heads.unionByName(rows).select("n", "kind", F.col("place_no").cast("long").alias("place_no"), "heading", "name")


def write_workbooks(rows: DataFrame, path: str, sheet: str | None = None) -> DataFrame:
    """Writes a workbook a partition into a folder that executors reach, a sheet for each value of column ``sheet``; returns (file, rows).

    A workbook is built in one piece, so a partition must be one that a reader of spreadsheets can open: ``repartition`` first. Files carry the partition's number:
    a task that runs again writes the same file.
    """
    import pyarrow as pa

    names = [c for c in rows.columns if c != sheet]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        from ..sources.sinks import workbook

        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            label = batch.column(sheet).to_pylist() if sheet else ["Datos"] * batch.num_rows
            for where, row in zip(label, zip(*(batch.column(c).to_pylist() for c in names), strict=True), strict=True):
                parts.setdefault(where, []).append(row)
        if parts:
            store, folder = fs.FileSystem.from_uri(path)
            store.create_dir(folder, recursive=True)
            file = f"part-{TaskContext.get().partitionId():05d}.xlsx"
            with store.open_output_stream(f"{folder}/{file}") as out:
                out.write(workbook({k: (names, v) for k, v in sorted(parts.items())}))
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([sum(map(len, parts.values()))], pa.int64())], names=["file", "rows"])

    return rows.mapInArrow(run, "file string, rows bigint")


def output_name(name: str, ending: str, stamp: str) -> str:
    """Name of an export: the input's without its ending, what was done, the day, and the ending."""
    base = name.rsplit("/", 1)[-1]
    return f"{base.rsplit('.', 1)[0] if '.' in base else base}_UTM30_{stamp}.{ending}"
