"""The notation of a coordinate's text, in the finest division, and what a sample of texts shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import coords
from .once import let

# Notations in the order in which they are tried, with their patterns (any case); placeholders come before all.
NOTATIONS = [
    ("WKT_POINT", r"^\s*POINT\s*\("), ("GEOJSON_POINT", r'^\{(?=.*"type")(?=.*"Point")'), ("DMS_SIGNO", r"^[+-]\d+[°º]"), ("DMS_PREFIJO", r"^[NSEWO]\s*\d+[°º]"), ("DMS_DOS_PUNTOS", r"^\d+:\d+:\d+\.?\d*\s*[NSEWO]?$"),
    ("DMS_MINUTOS_DEC", r"^\d+\s*[°º]\s*\d+\.?\d*\s*['′]\s*[NSEWO]?$"), ("DMS_ESPACIOS_EXTRA", r"^(?=\S*(\s\S*){3,}$)\d+\s*[°º]\s*\d+\s*['′]\s*\d+\.?\d*\s*" + r'["″]?\s*[NSEWO]?$'), ("DMS_ESTANDAR", r"^\d+\s*[°º]\s*\d+\s*['′]\s*\d+\.?\d*\s*" + r'["″]?\s*[NSEWO]?$'),
    ("DMS_ESPACIOS", r"^\d+\s+\d+\s+\d+\.?\d*\s*[NSEWO]$"), ("NMEA_SENTENCIA", r"^\$G[PN](GGA|RMC|GLL)"), ("NMEA_ESTANDAR", r"^\d{4,5}\.\d+\s*,?\s*[NSEWO]$"), ("NMEA_ENTERO", r"^\d{4,5}\s*[NSEWO]$"),
    ("NMEA_PAR", r"\d{4,5}\.?\d*\s*,?\s*[NS]\s*[,/\s]+\s*\d{4,5}\.?\d*\s*,?\s*[EWO]"), ("CONCATENADO", r"^\d{12,}$"), ("MOJIBAKE", r"Â[´º]"), ("ESPACIO_DOBLE_TILDE", r"^(\d{1,3}\s+\d{3}|\d\s+\d{3}\s+\d{3})´´\d{1,2}$"),
    ("ESPACIO_DECIMAL_IMPLICITO", r"^(\d{3}\s+\d{3}|\d\s+\d{3}\s+\d{3})\s+\d{1,2}$"), ("ESPACIO_SIN_DECIMAL", r"^\d{1,3}(\s+\d{3})+$"), ("TILDE_SIMPLE", r"^\d+´\d+$"), ("COMILLAS_TIPOGRAFICAS", r"\d+['’]d+"),
    ("EUROPEO_COMPLETO", r"^\d{1,3}(\.\d{3})+,\d+$"), ("COMA_DECIMAL", r"^\d+,\d+$"), ("PUNTO_MILES", r"^\d{1,3}(\.\d{3})+$"), ("LIMPIO", r"^-?\d+\.?\d*$"),
]


def notation_of(text: Column) -> Column:
    """Name of the first of ``NOTATIONS`` that fits; PLACEHOLDER for what stands for nothing, DESCONOCIDO if none fits."""
    t, out = F.trim(F.coalesce(text, F.lit(""))), F.when(coords.is_placeholder(text), "PLACEHOLDER")
    for name, pattern in NOTATIONS:
        out = out.when(t.rlike("(?i)" + pattern), name)
    return out.otherwise("DESCONOCIDO")


def sampled(rows: DataFrame, key: str, value: str, order: str, size: int = 20) -> DataFrame:
    """(key, notation, share, decimal, level, trust) of the first ``size`` values of each document: its most frequent notation (of equals the first by name), in percent of the sample.

    decimal: comma or point where one is more than twice as frequent, mixed, or none; level: high with signs of broken encoding, medium with spaces or mixed marks;
    trust: 20 more than the share, up to 95.
    """
    first = rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("__n") <= size)
    t = F.trim(F.coalesce(F.col(value), F.lit("")))
    one = first.select(key, notation_of(F.col(value)).alias("notation"), t.rlike(r",\d{1,3}$").alias("comma"), t.rlike(r"\.\d{1,3}$").alias("point"), t.rlike(r"\s").alias("space"), t.rlike("[â€™°ºª~˜]").alias("broken"))
    counts = one.groupBy(key, "notation").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("comma", "point", "space", "broken")))
    most = F.min(F.struct((-F.col("n")).alias("n"), "notation"))
    per = counts.groupBy(key).agg(most.alias("m"), F.sum("n").alias("all"), *(F.sum(c).alias(c) for c in ("comma", "point", "space", "broken")))
    share = F.floor(-F.col("m.n") / F.col("all") * 100 + 0.5).cast("long")
    decimal = F.when(F.col("comma") > 2 * F.col("point"), "comma").when(F.col("point") > 2 * F.col("comma"), "point").when((F.col("comma") > 0) & (F.col("point") > 0), "mixed").otherwise("none")
    level = F.when(F.col("broken") > 0, "high").when((F.col("space") > 0) | (F.col("decimal") == "mixed"), "medium").otherwise("low")
    return per.withColumn("decimal", decimal).select(key, F.col("m.notation").alias("notation"), share.alias("share"), "decimal", level.alias("level"), F.least(F.lit(95), share + 20).alias("trust"))


# Headings of columns of eastings and northings, whole and inside of longer ones (any case).
X_HEADINGS, Y_HEADINGS = (
    r"^(x|lon|long|longitude|longitud|este|easting|coord_?x|east)$|(coordenadas?|utm).*(x|lon|longitud|este)|^x\s|longitud|este|easting",
    r"^(y|lat|latitude|latitud|norte|northing|coord_?y|north)$|(coordenadas?|utm).*(y|lat|latitud|norte)|^y\s|latitud|norte|northing",
)


def coordinate_columns(rows: DataFrame, sample: int = 20) -> list[tuple[str, str, float]]:
    """Pairs of columns (x, y, score), the best first: the share of the first ``sample`` rows in which both are numbers.

    Columns by their headings; a heading of coordinates in front of an unnamed one gets 0.2 more; without any, every pair in order of over a half. It is metadata: one job over
    ``sample`` rows for all columns.
    """
    import re

    plain = [re.sub(r"[\r\n]+", " ", c).strip() for c in rows.columns]
    flags = rows.limit(sample).select(*(coords.loose_number(F.col(f"`{c}`").cast("string")).isNotNull().alias(f"c{i}") for i, c in enumerate(rows.columns))).collect()  # `sample` rows
    score = lambda i, j: sum(r[i] and r[j] for r in flags) / len(flags) if flags else 0.0
    is_x, is_y = ([i for i, c in enumerate(plain) if re.search(p, c, re.I | re.S)] for p in (X_HEADINGS, Y_HEADINGS))
    found = [(i, j, score(i, j)) for i in is_x for j in is_y]
    found += [(i, i + 1, score(i, i + 1) + 0.2) for i in range(len(plain) - 1) if re.search("coordenadas|utm", plain[i], re.I) and (plain[i + 1] == "" or "__empty" in plain[i + 1].lower()) and score(i, i + 1) > 0]
    found = [f for f in found if f[2] > 0] or [(i, j, score(i, j)) for i in range(len(plain)) for j in range(i + 1, len(plain)) if score(i, j) > 0.5]
    return [(rows.columns[i], rows.columns[j], s) for i, j, s in sorted(found, key=lambda f: -f[2])]


def recommendations(broken: Column, mixed: Column, dms: Column, nmea: Column, fused: Column, with_x: Column, with_y: Column, missing: Column, n: Column) -> Column:
    """Names of the seven remarks on a document's profile that apply, in their order."""
    share = F.when(n > 0, (with_x + with_y) / (n * 2) * 100).otherwise(0.0)
    rules = [("broken_encoding", broken > 0), ("mixed_marks", mixed), ("degrees", dms > 0), ("satellite", nmea > 0), ("fused", fused > 0), ("few_coordinates", share < 50), ("placeholders", missing > n * 0.3)]
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules)))
