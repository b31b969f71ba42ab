"""Coordinate strings to numbers, as Column expressions.

Order is part of the meaning: placeholders first, then notations from the most to the least specific.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let

# Texts and numbers that stand for a missing coordinate.
PLACEHOLDERS = [
    "", "-", "--", "---", "n/a", "na", "n.a.", "n/d", "nd", "n.d.", "s/d", "sd", "null", "none", "undefined", "indicar", "pendiente", "desconocido", "xxx", "xxxx", "yyyy", "?",
    "sin datos", "sin data", "sin información", "sin informacion", "por definir", "a determinar", "consultar", "ver plano", "ninguno", "no especificada", "no especificado", "inexistente", "inexistentes", "tbd", "todo",
]
PLACEHOLDER_NUMBERS = [0.0, 1.0, -1.0, 99999.0, 999999.0, 9999999.0, -9999.0, -99999.0, -999999.0, 12345.0, 123456.0]
# Ranges of EPSG:25830 in which a value is an easting, a northing, or a northing without its leading four millions.
EASTING, NORTHING, TRUNCATED = (100_000.0, 800_000.0), (3_980_000.0, 4_300_000.0), (40_000.0, 99_999.0)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)"


def prefix_number(text: Column) -> Column:
    """The number at the start of a text, as a script language's parser reads it; null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(text), _NUMBER, 0), F.lit("")).cast("double")


def is_placeholder(text: Column, texts: Sequence[str] = PLACEHOLDERS, numbers: Sequence[float] = PLACEHOLDER_NUMBERS) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return low.isin(list(texts)) | F.coalesce(prefix_number(text).isin(list(numbers)), F.lit(False)) if numbers else low.isin(list(texts))


def notation(text: Column, missing: Callable[[Column], Column] = is_placeholder) -> Column:
    """Name of the first notation that fits; ``missing`` tells placeholders."""
    t = F.trim(text)
    return (
        F.when(missing(text), "placeholder")
        .when(t.rlike(r"(?i)^point\s*\("), "wkt")
        .when(t.rlike(r"^\{.*coordinates"), "geojson")
        .when(t.rlike(r"^\$G[PN](GGA|RMC|GLL),"), "nmea_sentence")
        .when(t.rlike(r"^\d{4,5}\.\d+\s*[NSEW]$"), "nmea")
        .when(t.rlike(r"(?i)\d+\s*[°º˚⁰:]\s*\d+|^\d+\s+\d+\s+\d+[.,]?\d*\s*[NSEWO]$"), "dms")
        .when(t.rlike(r"\d\s*(´´|´|'')\s*\d"), "acute")
        .when(t.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), "european")
        .when(t.rlike(r"^\d+,\d+$"), "comma")
        .when(t.rlike(r"^\d{1,3}(\.\d{3}){2,}$"), "thousands")
        .when(t.rlike(r"^\d{12,}$"), "fused")
        .when(t.rlike(r"^\d{1,3}( \d{3})+$"), "spaced")
        .when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), "plain")
        .otherwise("unknown")
    )


def parse(text: Column, missing: Callable[[Column], Column] = is_placeholder) -> Column:
    """The value of one coordinate in any single-value notation; null for placeholders and what nothing reads. The notation is found once."""
    return let(F.struct(notation(text, missing).alias("kind"), F.trim(text).alias("t")), lambda s: _value(s["kind"], s["t"]))


def _value(kind: Column, t: Column) -> Column:
    acute = F.regexp_replace(F.regexp_replace(t, r"\s*(´´|´|'')\s*", "."), r"\s", "")
    return (
        F.when(kind == "plain", t.cast("double"))
        .when(kind == "acute", acute.cast("double"))
        .when(kind == "european", F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("double"))
        .when(kind == "comma", F.replace(t, F.lit(","), F.lit(".")).cast("double"))
        .when(kind == "thousands", F.replace(t, F.lit("."), F.lit("")).cast("double"))
        .when(kind == "spaced", F.replace(t, F.lit(" "), F.lit("")).cast("double"))
        .when(kind == "dms", parse_dms(t))
        .when(kind == "nmea", parse_nmea(t))
    )


# The ways to write degrees, minutes and seconds, from the most specific; D, M, S numbers, H a letter for the hemisphere, _ a space that must be there.
DMS_FORMS = {"marks": "D ° M ' S \" H", "spaces": "D_M_S H", "minutes": "D ° S ' H", "colons": "D:M:S H"}
_DMS_PARTS = {"D": r"(\d+)", "M": r"(\d+)", "S": r"(\d+\.?\d*)", "H": "([NSEWO]?)", "_": r"\s+", '"': '"?', " ": r"\s*"}
_MARKS = ("º˚⁰" + "´`’‘′" + "„‟”“″" + ",", "°°°" + "'" * 5 + '"' * 5 + ".")


def dms_parts(text: Column) -> Column:
    """Struct (form, degrees, minutes, seconds, hemisphere, sign) of an angle; null if no form fits.

    Signs that look like degrees, minutes and seconds count as such, a comma as a point; a hemisphere may stand in front, or a sign.
    """
    t = F.translate(F.trim(text), *_MARKS)
    sign = F.regexp_extract(t, "^([+-])", 1)
    t = F.regexp_replace(t, r"^[+-]\s*", "")
    front = F.upper(F.regexp_extract(t, "(?i)^([NSEWO])", 1))
    t = F.regexp_replace(t, r"(?i)^[NSEWO]\s*", "")
    out = None
    for name, form in DMS_FORMS.items():
        pattern = "(?i)^" + "".join(_DMS_PARTS.get(c, c) for c in form) + "$"
        *numbers, letter = [F.regexp_extract(t, pattern, i + 1) for i in range(sum(c in "DMSH" for c in form))]
        degrees, minutes, seconds = [*numbers, F.lit("0")][:3]
        value = F.struct(
            F.lit(name).alias("form"), degrees.cast("double").alias("degrees"), minutes.cast("double").alias("minutes"), seconds.cast("double").alias("seconds"),
            F.when(front != "", front).otherwise(F.upper(letter)).alias("hemisphere"), sign.alias("sign"),
        )
        out = F.when(t.rlike(pattern), value) if out is None else out.when(t.rlike(pattern), value)
    return out


def parse_dms(text: Column) -> Column:
    """Degrees of an angle in any of ``DMS_FORMS``; south, west and minus are negative; null for parts out of range."""
    return let(dms_parts(text), _degrees)


def _degrees(p: Column) -> Column:
    value = p["degrees"] + p["minutes"] / 60 + p["seconds"] / 3600
    sign = F.when((p["sign"] == "-") | p["hemisphere"].isin("S", "W", "O"), -1.0).otherwise(1.0)
    return F.when((p["degrees"] <= 180) & (p["minutes"] < 60) & (p["seconds"] < 60), value * sign)


def dms_warning(text: Column) -> Column:
    """OUT_OF_RANGE for parts that no angle has, OUTSIDE for a latitude or longitude beyond the region, else null."""
    p, v = dms_parts(text), parse_dms(text)
    outside = F.when(p["hemisphere"].isin("N", "S"), ~v.between(36, 38.5)).when(p["hemisphere"].isin("E", "W", "O"), ~v.between(-7.5, -1))
    return F.when(p["form"].isNotNull() & v.isNull(), "OUT_OF_RANGE").when(outside, "OUTSIDE")


def parse_nmea(text: Column) -> Column:
    """ddmm.mmm with a hemisphere letter, as an unsigned decimal: a single value carries no sign."""
    raw = F.regexp_extract(text, r"^(\d{4,5}\.\d+)\s*[NSEW]$", 1)
    value = F.nullif(raw, F.lit("")).cast("double")
    degrees = F.floor(value / 100)
    return degrees + (value - degrees * 100) / 60


def parse_nmea_pair(sentence: Column) -> Column:
    """Struct (lat, lon), signed, of a GGA, RMC or GLL sentence."""
    f = F.split(sentence, ",")
    first = F.when(sentence.rlike(r"^\$..GGA"), 2).when(sentence.rlike(r"^\$..RMC"), 3).when(sentence.rlike(r"^\$..GLL"), 1)
    at = lambda k: F.get(f, first + k)

    def signed(value: Column, letter: Column) -> Column:
        return parse_nmea(F.concat(value, letter)) * F.when(letter.isin("S", "W"), -1.0).otherwise(1.0)

    return F.when(first.isNotNull(), F.struct(signed(at(0), at(1)).alias("lat"), signed(at(2), at(3)).alias("lon")))


def parse_wkt(text: Column) -> Column:
    """Struct (x, y) of ``POINT(x y)``."""
    pattern = r"(?i)^\s*point\s*\(\s*([+-]?[\d.]+)[ ,]+([+-]?[\d.]+)\s*\)"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("double").alias("x"), F.regexp_extract(text, pattern, 2).cast("double").alias("y")))


def parse_geojson(text: Column) -> Column:
    """Struct (x, y) of a GeoJSON point."""
    c = F.from_json(text, "type string, coordinates array<double>")
    return F.when(c["type"] == "Point", F.struct(F.get(c["coordinates"], 0).alias("x"), F.get(c["coordinates"], 1).alias("y")))


def split_fused(digits: Column) -> Column:
    """Struct (x, y) of two fused values: the first cut near the middle that gives an easting and a northing."""
    half = F.floor(F.length(digits) / 2).cast("int")
    cuts = F.array(*(half + F.lit(k) for k in (0, -1, 1, -2, 2)))
    pairs = F.transform(cuts, lambda c: F.struct(F.substring(digits, F.lit(1), c).cast("double").alias("x"), F.substring(digits, c + 1, F.length(digits)).cast("double").alias("y")))
    return F.get(F.filter(pairs, lambda p: p["x"].between(*EASTING) & p["y"].between(*NORTHING)), 0)


def axis(value: Column) -> Column:
    """X before the truncated range before Y: the first range that holds the value."""
    return F.when(value.between(*EASTING), "X").when(value.between(*TRUNCATED), "Y_TRUNCATED").when(value.between(*NORTHING), "Y").otherwise("UNKNOWN")


def repaired(value: Column) -> Column:
    return F.when(axis(value) == "Y_TRUNCATED", value + 4_000_000.0).otherwise(value)


def is_swapped(x: Column, y: Column) -> Column:
    return x.between(2_000_000.0, 5_000_000.0) & y.between(100_000.0, 700_000.0)


def pair(x: Column, y: Column) -> Column:
    """Struct (x, y, swapped, fixed, confidence) of two parsed values after repair and exchange. Each value is evaluated once."""
    return let(F.struct(x.alias("x"), y.alias("y")), lambda p: _pair(p["x"], p["y"]))


def _pair(x: Column, y: Column) -> Column:
    swapped = F.coalesce(is_swapped(x, y), F.lit(False))
    a, b = F.when(swapped, y).otherwise(x), F.when(swapped, x).otherwise(repaired(y))
    fixed = F.coalesce(~swapped & (axis(y) == "Y_TRUNCATED"), F.lit(False))
    good = F.coalesce(a.between(*EASTING) & b.between(*NORTHING), F.lit(False))
    confidence = F.when(a.isNull() | b.isNull(), "CRITICA").when(~good, "BAJA").when(swapped | fixed, "MEDIA").otherwise("ALTA")
    return F.struct(a.alias("x"), b.alias("y"), swapped.alias("swapped"), fixed.alias("fixed"), confidence.alias("confidence"))


def band(score: Column) -> Column:
    """Confidence band of a score of 0 to 100."""
    return F.when(score >= 90, "ALTA").when(score >= 70, "MEDIA").when(score >= 50, "BAJA").otherwise("CRITICA")


# ---------------------------------------------------------------- cells of documents


def clean_cell(text: Column) -> Column:
    """A cell's coordinate as a plain number's text: empty for placeholders, thousands joined, a decimal point.

    Groups of three behind spaces are thousands; a last group of two makes decimals where there are over six digits. One dot in front of three digits is
    a thousands mark if the digits together are an easting or a northing.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    missing = t.rlike(r"(?i)^(indicar|sin\s*datos?|-+|n/?[ac]|\.+|_+|xxx?|completar)$")
    t = F.regexp_replace(t, "[´`'’‘“”\"]+", "")
    solid, last = F.regexp_replace(t, r"\s", ""), F.element_at(F.split(t, r"\s+"), -1)
    decimals = F.concat(F.substring(solid, F.lit(1), F.length(solid) - 2), F.lit("."), F.substring(solid, F.length(solid) - 1, F.lit(2)))
    grouped = F.when(t.rlike(r"^\d+( +\d{3})+$"), solid).when((F.length(last) == 2) & (F.length(solid) > 6), decimals).otherwise(solid)
    t = F.when(t.rlike(r"^\d[\d\s]+\d$") & t.contains(" "), grouped).otherwise(t)
    bare = F.regexp_replace(t, r"\.", "")
    number = F.when(t.rlike(r"^\d+\.\d{3}$"), bare).cast("double")
    thousands = t.rlike(r"\..*\.") | F.coalesce(number.between(100_000, 800_000) | number.between(3_980_000, 4_320_000), F.lit(False))
    t = F.when(thousands, bare).otherwise(t)
    return F.when(missing, "").otherwise(F.regexp_replace(F.regexp_replace(t, "^([^,]*),", "$1."), r"\s", ""))


def is_utm(text: Column, which: str) -> Column:
    """Whether a cleaned cell starts with an easting ("x") or northing ("y") of the region."""
    low, high = (100_000, 800_000) if which == "x" else (4_000_000, 4_350_000)
    return F.coalesce(prefix_number(text).between(low, high), F.lit(False))


def loose_number(text: Column) -> Column:
    """A number in any of the ways that spreadsheets have: degrees, minutes and seconds; degrees and minutes; either separator of thousands."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^0-9.,+\-eE°′″'" + r'"\s]', ""), r"\s+", " "))
    dms, dm = r"^([+-]?\d+)[°\s]+(\d+)[′'\s]+(\d+(?:\.\d+)?)[″" + r'"]?\s*(E?)$', r"(?i)^([+-]?\d+)[°\s]+(\d+(?:\.\d+)?)[′']?\s*(E?)$"
    part = lambda pattern, i: F.regexp_extract(t, pattern, i).cast("double")
    comma, dot = F.locate(",", F.reverse(t)), F.locate(".", F.reverse(t))  # from the end: the smaller comes last
    european = F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    plain = F.when(comma == 0, t).when(dot == 0, F.regexp_replace(t, "^([^,]*),", "$1.")).when(comma < dot, european).otherwise(F.replace(t, F.lit(","), F.lit("")))
    number = F.regexp_extract(F.regexp_replace(plain, r"\s", ""), _NUMBER + r"([eE][+-]?\d+)?", 0)
    return F.when(t.rlike(dms), part(dms, 1) + part(dms, 2) / 60 + part(dms, 3) / 3600).when(t.rlike(dm), part(dm, 1) + part(dm, 2) / 60).otherwise(F.nullif(number, F.lit("")).cast("double"))


def spatial_text(text: Column) -> Column:
    """Struct (format, x, y) of a WKT or GeoJSON point."""
    w, g = parse_wkt(text), parse_geojson(F.trim(text))
    return F.when(w.isNotNull(), F.struct(F.lit("WKT_POINT").alias("format"), w["x"].alias("x"), w["y"].alias("y"))).when(g.isNotNull(), F.struct(F.lit("GEOJSON_POINT").alias("format"), g["x"].alias("x"), g["y"].alias("y")))


def split_graded(text: Column) -> Column:
    """Struct (x, y, grade) of two fused values: ALTA easting then northing, MEDIA the other way round, BAJA two of a kind.

    Cuts are tried from the middle outwards; the first with any verdict counts.
    """
    d = F.regexp_replace(text, r"\D", "")
    half = F.floor(F.length(d) / 2).cast("int")
    cuts = F.filter(F.array(*(half + F.lit(k) for k in (0, -1, 1, -2, 2))), lambda c: (c >= 5) & (c <= F.length(d) - 6))
    easting, northing = (lambda v: v.between(*EASTING)), (lambda v: v.between(*NORTHING))

    def judged(c: Column) -> Column:
        a, b = F.substring(d, F.lit(1), c).cast("double"), F.substring(d, c + 1, F.length(d)).cast("double")
        grade = F.when(easting(a) & northing(b), "ALTA").when(northing(a) & easting(b), "MEDIA").when((easting(a) & easting(b)) | (northing(a) & northing(b)), "BAJA")
        return F.struct(F.when(easting(a), a).otherwise(b).alias("x"), F.when(northing(a), a).otherwise(b).alias("y"), grade.alias("grade"))

    return F.when(F.length(d) >= 12, F.get(F.filter(F.transform(cuts, judged), lambda r: r["grade"].isNotNull()), 0))


def checked_northing(value: Column) -> Column:
    """Struct (value, issue): 40,000 to 300,000 lacks four millions; ten times the value may be a northing; else an outlier stays."""
    low, high = 3_980_000.0, 4_290_000.0
    millions = (value >= 40_000) & (value < 300_000) & (value + 4_000_000).between(low, high)
    outside = ~value.between(low, high)
    tenfold = outside & (value * 10).between(low, high)
    return F.struct(F.when(millions, value + 4_000_000).when(tenfold, value * 10).otherwise(value).alias("value"), F.when(millions | tenfold, "truncated").when(outside, "outlier").alias("issue"))


def checked_easting(value: Column) -> Column:
    """concatenated over a thousand millions, outlier outside the region, else null."""
    return F.when(value > 1e9, "concatenated").when(~value.between(100_000, 620_000), "outlier")


def valid_in(x: Column, y: Column, system: Column) -> Column:
    """Whether a pair can be one of a reference system: degrees, zone 30, another zone, or anything."""
    zone30 = x.between(150_000, 900_000) & y.between(3_000_000, 6_000_000)
    return (
        F.when(system.isin("EPSG:4326", "EPSG:4258"), (F.abs(x) <= 180) & (F.abs(y) <= 90))
        .when(system.rlike("25830|23030|32630"), zone30)
        .when(system.rlike("UTM|258|230|326"), (x > 100_000) & (x < 1_000_000) & (y > 1_000_000) & (y < 10_000_000))
        .otherwise(True)
    )


def in_region(x: Column, y: Column, degrees: bool = False) -> Column:
    """Whether a pair lies in the region's box, in zone 30 or in degrees."""
    return x.between(-8, -1) & y.between(35, 39) if degrees else x.between(100_000, 700_000) & y.between(3_900_000, 4_400_000)


def pair_points(has_x: Column, has_y: Column, x_ok: Column, y_ok: Column, repaired_: Column, swapped: Column) -> Column:
    """0 to 100: 25 for each value and each range that holds, 15 less for an exchange, 10 less for a repair."""
    total = sum((F.when(c, 25).otherwise(0) for c in (has_x, has_y, x_ok, y_ok)), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total - F.when(swapped, 15).otherwise(0) - F.when(repaired_, 10).otherwise(0)))


def formatted(value: Column, decimals: int = 2) -> Column:
    """A fixed number of decimals; empty for no value."""
    return F.coalesce(F.format_string(f"%.{decimals}f", value), F.lit(""))


def diagnosis(x: Column, y: Column, swapped: Column, fixed: Column, confidence: Column) -> Column:
    """One line on a pair: what it is now, what was done, and how far to trust it."""
    done = F.array_compact(F.array(F.when(swapped, "exchanged"), F.when(fixed, "completed")))
    where = F.when(x.isNull() | y.isNull(), "no pair").otherwise(F.concat(formatted(x), F.lit(" "), formatted(y)))
    return F.concat_ws("; ", where, F.nullif(F.array_join(done, ", "), F.lit("")), F.lower(confidence))


#: Bands of a score: name and the least score of it, from the best.
BANDS = {
    "cascade": [("ALTA", 90), ("MEDIA", 70), ("BAJA", 50), ("CRITICA", 0)],
    "located": [("ALTA", 90), ("MEDIA", 70), ("BAJA", 50), ("CRITICA", 1e-9), ("NULA", 0)],
    "export": [("ALTA", 80), ("MEDIA", 60), ("BAJA", 40), ("NULA", 0)],
    "checks": [("CONFIRMADA", 95), ("ALTA", 85), ("MEDIA", 65), ("BAJA", 40), ("MUY_BAJA", 20), ("INVALIDA", 0)],
}


def band_of(score: Column, scale: str) -> Column:
    """Name of the band of one of ``BANDS`` that a score falls in."""
    out = None
    for name, least in BANDS[scale]:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(BANDS[scale][-1][0])
