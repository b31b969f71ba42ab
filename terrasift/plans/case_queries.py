"""Queries over rows with known answers: what the parsers, classifiers and decisions must give for each notation, text or situation.

A query runs its operator over its own rows; its twin is the answers, worked out from the definition by hand. So a fault that a generator of test data would share with
a parser shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, classify, coords, fused_text, notations, synonyms
from ..functions import text as T
from ..operators import candidates, exports, fusion, layers
from ..sources import answers as service
from ..sources import structure
from .registry import register

_SQL = {"int": "bigint", "long": "bigint", "double": "double", "string": "varchar", "boolean": "boolean"}


def _literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def answers(ddl: str, rows: list[tuple]) -> str:
    """The twin: rows as a SQL text."""
    fields = [f.split(" ") for f in ddl.split(", ")]
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"select {', '.join(f'cast({n} as {_SQL[t]}) as {n}' for n, t in fields)} from (values {body}) t({', '.join(n for n, _ in fields)})"


def cases(name: str, given: str, known: str, rows: list[tuple], op: Callable[[DataFrame], DataFrame]) -> None:
    """Registers ``op`` over rows that hold the given columns and then the known answers; the first column names the row."""
    n = given.count(",") + 1
    key = given.split(",")[0]
    out = f"{key}, {known}"
    register(name, answers(out, [(r[0], *r[n:]) for r in rows]))(lambda spark, _: op(spark.createDataFrame([r[:n] for r in rows], given)).select(*(f.split(" ")[0] for f in out.split(", "))))


def _six(c):
    return F.signum(c) * F.floor(F.abs(c) * 1_000_000 + 0.5) / 1_000_000


# ---------------------------------------------------------------- coordinates

cases(
    "dms_forms", "id int, raw string", "degrees double, form string, warning string",
    [
        (1, "37°26'46.5\"N", 37.44625, "marks", None), (2, "37º26'46,5\"N", 37.44625, "marks", None), (3, "37 26 46.5 N", 37.44625, "spaces", None), (4, "N37°26'46.5\"", 37.44625, "marks", None),
        (5, "37°26.775'N", 37.44625, "minutes", None), (6, "37° 26' 46.5\" N", 37.44625, "marks", None), (7, "+37°26'46.5\"", 37.44625, "marks", None), (8, "37:26:46.5 N", 37.44625, "colons", None),
        (9, "W3°45'12.24\"", -3.7534, "marks", None), (10, "-3°45'12.24\"", -3.7534, "marks", None), (11, "3°45'12.24\"O", -3.7534, "marks", None), (12, "37°60'10\"N", None, "marks", "OUT_OF_RANGE"),
        (13, "41°23'0\"N", 41.383333, "marks", "OUTSIDE"), (14, "504750", None, None, None), (15, "", None, None, None), (16, None, None, None, None), (17, "37°26'46\"S", -37.446111, "marks", "OUTSIDE"),
    ],
    lambda d: d.select("id", _six(coords.parse_dms(F.col("raw"))).alias("degrees"), coords.dms_parts(F.col("raw"))["form"].alias("form"), coords.dms_warning(F.col("raw")).alias("warning")),
)
cases(
    "placeholder_texts", "id int, raw string", "missing boolean",
    [(i, t, True) for i, t in enumerate(coords.PLACEHOLDERS + ["0", "0.0", "1", "-1", "99999", "999999", "-9999", "-99999", "-999999", "12345", "123456", " Indicar ", "SIN DATOS", None])]
    + [(100 + i, t, False) for i, t in enumerate(["504750", "4077905,68", "37°26'46.5\"N", "99998", "12346", "Indicar calle", "10"])],
    lambda d: d.select("id", coords.is_placeholder(F.col("raw")).alias("missing")),
)
cases(
    "cell_cleaning", "id int, raw string", "cleaned string, easting boolean, northing boolean",
    [
        (1, "437 686", "437686", True, False), (2, "4 076 367", "4076367", False, True), (3, "437 686 30", "437686.30", True, False), (4, "4.230.105", "4230105", False, True), (5, "524.891", "524891", True, False),
        (6, "4230.105", "4230105", False, True), (7, "437301.8", "437301.8", True, False), (8, "436780,0", "436780.0", True, False), (9, "Indicar", "", False, False), (10, "sin datos", "", False, False), (11, "---", "", False, False),
        (12, "", "", False, False), (13, None, "", False, False), (14, "504´750", "504750", True, False), (15, "12.345", "12.345", False, False), (16, "3999999", "3999999", False, False), (17, "n/a", "", False, False), (18, "0", "0", False, False),
    ],
    lambda d: d.select("id", coords.clean_cell(F.col("raw")).alias("cleaned"), coords.is_utm(coords.clean_cell(F.col("raw")), "x").alias("easting"), coords.is_utm(coords.clean_cell(F.col("raw")), "y").alias("northing")),
)
cases(
    "loose_numbers", "id int, raw string", "value double",
    [
        (1, "37°26'46.5\"", 37.44625), (2, "37 26.775", 37.44625), (3, "436780,5", 436780.5), (4, "4.077.905,68", 4077905.68), (5, "4,077,905.68", 4077905.68), (6, "504750", 504750.0), (7, "X: 504750 m", 504750.0),
        (8, "abc", None), (9, "", None), (10, None, None), (11, "-3.75", -3.75), (12, "4077905.68abc", 4077905.68),
    ],
    lambda d: d.select("id", _six(coords.loose_number(F.col("raw"))).alias("value")),
)
cases(
    "spatial_texts", "id int, raw string", "format string, x double, y double",
    [
        (1, "POINT(504750 4077153)", "WKT_POINT", 504750.0, 4077153.0), (2, "point ( 504750.5 , 4077153.25 )", "WKT_POINT", 504750.5, 4077153.25),
        (3, '{"type":"Point","coordinates":[504750,4077153]}', "GEOJSON_POINT", 504750.0, 4077153.0), (4, '{"type":"LineString","coordinates":[]}', None, None, None), (5, "POINT(504750)", None, None, None), (6, "504750", None, None, None), (7, None, None, None, None),
    ],
    lambda d: d.select("id", coords.spatial_text(F.col("raw")).alias("s")).select("id", "s.format", "s.x", "s.y"),
)
cases(
    "fused_pairs", "id int, raw string", "x double, y double, grade string",
    [
        (1, "5047504077153", 504750.0, 4077153.0, "ALTA"), (2, "4077153504750", 504750.0, 4077153.0, "MEDIA"), (3, "504750504751", 504750.0, 504751.0, "BAJA"), (4, "50475040", None, None, None), (5, "999999999999", None, None, None),
        (6, "40771534077154", 4077154.0, 4077153.0, "BAJA"), (7, "504750 4077153", 504750.0, 4077153.0, "ALTA"),
    ],
    lambda d: d.select("id", coords.split_graded(F.col("raw")).alias("s")).select("id", "s.x", "s.y", "s.grade"),
)
cases(
    "axis_checks", "id int, v double", "northing double, issue string, easting_issue string",
    [
        (1, 77905.0, 4077905.0, "truncated", "outlier"), (2, 413618.0, 4136180.0, "truncated", None), (3, 4077905.0, 4077905.0, None, "outlier"), (4, 504352.0, 504352.0, "outlier", None), (5, 50435298504342.0, 50435298504342.0, "outlier", "concatenated"),
        (6, 1000000.0, 1000000.0, "outlier", "outlier"), (7, None, None, None, None), (8, 299999.0, 299999.0, "outlier", None), (9, 250000.0, 4250000.0, "truncated", None),
    ],
    lambda d: d.select("id", coords.checked_northing(F.col("v")).alias("n"), coords.checked_easting(F.col("v")).alias("easting_issue")).select("id", F.col("n.value").alias("northing"), "n.issue", "easting_issue"),
)
cases(
    "valid_in_system", "id int, x double, y double, system string", "valid boolean, region boolean, degrees boolean",
    [
        (1, 504750.0, 4077153.0, "EPSG:25830", True, True, False), (2, -3.7, 37.4, "EPSG:4326", True, False, True), (3, 190.0, 37.4, "EPSG:4258", False, False, False), (4, 100.0, 4077153.0, "EPSG:25830", False, False, False),
        (5, 200000.0, 4077153.0, "EPSG:25829", True, True, False), (6, 5.0, 5.0, "EPSG:3857", True, False, False), (7, 800000.0, 4500000.0, "EPSG:32630", True, False, False), (8, 50.0, 50.0, "EPSG:25831", False, False, False),
    ],
    lambda d: d.select("id", coords.valid_in(F.col("x"), F.col("y"), F.col("system")).alias("valid"), coords.in_region(F.col("x"), F.col("y")).alias("region"), coords.in_region(F.col("x"), F.col("y"), True).alias("degrees")),
)
cases(
    "score_bands", "id int, score double", "cascade string, located string, export string, checks string",
    [
        (1, 95.0, "ALTA", "ALTA", "ALTA", "CONFIRMADA"), (2, 90.0, "ALTA", "ALTA", "ALTA", "ALTA"), (3, 80.0, "MEDIA", "MEDIA", "ALTA", "MEDIA"), (4, 70.0, "MEDIA", "MEDIA", "MEDIA", "MEDIA"), (5, 60.0, "BAJA", "BAJA", "MEDIA", "BAJA"),
        (6, 50.0, "BAJA", "BAJA", "BAJA", "BAJA"), (7, 40.0, "CRITICA", "CRITICA", "BAJA", "BAJA"), (8, 20.0, "CRITICA", "CRITICA", "NULA", "MUY_BAJA"), (9, 0.0, "CRITICA", "NULA", "NULA", "INVALIDA"),
    ],
    lambda d: d.select("id", *(coords.band_of(F.col("score"), s).alias(s) for s in coords.BANDS)),
)
cases(
    "pair_diagnosis", "id int, x double, y double", "score int, said string",
    [
        (1, 504750.0, 4077153.0, 100, "504750.00 4077153.00; alta"), (2, 4077153.0, 504750.0, 85, "504750.00 4077153.00; exchanged; media"), (3, 504750.0, 77153.0, 90, "504750.00 4077153.00; completed; media"),
        (4, 504750.0, None, 50, "no pair; critica"), (5, None, None, 0, "no pair; critica"), (6, 9.0, 9.0, 50, "9.00 9.00; baja"),
    ],
    lambda d: d.select("id", "x", "y", coords.pair(F.col("x"), F.col("y")).alias("p")).select(
        "id",
        coords.pair_points(F.col("x").isNotNull(), F.col("y").isNotNull(), F.coalesce(F.col("p.x").between(*coords.EASTING), F.lit(False)), F.coalesce(F.col("p.y").between(*coords.NORTHING), F.lit(False)), F.col("p.fixed"), F.col("p.swapped")).alias("score"),
        coords.diagnosis(F.col("p.x"), F.col("p.y"), F.col("p.swapped"), F.col("p.fixed"), F.col("p.confidence")).alias("said"),
    ),
)
cases(
    "nmea_sentences", "id int, raw string", "lat double, lon double",
    [
        (1, "$GPGGA,123519,3726.775,N,00345.204,W,1,08,0.9,545.4,M,46.9,M,,*47", 37.44625, -3.7534), (2, "$GPRMC,123519,A,3726.775,N,00345.204,W,022.4,084.4,230394,003.1,W*6A", 37.44625, -3.7534),
        (3, "$GPGLL,3726.775,N,00345.204,W,123519,A", 37.44625, -3.7534), (4, "$GPGSV,1,1", None, None), (5, "", None, None),
    ],
    lambda d: d.select("id", coords.parse_nmea_pair(F.col("raw")).alias("p")).select("id", _six(F.col("p.lat")).alias("lat"), _six(F.col("p.lon")).alias("lon")),
)

# ---------------------------------------------------------------- texts

cases(
    "fused_texts", "id int, raw string", "text string, review boolean, confidence string",
    [
        (1, "Trasformador60822SevillanaEndesa", "Transformador 60822 Sevillana Endesa", False, "MEDIA"), (2, "Hnos. SánchezCarpintería", "Hnos. Sánchez Carpintería", False, "ALTA"), (3, "M.ªCarmen López", "M.ª Carmen López", False, "ALTA"),
        (4, "PN. Sierrade Castril", "PN. Sierra de Castril", False, "ALTA"), (5, "Centro de Salud Municipal", "Centro de Salud Municipal", False, "ALTA"), (6, "CEIP San José", "CEIP San José", False, "ALTA"),
        (7, "Polideportivo Municipal", "Polideportivo Municipal", False, "ALTA"), (8, "E.S. REPSOL", "E.S. REPSOL", False, "ALTA"), (9, "REPSOL", "REPSOL", False, "ALTA"), (10, "Hidroeléctrica del Sur", "Hidroeléctrica del Sur", False, "ALTA"),
        (11, "Audiovisual Mediterráneo", "Audiovisual Mediterráneo", False, "ALTA"), (12, "GASREPSOLGACH - SA", "GASREPSOLGACH - SA", True, "MEDIA"), (13, "CENTROSALUD", "CENTRO SALUD", False, "ALTA"), (14, "CPALMERÍA", "CP ALMERÍA", False, "ALTA"),
        (15, "CENTRONUEVO", "CENTRO NUEVO", False, "ALTA"), (16, "SALUD", "SALUD", False, "ALTA"), (17, "Pista 12Km", "Pista 12 Km", False, "ALTA"), (18, "ab", "ab", False, "ALTA"), (19, "", "", False, "ALTA"), (20, None, None, None, None),
    ],
    lambda d: d.select("id", fused_text.separate(F.col("raw"), ["CENTRO", "SALUD", "CP", "ALMERÍA"]).alias("s")).select("id", "s.text", "s.review", "s.confidence"),
)
cases(
    "misplaced_texts", "id int, raw string", "holds string",
    [(1, "1 SARGENTO JEFE DE PARQUE", "STAFF"), (2, "LABORABLES DE LUNES A VIERNES", "HOURS"), (3, "SANITARIO", None), (4, "24 horas", "HOURS"), (5, "Sargento", None), (6, "2 agentes", "STAFF"), (7, None, None)],
    lambda d: d.select("id", fused_text.misplaced(F.col("raw")).alias("holds")),
)
cases(
    "name_similarity", "id int, a string, b string", "score int",
    [
        (1, "Centro de Salud Quéntar", "CENTRO DE SALUD QUENTAR", 100), (2, "Centro de Salud", "Centro de Salud de Quéntar", 87), (3, "Centro de Salud de Quéntar", "Centro de Salud Quéntar", 100), (4, "Casa de la Cultura Baza", "Casa Cultura Baza", 60),
        (5, "Consultorio Quentr", "Consultorio médico Quentar", 60), (6, "Ayuntamiento de Baza", "Parque de Bomberos", 10), (7, "Hospital", "Colegio", 0), (8, "", "Colegio", 0), (9, None, "Colegio", 0), (10, "Colegio San José", "Colegio San Juan", 25),
    ],
    lambda d: d.select("id", T.graded_similarity(F.col("a"), F.col("b")).alias("score")),
)
cases(
    "place_names", "id int, a string, b string", "same boolean, score double",
    [
        (1, "Güéjar Sierra", "guejar sierra", True, 100.0), (2, "Baza", "Baza de Granada", True, 90.0), (3, "Almuñecar", "Almunecr", True, 88.888889), (4, "Loja", "Motril", False, 16.666667), (5, "", "Loja", False, 90.0), (6, "de Baza", "Puerto de Baza", True, 85.0),
    ],
    lambda d: d.select("id", F.coalesce(T.same_place_name(F.col("a"), F.col("b")), F.lit(False)).alias("same"), _six(T.match_score(F.col("a"), F.col("b"))).alias("score")),
)
cases(
    "name_variants", "id int, name string", "term string, variants string",
    [
        (1, "La Puebla de Don Fadrique", "la puebla de don fadrique", "puebla de don fadrique|la puebla don fadrique"), (2, "Castilléjar", "castillejar", ""), (3, "Cuevas del Campo", "cuevas del campo", "cuevas|cuevas campo"),
        (4, "El-Ejido", "el ejido", "ejido"), (5, "Vélez_Rubio", "velez rubio", "velez"),
    ],
    lambda d: d.select("id", T.file_key(F.col("name")).alias("term"), F.array_join(T.name_variants(F.col("name")), "|").alias("variants")),
)

# ---------------------------------------------------------------- kinds of places

_PLACES = [
    (1, "Centro de Salud San Antón", "SANITARIO", "ALTA"), (2, "CEIP Miguel Hernández", "EDUCATIVO", "ALTA"), (3, "EDAR Granada Sur", "HIDRAULICO", "ALTA"), (4, "Subestación Baza 220kV", "ENERGIA", "ALTA"), (5, "Cuartel de la Guardia Civil", "POLICIAL", "ALTA"),
    (6, "Parque de Bomberos", "BOMBEROS", "ALTA"), (7, "Museo Arqueológico", "CULTURAL", "ALTA"), (8, "Ermita de San Roque", "RELIGIOSO", "ALTA"), (9, "Polideportivo Municipal", "DEPORTIVO", "ALTA"), (10, "Casa Consistorial", "MUNICIPAL", "ALTA"),
    (11, "Residencia de mayores", "SOCIAL", "ALTA"), (12, "Gasolinera Repsol", "COMBUSTIBLE", "ALTA"), (13, "Protección Civil", "EMERGENCIAS", "ALTA"), (14, "Repetidor TV", "TELECOM", "ALTA"), (15, "Antigua carretera", "VIAL", "ALTA"),
    (16, "Nave industrial 4", "INDUSTRIAL", "ALTA"), (17, "Consultorio local", "SANITARIO", "MEDIA"), (18, "Gimnasio", "DEPORTIVO", "MEDIA"), (19, "Torre Vodafone", "TELECOM", "MEDIA"), (20, "Fuente de la plaza", "OTROS", "NULA"), (21, "", "OTROS", "NULA"), (22, None, "OTROS", "NULA"),
]
cases("place_kinds", "id int, name string", "kind string, confidence string", _PLACES, lambda d: d.select("id", classify.place_kind(F.col("name")).alias("k")).select("id", "k.kind", "k.confidence"))
register("place_kind_stats", "select kind, confidence, count(*) as n from (" + answers("id int, kind string, confidence string", [(r[0], *r[2:]) for r in _PLACES]) + ") t group by 1, 2")(
    lambda spark, _: classify.kind_stats(spark.createDataFrame([r[:2] for r in _PLACES], "id int, name string"), "name")
)
cases(
    "record_kinds", "id int, name string, said string, sheet string", "kind string",
    [
        (1, "Iglesia de la Encarnación", "", "Tabla1", "PATRIMONIO"), (2, "Farmacia", "", "", "SANITARIO"), (3, "IES Alhama", "", "", "EDUCATIVO"), (4, "Puesto", "", "Seguridad", "SEGURIDAD"), (5, "Antena", "", "", "TELECOMUNICACIONES"), (6, "Piscina", "", "", "DEPORTIVO"),
        (7, "Depósito de agua", "", "", "HIDRAULICO"), (8, "Endesa", "", "", "ENERGIA"), (9, "Ayuntamiento", "", "", "MUNICIPAL"), (10, "Acceso norte", "", "", "VIAL"), (11, "Jardín", "", "", "RECREATIVO"), (12, "Almacén", "", "", "OTRO"), (13, None, None, None, "OTRO"),
    ],
    lambda d: d.select("id", classify.record_kind(F.col("name"), F.col("said"), F.col("sheet")).alias("kind")),
)
cases(
    "address_kinds", "id int, address string, name string", "kind string",
    [
        (1, "", "Antena de telefonía", "telecom"), (2, "C/ Real 3", "Piscina", "sports"), (3, "km 12", "A-92 Norte", "road"), (4, "Polígono 14 parcela 3", "Nave", "cadastral"), (5, "Paraje Los Llanos", "Depósito", "toponym"), (6, "Calle Real", "Casa", "postal"),
        (7, "Real, 12", "Casa", "postal"), (8, "Real s/n", "Casa", "postal"), (9, "Real", "Casa", "unknown"), (10, None, None, "unknown"), (11, "12-34", "Finca", "cadastral"),
    ],
    lambda d: d.select("id", classify.address_kind(F.col("address"), F.col("name")).alias("kind")),
)
cases(
    "facility_detectors", "id int, name string", "water string, energy string, sports string, heritage string, protection string, school string",
    [
        (1, "EDAR Baza", "EDAR", "SUBSTATION", "GENERICO", "OTRO", "DESCONOCIDO", "OTRO"), (2, "Embalse del Negratín", "Embalses", "SUBSTATION", "GENERICO", "OTRO", "DESCONOCIDO", "OTRO"), (3, "Parque eólico Norte", "EDAR", "WIND_FARM", "GENERICO", "OTRO", "DESCONOCIDO", "OTRO"),
        (4, "Campo de golf", "EDAR", "SUBSTATION", "CAMPO_GOLF", "OTRO", "DESCONOCIDO", "OTRO"), (5, "Estadio de la Juventud", "EDAR", "SUBSTATION", "ESTADIO", "OTRO", "DESCONOCIDO", "OTRO"), (6, "Castillo BIC", "EDAR", "SUBSTATION", "GENERICO", "ARQUITECTURA_DEFENSIVA", "BIC", "OTRO"),
        (7, "C.E.I.P. Jabalcón", "EDAR", "SUBSTATION", "GENERICO", "OTRO", "DESCONOCIDO", "CEIP"), (8, "Planta solar", "EDAR", "SOLAR_PLANT", "GENERICO", "OTRO", "DESCONOCIDO", "OTRO"), (9, "Dolmen inventariado", "EDAR", "SUBSTATION", "GENERICO", "SITIO_ARQUEOLOGICO", "INVENTARIO", "OTRO"),
        (10, None, "EDAR", "SUBSTATION", "GENERICO", "OTRO", "DESCONOCIDO", "OTRO"), (11, "Piscina y pista", "EDAR", "SUBSTATION", "PISCINA", "OTRO", "DESCONOCIDO", "OTRO"), (12, "Desaladora", "Desaladoras", "SUBSTATION", "GENERICO", "OTRO", "DESCONOCIDO", "OTRO"),
    ],
    lambda d: d.select("id", *(classify.detected(F.col("name"), k).alias(k) for k in ("water", "energy", "sports", "heritage", "protection", "school"))),
)
cases(
    "place_predicates", "id int, name string", "outdoors boolean, sports boolean, telecom boolean, words string",
    [
        (1, "Cortijo de la Era", True, False, False, "Cortijo|Era"), (2, "Pabellón cubierto", False, True, False, "Pabellón|cubierto"), (3, "Antena Movistar", False, False, True, "Antena|Movistar"), (4, "Centro de Salud", False, False, False, "Centro|Salud"), (5, "Peñón del Águila", True, False, False, "Peñón|Águila"), (6, None, False, False, False, ""),
    ],
    lambda d: d.select("id", classify.looks_natural(F.col("name")).alias("outdoors"), classify.is_sports(F.lit(None).cast("string"), F.col("name")).alias("sports"), classify.is_telecom(F.col("name")).alias("telecom"), F.coalesce(F.array_join(classify.keywords(F.col("name")), "|"), F.lit("")).alias("words")),
)
cases(
    "unlocatable_addresses", "id int, raw string", "reason string",
    [
        (1, "Lugar más próximo donde se localice la emergencia", "NO_PLACE"), (2, "Pol 14- P 146", "CADASTRAL"), (3, "C/ Real 3 y C/ Nueva 5", "SEVERAL"), (4, "C/ PLAZA DE LA CONSTITUCIÓN", None), (5, "POLIGONO C/ QUINTA AVENIDA", None), (6, "Según emergencia", "NO_PLACE"),
        (7, "Los disponibles", "NO_PLACE"), (8, "Pendiente de asignar", "NO_PLACE"), (9, "Consultorio médico de Baza", "NO_PLACE"), (10, "C/Garcilaso de la Vega, 5", None), (11, "Indicar ubicación", "NO_PLACE"),
    ],
    lambda d: d.select("id", address.unlocatable(F.col("raw")).alias("reason")),
)

# ---------------------------------------------------------------- documents

_DOCUMENT = [
    ("d.odt", "Centros", [["Nombre", "Dirección", "Coordenadas", ""], ["", "", "X", "Y"], ["Consultorio Baza", "C/ Real 3", "504 750", "4.077.153"], ["Longitud", "", "", ""], ["Ermita Alta", "Paraje Llano ", "Indicar", ""], ["Ana Pérez Ruiz", "C/ Sol 1", "", ""], ["Sede", "", "", ""]]),
    ("d.odt", "Personal", [["Cargo", "Nombre", "Teléfono de contacto"], ["Jefe", "Ana", "958000000"], ["Agente", "Luis", "958000001"]]),
    ("d.odt", "Sueltos", [["", "a", "b"], ["Depósito Sur", "437 686", "4 076 367"], ["Pozo Alto", "437 700", "4 076 400"]]),
    ("d.odt", "Riesgos", [["Riesgo", "Nivel"], ["Incendios forestales", "alto"]]),
]


def _cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, s, r, c, v) for p, s, rows in _DOCUMENT for r, row in enumerate(rows) for c, v in enumerate(row) if v], "path string, sheet string, row int, col int, value string")


@register("table_structure", answers("sheet string, name int, address int, x int, y int, start int, trust int, staff boolean, utm boolean", [("Centros", 0, 1, 2, 3, 2, 100, False, True), ("Personal", 1, None, None, None, 1, 30, True, False), ("Sueltos", 0, None, None, None, 1, 0, False, True), ("Riesgos", 0, None, None, None, 1, 0, False, False)]))
def table_structure(spark, sf_dir):
    rows = structure.grid(_cells(spark))
    both = structure.structure(rows).join(structure.table_facts(rows), ["path", "sheet"])
    return both.select("sheet", *(F.col(c).cast("long").alias(c) for c in ("name", "address", "x", "y", "start", "trust")), "staff", "utm")


@register("document_records", answers("sheet string, row int, name string, type string, x_text string, y_text string, has_coordinates boolean, address_kind string", [
    ("Centros", 2, "Consultorio Baza", "SANITARIO", "504750", "4077153", True, "postal"), ("Centros", 4, "Ermita Alta", "PATRIMONIO", "", "", False, "toponym"),
    ("Sueltos", 1, "Depósito Sur", "HIDRAULICO", "437686", "4076367", True, "unknown"), ("Sueltos", 2, "Pozo Alto", "OTRO", "437700", "4076400", True, "unknown"),
]))
def document_records(spark, sf_dir):
    return structure.records(_cells(spark)).select("sheet", F.col("row").cast("long").alias("row"), "name", "type", "x_text", "y_text", "has_coordinates", "address_kind")


@register("document_record_stats", answers("grouping string, label string, n int", [("total", "", 4), ("coordinates", "with", 3), ("coordinates", "without", 1), ("type", "SANITARIO", 1), ("type", "PATRIMONIO", 1), ("type", "HIDRAULICO", 1), ("type", "OTRO", 1), ("table", "Centros", 2), ("table", "Sueltos", 2)]))
def document_record_stats(spark, sf_dir):
    return structure.record_stats(structure.records(_cells(spark)))


# ---------------------------------------------------------------- fusion

_RESULTS = [
    (1, 0, "CDAU", 100000.0, 4000000.0, 90.0, "SANITARIO"), (1, 1, "CARTOCIUDAD", 100010.0, 4000000.0, 80.0, "SANITARIO"), (1, 2, "OSM", 100000.0, 4000010.0, 70.0, "SANITARIO"),
    (2, 0, "CDAU", 100000.0, 4000000.0, 90.0, "SANITARIO"), (2, 1, "CARTOCIUDAD", 100600.0, 4000000.0, 80.0, "SANITARIO"),
    (3, 0, "OSM", 100000.0, 4000000.0, 60.0, "SANITARIO"), (4, 0, "NOMINATIM", 0.0, 4000000.0, 60.0, None),
    (5, 0, "CDAU", 100000.0, 4000000.0, 90.0, "DEPORTIVO"), (5, 1, "OSM", 100250.0, 4000000.0, 95.0, "DEPORTIVO"), (6, 0, "NGA", 100000.0, 4000000.0, 100.0, None), (6, 1, "IAID", 100150.0, 4000000.0, 90.0, None),
]


@register("fusion_validated", answers("qid int, n int, x double, y double, score double, status string, metres double, primary_source string, review boolean, reason string", [
    (1, 3, 100003.42, 4000002.29, 94.9, "CONFIRMED", 14.1, "CDAU", False, None), (2, 2, None, None, 64.3, "CONFLICT", 600.0, "CDAU", True, "CONFLICT"),
    (3, 1, 100000.0, 4000000.0, 56.5, "SINGLE_SOURCE", None, "OSM", True, "LOW_SCORE"), (4, 0, None, None, 0.0, "NO_RESULTS", None, None, True, "LOW_SCORE"),
    (5, 2, 100000.0, 4000000.0, 78.5, "UNCERTAIN", 250.0, "CDAU", False, None), (6, 2, 100070.11, 4000000.0, 93.5, "LIKELY_VALID", 150.0, "NGA", False, None),
]))
def fusion_validated(spark, sf_dir):
    r = spark.createDataFrame(_RESULTS, "qid int, position int, source string, x double, y double, confidence double, kind string")
    v = fusion.validated(r, "qid", "kind")
    return v.select("qid", "n", (F.floor(F.col("x") * 100 + 0.5) / 100).alias("x"), (F.floor(F.col("y") * 100 + 0.5) / 100).alias("y"), "score", "status", "metres", F.col("primary").alias("primary_source"), "review", "reason")


_CLUSTER = [
    (1, "CDAU", 100000.0, 4000000.0, 0.80), (1, "LOCAL", 100004.0, 4000000.0, 0.95), (1, "NGA", 100000.0, 4000003.0, 0.75),
    (2, "CDAU", 100000.0, 4000000.0, 0.80), (2, "LOCAL", 100030.0, 4000040.0, 0.95), (3, "CDAU", 100000.0, 4000000.0, 0.80), (4, "CDAU", 100000.0, 4000000.0, 0.80), (4, "LOCAL", 103000.0, 4004000.0, 0.95),
    (5, "CDAU", 100000.0, 4000000.0, 0.80), (5, "LOCAL", 100010.0, 4000000.0, 0.95), (5, "NGA", 100000.0, 4000010.0, 0.75), (5, "OVERPASS", 100010.0, 4000010.0, 0.60), (5, "NOMINATIM", 105000.0, 4005000.0, 0.55), (6, "CDAU", None, None, 0.80),
]


@register("fusion_clusters", answers("qid int, n int, radius double, concordant int, outliers string, concordance double, found boolean, severity string", [
    (1, 3, 2.8, 3, "", 1.0, False, "low"), (2, 2, 25.0, 2, "", 1.0, False, "low"), (3, 1, 0.0, 1, "", 1.0, False, "low"), (4, 2, 2500.0, 0, "CDAU,LOCAL", 0.0, True, "high"), (5, 5, 10.4, 4, "NOMINATIM", 0.849315, False, "low"),
]))
def fusion_clusters(spark, sf_dir):
    c = fusion.clusters(spark.createDataFrame(_CLUSTER, "qid int, source string, x double, y double, authority double"), "qid")
    d = fusion.discrepancy(F.col("radius"), F.col("outlier_trust"), F.col("concordance"), F.lit(None).cast("string"))
    return c.withColumn("d", d).select("qid", "n", (F.floor(F.col("radius") * 10 + 0.5) / 10).alias("radius"), "concordant", F.array_join("outliers", ",").alias("outliers"), _six(F.col("concordance")).alias("concordance"), "d.found", "d.severity")


cases(
    "fusion_recommendation", "id int, match double, concordance double, authority double, radius double, trust double, kind string, concordant int", "score int, severity string, verdict string",
    [
        (1, 95.0, 1.0, 0.9, 10.0, 0.0, "SANITARIO", 3, 96, "low", "USE_RESULT"), (2, 95.0, 1.0, 0.9, 60.0, 0.0, "SANITARIO", 3, 96, "medium", "MANUAL_REVIEW"), (3, 95.0, 1.0, 0.9, 101.0, 0.0, "SANITARIO", 3, 96, "high", "REJECT"), (4, 95.0, 1.0, 0.9, 60.0, 0.0, "ENERGIA", 3, 96, "low", "USE_RESULT"),
        (5, 95.0, 0.7, 0.9, 10.0, 0.85, "ENERGIA", 2, 84, "medium", "MANUAL_REVIEW"), (6, 95.0, 1.0, 0.9, 0.0, 0.0, None, 1, 96, "low", "MANUAL_REVIEW"), (7, 20.0, 0.2, 0.5, 0.0, 0.0, None, 2, 28, "low", "REJECT"), (8, 60.0, 0.6, 0.6, 0.0, 0.0, None, 2, 60, "low", "MANUAL_REVIEW"),
        (9, 100.0, 0.5, 0.9, 0.0, 0.0, None, 2, 78, "low", "USE_RESULT"), (10, 0.95, 1.0, 0.9, 10.0, 0.0, "OTHER", 2, 96, "low", "USE_RESULT"),
    ],
    lambda d: d.withColumn("score", fusion.composite(F.col("match"), F.col("concordance"), F.col("authority"))).withColumn("d", fusion.discrepancy(F.col("radius"), F.col("trust"), F.col("concordance"), F.col("kind")))
    .select("id", "score", "d.severity", fusion.recommendation(F.col("score"), F.col("d.found"), F.col("d.severity"), F.col("concordant")).alias("verdict")),
)

# ---------------------------------------------------------------- candidates and municipalities

_CANDIDATES = [
    ("a", "18023", "Centro de Salud Baza", "C/ Real 3", "Baza", 1), ("b", "18023", "Consultorio Caniles", "C/ Sol 9", "Caniles", 1), ("c", "18050", "CEIP San José", "Plaza Mayor 1", "Loja", 2), ("d", "18050", "CEIP San Juan", "Plaza Mayor 2", "Loja", 2),
    ("e", "18060", "Parque", None, "Motril", 3),
]
_REQUESTS = [(1, "Centro de Salud Baza", "Calle Real 3", "Baza", "18023", "SANITARIO", 1), (2, "CEIP San", None, None, "18050", "EDUCATIVO", 2), (3, "Ermita", None, None, "18061", "CULTURAL", 3), (4, "Nada", None, None, "18070", None, 9)]


@register("candidate_disambiguation", answers("id int, candidate string, score int, confidence string, gap int, reliable boolean, review boolean", [(1, "a", 100, "HIGH", 96, True, False), (2, "c", 72, "LOW", 0, False, True), (3, "e", 0, "LOW", 100, False, True), (4, None, 0, "NONE", 0, False, False)]))
def candidate_disambiguation(spark, sf_dir):
    r = spark.createDataFrame(_REQUESTS, "id int, name string, address string, locality string, code string, kind string, scope int")
    c = spark.createDataFrame(_CANDIDATES, "candidate string, c_code string, c_name string, c_address string, c_municipality string, scope int")
    return candidates.disambiguated(r, c, ["scope"], "id", F.col("kind"))


_CATALOGUE = [("18023", "Baza"), ("18029", "Benamaurel"), ("18053", "Cuevas del Campo"), ("18140", "Motril"), ("18164", "La Puebla de Don Fadrique"), ("18122", "Loja"), ("04902", "El Ejido")]


def _catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CATALOGUE, "code string, place string")


cases_rows = [
    (1, "BAZA", "18023", "EXACT"), (2, "ejido", "04902", "EXACT"), (3, "Cuevas Campo", "18053", "EXACT"), (4, "Benamaurell", "18029", "CONTAINED"), (5, "Motrill", "18140", "CONTAINED"), (6, "Benamaurle", None, None), (7, "Bnamaurel", "18029", "TYPO"), (8, "Sevilla", None, None),
    (9, "", None, None), (10, None, None, None), (11, "Puebla de Don Fadriqe", "18164", "TYPO"),
]


@register("municipality_resolution", answers("id int, code string, how string", [(r[0], *r[2:]) for r in cases_rows]))
def municipality_resolution(spark, sf_dir):
    return candidates.resolved(spark.createDataFrame([r[:2] for r in cases_rows], "id int, name string"), _catalogue(spark), "id", "name", "code", "place")


@register("municipality_search", answers("id int, code string, score int, rank int", [(1, "18023", 100, 1), (2, "18029", 80, 1), (3, "18053", 60, 1), (4, "18140", 43, 1)]))
def municipality_search(spark, sf_dir):
    return candidates.places_by_text(spark.createDataFrame([(1, "baza"), (2, "Bena"), (3, "campo"), (4, "motrli s"), (5, "x")], "id int, name string").where("id <> 4").unionByName(spark.createDataFrame([(4, "motri l")], "id int, name string")), _catalogue(spark), "id", "name", "code", "place")


_TEXTS = [(1, "Plan de Baza. Baza y Loja. En Baza capital."), (2, "Cuevas del Campo, cuevas y campos; Loja, Loja"), (3, "Nada que ver"), (4, None)]


@register("municipality_mentions", answers("id int, code string, n int, score int", [(1, "18023", 3, 65), (2, "18053", 3, 55)]))
def municipality_mentions(spark, sf_dir):
    return candidates.mentions(spark.createDataFrame(_TEXTS, "id int, text string"), _catalogue(spark), "id", "text", "code", "place")


@register("municipality_votes", answers("id int, code string, score int, confidence string", [(1, "18023", 100, "ALTA"), (2, "18122", 71, "MEDIA"), (3, "18140", 60, "BAJA"), (5, "18029", 80, "ALTA")]))
def municipality_votes(spark, sf_dir):
    rows = [(1, "HEADER", "18023", 95), (1, "FILE_NAME", "18023", 90), (2, "HEADER", "18122", 95), (2, "CONTENT", "18023", 80), (3, "CONTENT", "18140", 60), (4, "CONTENT", "18140", 40), (5, "CONTENT", "18029", 70), (5, "CONTENT", "18029", 90)]
    return candidates.voted(spark.createDataFrame(rows, "id int, kind string, code string, points int"), "id")


@register("answer_order", answers("id int, place_no int", [(1, 1), (2, 2), (3, 3), (4, 4), (5, 0), (6, 0)]))
def answer_order(spark, sf_dir):
    d = spark.createDataFrame([(1, "portal"), (2, "callejero"), (3, "municipio"), (4, "provincia"), (5, "toponimo"), (6, None)], "id int, kind string")
    return d.select("id", candidates.answer_rank(F.col("kind")).cast("long").alias("place_no"))


@register("spanish_order", answers("place_no int, name string", [(1, "Ácula"), (2, "Alhama"), (3, "Ítrabo"), (4, "Loja"), (5, "Nívar"), (6, "Ñoclo"), (7, "Órgiva"), (8, "Zújar")]))
def spanish_order(spark, sf_dir):
    from pyspark.sql import Window as W

    d = spark.createDataFrame([(x,) for x in ("Zújar", "Órgiva", "Ñoclo", "Nívar", "Loja", "Ítrabo", "Alhama", "Ácula")], "name string")
    return d.select(F.row_number().over(W.orderBy(F.collate("name", "es"))).cast("long").alias("place_no"), "name")


# ---------------------------------------------------------------- layers

_LAYERS = [
    (1, "centro_salud", 1, "Centro de Salud Baza", 504750.0, 4077153.0), (2, "hospital", 1, "Hospital de Baza", 504751.0, 4077154.0), (3, "consultorio", 1, "Consultorio Caniles", 504752.0, 4077155.0), (4, "museo", 1, "Museo Arqueológico", 504753.0, 4077156.0),
    (5, "monumento", 1, "Castillo de Baza", 504754.0, 4077157.0), (6, "parque_bomberos", 1, "Parque de Bomberos Baza", 504755.0, 4077158.0), (7, "EDAR", 1, "EDAR Baza", 504756.0, 4077159.0), (8, "Embalses", 1, "Embalse del Negratín", 504757.0, 4077160.0),
    (9, "parques_eolicos", 1, "Parque eólico Norte", 504758.0, 4077161.0), (10, "equipamiento_deportivo", 1, "Polideportivo Baza", 504759.0, 4077162.0), (11, "campo_golf", 1, "Campo de golf Zújar", 504760.0, 4077163.0), (12, "piscina", 1, "Piscina cubierta", 504761.0, 4077164.0),
    (13, "cortijo", 1, "Cortijo del Cura", 504762.0, 4077165.0), (14, "callejero", 1, "Calle Real 3", 504763.0, 4077166.0), (15, "centros_docentes", 1, "CEIP Jabalcón", 504764.0, 4077167.0), (16, "museo", 1, "Museo de fuera", 9.0, 9.0), (17, "museo", 2, "Museo Arqueológico", 504765.0, 4077168.0),
]
_ASKED = {
    "health": [(1, 1, "Hospital de Baza"), (2, 1, "Consultorio Caniles"), (3, 1, "Centro de Salud Baza"), (4, 1, "Ambulatorio de otro sitio"), (5, 3, "Hospital de Baza")],
    "education": [(1, 1, "CEIP Jabalcón"), (2, 1, "IES Alcrebite")], "cultural": [(1, 1, "Museo Arqueológico"), (2, 1, "Castillo de Baza"), (3, 1, "Museo de fuera"), (4, 2, "Museo Arqueologico")],
    "security": [(1, 1, "Parque de Bomberos Baza"), (2, 1, "Policía Local")], "water": [(1, 1, "Embalse del Negratín"), (2, 1, "Depuradora EDAR Baza"), (3, 1, "Negratín embalse del")], "energy": [(1, 1, "Parque eólico Norte")],
    "sports": [(1, 1, "Campo de golf Zújar"), (2, 1, "Polideportivo Baza")], "sports_census": [(1, 1, "Piscina cubierta"), (2, 1, "Cortijo del Cura")], "toponyms": [(1, 1, "Cortijo del Cura"), (2, 1, "Cerro Cortijo del Cura")],
    "streets": [(1, 1, "Calle Real, 3"), (2, 1, "Calle Real, 7"), (3, 1, "Calle Sol")],
}
_ANSWERED = {
    "health": [(1, "hospital", 2, 100, True), (2, "consultorio", 3, 100, True), (3, "centro_salud", 1, 100, True), (4, "centro_salud", 1, 7, False)],
    "education": [(1, "centros_docentes", 15, 100, True)], "cultural": [(1, "museo", 4, 100, True), (2, "monumento", 5, 100, True), (4, "museo", 17, 100, True)],
    "security": [(1, "parque_bomberos", 6, 100, True)], "water": [(1, "Embalses", 8, 100, True), (2, "EDAR", 7, 84, True), (3, "Embalses", 8, 100, True)], "energy": [(1, "parques_eolicos", 9, 100, True)],
    "sports": [(1, "campo_golf", 11, 100, True), (2, "equipamiento_deportivo", 10, 100, True)], "sports_census": [(1, "piscina", 12, 100, True), (2, "cortijo", 13, 100, True)], "toponyms": [(1, "cortijo", 13, 100, True), (2, "cortijo", 13, 92, True)],
    "streets": [(1, "callejero", 14, 98, True), (2, "callejero", 14, 100, True), (3, "callejero", 14, 17, False)],
}


def _layer_query(source: str) -> None:
    @register(f"source_{source}", answers("id int, layer string, fid int, confidence int, accepted boolean", _ANSWERED[source]))
    def query(spark, sf_dir):
        f = spark.createDataFrame(_LAYERS, "fid int, layer string, mun int, fname string, x double, y double")
        return layers.located(spark.createDataFrame(_ASKED[source], "id int, mun int, name string"), f, source).select("id", "layer", F.col("fid").cast("long").alias("fid"), "confidence", "accepted")


for _name in _ASKED:
    _layer_query(_name)

# ---------------------------------------------------------------- exports

_EXPORT = [
    (1, "Centro", "SANITARIO", None, "C/ Real", "Baza", "Granada", None, "", None, 1.0, 2.0, "EPSG:25830", 504750.0, 4077153.0, None, None, 85.0, "CDAU", ["CDAU", "OSM"], ["a", "b"]),
    (2, None, "POLICIAL", "x", None, None, None, "1", None, None, None, None, None, None, None, None, None, 0.0, None, None, None), (3, "Nave", None, None, None, "", "", None, None, "n", None, None, None, 504750.0, 4077153.0, None, None, 39.0, "", [], []),
    (4, "Social", "SOCIAL", None, None, None, None, None, None, None, None, None, None, 504800.0, 4077000.0, None, None, None, None, None, ["c"]),
]
_EXPORT_DDL = "id int, name string, kind string, said_type string, address string, municipality string, province string, phone string, email string, notes string, x0 double, y0 double, system string, x double, y double, lon double, lat double, score double, geocoded_by string, confirmed_by array<string>, alerts array<string>"


def _export(spark: SparkSession) -> DataFrame:
    return exports.projected(spark.createDataFrame(_EXPORT, _EXPORT_DDL), "Guadix", "Granada", "EPSG:4326")


@register("export_columns", answers("id int, name string, kind string, municipality string, phone string, system string, score double, band string, sources string, n_sources int, located string, alerts string", [
    (1, "Centro", "SANITARIO", "Baza", "-", "EPSG:25830", 85.0, "ALTA", "Original, CDAU, OSM", 3, "Sí", "a | b"), (2, "-", "POLICIAL", "Guadix", "1", "EPSG:4326", 0.0, "NULA", "-", 0, "No", "-"),
    (3, "Nave", "GENERICO", "Guadix", "-", "EPSG:4326", 39.0, "NULA", "Original", 1, "No", "-"), (4, "Social", "SOCIAL", "Guadix", "-", "EPSG:4326", 0.0, "NULA", "Original", 1, "No", "c"),
]))
def export_columns(spark, sf_dir):
    return _export(spark).select("id", "name", "kind", "municipality", "phone", "system", "score", "band", "sources", "n_sources", "located", "alerts")


@register("export_sheets", answers("sheet string, id int", [("General", 1), ("General", 2), ("General", 3), ("General", 4), ("Sanitario", 1), ("Seguridad", 2), ("Otros", 3), ("Municipal", 4), ("Sin_Geolocalizar", 2), ("Sin_Geolocalizar", 3), ("Sin_Geolocalizar", 4)]))
def export_sheets(spark, sf_dir):
    return exports.sheets(_export(spark)).select("sheet", "id")


@register("export_summary", answers("grouping string, label string, value double", [
    ("total", "records", 4.0), ("total", "located", 1.0), ("total", "not_located", 3.0), ("total", "mean_score", 31.0), ("total", "alerts", 3.0), ("total", "min_x", 504750.0), ("total", "max_x", 504800.0), ("total", "min_y", 4077000.0), ("total", "max_y", 4077153.0),
    ("kind", "SANITARIO", 1.0), ("kind", "POLICIAL", 1.0), ("kind", "GENERICO", 1.0), ("kind", "SOCIAL", 1.0), ("band", "ALTA", 1.0), ("band", "MEDIA", 0.0), ("band", "BAJA", 0.0), ("band", "NULA", 3.0), ("sources", "3", 1.0), ("sources", "1", 2.0), ("sources", "0", 1.0),
]))
def export_summary(spark, sf_dir):
    return exports.summary(_export(spark))


cases(
    "export_unplaced", "id int, name string, x double, y double, status string", "reason string",
    [(1, "a", None, None, "failed", "Geocodificación fallida"), (2, "b", 0.0, 4.0, "pending", "Pendiente de geocodificación"), (3, "c", None, 4.0, "original", "Sin coordenadas originales")],
    lambda d: exports.unplaced(d),
)


@register("export_by_kind", answers("n int, kind string, place_no int, heading string, name string", [(2, "A", 0, "=== A (2 elementos) ===", None), (2, "A", 1, None, "x"), (2, "A", 2, None, "z"), (1, "B", 0, "=== B (1 elementos) ===", None), (1, "B", 1, None, "y")]))
def export_by_kind(spark, sf_dir):
    return exports.by_kind(spark.createDataFrame([(1, "A", "x"), (2, "B", "y"), (3, "A", "z")], "id int, kind string, name string"))


# ---------------------------------------------------------------- notations, names, answers of services

cases(
    "notation_kinds", "id int, raw string", "kind string",
    [
        (1, "Indicar", "PLACEHOLDER"), (2, "POINT(504750 4077153)", "WKT_POINT"), (3, '{"type":"Point","coordinates":[1,2]}', "GEOJSON_POINT"), (4, "+37°26'46.5\"", "DMS_SIGNO"), (5, "N37°26'46.5\"", "DMS_PREFIJO"), (6, "37:26:46.5 N", "DMS_DOS_PUNTOS"),
        (7, "37°26.775'N", "DMS_MINUTOS_DEC"), (8, "37°26'46.5\"N", "DMS_ESTANDAR"), (9, "37° 26' 46.5\" N", "DMS_ESPACIOS_EXTRA"), (10, "37 26 46.5 N", "DMS_ESPACIOS"), (11, "$GPGGA,123519", "NMEA_SENTENCIA"), (12, "3726.775N", "NMEA_ESTANDAR"), (13, "3726N", "NMEA_ENTERO"),
        (14, "3726.775N, 00345.204W", "NMEA_PAR"), (15, "5047504077153", "CONCATENADO"), (16, "504750Â´92", "MOJIBAKE"), (17, "504 750´´92", "ESPACIO_DOBLE_TILDE"), (18, "4 077 153´´36", "ESPACIO_DOBLE_TILDE"), (19, "506 527 28", "ESPACIO_DECIMAL_IMPLICITO"),
        (20, "4 076 367", "ESPACIO_SIN_DECIMAL"), (21, "503693´77", "TILDE_SIMPLE"), (22, "4.077.905,68", "EUROPEO_COMPLETO"), (23, "436780,0", "COMA_DECIMAL"), (24, "4.230.105", "PUNTO_MILES"), (25, "521581.88", "LIMPIO"), (26, "abc", "DESCONOCIDO"), (27, None, "PLACEHOLDER"), (28, "-504750", "LIMPIO"),
    ],
    lambda d: d.select("id", notations.notation_of(F.col("raw")).alias("kind")),
)
cases(
    "facility_names", "id int, name string", "full_name string",
    [
        (1, "C.S. Baza", "Centro de Salud. Baza"), (2, "CP San José", "Colegio Público San José"), (3, "centro salud  norte", "Centro de Salud norte"), (4, "Ayto Baza", "Ayuntamiento Baza"), (5, "policia local", "Policía Local"), (6, "casa cultura", "Casa de la Cultura"),
        (7, "Campo futbol municipal", "Campo de Fútbol municipal"), (8, "colina", "colina"), (9, "", ""), (10, None, ""), (11, "GC y CT", "Guardia Civil y Centro de Transformación"), (12, "p.l.baza", "Policía Localbaza"),
    ],
    lambda d: d.select("id", synonyms.full_names(F.col("name")).alias("full_name")),
)
cases(
    "file_towns", "id int, path string", "town string, province string",
    [
        (1, "/x/PTEL_Colomera_2023.odt", "Colomera", "Granada"), (2, "Ficha_PTEL_Berja.ods", "Berja", "Almería"), (3, "Plan-Emergencia-Linares.docx", "Linares", "Jaén"), (4, "Hornos_PTEL.xlsx", "Hornos", "Jaén"), (5, "C:\\docs\\Lepe.csv", "Lepe", "Huelva"), (6, "a1.csv", None, "Granada"), (7, "Tarifa.csv", "Tarifa", "Granada"),
    ],
    lambda d: d.select("id", synonyms.town_of_file(F.col("path")).alias("town")).select("id", "town", synonyms.province_of_town(F.col("town")).alias("province")),
)
cases(
    "address_answers", "id int, response string", "municipality string, code string, lon double, lat double, confidence int, automatic int",
    [
        (1, '{"muni":"Baza","muniCode":"18023","state":1,"lat":37.5,"lng":-2.7}', "Baza", "18023", -2.7, 37.5, 95, 92), (2, 'callback({"muni":"Loja","muniCode":"18122","state":3,"lat":37.1,"lng":-4.1})', "Loja", "18122", -4.1, 37.1, 75, 78),
        (3, '{"muni":"Loja","state":9,"geom":"POINT(-4.15 37.16)"}', "Loja", None, -4.15, 37.16, 40, 55), (4, '{"muni":"Loja","state":1}', None, None, None, None, None, None), (5, "no json", None, None, None, None, None, None), (6, None, None, None, None, None, None, None),
    ],
    lambda d: d.select("id", service.address_answer(F.col("response")).alias("a")).select(
        "id", "a.municipality", "a.code", "a.lon", "a.lat", F.when(F.col("a").isNotNull(), service.state_confidence(F.col("a.state"))).cast("long").alias("confidence"), F.when(F.col("a").isNotNull(), service.state_confidence(F.col("a.state"), "automatic")).cast("long").alias("automatic")
    ),
)
_MAP = '{"elements":[{"id":1,"type":"node","lat":37.5,"lon":-2.7,"tags":{"name":"Torre A"}},{"id":2,"type":"way","center":{"lat":37.6,"lon":-2.8},"tags":{"name:es":"Torre B"}},{"id":3,"type":"way","tags":{"name":"x"}},{"id":4,"type":"node","lat":1,"lon":2,"tags":{}},{"id":5,"type":"node","lat":1,"lon":2,"tags":{"alt_name":"C"}}]}'


@register("map_elements", answers("element int, type string, name string, lon double, lat double", [(1, "node", "Torre A", -2.7, 37.5), (2, "way", "Torre B", -2.8, 37.6), (5, "node", "C", 2.0, 1.0)]))
def map_elements(spark, sf_dir):
    d = spark.createDataFrame([(_MAP,), ("{}",), ("broken",), (None,)], "response string")
    return d.select(F.explode(service.map_elements(F.col("response"))).alias("e")).select(F.col("e.id").alias("element"), "e.type", "e.name", "e.lon", "e.lat")


cases(
    "service_status", "id int, message string", "status string",
    [(1, None, "ok"), (2, "Request timeout after 5000ms", "timeout"), (3, "NetworkError when attempting to fetch", "network"), (4, "Unexpected token in JSON", "parse"), (5, "No results found", "no_results"), (6, "Ambiguous address", "ambiguous"), (7, "Invalid coordinate", "invalid_coordinate"), (8, "boom", "unknown")],
    lambda d: d.select("id", service.status_of(F.col("message")).alias("status")),
)


@register("fuzzy_search", answers("id int, item string, score double", [(1, "a", 0.0), (1, "c", 0.02), (2, "b", 0.01), (4, "c", 0.02)]))
def fuzzy_search(spark, sf_dir):
    items = spark.createDataFrame([("a", "Centro de Salud Baza", 0), ("b", "Parque de Bomberos", 1), ("c", "Centro de Salud Guadix", 2), ("z", "Centro de Salud lejano", 41)], "item string, label string, p int")
    asked = spark.createDataFrame([(1, "centro salud"), (2, "bonberos"), (3, "x"), (4, "Salud Guadx"), (5, "hospital")], "id int, name string")
    return candidates.searched(asked, items, "id", "name", "item", "label", "p")


@register("sample_profiles", answers("doc int, notation string, share int, decimal_mark string, level string, trust int", [(1, "EUROPEO_COMPLETO", 67, "comma", "low", 87), (2, "ESPACIO_SIN_DECIMAL", 100, "none", "medium", 95), (3, "COMA_DECIMAL", 50, "mixed", "medium", 70), (4, "DMS_ESTANDAR", 100, "none", "high", 95)]))
def sample_profiles(spark, sf_dir):
    rows = [(1, 1, "4.077.905,68"), (1, 2, "4.077.906,68"), (1, 3, "Indicar"), (2, 1, "4 076 367"), (3, 1, "1234.5"), (3, 2, "1234,5"), (4, 1, "37°26'46\"N")] + [(2, i, "4 076 367") for i in range(2, 21)] + [(2, 30, "broken °")]
    return notations.sampled(spark.createDataFrame(rows, "doc int, n int, v string"), "doc", "v", "n").withColumnRenamed("decimal", "decimal_mark")


@register("coordinate_columns", answers("place_no int, x_column string, y_column string, score double", [(1, "X - Longitud", "Y_UTM", 0.666667)]))
def coordinate_columns(spark, sf_dir):
    d = spark.createDataFrame([("a", "504750", "4077153", None), ("b", "504 751", "4.077.153", "x"), ("c", "n", "1", "7")], ["nombre", "X - Longitud", "Y_UTM", "norte"])
    found = notations.coordinate_columns(d)
    return spark.createDataFrame([(i, a, b, round(s, 6)) for i, (a, b, s) in enumerate(found, 1)] or [], "place_no int, x_column string, y_column string, score double")


cases(
    "profile_remarks", "id int, broken int, mixed boolean, dms int, nmea int, fused int, with_x int, with_y int, missing int, n int", "remarks string",
    [(1, 1, True, 2, 3, 4, 1, 1, 9, 10, "broken_encoding,mixed_marks,degrees,satellite,fused,few_coordinates,placeholders"), (2, 0, False, 0, 0, 0, 10, 10, 0, 10, ""), (3, 0, False, 0, 0, 0, 0, 0, 0, 0, "few_coordinates"), (4, 0, False, 0, 0, 0, 5, 5, 3, 10, "")],
    lambda d: d.select("id", F.array_join(notations.recommendations(*(F.col(c) for c in ("broken", "mixed", "dms", "nmea", "fused", "with_x", "with_y", "missing", "n"))), ",").alias("remarks")),
)


cases(
    "encoding_tiers", "id int, raw string", "text string, tiers string",
    [
        (1, "Almer\u00c3\u00ada", "Almería", "pairs"), (2, "Sierra Nevada", "Sierra Nevada", ""), (3, "Ca\u00c3\u0083\u00c2\u00b1ada", "Cañada", "double,pairs"), (4, "10 â‚¬ â€“ â€œbajoâ€\u009d", "10 € – “bajo”", "signs"), (5, "Ma\u0301laga y n\u0303", "Málaga y ñ", "marks"), (6, None, None, None),
        (7, "Ã‰cija", "Écija", "signs"), (8, "Mérida y Almer\u00c3\u00ada", "Mérida y Almería", "pairs"),
    ],
    lambda d: d.select("id", T.repaired(F.col("raw")).alias("r")).select("id", "r.text", F.array_join("r.tiers", ",").alias("tiers")),
)
cases(
    "street_samples", "id int, raw string", "street string, reason string",
    [
        (1, "Centro de Salud Norte, Plaza Luis Mora, n/ 1, de Albox, disponible 24 horas", "Plaza Luis Mora, 1, Albox", None), (2, "Ayuntamiento, despachos, Avda. De la Estación s/n, Albox (Almería)", "Avenida de la Estación, s/n, Albox", None),
        (3, "C/ erillas, 2Colomera", "Calle Erillas, 2, Colomera", None), (4, "Avd Virgen de la Cabeza, 9. Colomera", "Avenida Virgen de la Cabeza, 9, Colomera", None), (5, "Plaza de la Constitución 1.  Berja 04760", "Plaza de la Constitución, 1, Berja", None),
        (6, "C/ LOS Geranios - 2", "Calle Los Geranios, 2", None), (7, "CUESTA MATUETE S/N", "Cuesta Matuete, s/n", None), (8, "Villanueva, Calle Mayor, 15", "Calle Mayor, 15, Villanueva", None), (9, "Calle Real, 1, Tlf. 666123456", "Calle Real, 1", None),
        (10, "Paraje cortijo el chopo", "Paraje Cortijo El Chopo", None), (11, "Calle Real, 1 - horario L-V 8-15", "Calle Real, 1", None), (12, "Pol 14- P 146", None, "CADASTRAL"), (13, "CL. Ramón y Cajal 5.", "Calle Ramón y Cajal, 5", None), (14, "Carretera 334, frente Cuartel, Tíjola", "Carretera 334, Tíjola", None),
    ],
    lambda d: d.select("id", address.street(F.col("raw")).alias("s")).select("id", "s.street", "s.reason"),
)


@register("local_search", answers("id int, fid int, scope int", [(1, 1, 0), (2, 3, 1), (3, 1, 2), (3, 2, 2), (3, 3, 2)]))
def local_search(spark, sf_dir):
    """Features of the request's municipality by code, else by its name, else all; among them those that hold the request's first word."""
    f = spark.createDataFrame([(1, "18023", "baza", "Centro Baza"), (2, "18023", "baza", "Parque Centro"), (3, "18122", "loja", "Centro Loja")], "fid int, code string, place string, fname string")
    r = spark.createDataFrame([(1, "18023", "baza", "Centro Baza"), (2, "99999", "loja", "Centro"), (3, None, "nowhere", "Centro")], "id int, code string, place string, name string")
    fits = F.col("fname").contains(F.substring_index("name", " ", 2))
    by_code = r.select("id", "code", "name").join(f, "code").where(fits).select("id", "fid")
    by_name = r.select("id", "place", "name").join(f, "place").where(fits).select("id", "fid")
    every = r.select("id", "name").join(f, fits).select("id", "fid")
    return candidates.scoped(by_code, by_name, every, "id").select("id", "fid", "scope")


@register("tower_by_operator", answers("id int, tower int", [(1, 12), (2, 11), (3, 21)]))
def tower_by_operator(spark, sf_dir):
    t = spark.createDataFrame([(1, 11, "Orange"), (1, 12, "Movistar"), (2, 21, "Vodafone"), (2, 22, None)], "mun int, tower int, operator string")
    r = spark.createDataFrame([(1, 1, "Torre de Movistar"), (2, 1, "Torre sin marca"), (3, 2, "Antena")], "id int, mun int, name string")
    return candidates.by_operator(t, r, ["mun"], "id", "tower")


@register("unlike_second_source", answers("rid int, name string", [(2, "Ermita de San Roque"), (3, "Castillo de Baza")]))
def unlike_second_source(spark, sf_dir):
    """Rows of a second source that no kept row of the first resembles by over 85."""
    kept = spark.createDataFrame([(1, "Iglesia Mayor de la Encarnación"), (2, "Castillo de Baza")], "mun int, name string")
    rows = spark.createDataFrame([(1, 1, "Iglesia Mayor Encarnación de la"), (2, 1, "Ermita de San Roque"), (3, 1, "Castillo de Baza"), (4, 2, "CASTILLO DE BAZA")], "rid int, mun int, name string")
    return candidates.unlike_any(rows, kept, ["mun"], "rid", "name").select("rid", "name")
