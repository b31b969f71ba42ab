"""What kind of place a text names, as Column expressions: ordered rules, the first that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# For each kind, in the order in which they are tried, words that name it surely and words that hint at it (patterns, any case).
PLACE_KINDS = {
    "SANITARIO": (r"centro\s+de\s+salud|hospital|cl[íi]nica|consultorio\s+m[ée]dico?|ambulatorio|urgencias?|centro\s+sanitario", r"consultorio|m[ée]dico?|sanitari[oa]|sas\b"),
    "EDUCATIVO": (r"colegio|instituto|escuela|centro\s+educativo|ceip|ies|guardería|c\.e\.i\.p\.|i\.e\.s\.", r"educaci[óo]n|infantil|primaria|secundaria|aula"),
    "POLICIAL": (r"comisar[íi]a|cuartel\s+de\s+la\s+guardia\s+civil|polic[íi]a\s+(local|nacional)|comandancia|puesto\s+guardia\s+civil", r"polic[íi]a|guardia\s+civil|g\.civil|seguridad\s+ciudadana"),
    "BOMBEROS": (r"parque\s+de\s+bomberos?|bomberos?|estaci[óo]n\s+de\s+bomberos?", r"extinc?i[óo]n\s+incendios?|servicios?\s+contra\s+incendios?"),
    "CULTURAL": (r"museo|biblioteca|centro\s+cultural|teatro|casa\s+de\s+la\s+cultura|auditorio", r"cultural|patrimonio|exposici[óo]n"),
    "RELIGIOSO": (r"iglesia|ermita|parroquia|convento|monasterio|catedral|bas[íi]lica|capilla", r"religios[oa]|culto|templo|sacr[oa]"),
    "DEPORTIVO": (r"polideportivo|pabell[óo]n\s+deportivo|campo\s+de\s+f[úu]tbol|piscina\s+municipal|complejo\s+deportivo", r"deportivo|gimnasio|pista\s+deportiva"),
    "MUNICIPAL": (r"ayuntamiento|casa\s+consistorial|oficina\s+municipal|centro\s+administrativo|casa\s+del\s+pueblo", r"municipal|consistorio|servicios?\s+municipales?"),
    "SOCIAL": (r"centro\s+social|residencia|centro\s+de\s+d[íi]a|hogar\s+del\s+pensionista|centro\s+de\s+mayores", r"social|servicios?\s+sociales?|asistencia\s+social"),
    "COMBUSTIBLE": (r"gasolinera|estaci[óo]n\s+de\s+servicio|[áa]rea\s+de\s+servicio|e\.s\.", r"combustible|carburante|repostaje"),
    "EMERGENCIAS": (r"protecci[óo]n\s+civil|emergencias?|112|centro\s+coordinaci[óo]n|cecopal", r"emergencia|urgencia|coordinaci[óo]n"),
    "HIDRAULICO": (r"edar|etap|depuradora|potabilizadora|embalse|presa|dep[óo]sito\s+(de\s+)?agua|captaci[óo]n|aljibe", r"hidráulic[oa]|saneamiento|abastecimiento|agua\s+potable|aguas?\s+residuales?"),
    "ENERGIA": (r"subestaci[óo]n|centro\s+de?\s*transformaci[óo]n|central\s+(el[ée]ctrica|t[ée]rmica)|parque\s+e[óo]lico|planta\s+solar|fotovoltaica|l[íi]nea\s+(de\s+)?(alta\s+)?tensi[óo]n", r"energ[ée]tic[oa]|el[ée]ctric[oa]|aerogenerador|renovable|kv\b|\d+\s*kv"),
    "TELECOM": (r"antena|repetidor|torre\s+(de\s+)?comunicaci[óo]n|estaci[óo]n\s+base|bts|centro\s+(de\s+)?telecomunicaci[óo]n", r"movistar|vodafone|orange|yoigo|masmovil|telefon[íi]a|m[óo]vil|telecom"),
    "VIAL": (r"carretera|autov[íi]a|autopista|camino\s+rural|v[íi]a\s+p[ú]blica|acceso\s+principal", r"vial|viario|carril|tramo|cruce|rotonda|camino"),
    "INDUSTRIAL": (r"pol[íi]gono\s+industrial|nave\s+industrial|f[áa]brica|planta\s+industrial|zona\s+industrial|parque\s+empresarial", r"industrial|industria|almac[ée]n|taller|manufactura"),
}
# Kinds of the records of a document, in order, with the words that give them away anywhere in name, type or table.
RECORD_KINDS = {
    "PATRIMONIO": r"patrimonio|hist[oó]rico|cultural|monumento|iglesia|ermita|museo|castillo|torre|puente",
    "SANITARIO": r"sanita|salud|m[eé]dico|consultorio|hospital|ambulatorio|farmacia|centro\s*de\s*salud",
    "EDUCATIVO": r"educa|enseñanza|colegio|instituto|escuela|ceip|ies|guarder[ií]a|infantil",
    "SEGURIDAD": r"seguridad|polic[ií]a|guardia\s*civil|bomberos|protecci[oó]n\s*civil",
    "TELECOMUNICACIONES": r"telecom|antena|repetidor|comunicaci[oó]n|telef[oó]nica|movistar|vodafone|orange",
    "DEPORTIVO": r"deport|piscina|polideportivo|campo|pabell[oó]n|gimnasio|pista",
    "HIDRAULICO": r"hidr[aá]ulic|agua|dep[oó]sito|embalse|edar|depuradora|potabilizadora",
    "ENERGIA": r"energ[ií]a|el[eé]ctric|subestaci[oó]n|transformador|endesa|iberdrola",
    "MUNICIPAL": r"municipal|ayuntamiento|administrativo|casa\s*consist",
    "VIAL": r"vial|carretera|camino|acceso|autopista|autov[ií]a",
    "RECREATIVO": r"recreativ|parque|[aá]rea\s*recreativa|jard[ií]n",
}
# Ways in which an address may be given: kind, what is looked at (both, the name, the address), pattern.
ADDRESS_KINDS = [
    ("telecom", "both", r"(antena|repetidor|torre\s*(de\s*)?comunicaci[oó]n|bts|estaci[oó]n\s*base)"),
    ("sports", "both", r"(piscina|campo\s*(de\s*)?(f[uú]tbol|golf)|polideportivo|pabell[oó]n|gimnasio|pista)"),
    ("road", "name", r"^(carretera|autov[ií]a|autopista|ctra\.?|[anc][-\s]?\d{1,4}|gr[-\s]?\d{3,4})"),
    ("cadastral", "address", r"^(pol[ií]gono|parcela|pol\.?\s*\d|parc\.?\s*\d|\d+[-/]\d+)"),
    ("toponym", "address", r"^(paraje|cerro|cortijo|barranco|arroyo|fuente|era|cañada|llano|loma|monte|sierra|vega|haza)\s"),
    ("postal", "address", r"^(c/|calle|avda?\.?|avenida|plaza|pza\.?|paseo|ctra\.?|carretera|camino|travesía|ronda|glorieta)\s"),
    ("postal", "address", r",?\s*\d+\s*$|n[ºo°]?\s*\d+|s/n|sin\s*n[úu]mero"),
]


def place_kind(name: Column, strict: bool = False) -> Column:
    """Struct (kind, confidence): ALTA for a sure word, MEDIA for a hint (not if ``strict``), the first kind with either; OTROS and NULA without."""
    t = F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", " "))
    out = F.when(t == "", F.struct(F.lit("OTROS").alias("kind"), F.lit("NULA").alias("confidence")))
    for kind, (sure, hint) in PLACE_KINDS.items():
        out = out.when(t.rlike(rf"\b(?:{sure})\b"), F.struct(F.lit(kind).alias("kind"), F.lit("ALTA").alias("confidence")))
        if not strict:
            out = out.when(t.rlike(rf"\b(?:{hint})\b"), F.struct(F.lit(kind).alias("kind"), F.lit("MEDIA").alias("confidence")))
    return out.otherwise(F.struct(F.lit("OTROS").alias("kind"), F.lit("NULA").alias("confidence")))


def kind_stats(rows: DataFrame, name: str) -> DataFrame:
    """(kind, confidence, n): how many names fall in each class."""
    return rows.select(place_kind(F.col(name)).alias("k")).groupBy("k.kind", "k.confidence").agg(F.count("*").alias("n"))


def record_kind(name: Column, kind: Column, table: Column) -> Column:
    """Kind of a document's record by all that is said of it; OTRO if nothing gives it away."""
    t = F.lower(F.concat_ws(" ", name, kind, table))
    out = None
    for label, pattern in RECORD_KINDS.items():
        out = F.when(t.rlike(pattern), label) if out is None else out.when(t.rlike(pattern), label)
    return out.otherwise("OTRO")


def address_kind(address: Column, name: Column) -> Column:
    """How an address has to be searched; unknown if no rule fits."""
    a, n = F.lower(F.coalesce(address, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    seen, out = {"both": F.concat_ws(" ", n, a), "name": n, "address": a}, None
    for label, where, pattern in ADDRESS_KINDS:
        out = F.when(seen[where].rlike(pattern), label) if out is None else out.when(seen[where].rlike(pattern), label)
    return out.otherwise("unknown")


# Labels of finer detectors with their patterns (any case), in order; the last entry of each, without a pattern, is the default.
DETECTORS = {
    "water": [("EDAR", "edar|depuradora"), ("Embalses", "embalse|presa|pantano"), ("Captaciones", "captación|potabilizadora|etap"), ("Desaladoras", "desaladora|desalinizadora"), ("EDAR", None)],
    "energy": [
        ("SUBSTATION", r"subestación|set |s\.e\.t\.|subestacion"), ("TRANSFORMER", "centro de transformación|ct |transformador"), ("GAS_STATION", "gas|erm|gasoducto|reguladora"),
        ("WIND_FARM", "parque eólico|eólico|aerogenerador|^pe "), ("SOLAR_PLANT", "fotovoltaica|solar|huerto solar"), ("BIOMASS_PLANT", "biomasa|cogeneración"), ("POWER_PLANT", "central|generación"), ("SUBSTATION", None),
    ],
    "sports": [
        ("CAMPO_GOLF", "golf"), ("POLIDEPORTIVO", "polideportivo"), ("PABELLON", "pabellón|pabellon"), ("CAMPO_FUTBOL", "fútbol|futbol|estadio municipal"), ("ESTADIO", "^(?!.*municipal).*estadio"), ("PISCINA", "piscina"),
        ("PISTA_RAQUETA", "tenis|pádel|padel"), ("FRONTON", "frontón|fronton"), ("PISTA_ATLETISMO", "atletismo|pista"), ("CENTRO_DEPORTIVO", "centro deportivo|complejo"), ("GENERICO", None),
    ],
    "heritage": [
        ("ARQUITECTURA_RELIGIOSA", "iglesia|ermita|parroquia|convento|monasterio|capilla|catedral|basílica|santuario"), ("ARQUITECTURA_DEFENSIVA", "castillo|fortaleza|alcazaba|torre|muralla|torreón|atalaya|alcázar"),
        ("SITIO_ARQUEOLOGICO", "necrópolis|yacimiento|dolmen|cueva|abrigo|megalit|rupestre|íbero|romano|visigod|árabe"), ("ZONA_ARQUEOLOGICA", "zona arqueológica|área arqueológica|complejo arqueológico"),
        ("CONJUNTO_HISTORICO", "conjunto histórico|casco histórico|centro histórico"), ("ARQUITECTURA_CIVIL", "puente|fuente|lavadero|molino|acueducto|palacio|casa señorial|ayuntamiento histórico"),
        ("PAISAJE_CULTURAL", "paisaje|vega|campiña|sierra"), ("MONUMENTO", "monumento|bien de interés cultural|bic"), ("OTRO", None),
    ],
    "protection": [("BIC", r"\bbic\b|bien de interés cultural|interés cultural"), ("CATALOGO_GENERAL", "catálogo general|catalogación general"), ("INVENTARIO", "inventario|inventariado"), ("DESCONOCIDO", None)],
    "school": [
        ("CEIP", r"c\.e\.i\.p\.|ceip"), ("IES", r"i\.e\.s\.|ies"), ("CPR", r"c\.p\.r\.|cpr"), ("EOI", r"e\.o\.i\.|eoi"), ("CEEE", r"c\.e\.e\.e\.|ceee"), ("CONSERVATORIO", "conservatorio"),
        ("GUARDERIA", "guarderia|guardería"), ("ESCUELA_INFANTIL", "escuela infantil"), ("OTRO", None),
    ],
}
# Words of natural places, of sports grounds, and of radio masts (whole words, any case).
TOPONYM = "paraje|pago|partido|sitio|cerro|loma|colina|alto|cabezo|peñón|cortijo|cortijada|caserío|venta|molino|arroyo|rambla|barranco|fuente|manantial|aljibe|era|eras|ejido|cañada|vereda|cordel|colada|llano|vega|hoya"
SPORTS = "piscina|nataci[oó]n|campo|estadio|f[uú]tbol|polideportivo|pabell[oó]n|pista|cancha|frontón|gimnasio"
TELECOM = "antena|torre|movistar|vodafone|orange|yoigo|masmovil|telecom|telecomunicaci[oó]n|repetidor|bts|estaci[oó]n base"


def detected(name: Column, detector: str) -> Column:
    """Label of one of ``DETECTORS``."""
    t, out = F.lower(F.coalesce(name, F.lit(""))), None
    *rules, (default, _) = DETECTORS[detector]
    for label, pattern in rules:
        out = F.when(t.rlike(pattern), label) if out is None else out.when(t.rlike(pattern), label)
    return out.otherwise(default)


def _holds(text: Column, words: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"(?iu)\b(?:{words})\b")


def looks_natural(text: Column) -> Column:
    return _holds(text, TOPONYM)


def is_sports(kind: Column, name: Column) -> Column:
    return (F.coalesce(kind, F.lit("")) == "DEPORTIVO") | _holds(name, SPORTS)


def is_telecom(name: Column) -> Column:
    return _holds(name, TELECOM)


def keywords(name: Column) -> Column:
    """Words of over two letters that aren't articles or prepositions, as written."""
    # fixed values: words that say nothing
    empty = "el la los las de del a al en y o un una unos unas que por para con sin".split()
    return F.filter(F.split(F.trim(name), r"\s+"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(empty))
