"""Names of facilities in one form."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The full form of a name and its short or unmarked ones.
FORMS = {
    "Centro de Salud": ["c.s.", "c.s", "cs", "cs.", "centro salud"], "Consultorio": ["consultorio", "cons."], "Consultorio Local": ["consultorio local", "cons. local"], "Hospital": ["hosp.", "hosp", "h."], "Hospital Comarcal": ["h. comarcal"],
    "Hospital Regional": ["h. regional"], "Hospital General": ["h. general"], "Colegio Público": ["c.p.", "c.p", "cp", "cp.", "colegio publico"], "CEIP": ["ceip", "c.e.i.p.", "c.e.i.p"], "Colegio": ["col.", "col"], "IES": ["i.e.s.", "i.e.s", "ies"],
    "Instituto": ["instituto", "inst."], "Escuela Infantil": ["e.i.", "e.i", "ei"], "Guardería": ["guarderia", "guardería"], "Comisaría": ["comisaria", "comisaría", "com."], "Policía Local": ["policia local", "policía local", "pol. local", "pol.local", "p.l.", "p.l", "pl"],
    "Guardia Civil": ["g.c.", "g.c", "gc", "guardia civil"], "Cuartel Guardia Civil": ["cuartel gc", "cuartel g.c."], "Casa Cuartel": ["casa cuartel"], "Parque de Bomberos": ["parque bomberos", "parque de bomberos", "p. bomberos", "p.bomberos"],
    "Ayuntamiento": ["ayto.", "ayto", "ayunt.", "ayunt", "ayuntamiento"], "Casa Consistorial": ["casa consistorial"], "Pabellón": ["pabellon", "pabellón", "pab."], "Polideportivo": ["polideportivo", "polidep."], "Piscina Municipal": ["piscina municipal", "pisc. mpal."],
    "Campo de Fútbol": ["campo futbol", "campo de futbol", "campo de fútbol"], "Iglesia": ["igl.", "iglesia"], "Ermita": ["ermita"], "Biblioteca": ["biblioteca", "bibl.", "bib."], "Casa de la Cultura": ["casa cultura", "casa de cultura", "c. cultura"],
    "Depósito": ["dep.", "deposito", "depósito"], "ETAP": ["etap", "e.t.a.p."], "EDAR": ["edar", "e.d.a.r."], "Depuradora": ["depuradora"], "Centro de Transformación": ["c.t.", "ct"], "Subestación": ["subestacion", "subestación"], "Subestación Eléctrica": ["s.e."],
    "Parque Eólico": ["parque eolico", "parque eólico"],
}
_OF = {short: full for full, shorts in FORMS.items() for short in shorts}
_ANY = "|".join(re.escape(x) for x in sorted(_OF, key=lambda x: (-len(x), x)))


def full_names(text: Column) -> Column:
    """The text with every short form that stands as a word of its own written out, the longest first; spaces joined; null is empty.

    The text is read once, piece by piece: a form or a single sign.
    """
    lookup = F.create_map(*(F.lit(v) for kv in _OF.items() for v in kv))
    pieces = F.regexp_extract_all(F.trim(F.coalesce(text, F.lit(""))), F.lit(rf"(?is)(\b(?:{_ANY})\b|.)"))
    return F.trim(F.regexp_replace(F.array_join(F.transform(pieces, lambda p: F.coalesce(lookup[F.lower(p)], p)), ""), r"\s+", " "))


# How the municipality stands in the name of a file, in order; and towns by which a province is known, in order.
FILE_NAMES = [r"PTEL[_\-\s]+([A-ZÁÉÍÓÚÑa-záéíóúñ\s]+?)[_\-\s]+\d{4}", r"Ficha[_\-\s]+PTEL[_\-\s]+([A-ZÁÉÍÓÚÑa-záéíóúñ\s]+)", r"Plan[_\-\s]+Emergencia[_\-\s]+([A-ZÁÉÍÓÚÑa-záéíóúñ\s]+)", r"^([A-ZÁÉÍÓÚÑa-záéíóúñ\s]+?)[_\-\s]+PTEL", r"^([A-ZÁÉÍÓÚÑa-záéíóúñ\s]{3,30})$"]
PROVINCE_TOWNS = {
    "Granada": ["colomera", "granada", "motril", "baza", "guadix", "loja", "almuñécar", "quéntar", "quentar", "castril"], "Almería": ["almería", "almeria", "roquetas", "ejido", "níjar", "berja", "adra", "garrucha", "tijola"],
    "Jaén": ["jaén", "jaen", "linares", "úbeda", "baeza", "andújar", "hornos"], "Málaga": ["málaga", "malaga", "marbella", "fuengirola", "torremolinos", "ronda"], "Sevilla": ["sevilla", "dos hermanas", "alcalá", "utrera", "écija"],
    "Córdoba": ["córdoba", "cordoba", "lucena", "puente genil", "montilla"], "Cádiz": ["cádiz", "cadiz", "jerez", "algeciras", "san fernando"], "Huelva": ["huelva", "lepe", "almonte", "moguer", "ayamonte"],
}
DEFAULT_PROVINCE = "Granada"


def town_of_file(path: Column) -> Column:
    """The part of a file's name that should name a municipality; null if no pattern fits."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]+$", "")
    out = None
    for pattern in FILE_NAMES:
        found = F.trim(F.regexp_extract(base, "(?i)" + pattern, 1))
        out = F.when(found != "", found) if out is None else out.when(found != "", found)
    return out


def province_of_town(town: Column) -> Column:
    """Province of the first known town that a name holds; Granada without one."""
    t, out = F.lower(F.coalesce(town, F.lit(""))), None
    for province, towns in PROVINCE_TOWNS.items():
        hit = t.rlike("|".join(towns))
        out = F.when(hit, province) if out is None else out.when(hit, province)
    return out.otherwise(DEFAULT_PROVINCE)
