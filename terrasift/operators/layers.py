"""Feature layers as sources of places: which layers a request is looked up in, in which order, and from which confidence an answer is taken.

A source is data, not code: words of a request's name that call for layers, the layers that are tried anyway, and a floor. A lookup is one join of requests, spread
over their layers, with the features of the same municipality, one top answer a layer, and the first layer whose answer reaches the floor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as T


@dataclass(frozen=True)
class Source:
    """``words``: (pattern, layer) whose layers come first; ``always``: layers before all; ``others``: layers tried after, or only where no word fits if ``instead``.

    ``last``: a request for which no layer's answer reaches the floor gets that of its last layer that has one.
    """

    floor: float
    words: list[tuple[str, str]] = field(default_factory=list)
    always: list[str] = field(default_factory=list)
    others: list[str] = field(default_factory=list)
    instead: bool = False
    last: bool = False


# Layers by source, the words that call for them, and the confidence from which an answer counts.
SOURCES = {
    "health": Source(70, [("hospital|clínica", "hospital"), ("consultorio|ambulatorio", "consultorio")], ["centro_salud"], last=True),
    "education": Source(70, others=["centros_docentes"]),
    "cultural": Source(70, [("museo", "museo"), ("biblioteca", "biblioteca"), ("teatro|auditorio", "teatro"), ("castillo|monumento|iglesia|ermita", "monumento")], others=["museo", "biblioteca", "monumento"], instead=True),
    "security": Source(
        70, [("comisaría|policía nacional", "comisarias"), ("guardia civil|cuartel", "cuarteles_gc"), ("bombero|parque|extinción", "parque_bomberos"), ("policía local|municipal", "policia_local")],
        others=["comisarias", "cuarteles_gc", "parque_bomberos"], instead=True,
    ),
    "water": Source(70, [("edar|depuradora", "EDAR"), ("embalse|presa|pantano", "Embalses"), ("captación|potabilizadora|etap", "Captaciones"), ("desaladora|desalinizadora", "Desaladoras")], others=["EDAR", "Embalses", "Captaciones", "Desaladoras"], last=True),
    "energy": Source(
        70, [(r"subestación|set |s\.e\.t\.|subestacion", "subestaciones_electricas"), ("centro de transformación|ct |transformador", "centros_transformacion"), ("gas|erm|gasoducto|reguladora", "infraestructura_gas"), ("eólico|aerogenerador|^pe ", "parques_eolicos"), ("fotovoltaica|solar", "plantas_fotovoltaicas"), ("central|generación", "centrales_generacion")],
        others=["subestaciones_electricas", "parques_eolicos", "plantas_fotovoltaicas", "centrales_generacion", "infraestructura_gas"], last=True,
    ),
    "sports": Source(65, [("golf", "campo_golf")], others=["equipamiento_deportivo"]),
    "sports_census": Source(
        65, [("piscina|nataci[oó]n|vaso|acuático", "piscina"), (r"f[uú]tbol|campo|estadio(?!\s+de\s+atletismo)|césped", "campo_futbol"), ("polideportivo|pabell[oó]n|complejo deportivo|centro deportivo", "centro_deportivo"), ("p[aá]del", "padel"), ("tenis|tennis", "tenis"), ("front[oó]n|pelota", "fronton"), ("atletismo|pista|tartán", "atletismo"), ("gimnasio|gym|fitness", "gimnasio")],
        others=["*"], last=True,
    ),
    "toponyms": Source(
        60, [("paraje|pago|partido|sitio", "paraje"), ("cerro|loma|colina|alto|cabezo|peñón|risco", "cerro"), ("cortijo|cortijada|caserío|casa|venta|molino", "cortijo"), ("fuente|manantial|nacimiento|aljibe", "fuente"), ("era|eras|ejido", "era"), ("cañada|vereda|cordel|colada", "cañada"), ("barranco|barranquillo|cárcava", "barranco"), ("llano|llanura|vega|hoya", "llano"), ("arroyo|rambla|río|regato|caz", "arroyo")],
        others=["*"], last=True,
    ),
    "streets": Source(60, others=["callejero"], last=True),
}
#: Sources whose words must stand alone and of which the first that fits decides alone.
_ONE_WORD = ("sports_census", "toponyms", "water", "energy")


def layers_of(name: Column, source: str) -> Column:
    """The layers that a request's name is looked up in, in order; "*" stands for all of a source's."""
    s, t = SOURCES[source], F.lower(F.coalesce(name, F.lit("")))
    whole = source in ("sports_census", "toponyms")
    called = F.array_compact(F.array(*(F.when(t.rlike(rf"(?u)\b(?:{p})\b" if whole else p), F.lit(layer)) for p, layer in s.words))) if s.words else F.array().cast("array<string>")
    if source in _ONE_WORD:
        called = F.slice(called, 1, 1)
    always, others = (F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (s.always, s.others))
    return F.array_distinct(F.concat(always, called, F.when(F.size(called) > 0, F.array().cast("array<string>")).otherwise(others) if s.instead else others))


def located(requests: DataFrame, features: DataFrame, source: str, key: str = "id", on: str = "mun") -> DataFrame:
    """(key, layer, fid, x, y, confidence, accepted) of requests (key, mun, name) from features (layer, mun, fid, fname, x, y).

    Features outside the region don't count; of a layer the best name counts, ties go to the smaller fid. ``streets``: a portal's number that equals the
    feature's adds ten, up to 98.
    """
    s = SOURCES[source]
    wanted = requests.select(key, on, "name", F.posexplode(layers_of(F.col("name"), source)).alias("rank", "layer"))
    inside = features.where(F.col("x").between(100_000, 800_000) & F.col("y").between(4_000_000, 4_300_000)).withColumnRenamed("layer", "of")
    score = T.graded_similarity(F.col("name"), F.col("fname"))
    if source == "streets":
        number = lambda c: F.nullif(F.regexp_extract(c, r"(\d+)\s*$", 1), F.lit(""))
        score = T.graded_similarity(F.regexp_replace(F.col("name"), r",?\s*\d+\s*$", ""), F.regexp_replace(F.col("fname"), r",?\s*\d+\s*$", ""))
        score = F.when(number(F.col("name")) == number(F.col("fname")), F.least(F.lit(98), score + 10)).otherwise(score)
    joined = wanted.join(inside, on).where((F.col("layer") == "*") | (F.col("layer") == F.col("of"))).withColumn("confidence", score)
    best = joined.where("confidence > 0").groupBy(key, "rank").agg(F.min(F.struct(-F.col("confidence"), "fid", "of", "x", "y")).alias("b"))
    best = best.select(key, "rank", F.col("b.of").alias("layer"), "b.fid", "b.x", "b.y", (-F.col("b.col1")).alias("confidence"))
    good = F.col("confidence") >= s.floor
    pick = F.min(F.when(good, F.struct("rank", "layer", "fid", "x", "y", "confidence")))
    last = F.max(F.struct("rank", "layer", "fid", "x", "y", "confidence"))
    out = best.groupBy(key).agg(F.coalesce(pick, last).alias("b") if s.last else pick.alias("b")).where("b is not null")
    return out.select(key, "b.layer", "b.fid", "b.x", "b.y", F.col("b.confidence").cast("long").alias("confidence"), (F.col("b.confidence") >= s.floor).alias("accepted"))


# Kinds of places and the source that knows them.
SOURCE_OF_KIND = {
    "SANITARIO": "health", "EDUCATIVO": "education", "CULTURAL": "cultural", "RELIGIOSO": "cultural", "POLICIAL": "security", "BOMBEROS": "security", "HIDRAULICO": "water", "ENERGIA": "energy", "DEPORTIVO": "sports",
}


def dispatched(requests: DataFrame, features: DataFrame, key: str = "id", on: str = "mun") -> DataFrame:
    """Answers of each request's own source, by the kind that its name tells; columns of ``located`` and ``source``."""
    kinds = F.create_map(*(F.lit(v) for kv in SOURCE_OF_KIND.items() for v in kv))
    known = requests.withColumn("source", kinds[classify.place_kind(F.col("name"))["kind"]])
    parts = [located(known.where(F.col("source") == s), features, s, key, on).withColumn("source", F.lit(s)) for s in sorted(set(SOURCE_OF_KIND.values()))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
