"""Addresses: what kind they are, whether they can be located, their parts, and a quality score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, repair_encoding, strip_accents

# Street words, their short forms, and patterns in the order in which they decide.
STREET_FORMS = [("^c/|^c\\.\\s|^cl\\.?\\s", "Calle "), ("^avda?\\.?\\s|^av\\.?\\s", "Avenida "), ("^pza\\.?\\s|^pl\\.?\\s", "Plaza "), ("^ctra\\.?\\s", "Carretera "), ("^p[ºo]\\.?\\s", "Paseo "), ("^urb\\.?\\s", "Urbanización "), ("^bda\\.?\\s", "Barriada ")]
KIND_RULES = [
    (r"\b(pol\w*\.?\s*ind|poligono)", "INDUSTRIAL"), (r"\b(ctra|carretera|autovia|km\.?)\b", "ROAD"), (r"\b(urb|urbanizacion)\b", "ESTATE"),
    (r"\b(paraje|cortijo|finca|diseminado|camino|partida)\b", "RURAL"), (r"\b(plaza|pza|pl)\b", "SQUARE"), (r"(\bcalle\b|\bc/|\bavenida\b|\bavda?\b|\bpaseo\b)", "STREET"),
]
NOT_PLACES = (
    r"(lugar m[aá]s pr[oó]ximo|donde se (localice|produzca)|\bvarios\b|sin determinar|por determinar|todo el (municipio|t[eé]rmino)|\bitinerante\b|\d{14,20}\w{0,6}$"
    r"|seg[uú]n\s+(la\s+)?emergencia|los\s+disponibles|los\s+asignados|indicar\s+ubicaci[oó]n|pendiente\s+de|\d+,?-\s*cargos?\s+pol[ií]tic|\d+,?-\s*funcionarios?\s+de"
    r"|^consultorio\s+(m[eé]dico|local|auxiliar)(\s+de\s+\w+)?(\s+y\s+(del?\s+)?consultorio[\s\w]*)?$)"
)
NOISE = [r"(?i),?\s*disponible\s+\d+\s*(horas|h)\b\.?", r"(?i),?\s*tel[eé]?f?o?n?o?\.?:?\s*\d[\d\s]{7,}", r"(?i),?\s*\b(bajo|planta baja|local)\b", r"\s*\([^)]*\)"]
_NO_NUMBER = r"(?i)\bs\s*/\s*n\b"


def kind(address: Column) -> Column:
    """Class of an address, by ordered patterns; a number without one of them is a street, no number at all is NAMED."""
    low = strip_accents(F.lower(F.coalesce(address, F.lit(""))))
    rest = F.when(low.rlike(_NO_NUMBER), "UNNUMBERED").when(low.rlike(r"\d"), "STREET").when(F.trim(low) == "", "EMPTY").otherwise("NAMED")
    return F.coalesce(F.nullif(first_match(low, KIND_RULES, ""), F.lit("")), rest)


def can_be_located(address: Column) -> Column:
    low = F.lower(F.coalesce(address, F.lit("")))
    return (F.length(F.trim(low)) >= 4) & ~low.rlike(NOT_PLACES)


def clean(address: Column) -> Column:
    """One form of street words and numbers, without remarks; null if it names no place."""
    out = F.trim(address)
    for pattern in NOISE:
        out = F.regexp_replace(out, pattern, "")
    for short, full in STREET_FORMS:
        out = F.regexp_replace(out, f"(?i){short}", full)
    out = F.regexp_replace(out, r"(?i),?\s*\bn[º°.]?\s*/?\s*(?=\d)", ", ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*,(\s*,)*\s*", ", "), r"\s+", " ")
    out = F.regexp_replace(F.trim(out), r"^[,.\s]+|[,.\s]+$", "")
    return F.when(can_be_located(address), F.nullif(out, F.lit("")))


def parts(address: Column) -> Column:
    """Struct (street, number, postcode, locality) of a cleaned address; what isn't there is null."""
    c = clean(address)
    piece = lambda pattern, i=1: F.nullif(F.trim(F.regexp_extract(c, pattern, i)), F.lit(""))
    return F.struct(piece(r"^([^,\d]+)").alias("street"), piece(r"(?:,|\s)\s*(\d{1,4}[A-Za-z]?)(?=\s*(?:,|$))").alias("number"), piece(r"\b(\d{5})\b").alias("postcode"), piece(r",\s*(?:\d{5}\s+)?([^,\d]+)$").alias("locality"))


def quality(address: Column) -> Column:
    """0 to 100: street 40, number 30, locality 20, postcode 10."""
    p = parts(address)
    return F.coalesce(sum((F.when(p[k].isNotNull(), v).otherwise(0) for k, v in (("street", 40), ("number", 30), ("locality", 20), ("postcode", 10))), F.lit(0)), F.lit(0))


def geocodable(address: Column) -> Column:
    """Quality of 70, or of 50 with a locality."""
    q = quality(address)
    return (q >= 70) | ((q >= 50) & parts(address)["locality"].isNotNull())


# Names of facilities that precede an address, remarks that follow one, and words that stay small in names.
FACILITIES = ["centro de salud", "consultorio", "hospital", "ceip", "ies", "colegio", "policía local", "guardia civil", "bomberos", "protección civil", "ayuntamiento", "polideportivo", "biblioteca", "residencia"]
SMALL = ["de", "del", "la", "las", "los", "el", "y"]
STREETS = r"(?:^|\s)(c/|av[d.]?\.?|calle|avenida|plaza|pza\.?)(?=\s|$)"


def unlocatable(address: Column) -> Column:
    """Why an address can't be located: NO_PLACE, CADASTRAL or SEVERAL, or null.

    Two street words are one address if one of them is an estate, or in ``C/ PLAZA``.
    """
    low = F.lower(address)
    n = F.size(F.regexp_extract_all(low, F.lit(STREETS), F.lit(1)))
    pair = (n == 2) & (low.rlike(r"\bpol[ií]gono\b") | low.rlike(r"\bc/\s*plaza\b"))
    return F.when(low.rlike(r"\b\d{7}[a-z]{2}\d{4}[a-z]\b|\bparcela\s+\d+|\bpol\s*\d+\s*[-–]\s*p\s*\d+"), "CADASTRAL").when(~can_be_located(address), "NO_PLACE").when((n > 1) & ~pair, "SEVERAL")


def capitalised(text: Column) -> Column:
    """Capitals at the start of words, small words small but for the first."""
    words = F.split(text, " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(SMALL), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), " ")


# Words that begin a street's or a place's name, with their short forms; and what follows an address without belonging to it.
PLACE_WORDS = r"(?:c/|c\.\s|cl\.?\s|calle\b|avda?\b\.?|avd\b\.?|av\.|avenida\b|plaza\b|pza\b\.?|pl\.\s|paseo\b|ctra\b\.?|carretera\b|camino\b|cuesta\b|paraje\b|pol[ií]gono\b|autov[ií]a\b|ronda\b|traves[ií]a\b|urb\b\.?|urbanizaci[oó]n\b|bda\b\.?|barriada\b)"
FULL_WORDS = {r"c/\s*|c\.\s|cl\.?\s": "Calle ", r"avda?\b\.?\s*|avd\b\.?\s*|av\.\s*": "Avenida ", r"pza\b\.?\s*|pl\.\s": "Plaza ", r"ctra\b\.?\s*": "Carretera ", r"p[ºo]\.?\s": "Paseo ", r"urb\b\.?\s*": "Urbanización ", r"bda\b\.?\s*": "Barriada ", r"poligono\b": "Polígono", r"autovia\b": "Autovía"}
TRAILERS = [
    r"[,.\s-]*\bdis?ponib.*$", r"[,.\s-]*\bhorario\b.*$", r"[,.\s-]*\b24\s*(?:h|horas)\b.*$", r"[,.\s-]*\b(?:tel[eé]f\w*|tel|tlf|tfno)\b.*$", r"[,\s-]*\b\d{9}\b.*$", r"[,.\s]*\b\d{5}\b", r"\s*\([^)]*\)",
    r",?\s*\bfrente\s[^,]*", r",?\s*\b(planta baja|bajo|local|1ª planta)\b\.?",
]


def _from_street(c: Column) -> Column:
    """Without what stands in front of the street; a single name there that is no facility is the locality and goes to the end."""
    inside = rf"(?is)^(.*?)[,.:–-]\s*(?={PLACE_WORDS})"
    head = F.regexp_extract(c, inside, 1)
    locality = head.rlike(r"^\s*\p{Lu}\p{Ll}+\s*$") & ~head.rlike(rf"(?iu)^\s*(?:{'|'.join(FACILITIES)})\s*$")
    rest = F.regexp_replace(c, inside, "")
    moved = F.when(locality, F.concat(rest, F.lit(", "), F.trim(head))).otherwise(rest)
    other = F.regexp_replace(c, rf"(?i)^(?:{'|'.join(FACILITIES)})\b[^,]*,\s*", "")
    return F.when(c.rlike(rf"(?i)^\s*{PLACE_WORDS}"), c).when(c.rlike(inside), moved).otherwise(other)


def _full_words(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\bc/\s*plaza\b", "Plaza"), r"(?i)^pol[ií]gono\s+(?:c/|calle\b)\s*", "Polígono, Calle ")
    for short, full in FULL_WORDS.items():
        c = F.regexp_replace(c, f"(?i)^(?:{short})", full)
    return F.regexp_replace(c, r"(?i)\bfutbol\b", "Fútbol")


def _numbered(c: Column) -> Column:
    """The number, or that there is none, between commas."""
    steps = [
        (r"(?i)[,.\s]*\bs\s*[/7]\s*n\b\.?[,.\s]*", ", s/n, "), (r"(?i)[,\s]*\bnave\s+(?:n\.?\s*[º°]?\s*)?(\d+)", ", nave $1"), (r"(?i)[,.\s-]*\bn(?:\.?\s*[º°]|[º°.]?\s*/?|úm\.?|úmero)\s*(\d+)", ", $1"),
        (r"\s+-\s+(\d+)", ", $1"), (r"\b(\d{1,3})(?=\p{L}{2})", "$1, "), (r"(?<!(?i)carretera)(?<!nave)(?<=\p{L})[,.]?\s+(\d{1,3})(?=\s*(?:$|[,.])|\s+\p{Lu})", ", $1"), (r"(, \d{1,3})[.\s]+(?=\p{L})", "$1, "),
        (r",\s*de\s+(?=\p{Lu}[^,]*$)", ", "),
    ]
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def _street_case(text: Column) -> Column:
    """Capitals at the start of words; prepositions small, articles small behind one; what stands for a number small."""
    words = F.split(text, " ")

    def one(w: Column, i: Column) -> Column:
        low, before = F.lower(w), F.lower(F.get(words, i - 1))
        small = low.isin("de", "del", "y") | low.isin("la", "las", "los", "el") & before.isin("de", "y", "a", "en") | low.rlike("^(s/n|nave),?$")
        return F.when((i > 0) & small, low).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))

    return F.array_join(F.transform(words, one), " ")


def street(address: Column) -> Column:
    """Struct (street, reason, stages): encoding, facility in front, remarks behind, street words, number, punctuation, capitals.

    ``street`` is null with a ``reason``; ``stages`` names the stages that changed the text.
    """

    def without_remarks(c: Column) -> Column:
        for pattern in TRAILERS:
            c = F.regexp_replace(c, f"(?i){pattern}", "")
        return c

    tidy = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*,(\s*,)*\s*", ", "), r"\s+", " ")), r"^[,.;:\s-]+|[,.;:\s-]+$", "")
    plan = [("encoding", repair_encoding), ("facility", _from_street), ("remarks", without_remarks), ("words", _full_words), ("number", _numbered), ("punctuation", tidy), ("capitals", _street_case)]
    # each stage is evaluated once and handed on: nested, the texts would multiply with every use
    state = F.array(F.struct(F.trim(address).alias("t"), F.lit("").alias("s")))
    for name, step in plan:
        state = F.transform(state, (lambda n, f: lambda e: _stage(e, n, f))(name, step))
    end = F.get(state, 0)
    reason = unlocatable(address)
    done = F.when(reason.isNull(), F.nullif(end["t"], F.lit("")))
    return F.when(address.isNotNull(), F.struct(done.alias("street"), reason.alias("reason"), F.filter(F.split(end["s"], " "), lambda s: s != "").alias("stages")))


def _stage(state: Column, name: str, step) -> Column:
    both = F.transform(F.array(step(state["t"])), lambda new: F.struct(new.alias("t"), F.when(new != state["t"], F.concat(state["s"], F.lit(f" {name}"))).otherwise(state["s"]).alias("s")))
    return F.get(both, 0)
