"""Text repair and similarity, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms.
_MARKED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"


def strip_accents(text: Column) -> Column:
    return F.translate(text, _MARKED, _PLAIN)


def normalise(text: Column) -> Column:
    """Lower case, no marks, words of letters and digits joined by one space."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(text)), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normalise(text), " ")), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of the word sets; 0 for two empty ones."""
    both = F.size(F.array_union(words(a), words(b)))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / both)


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: equal 100; containment 70 and 30 by length; else 60 from a half of the words on, else 50 by the share."""
    x, y, j = normalise(a), normalise(b), jaccard(a, b)
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    inside = (short > 0) & (x.contains(y) | y.contains(x))
    return F.when(x == y, 100.0).when(inside, 70 + 30 * short / long).when(j >= 0.5, 60.0).otherwise(50 * j)


def fuzzy_hit(needle: Column, hay: Column) -> Column:
    """Whether every word of ``needle`` stands in ``hay`` with one error at most: in the order of the words, each at the start, the end or inside of one."""
    near = lambda w, o: o.contains(w) | (F.length(w) >= 3) & (F.levenshtein(w, F.substring(o, F.lit(1), F.length(w))) <= 1) | (F.length(w) >= 3) & (F.levenshtein(w, o) <= 1)
    theirs = F.filter(F.split(hay, " "), lambda o: o != "")
    return F.forall(F.filter(F.split(needle, " "), lambda w: w != ""), lambda w: F.exists(theirs, lambda o: near(w, o)))


def graded_similarity(a: Column, b: Column) -> Column:
    """0 to 100: nothing for an empty text; equal 100; containment 70 and 30 by length; 85 to 100 from four fifths of the words in common on, 60 to 85 from three
    fifths on; 60 for a fuzzy hit; else half the share. Words have two letters at least. Rounded.
    """
    x, y = normalise(a), normalise(b)
    long_words = lambda t: F.filter(F.array_distinct(F.split(t, " ")), lambda w: F.length(w) > 1)
    both, either = F.size(F.array_intersect(long_words(x), long_words(y))), F.size(F.array_union(long_words(x), long_words(y)))
    j = F.when(either == 0, 1.0).otherwise(both / either)
    round_ = lambda v: F.floor(v + 0.5)
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    score = (
        F.when(x == y, F.lit(100)).when(x.contains(y) | y.contains(x), round_(70 + 30 * short / long))
        .when(j >= 0.8, round_(85 + (j - 0.8) * 75)).when(j >= 0.6, round_(60 + (j - 0.6) * 125))
        .when(fuzzy_hit(x, y), F.lit(60)).otherwise(round_(j * 50))
    )
    return F.when(F.coalesce(F.length(a), F.lit(0)) * F.coalesce(F.length(b), F.lit(0)) == 0, F.lit(0)).otherwise(score).cast("long")


def match_score(wanted: Column, name: Column) -> Column:
    """100 equal, 90 the name starts with the request or the other way round, 80 to 90 containment by length, else the edit similarity in hundredths. Normalised."""
    x, y = normalise(wanted), normalise(name)
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 100.0).when(y.startswith(x) | x.startswith(y), 90.0).when(y.contains(x) | x.contains(y), 80 + 10 * short / long).otherwise(F.greatest(F.lit(0.0), 100 * edit_similarity(x, y)))


def same_place_name(a: Column, b: Column) -> Column:
    """Names of one municipality: equal, one inside the other, or an edit similarity over 0.8. Normalised; an empty one equals nothing."""
    x, y = normalise(a), normalise(b)
    return (F.length(x) > 0) & (F.length(y) > 0) & ((x == y) | x.contains(y) | y.contains(x) | (edit_similarity(x, y) > 0.8))


def file_key(text: Column) -> Column:
    """Lower case without marks; underscores and hyphens are spaces; other signs go."""
    t = F.regexp_replace(F.lower(F.trim(text)), "[_-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(t), r"[^a-z0-9\s]", ""), r"\s+", " "))


def name_variants(text: Column) -> Column:
    """Array of other ways to name a place: without its article, the first word of several (four letters at least), without prepositions."""
    t = file_key(text)
    bare, first = F.trim(F.regexp_replace(t, r"^(el|la|los|las)\s+", "")), F.substring_index(t, " ", 1)
    short = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+(de\s+la|del|de)(?=\s)", " "), r"\s+", " "))
    return F.array_compact(F.array(F.when(bare != t, bare), F.when(t.contains(" ") & (F.length(first) >= 4), first), F.when(short != t, short)))


def edit_similarity(a: Column, b: Column) -> Column:
    long = F.greatest(F.length(a), F.length(b))
    return F.when(long == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / long)


def repair_encoding(text: Column) -> Column:
    """Undoes UTF-8 that was read as Latin-1, pair by pair: what is sound around a broken letter stays."""
    pieces = F.regexp_extract_all(text, F.lit("((?:[ÃÂ][\u0080-¿])+|[^ÃÂ]+|[ÃÂ])"))
    whole = lambda p: F.when(p.rlike("^[ÃÂ][\u0080-¿]"), F.decode(F.encode(p, "ISO-8859-1"), "UTF-8")).otherwise(p)
    return F.when(text.rlike("[ÃÂ][\u0080-¿]"), F.array_join(F.transform(pieces, whole), "")).otherwise(text)


# Signs that UTF-8 leaves when it is read as Windows-1252, the longest first, and letters with a mark that follows them.
MISREAD = {"â‚¬": "€", "â€™": "’", "â€˜": "‘", "â€œ": "“", "â€\u009d": "”", "â€“": "–", "â€”": "—", "â€¦": "…", "â€¢": "•", "Ã‰": "É", "Ã“": "Ó", "Ãš": "Ú", "Ã‘": "Ñ", "Ãœ": "Ü", "Ã€": "À", "Ã‡": "Ç", "Â ": " "}
_LETTERS, _MARKS = "aeiouAEIOUnN", {"\u0301": "áéíóúÁÉÍÓÚńŃ", "\u0300": "àèìòùÀÈÌÒÙǹǸ", "\u0308": "äëïöüÄËÏÖÜn̈N̈", "\u0303": "ãẽĩõũÃẼĨÕŨñÑ"}


def composed(text: Column) -> Column:
    """Letters with a combining acute, grave, diaeresis or tilde behind them as one sign each."""
    for mark, whole in _MARKS.items():
        for letter, sign in zip(_LETTERS, whole, strict=False):
            if (mark != "\u0308" or letter not in "nN") and (mark == "\u0303") >= (letter in "nN"):
                text = F.replace(text, F.lit(letter + mark), F.lit(sign))
    return text


def repaired(text: Column) -> Column:
    """Struct (text, tiers): what broken encoding did undone, in tiers, and the names of those that changed it; sound text stays.

    double: UTF-8 that was misread twice; signs: what Windows-1252 leaves, the longest first; pairs: UTF-8 that was read as Latin-1; marks: letters and their
    marks joined. Null stays null.
    """
    from .once import let

    def signs(t: Column) -> Column:
        for bad, good in MISREAD.items():
            t = F.replace(t, F.lit(bad), F.lit(good))
        return t

    twice = lambda t: F.when(t.rlike("Ã[\u0082\u0083][Â]?"), repair_encoding(t)).otherwise(t)
    plan = [("double", twice), ("signs", lambda t: F.when(t.rlike("[âÃÂ]"), signs(t)).otherwise(t)), ("pairs", repair_encoding), ("marks", lambda t: F.when(t.rlike("[\u0300-\u0308]"), composed(t)).otherwise(t))]
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("tiers"))

    def after(name: str, step):
        changed = lambda s: lambda new: F.struct(new.alias("text"), F.when(new != s["text"], F.concat(s["tiers"], F.array(F.lit(name)))).otherwise(s["tiers"]).alias("tiers"))
        return lambda s: let(step(s["text"]), changed(s))

    for name, step in plan:
        state = let(state, after(name, step))
    return F.when(text.isNotNull(), state)


def split_camel(text: Column) -> Column:
    """A space between a lower and an upper letter and between letters and digits."""
    t = F.regexp_replace(text, "([a-záéíóúñ])([A-ZÁÉÍÓÚÑ])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(t, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def delimiter(line: Column) -> Column:
    """Of tab, comma, semicolon, bar and space the one that cuts most often; the first of equals; comma if none cuts."""
    marks = ["\t", ",", ";", "|", " "]
    cut = [F.length(line) - F.length(F.replace(line, F.lit(m), F.lit(""))) for m in marks]
    best = F.greatest(*cut)
    out = F.when(best == 0, ",")
    for m, n in zip(marks, cut, strict=True):
        out = out.when(n == best, m)
    return out


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule (pattern, label) that a text matches, in order."""
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(default)
