"""Candidate places of a request: scores, scopes, and the cascade of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def plain(c: Column) -> Column:
    return T.strip_accents(F.lower(F.trim(c)))


def name_score(wanted: Column, name: Column) -> Column:
    """100 equal, 80 the name holds the request, 60 the request holds the name, else 40 times the share of its words found."""
    a, b = plain(wanted), plain(name)
    theirs = F.split(b, r"\s+")
    shared = F.filter(F.split(a, r"\s+"), lambda w: F.exists(theirs, lambda o: o.contains(w) | w.contains(o)))
    return F.when(a == b, 100.0).when(b.contains(a), 80.0).when(a.contains(b), 60.0).otherwise(F.size(shared) * 40.0 / F.size(F.split(a, r"\s+")))


def best_by_group(
    requests: DataFrame, features: DataFrame, on: list[str], key: str, feature_key: str, asked: str, given: str, score: Callable[[Column, Column], Column], limit: int, meet: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """The ``limit`` features a request with the highest ``score(asked, given)`` among those equal in ``on``, ties to the smaller feature key; columns ``score``, ``rank``.

    The score depends on a request's ``asked`` and a feature's ``given`` alone. So it is computed once for each two different values that meet, of a value's
    features only the first ``limit`` can be among the best, and requests take what was found for their value. No request is compared with every feature.
    ``meet`` (different values asked, features by value, ``on``, ``given``, ``limit``) gives the pairs to score where not all can be among the best.
    """
    fields = [c for c in features.columns if c not in on]
    first = W.partitionBy(*on, given).orderBy(feature_key)
    groups = features.withColumn("__i", F.row_number().over(first)).where(F.col("__i") <= limit).groupBy(*on, given)
    groups = groups.agg(F.min(feature_key).alias("__first"), F.collect_list(F.struct(*fields)).alias("__all"))  # `limit` at most
    values = requests.select(*on, F.col(asked).alias("__asked")).distinct()
    pairs = (meet(values, groups, on, given, limit) if meet else values.join(groups, on)).withColumn("score", score(F.col("__asked"), F.col(given)))
    each = W.partitionBy(*on, "__asked")
    pairs = pairs.withColumn("__r", F.row_number().over(each.orderBy(F.desc("score"), "__first"))).where(F.col("__r") <= limit)
    best = pairs.select(*on, "__asked", "score", F.explode("__all").alias("__f")).select(*on, "__asked", "score", "__f.*")
    best = best.withColumn("__r", F.row_number().over(each.orderBy(F.desc("score"), feature_key))).where(F.col("__r") <= limit).drop("__r")
    best = best.withColumnsRenamed({c: f"__on{i}" for i, c in enumerate(on)})
    same = F.col(asked).eqNullSafe(F.col("__asked"))
    for i, c in enumerate(on):
        same = same & (F.col(c) == F.col(f"__on{i}"))
    out = requests.join(best, same).drop("__asked", *(f"__on{i}" for i in range(len(on))))
    return out.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), feature_key))).where(F.col("rank") <= limit)


def best_names(requests: DataFrame, features: DataFrame, on: list[str], key: str, feature_key: str, limit: int = 10) -> DataFrame:
    """The ``limit`` features a request (key, name) with the highest name score among those equal in ``on`` (feature column ``fname``)."""
    return best_by_group(requests, features, on, key, feature_key, "name", "fname", name_score, limit)


def low(c: Column) -> Column:
    """Lower case letter by letter: İ gives one letter, and a sigma at a word's end none of its own."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def holder_score(wanted: Column, name: Column) -> Column:
    """100 equal, 80 the name holds the request, else 0; in lower case."""
    a, b = low(wanted), low(name)
    return F.when(a == b, 100.0).when(b.contains(a), 80.0).otherwise(0.0)


def holders(asked: DataFrame, groups: DataFrame, on: list[str], given: str, limit: int) -> DataFrame:
    """Of all pairs of names in ``asked`` and ``groups`` those that can be among a request's ``limit`` best by ``holder_score``.

    Equal names score the same, those that hold the request too, and all others too: the first ``limit`` of each are enough. A request is looked up among
    the parts of the names that are as long as some request, so that names are never compared all with all.
    """
    b, n = low(F.col(given)), F.col("__n")
    wanted = asked.withColumn("__part", low(F.col("__asked")))
    starts = F.sequence(F.lit(1), F.length(b) - n + 1)
    parts = groups.join(wanted.where("__part is not null").select(*on, F.length("__part").alias("__n")).distinct(), on).where(n <= F.length(b))
    parts = parts.withColumn("__part", F.explode(F.array_distinct(F.transform(starts, lambda i: b.substr(i, n))))).join(wanted, [*on, "__part"], "left_semi")
    first = F.row_number().over(W.partitionBy(*on, "__part", n == F.length(b)).orderBy("__first"))
    parts = parts.withColumn("__i", first).where(F.col("__i") <= limit)
    rest = groups.withColumn("__i", F.row_number().over(W.partitionBy(*on).orderBy("__first"))).where(F.col("__i") <= limit)
    fields = [*on, "__asked", given, "__first", "__all"]
    return wanted.join(parts, [*on, "__part"]).select(fields).union(asked.join(rest, on).select(fields)).dropDuplicates([*on, "__asked", given])


def best_holders(requests: DataFrame, features: DataFrame, on: list[str], key: str, feature_key: str, limit: int = 10) -> DataFrame:
    """The ``limit`` features a request (key, name) with the highest holder score among those equal in ``on`` (feature column ``fname``)."""
    return best_by_group(requests, features, on, key, feature_key, "name", "fname", holder_score, limit, holders)


def scoped(by_code: DataFrame, by_name: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """Candidates from the narrowest scope that has any for a request, with column ``scope``: code, then name, then all."""
    parts = [d.withColumn("scope", F.lit(i)) for i, d in enumerate((by_code, by_name, every))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    least = both.groupBy(key).agg(F.min("scope").alias("scope"))
    return both.join(least, [key, "scope"])


def cascade(candidates: DataFrame, key: str, floors: dict[int, float], override: tuple[int, int] | None = (0, 1)) -> DataFrame:
    """(key, level, confidence) of the first level whose candidate reaches its floor.

    ``override`` (a, b): b takes a's place if its confidence is higher. One aggregation: levels are sources, a handful
    a request, and of each level the best candidate counts.
    """
    floor = F.create_map(*(F.lit(v) for kv in floors.items() for v in kv))[F.col("level")]
    ok = candidates.where(F.col("confidence") >= floor).groupBy(key, "level").agg(F.max("confidence").alias("confidence"))
    best = F.min_by(F.struct("level", "confidence"), F.col("level"))
    if override is None:
        return ok.groupBy(key).agg(best.alias("b")).select(key, "b.level", "b.confidence")
    a, b = override
    second = F.max(F.when(F.col("level") == b, F.struct("level", "confidence")))
    both = ok.groupBy(key).agg(best.alias("b"), second.alias("s"))
    better = (F.col("b.level") == a) & (F.col("s.confidence") > F.col("b.confidence"))
    return both.withColumn("c", F.when(better, F.col("s")).otherwise(F.col("b"))).select(key, "c.level", "c.confidence")


def known_name(requests: DataFrame, catalogue: DataFrame, key: str, name: str, code: str, label: str) -> DataFrame:
    """(key, code, how): EXACT by normalised name; else CONTAINED, the first catalogue row by code that shares a name's
    whole words with the request; else null.

    Containment meets on the catalogue name's first word, so it is an equi-join and not a comparison with every row.
    """
    r = requests.withColumn("__n", T.normalise(F.col(name)))
    c = catalogue.select(F.col(code).alias("code"), T.normalise(F.col(label)).alias("__c")).where("__c <> ''")
    exact = r.join(c.groupBy("__c").agg(F.min("code").alias("code")), F.col("__n") == F.col("__c"), "left")
    done = exact.where("code is not null").select(key, "code", F.lit("EXACT").alias("how"))
    rest = exact.where("code is null").select(key, "__n")
    words = rest.select(key, "__n", F.explode(F.array_distinct(F.split("__n", " "))).alias("__w"))
    inside = words.join(c.withColumn("__w", F.substring_index("__c", " ", 1)), "__w").where(F.concat(F.lit(" "), "__n", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("__c"), F.lit(" "))))
    found = inside.groupBy(key).agg(F.min("code").alias("code"))
    return done.unionByName(rest.join(found, key, "left").select(key, "code", F.when(F.col("code").isNotNull(), "CONTAINED").alias("how")))


def three_checks(inside: Column, near: Column, agreed: Column) -> Column:
    """Confidence of a place by how many of three checks hold: 20, 50, 80 or 95."""
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (inside, near, agreed)), F.lit(0))
    return F.element_at(F.array(F.lit(20), F.lit(50), F.lit(80), F.lit(95)), n + 1)


def verdict(confidence: Column) -> Column:
    return F.when(confidence >= 95, "CONFIRMADA").when(confidence >= 85, "ALTA").when(confidence >= 65, "MEDIA").when(confidence >= 40, "BAJA").when(confidence >= 20, "MUY_BAJA").otherwise("INVALIDA")


def spatial_cascade(x: Column, y: Column, centre_x: Column, centre_y: Column, inside: Column, edge: Column, neighbour: Column, tolerance: float = 100.0) -> Column:
    """Struct (level, state, trace): region and centroid range, polygon, tolerance around it, neighbours; stops at the first that decides.

    ``trace`` lists (level, passed) of the levels that were reached.
    """
    in_range = F.coalesce(x.between(100_000, 650_000) & y.between(3_950_000, 4_350_000) & (F.hypot(x - centre_x, y - centre_y) <= 50_000), F.lit(False))
    yes = [in_range, F.coalesce(inside, F.lit(False)), F.coalesce(edge <= tolerance, F.lit(False)), neighbour.isNotNull()]
    level = F.when(~yes[0], 1).when(yes[1], 2).when(yes[2], 3).otherwise(4)
    state = F.when(~yes[0], "OUT_OF_RANGE").when(yes[1], "INSIDE").when(yes[2], "AT_BORDER").when(yes[3], "NEIGHBOUR").otherwise("OUTSIDE")
    steps = F.array(*(F.struct(F.lit(i).alias("level"), p.alias("passed")) for i, p in enumerate(yes, 1)))
    return F.struct(level.alias("level"), state.alias("state"), F.slice(steps, F.lit(1), level).alias("trace"))


def predicate(name: str, contains: str | None = None, box: tuple[float, float, float, float] | None = None) -> Column:
    """Filter of a feature layer: a name that contains a text in any case (its % and _ taken literally), and a box (min_x, min_y, max_x, max_y).

    Both are plain comparisons, so that the box reaches a Parquet scan.
    """
    out = F.lit(True)
    if contains:
        safe = contains.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        out = out & F.col(name).ilike(f"%{safe}%")
    if box is not None:
        out = out & F.col("x").between(float(box[0]), float(box[2])) & F.col("y").between(float(box[1]), float(box[3]))
    return out


def best_match(requests: DataFrame, layer: DataFrame, on: list[str], key: str, feature_key: str, floor: float, only: int = 0) -> DataFrame:
    """The feature of a layer with the highest name similarity (0 to 100) of at least ``floor``; columns ``score``, ``how``.

    Sources differ in what they give without one: with ``only`` = n, the first feature where there are at most n in all
    (ONLY), else nothing. Ties go to the smaller feature key. Requests without an answer have no row.

    Each two different normalised names of equal ``on`` are compared once, and only those that can reach the floor.
    """
    fields = [c for c in layer.columns if c not in on]
    r, f = requests.select(key, *on, "name", T.normalise(F.col("name")).alias("__x")), layer.withColumn("__y", T.normalise(F.col("fname")))
    x = r.select(*on, "__x").where("__x is not null").distinct()
    y = f.where("__y is not null").groupBy(*on, "__y").agg(F.min_by(F.struct(*fields), feature_key).alias("__f"))
    pairs = x.join(y.select(*on, "__y"), on) if floor <= 0 else _alike(x, y.select(*on, "__y"), on, floor)
    pairs = pairs.withColumn("score", T.similarity(F.col("__x"), F.col("__y"))).where(F.col("score") >= floor).join(y, [*on, "__y"])
    order = F.struct((-F.col("score")).alias("s"), F.col(f"__f.{feature_key}").alias("k"))
    best = pairs.groupBy(*on, "__x").agg(F.min(order).alias("__o"), F.min_by(F.struct(*(F.col(f"__f.{c}").alias(c) for c in fields), "score"), order).alias("c"))
    found = r.join(best, [*on, "__x"]).groupBy(key).agg(F.min_by("c", "__o").alias("c")).select(key, "c.*", F.lit("MATCH").alias("how"))
    if only < 1:
        return found
    first = layer.groupBy(*on).agg(F.count("*").alias("__n"), F.min_by(F.struct(*fields), feature_key).alias("__f"))
    few = r.join(first, on).groupBy(key).agg(F.sum("__n").alias("__n"), F.min_by(F.struct("__f", "name"), f"__f.{feature_key}").alias("c")).where(F.col("__n") <= only)
    alone = few.join(found.select(key), key, "left_anti").select(key, "c.__f.*", T.similarity(F.col("c.name"), F.col("c.__f.fname")).alias("score"), F.lit("ONLY").alias("how"))
    return found.unionByName(alone)


def _alike(x: DataFrame, y: DataFrame, on: list[str], floor: float) -> DataFrame:
    """Pairs (on, __x, __y) of different normalised names among which are all whose similarity is at least ``floor``, over 0.

    A name that holds another meets it as one of its own substrings, of the lengths that names have. For the share of words: two sets of n and m words with a share t
    have o = t / (1 + t) * (n + m) words in common, so from rare to frequent one of the first n - o + 1 of one is among the first m - o + 1 of the other.
    """

    def holding(a: DataFrame, p: str, b: DataFrame, q: str) -> DataFrame:
        lengths = b.agg(F.collect_set(F.length(q)).alias("__lengths"))  # one row
        cuts = a.crossJoin(F.broadcast(lengths)).withColumn("__l", F.explode("__lengths")).where((F.col("__l") <= F.length(p)) & ((F.col("__l") > 0) | (F.length(p) == 0)))
        starts = F.sequence(F.lit(1), F.length(p) - F.col("__l") + 1)
        cuts = cuts.select(*on, p, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(p), i, F.col("__l"))))).alias(q))
        return cuts.join(b, [*on, q]).select(*on, "__x", "__y")

    pairs = holding(x, "__x", y, "__y").unionByName(holding(y, "__y", x, "__x"))
    if floor > 60:
        return pairs.distinct()
    t = min(floor, 25.0) / 50
    words = [d.select(*on, c, F.explode(T.words(F.col(c))).alias("__w")) for d, c in ((x, "__x"), (y, "__y"))]
    often = words[0].select("__w").unionByName(words[1].select("__w")).groupBy("__w").agg(F.count("*").alias("__o"))
    heads = []
    for d, c, own in zip(words, ("__x", "__y"), ("__n", "__m"), strict=True):
        other = {"__n": "__m", "__m": "__n"}[own]
        sets = d.join(often, "__w").groupBy(*on, c).agg(F.array_sort(F.collect_list(F.struct("__o", "__w"))).alias("__s")).withColumn(own, F.size("__s"))
        sizes = F.sequence(F.ceil(F.col(own) * t - 1e-9).cast("int"), F.floor(F.col(own) / t + 1e-9).cast("int"))
        sets = sets.withColumn(other, F.explode(sizes))
        common = F.ceil((F.col(own) + F.col(other)) * (t / (1 + t)) - 1e-9).cast("int")
        heads.append(sets.select(*on, c, "__n", "__m", F.explode(F.slice("__s", F.lit(1), F.greatest(F.col(own) - common + 1, F.lit(0)))).alias("__h")).select(*on, c, "__n", "__m", "__h.__w"))
    return pairs.unionByName(heads[0].join(heads[1], [*on, "__n", "__m", "__w"]).select(*on, "__x", "__y")).distinct()


def by_operator(towers: DataFrame, requests: DataFrame, on: list[str], key: str, feature_key: str) -> DataFrame:
    """One tower a request: of several the first (by key) whose ``operator`` the request's name mentions, else the first."""
    named = F.coalesce(plain(F.col("name")).contains(plain(F.col("operator"))), F.lit(False))
    joined = requests.join(towers, on)
    return joined.groupBy(key).agg(F.min_by(feature_key, F.struct(~named, F.col(feature_key))).alias(feature_key))


# ---------------------------------------------------------------- scores over name, address and locality

# Weights of name, address and locality by kind of place; the last entry for others.
WEIGHTS = {
    "HEALTH": (0.60, 0.25, 0.15), "SANITARIO": (0.60, 0.25, 0.15), "EDUCATION": (0.65, 0.20, 0.15), "EDUCATIVO": (0.65, 0.20, 0.15), "SECURITY": (0.40, 0.20, 0.40), "SEGURIDAD": (0.40, 0.20, 0.40),
    "TRANSPORT": (0.30, 0.50, 0.20), "TRANSPORTE": (0.30, 0.50, 0.20), "CULTURAL": (0.55, 0.25, 0.20), "RELIGIOSO": (0.55, 0.25, 0.20), "DEPORTIVO": (0.40, 0.35, 0.25), "ENERGIA": (0.55, 0.30, 0.15),
    "HIDRAULICO": (0.35, 0.25, 0.40), "": (0.45, 0.30, 0.25),
}


def field_scores(kind: Column) -> Column:
    """Struct (name, address, locality, total) of a candidate (c_name, c_address, c_municipality, c_code) for a request (name, address, locality, code).

    An address that either side lacks scores 0; without a locality the same municipal code scores 100.
    """
    from ..functions import address as A

    known = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    w = F.coalesce(known[F.upper(F.trim(kind))], known[F.lit("")])
    has = lambda c: F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))
    name = T.graded_similarity(F.col("name"), F.col("c_name"))
    address = F.when(has("address") & has("c_address"), T.graded_similarity(A.clean(F.col("address")), A.clean(F.col("c_address")))).otherwise(0)
    locality = F.when(has("locality"), T.graded_similarity(F.col("locality"), F.col("c_municipality"))).when(F.col("code") == F.col("c_code"), 100).otherwise(0)
    return F.struct(name.alias("name"), address.alias("address"), locality.alias("locality"), F.floor(name * w[0] + address * w[1] + locality * w[2] + 0.5).cast("long").alias("total"))


def disambiguated(requests: DataFrame, candidates: DataFrame, on: list[str], key: str, kind: Column) -> DataFrame:
    """(key, candidate, score, confidence, gap, reliable, review), one a request: the candidate with the highest total, ties to the smaller ``candidate``.

    HIGH from 15 points ahead of the second (100 if alone), MEDIUM from 8, LOW else and under a score of 40; NONE without candidates. One join on ``on``, then
    one aggregation that keeps the best two of each request.
    """
    scored = requests.join(candidates, on).withColumn("s", field_scores(kind)["total"])
    order = F.struct((-F.col("s")).alias("s"), F.col("candidate").alias("candidate"))
    top = scored.groupBy(key).agg(F.min(order).alias("a"), F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("two"))
    gap = F.when(F.size("two") > 1, F.get("two", 1)["s"] - F.col("a.s")).otherwise(100)
    top = top.select(key, F.col("a.candidate").alias("candidate"), (-F.col("a.s")).alias("score"), gap.cast("long").alias("gap"))
    out = requests.select(key).join(top, key, "left")
    confidence = F.when(F.col("candidate").isNull(), "NONE").when(F.col("score") < 40, "LOW").when(F.col("gap") >= 15, "HIGH").when(F.col("gap") >= 8, "MEDIUM").otherwise("LOW")
    out = out.withColumn("score", F.coalesce("score", F.lit(0))).withColumn("gap", F.coalesce("gap", F.lit(0))).withColumn("confidence", confidence)
    medium = F.col("confidence") == "MEDIUM"
    return out.select(key, "candidate", "score", "confidence", "gap", ((F.col("confidence") == "HIGH") | (medium & (F.col("score") >= 70))).alias("reliable"), ((F.col("confidence") == "LOW") | (medium & (F.col("score") < 60))).alias("review"))


def accepted_confidence(confidence: Column) -> Column:
    """What a disambiguated place is worth in a cascade; null for NONE."""
    return F.when(confidence == "HIGH", 90).when(confidence == "MEDIUM", 75).when(confidence == "LOW", 60)


# ---------------------------------------------------------------- municipalities


def named_places(catalogue: DataFrame, code: str, label: str) -> DataFrame:
    """(code, place, term, first) of a catalogue: the name and its variants; a variant that is another row's name or an earlier row's variant is left out."""
    own = catalogue.select(F.col(code).alias("code"), F.col(label).alias("place"), T.file_key(F.col(label)).alias("term"), F.lit(0).alias("rank"))
    more = catalogue.select(F.col(code).alias("code"), F.col(label).alias("place"), F.explode(T.name_variants(F.col(label))).alias("term"), F.lit(1).alias("rank"))
    return own.unionByName(more).where("term <> ''").groupBy("term").agg(F.min(F.struct("rank", "code", "place")).alias("b")).select("term", "b.code", "b.place")


def resolved(requests: DataFrame, catalogue: DataFrame, key: str, name: str, code: str, label: str) -> DataFrame:
    """(key, code, how) of each request: EXACT by name or variant; CONTAINED where the shorter has over 0.7 of the longer's letters; TYPO by an edit similarity over
    0.8 at three letters' difference at most, the fewest edits first; null else. Ties go to the smaller code.

    The catalogue is a country's municipalities, some thousands at most; requests without an exact answer are compared with terms that share a first
    or a last pair of letters or are contained, by one join on these pairs.
    """
    terms = named_places(catalogue, code, label)
    r = requests.select(key, F.coalesce(T.file_key(F.col(name)), F.lit("")).alias("n"))
    exact = r.join(terms, F.col("n") == F.col("term"), "left")
    done = exact.where("code is not null").select(key, "code", F.lit("EXACT").alias("how"))
    rest = exact.where("code is null and n <> ''").select(key, "n")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    near = rest.withColumn("g", F.explode(grams(F.col("n")))).join(terms.withColumn("g", F.explode(grams(F.col("term")))), "g").select(key, "n", "term", "code").distinct()
    short, long = F.least(F.length("n"), F.length("term")), F.greatest(F.length("n"), F.length("term"))
    inside = (F.col("n").contains(F.col("term")) | F.col("term").contains(F.col("n"))) & (short / long > 0.7)
    edits = F.levenshtein("n", "term")
    typo = (long - short <= 3) & (1 - edits / long > 0.8)
    rank = F.when(inside, F.struct(F.lit(0).alias("way"), F.lit(0).alias("edits"), F.col("code").alias("code"))).when(typo, F.struct(F.lit(1).alias("way"), edits.alias("edits"), F.col("code").alias("code")))
    best = near.groupBy(key).agg(F.min(rank).alias("b"))
    found = rest.select(key).join(best, key, "left").select(key, F.col("b.code").alias("code"), F.when(F.col("b.way") == 0, "CONTAINED").when(F.col("b.way") == 1, "TYPO").alias("how"))
    nothing = exact.where("code is null and n = ''").select(key, "code", F.lit(None).cast("string").alias("how"))
    return done.unionByName(found).unionByName(nothing)


def places_by_text(requests: DataFrame, catalogue: DataFrame, key: str, name: str, code: str, label: str, limit: int = 10) -> DataFrame:
    """(key, code, score, rank): places for a typed text, 100 equal, 80 start, 60 inside, else half the edit similarity if over 0.6."""
    c = catalogue.select(F.col(code).alias("code"), T.file_key(F.col(label)).alias("term"))
    r = requests.select(key, T.file_key(F.col(name)).alias("n")).where(F.length("n") >= 2)
    alike = 1 - F.levenshtein("n", "term") / F.greatest(F.length("n"), F.length("term"))
    score = F.when(F.col("n") == F.col("term"), 100).when(F.col("term").startswith(F.col("n")), 80).when(F.col("term").contains(F.col("n")), 60).when(alike > 0.6, F.floor(alike * 50 + 0.5)).otherwise(0)
    # a typed text shares a letter pair with whatever it may mean
    grams = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))
    pairs = r.withColumn("g", F.explode(grams(F.col("n")))).join(c.withColumn("g", F.explode(grams(F.col("term")))), "g").select(key, "n", "code", "term").distinct()
    ranked = pairs.withColumn("score", score.cast("long")).where("score > 0").withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "code")))
    return ranked.where(F.col("rank") <= limit).select(key, "code", "score", F.col("rank").cast("long").alias("rank"))


def mentions(documents: DataFrame, catalogue: DataFrame, key: str, text: str, code: str, label: str) -> DataFrame:
    """(key, code, n, score): the place that a document names most often, as whole words; 40 and 5 a mention up to 80, 10 more (up to 90) at twice the second's.

    Terms of four letters at least. Words meet terms by their first word, so a document is read once and nothing is compared with every term.
    """
    terms = named_places(catalogue, code, label).where(F.length("term") >= 4).withColumn("w", F.substring_index("term", " ", 1))
    words = documents.select(key, F.split(T.file_key(F.col(text)), " ").alias("t")).select(key, "t", F.posexplode("t").alias("i", "w"))
    n = F.size(F.split("term", " "))
    hits = words.join(terms, "w").where(F.array_join(F.slice("t", F.col("i") + 1, n), " ") == F.col("term"))
    counts = hits.groupBy(key, "code").agg(F.count("*").alias("n"))
    order = W.partitionBy(key).orderBy(F.desc("n"), "code")
    first = counts.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("n").over(order)).where("r = 1")
    base = F.least(F.lit(80), 40 + F.col("n") * 5)
    return first.select(key, "code", "n", F.when(F.col("n") / F.col("second") >= 2, F.least(F.lit(90), base + 10)).otherwise(base).cast("long").alias("score"))


# Weights of the kinds of evidence for a document's municipality.
EVIDENCE = {"HEADER": 1.5, "METADATA": 1.3, "FILE_NAME": 1.2, "CONTENT": 1.0}


def voted(evidence: DataFrame, key: str, least: int = 50) -> DataFrame:
    """(key, code, score, confidence) of evidence (key, kind, code, points): weighted sums over the number of pieces; nothing under ``least``.

    ALTA from 85 or where two pieces agree, MEDIA from 65, else BAJA. Ties go to the smaller code.
    """
    weight = F.create_map(*(F.lit(v) for kv in EVIDENCE.items() for v in kv))[F.col("kind")]
    total = evidence.groupBy(key).agg(F.count("*").alias("pieces"))
    each = evidence.groupBy(key, "code").agg(F.sum(F.col("points") * F.coalesce(weight, F.lit(1.0))).alias("sum"), F.count("*").alias("agree")).join(total, key)
    best = each.groupBy(key).agg(F.min(F.struct(-F.col("sum"), "code", "agree", "pieces")).alias("b")).select(key, "b.code", "b.agree", F.least(F.lit(100), F.floor(-F.col("b.col1") / F.col("b.pieces") + 0.5)).cast("long").alias("score"))
    return best.where(F.col("score") >= least).select(key, "code", "score", F.when((F.col("score") >= 85) | (F.col("agree") >= 2), "ALTA").when(F.col("score") >= 65, "MEDIA").otherwise("BAJA").alias("confidence"))


# Answers of an address service from the most to the least exact.
ANSWER_KINDS = ["portal", "callejero", "municipio", "provincia"]


def answer_rank(kind: Column) -> Column:
    """Order of an answer's kind; one that isn't listed comes first."""
    return F.array_position(F.array(*map(F.lit, ANSWER_KINDS)), F.coalesce(kind, F.lit("")))


def unlike_any(rows: DataFrame, kept: DataFrame, on: list[str], key: str, name: str, limit: float = 85) -> DataFrame:
    """Rows whose name is at most ``limit`` similar to every kept one with the same ``on``."""
    other = kept.select(*on, F.col(name).alias("__name"))
    close = rows.join(other, on).where(T.graded_similarity(F.col(name), F.col("__name")) > limit).select(key).distinct()
    return rows.join(close, key, "left_anti")


def searched(requests: DataFrame, items: DataFrame, key: str, name: str, item: str, label: str, position: str, limit: int = 10, threshold: float = 0.4) -> DataFrame:
    """(key, item, score): items whose name has every word of the request with one error at most, the first ``limit`` by ``position``.

    The score is the position over a hundred, and items past ``threshold`` don't count: this search scores places in a list, not likeness.
    So the list that requests are compared with has a bound, 100 * ``threshold`` + 1 items, however long the table is.
    """
    r = requests.select(key, T.normalise(F.col(name)).alias("n")).where(F.length("n") >= 2)
    i = items.where(F.col(position) <= threshold * 100).select(F.col(item).alias("item"), T.normalise(F.col(label)).alias("h"), F.col(position).alias("p"))
    hits = r.crossJoin(F.broadcast(i)).where(T.fuzzy_hit(F.col("n"), F.col("h")))  # the positions bound the items: 100 * threshold + 1 of them
    ranked = hits.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("p"))).where(F.col("r") <= limit)
    return ranked.select(key, "item", F.least(F.lit(1.0), F.col("p") / 100).alias("score"))
