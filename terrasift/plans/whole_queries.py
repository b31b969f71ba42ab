"""Queries of joins, checks and reports over whole derived tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import coords
from ..operators import candidates, fusion, reports, spatial
from .place_queries import P, S, cents
from .registry import register
from .views import KINDS, TABLES, features, points, sources, table

_D = "sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y))"


def _cent(c: str) -> str:
    return f"floor({c} * 100 + 0.5) / 100"


@register("nearest_by_radii", P(f""", n as (select id, min(d) as d from (select id, {_D} as d from p, f) a where d <= 10000 group by 1)
select p.id, {_cent('n.d')} as distance, case when d <= 100 then 100.0 when d <= 500 then 500.0 when d <= 1000 then 1000.0 when d <= 5000 then 5000.0 when d <= 10000 then 10000.0 end::double as radius from p left join n using (id)"""))
def nearest_by_radii(spark, sf_dir):
    near = spatial.nearest_within(points(spark, sf_dir).select("id", "x", "y"), features(spark, sf_dir).select("fid", "x", "y"), "id", "fid")
    return near.select("id", cents(F.col("distance")).alias("distance"), "radius")


@register("square_search", P(f"select id, fid, rank from (select id, fid, row_number() over (partition by id order by {_D}, fid) as rank from p, f where abs(p.x - f.x) <= 8000 and abs(p.y - f.y) <= 8000) t"))
def square_search(spark, sf_dir):
    return spatial.in_square(points(spark, sf_dir), features(spark, sf_dir).select("fid", "x", "y"), "id", "fid", 8_000.0).select("id", "fid", "rank")


@register("near_of_kind", P(f"select id, fid, {_cent(_D)} as distance, row_number() over (partition by id order by {_D}, fid) as rank from p, f where f.kind = 'SANITARIO' and {_D} <= 20000"))
def near_of_kind(spark, sf_dir):
    f = features(spark, sf_dir).where("kind = 'SANITARIO'").select("fid", "x", "y")
    near = spatial.within(points(spark, sf_dir).select("id", "x", "y"), f, 20_000.0)
    return near.select("id", "fid", cents(F.col("distance")).alias("distance"), F.row_number().over(W.partitionBy("id").orderBy("distance", "fid")).cast("long").alias("rank"))


@register("layer_check", P(f"select id, count(fid) > 0 as confirmed, {_cent('min(d)')} as nearest from (select p.id, f.fid, {_D} as d from p left join f on f.mun = p.mun and {_D} <= 60000) t group by 1"))
def layer_check(spark, sf_dir):
    """Whether a feature of its own municipality confirms a point within 60 km."""
    near = spatial.within(points(spark, sf_dir).select("id", "mun", "x", "y"), features(spark, sf_dir).select("fid", F.col("mun").alias("fmun"), "x", "y"), 60_000.0).where("mun = fmun")
    best = near.groupBy("id").agg(F.min("distance").alias("d"))
    return points(spark, sf_dir).select("id").join(best, "id", "left").select("id", F.col("d").isNotNull().alias("confirmed"), cents(F.col("d")).alias("nearest"))


@register("centroid_distance", P(", c as (select mun, avg(x) as cx, avg(y) as cy from f group by 1) select id, floor(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) * 10 + 0.5) / 10 as metres, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= 50000 as near from p left join c using (mun)"))
def centroid_distance(spark, sf_dir):
    centres = features(spark, sf_dir).groupBy("mun").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    return points(spark, sf_dir).join(centres, "mun", "left").select("id", (F.floor(d * 10 + 0.5) / 10).alias("metres"), (d <= 50_000).alias("near"))


# polygons: the box around each municipality's features, half a metre wider so that no whole coordinate lies on a side, with a hole in the middle ninth
_BOX = "b as (select mun, min(x) - 0.5 as x0, min(y) - 0.5 as y0, max(x) + 0.5 as x1, max(y) + 0.5 as y1 from f group by 1 having count(*) > 1)"
_HOLE = "h as (select *, x0 + floor((x1 - x0) / 3) + 0.25 as hx0, y0 + floor((y1 - y0) / 3) + 0.25 as hy0, x0 + floor((x1 - x0) * 2 / 3) + 0.25 as hx1, y0 + floor((y1 - y0) * 2 / 3) + 0.25 as hy1 from b)"
_IN = "({p}.x between {h}.x0 and {h}.x1 and {p}.y between {h}.y0 and {h}.y1 and not ({p}.x between {h}.hx0 and {h}.hx1 and {p}.y between {h}.hy0 and {h}.hy1))"
_RECT = "sqrt(pow(greatest({a} - p.x, p.x - {b}, 0), 2) + pow(greatest({c} - p.y, p.y - {d}, 0), 2))"
_SIDE = "least(p.x - {a}, {b} - p.x, p.y - {c}, {d} - p.y)"


def _edge(a: str, b: str, c: str, d: str) -> str:
    """Distance of a point to a rectangle's boundary."""
    k = {"a": a, "b": b, "c": c, "d": d}
    return f"case when p.x between {a} and {b} and p.y between {c} and {d} then {_SIDE.format(**k)} else {_RECT.format(**k)} end"


def _polygons(spark, sf_dir):
    b = features(spark, sf_dir).groupBy("mun").agg((F.min("x") - 0.5).alias("min_x"), (F.min("y") - 0.5).alias("min_y"), (F.max("x") + 0.5).alias("max_x"), (F.max("y") + 0.5).alias("max_y"), F.count("*").alias("n")).where("n > 1")
    third = lambda lo, hi, k: F.col(lo) + F.floor((F.col(hi) - F.col(lo)) * k / 3) + 0.25
    ring = lambda x0, y0, x1, y1: F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))
    outer = ring(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))
    hole = ring(third("min_x", "max_x", 1), third("min_y", "max_y", 1), third("min_x", "max_x", 2), third("min_y", "max_y", 2))
    return b.select("mun", "min_x", "min_y", "max_x", "max_y", F.array(outer, hole).alias("rings"))


_PLACED = f""", {_BOX}, {_HOLE},
o as (select p.id, p.mun, p.x, p.y, h.x0, {_IN.format(p='p', h='h')} as inside, least({_edge('h.x0', 'h.x1', 'h.y0', 'h.y1')}, {_edge('h.hx0', 'h.hx1', 'h.hy0', 'h.hy1')}) as edge from p left join h using (mun)),
s as (select *, case when x0 is null then 'UNKNOWN' when inside then 'INSIDE' when edge <= 100 then 'AT_BORDER' end as state from o),
n as (select s.id, min(h.mun) as found from s join h c on c.mun = s.mun join h on h.mun <> s.mun and c.x0 - 100 <= h.x1 + 100 and h.x0 - 100 <= c.x1 + 100 and c.y0 - 100 <= h.y1 + 100 and h.y0 - 100 <= c.y1 + 100 and {_IN.format(p='s', h='h')} where s.state is null group by 1),
r as (select s.id, coalesce(s.state, case when n.found is not null then 'NEIGHBOUR' else 'OUTSIDE' end) as state, case when s.state in ('INSIDE', 'AT_BORDER') then s.mun else n.found end as found from s left join n using (id))"""


@register("polygon_or_neighbour", P(_PLACED + " select id, state, found from r"))
def polygon_or_neighbour(spark, sf_dir):
    """Points in the polygons of their municipalities, holes and all, at their borders, or in a neighbour's."""
    return spatial.placed_in(points(spark, sf_dir).select("id", "mun", "x", "y"), _polygons(spark, sf_dir), "id", "mun")


@register("validation_summary", P(_PLACED + " select state, count(*) as n from r group by 1"))
def validation_summary(spark, sf_dir):
    return polygon_or_neighbour(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@register("checks_joined", P(_PLACED + f""", c as (select mun, avg(x) as cx, avg(y) as cy from f group by 1),
l as (select p.id, count(f.fid) > 0 as near from p left join f on f.mun = p.mun and {_D} <= 60000 group by 1),
k as (select p.id, cast(r.state in ('INSIDE', 'AT_BORDER') as int) + cast(coalesce(sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)) <= 50000, false) as int) + cast(l.near as int) as n from p join r using (id) join l using (id) left join c on c.mun = p.mun)
select case n when 0 then 20 when 1 then 50 when 2 then 80 else 95 end as confidence, count(*) as n from k group by 1"""))
def checks_joined(spark, sf_dir):
    """Three checks of each point: inside its municipality, near its centre, confirmed by a feature."""
    inside = polygon_or_neighbour(spark, sf_dir).select("id", F.col("state").isin("INSIDE", "AT_BORDER").alias("a"))
    both = inside.join(centroid_distance(spark, sf_dir).select("id", F.col("near").alias("b")), "id").join(layer_check(spark, sf_dir).select("id", F.col("confirmed").alias("c")), "id")
    return both.groupBy(candidates.three_checks(F.col("a"), F.col("b"), F.col("c")).alias("confidence")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------ features and requests

_KIND_OF = "case id % 11 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"


@register("singleton_requests", P(f""", q as (select id, mun, {_KIND_OF} as kind from p), g as (select mun, kind, count(*) as n, list(fid order by fid)[:10] as c from f group by 1, 2)
select id, coalesce(n, 0) as n, case when n = 1 then 'SINGLE' when n > 1 then 'MANY' else 'NONE' end as verdict, case when n = 1 then 95 end as confidence, coalesce(array_to_string(c, ','), '') as candidates from q left join g using (mun, kind)"""))
def singleton_requests(spark, sf_dir):
    wanted = points(spark, sf_dir).select("id", "mun", F.expr(_KIND_OF).alias("kind"))
    return reports.singletons(wanted, features(spark, sf_dir).select("mun", "kind", "fid"), ["mun", "kind"], "id", "fid").withColumn("candidates", F.array_join("candidates", ","))


@register("typology_lists", P(", k as (select unnest([" + ", ".join(f"'{x}'" for x in KINDS) + "]) as kind), c as (select mun, k.kind, count(f.fid) as n from (select distinct mun from f) m cross join k left join f using (mun, kind) group by 1, 2) select mun, coalesce(array_to_string(list(kind order by kind) filter (n = 1), ','), '') as single, coalesce(array_to_string(list(kind order by kind) filter (n > 1), ','), '') as many, coalesce(array_to_string(list(kind order by kind) filter (n = 0), ','), '') as missing, cast(sum(n) as bigint) as total from c group by 1"))
def typology_lists(spark, sf_dir):
    f = features(spark, sf_dir)
    grid = f.select("mun").distinct().select("mun", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    counts = grid.join(f.groupBy("mun", "kind").agg(F.count("*").alias("n")), ["mun", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("kind")))), ",")
    return counts.groupBy("mun").agg(of(F.col("n") == 1).alias("single"), of(F.col("n") > 1).alias("many"), of(F.col("n") == 0).alias("missing"), F.sum("n").alias("total"))


@register("feature_table", P("select kind || '_' || lpad(cast(mun as varchar), 5, '0') || '_' || cast(row_number() over (partition by kind, mun order by fid) - 1 as varchar) as id, fid, x, y from f where x <> 0 and y <> 0"))
def feature_table(spark, sf_dir):
    f = features(spark, sf_dir).where("x <> 0 and y <> 0")
    n = F.row_number().over(W.partitionBy("kind", "mun").orderBy("fid")) - 1
    return f.select(F.concat_ws("_", "kind", F.lpad(F.col("mun").cast("string"), 5, "0"), n.cast("string")).alias("id"), "fid", "x", "y")


@register("municipality_extract", P("select row_number() over (order by mun) as rank, mun, min_by(fname, fid) as first_name, floor(avg(x) + 0.5) as x, floor(avg(y) + 0.5) as y, count(*) as n from f group by mun"))
def municipality_extract(spark, sf_dir):
    per = features(spark, sf_dir).groupBy("mun").agg(F.min_by("fname", "fid").alias("first_name"), F.floor(F.avg("x") + 0.5).cast("double").alias("x"), F.floor(F.avg("y") + 0.5).cast("double").alias("y"), F.count("*").alias("n"))
    return per.select(F.row_number().over(W.orderBy("mun")).cast("long").alias("rank"), "mun", "first_name", "x", "y", "n")  # a row a municipality


@register("table_counts", " union all ".join(f"select '{t}' as name, count(*) as n, count(*) > 0 as ready from {t}" for t in TABLES))
def table_counts(spark, sf_dir):
    out = None
    for t in TABLES:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", (F.col("n") > 0).alias("ready"))
        out = one if out is None else out.unionByName(one)
    return out


@register("region_scope", "select c_custkey as id, count(s_suppkey) as n from customer join nation a on c_nationkey = a.n_nationkey join region r on a.n_regionkey = r.r_regionkey left join (select s_suppkey, r_name as given from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) s on contains(lower(s.given), lower(left(r.r_name, 4))) or contains(lower(left(r.r_name, 4)), lower(s.given)) group by 1")
def region_scope(spark, sf_dir):
    """Features whose province's name holds the request's, or the other way round: distinct names are compared, then joined."""
    regions = table(spark, sf_dir, "region")
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    given = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.lower("r_name").alias("given")).agg(F.count("*").alias("n"))
    asked = regions.select("r_name", F.lower(F.substring("r_name", 1, 4)).alias("asked"))
    counts = asked.join(given, F.col("given").contains(F.col("asked")) | F.col("asked").contains(F.col("given"))).groupBy("r_name").agg(F.sum("n").alias("n"))
    who = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return who.join(counts, "r_name", "left").select(F.col("c_custkey").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


@register("substring_search", "select p_partkey, p_name from (select p_partkey, p_name, row_number() over (order by p_name, p_partkey) as r from part where contains(lower(p_name), 'art')) t where r <= 25")
def substring_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("art")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(25)


@register("patterns_by_use", "select pattern, n, row_number() over (order by n desc, pattern) as rank from (select p_type as pattern, count(*) as n from part group by 1) t")
def patterns_by_use(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("pattern")).agg(F.count("*").alias("n"))
    return counts.select("pattern", "n", F.row_number().over(W.orderBy(F.desc("n"), "pattern")).cast("long").alias("rank"))  # a row a pattern


# ------------------------------------------------------------ fusion and cascades

_NAMES = list(fusion.AUTHORITY)
_NAMED = "case source " + " ".join(f"when {i + 1} then '{n}'" for i, n in enumerate(_NAMES)) + " else 'NOMINATIM' end"
_TRUST = "case source " + " ".join(f"when {i + 1} then {fusion.AUTHORITY[n]}" for i, n in enumerate(_NAMES)) + " else 0.5 end::double"


@register("validation_of_all", S(f""", r as (select qid, source, x, y, least(confidence, 100) as c, {_TRUST} as t from s), w as (select a.qid, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as far from r a join r b on a.qid = b.qid and a.source <= b.source group by 1),
g as (select qid, count(*) as n, floor(w.far * 10 + 0.5) / 10 as metres, max(c) / 100 as m, sum(c / 100 * t) / sum(t) as own, sum(x * (c / 100 * t)) / sum(c / 100 * t) as cx, sum(y * (c / 100 * t)) / sum(c / 100 * t) as cy, arg_min(source, (-(t * c), source, x, y)) as best, arg_min(x, (-(t * c), source, x, y)) as bx, arg_min(y, (-(t * c), source, x, y)) as byy from r join w using (qid) group by qid, w.far),
v as (select *, case when n = 1 then 'SINGLE_SOURCE' when metres <= 100 then 'CONFIRMED' when metres <= 200 then 'LIKELY_VALID' when metres <= 300 then 'UNCERTAIN' else 'CONFLICT' end as status,
 case when n = 1 then 0.5 when metres <= 100 then 1.0 when metres <= 200 then 1 - 0.3 * (metres - 100) / 100 when metres <= 300 then 0.7 - 0.4 * (metres - 200) / 100 else greatest(0.1, 0.3 - (metres - 300) / 5000) end as agree from g)
select qid, n, status, case when status in ('CONFIRMED', 'LIKELY_VALID') then {_cent('cx')} when status in ('UNCERTAIN', 'SINGLE_SOURCE') then bx end as x, case when status in ('CONFIRMED', 'LIKELY_VALID') then {_cent('cy')} when status in ('UNCERTAIN', 'SINGLE_SOURCE') then byy end as y, floor(floor(least(100, (0.40 * m + 0.35 * agree + 0.25 * own) * 100 + case when n >= 2 and metres <= 25 then least(8, (25 - metres) / 3) else 0 end) * 10 + 0.5) / 10 + 0.5) as score from v"""))
def validation_of_all(spark, sf_dir):
    s = sources(spark, sf_dir).select("qid", F.col("source").alias("position"), F.expr(_NAMED).alias("source"), "x", "y", F.least("confidence", F.lit(100.0)).alias("confidence"))
    v = fusion.validated(s, "qid")
    exact = lambda c: F.when(F.col("status").isin("CONFIRMED", "LIKELY_VALID"), cents(F.col(c))).otherwise(F.col(c))
    return v.select("qid", "n", "status", exact("x").alias("x"), exact("y").alias("y"), F.floor(F.col("score") + 0.5).cast("double").alias("score"))


@register("cascade_legacy", S("select qid, level, confidence from (select qid, source as level, max(confidence) as confidence, row_number() over (partition by qid order by source) as r from s where source <= 5 and confidence >= case source when 1 then 60 when 2 then 60 when 3 then 55 when 4 then 55 else 50 end group by 1, 2) t where r = 1"))
def cascade_legacy(spark, sf_dir):
    s = sources(spark, sf_dir).where("source <= 5").select("qid", F.col("source").alias("level"), "confidence")
    return candidates.cascade(s, "qid", {1: 60.0, 2: 60.0, 3: 55.0, 4: 55.0, 5: 50.0}, None)


@register("cascade_gated", S("select qid, level, confidence from (select qid, source as level, max(confidence) as confidence, row_number() over (partition by qid order by source) as r from s where confidence >= case source when 1 then 70 when 2 then 50 when 3 then 55 when 4 then 60 when 5 then 55 when 6 then 60 else 40 end and (source <> 6 or qid % 3 = 0) group by 1, 2) t where r = 1"))
def cascade_gated(spark, sf_dir):
    """The whole cascade; answers of the national service count only where their municipality is the wanted one."""
    s = sources(spark, sf_dir).where((F.col("source") != 6) | (F.col("qid") % 3 == 0)).select("qid", F.col("source").alias("level"), "confidence")
    return candidates.cascade(s, "qid", {1: 70.0, 2: 50.0, 3: 55.0, 4: 60.0, 5: 55.0, 6: 60.0, 7: 40.0}, None)


# ------------------------------------------------------------ reports

_MOTIVES = ["view", "click", "purchase", "signup", "error", "timeout"]


@register("rejections_filled", "select m.motive, count(event_id) as n from (select unnest([" + ", ".join(f"'{m}'" for m in _MOTIVES) + "]) as motive) m left join events on event_type = motive group by 1")
def rejections_filled(spark, sf_dir):
    return reports.by_motive(table(spark, sf_dir, "events"), "event_type", _MOTIVES)


@register("rejections_top", "select place, n, row_number() over (order by n desc, place) as rank from (select user_id as place, count(*) as n from events where event_type = 'error' group by 1) t order by n desc, place limit 5")
def rejections_top(spark, sf_dir):
    return reports.most_refused(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id")


@register("rejections_recent", "select cast(sum(case when ts >= m.now - interval 1 hour then 1 else 0 end) as bigint) as last_hour, cast(sum(case when ts::date = m.now::date then 1 else 0 end) as bigint) as today, sum(case when ts >= m.now - interval 1 hour then 1 else 0 end) >= 3 as alert from events, (select max(ts) as now from events) m")
def rejections_recent(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reports.recent_alerts(e, "ts", e.agg(F.max("ts")).first()[0], 3)


@register("rejection_lines", "select event_id, cast(event_id as varchar) || ',\"' || replace(props, '\"', '\"\"') || '\",' || event_type as line from events")
def rejection_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", reports.as_lines(e, ["event_id", "props", "event_type"], ["props"]).alias("line"))


@register("learning_totals", "select count(*) as rules, cast(sum(uses) as bigint) as uses, cast(sum(good) as bigint) as successes, sum(good) / cast(sum(uses) as double) as rate, cast(sum(case when uses >= 10 and good / cast(uses as double) >= 0.95 then 1 else 0 end) as bigint) as stable, (select count(distinct event_type) from events) as places from (select user_id, count(*) as uses, sum(case when event_type <> 'error' then 1 else 0 end) as good from events group by 1) t")
def learning_totals(spark, sf_dir):
    return reports.learning_totals(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error", "event_type")


@register("run_counts", S("select source, count(*) as n, floor(count(*) / cast((select count(*) from s) as double) * 1000000 + 0.5) / 1000000 as share from s group by 1"))
def run_counts(spark, sf_dir):
    return reports.run_counts(sources(spark, sf_dir), "source").withColumn("share", F.floor(F.col("share") * 1_000_000 + 0.5) / 1_000_000)


@register("encoding_facts", "select count(*) as n, cast(sum(case when regexp_full_match(text, '[\\x00-\\x7F]*') then 1 else 0 end) as bigint) as ascii, cast(sum(case when regexp_matches(text, '[ÃÂ][\\x{80}-\\x{BF}]|\\x{FFFD}') then 1 else 0 end) as bigint) as suspicious from documents")
def encoding_facts(spark, sf_dir):
    return reports.encoding_facts(table(spark, sf_dir, "documents"), "text")


@register("cache_hits", """with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
c as (select user_id, k, ts + interval 6 hour as until, 0::bigint as hit from e where k = 1 union all select e.user_id, e.k, case when e.ts < c.until then c.until else e.ts + interval 6 hour end, case when e.ts < c.until then 1 else 0 end from c join e on e.user_id = c.user_id and e.k = c.k + 1)
select user_id, count(*) as requests, cast(sum(hit) as bigint) as hits from c group by 1""")
def cache_hits(spark, sf_dir):
    return reports.cache_hits(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "'0 06:00:00' day to second")
