"""Queries against their SQL twins on rows that the small tables don't hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from terrasift.plans import registry


def against_sql(spark, folder, name, tables):
    """Rows of a query and of its twin over tables in ``folder``, sorted."""
    df = registry.queries()[name](spark, f"file://{folder}")
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]}) q").fetchall()
    plain = lambda rows: sorted(str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)
    return plain(df.collect()), plain(want)


# ------------------------------------------------------------ placeholders


@pytest.fixture(scope="module")
def odd_keys(spark, sf_dir, tmp_path_factory):
    """Customers whose eastings are 123456, a placeholder elsewhere, beside ten others."""
    folder = tmp_path_factory.mktemp("odd")
    rows = spark.range(10).union(spark.range(1).select(F.lit(518_624).cast("long"))).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"), (F.col("id") % 25).alias("c_nationkey"))
    rows.write.parquet(f"file://{folder}/customer.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"file://{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", ["parse_decimal", "document_profile", "located_stats", "pair_repair", "pair_confidence_by_region", "placeholder_filter"])
def test_measured_numbers_are_values(spark, odd_keys, name):
    got, want = against_sql(spark, odd_keys, name, ["customer", "nation", "region"])
    assert got == want


def test_pair_confidence_of_every_easting(spark, sf_dir, tmp_path):
    """520,000 keys in a row have each easting once and each northing at least once, in every region."""
    key = F.col("id")
    rows = spark.range(520_000).select(key.alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"), (F.floor(key / 10) % 25).alias("c_nationkey"))
    rows.write.parquet(f"file://{tmp_path}/customer.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"file://{tmp_path}/{t}.parquet")
    got, want = against_sql(spark, tmp_path, "pair_confidence_by_region", ["customer", "nation", "region"])
    assert len(got) == 20 and got == want


# ------------------------------------------------------------ joins whose groups grow


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """2,000 customers and 500 suppliers of two municipalities."""
    folder = tmp_path_factory.mktemp("crowded")
    for t, c, n in (("customer", "c_cust", 2_000), ("supplier", "s_supp", 500)):
        one = F.col("id")
        rows = spark.range(n).select(one.alias(f"{c}key"), F.concat(F.lit(f"{t}#"), F.lpad((one * 7 % 900).cast("string"), 5, "0")).alias(f"{c[:2]}name"), (one % 2).alias(f"{c[:2]}nationkey"))
        rows.write.parquet(f"file://{folder}/{t}.parquet")
    return folder


def most_rows(df):
    """Rows that the widest step of a query made."""
    df.write.format("noop").mode("overwrite").save()
    node, most = [df._jdf.queryExecution().executedPlan()], 0
    df.collect()
    while node:
        p = node.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        m = p.metrics().get("numOutputRows")
        most = max(most, m.get().value()) if m.isDefined() else most
        node += [p.plan()] if hasattr(p, "plan") and p.getClass().getSimpleName().endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.mark.parametrize("name", ["candidate_topk", "name_candidates", "source_match_whole"])
def test_no_product_of_a_group(spark, crowded, name):
    """The twin's rows, without 2,000 * 500 / 2 pairs on the way."""
    got, want = against_sql(spark, crowded, name, ["customer", "supplier"])
    assert got == want
    assert 2_000 <= most_rows(registry.queries()[name](spark, f"file://{crowded}")) < 300_000


@pytest.fixture(scope="module")
def odd_names(spark, tmp_path_factory):
    """Names equal, held, alike at the end or the beginning only, blank, null, of other letters, and more of each kind than a request gets."""
    folder = tmp_path_factory.mktemp("names")
    asked = ["Casa 040", "casa 040", "040", "Casa", " casa", "", " ", None, "a", "ab", "İzmir", "ΟΔΟΣ", "Straße", "Peña", "Plaza Mayor 12", "Plaza Mayor", "Mayor 12", "Customer#000001040", "😀", "nowhere"]
    given = ["Hospital 040", "Casa 040", "CASA 040", "Casa 040", "Casa 041", "b", "ab", "xabx", "", None, "izmir", "οδοσ Α", "ΟΔΟΣ", "STRASSE", "pena", "PEÑA", "Plaza Mayor 12 bis", "Plaza Menor 12", "Supplier#000000040", "Casa 😀", "la casa", "Vieja casa", " "]
    for t, c, names, alone in (("customer", "c_cust", asked, 2), ("supplier", "s_supp", given, 3)):
        rows = [(n, 0) for n in names] + [(n, 1) for n in names[::-1]] + [(n, None) for n in names] + [(n, alone) for n in names]
        rows = [(i, *r) for i, r in enumerate(rows)]
        spark.createDataFrame(rows, f"{c}key long, {c[:2]}name string, {c[:2]}nationkey int").write.parquet(f"file://{folder}/{t}.parquet")
    return folder


def test_name_candidates_take_whole_names(spark, odd_names):
    """the rows of the SQL, and of a plain count over whole names; those that share three letters only aren't equal."""
    got, want = against_sql(spark, odd_names, "name_candidates", ["customer", "supplier"])
    assert got == want
    low = lambda t: "".join({"İ": "i", "Σ": "σ"}.get(c, c.lower()) for c in t)
    score = lambda a, b: 0.0 if a is None or b is None else 100.0 if low(a) == low(b) else 80.0 if low(a) in low(b) else 0.0
    p, f = (sorted(tuple(r) for r in spark.read.parquet(f"file://{odd_names}/{t}.parquet").collect()) for t in ("customer", "supplier"))
    best = {i: sorted((-score(n, o), k) for k, o, m in f if m == mun)[:2] for i, n, mun in p if mun is not None}
    rows = registry.queries()["name_candidates"](spark, f"file://{odd_names}").collect()
    assert sorted((r.id, r.fid, r.score) for r in rows) == sorted((i, k, -s) for i, b in best.items() for s, k in b)
    names = dict((k, o) for k, o, _ in f)
    assert {names[r.fid] for r in rows if r.id == 17} == {"Hospital 040", "Casa 040"} and {r.score for r in rows if r.id == 17} == {0.0}


def test_no_product_of_different_names(spark, tmp_path):
    """2,000 and 500 names in one municipality, none twice, one word in all of them, and requests for it: not 1,000,000 pairs."""
    for t, c, n in (("customer", "c_cust", 2_000), ("supplier", "s_supp", 500)):
        one = F.col("id")
        name = F.concat(F.lit(f"{t} casa "), F.lpad(one.cast("string"), 5, "0"))
        if t == "customer":
            name = F.when(one < 20, F.concat(F.lit("casa 0"), one.cast("string"))).otherwise(name)
        spark.range(n).select(one.alias(f"{c}key"), name.alias(f"{c[:2]}name"), F.lit(1).alias(f"{c[:2]}nationkey")).write.parquet(f"file://{tmp_path}/{t}.parquet")
    got, want = against_sql(spark, tmp_path, "name_candidates", ["customer", "supplier"])
    assert got == want
    assert 2_000 <= most_rows(registry.queries()["name_candidates"](spark, f"file://{tmp_path}")) < 50_000
