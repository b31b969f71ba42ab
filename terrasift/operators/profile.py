"""What a document's coordinate columns look like, before anything is repaired."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords

#: Share from which one decimal mark is a document's habit, and up to which it isn't.
MAJOR, MINOR = 0.8, 0.2


def profile(rows: DataFrame, key: str, x: str, y: str, placeholder: Callable[[Column], Column] = coords.is_placeholder) -> DataFrame:
    """One row a document: (key, n, with_x, with_y, with_both, missing, readable, decimal_mark, thousands_mark, notations).

    ``notations`` maps each notation (a fixed, short list) to its count. Two aggregations on one key: the values first by
    notation, so that a document of any size meets in one task only as a few counts. ``placeholder`` tells what stands for a missing value.
    """
    missing = lambda c: placeholder(F.col(c))
    both = rows.select(key, (~missing(x)).alias("__hx"), (~missing(y)).alias("__hy"), F.array(F.col(x), F.col(y)).alias("__v"))
    values = both.select(key, F.explode("__v").alias("v"), F.lit(None).cast("boolean").alias("hx"), F.lit(None).cast("boolean").alias("hy"), F.lit(False).alias("row"))
    flags = both.select(key, F.lit(None).cast("string").alias("v"), F.col("__hx").alias("hx"), F.col("__hy").alias("hy"), F.lit(True).alias("row"))
    long = values.unionByName(flags)
    name = F.when(~F.col("row"), coords.notation(F.col("v"), placeholder))
    counted = long.groupBy(key, name.alias("notation")).agg(
        F.count_if("row").alias("n"), F.count_if("hx").alias("with_x"), F.count_if("hy").alias("with_y"), F.count_if(F.col("hx") & F.col("hy")).alias("with_both"),
        F.count_if(~F.col("row")).alias("values"), F.count_if(~F.col("row") & coords.parse(F.col("v"), placeholder).isNotNull()).alias("readable"),
        F.count_if(~F.col("row") & F.col("v").rlike(r",\d{1,3}$")).alias("commas"), F.count_if(~F.col("row") & F.col("v").rlike(r"\d\.\d{1,2}$")).alias("dots"),
        F.count_if(~F.col("row") & F.col("v").rlike(r"\d\.\d{3}(\D|$)")).alias("dot_groups"), F.count_if(~F.col("row") & F.col("v").rlike(r"\d \d{3}(\D|$)")).alias("space_groups"),
    )
    s = lambda c: F.sum(c)
    out = counted.groupBy(key).agg(
        *(s(c).alias(c) for c in ("n", "with_x", "with_y", "with_both", "readable")), F.coalesce(F.sum(F.when(F.col("notation") == "placeholder", F.col("values"))), F.lit(0)).alias("missing"),
        majority(s("commas"), s("dots"), ",", ".").alias("decimal_mark"), majority(s("dot_groups"), s("space_groups"), ".", " ").alias("thousands_mark"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("notation").isNotNull(), F.struct("notation", "values"))))).alias("notations"),
    )
    return out


def majority(a: Column, b: Column, mark_a: str, mark_b: str) -> Column:
    """The mark that holds from 80 % on, MIXED between, null where there is none of either."""
    share = a / F.nullif(a + b, F.lit(0))
    return F.when(share >= MAJOR, mark_a).when(share <= MINOR, mark_b).when(share.isNotNull(), "MIXED")


def phases(notations: Column) -> Column:
    """Repair phases that the notations of a profile call for, sorted."""
    needs = {"acute": "marks", "european": "marks", "comma": "marks", "thousands": "marks", "spaced": "spaces", "fused": "split", "wkt": "shapes", "geojson": "shapes", "dms": "degrees", "nmea": "degrees", "nmea_sentence": "degrees", "placeholder": "placeholders"}
    lookup = F.create_map(*(F.lit(v) for pair in needs.items() for v in pair))
    return F.array_sort(F.array_compact(F.array_distinct(F.transform(F.map_keys(notations), lambda k: lookup[k]))))


def advice(n: Column, missing_share: Column, readable_share: Column, mixed: Column) -> Column:
    """Recommendations by thresholds, as an array of names."""
    return F.array_compact(F.array(
        F.when(n == 0, F.lit("EMPTY")), F.when(missing_share > 0.5, F.lit("MOSTLY_MISSING")), F.when(readable_share < 0.7, F.lit("REVIEW_NOTATION")),
        F.when(F.coalesce(mixed, F.lit(False)), F.lit("MIXED_MARKS")), F.when((missing_share <= 0.1) & (readable_share >= 0.9), F.lit("READY")),
    ))
