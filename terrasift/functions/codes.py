"""Municipal codes of five digits, the first two of which name a province."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The provinces of the region by code.
PROVINCES = {"04": "Almería", "11": "Cádiz", "14": "Córdoba", "18": "Granada", "21": "Huelva", "23": "Jaén", "29": "Málaga", "41": "Sevilla"}


def padded(code: Column) -> Column:
    """Five digits; a lost leading zero comes back; null for anything else."""
    digits = F.trim(code.cast("string"))
    return F.when(digits.rlike(r"^\d{4,5}$"), F.lpad(digits, 5, "0"))


def province_code(code: Column) -> Column:
    return F.substring(code, 1, 2)


def province(code: Column) -> Column:
    pairs = [F.lit(x) for pair in PROVINCES.items() for x in pair]
    return F.create_map(*pairs)[province_code(code)]


def rejection(got: Column, wanted: Column, wanted_province: Column) -> Column:
    """Why an answer is refused: the first motive that holds, or null for a good one.

    ``wanted`` and ``wanted_province`` (a province's code) may be null; a null says nothing against an answer.
    """
    expected = F.coalesce(province_code(wanted), wanted_province)
    return (
        F.when(F.coalesce(got, F.lit("")) == "", "sin_codigo_ine")
        .when(~province_code(got).isin(list(PROVINCES)), "fuera_andalucia")
        .when(province_code(got) != expected, "provincia_incorrecta")
        .when(got != wanted, "municipio_incorrecto")
    )
