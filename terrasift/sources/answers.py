"""Answers of address and map services, as columns: stored responses become candidates without a call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import coords

# Confidence of an address service's answer by its state, for the two searches that use it; the default for other states.
STATES = {"validated": ({0: 50, 1: 95, 2: 88, 3: 75, 4: 60, 5: 45, 10: 30}, 40), "automatic": ({1: 92, 2: 85, 3: 78, 4: 70, 5: 60}, 55)}
_ADDRESS = "address string, muni string, muniCode string, province string, type string, state int, lat double, lng double, geom string"
_ELEMENT = "elements array<struct<id:bigint,type:string,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"


def state_confidence(state: Column, search: str = "validated") -> Column:
    known, other = STATES[search]
    return F.coalesce(F.create_map(*(F.lit(v) for kv in known.items() for v in kv))[state], F.lit(other))


def address_answer(response: Column) -> Column:
    """Struct (address, municipality, code, province, kind, state, lon, lat) of a response, with or without a call around it; the point may be text. Null if unreadable."""
    body = F.regexp_replace(F.trim(response), r"(?s)^\s*[\w.]+\((.*)\)\s*;?\s*$", "$1")
    r = F.from_json(body, _ADDRESS)
    shape = coords.parse_wkt(r["geom"])
    value = F.struct(
        r["address"].alias("address"), r["muni"].alias("municipality"), r["muniCode"].alias("code"), r["province"].alias("province"), r["type"].alias("kind"), r["state"].alias("state"),
        F.coalesce(r["lng"], shape["x"]).alias("lon"), F.coalesce(r["lat"], shape["y"]).alias("lat"),
    )
    return F.when(value["lon"].isNotNull() & value["lat"].isNotNull(), value)


def map_elements(response: Column) -> Column:
    """Array of structs (id, type, name, lon, lat) of a map service's response: nodes by their place, others by their centre; without a name or a place none."""
    e = F.from_json(response, _ELEMENT)["elements"]

    def parsed(x: Column) -> Column:
        node = x["type"] == "node"
        name = F.coalesce(x["tags"]["name"], x["tags"]["name:es"], x["tags"]["alt_name"], F.lit(""))
        return F.struct(x["id"].alias("id"), x["type"].alias("type"), name.alias("name"), F.when(node, x["lon"]).otherwise(x["center"]["lon"]).alias("lon"), F.when(node, x["lat"]).otherwise(x["center"]["lat"]).alias("lat"))

    return F.filter(F.transform(F.coalesce(e, F.array().cast(e_type())), parsed), lambda p: (p["name"] != "") & p["lat"].isNotNull() & p["lon"].isNotNull())


def e_type() -> str:
    return _ELEMENT.split(" ", 1)[1]


# What an error of a service is called, by what its message says, in order.
ERRORS = [("timeout", r"timeout|timed out|abort"), ("network", r"network|fetch|econn|dns|socket"), ("parse", r"json|parse|syntax|xml"), ("no_results", r"no results|not found|sin resultados|404"), ("ambiguous", r"ambig|multiple"), ("invalid_coordinate", r"coordinate|coordenada|out of range")]


def status_of(message: Column) -> Column:
    """Status of a call: ok without a message, else the kind of its error; unknown if nothing tells."""
    low, out = F.lower(message), F.when(message.isNull() | (message == ""), "ok")
    for name, pattern in ERRORS:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("unknown")
