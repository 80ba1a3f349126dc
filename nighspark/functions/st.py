"""Geometry columns: a struct of kind, binary form and envelope, and functions over it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nighspark.functions import geometry as G

GEOMETRY = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("wkb", T.BinaryType()), *(T.StructField(n, T.DoubleType()) for n in ("minx", "miny", "maxx", "maxy"))])


def _struct(rows: list[tuple]) -> pd.DataFrame:
    """Struct rows of geometries; null and empty ones have null envelopes."""
    out = pd.DataFrame(rows, columns=["kind", "wkb", "minx", "miny", "maxx", "maxy"])
    return out.astype({"kind": "Int8", **dict.fromkeys(("minx", "miny", "maxx", "maxy"), "float64")})


@F.pandas_udf(GEOMETRY)
def _from_wkt(texts: pd.Series) -> pd.DataFrame:
    return _struct([G.row_of_wkt(t) for t in texts])


@F.pandas_udf(GEOMETRY)
def _from_wkb(data: pd.Series) -> pd.DataFrame:
    return _struct([G.row_of_wkb(None if d is None else bytes(d)) for d in data])


@F.pandas_udf(T.StringType())
def _as_wkt(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else G.to_wkt(G.from_wkb(bytes(d))) for d in data], dtype=object)


@F.pandas_udf(T.DoubleType())
def wkb_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    of = G.geometry_of
    return pd.Series([None if a is None or b is None else G.distance(of(bytes(a)), of(bytes(b))) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def wkb_fills_box(data: pd.Series) -> pd.Series:
    """Whether the geometry is a point, an axis-parallel line or a rectangle, drawn in whatever way: its envelope."""
    return pd.Series([d is not None and G.wkb_fills_box(bytes(d)) for d in data], dtype=bool)


def wkb_predicate(name: str):
    @F.pandas_udf(T.BooleanType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        of = G.geometry_of
        return pd.Series([a is not None and b is not None and G.test(name, of(bytes(a)), of(bytes(b))) for a, b in zip(left, right)])

    return run


def st_from_wkt(text) -> Column:
    """Geometry of a text; null, which matches nothing, where the text is null or no geometry."""
    return _from_wkt(text)


def st_from_wkb(data) -> Column:
    """Geometry of a binary form; null, which matches nothing, where it is null or no geometry."""
    return _from_wkb(data)


def st_as_wkt(geom) -> Column:
    return _as_wkt(_col(geom)["wkb"])


def st_as_wkb(geom) -> Column:
    return _col(geom)["wkb"]


def st_point_wkt(x, y) -> Column:
    """Text of a point, made and read (st_point_x, st_point_y) without leaving the JVM."""
    return F.concat(F.lit("POINT ("), _col(x).cast("string"), F.lit(" "), _col(y).cast("string"), F.lit(")"))


_POINT = r"^\s*[Pp][Oo][Ii][Nn][Tt]\s*\(\s*(\S+)\s+([^\s)]+)\s*\)\s*$"


def st_point_x(text) -> Column:
    return F.regexp_extract(_col(text), _POINT, 1).try_cast("double")


def st_point_y(text) -> Column:
    return F.regexp_extract(_col(text), _POINT, 2).try_cast("double")


def st_envelope(geom) -> Column:
    g = _col(geom)
    return F.struct(*(g[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")))


def st_distance(left, right) -> Column:
    return wkb_distance(_col(left)["wkb"], _col(right)["wkb"])


def st_within_distance(left, right, distance: float) -> Column:
    return st_distance(left, right) <= distance


def st_predicate(name: str, left, right) -> Column:
    if name not in G.PREDICATES:
        raise ValueError(f"unknown predicate {name!r}; known: {', '.join(G.PREDICATES)}")
    return wkb_predicate(name)(_col(left)["wkb"], _col(right)["wkb"])


def st_intersects(left, right) -> Column:
    return st_predicate("intersects", left, right)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
