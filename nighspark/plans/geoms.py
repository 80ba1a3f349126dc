"""What a join is told about a side's geometry, turned into columns it works with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nighspark.functions.st import st_from_wkb, st_from_wkt

POINT, BOX, SHAPE = "point", "box", "shape"
ENVELOPE = ("minx", "miny", "maxx", "maxy")


def side(df: DataFrame, geom, prefix: str, extra: dict[str, Column] | None = None) -> tuple[DataFrame, str]:
    """df's columns renamed with the prefix, and prefix + minx, miny, maxx, maxy (and wkb); and the kind of geometry.

    geom: ("x", "y"), ("minx", "miny", "maxx", "maxy"), or one column: a geometry struct, text or binary form.
    Rows whose geometry is null, empty or not finite are left out: they match nothing.
    """
    kind, wkb = POINT, None
    if isinstance(geom, (tuple, list)):
        cols = [F.col(c) if isinstance(c, str) else c for c in geom]
        if len(cols) == 2:
            env = [cols[0], cols[1], cols[0], cols[1]]
        elif len(cols) == 4:
            env, kind = cols, BOX
        else:
            raise ValueError("a geometry is (x, y), (minx, miny, maxx, maxy) or one column")
    else:
        kind = SHAPE
        of = df.schema[geom].dataType
        if isinstance(of, T.StringType):
            df = df.withColumn("__ns_geom", st_from_wkt(F.col(geom)))
        elif isinstance(of, T.BinaryType):
            df = df.withColumn("__ns_geom", st_from_wkb(F.col(geom)))
        else:
            df = df.withColumn("__ns_geom", F.col(geom))
        env, wkb = [F.col("__ns_geom")[c] for c in ENVELOPE], F.col("__ns_geom")["wkb"]
    names = [c for c in df.columns if c != "__ns_geom"]
    made = [F.col(c).alias(f"{prefix}c_{i}") for i, c in enumerate(names)]
    made += [v.cast("double").alias(f"{prefix}{n}") for n, v in zip(ENVELOPE, env)]
    if wkb is not None:
        made.append(wkb.alias(f"{prefix}wkb"))
    made += [v.alias(f"{prefix}{n}") for n, v in (extra or {}).items()]
    out = df.select(*made)
    # NaN sorts above infinity, so this also leaves out NaN; nulls fail every comparison
    for n in ENVELOPE:
        out = out.where(F.abs(F.col(f"{prefix}{n}")) < float("inf"))
    return out, kind


def payload(df: DataFrame, prefix: str, suffix: str = "", taken: set[str] = frozenset()) -> list[Column]:
    """The columns of df under their own names again; a name that is taken gets the suffix."""
    return [F.col(f"{prefix}c_{i}").alias(c + suffix if c in taken else c) for i, c in enumerate(df.columns)]


def gap(a: str, b: str, kind_a: str, kind_b: str) -> Column:
    """Distance between the envelopes of sides a and b; for points just that of the points."""
    if kind_a == kind_b == POINT:
        dx, dy = F.col(f"{a}minx") - F.col(f"{b}minx"), F.col(f"{a}miny") - F.col(f"{b}miny")
    else:
        axis = lambda lo, hi: F.greatest(F.lit(0.0), F.col(a + lo) - F.col(b + hi), F.col(b + lo) - F.col(a + hi))
        dx, dy = axis("minx", "maxx"), axis("miny", "maxy")
    return F.sqrt(dx * dx + dy * dy)


def exact(a: str, b: str, kind_a: str, kind_b: str) -> Column:
    """Distance between the geometries: that of their envelopes unless one is a shape."""
    if SHAPE not in (kind_a, kind_b):
        return gap(a, b, kind_a, kind_b)
    from nighspark.functions.st import wkb_distance

    return wkb_distance(shape(a, kind_a), shape(b, kind_b))


def shape(a: str, kind: str) -> Column:
    """Binary form of a side's geometry, made from the envelope where it has none."""
    if kind == SHAPE:
        return F.col(f"{a}wkb")
    return _boxed(*(F.col(f"{a}{n}") for n in ENVELOPE))


@F.pandas_udf(T.BinaryType())
def _boxed(minx: pd.Series, miny: pd.Series, maxx: pd.Series, maxy: pd.Series) -> pd.Series:
    import numpy as np

    from nighspark.functions.geometry import Geometry, to_wkb

    out = []
    for a, b, c, d in zip(minx, miny, maxx, maxy):
        if a == c and b == d:
            g = Geometry(1, [[np.array([[a, b]])]])
        elif a == c or b == d:
            g = Geometry(2, [[np.array([[a, b], [c, d]])]])
        else:
            g = Geometry(3, [[np.array([[a, b], [c, b], [c, d], [a, d], [a, b]])]])
        out.append(to_wkb(g))
    return pd.Series(out, dtype=object)


def stats(df: DataFrame, prefix: str, *more: Column):
    """One pass: count, extent, mean and largest width and height, and what `more` asks."""
    c = {n: F.col(f"{prefix}{n}") for n in ENVELOPE}
    return df.agg(
        F.count("*").alias("n"), F.min(c["minx"]).alias("minx"), F.min(c["miny"]).alias("miny"), F.max(c["maxx"]).alias("maxx"), F.max(c["maxy"]).alias("maxy"),
        F.avg(c["maxx"] - c["minx"]).alias("w"), F.avg(c["maxy"] - c["miny"]).alias("h"), F.max(c["maxx"] - c["minx"]).alias("most_w"), F.max(c["maxy"] - c["miny"]).alias("most_h"), *more,
    ).first()
