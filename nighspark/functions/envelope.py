"""Envelopes as four double columns (or a struct of minx, miny, maxx, maxy): plain expressions, code-generated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("minx", "miny", "maxx", "maxy")


def envelope(minx, miny, maxx, maxy) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(n) if not isinstance(v, (str, Column)) else _col(v).cast("double").alias(n) for n, v in zip(FIELDS, (minx, miny, maxx, maxy))))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def expand(e: Column, d) -> Column:
    d = F.lit(d) if not isinstance(d, Column) else d
    return envelope(e["minx"] - d, e["miny"] - d, e["maxx"] + d, e["maxy"] + d)


def intersects(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def contains(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["minx"]) & (b["maxx"] <= a["maxx"]) & (a["miny"] <= b["miny"]) & (b["maxy"] <= a["maxy"])


def contains_point(a: Column, x: Column, y: Column) -> Column:
    return (a["minx"] <= x) & (x <= a["maxx"]) & (a["miny"] <= y) & (y <= a["maxy"])


def intersection(a: Column, b: Column) -> Column:
    """The common box, null if there is none."""
    box = envelope(F.greatest(a["minx"], b["minx"]), F.greatest(a["miny"], b["miny"]), F.least(a["maxx"], b["maxx"]), F.least(a["maxy"], b["maxy"]))
    return F.when(intersects(a, b), box)


def union(a: Column, b: Column) -> Column:
    return envelope(F.least(a["minx"], b["minx"]), F.least(a["miny"], b["miny"]), F.greatest(a["maxx"], b["maxx"]), F.greatest(a["maxy"], b["maxy"]))


def distance(a: Column, b: Column) -> Column:
    dx = F.greatest(F.lit(0.0), a["minx"] - b["maxx"], b["minx"] - a["maxx"])
    dy = F.greatest(F.lit(0.0), a["miny"] - b["maxy"], b["miny"] - a["maxy"])
    return F.sqrt(dx * dx + dy * dy)


def centre(e: Column) -> Column:
    return F.struct(((e["minx"] + e["maxx"]) / 2).alias("x"), ((e["miny"] + e["maxy"]) / 2).alias("y"))


def merged(e: Column) -> Column:
    """Aggregate: the smallest box around all."""
    return F.struct(F.min(e["minx"]).alias("minx"), F.min(e["miny"]).alias("miny"), F.max(e["maxx"]).alias("maxx"), F.max(e["maxy"]).alias("maxy"))
