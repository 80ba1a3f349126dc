"""A stream of points joined with a fixed table by distance: the grid join without the pass for statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nighspark.operators.distance import _pairs
from nighspark.plans.geoms import ENVELOPE, exact, payload, side


def stream_distance_join(stream: DataFrame, table: DataFrame, distance: float, cell: float, stream_geom=("x", "y"), table_geom=("x", "y"), suffix: str = "_right") -> DataFrame:
    """Pairs of a stream's rows and a table's at most `distance` apart; cell is the side of the grid's cells.

    Stateless: every micro-batch joins on its own. Boxes and shapes of either side should not be many cells wide.
    """
    if not 0 <= distance < float("inf") or cell <= 0:
        raise ValueError("distance must be finite and not negative, cell positive")
    l, lk = side(stream, stream_geom, "__l")
    r, rk = side(table, table_geom, "__r")
    pad = distance * (1 + 1e-9) + cell * 2.0**-40
    for n in ENVELOPE:
        l = l.withColumn(f"__w{n}", F.col(f"__l{n}") + (-pad if n.startswith("min") else pad))
    pairs = _pairs(l, lk, r, rk, pad, (cell, cell)).withColumn("__distance", exact("__l", "__r", lk, rk)).where(F.col("__distance") <= distance)
    return pairs.select(*payload(stream, "__l"), *payload(table, "__r", suffix, set(stream.columns)), F.col("__distance").alias("distance"))
