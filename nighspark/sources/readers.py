"""Readers of geometry text files and the sink for run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nighspark.functions.st import st_from_wkt, st_point_x, st_point_y


def read_points_csv(spark: SparkSession, path: str, geom_field: int = 4, time_field: int | None = None, n_fields: int = 5, id_field: int | None = None) -> DataFrame:
    """Points of a comma-separated file without header: x, y and, where asked for, id (long) and time, and the fields.

    A text that is no point gives null coordinates, which match nothing in a join; an id or time that is none gives null.
    """
    names = [f"f{i}" for i in range(n_fields)]
    out = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names))
    wkt = F.col(names[geom_field])
    point = wkt.rlike(r"(?i)^\s*POINT\s*\(\s*\S+\s+[^\s)]+\s*\)\s*$")
    made = {"x": F.when(point, st_point_x(wkt)), "y": F.when(point, st_point_y(wkt))}
    if time_field is not None:
        made["time"] = F.col(names[time_field]).try_cast("timestamp_ntz")
    if id_field is not None:
        made["id"] = F.col(names[id_field]).try_cast("long")
    return out.withColumns(made)


def read_wkt_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Geometries with an interval from a tab-separated file (text, start, end): geom, start, end, wkt; null what is malformed."""
    out = spark.read.csv(path, sep="\t", quote="", schema="wkt string, start string, end string")
    return out.select(st_from_wkt(F.col("wkt")).alias("geom"), F.col("start").try_cast("timestamp_ntz").alias("start"), F.col("end").try_cast("timestamp_ntz").alias("end"), "wkt")


def write_stats(stats: DataFrame, path: str) -> None:
    """One JSON file of a statistics row; overwrites."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def stats_line(stats: DataFrame) -> str:
    """name:value;… of a statistics row."""
    return ";".join(f"{k}:{v}" for k, v in stats.first().asDict().items())
