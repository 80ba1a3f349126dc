import pytest

from nighspark.operators.distance import distance_join
from nighspark.operators.knn import join_stats
from nighspark.sources.readers import read_points_csv, read_wkt_tsv, stats_line, write_stats
from nighspark.streaming.joins import stream_distance_join
from tests.test_distance import points


def test_point_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("0,7,1,2024-01-01 00:00:05,POINT (1.5 -2)\n0,7,2,2024-01-01 00:01:00,LINESTRING EMPTY\n0,8,3,,point(3 4e1)\n")
    rows = read_points_csv(spark, str(tmp_path / "p.csv"), time_field=3, id_field=2).orderBy("id").collect()
    assert [(r["id"], r["x"], r["y"], str(r["time"])) for r in rows] == [(1, 1.5, -2.0, "2024-01-01 00:00:05"), (2, None, None, "2024-01-01 00:01:00"), (3, 3.0, 40.0, "None")]


def test_shape_file(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("LINESTRING (0 0, 3 4)\t2024-01-01 00:00:00\t2024-01-01 01:00:00\nPOLYGON ((0 0, 1 0, 1 1, 0 0))\t2024-01-02 00:00:00\t2024-01-02 00:00:00\n")
    rows = read_wkt_tsv(spark, str(tmp_path / "s.tsv")).select("geom.kind", "geom.maxx", "start", "end").orderBy("kind").collect()
    assert [(r["kind"], r["maxx"]) for r in rows] == [(2, 3.0), (3, 1.0)] and rows[0]["end"].hour == 1


def test_stats_sink(spark, tmp_path):
    a = points(spark, [(0, 0), (1, 1)])
    stats = join_stats(a, a, 1)
    write_stats(stats, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["pair_num"] == 2
    assert stats_line(stats) == "left_num:2;right_num:2;pair_num:2;hit_num:2;hit_rate:1.0"


def test_stream_against_table(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    fixed = points(spark, [(0.4, 0), (3, 3.5), (9, 9)])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_distance_join(stream, fixed, 1.0, 2.0).writeStream.format("memory").queryName("near").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = distance_join(df, fixed, 1.0).select("id", "id_right").collect()
    assert sorted(map(tuple, spark.sql("SELECT id, id_right FROM near").collect())) == sorted(map(tuple, want)) and want
    with pytest.raises(ValueError):
        stream_distance_join(stream, fixed, -1.0, 2.0)


def test_malformed_rows_give_null(spark, tmp_path):
    (tmp_path / "p.csv").write_text("0,7,a,no time,POINT (x y)\n0,7,2,2024-01-01 00:01:00,POINT (1 2)\n")
    rows = read_points_csv(spark, str(tmp_path / "p.csv"), time_field=3, id_field=2).select("id", "x", "y", "time").collect()
    assert [None] * 4 in [list(r) for r in rows] and len(rows) == 2
    (tmp_path / "s.tsv").write_text("POLYGON ((0 0, 1\t?\t2024-01-01 01:00:00\nPOINT (1 2)\t2024-01-02 00:00:00\t2024-01-02 00:00:00\n")
    rows = read_wkt_tsv(spark, str(tmp_path / "s.tsv")).select("geom.minx", "start").collect()
    assert sorted(r["minx"] is None for r in rows) == [False, True] and sum(r["start"] is None for r in rows) == 1
    from pyspark.sql import functions as F

    from nighspark.functions.st import st_from_wkb

    bad = spark.createDataFrame([(b"\x01\x02",), (None,), (b"",)], "d binary").select(st_from_wkb(F.col("d"))["minx"].alias("x")).collect()
    assert [r["x"] for r in bad] == [None] * 3
