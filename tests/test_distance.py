import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nighspark.operators.distance import distance_join, interval_join, self_distance_join, spatial_join

BOX = ("minx", "miny", "maxx", "maxy")


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double")


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, minx double, miny double, maxx double, maxy double")


def some_boxes(rng, n, wide=1.0):
    at = np.round(rng.uniform(-10, 10, (n, 2)), 1)
    size = np.round(rng.exponential(wide, (n, 2)), 1)
    return np.concatenate([at, at + size], 1)


def gap(a, b):
    dx, dy = max(0.0, a[0] - b[2], b[0] - a[2]), max(0.0, a[1] - b[3], b[1] - a[3])
    return math.sqrt(dx * dx + dy * dy)


def ids(df):
    return sorted((r[0], r[1]) for r in df.select("id", "id_right").collect())


@pytest.mark.parametrize("d", [0.0, 0.3, 2.5])
@pytest.mark.parametrize("cell", [None, 0.5, 4.0])
def test_points_match_brute_force(spark, d, cell):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.uniform(-5, 5, (70, 2)), 1), np.round(rng.uniform(-5, 5, (60, 2)), 1)
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) <= d)
    assert ids(distance_join(points(spark, a), points(spark, b), d, cell=cell)) == want


@pytest.mark.parametrize("wide", [0.5, 5.0])
@pytest.mark.parametrize("d", [0.0, 1.3])
def test_boxes_of_any_size_match_brute_force(spark, wide, d):
    rng = np.random.default_rng(2)
    a, b = some_boxes(rng, 50, wide), some_boxes(rng, 60, 0.4)
    b[0] = (-100, -100, 100, 100)  # one box over everything
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if gap(p, q) <= d)
    assert ids(distance_join(boxes(spark, a), boxes(spark, b), d, BOX, BOX)) == want
    assert ids(distance_join(boxes(spark, a), boxes(spark, b), d, BOX, BOX, cell=0.7)) == want


def test_exact_distance_is_inclusive(spark):
    a, b = points(spark, [(0.3, 0), (0.7, 0)]), points(spark, [(0.1, 0), (0.5, 0)])
    got = ids(distance_join(a, b, 0.3 - 0.1))
    assert got == [(0, 0), (1, 1)]


def test_join_kinds(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 5.0), (2, None, 1.0), (3, float("nan"), 1.0), (0, 0.0, 0.0)], "id long, x double, y double")
    b = points(spark, [(0, 1), (0, 0.5)])
    left = distance_join(a, b, 1.0, how="left")
    assert sorted((r.id, r.id_right) for r in left.where("id_right is not null").collect()) == [(0, 0), (0, 0), (0, 1), (0, 1)]
    assert sorted(r.id for r in left.where("id_right is null").collect()) == [1, 2, 3]
    assert [r.id for r in distance_join(a, b, 1.0, how="left_semi").collect()] == [0, 0]
    assert sorted(r.id for r in distance_join(a, b, 1.0, how="left_anti").collect()) == [1, 2, 3]


@pytest.mark.parametrize("how,n", [("inner", 0), ("left", 2), ("left_semi", 0), ("left_anti", 2)])
def test_empty_right_side(spark, how, n):
    a = points(spark, [(0, 0), (1, 1)])
    assert distance_join(a, a.limit(0), 1.0, how=how).count() == n
    assert distance_join(a.limit(0), a, 1.0, how=how).count() == 0


def test_all_at_one_point_and_one_row(spark):
    a = points(spark, [(2, 2)] * 12)
    assert distance_join(a, a, 0.0).count() == 144
    assert distance_join(points(spark, [(2, 2)]), a, 0.0).count() == 12


def test_bad_arguments(spark):
    a = points(spark, [(0, 0)])
    with pytest.raises(ValueError):
        distance_join(a, a, -1.0)
    with pytest.raises(ValueError):
        distance_join(a, a, 1.0, how="outer")
    with pytest.raises(ValueError):
        spatial_join(a, a, "near")


def test_self_join_options(spark):
    a = points(spark, [(0, 0), (0.5, 0), (9, 9)])
    assert self_distance_join(a, 1.0).count() == 5
    assert self_distance_join(a, 1.0, include_self=False).count() == 2
    assert ids(self_distance_join(a, 1.0, key="id", include_self=False, ordered=False)) == [(0, 1)]
    assert ids(self_distance_join(a, 1.0, key="id", ordered=False)) == [(0, 0), (0, 1), (1, 1), (2, 2)]


def test_shapes_against_points_and_predicate_hook(spark):
    from nighspark.functions.st import st_from_wkt

    shapes = spark.createDataFrame([(0, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"), (1, "LINESTRING (0 10, 10 10)"), (2, None), (3, "POINT EMPTY")], "id long, wkt string").withColumn("g", st_from_wkt(F.col("wkt")))
    pts = points(spark, [(2, 2), (0.5, 0.5), (5, 11), (4, 4)])
    assert ids(spatial_join(shapes, pts, "intersects", "g", ("x", "y"))) == [(0, 1), (0, 3)]
    assert ids(spatial_join(shapes, pts, "contains", "g", ("x", "y"))) == [(0, 1)]
    assert ids(distance_join(shapes, pts, 1.0, "g", ("x", "y"))) == [(0, 0), (0, 1), (0, 3), (1, 2)]
    assert ids(distance_join(shapes, pts, 1.0, "wkt", ("x", "y"))) == [(0, 0), (0, 1), (0, 3), (1, 2)]


    never = F.pandas_udf(lambda a, b: a.isna(), "boolean")
    assert spatial_join(shapes, pts, never, "g", ("x", "y")).count() == 0


def test_interval_join(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 3, 10, 1, 0) + dt.timedelta(minutes=m)
    a = spark.createDataFrame([(0, at(0), at(10)), (1, at(100), at(100)), (2, at(5), None)], "id long, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame([(0, at(10), at(12)), (1, at(11), at(500)), (2, at(-9), at(-1))], "id long, s timestamp_ntz, e timestamp_ntz")
    assert ids(interval_join(a, b, ("s", "e"), ("s", "e"))) == [(0, 0), (1, 1)]
    assert ids(interval_join(a, b, ("s", "e"), ("s", "e"), delta_ms=60_000)) == [(0, 0), (0, 1), (0, 2), (1, 1)]


def test_plan_has_no_cartesian_product(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = points(spark, np.random.default_rng(3).uniform(0, 1, (50, 2)))
        plan = distance_join(a, a, 0.1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("name", ["contains", "within", "covers", "covered_by", "touches", "crosses", "overlaps", "equals"])
def test_box_predicates_match_exact_geometry(spark, name):
    from nighspark.functions import geometry as G

    def shape(x0, y0, x1, y1):
        if x0 == x1 and y0 == y1:
            return G.from_wkt(f"POINT ({x0} {y0})")
        if x0 == x1 or y0 == y1:
            return G.from_wkt(f"LINESTRING ({x0} {y0}, {x1} {y1})")
        return G.from_wkt(f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))")

    rng = np.random.default_rng(12)
    at = rng.integers(0, 4, (70, 2))
    rows = np.concatenate([at, at + rng.integers(0, 3, (70, 2))], 1).astype(float)  # points, lines and solid boxes
    shapes = [shape(*r) for r in rows.tolist()]
    want = sorted((i, j) for i, p in enumerate(shapes) for j, q in enumerate(shapes) if G.test(name, p, q))
    assert ids(spatial_join(boxes(spark, rows), boxes(spark, rows), name, BOX, BOX)) == want and want


def test_equal_points_beside_a_far_one(spark):
    rows = [(0, 0), (0, 0), (1e-9, 0), (1e9, 1e9), (-0.0, 0)]
    assert ids(distance_join(points(spark, rows), points(spark, rows), 0.0)) == sorted((i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if p == q)


def test_flat_boxes_make_flat_cells():
    from types import SimpleNamespace

    from nighspark.operators.distance import _sides_of_cell

    side = SimpleNamespace(n=10, w=40.0, h=2.0, minx=0.0, miny=0.0, maxx=1000.0, maxy=100.0)
    assert _sides_of_cell(side, side, 0.0) == (40.0, 2.0) and _sides_of_cell(side, side, 3.0) == (40.0, 6.0)


@pytest.mark.parametrize("name", ["intersects", "contains", "covered_by", "touches", "crosses", "overlaps", "equals"])
def test_shapes_that_fill_their_envelopes_beside_others(spark, name):
    from nighspark.functions import geometry as G
    from tests.test_geometry import _some

    rng = np.random.default_rng(8)
    shapes = _some(rng)
    rows = lambda held: spark.createDataFrame([(i, G.to_wkt(g)) for i, g in held], "id long, g string")
    left, right = list(enumerate(shapes[::3])), list(enumerate(shapes[::4]))
    want = sorted((i, j) for i, a in left for j, b in right if G.test(name, a, b))
    assert ids(spatial_join(rows(left), rows(right), name, "g", "g")) == want


def test_boxes_drawn_as_shapes_are_compared_in_the_jvm(spark):
    from nighspark.functions.st import st_from_wkt
    from nighspark.plans.shared import checkpointed

    at = np.random.default_rng(9).integers(0, 9, (40, 2)).tolist()
    texts = [(i, f"POLYGON (({x} {y}, {x + 3} {y}, {x + 3} {y + 1}, {x} {y + 1}, {x} {y}))") for i, (x, y) in enumerate(at)]
    shapes = checkpointed(spark.createDataFrame(texts, "id long, t string").select("id", st_from_wkt(F.col("t")).alias("g")))
    out = spatial_join(shapes, shapes, "overlaps", "g", "g")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert ids(out) == [(i, j) for i, (x, y) in enumerate(at) for j, (u, v) in enumerate(at) if (x, y) != (u, v) and y == v and abs(x - u) < 3]


@pytest.mark.parametrize("d", [None, 0.5])
@pytest.mark.parametrize("together", [256, 3])
def test_copies_of_boxes_go_through_the_join_together(spark, monkeypatch, d, together):
    from nighspark.operators import distance

    monkeypatch.setattr(distance, "TOGETHER", together)
    rng = np.random.default_rng(5)
    a, b = np.tile(some_boxes(rng, 40), (9, 1)), np.concatenate([np.tile(some_boxes(rng, 30), (6, 1)), some_boxes(rng, 5)])
    join = lambda l, r: spatial_join(l, r, "overlaps", BOX, BOX) if d is None else distance_join(l, r, d, BOX, BOX)
    out = join(boxes(spark, a), boxes(spark, b))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__lrows" in plan and "lambdafunction" in plan
    got = ids(out)
    monkeypatch.setattr(distance, "COPIES", 1000)
    plain = join(boxes(spark, a), boxes(spark, b))
    assert out.schema == plain.schema and got == ids(plain)
    if d is not None:
        assert got == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if gap(p, q) <= d)


def framed(spark, copies=1):
    """Frames (rectangles with a rectangle as a hole) and points, several of each of one place, and what they hold."""
    rng = np.random.default_rng(14)
    at, spots = np.tile(rng.integers(0, 20, (30, 2)), (copies, 1)).tolist(), np.tile(rng.integers(0, 24, (40, 2)), (copies, 1)).tolist()
    ring = lambda a, b, c, d: f"({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b})"
    frames = spark.createDataFrame([(i, f"POLYGON ({ring(x, y, x + 6, y + 6)}, {ring(x + 2, y + 2, x + 4, y + 4)})") for i, (x, y) in enumerate(at)], "id long, g string")
    held = [(i, j) for i, (x, y) in enumerate(at) for j, (u, v) in enumerate(spots) if x < u < x + 6 and y < v < y + 6 and not (x + 2 <= u <= x + 4 and y + 2 <= v <= y + 4)]
    return frames, spark.createDataFrame([(i, f"POINT ({u} {v})") for i, (u, v) in enumerate(spots)], "id long, g string"), held


@pytest.mark.parametrize("together", [256, 3])
def test_copies_of_shapes_go_through_the_join_together(spark, monkeypatch, together):
    """What is tested in Python is pairs of shapes, not of rows, and no side is broadcast by what its files suggest."""
    from nighspark.functions.st import st_from_wkt
    from nighspark.operators import distance

    monkeypatch.setattr(distance, "TOGETHER", together)
    frames, spots, held = framed(spark, 7)
    out = spatial_join(frames, spots.select(st_from_wkt(F.col("g")).alias("g"), "id"), "contains", "g", "g")
    plan = out._jdf.queryExecution().toString()
    assert "__lrows" in plan and "__rrows" in plan and "Broadcast" not in plan
    assert ids(out) == held and out.columns == ["id", "g", "g_right", "id_right"]
    text = {r["id"]: r["g"] for r in frames.collect()}
    assert all(r["g"] == text[r["id"]] for r in out.collect())
    assert spatial_join(frames.select("g"), spots.select("g"), "contains", "g", "g").count() == len(held)
    near = distance_join(frames, spots, 0.0, "g", "g")
    assert near.count() == len(near.select("id", "id_right").distinct().collect()) > len(held)


def test_shapes_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    frames, spots, held = framed(spark)
    frames.write.parquet(str(tmp_path / "frames"))
    spots.write.parquet(str(tmp_path / "spots"))
    out = spatial_join(*(spark.read.parquet(str(tmp_path / name)) for name in ("frames", "spots")), "contains", "g", "g")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert ids(out) == held


def test_copies_of_parts_meet_copies_of_boxes(spark):
    """Geometries of two rectangles against rectangles, several of each of one place: pairs of shapes are tested once."""
    from nighspark.operators import distance

    rng = np.random.default_rng(15)
    at, to = np.tile(rng.integers(0, 30, (25, 2)), (8, 1)).tolist(), np.tile(rng.integers(0, 40, (35, 2)), (8, 1)).tolist()
    ring = lambda x, y: f"(({x} {y}, {x + 2} {y}, {x + 2} {y + 1}, {x} {y + 1}, {x} {y}))"
    twins = spark.createDataFrame([(i, f"MULTIPOLYGON ({ring(x, y)}, {ring(x + 10, y)})") for i, (x, y) in enumerate(at)], "id long, g string")
    plain = spark.createDataFrame([(i, f"POLYGON {ring(x, y)}") for i, (x, y) in enumerate(to)], "id long, g string")
    _, pairs, _, _ = distance._candidates(twins, plain, "g", "g", 0.0, None, False, True)
    assert pairs.count() <= 25 * 35
    got = ids(spatial_join(twins, plain, "intersects", "g", "g"))
    assert got == [(i, j) for i, (x, y) in enumerate(at) for j, (u, v) in enumerate(to) if abs(y - v) <= 1 and (abs(x - u) <= 2 or abs(x + 10 - u) <= 2)]
