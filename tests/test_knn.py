import datetime as dt

import numpy as np
import pytest

from nighspark.operators.knn import join_stats, knn_join, st_knn_join
from tests.test_distance import BOX, boxes, gap, points, some_boxes


def flat(df, right="id_right"):
    return sorted((r["id"], r["rank"], r[right], round(r["distance"], 9)) for r in df.collect())


def brute(a, b, k, eligible=lambda i, j: True):
    out = []
    for i, p in enumerate(a):
        near = sorted((gap(p, q), j) for j, q in enumerate(b) if eligible(i, j))[:k]
        out += [(i, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(near)]
    return sorted(out)


def as_boxes(p):
    return np.concatenate([p, p], 1)


@pytest.mark.parametrize("k", [1, 4, 40])
@pytest.mark.parametrize("seed", [0, 1])
def test_points(spark, k, seed):
    rng = np.random.default_rng(seed)
    a = np.concatenate([rng.normal(0, 1, (40, 2)), [[100, -50]]])
    b = np.concatenate([np.round(rng.normal(0, 0.3, (60, 2)), 1), rng.uniform(-80, 80, (15, 2))])  # a dense knot with ties, and far ones
    assert flat(knn_join(points(spark, a), points(spark, b), k)) == brute(as_boxes(a), as_boxes(b), k)


@pytest.mark.parametrize("wide", [0.3, 4.0])
def test_boxes(spark, wide):
    rng = np.random.default_rng(5)
    a, b = some_boxes(rng, 40, wide), some_boxes(rng, 50, wide)
    b[0] = (-200, -200, 5, 5)
    assert flat(knn_join(boxes(spark, a), boxes(spark, b), 3, BOX, BOX)) == brute(a, b, 3)


def test_same_place_and_more_than_there_are(spark):
    a, b = points(spark, [(1, 1), (2, 2)]), points(spark, [(1, 1)] * 5)
    assert [r[2] for r in flat(knn_join(a, b, 3)) if r[0] == 0] == [0, 1, 2]
    assert knn_join(a, b, 9).count() == 10
    assert knn_join(b, b, 2).count() == 10


def test_forms(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0), (1, None, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 0.0, "a"), (8, 2.0, 0.0, "b")], "key long, x double, y double, name string")
    rows = knn_join(a, b, 1, right_key="key", how="left").orderBy("id").collect()
    assert [(r["id"], r["key"]) for r in rows] == [(0, 7), (1, None)]
    nested = knn_join(a, b, 2, right_key="key", nested=True).orderBy("id").collect()
    assert [[n["key"] for n in r["neighbours"]] for r in nested] == [[7, 8], []]
    wide = knn_join(a, b, 1, right_key="key", columns=True).collect()
    assert wide[0].asDict() == {"id": 0, "x": 0.0, "y": 0.0, "key": 7, "x_right": 1.0, "y_right": 0.0, "name": "a", "distance": 1.0, "rank": 1}


def test_empty_sides(spark):
    a = points(spark, [(0, 0)])
    assert knn_join(a, a.limit(0), 2).count() == 0
    assert knn_join(a, a.limit(0), 2, how="left").count() == 1
    assert knn_join(a, a.limit(0), 2, nested=True).first()["neighbours"] == []
    assert knn_join(a.limit(0), a, 2).count() == 0
    with pytest.raises(ValueError):
        knn_join(a, a, 0)


START = dt.datetime(2024, 3, 31, 0, 0)


def timed(spark, rows, times):
    data = [(i, *map(float, r), START + dt.timedelta(seconds=int(s)), START + dt.timedelta(seconds=int(e))) for i, (r, (s, e)) in enumerate(zip(rows, times))]
    return spark.createDataFrame(data, "id long, minx double, miny double, maxx double, maxy double, s timestamp_ntz, e timestamp_ntz")


@pytest.mark.parametrize("delta", [0, 30, 2000, 100_000])
@pytest.mark.parametrize("seed", [0, 1])
def test_space_time(spark, delta, seed):
    rng = np.random.default_rng(seed)
    a, b = some_boxes(rng, 45), some_boxes(rng, 55)
    ta, tb = (np.stack([s, s + rng.integers(0, 300, len(s))], 1) for s in (rng.integers(0, 20000, 45), rng.integers(0, 20000, 55)))
    got = st_knn_join(timed(spark, a, ta), timed(spark, b, tb), 4, delta * 1000, ("s", "e"), ("s", "e"), BOX, BOX)
    assert flat(got) == brute(a, b, 4, lambda i, j: tb[j][0] <= ta[i][1] + delta and tb[j][1] >= ta[i][0] - delta)


def test_touching_times_and_left_rows_kept(spark):
    a = timed(spark, [(0, 0, 0, 0)] * 2, [(100, 100), (9000, 9000)])
    b = timed(spark, [(1, 0, 1, 0), (2, 0, 2, 0)], [(110, 120), (90, 90)])
    join = lambda ms, **k: st_knn_join(a, b, 5, ms, ("s", "e"), ("s", "e"), BOX, BOX, **k)
    assert len(flat(join(10_000))) == 2 and len(flat(join(9_999))) == 0
    assert [len(r["neighbours"]) for r in join(10_000, nested=True).orderBy("id").collect()] == [2, 0]
    assert sorted((r["id"], r["id_right"]) for r in join(9_999, how="left").collect()) == [(0, None), (1, None)]


def test_stats(spark):
    a, b = points(spark, [(0, 0), (1, 0), (2, 0)]), points(spark, [(0, 0), (5, 5)])
    assert join_stats(a, b, 2).first().asDict() == {"left_num": 3, "right_num": 2, "pair_num": 6, "hit_num": 3, "hit_rate": 1.0}
    assert join_stats(a, b.limit(0), 2).first()["pair_num"] == 0


def test_candidates_stay_near_the_answer(spark):
    """On uniform points the grid looks at a small share of all pairs."""
    from nighspark.operators import knn as K

    rng = np.random.default_rng(9)
    a, b = points(spark, rng.uniform(0, 1, (400, 2))), points(spark, rng.uniform(0, 1, (4000, 2)))
    seen = []
    plain = K._gathered
    try:
        K._gathered = lambda *x: seen.append(plain(*x)) or seen[-1]
        knn_join(a, b, 5).count()
    finally:
        K._gathered = plain
    assert seen[0].count() < 0.08 * 400 * 4000


def candidates(run):
    """Rows that the gathering phase of a join looks at."""
    from nighspark.operators import knn as K

    seen, plain = [], K._gathered
    try:
        K._gathered = lambda *x: seen.append(plain(*x)) or seen[-1]
        rows = flat(run())
    finally:
        K._gathered = plain
    return rows, seen[0].count()


def test_a_dense_city_and_a_far_row(spark):
    """Most rows in a billionth of the extent: the grid goes down to them."""
    rng = np.random.default_rng(10)
    city = lambda n: rng.normal(0, 1e-3, (n, 2))
    a, b = np.concatenate([city(200), [[9e5, 9e5]]]), np.concatenate([city(1500), [[1e6, 1e6], [-5e5, 3.0]]])
    got, looked = candidates(lambda: knn_join(points(spark, a), points(spark, b), 4))
    assert got == brute(as_boxes(a), as_boxes(b), 4)
    assert looked < 0.15 * len(a) * len(b)


def test_one_long_interval_among_short_ones(spark):
    rng = np.random.default_rng(11)
    a, b = some_boxes(rng, 60), some_boxes(rng, 80)
    ta, tb = (np.stack([s, s + rng.integers(0, 50, len(s))], 1) for s in (rng.integers(0, 200_000, 60), rng.integers(0, 200_000, 80)))
    tb[3], ta[5] = (0, 300_000_000), (1000, 40_000_000)
    got, looked = candidates(lambda: st_knn_join(timed(spark, a, ta), timed(spark, b, tb), 3, 40_000, ("s", "e"), ("s", "e"), BOX, BOX))
    assert got == brute(a, b, 3, lambda i, j: tb[j][0] <= ta[i][1] + 40 and tb[j][1] >= ta[i][0] - 40)


@pytest.mark.parametrize("reach", [400_000, 5_000_000])
def test_long_intervals_that_cover_short_windows(spark, reach):
    """Right rows that begin long before any window bound the radius all the same."""
    rng = np.random.default_rng(12)
    a, b = as_boxes(rng.uniform(0, 1, (80, 2))), as_boxes(rng.uniform(0, 1, (2000, 2)))
    ta = np.stack([s := rng.integers(0, 1000, 80), s + rng.integers(0, 30, 80)], 1)
    tb = np.stack([s := -rng.integers(0, reach, 2000), s + rng.integers(reach // 2, reach, 2000)], 1)
    got, looked = candidates(lambda: st_knn_join(timed(spark, a, ta), timed(spark, b, tb), 3, 5_000, ("s", "e"), ("s", "e"), BOX, BOX))
    assert got == brute(a, b, 3, lambda i, j: tb[j][0] <= ta[i][1] + 5 and tb[j][1] >= ta[i][0] - 5)
    assert looked < 0.1 * len(a) * len(b)


def test_left_keys_that_repeat(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 10.0), (1, 10.0, 10.0)], "id long, x double, y double")
    b = points(spark, [(0, 0), (1, 0), (10, 10), (9, 10)])
    rows = sorted((r["rank"], r["id_right"]) for r in knn_join(a, b, 2).collect())
    assert rows == sorted([(1, 0), (2, 1)] + [(1, 2), (2, 3)] * 2)
    assert join_stats(a, b, 2).first()["hit_num"] == 3
    for how in ({"nested": True}, {"columns": True}, {"how": "left"}):
        with pytest.raises(ValueError):
            knn_join(a, b, 2, **how).collect()


def test_run_stats(spark):
    from nighspark.operators.knn import run_stats

    a, b = points(spark, [(0, 0), (1, 0), (2, 0)]), points(spark, [(0, 0), (5, 5)])
    row = run_stats(a, b, 2).first()
    assert row["left_num"] == 3 and row["left_copy_num"] >= 3 and row["right_copy_rate"] == row["right_copy_num"] / 2 and row["total_time"] > 0
    assert run_stats(a, b.limit(0), 2).first()["left_copy_num"] == 0


def test_long_boxes_over_one_another(spark):
    """Right boxes lie over every place, so that neighbours are at distance 0 or little more."""
    rng = np.random.default_rng(31)
    lower = lambda n: rng.integers(0, [300, 30], (n, 2)).astype(float)
    a, b = lower(300), lower(2000)
    a, b = np.concatenate([a, a + (10, 2)], 1), np.concatenate([b, b + (40, 2)], 1)
    got, looked = candidates(lambda: knn_join(boxes(spark, a), boxes(spark, b), 3, BOX, BOX))
    assert got == brute(a, b, 3)
    assert looked < 300 * len(a)


@pytest.mark.parametrize("times", [False, True])
def test_rows_of_one_place_are_searched_once(spark, times):
    """Copies of left rows are one search; of right ones only the k smallest keys are looked at."""
    rng = np.random.default_rng(33)
    a, b = np.tile(some_boxes(rng, 30, 2.0), (6, 1)), np.tile(some_boxes(rng, 40, 2.0), (6, 1))
    if times:
        ta, tb = (np.tile(np.stack([s := rng.integers(0, 500, n), s + rng.integers(0, 90, n)], 1), (6, 1)) for n in (30, 40))
        run = lambda: st_knn_join(timed(spark, a, ta), timed(spark, b, tb), 3, 60_000, ("s", "e"), ("s", "e"), BOX, BOX)
        expected = brute(a, b, 3, lambda i, j: tb[j][0] <= ta[i][1] + 60 and tb[j][1] >= ta[i][0] - 60)
    else:
        run, expected = lambda: knn_join(boxes(spark, a), boxes(spark, b), 3, BOX, BOX), brute(a, b, 3)
    got, looked = candidates(run)
    assert got == expected
    assert looked <= 30 * 40 * 3


def test_many_left_rows_of_one_place_and_keys_that_are_null(spark):
    rows = [(i if i % 100 else None, 0.0, float(i % 2)) for i in range(1200)]
    a, b = spark.createDataFrame(rows, "id long, x double, y double"), points(spark, [(0, 0), (0, 1), (5, 5)] * 4)
    got = sorted((r["id"] or 0, r["rank"], r["id_right"]) for r in knn_join(a, b, 2).collect())
    assert got == sorted((i or 0, n + 1, int(y) + 3 * n) for i, _, y in rows for n in range(2))
    assert join_stats(a, b, 2).first().asDict() == {"left_num": 1200, "right_num": 12, "pair_num": 2400, "hit_num": 1200, "hit_rate": 1.0}
