"""Queries over the driver's tables, one or more for each operator, with the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nighspark.functions import envelope as E
from nighspark.functions import interval as I
from nighspark.functions.st import st_as_wkt, st_distance, st_from_wkb, st_from_wkt, st_as_wkb, st_point_wkt, st_point_x, st_point_y, wkb_distance
from nighspark.operators.distance import distance_join, interval_join, self_distance_join, spatial_join
from nighspark.operators.knn import join_stats, knn_join, run_stats, st_knn_join
from nighspark.plans.shared import own_folder
from nighspark.sources.readers import read_points_csv, read_wkt_tsv, stats_line, write_stats

Query = Callable[[SparkSession, str], DataFrame]
BOX = ("minx", "miny", "maxx", "maxy")
DAY_MS = 86_400_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir, kind=None):
    events = _table(spark, sf_dir, "events")
    return (events if kind is None else events.where(F.col("event_type") == kind)).select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), "ts")


def _events_sql(kind=None):
    where = "" if kind is None else f" WHERE event_type = '{kind}'"
    return f"(SELECT event_id AS id, value AS x, CAST(user_id AS DOUBLE) AS y, ts FROM events{where})"


def _customers(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


_CUSTOMERS = "(SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)"


def _suppliers(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))


_SUPPLIERS = "(SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)"


def _boxes(spark, sf_dir, large=None):
    """Parts as rectangles with whole-numbered corners: short ones (up to 25) or long ones."""
    part = _table(spark, sf_dir, "part")
    if large is not None:
        part = part.where(F.col("p_size") > 25 if large else F.col("p_size") <= 25)
    x, y = (F.col("p_partkey") * 37 % 1000).cast("double"), F.floor(F.col("p_retailprice") - 900).cast("double")
    return part.select(F.col("p_partkey").alias("id"), x.alias("minx"), y.alias("miny"), (x + F.col("p_size")).alias("maxx"), (y + 1 + F.col("p_size") % 3).alias("maxy"))


def _boxes_sql(large=None):
    where = "" if large is None else f" WHERE p_size {'> 25' if large else '<= 25'}"
    x, y = "CAST(p_partkey * 37 % 1000 AS DOUBLE)", "CAST(floor(p_retailprice - 900) AS DOUBLE)"
    return f"(SELECT p_partkey AS id, {x} AS minx, {y} AS miny, {x} + p_size AS maxx, {y} + 1 + p_size % 3 AS maxy FROM part{where})"


def _orders(spark, sf_dir, priority=None):
    o = _table(spark, sf_dir, "orders")
    o = o if priority is None else o.where(F.col("o_orderpriority") == priority)
    end = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 10).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"), F.col("o_orderdate").alias("s"), end.alias("e"))


def _orders_sql(priority=None):
    where = "" if priority is None else f" WHERE o_orderpriority = '{priority}'"
    return f"(SELECT o_orderkey AS id, o_totalprice / 1000 AS x, CAST(o_custkey % 100 AS DOUBLE) AS y, o_orderdate AS s, o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS e FROM orders{where})"


_HIGH, _URGENT = "2-HIGH", "1-URGENT"
_POINT_GAP = "sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y))"
_GX, _GY = "greatest(0.0, l.minx - r.maxx, r.minx - l.maxx)", "greatest(0.0, l.miny - r.maxy, r.miny - l.maxy)"
_BOX_GAP = f"sqrt({_GX} * {_GX} + {_GY} * {_GY})"
_MEET = "l.minx <= r.maxx AND r.minx <= l.maxx AND l.miny <= r.maxy AND r.miny <= l.maxy"
_OPEN = "l.minx < r.maxx AND r.minx < l.maxx AND l.miny < r.maxy AND r.miny < l.maxy"
_HOLDS = "l.minx <= r.minx AND r.maxx <= l.maxx AND l.miny <= r.miny AND r.maxy <= l.maxy"
_HELD = "r.minx <= l.minx AND l.maxx <= r.maxx AND r.miny <= l.miny AND l.maxy <= r.maxy"


def _ids(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("id").alias("l_id"), F.col("id_right").alias("r_id"), *more)


def _near(how="inner", d=1.5, **k):
    return lambda s, d_: distance_join(_events(s, d_, "view"), _events(s, d_, "purchase"), d, how=how, **k)


def _knn_sql(left, right, k, gap=_POINT_GAP, where="TRUE"):
    return f"SELECT l.id AS l_id, r.id AS r_id, round({gap}, 6) AS distance, CAST(row_number() OVER (PARTITION BY l.id ORDER BY {gap}, r.id) AS INTEGER) AS rank FROM {left} l, {right} r WHERE {where} QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY {gap}, r.id) <= {k}"


def _ranked(df: DataFrame) -> DataFrame:
    return _ids(df, F.round("distance", 6).alias("distance"), "rank")


def _knn(k):
    return lambda s, d: _ranked(knn_join(_events(s, d, "view"), _events(s, d, "purchase"), k))


def _shapes(boxes: DataFrame) -> DataFrame:
    corner = lambda x, y: F.concat(F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"))
    ring = F.concat_ws(", ", corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"))
    return boxes.select("id", st_from_wkt(F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).alias("g"))


def _predicate(name):
    return lambda s, d: _ids(spatial_join(_shapes(_boxes(s, d, False)), _shapes(_boxes(s, d, True)), name, "g", "g"))


def _corner(x: str, y: str):
    return F.concat(F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"))


def _ring(low: str = "minx", high: str = "maxx", bottom: str = "miny", top: str = "maxy"):
    return F.concat(F.lit("("), F.concat_ws(", ", _corner(low, bottom), _corner(high, bottom), _corner(high, top), _corner(low, top), _corner(low, bottom)), F.lit(")"))


def _drawn(boxes: DataFrame, kind: str, *parts) -> DataFrame:
    return boxes.select("id", st_from_wkt(F.concat(F.lit(f"{kind} ("), F.concat_ws(", ", *parts), F.lit(")"))).alias("g"))


def _frames(boxes: DataFrame) -> DataFrame:
    """Polygons around each rectangle, 4 wide, with the rectangle as a hole."""
    wide = boxes.withColumns({"ax": F.col("minx") - 4, "ay": F.col("miny") - 4, "bx": F.col("maxx") + 4, "by": F.col("maxy") + 4})
    return _drawn(wide, "POLYGON", _ring("ax", "bx", "ay", "by"), _ring())


def _twins(boxes: DataFrame) -> DataFrame:
    """Each rectangle and one 100 to the right of it as one geometry."""
    far = boxes.withColumns({"ax": F.col("minx") + 100, "bx": F.col("maxx") + 100})
    return _drawn(far, "MULTIPOLYGON", F.concat(F.lit("("), _ring(), F.lit(")")), F.concat(F.lit("("), _ring("ax", "bx"), F.lit(")")))


def _redrawn(boxes: DataFrame) -> DataFrame:
    """Rectangles drawn the other way round, with one corner more on a side."""
    mid = boxes.withColumn("mx", (F.col("minx") + F.col("maxx")) / 2)
    return _drawn(mid, "POLYGON", F.concat(F.lit("("), F.concat_ws(", ", _corner("maxx", "maxy"), _corner("maxx", "miny"), _corner("mx", "miny"), _corner("minx", "miny"), _corner("minx", "maxy"), _corner("maxx", "maxy")), F.lit(")")))


def _bottoms(boxes: DataFrame) -> DataFrame:
    return _drawn(boxes, "LINESTRING", _corner("minx", "miny"), _corner("maxx", "miny"))


def _shape_join(left, right, predicate):
    return lambda s, d: _ids(spatial_join(left(s, d), right(s, d), predicate, "g", "g"))


def _point_shapes(s, d):
    return _point_left(s, d).select("id", st_from_wkt(st_point_wkt("x", "y")).alias("g"))


def _point_file(s, d, timed):
    """Events as a point file, read again."""
    path = own_folder(s, "points")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    _events(s, d).select(F.lit("0"), F.col("y").cast("string"), F.col("id").cast("string"), stamp, st_point_wkt("x", "y")).toDF("a", "b", "c", "d", "e").write.csv(path)
    out = read_points_csv(s, path, time_field=3 if timed else None, id_field=2)
    return out.select("id", "x", "y", *(["time"] if timed else []))


def _shape_file(s, d):
    """Orders' places as lines with their times in a shape file, read again."""
    path = own_folder(s, "shapes")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.concat(F.lit("LINESTRING ("), _corner("x", "y"), F.lit(", "), F.concat((F.col("x") + 1).cast("string"), F.lit(" "), F.col("y").cast("string")), F.lit(")"))
    _orders(s, d).select(line.alias("a"), text("s").alias("b"), text("e").alias("c")).write.option("sep", "\t").option("quote", "").csv(path)
    out = read_wkt_tsv(s, path)
    return out.groupBy("start", "end").agg(F.count("*").alias("n"), F.round(F.min("geom.minx"), 6).alias("minx"), F.round(F.max("geom.maxx"), 6).alias("maxx"), F.max("geom.maxy").alias("maxy"))


def _sunk(s, d):
    path = own_folder(s, "stats")
    write_stats(_stats(s, d), path)
    return s.read.json(path).select("left_num", "right_num", "pair_num", "hit_num", "hit_rate")


def _line_of(s, d):
    return s.createDataFrame([(stats_line(_stats(s, d)),)], "line string")


def _run_stats(s, d):
    out = run_stats(_events(s, d, "view"), _events(s, d, "purchase"), 5, delta_ms=6 * 3_600_000, left_time="ts", right_time="ts")
    sent = lambda side: F.col(f"{side}_copy_num") > 0
    return out.select("left_num", "right_num", "pair_num", "hit_num", F.round("hit_rate", 6).alias("hit_rate"), (sent("left") & sent("right") & (F.col("total_time") > 0)).alias("counted"))


def _interval_tests(s, d):
    o = _orders(s, d).withColumns({"p": F.col("s") + F.make_dt_interval((F.col("id") % 4).cast("int")), "q": F.col("s") + F.make_dt_interval((F.col("id") % 13).cast("int"))})
    return o.select("id", I.contains(F.col("s"), F.col("e"), F.col("q")).alias("holds"), I.within(F.col("p"), F.col("q"), F.col("s"), F.col("e")).alias("inside"))


def _unions(s, d):
    own = F.struct(*BOX)
    u = E.union(own, E.envelope(*_FIXED))
    return _boxes(s, d).select("id", *(u[c].alias(c) for c in BOX), E.contains_point(own, F.lit(110.0), F.lit(30.0)).alias("holds"))


def _diagonals(boxes: DataFrame) -> DataFrame:
    """Each rectangle's diagonal from its lower corner as a line."""
    corner = lambda x, y: F.concat(F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"))
    return boxes.select("id", st_from_wkt(F.concat(F.lit("LINESTRING ("), corner("minx", "miny"), F.lit(", "), corner("maxx", "maxy"), F.lit(")"))).alias("g"))


#: The diagonal of l, at shares of its length, enters the inner part of r.
_ENTERS = """greatest(0.0, (r.minx - l.minx) / (l.maxx - l.minx), (r.miny - l.miny) / (l.maxy - l.miny))
    < least(1.0, (r.maxx - l.minx) / (l.maxx - l.minx), (r.maxy - l.miny) / (l.maxy - l.miny))"""


def _pairs_sql(left, right, on):
    return f"SELECT l.id AS l_id, r.id AS r_id FROM {left} l JOIN {right} r ON {on}"


def _micros(ms: int) -> str:
    return f"to_microseconds({ms * 1000})"


def _eligible(ms: int, s="s", e="e") -> str:
    return f"r.{s} <= l.{e} + {_micros(ms)} AND r.{e} >= l.{s} - {_micros(ms)}"


def _st(kind, k, ms, how="inner"):
    def run(s, d):
        if kind == "instants":
            out = st_knn_join(_events(s, d, "view"), _events(s, d, "purchase"), k, ms, "ts", "ts", how=how)
        else:
            out = st_knn_join(_orders(s, d, _URGENT), _orders(s, d, _HIGH), k, ms, ("s", "e"), ("s", "e"), how=how)
        return _ranked(out)

    return run


def _st_sql(kind, k, ms):
    if kind == "instants":
        return _knn_sql(_events_sql("view"), _events_sql("purchase"), k, where=_eligible(ms, "ts", "ts"))
    return _knn_sql(_orders_sql(_URGENT), _orders_sql(_HIGH), k, where=_eligible(ms))


def _point_left(spark, sf_dir):
    return _events(spark, sf_dir, "purchase")


def _dist_left(s, d):
    return _ids(_near("left", 0.2)(s, d), F.round("distance", 6).alias("distance"))


def _nested(s, d):
    out = knn_join(_events(s, d, "view"), _events(s, d, "purchase"), 5, nested=True)
    total = F.aggregate("neighbours", F.lit(0.0), lambda a, x: a + x["distance"])
    return out.select(F.col("id").alias("l_id"), F.size("neighbours").cast("long").alias("n"), F.round(total, 4).alias("total"), F.get("neighbours", F.lit(0))["id"].alias("nearest"))


def _extent(s, d):
    box = _boxes(s, d)
    e = E.merged(F.struct(*BOX))
    return box.agg(e.alias("e"), F.count("*").alias("n")).select("e.*", "n")


def _expanded(s, d):
    e = E.expand(F.struct(*BOX), 2.5)
    c = E.centre(F.struct(*BOX))
    return _boxes(s, d).select("id", e.alias("e"), c.alias("c")).select("id", "e.*", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


_FIXED = (100.0, 20.0, 220.0, 40.0)


def _against_fixed(s, d):
    own, fixed = F.struct(*BOX), E.envelope(*_FIXED)
    cut = E.intersection(own, fixed)
    return _boxes(s, d).select("id", F.round(E.distance(own, fixed), 6).alias("distance"), E.intersects(own, fixed).alias("meets"), E.contains(fixed, own).alias("held"), cut["minx"].alias("cut_minx"), cut["maxy"].alias("cut_maxy"))


def _reference(s, d):
    o = _orders(s, d)
    other_s = F.col("s") + F.make_dt_interval((F.col("id") % 7).cast("int"))
    other_e = other_s + F.make_dt_interval(F.lit(3))
    lo, hi = I.widened(F.col("s"), F.col("e"), DAY_MS)
    return o.select("id", I.reference_point(F.col("s"), F.col("e"), other_s, other_e).alias("at"), I.intersects(F.col("s"), F.col("e"), other_s, other_e).alias("meets"), lo.alias("lo"), hi.alias("hi"))


def _wkt(s, d):
    p = _events(s, d)
    text = st_point_wkt("x", "y")
    native = p.select("id", "x", "y", text.alias("wkt"))
    again = native.select("id", "wkt", "x", "y", st_from_wkb(st_as_wkb(st_from_wkt(F.col("wkt")))).alias("g"))
    return again.select("id", st_point_x("wkt").alias("x"), st_point_y("wkt").alias("y"), F.col("g")["minx"].alias("gx"), F.col("g")["maxy"].alias("gy"), st_point_x(st_as_wkt("g")).alias("tx"))


def _shape_distance(s, d):
    """Part rectangles as polygons against purchase points as text: the shape path of the distance join."""
    points = _point_left(s, d).select("id", st_from_wkt(st_point_wkt("x", "y")).alias("g"))
    return _ids(distance_join(_shapes(_boxes(s, d, False)), points, 1.0, "g", "g"), F.round("distance", 6).alias("distance"))


def _scalar_distance(s, d):
    """Each part's rectangle as a polygon against one fixed line."""
    line = st_from_wkt(F.lit("LINESTRING (100 20, 220 20)"))
    return _shapes(_boxes(s, d)).select("id", F.round(st_distance(F.col("g"), line), 6).alias("distance"))


def _stats(s, d):
    return join_stats(_events(s, d, "view"), _events(s, d, "purchase"), 5, delta_ms=6 * 3_600_000, left_time="ts", right_time="ts").withColumn("hit_rate", F.round("hit_rate", 6))


_HOURS = 3_600_000
_CASES: dict[str, tuple[Query, str]] = {
    "dist_join_points": (lambda s, d: _ids(_near()(s, d)), _pairs_sql(_events_sql("view"), _events_sql("purchase"), f"{_POINT_GAP} <= 1.5")),
    "dist_join_with_distance": (
        lambda s, d: _ids(_near()(s, d), F.round("distance", 6).alias("distance")),
        f"SELECT l.id AS l_id, r.id AS r_id, round({_POINT_GAP}, 6) AS distance FROM {_events_sql('view')} l JOIN {_events_sql('purchase')} r ON {_POINT_GAP} <= 1.5",
    ),
    "dist_join_boxes": (lambda s, d: _ids(distance_join(_boxes(s, d, False), _boxes(s, d, True), 3.0, BOX, BOX)), _pairs_sql(_boxes_sql(False), _boxes_sql(True), f"{_BOX_GAP} <= 3.0")),
    "dist_join_shapes": (_shape_distance, f"SELECT l.id AS l_id, r.id AS r_id, round({_BOX_GAP}, 6) AS distance FROM {_boxes_sql(False)} l JOIN (SELECT id, x AS minx, y AS miny, x AS maxx, y AS maxy FROM {_events_sql('purchase')}) r ON {_BOX_GAP} <= 1.0"),
    "dist_self_join": (lambda s, d: _ids(self_distance_join(_customers(s, d), 0.5)), _pairs_sql(_CUSTOMERS, _CUSTOMERS, f"{_POINT_GAP} <= 0.5")),
    "dist_self_join_distinct": (lambda s, d: _ids(self_distance_join(_customers(s, d), 0.5, key="id", include_self=False, ordered=False)), _pairs_sql(_CUSTOMERS, _CUSTOMERS, f"{_POINT_GAP} <= 0.5 AND l.id < r.id")),
    "dist_left_outer": (_dist_left, f"SELECT l.id AS l_id, r.id AS r_id, round({_POINT_GAP}, 6) AS distance FROM {_events_sql('view')} l LEFT JOIN {_events_sql('purchase')} r ON {_POINT_GAP} <= 0.2"),
    "dist_semi": (lambda s, d: _near("left_semi", 0.2)(s, d).select("id"), f"SELECT id FROM {_events_sql('view')} l WHERE EXISTS (SELECT 1 FROM {_events_sql('purchase')} r WHERE {_POINT_GAP} <= 0.2)"),
    "dist_anti": (lambda s, d: _near("left_anti", 0.2)(s, d).select("id"), f"SELECT id FROM {_events_sql('view')} l WHERE NOT EXISTS (SELECT 1 FROM {_events_sql('purchase')} r WHERE {_POINT_GAP} <= 0.2)"),
    "intersects_points_boxes": (lambda s, d: _ids(spatial_join(_point_left(s, d), _boxes(s, d), "intersects", ("x", "y"), BOX)), _pairs_sql(_events_sql("purchase"), _boxes_sql(), "r.minx <= l.x AND l.x <= r.maxx AND r.miny <= l.y AND l.y <= r.maxy")),
    "intersects_boxes": (lambda s, d: _ids(spatial_join(_boxes(s, d, False), _boxes(s, d, True), "intersects", BOX, BOX)), _pairs_sql(_boxes_sql(False), _boxes_sql(True), _MEET)),
    "contains_box_point": (lambda s, d: _ids(spatial_join(_boxes(s, d), _point_left(s, d), "contains", BOX, ("x", "y"))), _pairs_sql(_boxes_sql(), _events_sql("purchase"), "l.minx < r.x AND r.x < l.maxx AND l.miny < r.y AND r.y < l.maxy")),
    "within_point_box": (lambda s, d: _ids(spatial_join(_point_left(s, d), _boxes(s, d), "within", ("x", "y"), BOX)), _pairs_sql(_events_sql("purchase"), _boxes_sql(), "r.minx < l.x AND l.x < r.maxx AND r.miny < l.y AND l.y < r.maxy")),
    "pred_intersects": (_predicate("intersects"), _pairs_sql(_boxes_sql(False), _boxes_sql(True), _MEET)),
    "pred_contains": (_predicate("contains"), _pairs_sql(_boxes_sql(False), _boxes_sql(True), _HOLDS)),
    "pred_within": (_predicate("within"), _pairs_sql(_boxes_sql(False), _boxes_sql(True), _HELD)),
    "pred_covers": (_predicate("covers"), _pairs_sql(_boxes_sql(False), _boxes_sql(True), _HOLDS)),
    "pred_covered_by": (_predicate("covered_by"), _pairs_sql(_boxes_sql(False), _boxes_sql(True), _HELD)),
    "pred_touches": (_predicate("touches"), _pairs_sql(_boxes_sql(False), _boxes_sql(True), f"{_MEET} AND NOT ({_OPEN})")),
    "pred_overlaps": (_predicate("overlaps"), _pairs_sql(_boxes_sql(False), _boxes_sql(True), f"{_OPEN} AND NOT ({_HOLDS}) AND NOT ({_HELD})")),
    "pred_equals": (_predicate("equals"), _pairs_sql(_boxes_sql(False), _boxes_sql(True), f"{_HOLDS} AND {_HELD}")),
    "pred_crosses": (_predicate("crosses"), _pairs_sql(_boxes_sql(False), _boxes_sql(True), "FALSE")),
    "pred_crosses_lines": (
        lambda s, d: _ids(spatial_join(_diagonals(_boxes(s, d, False)), _shapes(_boxes(s, d, True)), "crosses", "g", "g")),
        _pairs_sql(_boxes_sql(False), _boxes_sql(True), f"{_ENTERS} AND NOT ({_HELD})"),
    ),
    "pred_contains_large": (_shape_join(lambda s, d: _shapes(_boxes(s, d, True)), lambda s, d: _shapes(_boxes(s, d, False)), "contains"), _pairs_sql(_boxes_sql(True), _boxes_sql(False), _HOLDS)),
    "pred_covers_large": (_shape_join(lambda s, d: _shapes(_boxes(s, d, True)), lambda s, d: _shapes(_boxes(s, d, False)), "covers"), _pairs_sql(_boxes_sql(True), _boxes_sql(False), _HOLDS)),
    "pred_equals_redrawn": (_shape_join(lambda s, d: _shapes(_boxes(s, d)), lambda s, d: _redrawn(_boxes(s, d)), "equals"), _pairs_sql(_boxes_sql(), _boxes_sql(), f"{_HOLDS} AND {_HELD}")),
    "pred_contains_holes": (
        _shape_join(lambda s, d: _frames(_boxes(s, d)), _point_shapes, "contains"),
        _pairs_sql(_boxes_sql(), _events_sql("purchase"), "l.minx - 4 < r.x AND r.x < l.maxx + 4 AND l.miny - 4 < r.y AND r.y < l.maxy + 4 AND NOT (l.minx <= r.x AND r.x <= l.maxx AND l.miny <= r.y AND r.y <= l.maxy)"),
    ),
    "pred_intersects_multi": (
        _shape_join(lambda s, d: _twins(_boxes(s, d, False)), lambda s, d: _shapes(_boxes(s, d, True)), "intersects"),
        _pairs_sql(_boxes_sql(False), _boxes_sql(True), "((l.minx <= r.maxx AND r.minx <= l.maxx) OR (l.minx + 100 <= r.maxx AND r.minx <= l.maxx + 100)) AND l.miny <= r.maxy AND r.miny <= l.maxy"),
    ),
    "pred_touches_lines": (
        _shape_join(lambda s, d: _bottoms(_boxes(s, d, False)), lambda s, d: _shapes(_boxes(s, d, True)), "touches"),
        _pairs_sql(_boxes_sql(False), _boxes_sql(True), "l.minx <= r.maxx AND r.minx <= l.maxx AND r.miny <= l.miny AND l.miny <= r.maxy AND NOT (l.minx < r.maxx AND r.minx < l.maxx AND r.miny < l.miny AND l.miny < r.maxy)"),
    ),
    "pred_own": (_shape_join(lambda s, d: _shapes(_boxes(s, d, False)), lambda s, d: _shapes(_boxes(s, d, True)), lambda a, b: wkb_distance(a, b) <= 0), _pairs_sql(_boxes_sql(False), _boxes_sql(True), _MEET)),
    **{
        f"box_{name}": ((lambda name: lambda s, d: _ids(spatial_join(_boxes(s, d, True), _boxes(s, d, False), name, BOX, BOX)))(name), _pairs_sql(_boxes_sql(True), _boxes_sql(False), on))
        for name, on in {"contains": _HOLDS, "touches": f"{_MEET} AND NOT ({_OPEN})", "overlaps": f"{_OPEN} AND NOT ({_HOLDS}) AND NOT ({_HELD})"}.items()
    },
    "box_within": (lambda s, d: _ids(spatial_join(_boxes(s, d, False), _boxes(s, d, True), "within", BOX, BOX)), _pairs_sql(_boxes_sql(False), _boxes_sql(True), _HELD)),
    "source_points": (lambda s, d: _point_file(s, d, False), f"SELECT id, x, y FROM {_events_sql()}"),
    "source_points_times": (lambda s, d: _point_file(s, d, True), f"SELECT id, x, y, ts AS time FROM {_events_sql()}"),
    "source_shapes": (_shape_file, f'SELECT s AS start, e AS "end", count(*) AS n, round(min(x), 6) AS minx, round(max(x + 1), 6) AS maxx, max(y) AS maxy FROM {_orders_sql()} GROUP BY s, e'),
    "knn_k1": (_knn(1), _knn_sql(_events_sql("view"), _events_sql("purchase"), 1)),
    "knn_k5": (_knn(5), _knn_sql(_events_sql("view"), _events_sql("purchase"), 5)),
    "knn_k15": (_knn(15), _knn_sql(_events_sql("view"), _events_sql("purchase"), 15)),
    "knn_self": (lambda s, d: _ranked(knn_join(_customers(s, d), _customers(s, d), 4)), _knn_sql(_CUSTOMERS, _CUSTOMERS, 4)),
    "knn_k_gt_right": (lambda s, d: _ranked(knn_join(_suppliers(s, d), _nations(s, d), 30)), _knn_sql(_SUPPLIERS, "(SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y FROM nation)", 30)),
    "knn_boxes": (lambda s, d: _ranked(knn_join(_boxes(s, d, False), _boxes(s, d, True), 5, BOX, BOX)), _knn_sql(_boxes_sql(False), _boxes_sql(True), 5, _BOX_GAP)),
    "knn_nested_counts": (
        _nested,
        f"SELECT l_id, count(*) AS n, round(sum(distance), 4) AS total, min(CASE WHEN rank = 1 THEN r_id END) AS nearest FROM ({_knn_sql(_events_sql('view'), _events_sql('purchase'), 5).replace(f'round({_POINT_GAP}, 6)', _POINT_GAP)}) GROUP BY l_id",
    ),
    "stknn_instants": (_st("instants", 5, 6 * _HOURS), _st_sql("instants", 5, 6 * _HOURS)),
    "stknn_intervals": (_st("intervals", 5, DAY_MS), _st_sql("intervals", 5, DAY_MS)),
    "stknn_wide": (_st("instants", 15, 240 * _HOURS), _st_sql("instants", 15, 240 * _HOURS)),
    "stknn_sparse": (_st("instants", 15, 5 * 60_000), _st_sql("instants", 15, 5 * 60_000)),
    "stknn_left": (
        _st("instants", 3, 5 * 60_000, "left"),
        f"SELECT a.id AS l_id, b.r_id, b.distance, b.rank FROM {_events_sql('view')} a LEFT JOIN ({_st_sql('instants', 3, 5 * 60_000)}) b ON a.id = b.l_id",
    ),
    "interval_join": (lambda s, d: _ids(interval_join(_orders(s, d, _URGENT), _orders(s, d, _HIGH), ("s", "e"), ("s", "e"))), _pairs_sql(_orders_sql(_URGENT), _orders_sql(_HIGH), "r.s <= l.e AND r.e >= l.s")),
    "join_stats": (
        _stats,
        f"""WITH p AS ({_st_sql('instants', 5, 6 * _HOURS)}), c AS (SELECT l_id, count(*) AS n FROM p GROUP BY l_id),
        a AS (SELECT (SELECT count(*) FROM {_events_sql('view')}) AS left_num, (SELECT count(*) FROM {_events_sql('purchase')}) AS right_num, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS pair_num, (SELECT count(*) FROM c WHERE n = 5) AS hit_num)
        SELECT *, round(hit_num / left_num, 6) AS hit_rate FROM a""",
    ),
    "stats_sink": (_sunk, "JOIN_STATS"),
    "stats_line": (_line_of, "SELECT concat('left_num:', left_num, ';right_num:', right_num, ';pair_num:', pair_num, ';hit_num:', hit_num, ';hit_rate:', hit_rate) AS line FROM (JOIN_STATS)"),
    "run_stats": (_run_stats, "SELECT *, TRUE AS counted FROM (JOIN_STATS)"),
    "interval_tests": (
        _interval_tests,
        f"SELECT id, s <= q AND q <= e AS holds, p > s AND q < e AS inside FROM (SELECT *, s + to_days(CAST(id % 4 AS INTEGER)) AS p, s + to_days(CAST(id % 13 AS INTEGER)) AS q FROM {_orders_sql()})",
    ),
    "envelope_union": (_unions, f"SELECT id, least(minx, 100.0) AS minx, least(miny, 20.0) AS miny, greatest(maxx, 220.0) AS maxx, greatest(maxy, 40.0) AS maxy, minx <= 110 AND 110 <= maxx AND miny <= 30 AND 30 <= maxy AS holds FROM {_boxes_sql()}"),
    "extent_stats": (_extent, f"SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS n FROM {_boxes_sql()}"),
    "envelope_expand": (_expanded, f"SELECT id, minx - 2.5 AS minx, miny - 2.5 AS miny, maxx + 2.5 AS maxx, maxy + 2.5 AS maxy, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM {_boxes_sql()}"),
    "envelope_distance": (
        _against_fixed,
        f"""SELECT id, round({_BOX_GAP}, 6) AS distance, {_MEET} AS meets, {_HELD} AS held, CASE WHEN {_MEET} THEN greatest(l.minx, r.minx) END AS cut_minx, CASE WHEN {_MEET} THEN least(l.maxy, r.maxy) END AS cut_maxy
        FROM {_boxes_sql()} l, (SELECT 100.0::DOUBLE AS minx, 20.0::DOUBLE AS miny, 220.0::DOUBLE AS maxx, 40.0::DOUBLE AS maxy) r""",
    ),
    "interval_reference_point": (
        _reference,
        f"""SELECT id, CASE WHEN s <= e2 AND s2 <= e THEN greatest(s, s2) END AS at, s <= e2 AND s2 <= e AS meets, s - {_micros(DAY_MS)} AS lo, e + {_micros(DAY_MS)} AS hi
        FROM (SELECT id, s, e, s + to_days(CAST(id % 7 AS INTEGER)) AS s2, s + to_days(CAST(id % 7 AS INTEGER)) + to_days(3) AS e2 FROM {_orders_sql()})""",
    ),
    "wkt_roundtrip": (_wkt, f"SELECT id, x, y, x AS gx, y AS gy, x AS tx FROM {_events_sql()}"),
    "shape_distance": (_scalar_distance, f"SELECT id, round({_BOX_GAP}, 6) AS distance FROM {_boxes_sql()} l, (SELECT 100.0::DOUBLE AS minx, 20.0::DOUBLE AS miny, 220.0::DOUBLE AS maxx, 20.0::DOUBLE AS maxy) r"),
}


def _nations(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.replace("JOIN_STATS", _CASES["join_stats"][1]) for name, (_, sql) in _CASES.items()}
