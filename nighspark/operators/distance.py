"""Distance and predicate joins as grid equi-joins.

Each side's envelope (the left one widened by the distance) is exploded over the cells of a grid it meets; the sides
join on the cell, and a pair counts only in the cell that holds the lower corner of the common box, so none is lost or
doubled and no distinct is needed. A cell is as wide and as high as boxes are on the mean, so flat boxes make flat cells.
Large boxes go to coarser grids, so no row meets more than a few cells however the sizes vary. Shapes that fill their
envelopes are compared by these, in the JVM; others are tested exactly by a vectorised function on what is left.
Where many rows share an envelope or a shape, they go through an inner join as one row and are told apart again in the pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nighspark.functions.geometry import PREDICATES
from nighspark.functions.st import wkb_fills_box, wkb_predicate
from nighspark.plans.geoms import BOX, ENVELOPE, POINT, SHAPE, exact, gap, payload, shape, side, stats
from nighspark.plans.shared import COPIES, TOGETHER, checkpointed, together, with_row_id

HOW = ("inner", "left", "left_semi", "left_anti")


def _sides_of_cell(l, r, distance: float) -> tuple[float, float]:
    """Width and height of a cell of the finest grid."""
    far = max(abs(x) for x in (l.minx, l.miny, l.maxx, l.maxy, r.minx, r.miny, r.maxx, r.maxy))

    def side_along(mean: float, span: float) -> float:
        cell = max(2 * distance, mean)
        if cell <= 0:
            cell = span / math.sqrt(max(l.n, r.n, 1)) or 1.0
        return max(cell, (far + distance) * 2.0**-50, 1e-300)

    return (
        side_along(max(l.w or 0, r.w or 0), max(l.maxx - l.minx, r.maxx - r.minx)),
        side_along(max(l.h or 0, r.h or 0), max(l.maxy - l.miny, r.maxy - r.miny)),
    )


def _level(prefix: str, cell: tuple[float, float]) -> Column:
    size = F.greatest(*((F.col(f"{prefix}max{axis}") - F.col(f"{prefix}min{axis}")) / c for axis, c in zip("xy", cell)))
    return F.ceil(F.log2(F.greatest(size, F.lit(1.0)))).cast("int")


def _celled(df: DataFrame, prefix: str, cell: tuple[float, float], own: list[int], other: list[int], point: bool) -> DataFrame:
    """df exploded over (level, cx, cy): its own level and the other side's coarser ones."""
    lvl = f"{prefix}level"
    if own == other == [0]:
        df = df.withColumn(lvl, F.lit(0)).withColumn("level", F.lit(0))
        width = [F.lit(c) for c in cell]
    else:
        df = df.withColumn(lvl, _level(prefix, cell) if len(own) > 1 or own[0] else F.lit(0))
        levels = F.array_distinct(F.concat(F.array(F.col(lvl)), F.filter(F.array(*(F.lit(x) for x in other)), lambda x: x > F.col(lvl))))
        df = df.withColumn("level", F.explode(levels))
        width = [F.lit(c) * F.pow(F.lit(2.0), F.col("level")) for c in cell]
    at = lambda name: F.floor(F.col(f"{prefix}{name}") / width["xy".index(name[-1])]).cast("long")
    if point:
        return df.withColumn("cx", at("minx")).withColumn("cy", at("miny"))
    df = df.withColumn("cx", F.explode(F.sequence(at("minx"), at("maxx"))))
    return df.withColumn("cy", F.explode(F.sequence(at("miny"), at("maxy"))))


def _pairs(l: DataFrame, lk: str, r: DataFrame, rk: str, distance: float, cell: tuple[float, float], levels=([0], [0]), parts: int = 0) -> DataFrame:
    """Pairs whose envelopes lie within the distance, each once, in `parts` partitions if given. l's envelope must be widened already (to __w...)."""
    dealt = "level", "cx", "cy"
    left = _celled(l, "__w", cell, levels[0], levels[1], lk == POINT and distance == 0)
    right = _celled(r, "__r", cell, levels[1], levels[0], rk == POINT)
    if SHAPE in (lk, rk):
        parts = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts:
        # few rows make many pairs, tested in Python or told apart: adaptive execution would put them into a few tasks by their size;
        # merged, as what Spark takes for small by the files that were read may be too much for a broadcast
        left, right = left.repartition(parts, *dealt).hint("merge"), right.repartition(parts, *dealt)
    low = lambda axis: F.greatest(F.col(f"__wmin{axis}"), F.col(f"__rmin{axis}"))
    width = [F.lit(c) * F.pow(F.lit(2.0), left["level"]) if levels != ([0], [0]) else F.lit(c) for c in cell]
    on = (left["level"] == right["level"]) & (left["cx"] == right["cx"]) & (left["cy"] == right["cy"])
    box = (F.col("__rminx") <= F.col("__wmaxx")) & (F.col("__wminx") <= F.col("__rmaxx")) & (F.col("__rminy") <= F.col("__wmaxy")) & (F.col("__wminy") <= F.col("__rmaxy"))
    first = (left["cx"] == F.floor(low("x") / width[0])) & (left["cy"] == F.floor(low("y") / width[1]))
    if levels != ([0], [0]):
        first = first & (left["level"] == F.greatest("__wlevel", "__rlevel"))
    return left.join(right, on & box & first).drop(*dealt)


def _together(df: DataFrame, p: str, own: list[str]) -> tuple[DataFrame, bool]:
    """df with the rows of an envelope (and of what else tells shapes apart; own: their column) in arrays, as prefix + rows, and whether one has several arrays."""
    keys = [c for c in df.columns if not c.startswith(f"{p}c_") or c in own]
    return together(df, keys, F.struct(F.lit(True).alias(f"{p}held"), *(c for c in df.columns if c not in keys)), f"{p}rows", TOGETHER)


def _apart(pairs: DataFrame) -> DataFrame:
    """The pairs of rows in pairs of arrays made by _together."""
    held = [p for p in ("__l", "__r") if f"{p}rows" in pairs.columns]
    for p in held:
        # generated code would hold all pairs of rows that come of one row of the join; a lambda ends it, so that one pair's are held
        pairs = pairs.withColumn(f"{p}rows", F.filter(f"{p}rows", lambda x: x.isNotNull()))
    for p in held:
        pairs = pairs.withColumn(f"{p}row", F.explode(f"{p}rows")).drop(f"{p}rows").select("*", f"{p}row.*").drop(f"{p}row", f"{p}held")
    return pairs


def _candidates(left: DataFrame, right: DataFrame, left_geom, right_geom, distance: float, cell: float | None, row_id: bool, boxes: bool = False):
    """l, the pairs, and the kinds of both sides; pairs may be of arrays (see _apart); with boxes, __lbox and __rbox tell shapes that fill their envelopes, and
    sides of nothing else count as BOX."""
    l, lk = side(left, left_geom, "__l")
    r, rk = side(right, right_geom, "__r")
    if row_id:
        l = with_row_id(l, "__lid")
    all_boxes = [[], []]
    if boxes and SHAPE in (lk, rk):
        fills = lambda p, kind: wkb_fills_box(F.col(f"{p}wkb")) if kind == SHAPE else F.lit(True)
        l, r = l.withColumn("__lbox", fills("__l", lk)), r.withColumn("__rbox", fills("__r", rk))
        # what Python made of texts is not made again for the join
        l, r = (checkpointed(df) if kind == SHAPE else df for df, kind in ((l, lk), (r, rk)))
        all_boxes = [[F.bool_and(f"{p}box").alias("boxes")] for p in ("__l", "__r")]
    alike = lambda p, kind: [f"{p}wkb"] if kind == SHAPE else [f"{p}{n}" for n in ENVELOPE]
    places = [F.approx_count_distinct(F.xxhash64(*alike(p, kind))).alias("places") for p, kind in (("__l", lk), ("__r", rk))]
    ls, rs = stats(l, "__l", places[0], *all_boxes[0]), stats(r, "__r", places[1], *all_boxes[1])
    if not ls.n or not rs.n:
        return l, None, lk, rk
    if all_boxes[0] and ls.boxes and rs.boxes:
        lk, rk = (BOX if kind == SHAPE else kind for kind in (lk, rk))
        l, r = l.drop("__lwkb", "__lbox"), r.drop("__rwkb", "__rbox")
    point = lk == rk == POINT and not distance
    parts = 0
    if not row_id and not point:
        # which way is taken decides on speed only
        grouped = lambda df, p, s, kind, given, geom: _together(df, p, [f"{p}c_{given.columns.index(geom)}"] if kind == SHAPE else []) if s.n >= COPIES * s.places else (df, True)
        (l, split), (r, rsplit) = grouped(l, "__l", ls, lk, left, left_geom), grouped(r, "__r", rs, rk, right, right_geom)
        if not split and not rsplit:
            parts = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = max(abs(x) for x in (ls.minx, ls.miny, ls.maxx, ls.maxy, rs.minx, rs.miny, rs.maxx, rs.maxy))
    # a little more than the distance, so that no rounding of a bound loses a pair the exact test would keep
    pad = distance * (1 + 1e-9) + far * 2.0**-48 if distance else 0.0
    for n in ENVELOPE:
        l = l.withColumn(f"__w{n}", F.col(f"__l{n}") + (-pad if n.startswith("min") else pad))
    cell = (cell, cell) if cell else _sides_of_cell(ls, rs, pad)
    if point:
        # equal points, wherever they lie: no grid
        same = (F.col("__lminx") == F.col("__rminx")) & (F.col("__lminy") == F.col("__rminy"))
        return l, l.join(r, same), lk, rk
    levels = ([0], [0])
    if any(max(own + 2 * pad, other) > 2 * c for own, other, c in zip((ls.most_w, ls.most_h), (rs.most_w, rs.most_h), cell)):
        found = [sorted(x[0] for x in df.select(_level(p, cell)).distinct().collect()) for df, p in ((l, "__w"), (r, "__r"))]
        levels = tuple(found)
    return l, _pairs(l, lk, r, rk, pad, cell, levels, parts), lk, rk


def _finish(left: DataFrame, right: DataFrame, l: DataFrame, pairs: DataFrame | None, how: str, with_distance: bool, suffix: str) -> DataFrame:
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}")
    own, taken = payload(left, "__l"), set(left.columns)
    both = [*own, *payload(right, "__r", suffix, taken), *([F.col("__distance").alias("distance")] if with_distance else [])]
    if how in ("left_semi", "left_anti"):
        # rows without geometry match nothing, so an anti join keeps them
        if pairs is None:
            return left.limit(0) if how == "left_semi" else left
        met = pairs.select("__lid").distinct()
        kept = l.join(met, "__lid", how).select(*own)
        return kept if how == "left_semi" else kept.unionByName(_without(left, l))
    empty = [F.lit(None).cast(f.dataType).alias(f.name + suffix if f.name in taken else f.name) for f in right.schema] + ([F.lit(None).cast("double").alias("distance")] if with_distance else [])
    if pairs is None:
        out = left.select(*(F.col(f"`{c}`") for c in left.columns), *empty)
        return out if how == "left" else out.limit(0)
    if how == "inner":
        return pairs.select(*both)
    rest = l.join(pairs.select("__lid").distinct(), "__lid", "left_anti").select(*own, *empty)
    return pairs.select(*both).unionByName(rest).unionByName(_without(left, l).select(*(F.col(f"`{c}`") for c in left.columns), *empty))


def _without(left: DataFrame, l: DataFrame) -> DataFrame:
    """Rows of left whose geometry is missing; l knows how it was read."""
    return l._nighspark_missing


def distance_join(left: DataFrame, right: DataFrame, distance: float, left_geom=("x", "y"), right_geom=("x", "y"), how: str = "inner", with_distance: bool = True, cell: float | None = None, suffix: str = "_right") -> DataFrame:
    """Pairs of rows at most `distance` apart (inclusive); right columns whose name is taken get the suffix.

    Null, empty and non-finite geometries match nothing; equal rows are pairs of their own; empty sides give no pairs.
    """
    if not distance >= 0 or distance == float("inf"):
        raise ValueError("distance must be finite and not negative")
    l, pairs, lk, rk = _with_missing(left, right, left_geom, right_geom, distance, cell, how)
    if pairs is not None:
        if SHAPE in (lk, rk):
            pairs = pairs.where(gap("__l", "__r", lk, rk) <= distance)
        pairs = pairs.withColumn("__distance", exact("__l", "__r", lk, rk)).where(F.col("__distance") <= distance)
        pairs = _apart(pairs)
    return _finish(left, right, l, pairs, how, with_distance, suffix)


def _with_missing(left, right, left_geom, right_geom, distance, cell, how, boxes=False):
    l, pairs, lk, rk = _candidates(left, right, left_geom, right_geom, distance, cell, how != "inner", boxes)
    if how in ("left", "left_anti"):
        l._nighspark_missing = _missing(left, left_geom)
    return l, pairs, lk, rk


def _missing(df: DataFrame, geom) -> DataFrame:
    from nighspark.functions.st import st_from_wkb, st_from_wkt

    if isinstance(geom, (tuple, list)):
        env = [F.col(c) if isinstance(c, str) else c for c in geom]
    else:
        of = df.schema[geom].dataType.simpleString()
        read = st_from_wkt(F.col(geom)) if of == "string" else st_from_wkb(F.col(geom)) if of == "binary" else F.col(geom)
        env = [read[n] for n in ENVELOPE]
    whole = F.lit(True)
    for e in env:
        whole = whole & F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False))
    return df.where(~whole)


def spatial_join(left: DataFrame, right: DataFrame, predicate="intersects", left_geom=("x", "y"), right_geom=("x", "y"), how: str = "inner", cell: float | None = None, suffix: str = "_right") -> DataFrame:
    """Pairs whose envelopes meet and for which the predicate holds.

    predicate: intersects, contains, within, covers, covered_by, touches, crosses, overlaps, equals (left first), or a
    vectorised function of two binary-form columns that gives booleans.
    """
    l, pairs, lk, rk = _with_missing(left, right, left_geom, right_geom, 0.0, cell, how, not callable(predicate))
    if pairs is not None:
        if callable(predicate):
            pairs = pairs.where(predicate(shape("__l", lk), shape("__r", rk)))
        elif predicate not in PREDICATES:
            raise ValueError(f"unknown predicate {predicate!r}; known: {', '.join(PREDICATES)}")
        elif SHAPE in (lk, rk):
            both = F.col("__lbox") & F.col("__rbox")
            tested = wkb_predicate(predicate)(*(F.when(~both, shape(p, kind)) for p, kind in (("__l", lk), ("__r", rk))))
            pairs = pairs.where(_envelope_test(predicate)).where(F.when(both, _box_predicate(predicate)).otherwise(tested))
        else:
            pairs = pairs.where(_box_predicate(predicate))
        pairs = _apart(pairs)
    return _finish(left, right, l, pairs, how, False, suffix)


def _envelope_test(name: str) -> Column:
    """What the predicate asks of envelopes that meet, whatever the shapes: one that holds another holds its envelope."""
    holds, held = _holds("l", "r"), _holds("r", "l")
    return {"contains": holds, "covers": holds, "within": held, "covered_by": held, "equals": holds & held}.get(name, F.lit(True))


def _holds(p: str, q: str) -> Column:
    c = lambda p, n: F.col(f"__{p}{n}")
    return (c(p, "minx") <= c(q, "minx")) & (c(q, "maxx") <= c(p, "maxx")) & (c(p, "miny") <= c(q, "miny")) & (c(q, "maxy") <= c(p, "maxy"))


def _box_predicate(name: str) -> Column:
    """The named predicate for points and boxes (of any width and height, zero too), as comparisons.

    Boxes are products of closed intervals, so inner parts (a point's or a line's too) meet if they do on both axes.
    """
    c = lambda p, n: F.col(f"__{p}{n}")
    flat = lambda p, axis: c(p, f"min{axis}") == c(p, f"max{axis}")
    open_ = lambda axis: F.when(flat("l", axis) & flat("r", axis), c("l", f"min{axis}") == c("r", f"min{axis}")).otherwise((c("l", f"min{axis}") < c("r", f"max{axis}")) & (c("r", f"min{axis}") < c("l", f"max{axis}")))
    dim = lambda p: F.when(flat(p, "x"), 0).otherwise(1) + F.when(flat(p, "y"), 0).otherwise(1)
    inner, covers, covered = open_("x") & open_("y"), _holds("l", "r"), _holds("r", "l")
    # of two lines: along one axis (they share a stretch) or across (they share a point)
    along = flat("l", "x") == flat("r", "x")
    a, b = dim("l"), dim("r")
    return {
        "intersects": F.lit(True),
        "covers": covers,
        "covered_by": covered,
        "equals": covers & covered,
        "contains": covers & inner,
        "within": covered & inner,
        "touches": ~inner,
        "overlaps": (a == b) & inner & ~covers & ~covered & ((a != 1) | along),
        "crosses": inner & F.when(a < b, ~covered).when(a > b, ~covers).otherwise((a == 1) & ~along),
    }[name]


def self_distance_join(df: DataFrame, distance: float, geom=("x", "y"), key: str | None = None, include_self: bool = True, ordered: bool = True, with_distance: bool = True, suffix: str = "_right", cell: float | None = None) -> DataFrame:
    """Pairs of rows of one table; by default both (a, b), (b, a) and (a, a).

    include_self=False leaves out (a, a), ordered=False gives each pair once (the smaller key left); both need a key,
    and one is made (fixed by a checkpoint) if none is given.
    """
    if include_self and ordered:
        return distance_join(df, df, distance, geom, geom, "inner", with_distance, cell, suffix)
    own = key or "__ns_id"
    rows = df if key else with_row_id(df, own)
    out = distance_join(rows, rows, distance, geom, geom, "inner", with_distance, cell, suffix)
    a, b = F.col(own), F.col(own + suffix)
    out = out.where((a <= b if include_self else a < b) if not ordered else a != b)
    return out if key else out.drop(own, own + suffix)


def interval_join(left: DataFrame, right: DataFrame, left_time: tuple[str, str], right_time: tuple[str, str], delta_ms: int = 0, suffix: str = "_right") -> DataFrame:
    """Pairs whose closed intervals meet, the left one widened by delta on both sides: the grid join in one dimension."""
    from nighspark.plans.times import time_side

    l = time_side(left, left_time, delta_ms)
    r = time_side(right, right_time, 0)
    zero = F.lit(0.0)
    geom = lambda: (F.col("__ns_lo").cast("double"), zero, F.col("__ns_hi").cast("double"), zero)
    # microseconds since 1970 are exact in a double up to the year 2255
    out = spatial_join(l, r, "intersects", geom(), geom(), suffix=suffix)
    return out.drop("__ns_lo", "__ns_hi", "__ns_lo" + suffix, "__ns_hi" + suffix)
