"""Exact nearest-neighbour joins, plain and with a time tolerance.

The grid has as many levels (each a quarter of the cells above) as a bounded sample of the right side says the densest rows
need; levels on which nothing divides further are left out, so that a far row or a dense city costs a level, not a scan.

Phase A bounds each left row's radius. Right rows are counted in the finest cells and the counts rolled up through coarser
levels; any cell that holds a left row's centre and k right rows bounds the distance to its k-th neighbour by the cell's
diagonal (plus half-sizes for boxes and shapes). Left rows of a cell share that bound, so the search for it runs over cells,
not rows. With times, right rows count that start in time buckets wholly inside a left row's window, and long ones that
cover the bucket in which it begins (one bucket for each doubling of their length): a lower bound of those eligible. The
buckets' width doubles with the window's, so any window is a bounded number of them.

Of right boxes (without times) those count as well that meet the cell, of about their smaller side, of a left row's centre:
where long boxes lie over one another, that bound is far below one by centres and half-sizes.

Phase B gathers. A left row is exploded over the cells its circle meets, on the level where these are few; right rows
sit in one cell (that of their centre) of every level in use. Right rows are classed by half-size, so one huge geometry
widens the search only for its class. With times both sides also join on a time bucket whose width follows the longer of
the two intervals by doubling, and a pair counts only in the bucket of the later start, so one long interval costs few
rows. Left rows without a bound have fewer than k eligible right rows in the buckets inside their window; they join on time
alone (or, if there are fewer than k right rows at all, on the whole small right side).

Phase C ranks by distance, then right key, with row_number() <= k, which Spark turns into a per-group limit.

Where many rows share a geometry (and times), left ones have the same neighbours and go through all this as one row, and of
right ones only the k of the smallest keys can be among a row's neighbours, since ties go by the key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nighspark.plans.geoms import BOX, ENVELOPE, POINT, SHAPE, exact, gap, side, stats
from nighspark.plans.shared import COPIES, checkpointed, together
from nighspark.plans.times import window_of

MAX_LEVEL = 40
#: Counting buckets per typical window, and about how many buckets one window is summed from at most.
COUNT_SPLIT, MOST_BUCKETS = 8, 64
#: Mean lengths from which an interval counts as long and goes to wider buckets.
LONG = 4
#: Cells that a right box may meet to be counted in them.
MOST_CELLS = 64
#: Rows, about, from which the levels of the grid are chosen (two numbers each); they decide on speed, not on results.
SAMPLE = 100_000


def _levels(r: DataFrame, n: int, k: int, minx: float, miny: float, span: float) -> list[int]:
    """The levels of the grid: down to where a right row shares its cell with about 2k, without those that divide nothing."""
    import numpy as np

    share = min(1.0, SAMPLE / n)
    picked = r.select(((F.col("__rminx") + F.col("__rmaxx")) / 2).alias("x"), ((F.col("__rminy") + F.col("__rmaxy")) / 2).alias("y"), "__rkey")
    rows = picked.where(F.pmod(F.xxhash64("x", "y", "__rkey"), F.lit(1 << 30)) < share * (1 << 30)).select("x", "y").toArrow()
    if not len(rows):
        return [0]
    at = [np.clip(np.floor((rows[c].to_numpy() - low) / span * (1 << MAX_LEVEL)), 0, (1 << MAX_LEVEL) - 1).astype(np.int64) for c, low in (("x", minx), ("y", miny))]
    found, last = [0], None
    for level in range(MAX_LEVEL + 1):
        x, y = (v >> (MAX_LEVEL - level) for v in at)
        c = np.unique(x * 0x5851F42D4C957F2D + y, return_counts=True)[1].astype(float)  # products wrap
        beside = (c * (c - 1)).sum() / len(rows) / share + 1  # rows in the cell of a row, on the mean
        if last is not None and beside < 0.7 * last:
            found.append(level)
        last = beside if last is None or level == found[-1] else last
        if beside <= 2 * k or beside * share < 3:
            # where the sample is spent, what it cannot see is taken to be even
            more = math.ceil(math.log(max(1.0, beside / (2 * k)), 4))
            return sorted({*found, *range(level, min(MAX_LEVEL, level + more) + 1)})
    return sorted({*found, MAX_LEVEL}) if found != [0] else [0]


class _Grid:
    def __init__(self, minx: float, miny: float, span: float, levels: list[int]):
        self.minx, self.miny, self.span, self.levels, self.top = minx, miny, span or 1.0, levels, levels[-1]

    def cell(self, value, low: float, level=None):
        """Cell number at a level (column or number; the finest by default), kept within the grid."""
        n = F.lit(float(1 << self.top)) if level is None else F.pow(F.lit(2.0), level)
        return F.greatest(F.lit(0), F.least(F.floor((value - low) / self.span * n), n.cast("long") - 1)).cast("long")


def _centred(df: DataFrame, p: str, grid: _Grid) -> DataFrame:
    """p + mx, my (centre), p + half (half-diagonal), p + fx, fy (finest cell)."""
    c = lambda n: F.col(p + n)
    w, h = c("maxx") - c("minx"), c("maxy") - c("miny")
    out = df.withColumns({f"{p}mx": (c("minx") + c("maxx")) / 2, f"{p}my": (c("miny") + c("maxy")) / 2, f"{p}half": F.sqrt(w * w + h * h) / 2})
    return out.withColumns({f"{p}fx": grid.cell(c("mx"), grid.minx), f"{p}fy": grid.cell(c("my"), grid.miny)})


def _radius(l: DataFrame, r: DataFrame, grid: _Grid, k: int, bucket: int | None, longest: int = 0, right_longest: int = 0) -> DataFrame:
    """l with __radius: no smaller than the distance to the k-th eligible right row, null where no bound was found."""
    steps: list[int] = []
    levels = F.explode(F.array(*(F.lit(x) for x in grid.levels)))
    keys, held = ["fx", "fy"], ["level", "cx", "cy"]
    right = r.select(F.col("__rfx").alias("fx"), F.col("__rfy").alias("fy"), F.col("__rhalf").alias("half"), *([F.col("__rlo").alias("lo")] if bucket else []))
    if bucket:
        # a window of very many buckets is counted in buckets twice, four times .. as wide
        many = F.floor((F.col("__lhi") + 1) / bucket) - F.ceil(F.col("__llo") / bucket)
        l = l.withColumn("__ltl", F.when(many <= MOST_BUCKETS, F.lit(0)).otherwise(F.ceil(F.log2(many / MOST_BUCKETS))).cast("int"))
        width = lambda c: F.lit(bucket) * F.pow(F.lit(2.0), F.col(c))
        l = l.withColumns({"__lb0": F.ceil(F.col("__llo") / width("__ltl")), "__lb1": F.floor((F.col("__lhi") + 1) / width("__ltl")) - 1})
        used = sorted(x[0] for x in l.select("__ltl").distinct().collect()) if longest >= MOST_BUCKETS * bucket else [0]
        starts = right.withColumn("tl", F.explode(F.array(*(F.lit(x) for x in used)))).withColumn("tb", F.floor(F.col("lo") / width("tl")))
        held += ["tl", "tb"]
        least = LONG * COUNT_SPLIT * bucket
        if right_longest >= least:
            # a row at least two buckets long covers the whole bucket after that in which it starts; only rows much longer
            # than windows are counted by this, of others enough start inside
            length = F.col("__rhi") - F.col("__rlo")
            step = F.floor(F.log2(length / (2 * bucket)))
            step = F.when(length < F.lit(2.0 * bucket) * F.pow(F.lit(2.0), step), step - 1).otherwise(step).cast("int")
            long = r.where(length >= least).withColumn("step", step)
            steps = sorted(x["step"] for x in long.groupBy("step").count().where(F.col("count") >= k).collect())
            covers = (F.floor(F.col("__rlo") / width("step")) + 1).alias("tb")
            long = long.select(F.col("__rfx").alias("fx"), F.col("__rfy").alias("fy"), F.col("__rhalf").alias("half"), (-1 - F.col("step")).alias("tl"), covers).where(F.col("tl").isin([-1 - t for t in steps]))
            if steps:
                starts = starts.drop("lo").unionByName(long)
                l = l.withColumn("__lbegin", F.floor(F.col("__llo") / bucket))
        right = starts
    counts = right.groupBy(*keys, *held[3:]).agg(F.count("*").alias("n"), F.max("half").alias("half")).withColumn("level", levels)
    up = lambda df: df.withColumn("cx", F.expr(f"shiftright(fx, {grid.top} - level)")).withColumn("cy", F.expr(f"shiftright(fy, {grid.top} - level)"))
    counts = up(counts).groupBy(*held).agg(F.sum("n").alias("n"), F.max("half").alias("half"))
    left = l.select(F.col("__lfx").alias("fx"), F.col("__lfy").alias("fy"), *([F.col("__ltl").alias("tl"), F.col("__lb0").alias("b0"), F.col("__lb1").alias("b1")] if bucket else []), *([F.col("__lbegin").alias("begin")] if steps else []))
    if bucket:
        keys += ["tl", "b0", "b1", *(["begin"] if steps else [])]
        inside = F.when(F.col("b0") <= F.col("b1"), F.transform(F.sequence(F.least("b0", "b1"), F.col("b1")), lambda b: F.struct(F.col("tl").alias("tl"), b.alias("tb"))))
        covered = F.array(*(F.struct(F.lit(-1 - t).alias("tl"), F.shiftright("begin", t).alias("tb")) for t in steps))
        asked = left.distinct().withColumn("ask", F.explode(F.concat(F.coalesce(inside, F.array().cast("array<struct<tl:int,tb:bigint>>")), covered) if steps else inside))
        asked = up(asked.withColumn("level", levels)).alias("asked")
        on = [F.col(f"asked.{c}") == F.col(f"counts.{c}") for c in held[:3]] + [F.col(f"asked.ask.{c}") == F.col(f"counts.{c}") for c in held[3:]]
        met = asked.join(counts.alias("counts"), on).select(*(f"asked.{c}" for c in [*keys, "level"]), "counts.n", "counts.half")
        enough = met.groupBy(*keys, "level").agg(F.sum("n").alias("n"), F.max("half").alias("half")).where(F.col("n") >= k)
    else:
        enough = up(left.distinct().withColumn("level", levels)).join(counts.where(F.col("n") >= k), held)
    bound = F.lit(grid.span * math.sqrt(2)) / F.pow(F.lit(2.0), "level") + F.col("half")
    best = enough.groupBy(*keys).agg(F.min(bound).alias("bound"))
    names = {"fx": "__lfx", "fy": "__lfy"} | ({"tl": "__ltl", "b0": "__lb0", "b1": "__lb1"} if bucket else {}) | ({"begin": "__lbegin"} if steps else {})
    out = l.join(best.withColumnsRenamed(names), list(names.values()), "left")
    # cells are numbered with rounding; a little more radius makes up for it
    return out.withColumn("__radius", (F.col("bound") + F.col("__lhalf")) * (1 + 1e-9) + grid.span * 2.0**-48).drop("bound")


def _closer(l: DataFrame, r: DataFrame, rs, far: float, k: int) -> DataFrame:
    """l with a smaller __radius where k right boxes meet the cell of its centre: none of them is farther than the cell's diagonal.

    Boxes that meet very many cells are left uncounted, which only leaves some radii as they were.
    """
    cell = max(min(rs.w, rs.h), max(rs.w, rs.h) / 8)
    if cell <= far * 2.0**-40:
        return l
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    meets = r.select(at("__rminx").alias("x0"), at("__rmaxx").alias("x1"), at("__rminy").alias("y0"), at("__rmaxy").alias("y1"))
    meets = meets.where((F.col("x1") - F.col("x0") + 1.0) * (F.col("y1") - F.col("y0") + 1.0) <= MOST_CELLS)
    meets = meets.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    held = meets.groupBy("cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("cx", "cy", F.lit(cell * math.sqrt(2) * (1 + 1e-9) + far * 2.0**-40).alias("close"))
    out = l.withColumns({"cx": at("__lmx"), "cy": at("__lmy")}).join(held, ["cx", "cy"], "left")
    return out.withColumn("__radius", F.least("__radius", "close")).drop("cx", "cy", "close")


def _gathered(l: DataFrame, r: DataFrame, lk: str, rk: str, grid: _Grid, bucket: int | None, longest: int = 0) -> DataFrame:
    """Candidate pairs: everything within the radius, each pair once."""
    if rk == POINT:
        sizes = {0: 0.0}
        r = r.withColumn("cls", F.lit(0))
    else:
        unit = grid.span / (1 << grid.top)
        cls = F.when(F.col("__rhalf") <= unit, F.lit(0)).otherwise(F.ceil(F.log2(F.col("__rhalf") / unit) / 2)).cast("int")
        r = r.withColumn("cls", cls)
        sizes = {x["cls"]: x["m"] for x in r.groupBy("cls").agg(F.max("__rhalf").alias("m")).collect()}
    classes = F.array(*(F.struct(F.lit(c).alias("cls"), F.lit(m).alias("m")) for c, m in sorted(sizes.items())))
    l = l.withColumn("s", F.explode(classes)).withColumn("reach", F.col("__radius") + F.col("s.m"))
    wide = F.col("reach") + F.greatest(F.col("__lmaxx") - F.col("__lminx"), F.col("__lmaxy") - F.col("__lminy")) / 2
    fine = F.floor(F.log2(F.lit(2 * grid.span) / wide))
    level = F.greatest(F.lit(0), *(F.when(fine >= x, F.lit(x)).otherwise(F.lit(0)) for x in grid.levels))
    if bucket:
        length = lambda p: (F.col(f"{p}hi") - F.col(f"{p}lo")) / (LONG * bucket)
        steps = lambda p: F.when(length(p) <= 1, F.lit(0)).otherwise(F.ceil(F.log2(length(p)))).cast("int")
        l, r = l.withColumn("__lti", steps("__l")), r.withColumn("__rti", steps("__r"))
    l = checkpointed(l.select("*", F.col("s.cls").alias("cls"), F.when(F.col("__radius").isNull(), F.lit(-1)).otherwise(level).alias("level")).drop("s"))
    used = sorted(x[0] for x in l.select("level").distinct().collect())
    width = F.greatest(F.col("level"), F.lit(0))

    def span(axis: str, low: float):
        a = grid.cell(F.col(f"__lmin{axis}") - F.col("reach"), low, width)
        b = grid.cell(F.col(f"__lmax{axis}") + F.col("reach"), low, width)
        zero = F.lit(0).cast("long")
        return F.explode(F.sequence(F.when(F.col("level") < 0, zero).otherwise(a), F.when(F.col("level") < 0, zero).otherwise(b)))

    left = l.withColumn("cx", span("x", grid.minx)).withColumn("cy", span("y", grid.miny))
    right = r.withColumn("level", F.explode(F.array(*(F.lit(x) for x in used))))
    right = right.withColumn("cx", grid.cell(F.col("__rmx"), grid.minx, width)).withColumn("cy", grid.cell(F.col("__rmy"), grid.miny, width))
    if -1 in used:
        right = right.withColumn("cx", F.when(F.col("level") < 0, F.lit(0)).otherwise(F.col("cx")).cast("long")).withColumn("cy", F.when(F.col("level") < 0, F.lit(0)).otherwise(F.col("cy")).cast("long"))
    on = ["cls", "level", "cx", "cy"]
    near = F.lit(True)
    if bucket:
        # a pair meets on the step of its longer interval: each side goes to its own step and to the other side's wider ones
        width = F.lit(bucket) * F.pow(F.lit(2.0), F.col("ti"))
        several = longest > LONG * bucket
        own = {p: sorted(x[0] for x in df.select(f"{p}ti").distinct().collect()) if several else [0] for p, df in (("__l", l), ("__r", r))}

        def timed(df, p, other):
            wider = F.filter(F.array(*(F.lit(x) for x in own[other])), lambda x: x > F.col(f"{p}ti"))
            df = df.withColumn("ti", F.explode(F.concat(F.array(f"{p}ti"), wider)))
            return df.withColumn("tb", F.explode(F.sequence(F.floor(F.col(f"{p}lo") / width), F.floor(F.col(f"{p}hi") / width))))

        left, right = timed(left, "__l", "__r"), timed(right, "__r", "__l")
        on += ["ti", "tb"]
        near = (F.col("__rlo") <= F.col("__lhi")) & (F.col("__rhi") >= F.col("__llo")) & (left["ti"] == F.greatest("__lti", "__rti"))
        near = near & (F.floor(F.greatest("__llo", "__rlo") / (F.lit(bucket) * F.pow(F.lit(2.0), left["ti"]))) == left["tb"])
    equal = F.lit(True)
    for c in on:
        equal = equal & (left[c] == right[c])
    near = near & (F.col("__radius").isNull() | (gap("__l", "__r", lk, rk) <= F.col("__radius")))
    pairs = left.join(right, equal & near)
    pairs._nighspark_sides = left, right
    return pairs


def _ranked(left, right, k, left_geom, right_geom, left_key, right_key, delta_ms=None, left_time=None, right_time=None):
    """(lrow, lkey, rkey, distance, rank) of each left row's neighbours; lrow numbers left rows, whose keys may repeat."""
    if k < 1:
        raise ValueError("k must be at least 1")
    timed = delta_ms is not None
    extra = lambda df, key, time, d: {"key": F.col(key)} | (dict(zip(("lo", "hi"), window_of(df, time, d))) if timed else {})
    l, lk = side(left, left_geom, "__l", extra(left, left_key, left_time, delta_ms))
    r, rk = side(right, right_geom, "__r", extra(right, right_key, right_time, 0))
    keep = lambda p, kind: [f"{p}key", *(p + n for n in ENVELOPE), *([f"{p}wkb"] if kind == SHAPE else []), *([f"{p}lo", f"{p}hi"] if timed else [])]
    l, r = l.select(*keep("__l", lk)), r.select(*keep("__r", rk))
    if timed:
        l, r = l.where("__llo is not null and __lhi is not null"), r.where("__rlo is not null and __rhi is not null")
    more = lambda p: [F.min(f"{p}lo").alias("lo"), F.max(f"{p}hi").alias("hi"), F.avg(F.col(f"{p}hi") - F.col(f"{p}lo")).alias("mean"), F.max(F.col(f"{p}hi") - F.col(f"{p}lo")).alias("longest")] if timed else []
    alike = lambda df, p: [c for c in df.columns if c != f"{p}key"]
    places = lambda df, p: F.approx_count_distinct(F.xxhash64(*alike(df, p))).alias("places")
    ls = stats(l, "__l", *more("__l"), places(l, "__l"))
    if timed and ls.n:
        # right rows outside every left window can be nobody's neighbour
        r = r.where((F.col("__rlo") <= ls.hi) & (F.col("__rhi") >= ls.lo))
    rs = stats(r, "__r", *more("__r"), places(r, "__r"))
    if not ls.n or not rs.n:
        return None
    # which way is taken decides on speed only
    groups = None
    if ls.n >= COPIES * ls.places:
        groups = checkpointed(together(l, alike(l, "__l"), F.struct("__lkey"), "keys")[0].withColumn("__lrow", F.monotonically_increasing_id()))
        l = groups.drop("keys")
    if rs.n >= COPIES * rs.places:
        first = F.row_number().over(Window.partitionBy(*alike(r, "__r")).orderBy("__rkey"))
        r = checkpointed(r.withColumn("first", first).where(F.col("first") <= k).drop("first"))
        rs = stats(r, "__r", *more("__r"))
    minx, miny = min(ls.minx, rs.minx), min(ls.miny, rs.miny)
    span = max(max(ls.maxx, rs.maxx) - minx, max(ls.maxy, rs.maxy) - miny)
    grid = _Grid(minx, miny, span, _levels(r, rs.n, k, minx, miny, span) if span else [0])
    if groups is None:
        # fixed by the checkpoint of _gathered
        l = l.withColumn("__lrow", F.monotonically_increasing_id())
    l, r = _centred(l, "__l", grid), _centred(r, "__r", grid)
    window, longest = None, 0
    if timed:
        window, longest = max(1, int(max(ls.mean, rs.mean))), max(ls.longest, rs.longest)
        l = _radius(l, r, grid, k, max(1, int(ls.mean) // COUNT_SPLIT), ls.longest, rs.longest)
    else:
        l = _radius(l, r, grid, k, None)
        if rk == BOX:
            l = _closer(l, r, rs, max(abs(x) for x in (ls.minx, ls.miny, ls.maxx, ls.maxy, rs.minx, rs.miny, rs.maxx, rs.maxy)), k)
    met = _gathered(l, r, lk, rk, grid, window, longest)
    pairs = met.withColumn("distance", exact("__l", "__r", lk, rk)).select(F.col("__lrow").alias("lrow"), *([F.col("__lkey").alias("lkey")] if groups is None else []), F.col("__rkey").alias("rkey"), "distance")
    rank = F.row_number().over(Window.partitionBy("lrow").orderBy("distance", "rkey"))
    out = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    if groups is not None:
        each = groups.select("__lrow", F.posexplode("keys").alias("at", "row"))
        out = out.join(each, F.col("lrow") == F.col("__lrow")).select(F.struct("lrow", "at").alias("lrow"), F.col("row.__lkey").alias("lkey"), "rkey", "distance", "rank")
    out._nighspark_sides = met._nighspark_sides
    return out


def _unique(df: DataFrame, key: str) -> None:
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"the values of {key} repeat: only plain inner results can be told apart then")


def _shaped(left: DataFrame, right: DataFrame, ranked: DataFrame | None, left_key: str, right_key: str, how: str, nested: bool, columns: bool, suffix: str) -> DataFrame:
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    rkey = right_key + suffix if right_key == left_key else right_key
    if nested or columns or how == "left":
        _unique(left, left_key)
    if columns:
        _unique(right, right_key)
    if ranked is None:
        kinds = f"`lkey` {left.schema[left_key].dataType.simpleString()}, `rkey` {right.schema[right_key].dataType.simpleString()}, distance double, rank int"
        ranked = left.sparkSession.createDataFrame([], kinds)
    if nested:
        one = F.struct("rank", F.col("rkey").alias(right_key), "distance")
        lists = ranked.groupBy("lkey").agg(F.array_sort(F.collect_list(one)).alias("neighbours"))
        none = F.array().cast(lists.schema["neighbours"].dataType)
        base = left if columns else left.select(left_key)
        return base.join(lists.withColumnRenamed("lkey", left_key), left_key, "left").withColumn("neighbours", F.coalesce("neighbours", none))
    flat = ranked.select(F.col("lkey").alias(left_key), F.col("rkey").alias(rkey), "distance", "rank")
    if columns:
        taken = set(left.columns)
        theirs = right.select(*(F.col(f"`{c}`").alias(rkey if c == right_key else c + suffix if c in taken else c) for c in right.columns))
        return left.join(flat, left_key, how).join(theirs, rkey, "inner" if how == "inner" else "left").select(*left.columns, *theirs.columns, "distance", "rank")
    return flat if how == "inner" else left.select(left_key).join(flat, left_key, "left")


def knn_join(left: DataFrame, right: DataFrame, k: int, left_geom=("x", "y"), right_geom=("x", "y"), left_key: str = "id", right_key: str = "id", how: str = "inner", nested: bool = False, columns: bool = False, suffix: str = "_right") -> DataFrame:
    """For each left row its k nearest right rows: left key, right key (with the suffix if of the same name), distance, rank.

    nested gives one row per left row with an array of (rank, right key, distance), empty if there is none; columns adds
    all columns of both sides; how="left" keeps left rows without neighbours. Ties go to the smaller right key. Left rows of
    one key each have their own neighbours; nested, columns and how="left", which go by the key, refuse keys that repeat.
    Right rows without geometry are nobody's neighbours; left rows without geometry have none.
    """
    ranked = _ranked(left, right, k, left_geom, right_geom, left_key, right_key)
    return _shaped(left, right, ranked, left_key, right_key, how, nested, columns, suffix)


def st_knn_join(left: DataFrame, right: DataFrame, k: int, delta_ms: int, left_time, right_time, left_geom=("x", "y"), right_geom=("x", "y"), left_key: str = "id", right_key: str = "id", how: str = "inner", nested: bool = False, columns: bool = False, suffix: str = "_right") -> DataFrame:
    """As knn_join, among right rows whose closed interval meets the left row's widened by delta on both sides.

    A time is one timestamp column or (start, end). Distance is spatial only. Fewer than k eligible rows give fewer.
    """
    if delta_ms < 0:
        raise ValueError("delta must not be negative")
    ranked = _ranked(left, right, k, left_geom, right_geom, left_key, right_key, delta_ms, left_time, right_time)
    return _shaped(left, right, ranked, left_key, right_key, how, nested, columns, suffix)


def join_stats(left: DataFrame, right: DataFrame, k: int, left_geom=("x", "y"), right_geom=("x", "y"), left_key: str = "id", right_key: str = "id", delta_ms: int | None = None, left_time=None, right_time=None) -> DataFrame:
    """One row: left_num, right_num, pair_num, hit_num (left rows with k neighbours) and hit_rate."""
    return _counted(left, right, k, _ranked(left, right, k, left_geom, right_geom, left_key, right_key, delta_ms, left_time, right_time))


def _counted(left: DataFrame, right: DataFrame, k: int, ranked: DataFrame | None) -> DataFrame:
    per = ranked.groupBy("lrow").agg(F.count("*").alias("n")) if ranked is not None else left.sparkSession.createDataFrame([], "lrow long, n long")
    found = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pair_num"), F.count(F.when(F.col("n") == k, 1)).alias("hit_num"))
    n_left, n_right = (df.agg(F.count("*").alias(c)) for df, c in ((left, "left_num"), (right, "right_num")))
    # three single rows side by side
    out = n_left.join(n_right).join(found)
    return out.withColumn("hit_rate", F.when(F.col("left_num") > 0, F.col("hit_num") / F.col("left_num")).otherwise(F.lit(0.0)))


def run_stats(left: DataFrame, right: DataFrame, k: int, **how) -> DataFrame:
    """The row of join_stats() with left_copy_num and right_copy_num (rows either side sends to cells), their rates to the
    rows of the side, and total_time (seconds). It runs the join and takes the arguments of join_stats()."""
    import time

    given = {"left_geom": ("x", "y"), "right_geom": ("x", "y"), "left_key": "id", "right_key": "id", "delta_ms": None, "left_time": None, "right_time": None} | how
    began = time.time()
    ranked = _ranked(left, right, k, *given.values())
    row = _counted(left, right, k, ranked).first().asDict()
    row["total_time"] = time.time() - began
    for name, sent in zip(("left", "right"), ranked._nighspark_sides if ranked is not None else (left.limit(0),) * 2):
        row[f"{name}_copy_num"] = sent.count()
        row[f"{name}_copy_rate"] = row[f"{name}_copy_num"] / row[f"{name}_num"] if row[f"{name}_num"] else 0.0
    return left.sparkSession.createDataFrame([row], ", ".join(f"{c} {'double' if c.endswith(('rate', 'time')) else 'long'}" for c in row))
