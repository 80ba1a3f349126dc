"""Near duplicates by min-max hashing, banding, and exact verification on full shingle sets.

Under each of P hash functions a set keeps its smallest and its largest value, so 2P signature values cost P evaluations;
both agree between two sets with the probability of their Jaccard similarity, and together they vary less than 2P
independent minima. Bands of `rows` values are bucket keys.

Documents with equal sets are one class from the start. Within a bucket no pairs are enumerated: each class is verified
against one centre, the class that shares most bucket places (the original of a group of copies, as a rule), and what
verified links join into components. A group of copies however large thus costs one verification a member. Only classes
of buckets that still hold several components may have links left. These are found by an exact prefix join among them:
with shingles ordered by how many of these classes have them, two sets at the threshold share one of the rarest of each,
at places that leave room for the overlap needed, so edited copies just below the threshold make no pairs with their
whole group. Every link counts only when verified on both full sets, which are worked out once for each class of a bucket.

With the default 28 bands of 4 a pair at the threshold 0.8 shares no bucket with probability (1 - 0.8^4)^28 < 4e-7.

Defined cases: null or wordless texts have an empty set, are linked with nothing and stand for themselves; rows repeated
in id and text are in one class; a null id never is the smallest; an empty table gives no rows; texts of any length are
taken whole; other columns play no part in near_duplicates() and go through keep_one(), whatever their names.

Classes are named by 64-bit hashes of their sets: of 10^9 distinct sets one pair in 37 such tables would share a name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nighspark.llm.common import components, drop_written, joined_by, map_texts, maybe_broadcast, mixed, row_key, shingles, word_hashes, words, written

BANDS, ROWS = 28, 4
#: Rounds before the last in which a class meets some of a component's classes, and how many for a shingle.
ROUNDS, MEETS = 2, 4
#: Rows (two longs) up to which representatives are broadcast to fetch their texts.
BROADCAST_CLASSES = 400_000


def shingle_set(text, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles; the whole sequence as one if it has fewer words."""
    return shingles(word_hashes(words(text)), width) if text else np.empty(0, np.uint64)


def min_max(flat: np.ndarray, first: np.ndarray, last: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[value, set] min-max signatures of the sets flat[first[i]:last[i]], none of them empty; sets may overlap."""
    p = -(-bands * rows // 2)
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, p, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, p, dtype=np.uint64)
    values = np.empty((2 * p, len(first)), np.uint64)
    bounds = np.stack([first, last], 1).ravel()
    for i in range(p):
        h = np.append(flat * a[i] + b[i], np.uint64(0))
        values[2 * i], values[2 * i + 1] = np.minimum.reduceat(h, bounds)[::2], np.maximum.reduceat(h, bounds)[::2]
    # a band takes values of different functions: minima and maxima of one function lie p values apart
    return np.concatenate([values[::2], values[1::2]])[: bands * rows]


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[set, band] hashes of the bands of signatures."""
    values = values.reshape(bands, rows, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    for r in range(rows):
        key = mixed(key ^ values[:, r]) + np.uint64(r)
    return np.ascontiguousarray(key.T)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """[set, band] hashes of min-max signatures; sets must not be empty."""
    ends = np.cumsum([len(s) for s in sets])
    return band_keys(min_max(np.concatenate(sets), ends - [len(s) for s in sets], ends, bands, rows), bands, rows)


def _signed(df: DataFrame, id_col: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """row, id, n (set size), class (hash of the set), bands."""

    def make():
        def each(texts):
            sets = [shingle_set(t, width) for t in texts]
            full = [s for s in sets if len(s)]
            keys = signatures(full, bands, rows).view(np.int64) if full else np.empty((0, bands), np.int64)
            size = np.array([bands if len(s) else 0 for s in sets], np.int64)
            banded = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(keys.ravel()))
            names = [xxhash.xxh3_64_intdigest(s.tobytes(), seed=width) - (1 << 63) if len(s) else None for s in sets]
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), banded]

        return each

    rows_of = df.select(row_key(df, id_col, text).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    return map_texts(rows_of, "text", "n long, class long, bands array<long>", make, keep=["row", "id"])


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """class, n and s, the full shingle set (sorted hashes), of (class, text)."""

    def make():
        def each(found):
            sets = [shingle_set(t, width) for t in found]
            size = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            return [pa.array(size), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(flat))]

        return each

    return map_texts(texts, "text", "n long, s array<long>", make, keep=["class"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose full sets reach the threshold, as (smaller, larger).

    The set of a rides to the shuffle by b, so b should be the class that many pairs have.
    """
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = 100 * both >= percent * (F.col("na") + F.col("nb") - both)
    reach = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    found = pairs.select("a", "b").join(left, "a").join(right, "b").where(reach).where(near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _prefixes(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """class, n, left, shingle, df: the rarest shingles of each class (class, n) that every partner shares one of.

    Sets of n and m at the threshold share at least need = percent * (n + m) / (100 + percent) shingles, so under any
    common order of shingles their first common one leaves that many at and behind it (`left`) in both.
    """
    each = written(sets.join(classes.select("class"), "class", "left_semi").select("class", F.explode("s").alias("shingle")), "shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one class come first in the order and match nothing: only their number is needed, as an offset
    kept = each.join(often, "shingle").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    prefix = kept.join(classes.select("class", "n"), "class").withColumn("alone", F.col("n") - F.size("s"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    rows = prefix.where(length > 0).select("class", "n", "alone", F.posexplode(F.slice("s", 1, length.cast("int"))).alias("i", "s"))
    return written(rows.select("class", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), "s.shingle", "s.df"), "prefixes")


def _prefix_pairs(prefixes: DataFrame, components_of: DataFrame, percent: int, seed: int | None) -> DataFrame:
    """(a, b): the pairs of classes of different components (class, c) that could reach the threshold.

    With a seed only some of them, chosen by it: for each of its shingles a class meets a few of the largest component
    that has the shingle, so their number follows that of classes whatever the components' sizes.
    """
    rows = prefixes.join(components_of, "class")
    mixed_up = rows.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("shingle", "least")
    rows = rows.join(mixed_up, "shingle").where(F.col("left") * (100 + percent) >= (F.col("n") + F.col("least")) * percent)
    large = written(components_of.groupBy("c").agg(F.count("*").alias("members")), "members")
    rows = joined_by(rows, large, "c", "members").withColumn("rank", F.struct("members", "c"))
    side = lambda df, x: df.select("shingle", F.col("class").alias(x), F.col("rank").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("left").alias(f"l{x}"))
    left, right = side(rows, "a"), side(rows, "b")
    if seed is not None:
        turn = F.row_number().over(Window.partitionBy("shingle").orderBy(F.desc("rb"), F.xxhash64("b", F.lit(seed))))
        right = right.withColumn("turn", turn).where(F.col("turn") <= MEETS).drop("turn")
    reach = F.least("la", "lb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    pairs = left.join(right, "shingle").where((F.col("ra") < F.col("rb")) & reach)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links_of(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between classes, enough to join every two classes that links within buckets join.

    buckets: (key, class) with at least two classes a key; sets: (class, n, s) by sets_of().
    """
    sized = buckets.join(buckets.groupBy("key").agg(F.count("*").alias("size")), "key")
    degree = sized.groupBy("class").agg(F.sum("size").alias("degree"))
    ranked = buckets.join(degree, "class").select("key", "class", F.struct("degree", "class").alias("place"))
    top = ranked.groupBy("key").agg(F.max("place").alias("top"))
    # of the centres of its buckets a class takes the one it meets most often, not one that an odd bucket brings
    met = ranked.join(top, "key").groupBy("class", "top").agg(F.count("*").alias("times")).where("top.class <> class")
    star = met.groupBy("class").agg(F.max(F.struct("times", "top")).alias("t")).select(F.col("class").alias("a"), F.col("t.top.class").alias("b"))
    # of a bucket of two its one pair: such buckets are done with
    sizes_of = sized.groupBy("key").agg(F.first("size").alias("size"), F.min("class").alias("a"), F.max("class").alias("b"))
    star = written(star.unionAll(sizes_of.where("size = 2").join(star, ["a", "b"], "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "star")
    buckets = written(sized.where("size > 2").select("key", "class"), "large")
    links = written(_verified(star, sets, percent), "links")
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    prefixes = None
    # a few of each component's classes first: what they join needs no further pairs; then all that are left
    for seed in (*range(ROUNDS), None):
        found = components(links).withColumnsRenamed({"id": "class", "component": "c"})
        members = buckets.join(found, "class", "left").withColumn("c", F.coalesce("c", "class"))
        still = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        classes = written(members.join(still, "key", "left_semi").select("class", "c").distinct().join(sets.select("class", "n"), "class"), "open")
        if classes.isEmpty():
            break
        if prefixes is None:
            prefixes = _prefixes(classes, sets, percent)
        pairs = _prefix_pairs(prefixes, classes.select("class", "c"), percent, seed).join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        links = written(links.unionAll(_verified(pairs, sets, percent)), "links")
        tested = tested.unionAll(pairs)
    return links


def duplicate_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of df: row (hash of id and text), id, n_shingles, root (its group), component_id (the smallest id of its group)."""
    signed = written(_signed(df, id_col, text, width, bands, rows), "signed")
    classes = signed.where("class is not null")
    keyed = classes.groupBy("class").agg(F.first("bands").alias("bands")).select("class", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    buckets = written(keyed.join(shared, "key", "left_semi").select("key", "class"), "buckets")
    in_bucket = buckets.select("class").distinct()
    wanted = written(classes.groupBy("class").agg(F.min("row").alias("want")).join(in_bucket, "class", "left_semi"), "wanted")
    source = df.select(row_key(df, id_col, text).alias("want"), F.col(text).alias("text"))
    sets = written(sets_of(source.join(maybe_broadcast(wanted.select("want", "class"), wanted.count(), BROADCAST_CLASSES), "want").dropDuplicates(["class"]).select("class", "text"), width), "sets")
    links = links_of(buckets, sets, percent)
    joined = components(links).withColumnsRenamed({"id": "class", "component": "root"})
    drop_written(sets, buckets, wanted)
    # the smallest id of each class, then of each group of classes; rows get it through their class
    lows = classes.groupBy("class").agg(F.min("id").alias("low"))
    rooted = lows.join(joined, "class", "left").withColumn("root", F.coalesce("root", "class"))
    group = rooted.groupBy("root").agg(F.min("low").alias("group_low"))
    low_of = rooted.join(group, "root").select("class", "root", "group_low")
    out = signed.select("row", "id", "n", "class").join(low_of, "class", "left")
    return out.select("row", "id", F.col("n").alias("n_shingles"), "root", F.coalesce("group_low", "id").alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row of df."""
    out = duplicate_classes(df, id_col, text, **how)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with one row of each group of near duplicates: of the rows of the smallest id that of the smallest hash over
    all columns. Rows without words, and rows of groups without any id, stand for themselves: the former all stay."""
    row, all_ = "__ns_row", "__ns_all"
    found = duplicate_classes(df, id_col, text, **how)
    # rows of one id in one group differ in text or further columns: the smallest of their hashes stays
    firsts = found.where("n_shingles > 0 and id <=> component_id").select(F.col("row").alias(row), F.col("component_id").alias("__ns_group"), "root").distinct()
    mine = firsts.groupBy("root").agg(F.min(row).alias(row)).select(row)
    out = df.withColumns({row: row_key(df, id_col, text), all_: row_key(df)}).withColumn("__ns_words", F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    with_words = out.where("__ns_words").join(mine, row, "left_semi")
    least = with_words.groupBy(row).agg(F.min(all_).alias(all_))
    one = with_words.join(least, [row, all_], "left_semi").dropDuplicates([row])
    return one.unionByName(out.where("not __ns_words")).select(*df.columns)
