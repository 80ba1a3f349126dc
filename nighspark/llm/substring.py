"""Substring dedup: paragraphs and passages compared across documents by MinHash banding.

The units compared are
 * paragraphs (lines) of `paragraph_words` words or more, and
 * passages: runs of `passage_words` words from anchors on, wherever paragraphs break. An anchor is a 5-word run whose hash
   is smallest in a window of `window` such runs, so it depends on the words alone. Any run of
   passage_words + window - 1 words (51 by default) that two documents share holds a whole passage of both.
Every unit has a min-max signature of its 5-word shingles, banded into buckets; paragraphs meet paragraphs and passages
meet passages. Units of equal words are one class from the start; classes that meet in a bucket are joined and their exact
Jaccard similarity (0.8) is verified on full shingle sets; links make components (nighspark.llm.neardup). Paragraphs have 6
bands of 2, which miss a pair at the threshold with probability (1 - 0.8^2)^6 = 0.002. Passages are there for verbatim
runs, which are equal and never missed, and have 2 bands of 3; an edit inside 26 words leaves them below 0.8 anyhow.

A component found in two documents or more is a hit. Its document of smallest id keeps it (rows that share this id all
do); it is removed from the others. Hits of a document that overlap or adjoin form spans, and spans that share
components are one cluster.

What travels: one row (key, class, mark of the document) for each band of each class that a slice of texts holds, one narrow row for each unit,
and the texts of documents that hold the first unit of a class that shares a bucket. Components of a thousandth of all
hits or more are joined by broadcast (at most a thousand of them), so no task gets one of them whole.

Defined cases: null and empty texts have no units; units that repeat only within one document are left alone; documents
repeated in id and text are one document; a null id sorts last, and documents without id all keep what only they hold;
an empty table gives no rows; texts are taken whole, whatever their length; other columns play no part in
repeated_spans() and go through remove_repeats().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nighspark.llm.common import components, drop_written, joined_by, map_texts, mixed, row_key, runs_of, utf8, word_hashes, words, written
from nighspark.llm.neardup import band_keys, links_of, min_max

PASSAGE_WORDS, WINDOW, SHINGLE, PERCENT = 26, 26, 5, 80
#: Least words of a paragraph: the shingle and a few more, so that one has several shingles.
PARAGRAPH_WORDS = SHINGLE + 5
#: Bands and rows of paragraphs and of passages.
BANDS, PASSAGE_BANDS = (6, 2), (2, 3)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def anchors(runs: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Positions smallest (the last of equals) in a window of `runs`; document d has runs first[d] to first[d] + count[d] - 1."""
    if len(runs) < window:
        return np.empty(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(runs, window)
    left = np.maximum(count - window + 1, 0)
    at = np.repeat(first, left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
    return np.unique(at + window - 1 - seen[at, ::-1].argmin(1))


class Units:
    """The units of several texts laid end to end: document, first word, words, class and place of each."""

    def __init__(self, texts: list, paragraph_words: int, passage_words: int, window: int):
        found, size, docs, starts, counts = [], [], [], [], []
        for d, t in enumerate(texts):
            at = 0
            for line in (t or "").split("\n"):
                own = words(line)
                if len(own) >= paragraph_words:
                    docs.append(d)
                    starts.append(at)
                    counts.append(len(own))
                at += len(own)
                found += own
            size.append(at)
        size = np.array(size, np.int64)
        first = np.cumsum(size) - size
        h = word_hashes(found)
        self.shingles = runs_of(h, SHINGLE)  # runs that cross documents are in no unit
        at = anchors(self.shingles, first, np.maximum(size - SHINGLE + 1, 0), window)
        of = np.searchsorted(first + size, at, side="right")
        whole = at + passage_words <= (first + size)[of]
        at, of = at[whole], of[whole]
        doc = np.concatenate([np.array(docs, np.int64), of])
        place = np.concatenate([first[np.array(docs, np.int64)] + np.array(starts, np.int64), at])
        n = np.concatenate([np.array(counts, np.int64), np.full(len(at), passage_words, np.int64)])
        order = np.argsort(doc, kind="stable")
        self.doc, self.place, self.n, self.inner = doc[order], place[order], n[order], (np.arange(len(doc)) >= len(docs))[order]
        self.start = self.place - first[self.doc]
        # hash of a unit's words from sums of word hashes times falling powers, whatever its length
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BACK, len(h)), dtype=np.uint64)))
        value = (sums[self.place + self.n] - sums[self.place]) * _powers(_STEP, len(h) + 1)[self.place]
        self.name = mixed(value + (2 * self.n + self.inner).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def keys(self, which: np.ndarray, bands: tuple, passage_bands: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Number of bucket keys of each of the units `which`, and the keys."""
        inner = self.inner[which]
        count = np.where(inner, passage_bands[0], bands[0])
        out, first = np.empty(int(count.sum()), np.uint64), np.cumsum(count) - count
        for kind, (b, r) in enumerate((bands, passage_bands)):
            at = np.flatnonzero(inner == bool(kind))
            if len(at):
                a = self.place[which[at]]
                keys = band_keys(min_max(self.shingles, a, a + self.n[which[at]] - SHINGLE + 1, b, r), b, r)
                out[first[at][:, None] + np.arange(b)] = keys ^ np.uint64(kind * _STEP)
        return count, out


def _units(docs: DataFrame, paragraph_words: int, passage_words: int, window: int, bands: tuple, passage_bands: tuple) -> DataFrame:
    """row, id, starts, counts, classes; and of the units whose class a slice of texts has first: class (new), mark, number of keys; keys.

    mark is 0 where several documents of the slice hold the class, else a number of its document.
    """

    def make():
        def each(texts):
            u = Units(texts, paragraph_words, passage_words, window)
            new, of = np.unique(u.name, return_index=True, return_inverse=True)[1:]
            alone = np.ones(len(new), bool)
            alone[of[u.doc != u.doc[new][of]]] = False
            order = np.argsort(new)
            new, alone = new[order], alone[order]
            # any number serves that differs from slice to slice and text to text
            digest = np.array([xxhash.xxh32_intdigest(utf8(t or "")) | 1 for t in texts], np.uint32)
            per, fresh = np.bincount(u.doc, minlength=len(texts)), np.bincount(u.doc[new], minlength=len(texts))
            ends = lambda size: pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            lists = [(per, pa.array(u.start, pa.int32())), (per, pa.array(u.n, pa.int32())), (per, pa.array(u.name.view(np.int64)))]
            lists += [(fresh, pa.array(u.name[new].view(np.int64))), (fresh, pa.array(np.where(alone, digest[u.doc[new]], 0).astype(np.uint32).view(np.int32)))]
            count, keys = u.keys(new, bands, passage_bands)
            lists.append((fresh, pa.array(count, pa.int32())))
            lists.append((np.bincount(u.doc[new], weights=count, minlength=len(texts)).astype(np.int64), pa.array(keys.view(np.int64))))
            return [pa.ListArray.from_arrays(ends(size), values) for size, values in lists]

        return each

    return map_texts(docs, "text", "starts array<int>, counts array<int>, classes array<long>, new array<long>, marks array<int>, sizes array<int>, keys array<long>", make, keep=["row", "id"])


def _buckets(units: DataFrame) -> DataFrame:
    """(key, class), each once, for keys that several classes of several documents have.

    A document's own units overlap, so most keys that classes share are of one document.
    """

    def keyed(batches):
        for batch in batches:
            name, mark, size, key = (c.flatten().to_numpy() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(name, size)), pa.array(np.repeat(mark, size))], names=["key", "class", "mark"])

    def shared(batches):
        # rows sorted by key; of the last key those are held that do not yet make it go on: one class, or classes of one document
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        passed = None
        for batch in batches:
            key, name, mark = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            several = (np.minimum.reduceat(mark, first) != np.maximum.reduceat(mark, first)) | (np.add.reduceat(mark == 0, first) > 0)
            good = several & (np.minimum.reduceat(name, first) != np.maximum.reduceat(name, first))
            good[0] |= passed is not None and key[0] == passed
            keep = np.repeat(good, size)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(name[keep])], names=["key", "class"])
            passed = key[-1] if good[-1] else None
            last = slice(first[-1], len(key))
            name, at = np.unique(name[last], return_index=True)
            mark = np.where(several[-1], 0, mark[last][at]).astype(np.int32)
            held = [x[: 0 if good[-1] else len(x)] for x in (np.full(len(name), key[-1]), name, mark)]

    rows = units.where("size(new) > 0").select("new", "marks", "sizes", "keys").mapInArrow(keyed, "key long, class long, mark int")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, class long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, n and s (full shingle set) of the wanted units (class, want, start, n)."""
    lists = written(wanted.groupBy("want").agg(F.collect_list(F.struct("class", "start", "n")).alias("units")), "wanted")

    def run(batches):
        for batch in batches:
            names, sets = [np.empty(0, np.int64)], []
            for text, units in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = runs_of(word_hashes(words(text)), SHINGLE)
                name, start, n = (c.to_numpy() for c in units.values.flatten())
                names.append(name)
                sets += [np.unique(found[a : a + k - SHINGLE + 1]) for a, k in zip(start.tolist(), n.tolist())]
            size = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(size), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["class", "n", "s"])

    found = docs.join(lists, docs["row"] == lists["want"]).select("text", "units").mapInArrow(run, "class long, n long, s array<long>")
    return found.dropDuplicates(["class"])


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", passage_words: int = PASSAGE_WORDS, window: int = WINDOW, bands: tuple = BANDS, passage_bands: tuple = PASSAGE_BANDS, paragraph_words: int = PARAGRAPH_WORDS
) -> DataFrame:
    """One row per repeated span: row (document), id, start, n_words, cluster_id, removed.

    start counts the document's words from 0. removed tells whether the span goes (an earlier document keeps it).
    """
    if min(paragraph_words, passage_words) < SHINGLE:
        raise ValueError(f"units need {SHINGLE} words at least")
    docs = df.select(row_key(df, id_col, text).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    units = written(_units(docs, paragraph_words, passage_words, window, bands, passage_bands), "units")
    buckets = written(_buckets(units), "buckets")
    each = units.select("row", "id", F.explode(F.arrays_zip("starts", "counts", "classes")).alias("z"))
    each = each.select("row", "id", F.col("z.starts").alias("start"), F.col("z.counts").alias("n"), F.col("z.classes").alias("class"))
    figures = each.groupBy("class").agg(F.first("row").alias("want"), F.first("start").alias("start"), F.first("n").alias("n"), F.count("*").alias("c"), F.min("row").alias("lo"), F.max("row").alias("hi"), F.min("id").alias("low"))
    met = buckets.select("class").distinct().withColumn("met", F.lit(True))
    classes = written(figures.join(met, "class", "left").where("met or lo <> hi"), "classes")
    sets = written(_sets(docs, classes.where("met").select("class", "want", "start", "n")), "sets")
    links = links_of(buckets, sets, PERCENT)
    joined = components(links).withColumnsRenamed({"id": "class", "component": "unit"})
    held = classes.select("class", "c", "lo", "hi", "low").join(joined, "class", "left").withColumn("unit", F.coalesce("unit", "class"))
    several = held.groupBy("unit").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.min("low").alias("keeper")).where("a <> b").select("unit", "keeper")
    repeated = written(held.select("class", "c", "unit").join(several, "unit").select("class", "c", "unit", "keeper"), "repeated")
    hits = joined_by(each, repeated, "class", "c").select("row", "id", "start", "n", "unit", (~F.col("id").eqNullSafe(F.col("keeper"))).alias("removed"))
    by = Window.partitionBy("row", "removed").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("k", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    marked = written(marked.select("row", "id", "removed", "start", "n", "unit", F.xxhash64("row", "removed", "k").alias("span")), "spans")
    drop_written(units, buckets, classes, sets, repeated)
    first = written(marked.groupBy("unit").agg(F.min("span").alias("first"), F.count("*").alias("c")), "firsts")
    joined = components(joined_by(marked.select("unit", "span"), first, "unit", "c").select(F.col("span").alias("a"), F.col("first").alias("b")))
    spans = marked.groupBy("span").agg(F.first("row").alias("row"), F.first("id").alias("id"), F.first("removed").alias("removed"), F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    spans = spans.join(joined.withColumnsRenamed({"id": "span", "component": "c"}), "span", "left")
    return spans.select("row", "id", F.col("start").cast("long"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), F.coalesce("c", "span").alias("cluster_id"), "removed")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with removed spans cut out of its texts."""
    spans = repeated_spans(df, id_col, text, **how).where("removed")
    cuts = spans.groupBy(F.col("row").alias("__ns_row")).agg(F.array_sort(F.collect_list(F.struct("start", F.col("n_words")))).alias("__ns_cuts"))

    @F.pandas_udf("string")
    def cut(texts, cuts_of):
        import pandas as pd

        return pd.Series([_without(t, [(c["start"], c["n_words"]) for c in ([] if cs is None else cs)]) for t, cs in zip(texts, cuts_of)], dtype=object)

    out = df.withColumn("__ns_row", row_key(df, id_col, text)).join(cuts, "__ns_row", "left")
    return out.withColumn(text, F.when(F.col("__ns_cuts").isNull(), F.col(text)).otherwise(cut(F.col(text), F.col("__ns_cuts")))).select(*df.columns)


def _without(text: str | None, cuts: list[tuple[int, int]]) -> str:
    """text without the words of the cuts and the blanks behind them."""
    if not cuts:
        return text
    at = [m.end() for m in _BLANK.finditer(text)]
    starts = ([0] if text[:1] and not _BLANK.match(text) else []) + [p for p in at if p < len(text)]
    starts.append(len(text))
    out, done = [], 0
    for first, n in cuts:
        if starts[first] > done:
            out.append(text[done : starts[first]])
        done = max(done, starts[first + n])
    return "".join([*out, text[done:]])
