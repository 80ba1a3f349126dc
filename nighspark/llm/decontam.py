"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Words are the runs of 0-9, a-z and non-ASCII characters of the text lower-cased in A-Z. The automaton of all items is
broadcast; every document streams its words through it, which gives at each word the longest run that ends there and
occurs in one item. A run of `window` words or more is a hit for all its words; an item of fewer words is a window as a
whole. Documents meet no other document, so there is no shuffle.

The automaton's size is bounded: items are taken in groups of at most `group_words` words (counted first), and where
there are more, documents pass once for every group and the spans found are joined per document in Python.

Defined cases: null and empty texts have no words and no hits; items that are null or without words match nothing;
equal items are all reported, items that repeat an id are reported once, and a null item id counts as the empty string;
an empty table gives no rows, and no items no hits; repeated rows are judged each; texts of any length are streamed whole;
columns named as the new ones give way to them in contamination() and judged(), decontaminate() keeps every column.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nighspark.llm.common import boxed, map_texts, unboxed, utf8, written

WINDOW = 13
GROUP_WORDS = 400_000
_SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def item_words(text) -> list[bytes]:
    return utf8(text).translate(_SPACED).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window and of each short item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found]) for item, found in items if found]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}
        # by state, then by number of words: a state stands for runs of several lengths
        self.short: dict[int, dict[int, set[str]]] = {}
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        for item, ids in coded:
            state = 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.items.setdefault(self.window_state(state), set()).add(item)
            if len(ids) < window:
                self.short.setdefault(self._holding(state, len(ids)), {}).setdefault(len(ids), set()).add(item)
        # the nearest state at or above each that holds a whole short item, by growing length so that links come first
        self.above = [-1] * len(self.next)
        if self.short:
            for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                self.above[s] = s if s in self.short else self.above[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _holding(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def window_state(self, state: int) -> int:
        return self._holding(state, self.window)

    def match(self, found: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Disjoint spans [first, last] of hit words, in order, and the items whose windows occur."""
        known = np.fromiter((self.vocabulary.get(w, -1) for w in found), dtype=np.int64, count=len(found))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known >= 0, [False])).astype(np.int8)))
        spans, items, states = [], set(), set()
        nexts, link, length, window = self.next, self.link, self.length, self.window
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start < self.shortest:
                continue
            s = n = 0
            for i, c in enumerate(known[start:end].tolist(), start):
                while s and c not in nexts[s]:
                    s = link[s]
                    n = length[s]
                if c not in nexts[s]:
                    continue
                s, n = nexts[s][c], n + 1
                longest = n if n >= window else 0
                if longest:
                    states.add(s)
                if self.short:
                    q = self.above[s]
                    while q != -1:
                        for size, held in self.short[q].items():
                            if size <= n:
                                items |= held
                                longest = max(longest, size)
                        q = self.above[link[q]] if link[q] > 0 else -1
                if longest:
                    first = i - longest + 1
                    while spans and spans[-1][1] >= first - 1:
                        first = min(first, spans.pop()[0])
                    spans.append([first, i])
        for s in states:
            items |= self.items[self.window_state(s)]
        return spans, items


def _groups(benchmark: DataFrame, item_id: str, text: str, group_words: int):
    """The items in groups of bounded size, one group at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (group_words * 4)))
    for k in range(parts):
        held = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else rows
        yield [(r["item"] if r["item"] is not None else "", item_words(r["text"])) for r in held.collect()]


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, group_words: int = GROUP_WORDS) -> DataFrame:
    """df with n_words, hit_spans (array of [first, last] word numbers) and hit_items (sorted item ids as strings)."""
    ddl = "n_words long, hit_spans array<array<int>>, hit_items array<string>"
    groups = _groups(benchmark, item_id, item_text, group_words)
    out = None
    for items in groups:
        shared = df.sparkSession.sparkContext.broadcast(vars(Automaton(items, window)))

        def make(shared=shared):
            automaton = object.__new__(Automaton)
            automaton.__dict__ = shared.value

            def each(texts):
                found = [item_words(x) for x in texts]
                hits = [automaton.match(w) for w in found]
                return [pa.array([len(w) for w in found], pa.int64()), pa.array([s for s, _ in hits], pa.list_(pa.list_(pa.int32()))), pa.array([sorted(i) for _, i in hits], pa.list_(pa.string()))]

            return each

        if out is None:
            out = map_texts(df, text, ddl, make)
        else:
            old = written(out.withColumnsRenamed({"hit_spans": "__ns_spans", "hit_items": "__ns_items"}), "spans")
            new = map_texts(old, text, ddl, make)
            out = new.withColumn("hit_spans", _joined(F.concat("__ns_spans", "hit_spans"))).withColumn("hit_items", F.array_sort(F.array_distinct(F.concat("__ns_items", "hit_items")))).drop("__ns_spans", "__ns_items")
    return out


def _joined(spans):
    """Overlapping or adjoining spans made one."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<array<int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (s[0] <= F.element_at(done, -1)[1] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], s[1]))))).otherwise(F.concat(done, F.array(s))),
    )


def judged(found: DataFrame, coverage: int = 20) -> DataFrame:
    """The result of contamination() with n_hit, n_items, items_sha256 and contaminated instead of spans and items."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0] + 1)
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("hit_items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("hit_items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")))
        .drop("hit_spans", "hit_items")
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", drop: str = "documents", coverage: int = 20, **how) -> DataFrame:
    """df without its contaminated documents, or (drop="spans") with every hit span cut out of its text."""
    found = contamination(boxed(df), benchmark, text=f"__ns_all.`{text}`", **how)
    if drop == "documents":
        return unboxed(judged(found, coverage).where(~F.col("contaminated")))

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([_without(t, s) for t, s in zip(texts, spans)], dtype=object)

    own = F.col(f"__ns_all.`{text}`")
    clean = F.when(F.size("hit_spans") > 0, cut(own, F.col("hit_spans"))).otherwise(own)
    return found.select(*(clean.alias(c) if c == text else F.col(f"__ns_all.`{c}`").alias(c) for c in df.columns))


def _without(text, spans):
    if text is None or not len(spans):
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for first, last in spans:
        out.append(text[done : at[first][0]])
        done = at[last][1]
    return "".join([*out, text[done:]])


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
