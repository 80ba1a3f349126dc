"""Best-fit packing of tokenised documents into sequences of bounded length, with a swap-based local search.

A document's ids (with its end mark) longer than a sequence are cut into full pieces, the first of which may be
shorter; other documents stay whole. Pieces, a few integers each, are dealt round robin into groups of at most
`group_pieces`, packed best fit decreasing, and then improved: the least filled bins give up their pieces one by one to
other bins (move), against a shorter piece (one for one), or two at a time against one piece (two for one). Pieces of one
length are alike, so lengths and rooms are tried, not pieces. Each step raises the sum of squared fills, so the search
ends; it stops early once no packing could need fewer bins. The last bin of each group and bins at most half full are
packed once more together.

The ids are those of the public byte-level vocabulary, as `tokenizers` gives them for its file: the name of an added
token in a text is that token's id. The engine that applies the merges is tiktoken's, at a quarter of the time.

Defined cases: a null text counts as empty and gives one piece, the end mark; a text of any length is cut; equal rows are
packed each on its own, ties of length in the order of rows; an empty table gives no rows; of other columns, those with
a name of the result give way to it, the rest go through.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nighspark.llm.common import drop_written, map_texts, written

CAPACITY, END_ID = 1024, 2
GROUP_PIECES = 32_768


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """Name and id of the tokens that a tokenizers file adds to its vocabulary; they are found in texts as they stand."""
    import json

    with open(tokenizer_file, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that need more than their name are not supported")
    return {t["content"]: t["id"] for t in added}


def encoder(ranks_file: str, pattern: str, added: dict[str, int]):
    """A function from a text to its ids (numpy, unsigned 32 bits)."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: np.array(own.encode(text, allowed_special="all"), dtype="<u4") if any(t in text for t in added) else own.encode_to_numpy(text, disallowed_special=()).astype("<u4")


def pieces_of(df: DataFrame, ranks_file: str, pattern: str, added: dict[str, int], text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: the columns of df but text, and piece, start, length, ids_crc32 (and ids)."""

    def make():
        encode = encoder(ranks_file, pattern, added)

        def each(texts):
            out = []
            for t in texts:
                ids = np.append(encode(t or ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                out.append([{"start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} | ({"ids": ids[a:b].tolist()} if with_ids else {}) for a, b in zip(cuts, cuts[1:])])
            kind = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])]
            return [pa.array(out, pa.list_(pa.struct(kind)))]

        return each

    ddl = "__ns_pieces array<struct<start:long,length:long,ids_crc32:long" + (",ids:array<long>" if with_ids else "") + ">>"
    keep = [c for c in df.columns if c not in (text, "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")]
    found = map_texts(df, text, ddl, make, keep)
    return found.select(*keep, F.posexplode("__ns_pieces").alias("piece", "__ns_p")).select(*keep, "piece", "__ns_p.*")


class Bins:
    """Bins of one group: lists of (length, index of the piece)."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity, self.least = capacity, -(-int(lengths.sum()) // capacity)
        self.held: list[list[tuple[int, int]]] = []
        self.fill: list[int] = []
        self._best_fit(lengths)

    def _best_fit(self, lengths: np.ndarray) -> None:
        """Best fit decreasing; open[r] has the bins with room for r more, mask the r for which there are any."""
        cap, opened, mask = self.capacity, [[] for _ in range(self.capacity + 1)], 0
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = opened[room].pop()
                if not opened[room]:
                    mask &= ~(1 << room)
            else:
                room, b = cap, len(self.held)
                self.held.append([])
                self.fill.append(0)
            self.held[b].append((n, i))
            self.fill[b] += n
            if room > n:
                opened[room - n].append(b)
                mask |= 1 << (room - n)

    def improve(self) -> None:
        """Empties short bins by moves and swaps, the least filled first, until none can be or the least is reached."""
        stuck: set[int] = set()
        alive = sum(f > 0 for f in self.fill)
        while alive > self.least:
            short = [b for b, f in enumerate(self.fill) if 0 < f < self.capacity]
            left = [b for b in short if b not in stuck]
            if len(short) < 2 or not left:
                break
            b = min(left, key=self.fill.__getitem__)
            if self._empty(b, [c for c in short if c != b]):
                alive -= 1
                stuck.clear()
            else:
                stuck.add(b)

    def _empty(self, b: int, others: list[int]) -> bool:
        """Gives away what bin b holds as long as a step raises the squared fills; whether it is empty then."""
        cap = self.capacity
        open_ = {c: None for c in others}
        by_room: list[set[int]] = [set() for _ in range(cap + 1)]
        # under each sum of a bin's room and a piece's length: the bins by that length
        by_sum: list[dict[int, set[int]]] = [{} for _ in range(cap + 1)]

        def place(c: int, there: bool) -> None:
            room = cap - self.fill[c]
            (by_room[room].add if there else by_room[room].discard)(c)
            for n in {n for n, _ in self.held[c]}:
                held = by_sum[room + n].setdefault(n, set())
                if there:
                    held.add(c)
                else:
                    held.discard(c)
                    if not held:
                        del by_sum[room + n][n]

        for c in open_:
            place(c, True)
        while self.held[b]:
            self.held[b].sort()
            step = self._move(b, by_room) or self._swap(b, by_sum)
            if step is None:
                return False
            c, give, take = step
            place(c, False)
            self._put(b, c, give, take)
            place(c, True)
        return True

    def _put(self, b: int, c: int, give: list[tuple[int, int]], take: list[tuple[int, int]]) -> None:
        for p in give:
            self.held[b].remove(p)
            self.held[c].append(p)
        for p in take:
            self.held[c].remove(p)
            self.held[b].append(p)
        gain = sum(n for n, _ in give) - sum(n for n, _ in take)
        self.fill[b] -= gain
        self.fill[c] += gain

    def _move(self, b: int, by_room: list[set[int]]):
        """The longest piece that fits another bin, into the fullest such bin."""
        for n in sorted({n for n, _ in self.held[b]}, reverse=True):
            for room in range(n, self.capacity + 1):
                if by_room[room]:
                    return min(by_room[room]), [self._piece(b, n)], []
        return None

    def _swap(self, b: int, by_sum: list[dict[int, set[int]]]):
        """The one-for-one or two-for-one exchange that leaves the least room in the other bin."""
        count: dict[int, int] = {}
        for n, _ in self.held[b]:
            count[n] = count.get(n, 0) + 1
        lengths = sorted(count)
        gives = {n: (n,) for n in lengths}
        for i, n in enumerate(lengths):
            for m in lengths[i:]:
                if n + m <= self.capacity and (n != m or count[n] > 1):
                    gives.setdefault(n + m, (n, m))
        best = None
        for total, give in gives.items():
            # squared fills rise if the other bin is fuller after the exchange than this one was
            for rest in range(min(self.capacity - total, self.capacity - self.fill[b] - 1) + 1):
                if best is not None and rest >= best[0]:
                    break
                taken = min((n for n in by_sum[total + rest] if n < total), default=None)
                if taken is not None:
                    best = rest, give, taken, min(by_sum[total + rest][taken])
                    break
            if best is not None and best[0] == 0:
                break
        if best is None:
            return None
        _, give, taken, c = best
        first = self._piece(b, give[0])
        return c, [first, *(self._piece(b, n, first) for n in give[1:])], [self._piece(c, taken)]

    def _piece(self, b: int, length: int, but: tuple[int, int] | None = None) -> tuple[int, int]:
        return next(p for p in self.held[b] if p[0] == length and p != but)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the bins' fills; bins are numbered by falling fill."""
    bins = Bins(lengths, capacity)
    bins.improve()
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    ranked = sorted((b for b, f in enumerate(bins.fill) if f), key=lambda b: -bins.fill[b])
    for k, b in enumerate(ranked):
        at = 0
        for n, i in bins.held[b]:
            which[i], offset[i] = k, at
            at += n
    return which, offset, np.array([bins.fill[b] for b in ranked], np.int64)


def _packed(pieces: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """pieces with sequence_id, offset and tail (in the least filled bin of its group, or one at most half full)."""
    from pyspark.sql import types as T

    schema = T.StructType([*pieces.schema.fields, *T._parse_datatype_string("sequence_id long, offset long, tail boolean").fields])
    names, at = schema.names, pieces.columns.index("length")

    def run(batches):
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        which, offset, fill = pack_lengths(rows.column(at).to_numpy(), capacity)
        base = (level << 60) + (TaskContext.get().partitionId() << 32)
        cols = [*rows.columns, pa.array(base + which), pa.array(offset), pa.array((which == len(fill) - 1) | (fill[which] * 2 <= capacity))]
        yield from pa.Table.from_arrays(cols, names=names).to_batches(max_chunksize=10_000)

    return pieces.repartition(groups).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (any columns, with length) with sequence_id and offset."""
    pieces = written(pieces, "pieces")
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    first = written(_packed(pieces, groups, capacity, 0), "packed")
    drop_written(pieces)
    if groups == 1:
        return first.drop("tail")
    tails = first.where("tail").select(*pieces.columns)
    again = _packed(tails, max(1, -(-tails.count() // group_pieces)), capacity, 1)
    out = written(first.where("not tail").unionAll(again), "sequences").drop("tail")
    drop_written(first)
    return out


def pack_documents(df: DataFrame, ranks_file: str, pattern: str, added: dict[str, int], text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, **how) -> DataFrame:
    """df's documents as packed pieces: its columns but text, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces_of(df, ranks_file, pattern, added, text, capacity, end_id), capacity, **how)
