"""Token counts under a unigram model, worked out once for every shared prefix of the distinct pre-tokens.

The pieces come from a public vocabulary. A piece's score is its log probability under a unigram model learned from the
whole table: how often the public tokenizer itself uses the piece (with half an occurrence more for each). Byte pieces serve
only as fallback for characters no piece covers. A pre-token is a run of characters between white space [\\x20\\x09-\\x0D]
with the word mark in front; its segmentation is the one of highest score, ties going to fewer pieces.

Distinct pre-tokens are inserted in a trie that a worker process keeps from slice to slice and from task to task. A node
holds the forward score and the number of pieces of the best segmentation of its prefix, worked out once from those of the
nodes above it, so a prefix that many pre-tokens share is scored once. The counts of terminal nodes are looked up for each
occurrence.

Each worker process has its own trie and starts a new one beyond MOST_NODES, so memory is bounded whatever the vocabulary
of the corpus, and results depend on neither; the model is a row per piece. Nothing is shuffled but partial counts of pieces.

Defined cases: null and empty texts have 0 words and 0 tokens; words of any length are scored in time linear in them; an
empty table gives no rows; repeated rows are counted each; columns named as the new ones give way to them, others pass.
"""

from __future__ import annotations

import math
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nighspark.llm.common import map_texts, slices, utf8

MARK = "▁"
MOST_NODES = 2_500_000
#: Distinct pre-tokens that a task counts before it tokenises them and starts anew.
MOST_WORDS = 1_000_000
#: Distinct pre-tokens inserted before the trie's size is looked at again.
AT_ONCE = 100_000
#: Bytes and rows of text whose pre-tokens are made distinct at once.
SLICE_BYTES, SLICE_ROWS = 8_000_000, 2048
#: Log probability of one fallback byte.
BYTE_SCORE = -20.0


def _vocabulary(model_file: str):
    """The tokenizer and its ordinary pieces by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return sp, {i: sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


def _distinct(texts: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pre-tokens of the texts, the number of each one among them, and how many each text has."""
    split = [utf8(t).split() if t else [] for t in texts]
    coded = pc.dictionary_encode(pa.array([w for found in split for w in found], pa.binary()))
    return coded.dictionary, coded.indices.to_numpy(), np.array([len(found) for found in split], np.int64)


def _summed(counted: pa.Table) -> pa.Table:
    """(w, n) with one row for each w."""
    return counted.group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"])


def piece_counts(df: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """(piece, n): how often the tokenizer uses each piece (by id) for the pre-tokens of all rows."""

    def run(batches):
        sp, _ = _vocabulary(model_file)
        sums = np.zeros(sp.get_piece_size(), np.int64)
        parts: list[pa.Table] = []
        held = distinct = 0

        def flush(counted):
            n = counted["n"].to_numpy()
            for at in range(0, len(n), 10_000):
                part = counted["w"].slice(at, 10_000).to_pylist()
                coded = sp.encode([w.decode("utf-8", "replace") for w in part], num_threads=1)
                size = np.fromiter(map(len, coded), np.int64, len(coded))
                ids = np.fromiter(chain.from_iterable(coded), np.int64, int(size.sum()))
                np.add.at(sums, ids, np.repeat(n[at : at + len(coded)], size))

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, to in slices([len(t or "") for t in texts], SLICE_BYTES, SLICE_ROWS):
                seen, index, _ = _distinct(texts[at:to])
                parts.append(pa.table([seen, np.bincount(index, minlength=len(seen))], names=["w", "n"]))
                held += len(seen)
                # merged once as much is new as is held, so that every word is merged a few times only
                if held > distinct + MOST_WORDS:
                    parts = [_summed(pa.concat_tables(parts))]
                    held = distinct = len(parts[0])
                    if distinct > MOST_WORDS:
                        flush(parts.pop())
                        held = distinct = 0
        if parts:
            flush(_summed(pa.concat_tables(parts)))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["piece", "n"])

    return df.select(text).mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_scores(model_file: str, counts: dict[int, int]) -> dict[str, float]:
    """Natural log probability of each ordinary piece by the counts of pieces."""
    _, pieces = _vocabulary(model_file)
    total = math.log(sum(counts.get(i, 0) for i in pieces) + 0.5 * len(pieces))
    return {p: math.log(counts.get(i, 0) + 0.5) - total for i, p in pieces.items()}


class Trie:
    """Pre-tokens as paths; nodes hold the forward score and the number of pieces of their prefix."""

    def __init__(self, scores: dict[str, float], most: int = MOST_NODES):
        # pieces and all ends of pieces, which have no score: what is neither ends no piece
        self.ends: dict[str, float | None] = dict.fromkeys(p[i:] for p in scores for i in range(1, len(p)))
        self.ends.update(scores)
        self.single = {p for p in scores if len(p) == 1}
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.next: dict[int, int] = {}
        self.best, self.count = array("d", [0.0]), array("i", [0])
        self.terminals: dict[bytes, int] = {}

    @property
    def nodes(self) -> int:
        return len(self.best) - 1

    def insert(self, tokens) -> None:
        """Adds the tokens that have no terminal yet; a full trie is left for a new one first."""
        if self.nodes > self.most:
            self._empty()
        follow, best, count, ends, single, no_end = self.next, self.best, self.count, self.ends, self.single, self
        terminals = self.terminals
        # neighbours in the trie one after the other
        for t in sorted(t for t in tokens if t not in terminals):
            word, node, path = MARK + t.decode("utf-8", "surrogatepass"), 0, [0]
            for c in word:
                node = follow.get(node << 21 | ord(c))
                if node is None:
                    break
                path.append(node)
            for end in range(len(path), len(word) + 1):
                top, pieces = None, 0
                for start in range(end - 1, -1, -1):
                    s = ends.get(word[start:end], no_end)
                    if s is no_end:
                        break
                    if s is not None:
                        at = path[start]
                        s += best[at]
                        if top is None or s > top or (s == top and count[at] + 1 < pieces):
                            top, pieces = s, count[at] + 1
                c = word[end - 1]
                if c not in single:
                    n = len(utf8(c))
                    s = best[path[-1]] + n * BYTE_SCORE
                    if top is None or s > top:
                        top, pieces = s, count[path[-1]] + n
                follow[path[-1] << 21 | ord(c)] = len(best)
                path.append(len(best))
                best.append(top)
                count.append(pieces)
            terminals[t] = path[-1]

    def figures(self, tokens) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and scores of tokens that were inserted."""
        at = np.fromiter(map(self.terminals.__getitem__, tokens), np.int64, len(tokens))
        return np.frombuffer(self.count, np.int32)[at].astype(np.int64), np.frombuffer(self.best)[at]


_kept: list[tuple[dict, Trie]] = []


def kept_trie(scores: dict[str, float]) -> Trie:
    """The trie of this worker process, which its tasks of one query go on with; one of other scores goes."""
    if not _kept or _kept[0][0] is not scores:
        _kept[:] = [(scores, Trie(scores))]
    return _kept[0][1]


def count_tokens(df: DataFrame, model_file: str, text: str = "text", scores: dict[str, float] | None = None) -> DataFrame:
    """df with n_words, n_tokens (long) and token_score (double, the natural log probability of the segmentation).

    Without scores of pieces they are learned from df, in a pass of its own.
    """
    if scores is None:
        scores = piece_scores(model_file, {r["piece"]: r["n"] for r in piece_counts(df, model_file, text).collect()})
    shared = df.sparkSession.sparkContext.broadcast(scores)

    def make():
        trie = kept_trie(shared.value)

        def each(texts):
            seen, index, size = _distinct(texts)
            seen = seen.to_pylist()
            got = []
            for at in range(0, len(seen), AT_ONCE):
                trie.insert(seen[at : at + AT_ONCE])
                got.append(trie.figures(seen[at : at + AT_ONCE]))
            pieces, score = map(np.concatenate, zip(*got)) if got else (np.empty(0, np.int64), np.empty(0))
            tokens, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            some = np.flatnonzero(size)
            if len(some):
                first = (np.cumsum(size) - size)[some]
                tokens[some], total[some] = np.add.reduceat(pieces[index], first), np.add.reduceat(score[index], first)
            return [pa.array(size), pa.array(tokens), pa.array(total)]

        return each

    return map_texts(df, text, "n_words long, n_tokens long, token_score double", make, most=SLICE_BYTES, rows=SLICE_ROWS)
