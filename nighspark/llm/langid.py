"""Language identification: script ranges narrow the candidates, Viterbi over words labels the spans.

A word (run of letters) is scored under each language by its character n-grams, hashed into a table of log
probabilities learned from labelled documents. Only languages that the labelled text shows in the word's script are
candidates. A document's words are labelled by the best path that pays `penalty` at each change of language, so a foreign
name does not start a span but a foreign passage does. The prediction is the language with most letters; the score is its
share of the letters, weighted by how sure its spans are.

The model is a fixed-size table (2^bits x languages counts), whatever the corpus: every task counts its labelled rows
into sparse cells, the cells are summed by key, and the table is broadcast.

Defined cases: a null text, or one without letters (marks alone are none), gives `und` and score 0; null labels are not
learned, every other label is a language; ties go to the language first in alphabetical order; with no labelled row at
all every text is `und`; an empty table gives no rows; repeated rows get equal labels; texts of any length are labelled
whole (a task holds 5 bytes per word and language of the longest text); columns named as the new ones give way to them,
others pass through.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nighspark.llm.common import map_texts, slices, trimmed

UNKNOWN = "und"
BITS = 16
#: Rows learned from per language at most, about (chosen by hash of the text), the documented bound on the sample.
SAMPLE_PER_LANG = 4000
#: Price in nats of changing language between two words.
PENALTY = 6.0
ORDERS = (1, 2, 3)

# First and last code points of Unicode script ranges, by script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
_NAMES = [*SCRIPTS, "other"]
_OTHER = len(SCRIPTS)
#: Added to a script's number for the marks that go on a word but are no letters.
MARK = 64


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


@functools.cache
def script_table() -> np.ndarray:
    """Script number of each letter's code point, MARK more for a mark, -1 for others. Built on the driver."""
    kinds = np.full(0x110000, -1, np.int8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            kinds[a : b + 1] = k
    for c in range(0x110000):
        category = unicodedata.category(chr(c))[0]
        if category not in "LM" or c < 0x80 and kinds[c] < 0:
            kinds[c] = -1
        else:
            kinds[c] = (kinds[c] if kinds[c] >= 0 else _OTHER) + MARK * (category == "M")
    return kinds


class Words:
    """The words of several texts laid end to end: n-gram cells by position, word bounds, scripts, letters."""

    def __init__(self, texts: list, kinds: np.ndarray, bits: int):
        parts = [_code_points(t + "\n" if t else "\n") for t in texts]
        mark = np.array([10], np.uint32)
        cp = np.concatenate([mark, *parts, mark])
        ends = np.cumsum([1, *(len(p) for p in parts)])
        script = kinds[np.minimum(cp, 0x10FFFF)]
        letter = script >= 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        marks = np.concatenate(([0], np.cumsum(script >= MARK, dtype=np.int32)))
        if marks[-1]:
            some = marks[self.ends] - marks[self.starts] < self.ends - self.starts
            self.starts, self.ends = self.starts[some], self.ends[some]
        script = script % MARK
        self.docs = np.searchsorted(ends, self.starts, side="right") - 1
        self.letters = self.ends - self.starts
        self.script = script[self.starts]
        # n-grams end at each letter of a word and at the mark behind it
        x = np.where(letter, cp, np.uint32(0))
        self.cells = []
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h[n - 1 :] += x[: len(x) - n + 1]
            h += np.uint32(n)
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                self.cells.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.uint16 if bits <= 16 else np.uint32))
        self.letter, self.size = letter, len(x)


def _learn(labelled: DataFrame, text: str, lang: str, bits: int):
    """(lang, cell, n) summed over the labelled rows; cells below 0 count words by script."""
    shared = labelled.sparkSession.sparkContext.broadcast(script_table())

    def run(batches):
        kinds, sums = shared.value, {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for of in set(langs):
                texts = [t for t, x in zip(batch.column(0).to_pylist(), langs) if x == of and t]
                for at, to in slices([len(t) for t in texts]):
                    w = Words(texts[at:to], kinds, bits)
                    if not len(w.starts):
                        continue
                    inside = w.letter.copy()
                    inside[w.ends] = True
                    cells, scripts = sums.setdefault(of, (np.zeros(1 << bits, np.int64), np.zeros(len(_NAMES), np.int64)))
                    for c in w.cells:
                        cells += np.bincount(c[inside], minlength=1 << bits)
                    scripts += np.bincount(w.script, minlength=len(_NAMES))
        for of, (cells, scripts) in sums.items():
            at = np.flatnonzero(cells)
            got = np.flatnonzero(scripts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([of] * (len(at) + len(got))), pa.array(np.concatenate([at, -1 - got])), pa.array(np.concatenate([cells[at], scripts[got]]))], names=["lang", "cell", "n"]
            )
        batch = texts = w = None
        trimmed()

    got = labelled.select(text, lang).mapInArrow(run, "lang string, cell long, n long")
    return got.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], logs: np.ndarray, allowed: np.ndarray, bits: int):
        self.langs, self.logs, self.allowed, self.bits = langs, logs, allowed, bits

    def label(self, texts: list, kinds: np.ndarray, penalty: float = PENALTY) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words, each word's scores by language and its label on the best path of its document."""
        w = Words(texts, kinds, self.bits)
        scores = np.empty((len(w.starts), len(self.langs)), np.float32)
        for at in range(0, len(w.starts), 50_000):  # word by word would be slow, all at once large
            first, last = w.starts[at : at + 50_000], w.ends[at : at + 50_000]
            low = int(first[0])
            gain = sum(self.logs[c[low : int(last[-1]) + 2]] for c in w.cells)
            scores[at : at + 50_000] = np.add.reduceat(gain, np.stack([first - low, last + 1 - low], 1).ravel(), axis=0)[::2]
        allowed = self.allowed[w.script]
        allowed = np.where(allowed.any(1, keepdims=True), allowed, True)
        scores = np.where(allowed, scores, np.float32(-1e4)).astype(np.float32)
        return w, scores, viterbi(scores, w.docs, penalty)


def viterbi(scores: np.ndarray, docs: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row; documents are runs of equal `docs` and go side by side, one word of each at a step."""
    n, k = scores.shape
    out = np.zeros(n, np.int64)
    if not n or k == 1:
        return out
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    length = np.diff(np.concatenate((first, [n])))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # documents with more than t words
    number = np.int8 if k <= 127 else np.int32
    came = np.zeros((n, k), number)
    value = scores[first].copy()
    for t in range(1, int(length[0])):
        m = active[t]
        v = value[:m]
        top = v.argmax(1)
        jump = v[np.arange(m), top] - penalty
        stay = v >= jump[:, None]
        at = first[:m] + t
        came[at] = np.where(stay, np.arange(k, dtype=number), top[:, None].astype(number))
        value[:m] = np.where(stay, v, jump[:, None]) + scores[at]
    label = value.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        out[at] = label[:m]
        label[:m] = came[at, label[:m]] if t else label[:m]
    return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, per_lang: int = SAMPLE_PER_LANG, key: Column | None = None) -> Model | None:
    """The model of labelled rows with a text and a label, at most about per_lang of each language, chosen by hash."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    # as many rows as languages, which the model's table holds on the driver too
    shares = labelled.sparkSession.createDataFrame([(x, min(1.0, per_lang / c)) for x, c in counts.items()], "__ns_lang string, __ns_share double")
    key = F.xxhash64(text) if key is None else key
    rows = rows.join(F.broadcast(shares), F.col(lang) == F.col("__ns_lang")).where(F.pmod(key, F.lit(1 << 20)) < F.col("__ns_share") * (1 << 20))
    langs = sorted(counts)
    table = np.zeros((1 << bits, len(langs)))
    seen = np.zeros((len(_NAMES), len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    for r in _learn(rows, text, lang, bits).toPandas().itertuples(index=False):
        i = place[r.lang]
        if r.cell >= 0:
            table[r.cell, i] = r.n
        else:
            seen[-1 - r.cell, i] = r.n
    logs = np.log((table + 0.5) / (table.sum(0) + 0.5 * (1 << bits)))
    # a script counts as a language's own from one word in a thousand on
    allowed = seen >= np.maximum(1, 0.001 * seen.sum(0))
    return Model(langs, logs.astype(np.float32), allowed, bits)


def identify(df: DataFrame, model: Model | None, text: str = "text", penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """df with lang_pred and score; with spans also `spans`: (lang, first word, last word, letters) of each labelled run."""
    ddl = "lang_pred string, score double" + (", spans array<struct<lang:string,first:int,last:int,letters:int>>" if spans else "")
    if model is None:
        out = df.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
        return out.withColumn("spans", F.array().cast("array<struct<lang:string,first:int,last:int,letters:int>>")) if spans else out
    shared = df.sparkSession.sparkContext.broadcast((vars(model), script_table()))

    def make():
        own = object.__new__(Model)
        own.__dict__, kinds = shared.value

        def each(texts):
            w, scores, label = own.label(texts, kinds, penalty)
            k, names = len(own.langs), own.langs
            letters = np.zeros((len(texts), k))
            np.add.at(letters, (w.docs, label), w.letters)
            best = letters.argmax(1)
            # how much likelier the winner's own words are under it than under the next language, squashed to 0..1
            margin = np.zeros(len(texts))
            if len(label) and k > 1:
                rest = scores.copy()
                rest[np.arange(len(label)), label] = -np.inf
                mine = label == best[w.docs]
                np.add.at(margin, w.docs[mine], (scores[np.arange(len(label)), label] - rest.max(1))[mine])
                sure = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            else:
                sure = np.ones(len(texts))
            whole = letters.sum(1)
            known = whole > 0
            score = np.where(known, letters[np.arange(len(texts)), best] / np.maximum(whole, 1) * sure, 0.0)
            made = [pa.array([names[b] if y else UNKNOWN for b, y in zip(best.tolist(), known.tolist())]), pa.array(np.clip(score, 0, 1))]
            if spans:
                made.append(pa.array(_spans(w, label, names, len(texts)), pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("letters", pa.int32())]))))
            return made

        return each

    return map_texts(df, text, ddl, make)


def _spans(w: Words, label: np.ndarray, names: list[str], n: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    count = [0] * n
    for d, x, c in zip(w.docs.tolist(), label.tolist(), w.letters.tolist()):
        if out[d] and out[d][-1]["lang"] == names[x]:
            out[d][-1]["last"] = count[d]
            out[d][-1]["letters"] += c
        else:
            out[d].append({"lang": names[x], "first": count[d], "last": count[d], "letters": c})
        count[d] += 1
    return out
