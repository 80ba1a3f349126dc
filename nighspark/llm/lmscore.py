"""Language-model scoring by logistic context mixing over bits, beside a smoothed unigram baseline over words.

Mixing model. A text is its sequence of lower-cased words, written as UTF-8 bytes with a space behind each word and an
end byte; each byte is eight binary choices. For every context (the last 0 to 5 bytes) it is counted how often each bit
followed context and partial byte in the training texts. The logits of these predictors are mixed by a weight vector that
a gate picks (bit position and number of orders that know the context), and an adaptive table over (partial byte, mixed
logit) refines the result. The weights are learned online, step by step through the training statistics, each occurrence
predicted from the counts without itself; the weights of different buckets are averaged by their number of bits. Scoring
then holds all of it fixed, so the score of a text does not depend on where or after which other texts it is scored.

Counts are exact, whatever the corpus: they are kept as distinct strings of 6 bytes (the longest context and the byte
itself), a table that grows with the corpus. It is dealt into buckets by the two bytes before the last, so all strings that
share a context of 2 bytes or more are in one bucket, where sums over runs of sorted strings give the counts of every
context and partial byte. Contexts of 0 and 1 byte come from a broadcast table of 256 x 256. The probability of a
string's last byte depends on the string only, so it is worked out once for each distinct string and met per block.

The word as a whole is one more context: a token's probability is mixed from that of its bytes and its share of the
training tokens. The latter's weight is WORD_WEIGHT of the share of new text that will be words seen before (one less the
share of tokens whose word was seen once).

What travels: weights, and one row per distinct word and per distinct 6-byte string of each block of documents. Blocks
hold about `block_bytes` of text; a block meets the corpus figures of its own words and strings only, so no task or driver
ever holds the vocabulary.

Defined cases: a null text counts as empty (one token, the end); texts of any length are scored whole, each within one task;
words are compared by 64-bit hash; repeated rows are scored each; an empty table gives no rows; with no training text the
baseline has N = V = 0 and the mixing model is uniform; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nighspark.llm.common import drop_written, mixed, slices, trimmed, word_hashes, words, written

#: Bytes of each context, the bytes kept of a position (the longest context and the byte itself).
CONTEXTS = (0, 1, 2, 3, 4, 5)
ORDERS, WIDTH = len(CONTEXTS), max(CONTEXTS) + 1
#: Distinct strings of a bucket, about, and the least number of buckets.
BUCKET_GRAMS, LEAST_BUCKETS = 100_000, 24
BLOCK_BYTES = 16_000_000
RATE, EPOCHS, ROUNDS, BUCKETS = 0.02, 4, 2, 33
#: Bytes of text whose strings of 6 bytes are held at once: each byte takes about 50.
SLICE = 500_000
#: Rows of a batch that leaves a block.
OUT_ROWS = 65_536
#: Hash standing for the end token.
END = np.uint64(0x5DEECE66D1234567)
WORD_WEIGHT = 0.7
_LIMIT = 1e-6


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Every byte (and end byte) of the texts' words with those before it as one integer, and how many each text has."""
    parts = [np.frombuffer(b" ".join([*words(t or ""), b"\0"]), np.uint8) for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    x = np.concatenate(parts).astype(np.uint64)
    at = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    out = x.copy()
    for back in range(1, WIDTH):
        prev = np.concatenate([np.zeros(back, np.uint64), x])[: len(x)]
        out |= np.where(at >= back, prev, np.uint64(0)) << np.uint64(8 * back)
    return out, size


def _runs(gram: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """[d, gram]: the count of all grams with this one's context of the order and first d bits of its last byte."""
    value = gram & np.uint64((1 << 8 * (CONTEXTS[order] + 1)) - 1)
    at = np.argsort(value)
    value, total = value[at], np.concatenate(([0], np.cumsum(n[at])))
    out = np.empty((9, len(gram)), np.float32)
    for d in range(9):
        part = value >> np.uint64(8 - d)
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        first = np.concatenate(([0], ends[:-1]))
        out[d, at] = np.repeat(total[ends] - total[first], ends - first)
    return out


def _bit(gram: np.ndarray, k: int) -> np.ndarray:
    return (gram >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Mixer:
    """Counts [last byte of the context, byte], weights [gate, order] and refining counts [partial byte, bucket]."""

    def __init__(self, low: np.ndarray, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.low, self.refine = low, refine
        self.weights = np.full((8 * (ORDERS + 1), ORDERS), 0.4) if weights is None else weights

    def state(self) -> dict:
        """What tasks need of it."""
        return {"low": self.low, "weights": self.weights, "refine": self.refine}

    def runs(self, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """[order, d, gram] counts by _runs; the grams must hold all training grams that share two bytes of context with one of them."""
        symbol, before = ((gram >> np.uint64(8 * i) & np.uint64(0xFF)).astype(np.int64) for i in (0, 1))
        out = np.empty((ORDERS, 9, len(gram)), np.float32)
        for order, size in enumerate(CONTEXTS):
            if size > 1:
                out[order] = _runs(gram, n, order)
                continue
            table, at = (self.low, before) if size else (self.low.sum(0, keepdims=True), 0)
            for d in range(9):
                out[order, d] = table.reshape(len(table), 1 << d, -1).sum(2)[at, symbol >> (8 - d)]
        return out

    def inputs(self, runs: np.ndarray, gram: np.ndarray, k: int, without: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Logits by order and how many orders know the context; `without` leaves one occurrence of the bit itself out of the counts."""
        own, other = runs[:, k + 1], runs[:, k] - runs[:, k + 1]
        if without:
            own = np.maximum(own - 1, 0)
        logit = np.log((own + np.float32(0.3)) / (other + np.float32(0.3))) * np.where(_bit(gram, k) == 1, 1, -1).astype(np.float32)
        return np.ascontiguousarray(logit.T), (own + other > 0).sum(0)

    def mix(self, logit: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
        return np.clip((logit * self.weights[k * (ORDERS + 1) + known]).sum(1), -13, 13)

    def refined(self, z: np.ndarray, gram: np.ndarray, k: int) -> np.ndarray:
        p = _squash(z)
        if self.refine is not None:
            cell = self.refine[_node(gram, k), _bucket(z)]
            p = (p + (cell[:, 1] + 8 * p) / (cell.sum(1) + 8)) / 2
        return np.clip(p, _LIMIT, 1 - _LIMIT)

    def costs(self, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram of a bucket."""
        total, runs = np.zeros(len(gram)), self.runs(gram, n)
        for k in range(8):
            logit, known = self.inputs(runs, gram, k)
            p = self.refined(self.mix(logit, known, k), gram, k)
            total += np.log10(np.where(_bit(gram, k) == 1, p, 1 - p))
        return total

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """The same of any grams, on the driver."""
        asked = self.cells.sparkSession.createDataFrame([(int(g), 0) for g in np.unique(gram)], "gram long, n long")
        both = self.cells.unionByName(asked).groupBy("gram").agg(F.sum("n").alias("n"))
        found = {r["gram"]: r["cost"] for r in gram_costs(self, both).join(asked.select("gram"), "gram").collect()}
        return np.array([found[int(g)] for g in gram])

    def learn(self, gram: np.ndarray, n: np.ndarray, runs: np.ndarray, step: int = 512) -> np.ndarray:
        """Online descent through the grams in order; the bits seen by each gate."""
        seen = np.zeros((8, ORDERS + 1))
        gates = np.arange(ORDERS + 1)[:, None]
        for k in range(8):
            bit = _bit(gram, k)
            logit, known = self.inputs(runs, gram, k, without=True)
            seen[k] = np.bincount(known, weights=n, minlength=ORDERS + 1)
            own = self.weights[k * (ORDERS + 1) : (k + 1) * (ORDERS + 1)]
            for _ in range(EPOCHS):
                for at in range(0, len(gram), step):
                    x, g, w = logit[at : at + step], known[at : at + step], n[at : at + step]
                    error = (bit[at : at + step] - _squash(np.clip((x * own[g]).sum(1), -13, 13))) * w
                    of = (g == gates).astype(np.float64)
                    own += RATE * (of @ (error[:, None] * x)) / np.maximum(of @ w, 1)[:, None]
        return seen.ravel()


def _node(gram: np.ndarray, k: int) -> np.ndarray:
    return ((1 << k) | ((gram & np.uint64(0xFF)) >> np.uint64(8 - k)).astype(np.int64)).astype(np.int64)


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order and the sum of the counts of each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class _Tally:
    """Sums of counts by key; parts are merged whenever as much is pending as is held."""

    def __init__(self):
        self.key, self.n, self.parts, self.pending = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        self.pending += len(key)
        if self.pending > max(len(self.key), 200_000):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            keys, counts = zip((self.key, self.n), *self.parts)
            self.parts, self.pending = [], 0
            self.key, self.n = _counted(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
        return self.key, self.n


def _grams_of(train: DataFrame, text: str, most: int = 3_000_000) -> DataFrame:
    """(gram, n) over the training texts; tasks flush what they hold beyond `most` distinct ones."""

    def run(batches):
        tally = _Tally()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(tally.key.view(np.int64)), pa.array(tally.n)], names=["gram", "n"])
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, to in slices([len(t or "") for t in texts], SLICE):
                found = pc.value_counts(pa.array(grams(texts[at:to])[0]))
                tally.add(found.field(0).to_numpy(), found.field(1).to_numpy())
                if len(tally.merge()[0]) > most:
                    yield out()
                    tally = _Tally()
        tally.merge()
        yield out()

    return train.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _arrays(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()


def _bucketed(cells: DataFrame) -> DataFrame:
    """cells with the bucket of the two bytes before each gram's last."""
    buckets = max(LEAST_BUCKETS, -(-cells.count() // BUCKET_GRAMS))
    return cells.withColumn("bucket", F.pmod(F.xxhash64(F.expr("shiftright(gram, 8) & 65535")), F.lit(buckets)).cast("int"))


def gram_costs(mixer: Mixer, cells: DataFrame) -> DataFrame:
    """(gram, cost): log10 probability of each gram's last byte; cells hold all grams of the corpus, n counting training texts."""
    shared = cells.sparkSession.sparkContext.broadcast(mixer.state())

    def costs(table: pa.Table) -> pa.Table:
        gram, n = _arrays(table)
        cost = _mixer(shared.value).costs(gram, n)
        trimmed()
        return pa.table([table["gram"], pa.array(cost)], names=["gram", "cost"])

    return _bucketed(cells).select("gram", "n", "bucket").groupBy("bucket").applyInArrow(costs, "gram long, cost double")


def train_mixer(train: DataFrame, text: str = "text") -> Mixer:
    """The mixing model of all rows of `train`."""
    return fitted(written(_grams_of(train, text), "grams"))


def fitted(cells: DataFrame) -> Mixer:
    """The mixing model of training statistics (gram, n)."""
    spark = cells.sparkSession
    low = np.zeros((256, 256))
    for r in cells.groupBy(F.expr("gram & 65535").alias("at")).agg(F.sum("n").alias("n")).collect():  # 65536 rows at most
        low.ravel()[r["at"]] = r["n"]
    mixer = Mixer(low)
    mixer.cells = cells
    held = _bucketed(cells.where("n > 0")).select("gram", "n", "bucket").groupBy("bucket")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(mixer.state())

        def steps(table):
            own = _mixer(shared.value)
            own.weights = own.weights.copy()
            gram, n = _arrays(table)
            order = np.argsort(mixed(gram))
            gram, n = gram[order], n[order]
            seen = own.learn(gram, n.astype(np.float64), own.runs(gram, n))
            total = own.weights * seen[:, None]
            gate = np.arange(own.weights.size) // ORDERS
            return pa.table([pa.array(np.arange(own.weights.size)), pa.array(total.ravel()), pa.array(seen[gate])], names=["at", "w", "n"])

        sums = held.applyInArrow(steps, "at long, w double, n double").groupBy("at").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).where("n > 0").collect()
        flat = mixer.weights.ravel().copy()
        for r in sums:
            flat[r["at"]] = r["w"] / r["n"]
        mixer.weights = flat.reshape(mixer.weights.shape)
    shared = spark.sparkContext.broadcast(mixer.state())

    def refine(table):
        own, cell = _mixer(shared.value), np.zeros(256 * BUCKETS * 2)
        gram, n = _arrays(table)
        runs = own.runs(gram, n)
        for k in range(8):
            logit, known = own.inputs(runs, gram, k, without=True)
            at = (_node(gram, k) * BUCKETS + _bucket(own.mix(logit, known, k))) * 2 + _bit(gram, k)
            cell += np.bincount(at, weights=n, minlength=len(cell))
        at = np.flatnonzero(cell)
        return pa.table([pa.array(at), pa.array(cell[at].astype(np.int64))], names=["at", "n"])

    table = np.zeros(256 * BUCKETS * 2)
    for r in held.applyInArrow(refine, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        table[r["at"]] = r["n"]
    mixer.refine = table.reshape(256, BUCKETS, 2)
    return mixer


def _mixer(state: dict) -> Mixer:
    own = object.__new__(Mixer)
    own.__dict__ = dict(state)
    return own


def _word_slices(column):
    """(texts, from, to, hash of each token of the slice, tokens of each text) of a column; every text ends with the end token."""
    size_of = np.nan_to_num(pc.binary_length(column).to_numpy().astype(float)).tolist()
    for at, to in slices(size_of, SLICE):
        texts = column.slice(at, to - at).to_pylist()
        found = [words(t or "") for t in texts]
        size = np.array([len(w) + 1 for w in found], np.int64)
        hashes = np.empty(int(size.sum()), np.uint64)
        ends = np.cumsum(size) - 1
        inner = np.ones(len(hashes), bool)
        inner[ends] = False
        hashes[inner] = word_hashes([w for f in found for w in f])
        hashes[ends] = END
        yield texts, at, to, hashes, size


def _block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, spelled, key, n) of one block: its distinct words and 6-byte strings (spelled), and how often its training texts have them."""
    tallies, block = (_Tally(), _Tally()), None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held, block = table["held_out"].to_numpy(), table["block"][0].as_py()
        for texts, at, to, hashes, size in _word_slices(table["text"]):
            for tally, (found, each) in zip(tallies, ((hashes, size), grams(texts))):
                seen = pc.dictionary_encode(pa.array(found))
                distinct = seen.dictionary.to_numpy()
                tally.add(distinct, np.bincount(seen.indices.to_numpy(), weights=np.repeat(~held[at:to], each), minlength=len(distinct)).astype(np.int64))
    for spelled, tally in enumerate(tallies):
        key, n = tally.merge()
        for at in range(0, len(key), OUT_ROWS):
            k, c = key[at : at + OUT_ROWS].view(np.int64), n[at : at + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int32)), pa.array(np.full(len(k), bool(spelled))), pa.array(k), pa.array(c)], names=["block", "spelled", "key", "n"])
    table = batch = texts = hashes = found = seen = distinct = tally = tallies = key = n = None
    trimmed()


def _by_key(table: pa.Table, figure: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order and their figures."""
    key, c = table["key"].to_numpy().view(np.uint64), table[figure].to_numpy()
    order = np.argsort(key)
    return key[order], c[order]


def score_texts(df: DataFrame, doc_id: str, text: str, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the text) for every row of df."""
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(24, -(-size // block_bytes))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    local = docs.select("text", "held_out", "block").groupBy("block").applyInArrow(_block_keys, "block int, spelled boolean, key long, n long")
    local = written(local, "keys")
    spelled, own = local.where("spelled").select("block", F.col("key").alias("gram"), "n"), local.where("not spelled").select("block", F.col("key").alias("word"), "n")
    cells = written(spelled.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    mixer = fitted(cells)
    costs = written(gram_costs(mixer, cells), "costs")
    drop_written(cells)
    # every block's row of a word gets the word's count over all of them; a word has as many rows as blocks hold it
    word = Window.partitionBy("word")
    counts = written(own.select("block", "word", F.sum("n").over(word).alias("c"), (F.min("block").over(word) == F.col("block")).alias("one")), "words")
    total = counts.where("one and c > 0").agg(F.sum("c"), F.count("*"), F.count(F.when(F.col("c") == 1, 1))).first()
    n, v = int(total[0] or 0), int(total[1])
    seen_share = WORD_WEIGHT * (1 - total[2] / n) if n else 0.0

    def score(docs_of: pa.Table, keys_of: pa.Table) -> pa.Table:
        (key, c), (gram, cost_of) = (_by_key(keys_of.select(["key", y]).filter(pc.equal(keys_of["spelled"], x)), y) for x, y in ((False, "c"), (True, "cost")))
        gain, known = np.log10(c + 0.1), c > 0
        cols, length_of = [[], [], [], []], np.nan_to_num(pc.binary_length(docs_of["text"]).to_numpy().astype(float))
        for texts, _, _, hashes, size in _word_slices(docs_of["text"]):
            found = pc.dictionary_encode(pa.array(hashes))
            where = np.searchsorted(key, found.dictionary.to_numpy())
            index = found.indices.to_numpy()
            first = np.cumsum(size) - size
            cols[0].append(size)
            cols[1].append(np.add.reduceat(known[where][index].astype(np.int64), first))
            cols[2].append(np.add.reduceat(gain[where][index], first))
            g, length = grams(texts)
            seen = pc.dictionary_encode(pa.array(g))
            cost = cost_of[np.searchsorted(gram, seen.dictionary.to_numpy())][seen.indices.to_numpy()]
            # a token's bytes run to the space behind it; the end token is one byte
            ends = (g & np.uint64(0xFF)) == np.uint64(0x20)
            ends[np.cumsum(length) - 1] = True
            ends = np.flatnonzero(ends)
            spelled = np.add.reduceat(cost.astype(np.float64), np.concatenate(([0], ends[:-1] + 1)))
            share = (c[where] / max(n, 1))[index]
            unseen = np.log10(1 - seen_share) + spelled
            token = np.where(share > 0, np.log10(10.0 ** np.maximum(unseen, -300) + seen_share * share), unseen)
            cols[3].append(np.add.reduceat(token, first))
        joined = [np.concatenate(x) for x in cols]
        bits = -joined[3] / np.log10(2) / np.maximum(length_of, 1)
        del key, c, gram, cost_of, gain, known
        trimmed()
        return pa.table([docs_of["id"], docs_of["held_out"], *(pa.array(x) for x in joined), pa.array(bits)], names=["id", "held_out", "n_tokens", "n_known", "gain", "score", "bits_per_byte"])

    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, gain double, score double, bits_per_byte double"
    figures = counts.select("block", F.lit(False).alias("spelled"), F.col("word").alias("key"), F.col("c").cast("double").alias("c"), F.lit(None).cast("float").alias("cost"))
    figures = figures.unionAll(spelled.join(costs.hint("shuffle_hash"), "gram").select("block", F.lit(True), "gram", F.lit(None).cast("double"), F.col("cost").cast("float")))
    out = docs.groupBy("block").cogroup(figures.groupBy("block")).applyInArrow(score, schema)
    norm = float(np.log10(n + 0.1 * (v + 1)))
    return out.select(
        F.col("id").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("gain") - F.col("n_tokens") * norm).alias("base_score"), "score", "bits_per_byte"
    )
