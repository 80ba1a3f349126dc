"""Shared pieces: tables written to the cluster's shared folder, connected components, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a one-column key table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and the master is local, a temporary one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nighspark-"))
        return shared_dir(spark)
    return base


#: Rows and bytes of an Arrow batch: buffers of both sides of a worker's pipe lie beside the heap.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}
#: Held while an intermediate table is written: its shuffle files go once it is there, and Arrow batches stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **_BATCHES}


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/nighspark/{tag}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._nighspark_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for t in tables:
        path = getattr(t, "_nighspark_path", None)
        if path:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            pass


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of 2048 rows or 2 MB in this session, so that tasks need little memory beside the heap."""
    for k, v in _BATCHES.items():
        spark.conf.set(k, v)


def trimmed() -> None:
    """Gives back to the system what this worker has freed; else a worker keeps the memory of its largest task until it ends."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(keys: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """keys (narrow rows) with a broadcast hint if their counted number is within the bound, else as they are."""
    return F.broadcast(keys) if rows <= most else keys


def row_key(df: DataFrame, *columns: str) -> Column:
    """Hash of a row's columns (all of df's by default) that tells nulls apart by place, for columns of any type."""
    parts = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType
        value = F.col(f"`{c}`")
        parts += [value.isNull(), value if isinstance(kind, T.AtomicType) else F.to_json(F.struct(value))]
    return F.xxhash64(*parts)


def boxed(df: DataFrame, *columns: str) -> DataFrame:
    """__ns_all (a struct of all columns of df) beside the named columns, so that no name of df can clash with an operator's."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__ns_all"), *(F.col(f"`{c}`") for c in columns))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("__ns_all.*")


def joined_by(rows: DataFrame, keys: DataFrame, on: str, weight: str, most: int = 1000) -> DataFrame:
    """rows inner joined with keys (one row for each value of `on`, `weight` of which counts the rows that have it).

    Values with a share of 1/most or more of all those rows, at most `most` of them, are broadcast, so that their rows
    stay where they are; the others are joined in a shuffle without them.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * most >= total
    hot = F.broadcast(keys.where(heavy))
    rest = rows.join(hot.select(on), on, "left_anti").join(keys.where(~heavy), on)
    return rows.join(hot, on).unionByName(rest)


def utf8(text) -> bytes:
    """UTF-8 bytes of a text, lone surrogates kept."""
    return text.encode("utf-8", "surrogatepass")


def words(text) -> list[bytes]:
    """Lower-cased (A-Z only) words [^\\x20\\x09-\\x0D]+ as UTF-8 bytes; bytes.split splits at exactly these."""
    return utf8(text).lower().split()


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the run of `width` words from each place on."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n] * _A
    for i in range(1, width):
        acc = (acc ^ (acc >> np.uint64(29))) * _B + h[i : n + i]
    return mixed(acc + np.uint64(width))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the distinct runs of `width` words (sorted); fewer words give the whole sequence as one."""
    return np.unique(runs_of(h, min(width, len(h)))) if len(h) else h


#: Links up to which one task finds the components (16 bytes each in memory); beyond it rounds of joins do.
FEW_LINKS = 200_000


def _forest(batches):
    """(id, component) of the links (u, v) of all batches, by merging trees."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = parent.setdefault(x, x)
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    ids = list(parent)
    for at in range(0, len(ids), 10_000):
        part = ids[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "cc", few: int = FEW_LINKS) -> DataFrame:
    """(id, component) for every id in the links of edges; component is the smallest id reachable.

    Alternating large-star and small-star rounds, each written to the shared folder; a round is two aggregations
    and two joins on ids, whose hot ids adaptive execution splits. Ends when a round changes nothing. A counted, small
    number of links (`few`) is left to one task, with the same result.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    e, before = written(e, tag), None
    if e.count() <= few:
        out = written(e.select("u", "v").coalesce(1).mapInArrow(_forest, "id long, component long"), tag)
        drop_written(e)
        return out
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, tag)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(e)
        e = new
        if state == before:
            break
        before = state
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: Rows and bytes of text of an Arrow batch handled at once in Python; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 512, 2_000_000


def slices(sizes: list, most: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """(from, to) of runs of rows within `rows` rows and `most` bytes."""
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and (i - at >= rows or held + size > most):
            yield at, i
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def map_texts(df: DataFrame, text: str, ddl: str, make, keep: list[str] | None = None, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> DataFrame:
    """df (or its columns `keep`) with the columns of `ddl` worked out from one text column, batch by batch.

    make() gives, once a task, a function from a list of texts to a list of Arrow arrays. Every other column goes
    through as Arrow; a column of df with the name of a new one gives way to it. text may be a field of a struct.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    new = T._parse_datatype_string(ddl).fields
    keep = [c for c in (df.columns if keep is None else keep) if c not in {f.name for f in new}]
    source = "__ns_source"
    schema = T.StructType([*(df.schema[c] for c in keep), *new])
    names = schema.names

    def run(batches):
        each = make()
        for batch in batches:
            sizes = pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
            for at, to in slices(np.nan_to_num(sizes).tolist(), most, rows):
                part = batch.slice(at, to - at)
                made = each(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=names)
        batch = part = made = each = None
        trimmed()

    return df.select(*keep, F.col(text).alias(source)).mapInArrow(run, schema)
