"""Helpers the operators of this subpackage share: scratch tables in the cluster's
shared folder, byte-level word scanning over Arrow buffers, and connected components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch of the registered queries; texts vary from a few bytes to megabytes, so batches stay short.
BATCH_ROWS = 256
#: Bytes of text that an operator works on at a time, whatever the batch holds (or one longer text); bytes of a scratch file, about.
PIECE_BYTES, FILE_BYTES = 1 << 20, 1 << 22
#: Edges that one task may finish (16 MB); beyond that `components` goes on in rounds.
LAST_EDGES = 1 << 20

_scratch: list[str] = []


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a private one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: scratch tables need a folder that all executors share")
    base = tempfile.mkdtemp(prefix="skeinrank-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def size_of(df: DataFrame) -> int:
    """Bytes of `df` as Spark's statistics have them: of a written table its files' size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for what an operator writes by itself; it goes as `materialize`'s do."""
    path = f"{scratch_root(spark).rstrip('/')}/skeinrank-{uuid.uuid4().hex}/{label}"
    _scratch.append(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, label: str, at_most: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, a lost executor costs nothing.

    `at_most` is a bound in bytes, if one is known: a table that takes little work is made by no
    more tasks, and goes to no more files, than that needs. The folder goes when the
    application ends, if `release` doesn't delete it before.
    """
    spark = session_of(df)
    if at_most is not None:
        df = df.coalesce(_files(df, at_most))
    path = scratch_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_paths() -> list[str]:
    return list(_scratch)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables whose readers have finished."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)
        if path in _scratch:
            _scratch.remove(path)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """For applications: operators leave the session's settings alone and only cut what they are given."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, name: str, size: int = PIECE_BYTES):
    """The batches in runs of rows whose texts (column `name`) have `size` bytes together, or one longer text."""
    for batch in batches:
        _, off = text_buffer(batch[name])
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


# ---------------------------------------------------------------- memory of Python workers

_kept: dict[str, object] = {}


def kept(key: str, make):
    """What a Python worker keeps from task to task; of several keys only the last one asked for."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Workers outlive a query's stages: a task that needs nothing kept drops it, and gives freed memory back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


# ---------------------------------------------------------------- hashing

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x.astype(np.uint64) + _C1
    x ^= x >> np.uint64(30)
    x *= _C2
    x ^= x >> np.uint64(27)
    x *= _C3
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x1F123BB5) + np.uint64(77))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = bytes(_LOWER)

#: Word bytes: everything but space and \t..\r.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes: digits, ASCII letters, everything beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

#: Powers that are kept; those beyond are products of two.
_NEAR = 1 << 12
_powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_NEAR - 1, _P)]))


def _powers_of(place: np.ndarray) -> np.ndarray:
    """_P to the power of each place."""
    if not len(place) or (most := int(place.max())) < _NEAR:
        return _powers[place]
    far = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(_powers[-1:] * _P, most // _NEAR)]))
    return _powers[place % _NEAR] * far[place // _NEAR]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return _LOWER[buf]


#: Bytes hashed at a time.
_PIECE = 1 << 19


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, row bounds): each word's first byte, its 64-bit hash, and per row the range of its words."""
    return sized_words(buf, off, is_word)[:3]


def sized_words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `words` returns, and the words' bytes."""
    starts, hashes, sizes = [], [], []
    edge = np.unique(off[:-1]) if len(off) > 1 else off[:0]
    lo = 0
    while lo < len(buf):
        hi = min(len(buf), lo + _PIECE)
        if hi < len(buf):  # end a piece where no word runs on
            back = np.flatnonzero(~is_word[buf[lo:hi]])
            while not len(back) and hi < len(buf):
                lo2, hi = hi, min(len(buf), hi + _PIECE)
                back = np.flatnonzero(~is_word[buf[lo2:hi]]) + (lo2 - lo)
            if len(back) and hi < len(buf):
                hi = lo + int(back[-1]) + 1
        part = buf[lo:hi]
        mask = is_word[part]
        first = mask.copy()
        first[1:] &= ~mask[:-1]
        own = edge[np.searchsorted(edge, lo) : np.searchsorted(edge, hi)] - lo
        first[own] = mask[own]
        at = np.flatnonzero(first)
        if len(at):
            inside = np.flatnonzero(mask)
            begin = np.searchsorted(inside, at)
            size = np.diff(np.append(begin, len(inside)))
            place = np.arange(len(inside)) - np.repeat(begin, size)
            value = _BYTE[part[inside]] * _powers_of(place)
            hashes.append(mix64(np.add.reduceat(value, begin) ^ size.astype(np.uint64)))
            starts.append(at + lo)
            sizes.append(size)
        lo = hi
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return s, h, np.searchsorted(s, off), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def beginnings(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int):
    """For n = 1..most: (n, the words of n bytes or more, the hashes of their first n bytes)."""
    value, at, left, power = np.zeros(len(starts), np.uint64), np.arange(len(starts)), sizes, _powers_of(np.arange(most + 1))
    for n in range(1, most + 1):
        at = at[left[at] >= n]
        value[at] += _BYTE[buf[starts[at] + n - 1]] * power[n - 1]
        yield n, at, mix64(value[at] + np.uint64(n))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ---------------------------------------------------------------- marked rows

#: Bits of the bitmap that marks wanted rows: some for each, this many (16 MB) at most.
MARK_BITS, MARK_MOST = 16, 1 << 27


class Marks:
    """A broadcast bitmap of hashes: all that are in it, and some others when it fills up. Its size is bounded, so
    what it saves shrinks beyond some 8 million marks, never what it lets through."""

    def __init__(self, hashes: DataFrame):
        """hashes(h): longs."""
        self.bits = 1 << max(10, min(MARK_MOST, MARK_BITS * hashes.count() + 1).bit_length() - 1)
        at = hashes.select(F.col("h").bitwiseAND(F.lit(self.bits - 1)).alias("at"))
        # a row for each word of the bitmap that isn't zero, put together before it is shuffled
        rows = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("v")).toArrow()
        words_ = np.zeros(self.bits // 64, np.int64)
        words_[rows["w"].to_numpy()] = rows["v"].to_numpy()
        self.shared = session_of(hashes).sparkContext.broadcast(words_.tobytes())

    def hits(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.int64) & (self.bits - 1)
        own = np.frombuffer(self.shared.value, np.int64)
        return (own[at >> 6] >> (at & 63) & 1).astype(bool)


def id_hash(name: str):
    return F.xxhash64(F.col(f"`{name}`"))


def parted(docs: DataFrame, marks: Marks, id_col: str, wanted: bool) -> DataFrame:
    """Rows of `docs` whose id is marked, or the others."""

    def run(batches):
        let_go()
        for batch in batches:
            got = batch.filter(pa.array(marks.hits(batch["__h"].to_numpy()) == wanted))
            if len(got):
                yield got.drop_columns(["__h"])

    return docs.withColumn("__h", id_hash(id_col)).mapInArrow(run, docs.schema)


def settled(docs: DataFrame, verdicts: DataFrame, key_of, key_type: T.DataType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that verdicts(id, key, stays) turn down, and with one row of each id and key that stays.

    `key_of` makes the keys of an Arrow column of texts. Rows whose id isn't marked, most of them,
    pass without a shuffle; only the marked ones are joined. Every id and key that repeats needs a verdict.
    """
    marks = Marks(verdicts.select(id_hash("id").alias("h")))

    def run(batches):
        let_go()
        for batch in batches:
            got = batch.filter(pa.array(marks.hits(batch["__h"].to_numpy()))).drop_columns(["__h"])
            for part in sliced([got] if len(got) else [], text_col):
                yield part.append_column("__key", key_of(part[text_col]))

    keyed = docs.withColumn("__h", id_hash(id_col)).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__key", key_type)]))
    said = verdicts.select(F.col("id").alias("__id"), F.col("key").alias("__k"), F.col("stays").alias("__stays"))
    both = keyed.join(said, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & F.col("__key").eqNullSafe(F.col("__k")), "left").where(F.coalesce("__stays", F.lit(True)))
    own = both.dropDuplicates([id_col, "__key"]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return parted(docs, marks, id_col, False).unionByName(own)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, max_rounds: int = 60, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, component), written: the smallest node reachable over `edges(a, b)`; only nodes with an edge appear.

    First every task contracts its own edges to a spanning forest, so a hub is never gathered in one place. If few
    edges are left (they are counted), one task ends it; else alternating large-star and small-star steps go on over
    written tables, joined where skewed keys can be split, until that is so or the graph is stars.
    """
    e = materialize(_contracted(edges), "cc-0")
    old: list[str] = []
    for r in range(1, max_rounds):
        if e.count() <= last_edges:
            e = _contracted(e.coalesce(1), whole=True)
            break
        before, room = scratch_paths(), 2 * size_of(e)
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"cc-{r}m", room)
        if r % 2:  # large star: every larger neighbour of u hangs on u's smallest
            stars = both.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        else:  # small star: u and its smaller neighbours hang on u's smallest
            own = low.where("m < a").select(F.col("a").alias("x"), F.col("m").alias("y"))
            stars = both.where("b < a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(own)
        nxt = materialize(_contracted(stars.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).coalesce(_files(e, room))), f"cc-{r}")
        # done when the graph is stars already: no root hangs on anything, every leaf hangs on one root
        roots = nxt.select("b").distinct()
        leaves = nxt.groupBy("a").agg(F.countDistinct("b").alias("n"))
        open_ = leaves.where("n > 1").select("a").union(leaves.join(roots, leaves.a == roots.b, "left_semi").select("a"))
        e = nxt
        done = open_.isEmpty()
        release(session_of(edges), old)  # what the round before wrote, read for the last time in this one
        old = [p for p in scratch_paths() if p not in before]
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = e.select("a", "b").union(e.select("b", "b"))
    return materialize(stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "components", 2 * size_of(e))


def _files(df: DataFrame, at_most: int) -> int:
    return min(max(2, session_of(df).sparkContext.defaultParallelism // 2, -(-at_most // FILE_BYTES)), 1 << 30)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over the edges given, for all nodes but the smallest ones."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, up = place[: len(a)], place[len(a) :], np.arange(len(ids))
    while len(u):
        u, v = up[u], up[v]
        apart = u != v
        u, v = np.maximum(u, v)[apart], np.minimum(u, v)[apart]
        np.minimum.at(up, u, v)
        while not np.array_equal(flat := up[up], up):
            up = flat
    own = np.flatnonzero(up != np.arange(len(ids)))
    return ids[own], ids[up[own]]


def _contracted(edges: DataFrame, whole: bool = False) -> DataFrame:
    """Per task, the edges replaced by stars on each local component's smallest node; unless `whole`, a task with very many goes on in parts."""

    def run(batches):
        let_go()
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch["a"].to_numpy()]), np.concatenate([b, batch["b"].to_numpy()])
            if len(a) > 500_000:
                a, b = _roots(a, b)
                if len(a) > 250_000 and not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = a[:0], b[:0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(a, b)], ["a", "b"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")
