"""Vector code compression: product quantisation in whole numbers, with segment-mean lower bounds.

A vector's components become integers and are cut into parts; a part is coded by its nearest
codebook entry. Not every entry's distance is computed. A part is seen as blocks: with the blocks'
sums S and the norm R of what is left when each block's mean is taken off,

    |x - c|^2  >=  sum over blocks (S_x - S_c)^2 / size  +  (R_x - R_c)^2,

as block means and what is left are orthogonal. The bound is taken coarse to fine, with one block a
part, then two, four and so on. An entry goes when its bound is above an exact distance (each level
measures the entry it likes best); those that are left receive exact integer distances.
Bounds are lowered by more than their rounding can be, so no nearest entry and no tie is ever lost.

Codebooks start from the rows of the smallest ids and are refined by rounds over all rows: a task
sends its sums by part and entry, which Spark adds up; only codebooks pass the driver (parts x
entries rows). The integers are written once and read by every round.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped; so are
vectors of another length than that of the first kept row by id. A length that `parts` doesn't
divide gives parts that differ by one. Components are held to +-2**27 (inputs of +-32,768), so that
squares fit. Fewer kept rows than entries start so many entries; an empty table gives no rows.
Repeated ids start one entry each, in the order of their vectors; null ids come last. Equal
distances go to the lower index; entries that no part chose stay as they are; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import let_go, materialize

#: Parts, entries of a part's codebook, rounds, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components' bound, and cells (rows x entries) worked on at a time.
LIMIT, CELLS = 1 << 27, 1 << 17
#: More than the bounds' rounding errors, of their size.
SLACK = 1e-9


def integers(rows: DataFrame, scale: int, keep: list[str], id_col: str = "vec_id", vector_col: str = "embedding", limit: int = LIMIT) -> DataFrame:
    """`keep` and v, the components as floor(scale * x), of the rows whose vectors are whole and of the common length."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    fine = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c, F.lit(-2.0 * limit / scale)), F.lit(2.0 * limit / scale)) * scale), F.lit(-limit)), F.lit(limit))
    kept = rows.select(*(F.col(f"`{c}`") for c in keep), x.alias("x")).where(fine).select(*(F.col(f"`{c}`") for c in keep), F.transform("x", lambda c: held(c).cast("int")).alias("v"))
    written = materialize(kept, "integers")
    first = written.select(F.size("v").alias("d"), F.col(f"`{id_col}`").alias("id"), "v").orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    return written.where(F.size("v") == first[0]["d"]) if first else written


def bounds_of(d: int, parts: int) -> list[int]:
    """Where parts begin and end."""
    return [i * d // parts for i in range(parts + 1)]


class Segments:
    """Block sums and left norms of some vectors (rows of an int64 matrix), coarse to fine."""

    def __init__(self, x: np.ndarray):
        d, square = x.shape[1], (x.astype(float) ** 2).sum(1)
        self.levels = []
        blocks = 1
        while blocks < d:
            edge = np.array([i * d // blocks for i in range(blocks)])
            size = np.diff(np.append(edge, d)).astype(float)
            root = np.add.reduceat(x, edge, axis=1) / np.sqrt(size)
            self.levels.append((root, np.sqrt(np.maximum(square - (root**2).sum(1), 0))))
            blocks *= 2
        self.square = square


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index, and how many exact distances that took."""
    n, k = len(x), len(entries)
    if not n or not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    out, far, exact = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    of_entries = Segments(entries)
    step = max(1, CELLS // k)
    for lo in range(0, n, step):
        part = x[lo : lo + step]
        own = Segments(part)
        # how much the terms of a bound may be off by rounding
        loose = SLACK * (own.square + of_entries.square.max()) + 1e-3
        most = np.full(len(part), np.inf)
        row, entry = np.divmod(np.arange(len(part) * k), k)
        for level, ((a, ra), (b, rb)) in enumerate(zip(own.levels, of_entries.levels)):
            if level:
                low = np.full((len(part), k), np.inf)
                low[row, entry] = ((a[row] - b[entry]) ** 2).sum(1) + (ra[row] - rb[entry]) ** 2
            else:
                low = (a - b.T) ** 2 + (ra[:, None] - rb[None]) ** 2
            # an exact distance for each row, of the entry with the lowest bound
            most = np.minimum(most, ((part - entries[low.argmin(1)]) ** 2).sum(1) * (1 + SLACK) + loose)
            exact += len(part)
            row, entry = np.nonzero(low <= most[:, None])
        exact += len(row)
        distance = np.full((len(part), k), np.iinfo(np.int64).max)
        distance[row, entry] = ((part[row] - entries[entry]) ** 2).sum(1)
        out[lo : lo + step] = distance.argmin(1)
        far[lo : lo + step] = distance.min(1)
    return out, far, exact


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _rounds(rows: DataFrame, books: list[np.ndarray], edges: list[int]) -> list[np.ndarray]:
    """One round over all rows: each entry becomes the floor of the mean of the parts nearest to it."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        let_go()
        sums = [np.zeros((len(b), b.shape[1]), np.int64) for b in shared.value]
        times = [np.zeros(len(b), np.int64) for b in shared.value]
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch["v"])
            for p, book in enumerate(shared.value):
                part = v[:, edges[p] : edges[p + 1]]
                at, _, _ = nearest(part, book)
                np.add.at(sums[p], at, part)
                times[p] += np.bincount(at, minlength=len(book))
        for p in range(len(sums)):
            e = np.flatnonzero(times[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), p, np.int32)), pa.array(e.astype(np.int32)), pa.array(times[p][e]), pa.array(sums[p][e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    width = max(e - b for b, e in zip(edges, edges[1:]))
    got = rows.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>").groupBy("part", "entry")
    got = got.agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width))).collect()
    out = [b.copy() for b in books]
    for r in got:
        d = out[r["part"]].shape[1]
        out[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    return out


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id") -> tuple[list[np.ndarray], list[int]]:
    """A codebook for each part, and where parts begin and end, of rows(id, v)."""
    first = rows.select(F.col(f"`{id_col}`").alias("id"), "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), len(first[0]["v"]) if first else 0)
    edges = bounds_of(start.shape[1], parts)
    books = [start[:, a:b] for a, b in zip(edges, edges[1:])]
    for _ in range(rounds if len(first) else 0):
        books = _rounds(rows, books, edges)
    return books, edges


def code_type(books: list[np.ndarray]) -> str:
    return "u1" if max((len(b) for b in books), default=0) <= 256 else "<u2"


def encode(rows: DataFrame, books: list[np.ndarray], edges: list[int], norms: bool = False) -> DataFrame:
    """All columns of `rows`, code (binary: an entry's index a part, a byte each, two with over 256 entries), error (the squared distances, added up), and with
    `norms` left: each part's distance from its entry."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(books), code_type(books)
    more = [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType()), *([T.StructField("left", T.ArrayType(T.DoubleType()))] if norms else [])]

    def run(batches):
        let_go()
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch["v"])
            found = [nearest(v[:, edges[p] : edges[p + 1]], book)[:2] for p, book in enumerate(shared.value)]
            code = np.stack([a for a, _ in found], 1).astype(kind)
            far = np.stack([b for _, b in found], 1)
            made = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(far.sum(1))]
            if norms:
                made.append(pa.array(list(np.sqrt(far)), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f.name for f in more)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def books_digest(books: list[np.ndarray]) -> str:
    """Lowercase sha256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error) of each kept row, codebooks)."""
    rows = integers(vectors, scale, [id_col, label_col], id_col, vector_col)
    books, edges = train(rows, parts, entries, rounds, id_col)
    return encode(rows, books, edges).drop("v"), books
