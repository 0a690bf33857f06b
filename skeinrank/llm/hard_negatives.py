"""Hard-negative mining over product-quantised vectors with stored residual norms.

Every vector is coded once (`vector_codes`), and the distance of each of its parts from its entry
is stored beside the code. For an anchor a and a row x = entries + rest,

    | a.x - sum over parts of table[part, code] |  <=  sum over parts |a_part| |rest_part|,

so a table of the anchor's products with the entries gives each row's score up to a known bound. A
row whose bounds can't reach what is wanted goes without a look at its vector; those that are left
get exact integer products, and the wanted ones are chosen among these.

Anchors go out in blocks of `ANCHORS`, each against all rows. First each anchor's positives: a task
takes the rows of its label whose upper bound reaches the n-th best exact score so far, ranks them
exactly and sends its n best; Spark cuts these to n. Then the negatives of each anchor and positive,
rows of other labels whose exact score lies in the positive's window: a task looks at the rows whose
bounds meet a window of the anchor between the n-th best found in it so far and its upper end. What a block needs of the driver is its anchors and their positives. Blocks are
written as they come, so no plan grows with their number.

Edge cases: rows with a null id, a null label, a null vector or a null or non-finite component take
no part; nor do vectors of another length than that of the first row by id. Components are held to
+-2**23. A row with the anchor's own id is no positive of it; rows that repeat another id count as
often as they stand, and an anchor that repeats is mined as often. Equal scores go to the smaller id. An
anchor without positives, and a positive without negatives, give no rows (a positive's score under zero has an
empty window); so does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import let_go, materialize
from .vector_codes import _matrix, code_type, encode, integers, train

#: Codebooks' size and rounds (trained on all rows; they decide how much is looked at, never what is found).
PARTS, ENTRIES, ROUNDS = 16, 32, 2
#: What a component is multiplied by, and its bound.
SCALE, LIMIT = 256, 1 << 23
#: Anchors of a block, and scores (windows x rows) held at a time.
ANCHORS, SCORES = 2048, 1 << 20
#: More than the table scores' rounding errors, of their size.
SLACK = 1e-9
#: A pair among so many of anchors x rows is a good part of them.
DENSE = 32


class Anchors:
    """A block of anchors: ids, labels and vectors, with their products with all entries and their parts' norms."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: list[np.ndarray], edges: list[int]):
        self.ids, self.labels, self.vectors, self.kind = ids, labels, vectors, code_type(books)
        parts = [vectors[:, a:b].astype(float) for a, b in zip(edges, edges[1:])]
        self.tables = [p @ b.T.astype(float) for p, b in zip(parts, books)]
        self.norms = np.stack([np.sqrt((p**2).sum(1)) for p in parts], 1)

    def bounds(self, of: np.ndarray, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) score of each row (code, left) for the anchors `of`: anchors x rows."""
        score = np.zeros((len(of), len(code)))
        for p, table in enumerate(self.tables):
            score += table[of][:, code[:, p]]
        most = self.norms[of] @ left.T
        most += SLACK * (np.abs(score) + most) + 1e-3
        return score - most, score + most

    def exact(self, of: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer products of pairs (anchor, row), in the narrowest kind of number that holds them exactly. Where the pairs are a good
        part of their anchors x rows, these are multiplied as matrices."""
        if not len(of):
            return np.zeros(0, np.int64)
        most = float(np.sqrt((self.vectors.astype(float) ** 2).sum(1).max() * (vectors.astype(float) ** 2).sum(1).max()))
        kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
        own, rows = self.vectors.astype(kind), vectors.astype(kind)
        a, i = np.unique(of, return_inverse=True)
        r, j = np.unique(at, return_inverse=True)
        if len(of) * DENSE >= len(a) * len(r) and kind is not np.int64:
            return (own[a] @ rows[r].T)[i, j].astype(np.int64)
        out = np.zeros(len(of), np.int64)
        for lo in range(0, len(of), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            out[part] = np.einsum("ij,ij->i", own[of[part]], rows[at[part]])
        return out


class Best:
    """The n best (score, then smaller id) of each line so far, over a task's batches."""

    def __init__(self, lines: int, n: int):
        self.n, self.bar = n, np.full(lines, -np.inf)
        self.line, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, line: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        line, score, ids = (np.concatenate(x) for x in ((self.line, line), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, line))
        line = line[order]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        kept = place < self.n
        self.line, self.score, self.id = line[kept], score[order][kept], ids[order][kept]
        last = place[kept] == self.n - 1
        self.bar[self.line[last]] = self.score[last]

    def batch(self, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.line, self.id, self.score)], [name, "id", "score"])


def _coded(batches, lines: int, kind: str):
    """(ids, labels, codes, left norms, vectors) of as many rows at a time as `SCORES` allows for so many lines."""
    step = max(1, SCORES // max(1, lines))
    for batch in batches:
        for lo in range(0, len(batch), step):
            b = batch.slice(lo, step)
            code = np.frombuffer(b"".join(b["code"].to_pylist()), kind).reshape(len(b), -1)
            left = b["left"].flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            yield b["id"].to_numpy(), b["label"].to_numpy(), code, left, _matrix(b["v"])


def _positives(rows: DataFrame, shared, n: int) -> DataFrame:
    """(anchor, id, score): the n best rows of each anchor's label, by the anchor's place in the block."""

    def run(batches):
        let_go()
        own = shared.value
        every, best = np.arange(len(own.ids)), Best(len(own.ids), n)
        for ids, labels, code, left, vectors in _coded(batches, len(own.ids), own.kind):
            _, high = own.bounds(every, code, left)
            a, r = np.nonzero((high >= best.bar[:, None]) & (own.labels[:, None] == labels[None]) & (own.ids[:, None] != ids[None]))
            best.add(a, own.exact(a, vectors, r), ids[r])
        yield best.batch("anchor")

    best = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    made = rows.mapInArrow(run, "anchor long, id long, score long")
    return made.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def _negatives(rows: DataFrame, shared, asked, n: int) -> DataFrame:
    """(window, id, score): the n best rows of each window (anchor, lowest and highest score), of other labels than the anchor's."""

    def run(batches):
        let_go()
        own, (of, least, most) = shared.value, asked.value
        best, every = Best(len(of), n), np.arange(len(own.ids))
        begin = np.searchsorted(of, np.append(every, len(every)))  # an anchor's windows stand together
        size = np.diff(begin)
        asks = np.flatnonzero(size)
        if not len(asks):
            return
        top = np.maximum.reduceat(most, begin[asks])
        for ids, labels, code, left, vectors in _coded(batches, len(asks), own.kind):
            low, high = own.bounds(asks, code, left)
            need = np.minimum.reduceat(np.maximum(least, best.bar), begin[asks])
            a, r = np.nonzero((high >= need[:, None]) & (low <= top[:, None]) & (own.labels[asks][:, None] != labels[None]))
            a = asks[a]
            score = own.exact(a, vectors, r)
            fits = (score >= need[np.searchsorted(asks, a)]) & (score <= top[np.searchsorted(asks, a)])
            a, r, score = a[fits], r[fits], score[fits]
            w = np.repeat(begin[a], size[a]) + np.arange(size[a].sum()) - np.repeat(np.cumsum(size[a]) - size[a], size[a])
            r, score = np.repeat(r, size[a]), np.repeat(score, size[a])
            fits = (score >= np.maximum(least, best.bar)[w]) & (score <= most[w])
            best.add(w[fits], score[fits], ids[r[fits]])
        yield best.batch("window")

    best = W.partitionBy("window").orderBy(F.desc("score"), "id")
    made = rows.mapInArrow(run, "window long, id long, score long")
    return made.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, lowest: Fraction = Fraction(1, 2), highest: Fraction = Fraction(19, 20),
    id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = SCALE, block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). `anchors` says which rows are anchors, by the table's
    columns; a negative's score is at least `lowest` and at most `highest` of its positive's."""
    label = F.col("label") if label is None else label
    taken = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(f"`{vector_col}`").alias("x"))
    rows = integers(taken.where("id IS NOT NULL AND label IS NOT NULL"), scale, ["id", "label", "anchor"], "id", "x", LIMIT)
    books, edges = train(rows, PARTS, ENTRIES, ROUNDS, "id")
    coded = materialize(encode(rows, books, edges, norms=True), "coded")
    spark, chosen = vectors.sparkSession, coded.where("anchor")
    blocks = -(-chosen.count() // block)
    # a block's anchors are those of one hash, so its size varies a little
    numbered = chosen.select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))).alias("block"))
    out = None
    for k in range(blocks):
        got = numbered.where(F.col("block") == k).orderBy("id", "label", "v").toArrow()
        own = Anchors(got["id"].to_numpy(), got["label"].to_numpy(), _matrix(got["v"].combine_chunks()), books, edges)
        shared = spark.sparkContext.broadcast(own)
        found = _positives(coded, shared, positives).select("anchor", "id", "score").orderBy("anchor", F.desc("score"), "id").toArrow()
        of, score = found["anchor"].to_numpy(), found["score"].to_numpy()
        # ceil and floor of the window's ends, in whole numbers
        least = -(-(score * lowest.numerator) // lowest.denominator)
        most = (score * highest.numerator) // highest.denominator
        asked = spark.sparkContext.broadcast((of, least, most))
        windows = spark.createDataFrame(pa.table({"window": np.arange(len(of)), "anchor_id": own.ids[of], "positive_id": found["id"].to_numpy(), "positive_score": score}))
        mined = _negatives(coded, shared, asked, negatives).join(F.broadcast(windows), "window")  # a block's positives
        part = materialize(mined.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out
