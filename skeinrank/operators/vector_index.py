"""A stored inverted-file index with residual product-quantised codes, for cosine neighbours.

Vectors are normalised and dealt to the cell of the nearest centroid; what is left is coded by parts.
Centroids and codebooks are fitted on a bounded sample (`SAMPLE` rows by a hash of the id, all when there
are fewer); every row is indexed. The table is versioned, a cell a bucket, and holds the whole vectors too.

A question goes to its `probes` nearest cells only; other cells' files aren't read. Within a cell the
codes are scored from tables, the best `pool` get exact products, and the k best go out. How many cells
to probe is measured when the index is fitted: as many as it takes for `TARGET` of the neighbours among the sample.

Cells differ in size, and one may hold a third of all rows; questions may crowd in one cell, too. So a
cell is cut in tiles of `ROWS` rows and `QUESTIONS` questions, and each pair of tiles is one task's
group. What the driver sees is the sample, the model, and one row a cell.

Edge cases: rows with a null id or vector, or one of another length than the model's, are left out; a
vector of zeros has the score 0 with all; questions without a vector have no hits; ties go to the smaller id.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import Table
from .retrieve import ranked

#: Rows that the model is fitted on (about), cells at most, codes' parts and entries, rounds of fitting.
SAMPLE, CELLS, PARTS, ENTRIES, ROUNDS = 32_768, 4096, 8, 256, 12
#: The share of neighbours that the probed cells must hold on the sample, and the sample's questions for that.
TARGET, TRIED = 0.98, 512
#: Rows and questions of a tile; codes that get exact products, for each hit asked for.
ROWS, QUESTIONS, POOL = 65_536, 1024, 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The index of each row's nearest centre."""
    half = (centres**2).sum(1) / 2
    step = max(1, (1 << 23) // max(1, len(centres)))
    return np.concatenate([(half - x[i : i + step] @ centres.T).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means from evenly spread rows; a centre that loses all its rows stays."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.unique(np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int))].copy()
    for _ in range(rounds):
        at = _closest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Model:
    """Centroids, codebooks of what is left, and how many cells to probe."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray], probes: int):
        self.centres, self.books, self.probes = centres, books, probes
        self.edges = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def fit(cls, x: np.ndarray, n: int, parts: int = PARTS, entries: int = ENTRIES, k: int = 10) -> Model:
        """Of a sample x of unit vectors out of n rows."""
        cells = int(np.clip(round(n**0.5), 1, min(CELLS, max(1, len(x) // 8))))
        centres = _means(x, cells, ROUNDS)
        at = _closest(x, centres)
        left = x - centres[at]
        d = x.shape[1]
        edges = [i * d // parts for i in range(parts + 1)]
        books = [_means(left[:, a:b], entries, ROUNDS) for a, b in zip(edges, edges[1:]) if b > a]
        # the place of each neighbour's cell in the order in which its question probes
        tried = x[np.unique(np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int))]
        near = np.argsort(-(tried @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
        place = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(place, at[near], 1).ravel())
        probes = int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1 if len(needed) else 1
        return cls(centres, books, probes)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _closest(x, self.centres)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        left = x - self.centres[cells]
        return np.stack([_closest(left[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, a:b] @ book.T for a, b, book in zip(self.edges, self.edges[1:], self.books)]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, probes=self.probes, **{f"book{i:03d}": b for i, b in enumerate(self.books)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as held:
            return cls(held["centres"], [held[n] for n in sorted(held) if n.startswith("book")], int(held["probes"]))


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = Table(spark, f"{self.path}/rows")
        self._model: Model | None = None

    @property
    def model(self) -> Model:
        if self._model is None:
            self._model = Model.load(bytes(self.spark.read.parquet(f"{self.path}/model").head().data))
        return self._model

    @classmethod
    def build(cls, spark: SparkSession, path: str, vectors: DataFrame, order: str | None = None, sample: int = SAMPLE) -> VectorIndex:
        """vectors(chunk_id, embedding), with `order` the last row of an id counts."""
        self = cls(spark, path)
        own = vectors.where("chunk_id IS NOT NULL AND embedding IS NOT NULL").select("chunk_id", "embedding")
        n = own.count()
        part = own if n <= sample else own.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
        got = part.orderBy(F.xxhash64("chunk_id")).select("embedding").toArrow()["embedding"]
        sizes = {len(v) for v in got.to_pylist()} if n else {0}
        if len(sizes) != 1:
            raise ValueError(f"the vectors have {sorted(sizes)} dimensions")
        self._model = Model.fit(_unit(_vectors(got)), n) if n else Model(np.zeros((1, 1)), [np.zeros((1, 1))], 1)
        spark.createDataFrame([(bytearray(self._model.dump()),)], "data binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")
        self.upsert(vectors, order)
        return self

    def coded(self, vectors: DataFrame, more: list[str] | None = None) -> DataFrame:
        """(chunk_id, bucket, code, embedding) of the rows that fit the model."""
        shared, d = self.spark.sparkContext.broadcast(self.model), self.model.centres.shape[1]
        own = vectors.where(F.col("chunk_id").isNotNull() & (F.size("embedding") == d)).select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), *(more or []))
        schema = T.StructType([*own.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("code", T.BinaryType())])

        def run(batches):
            model = shared.value
            for batch in batches:
                if len(batch):
                    x = _unit(_vectors(batch["embedding"]))
                    cells = model.cells(x)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in model.codes(x, cells)], pa.binary())], schema.names)

        return own.mapInArrow(run, schema)

    def upsert(self, vectors: DataFrame, order: str | None = None) -> int:
        """Rows replace those of their ids, whatever their cells were."""
        return self.table.upsert(self.coded(vectors, [order] if order else None), order)

    def asked(self, questions: DataFrame, probes: int) -> DataFrame:
        """(question_id, q, bucket): a row for each cell that a question probes."""
        shared, d = self.spark.sparkContext.broadcast(self.model), self.model.centres.shape[1]
        own = questions.where(F.size("embedding") == d).select("question_id", F.transform("embedding", lambda x: x.cast("double")).alias("q"))

        def run(batches):
            model = shared.value
            for batch in batches:
                if len(batch):
                    near = np.argsort(-(_unit(_vectors(batch["q"])) @ model.centres.T), axis=1, kind="stable")[:, :probes]
                    rows = batch.take(pa.array(np.repeat(np.arange(len(batch)), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel().astype(np.int32))], ["question_id", "q", "bucket"])

        return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("bucket", T.IntegerType())]))

    def search(self, questions: DataFrame, k: int, probes: int | None = None, itself: bool = True, pool: int | None = None) -> DataFrame:
        """The k nearest of questions(question_id, embedding) by cosine, among the cells probed; scores are exact. Unless `itself`, a row of
        the question's own id isn't a hit."""
        asked, shared = self.asked(questions, probes or self.model.probes), self.spark.sparkContext.broadcast(self.model)
        crowd = {r.bucket: r["count"] for r in asked.groupBy("bucket").count().collect()}  # a row a cell
        rows = self.table.read(sorted(crowd))
        sizes = {r.bucket: r["count"] for r in rows.groupBy("bucket").count().collect()}
        tiles = [(b, -(-sizes[b] // ROWS), -(-crowd[b] // QUESTIONS)) for b in sorted(sizes)]
        tiles = self.spark.createDataFrame(tiles, "bucket int, t int, u int")
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        held = rows.join(tiles, "bucket").select("chunk_id", "code", "embedding", "bucket", part("chunk_id", "t").alias("i"), each("u").alias("j"))
        wanted = asked.join(tiles, "bucket").select("question_id", "q", "bucket", part("question_id", "u").alias("j"), each("t").alias("i"))
        schema = T.StructType([T.StructField("question_id", asked.schema["question_id"].dataType), T.StructField("chunk_id", rows.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
        most, arrow = pool or POOL * k, [("question_id", pa.null()), ("chunk_id", pa.null())]

        def best(own: pa.Table, questions: pa.Table) -> pa.Table:
            model, kinds = shared.value, [questions.schema.field("question_id").type if questions.num_columns else arrow[0][1], own.schema.field("chunk_id").type if own.num_columns else arrow[1][1]]
            names, ids = questions["question_id"].combine_chunks(), own["chunk_id"].combine_chunks()
            if not len(names) or not len(ids):
                return pa.table([pa.array([], kinds[0]), pa.array([], kinds[1]), pa.array([], pa.float64())], names=schema.names)
            q, x = _unit(_vectors(questions["q"])), _unit(_vectors(own["embedding"]))
            code = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            tables, key = model.tables(q), np.array(ids.to_pylist())
            asker, hit, score = [], [], []
            for i in range(len(names)):
                rough = sum(t[i][code[:, p]] for p, t in enumerate(tables))  # the centroid's part is the same for all
                near = np.argpartition(-rough, most - 1)[:most] if len(rough) > most else np.arange(len(rough))
                exact = np.round(x[near] @ q[i], 6) + 0.0
                if not itself:
                    near, exact = near[key[near] != names[i].as_py()], exact[key[near] != names[i].as_py()]
                top = np.lexsort((key[near], -exact))[:k]
                asker.append(np.full(len(top), i))
                hit.append(near[top])
                score.append(exact[top])
            return pa.table([names.take(pa.array(np.concatenate(asker))), ids.take(pa.array(np.concatenate(hit))), pa.array(np.concatenate(score))], names=schema.names)

        groups = ["bucket", "i", "j"]
        return ranked(held.groupBy(*groups).cogroup(wanted.groupBy(*groups)).applyInArrow(best, schema), k)

    def get(self, ids: DataFrame) -> DataFrame:
        """The rows of ids(chunk_id)."""
        return self.table.read().select("chunk_id", "embedding").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
