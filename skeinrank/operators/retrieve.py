"""Rankings of many questions at once. A ranking is a DataFrame (question_id, rank, chunk_id, score);
scores are rounded to six digits and ties go to the smaller chunk_id, so ranks are reproducible."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..ports import EmbeddingModel, Reranker
from ..sources.readers import stored

K1, B, RRF = 1.2, 0.75, 60
#: Query vectors of one broadcast block, scores held at a time, and rows taken at a time: bounds on memory, not on what is searched.
QUERY_BLOCK, SCORES, ROWS = 8192, 1_000_000, 1000


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each question; Spark cuts to k before the shuffle, too."""
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", "score")


class _Kept:
    """The k best of each question among what a task has seen so far; `least` is how many rows wait until they are cut."""

    def __init__(self, k: int, least: int = 200_000):
        self.k, self.least, self.n, self.parts = k, least, 0, []

    def add(self, part: pd.DataFrame) -> None:
        self.parts.append(part)
        self.n += len(part)
        if self.n > self.least:
            whole = self.cut()
            self.parts, self.n, self.least = [whole], len(whole), max(self.least, 4 * len(whole))

    def cut(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"question_id": [], "chunk_id": [], "score": []})
        whole = pd.concat(self.parts, ignore_index=True)
        order = whole.sort_values(["question_id", "score", "chunk_id"], ascending=[True, False, True])
        return order[order.groupby("question_id", sort=False).cumcount() < self.k]

    def batches(self, question_type: pa.DataType, chunk_type: pa.DataType):
        got = self.cut()
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(got["question_id"].tolist(), question_type), pa.array(got["chunk_id"].tolist(), chunk_type), pa.array(got["score"], pa.float64())], list(got.columns))


def question_hits(questions: DataFrame, chunks: DataFrame) -> str:
    return f"question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"


def dense(queries: DataFrame, vectors: DataFrame, k: int, itself: bool = True, model: EmbeddingModel | None = None) -> DataFrame:
    """Exact cosine top-k. queries(question_id, embedding), vectors(chunk_id, embedding); with `model` chunks(chunk_id, text), which
    are embedded where they are compared, so that their vectors don't leave the task.

    Queries go out in blocks of a fixed size; every task keeps its k best a query before
    anything is shuffled. Unless `itself`, a question's own vector (equal ids) isn't a hit of it.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, math.ceil(n / QUERY_BLOCK))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(blocks)))
    if blocks > 1:  # every block reads them: they are made once
        vectors, model = (embedded(vectors, model, "chunk_id") if model else vectors), None
        numbered, vectors = stored(numbered, "questions"), stored(vectors.select("chunk_id", "embedding"), "vectors")
    parts = []
    for b in range(blocks):
        rows = numbered.where(F.col("block") == b).select("question_id", "embedding").toArrow()
        q = np.array(rows["embedding"].to_pylist(), float).reshape(len(rows), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((np.array(rows["question_id"].to_pylist()), q, rows.schema.field("question_id").type))

        def best(batches, shared=shared, model=model):
            names, q, kind = shared.value
            if not len(names):
                return
            kept, step, own = _Kept(k), max(1, min(ROWS, SCORES // len(names))), None
            for batch in batches:
                own = batch.schema.field("chunk_id").type
                for lo in range(0, len(batch), step):
                    part = batch.slice(lo, step)
                    v = _embed(model, part["text"].to_pylist()) if model else _matrix(part["embedding"])
                    kept.add(_nearest(names, q, np.array(part["chunk_id"].to_pylist()), v, k, itself))
            yield from kept.batches(kind, own)

        parts.append(vectors.select("chunk_id", "text" if model else "embedding").mapInArrow(best, question_hits(queries, vectors)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, k)


def _matrix(lists: pa.Array) -> np.ndarray:
    values, n = lists.flatten(), len(lists)
    if lists.null_count or values.null_count or not n or len(values) % n or pc.count_distinct(lists.value_lengths()).as_py() > 1:
        return np.array(lists.to_pylist(), float)
    return values.to_numpy().astype(float).reshape(n, -1)


def _nearest(names: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, itself: bool) -> pd.DataFrame:
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    score = np.round(q @ v.T, 6) + 0.0
    if not itself:
        score[names[:, None] == ids[None]] = -np.inf
    return _best(names, ids, score, k)


def _best(names: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """Of scores (question x chunk; -inf is none) each question's k best; only what reaches the k-th score is sorted."""
    least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(names), -np.inf)
    row, column = np.nonzero((score >= least[:, None]) & np.isfinite(score))
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, column = row[place < k], column[place < k]
    return pd.DataFrame({"question_id": names[row], "chunk_id": ids[column], "score": score[row, column]})


def _embed(model: EmbeddingModel, texts: list[str | None]) -> np.ndarray:
    vectors = model.embed([t or "" for t in texts])
    if vectors.shape != (len(texts), model.dimensions):
        raise ValueError(f"the embedder returned {vectors.shape} for {len(texts)} texts of {model.dimensions} dimensions")
    return vectors


def embedded(texts: DataFrame, model: EmbeddingModel, id_col: str) -> DataFrame:
    """(id, embedding) of texts(id, text), a batch of texts at a time, with the vector in the row of its text."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], "embedding": list(_embed(model, f["text"].tolist()))})

    return texts.select(id_col, "text").mapInPandas(run, f"{id_col} {texts.schema[id_col].dataType.simpleString()}, embedding array<double>")


def embedded_parts(rows: DataFrame, model: EmbeddingModel, id_col: str, parts: list[str]) -> DataFrame:
    """(id, a vector for each of the columns `parts`, of the same name) of rows(id, *parts), in one pass; a null counts as empty."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], **{p: list(_embed(model, f[p].tolist())) for p in parts}})

    schema = ", ".join([f"{id_col} {rows.schema[id_col].dataType.simpleString()}", *(f"{p} array<double>" for p in parts)])
    return rows.select(id_col, *parts).mapInPandas(run, schema)


def embed_missing(texts: DataFrame, cache: DataFrame, model: EmbeddingModel) -> tuple[DataFrame, DataFrame]:
    """texts(text), cache(key, embedding): (text, embedding) of each row, and what is to be added to the cache.
    Only distinct texts that the cache lacks are embedded."""
    keyed = texts.withColumn("key", F.sha2(F.concat(F.lit(model.identity + "\0"), "text"), 256))
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    fresh = embedded(missing.withColumnRenamed("key", "id"), model, "id").withColumnRenamed("id", "key")
    return keyed.join(cache.unionByName(fresh), "key").select("text", "embedding"), fresh


def dense_texts(questions: DataFrame, chunks: DataFrame, k: int, model: EmbeddingModel) -> DataFrame:
    """questions(question_id, text), chunks(chunk_id, text)."""
    return dense(embedded(questions, model, "question_id"), chunks, k, model=model)


# ---------------------------------------------------------------- sparse


def bm25(questions: DataFrame, chunks: DataFrame, k: int, analyzer: Callable[[Column], Column] = tokens) -> DataFrame:
    """questions(question_id, text), chunks(chunk_id, text; or words, if they are analysed already), without a stored index (`sparse_index`):
    nothing is shuffled but each task's k best. One pass counts the terms asked for, one scores; of a chunk only those terms leave the JVM. Questions go
    out in blocks, with their terms."""
    asked = questions.select("question_id", F.explode(analyzer(F.col("text"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
    blocks = max(1, math.ceil(questions.count() / QUERY_BLOCK))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b).orderBy("question_id", "term").toPandas()
        part = ranked(_bm25_block(own, chunks, k, analyzer, question_hits(questions, chunks)), k)
        out = part if out is None else out.unionByName(part)
    return out


def _bm25_block(asked: pd.DataFrame, chunks: DataFrame, k: int, analyzer, schema: str) -> DataFrame:
    terms = sorted(asked["term"].unique().tolist())
    words = chunks.select("chunk_id", "words" if "words" in chunks.columns else analyzer(F.col("text")).alias("words"))
    held = words.select("chunk_id", F.size("words").alias("len"), F.filter("words", lambda w: w.isin(terms)).alias("held"))
    # a row without a term for each chunk: the chunks' number and length
    counts = held.select("len", F.explode(F.concat(F.array_distinct("held"), F.array(F.lit(None).cast("string")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect()
    n, total = next(((r.n, r.len) for r in counts if r.term is None), (0, 0))
    df = asked["term"].map(dict((r.term, r.n) for r in counts)).fillna(0).to_numpy(float)
    return gathered(held, *weighed(asked, df, n, total, k), 6, schema)


def weighed(asked: pd.DataFrame, df: np.ndarray, n: int, total: int, k: int) -> tuple[pd.DataFrame, int, Callable]:
    """BM25 for `gathered`: what the terms asked for are worth, k, and the value of an occurrence, in `n` chunks of `total` terms."""
    mean = max(total / max(n, 1), 1e-300)
    worth = np.log1p((n - df + 0.5) / (df + 0.5)) * asked["times"].to_numpy(float)
    return asked.assign(w=worth), k, lambda w, tf, length: w * (tf / (tf + K1 * (1 - B + B * length / mean)))


def gathered(held: DataFrame, asked: pd.DataFrame, k: int, value: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], digits: int, schema: str) -> DataFrame:
    """Each task's k best of a question, by the sum of value(w, tf, len), half up to `digits`, over the terms that both have. asked(question_id, term, w) goes
    out to all; held(chunk_id, len, held: terms, of which any may be unknown). A task holds SCORES products at a time, however long its chunks are."""
    shared = held.sparkSession.sparkContext.broadcast(by_term(asked))

    return held.select("chunk_id", "len", "held").mapInArrow(lambda batches: _gather(batches, shared.value, k, value, digits), schema)


def by_term(asked: pd.DataFrame) -> tuple:
    """asked(question_id, term, w) as tasks use it: term by term its questions, with what an occurrence there is worth."""
    terms, term_of = np.unique(asked["term"].to_numpy(str), return_inverse=True)
    names, question_of = np.unique(asked["question_id"].to_numpy(), return_inverse=True)
    order = np.argsort(term_of, kind="stable")
    begin = np.searchsorted(term_of[order], np.arange(len(terms) + 1))
    return terms, names, question_of[order], begin, asked["w"].to_numpy(float)[order], pa.array(asked["question_id"]).type


def _gather(batches, shared: tuple, k: int, value, digits: int):
    """What a task of `gathered` does."""
    terms, names, *_, kind = shared
    place = {t: i for i, t in enumerate(terms.tolist())}
    kept, field, step = _Kept(k), None, max(1, min(ROWS, SCORES // max(1, len(names))))
    for batch in batches:
        field = batch.schema.field("chunk_id").type
        for lo in range(0, len(batch), step):
            part = batch.slice(lo, step)
            lists = part["held"]
            coded = lists.flatten().dictionary_encode()
            own = np.array([place.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(part)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
            for best in products(row[own >= 0], own[own >= 0], pc.fill_null(part["len"], 0).to_numpy(zero_copy_only=False), np.array(part["chunk_id"].to_pylist()), shared, k, value, digits):
                kept.add(best)
    yield from kept.batches(kind, field)


def products(row: np.ndarray, own: np.ndarray, lengths: np.ndarray, ids: np.ndarray, shared: tuple, k: int, value, digits: int):
    """Each question's k best of some chunks, a part of them at a time: the chunk and the number of each occurrence of a term asked for."""
    terms, names, question, begin, worth, _ = shared
    both, tf = np.unique(row * len(terms) + own, return_counts=True)
    row, own = both // max(1, len(terms)), both % max(1, len(terms))
    length, times = lengths[row], begin[own + 1] - begin[own]
    ends = np.concatenate(([0], np.cumsum(times)))
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    a = 0
    while a < len(ids):  # as many chunks as give SCORES products, one at least
        b = max(a + 1, int(np.searchsorted(ends[first], ends[first[a]] + SCORES, "right")) - 1)
        x, y, wide = first[a], first[b], b - a
        at = np.repeat(begin[own[x:y]] - ends[x:y], times[x:y]) + np.arange(ends[x], ends[y])
        cell = question[at] * wide + np.repeat(row[x:y] - a, times[x:y])
        again = lambda each: np.repeat(each[x:y], times[x:y])  # noqa: B023, E731
        score = np.bincount(cell, value(worth[at], again(tf), again(length)), len(names) * wide)
        found = np.zeros(len(names) * wide, bool)
        found[cell] = True
        score = np.where(found, np.floor(score * 10**digits + 0.5) / 10**digits, -np.inf).reshape(len(names), wide)
        yield _best(names, ids[a:b], score, k)
        a = b


def fuse(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Reciprocal ranks added up; equal sums go to what was seen first, the first ranking before the second."""
    both = first.select("question_id", "chunk_id", "rank", F.lit(0).alias("branch")).unionByName(second.select("question_id", "chunk_id", "rank", F.lit(1).alias("branch")))
    summed = both.groupBy("question_id", "chunk_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"), F.min(F.struct("branch", "rank")).alias("seen"))
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "seen")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", "score")


def rerank(base: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, scorer: Reranker | None = None) -> DataFrame:
    """The pool ordered anew by a scorer of (question, chunk) pairs; ties keep the base order. Without one, by the
    native stand-in: the share of the question's terms that a chunk holds."""
    pool = base.join(questions.select("question_id", F.col("text").alias("__q")), "question_id").join(chunks.select("chunk_id", F.col("text").alias("__t")), "chunk_id")
    pool = pool.select("question_id", "chunk_id", F.col("rank").alias("base_rank"), "__q", "__t")
    if scorer is None:
        q = F.array_distinct(tokens(F.col("__q")))
        pool = pool.withColumn("score", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(F.col("__t")))), F.size(q)), F.lit(0.0)), 6)).drop("__q", "__t")
    else:

        def run(frames):
            for f in frames:
                yield f.assign(score=np.asarray(scorer.score(f["__q"].tolist(), f["__t"].tolist()), float)).drop(columns=["__q", "__t"])

        kept = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in pool.schema.fields[:3])
        pool = pool.mapInPandas(run, f"{kept}, score double")
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "base_rank")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", "score")


def to_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits on fragments become hits on their parents, each once, best rank first; nothing is filled up. parents(chunk_id, parent_id)."""
    wide = hits.join(parents, "chunk_id", "left").withColumn("own", F.coalesce("parent_id", "chunk_id"))
    first = wide.groupBy("question_id", "own").agg(F.min(F.struct("rank", "score")).alias("best"))
    order = W.partitionBy("question_id").orderBy("best.rank")
    return first.withColumn("rank", F.row_number().over(order)).select("question_id", "rank", F.col("own").alias("chunk_id"), F.col("best.score").alias("score"))


# ---------------------------------------------------------------- the ten strategies


class Corpus:
    """What the strategies are built from: questions(question_id, text), chunks(chunk_id, text), fragments(chunk_id, text,
    parent_id), contextual, summarized and both (chunk_id, text), nodes of the summary tree (chunk_id, text).

    With `store`, a ranking that several strategies need is made once, as deep as any of them asks, and read from there. With
    `index`, sparse rankings are searched in the stored index that it gives for a frame's name. `graph` gives the stored graph of the chunks.

    A frame may have its texts' terms in a column `words`. `made_of` says which columns of the frame `parts` (chunk_id and they) make a
    frame's texts when they are joined by white space: with `store` and a model that is additive each part is embedded once for all of them.
    """

    def __init__(self, model: EmbeddingModel, analyzer: Callable[[Column], Column] = tokens, store: Callable[[DataFrame, str], DataFrame] | None = None, index=None, graph=None, made_of: dict[str, list[str]] | None = None, **frames: DataFrame):
        self.model, self.analyzer, self.store, self.index, self.graph, self.made_of, self.frames, self.kept = model, analyzer, store, index, graph, made_of or {}, frames, {}

    def _vectors(self, name: str) -> DataFrame | None:
        """(chunk_id, embedding) of a frame's chunks as sums of their parts' vectors."""
        if self.store is None or name not in self.made_of or not getattr(self.model, "additive", False):
            return None
        if "parts" not in self.kept:
            columns = [c for c in self.frames["parts"].columns if c != "chunk_id"]
            self.kept["parts"] = self.store(embedded_parts(self.frames["parts"], self.model, "chunk_id", columns), "parts")
        first, *rest = map(F.col, self.made_of[name])
        for c in rest:
            first = F.zip_with(first, c, lambda a, b: a + b)
        return self.kept["parts"].select("chunk_id", first.alias("embedding"))

    def _ranking(self, kind: str, name: str, k: int) -> DataFrame:
        def make(depth):
            if kind == "near":
                vectors = self._vectors(name)
                if vectors is not None:
                    return dense(embedded(self.frames["questions"], self.model, "question_id"), vectors, depth)
                return dense_texts(self.frames["questions"], self.frames[name], depth, self.model)
            if self.index is not None:
                return self.index(name, self.frames[name]).search(self.frames["questions"], depth)
            return bm25(self.frames["questions"], self.frames[name], depth, self.analyzer)

        if self.store is None or name not in ("chunks", "contextual"):
            return make(k)
        depth = max(POOL, k) if name == "chunks" else k
        if (kind, name) not in self.kept:
            self.kept[kind, name] = self.store(make(depth), f"{kind}-{name}")
        return self.kept[kind, name].where(F.col("rank") <= k)

    def near(self, name: str, k: int) -> DataFrame:
        return self._ranking("near", name, k)

    def sparse(self, name: str, k: int) -> DataFrame:
        return self._ranking("sparse", name, k)

    def hybrid(self, name: str, k: int) -> DataFrame:
        return fuse(self.near(name, k), self.sparse(name, k), k)


#: A pool for the scorer, at least.
POOL = 50


def _reranked(c: Corpus, k: int) -> DataFrame:
    return rerank(c.hybrid("chunks", max(POOL, k)), c.frames["questions"], c.frames["chunks"], k)


STRATEGIES: dict[str, Callable[[Corpus, int], DataFrame]] = {
    "dense": lambda c, k: c.near("chunks", k),
    "sparse_bm25": lambda c, k: c.sparse("chunks", k),
    "hybrid_rrf": lambda c, k: c.hybrid("chunks", k),
    "reranked": _reranked,
    "contextual": lambda c, k: c.hybrid("contextual", k),
    "parent_child": lambda c, k: to_parents(c.near("fragments", k), c.frames["fragments"].select("chunk_id", "parent_id")),
    "sac": lambda c, k: c.near("summarized", k),
    "sac_contextual": lambda c, k: c.near("both", k),
    "raptor": lambda c, k: c.near("nodes", k),
    "graphrag": lambda c, k: c.graph().local(c.frames["questions"], k),
}


def requested(labels: list) -> list[str]:
    """Checked labels of strategies: some, all strings, each once, all known."""
    if not isinstance(labels, list) or not labels:
        raise ValueError("strategies must be a list that isn't empty")
    if not all(isinstance(x, str) for x in labels):
        raise ValueError("strategies must be strings")
    if len(set(labels)) < len(labels):
        raise ValueError("strategies are given twice")
    if unknown := sorted(set(labels) - set(STRATEGIES)):
        raise ValueError(f"unknown strategies: {', '.join(unknown)}")
    return labels
