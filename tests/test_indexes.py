"""Versioned tables, the vector index, the inverted index and the two-level scans, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinrank.functions.text import terms
from skeinrank.operators import metrics, records, retrieve, scan
from skeinrank.operators.sparse_index import SparseIndex
from skeinrank.operators.vector_index import VectorIndex
from skeinrank.sources import tables
from skeinrank.sources.tables import Conflict, Table

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- tables


def rows(spark, items):
    return spark.createDataFrame(items, "chunk_id long, v string").withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(4)).cast("int"))


def held(df):
    return sorted((r.chunk_id, r.v) for r in df.collect())


def test_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.upsert(rows(spark, [(i, "a") for i in range(20)]))
    t.upsert(rows(spark, [(3, "b"), (99, "b"), (3, "c")]))
    assert held(t.read()) == sorted([(i, "c" if i == 3 else "a") for i in range(20)] + [(99, "b")])
    assert held(t.read(version=1)) == [(i, "a") for i in range(20)]
    t.append(rows(spark, [(99, "z"), (100, "z"), (100, "z")]))
    assert [v for i, v in held(t.read()) if i > 98] == ["b", "z"]
    t.replace(F.col("v") == "a", rows(spark, [(500, "new")]))
    assert held(t.read()) == [(3, "c"), (99, "b"), (100, "z"), (500, "new")]
    one = [r.bucket for r in rows(spark, [(3, "")]).collect()]
    assert set(held(t.read(one))) == {(i, v) for i, v in held(t.read()) if i in {r.chunk_id for r in t.read().where(F.col("bucket") == one[0]).collect()}}
    assert t.versions() == [1, 2, 3, 4]
    t.vacuum()
    assert t.versions() == [4] and held(t.read()) == [(3, "c"), (99, "b"), (100, "z"), (500, "new")]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.create(rows(spark, [(i, "a") for i in range(40)]))
    before = t._listed(None)[1]
    t.upsert(rows(spark, [(7, "b")]))
    after = t._listed(None)[1]
    assert len([b for b in before if before[b] != after[b]]) == 1


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "t"))
    t.create(rows(spark, [(1, "a"), (2, "a")]))
    monkeypatch.setattr(Table, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.upsert(rows(spark, [(1, "b")]))
    monkeypatch.undo()
    assert held(t.read()) == [(1, "a"), (2, "a")]
    monkeypatch.setattr(tables, "PATIENCE", 0.3)
    # a list that broke off is no version, and the next write goes round it
    (tmp_path / "t" / "versions" / "000000000002").write_text("half")
    assert t.versions() == [1]
    t.upsert(rows(spark, [(2, "c")]))
    assert t.versions() == [1, 3] and held(t.read()) == [(1, "a"), (2, "c")]


def test_two_writers(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.create(rows(spark, [(1, "a")]))
    schema, listed = t._listed(None)
    t.upsert(rows(spark, [(1, "b")]))
    with pytest.raises(Conflict):
        t._commit(1, schema, listed)
    assert held(t.read()) == [(1, "b")]


def test_other_columns_and_no_table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    t.create(rows(spark, []))
    assert held(t.read()) == []
    with pytest.raises(ValueError):
        t.upsert(rows(spark, [(1, "a")]).drop("v"))


# ---------------------------------------------------------------- vectors


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 16))
    x = centres[rng.integers(0, 12, 600)] + rng.normal(0, 0.2, (600, 16))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(None, [0.0] * 16), (900, None), (901, [1.0]), (902, [0.0] * 16)], "chunk_id long, embedding array<double>")
    with pytest.raises(ValueError):
        VectorIndex.build(spark, str(tmp_path / "bad"), v)
    v = v.where("chunk_id IS NULL OR chunk_id <> 901")
    index = VectorIndex.build(spark, str(tmp_path / "i"), v)
    q = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(0, 600, 7)], "question_id long, embedding array<double>")
    key = lambda df: {(r.question_id, r.chunk_id) for r in df.collect()}
    exact = key(retrieve.dense(q, v.where("chunk_id IS NOT NULL AND embedding IS NOT NULL"), 10, itself=False))
    again = VectorIndex(spark, str(tmp_path / "i"))
    assert len(key(again.search(q, 10, itself=False)) & exact) >= 0.95 * len(exact)
    # all cells and all codes: the exact ranking, scores included
    full = lambda df: sorted((r.question_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    assert full(index.search(q, 10, probes=10_000, pool=10_000)) == full(retrieve.dense(q, v.where("chunk_id IS NOT NULL AND embedding IS NOT NULL"), 10))
    # a row that moves to another cell is found there, and only there
    index.upsert(spark.createDataFrame([(5, [float(c) for c in x[300]]), (777, [float(c) for c in x[300]])], "chunk_id long, embedding array<double>"))
    assert index.table.read().count() == 602
    near = {r.chunk_id for r in index.search(spark.createDataFrame([(1, [float(c) for c in x[300]])], "question_id long, embedding array<double>"), 3).collect()}
    assert near == {5, 300, 777}
    assert index.get(spark.createDataFrame([(5,), (5,), (4000,)], "chunk_id long")).count() == 1


def test_vector_index_tiles_and_skew(spark, tmp_path, monkeypatch):
    from skeinrank.operators import vector_index

    monkeypatch.setattr(vector_index, "ROWS", 50)
    monkeypatch.setattr(vector_index, "QUESTIONS", 3)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.tile([1.0, 0, 0, 0], (200, 1)), rng.normal(0, 1, (100, 4))])  # most rows in one cell
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>")
    index = VectorIndex.build(spark, str(tmp_path / "i"), v)
    q = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(0, 300, 20)], "question_id long, embedding array<double>")
    full = lambda df: sorted((r.question_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    assert full(index.search(q, 5, probes=10_000, pool=10_000)) == full(retrieve.dense(q, v, 5))


def test_vector_recall_of_the_tables(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = VectorIndex.build(spark, str(tmp_path / "i"), v)
    q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "question_id")
    key = lambda df: {(r.question_id, r.chunk_id) for r in df.collect()}
    exact = key(retrieve.dense(q, v, 10, itself=False))
    assert len(key(index.search(q, 10, itself=False)) & exact) >= 0.95 * len(exact)


# ---------------------------------------------------------------- the inverted index


def ranking(df):
    return sorted((r.question_id, r.rank, r.chunk_id, r.score) for r in df.collect())


def test_inverted_index_is_exact(spark, tmp_path):
    chunks = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text").repartition(8)
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("question_id"), "text")
    asked = asked.union(spark.createDataFrame([(9001, "nowhere zzzzqq"), (9002, ""), (9003, None)], asked.schema))
    index = SparseIndex.build(spark, str(tmp_path / "i"), chunks, terms)
    want = ranking(retrieve.bm25(asked, chunks, 5, terms))
    assert ranking(index.search(asked, 5)) == want
    assert ranking(SparseIndex(spark, str(tmp_path / "i"), terms).search(asked, 5, first=1)) == want
    seen = index.looked_at(asked, 5).agg(F.sum("blocks").alias("b"), F.sum("scored").alias("s")).head()
    assert seen.s <= seen.b
    # chunks that change, grow, lose all terms, or are new
    more = spark.createDataFrame([(0, "unheard words alone"), (1, ""), (2, None), (50_000, "unheard unheard words")], "chunk_id long, text string")
    index.upsert(more)
    now = chunks.join(more, "chunk_id", "left_anti").unionByName(more)
    asked = asked.union(spark.createDataFrame([(9004, "unheard words")], asked.schema))
    assert ranking(index.search(asked, 5)) == ranking(retrieve.bm25(asked, now.withColumn("text", F.coalesce("text", F.lit(""))), 5, terms))


def test_blocks_are_skipped(spark, tmp_path):
    # one block in thirty holds the rare term
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("common word "), F.when(F.col("id") % 997 == 5, "rare").otherwise("")).alias("text"))
    index = SparseIndex.build(spark, str(tmp_path / "i"), chunks)
    asked = spark.createDataFrame([(1, "rare common")], "question_id long, text string")
    seen = index.looked_at(asked, 2, first=1).head()
    assert seen.blocks == index.blocks and seen.scored <= 4
    assert ranking(index.search(asked, 2, first=1)) == ranking(retrieve.bm25(asked, chunks, 2))
    plan = index.search(asked, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" not in plan  # the buckets asked for are listed, not filtered


def test_postings_are_shuffled_once_and_only_terms_asked_for_are_looked_up(spark, tmp_path, monkeypatch):
    plans, create = [], Table.create

    def seen(self, rows, *args, **named):
        plans.append((self.key, rows._jdf.queryExecution().executedPlan().toString()))
        written.append(bool(named.get("dealt")))
        return create(self, rows, *args, **named)

    written = []
    monkeypatch.setattr(Table, "create", seen)
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("common w"), F.col("id") % 700, F.lit(" x"), F.col("id")).alias("text"))
    index = SparseIndex.build(spark, str(tmp_path / "i"), chunks)
    (plan,) = [p for key, p in plans if key == "term"]
    assert plan.count("Exchange") == 1 and written == [False, True]
    assert index.rows.read().groupBy("term", "block").count().where("count > 1").isEmpty()
    asked = spark.createDataFrame([(1, "w5 x9"), (2, "common w7")], "question_id long, text string")
    hits = index.search(asked, 3)
    assert ranking(hits) == ranking(retrieve.bm25(asked, chunks, 3))
    # rows of the index meet the terms asked for before they meet blocks
    assert "LeftSemi" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_and_empty_chunks(spark, tmp_path):
    rows_ = [(1, "a b", 1), (1, "c", 2), (None, "a", 3), (2, "", 4), (3, None, 5), (4, "a a a c", 6)]
    index = SparseIndex.build(spark, str(tmp_path / "i"), spark.createDataFrame(rows_, "chunk_id long, text string, ord int"), order="ord")
    asked = spark.createDataFrame([(1, "a c")], "question_id long, text string")
    kept = spark.createDataFrame([(1, "c"), (2, ""), (3, ""), (4, "a a a c")], "chunk_id long, text string")
    assert ranking(index.search(asked, 5)) == ranking(retrieve.bm25(asked, kept, 5))
    empty = SparseIndex.build(spark, str(tmp_path / "e"), kept.where("false"))
    assert empty.search(asked, 5).count() == 0


# ---------------------------------------------------------------- scans


def plain_status(failures, limit=5):
    out, run, open_ = [], 0, False
    for bad in failures:
        out.append("skipped" if open_ else "failed" if bad else "succeeded")
        run = run + 1 if bad else 0
        open_ = open_ or run >= limit
    return out


def test_circuit_breaker_with_one_key(spark):
    rng = np.random.default_rng(7)
    for share, n in ((0.5, 400), (0.7, 300), (1.0, 40), (0.0, 30), (0.9, 60)):
        bad = (rng.random(n) < share).tolist()
        bad[:3] = [True] * 3
        df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bad)] + [(2, 0, True), (3, 1, False)], "k long, i long, f boolean").repartition(5)
        for segments in (1, 7, 40):
            got = metrics.circuit_breaker(df, "k", ["i"], "f", segments=segments).orderBy("k", "i").collect()
            assert [r.status for r in got] == [*plain_status(bad), "failed", "succeeded"]


def test_segments_are_of_like_size(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") % 3 == 0).alias("f"))
    sizes = [r["count"] for r in scan.segmented(df, ["k"], ["i"], 16).groupBy("__seg").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * 20_000 / 16


def test_previous_and_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"), (F.col("id") * 7 % 13).alias("v"))
    w = W.partitionBy("k").orderBy("i")
    want = df.withColumn("p", F.lag("v").over(w)).withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    got = scan.previous(df, ["k"], ["i"], {"p": "v"}, 9)
    got = scan.running_before(got, ["k"], ["i"], "v", "s", 9)
    assert sorted(map(tuple, got.select("k", "i", "p", "s").collect()), key=repr) == sorted(map(tuple, want.select("k", "i", "p", "s").collect()), key=repr)


def test_spearman_of_one_large_group(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 400, 3000), rng.integers(0, 30, 3000)
    df = spark.createDataFrame([("g", int(x), int(x + 5 * y)) for x, y in zip(a, b)], "g string, a long, b long")
    import pandas as pd

    frame = pd.DataFrame({"a": a, "b": a + 5 * b})
    want = frame["a"].rank().corr(frame["b"].rank())
    assert records.spearman(df, ["g"]).head().spearman == pytest.approx(want, abs=1e-6)
