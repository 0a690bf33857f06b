"""Bounds on what a task holds, whatever its input is."""

import tracemalloc

import numpy as np
import pyarrow as pa

from skeinrank import ports
from skeinrank.operators import retrieve


def test_products_of_common_terms_are_held_in_parts():
    """3,000 chunks of 40 terms that all 200 questions ask for give 24 million products."""
    terms, names = np.array([f"t{i:02}" for i in range(40)]), np.arange(200)
    shared = (terms, names, np.tile(names, 40), np.arange(41) * 200, np.linspace(0.1, 1, 8000), pa.int64())
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(3000)), "len": [40 + i % 7 for i in range(3000)], "held": [terms.tolist()] * 3000})
    tracemalloc.start()
    got = pa.Table.from_batches(list(retrieve._gather([batch], shared, 5, lambda w, tf, length: w * tf / length, 6))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    want = (np.linspace(0.1, 1, 8000).reshape(40, 200).sum(0) / 40).round(6)
    assert len(got) == 1000
    for question, own in got.groupby("question_id"):
        assert own["chunk_id"].tolist() == [0, 7, 14, 21, 28] and np.allclose(own["score"], want[question], atol=2e-6)


def test_memo_of_words_is_bounded():
    model = ports.HashedTerms()
    model.embed([" ".join(f"w{i}" for i in range(250_000))])
    assert len(model.place) <= 100_001


def test_vectors_of_chunks_stay_in_their_task(spark):
    rows = spark.createDataFrame([(i, f"a b{i} c") for i in range(6)], "chunk_id long, text string")
    hits = retrieve.dense_texts(rows.withColumnRenamed("chunk_id", "question_id"), rows, 1, ports.HashedTerms())
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1
    assert {(r.question_id, r.chunk_id) for r in hits.collect()} == {(i, i) for i in range(6)}


def test_contents_are_not_shuffled_to_be_scored(spark, tmp_path):
    """Every question meets every content: only each task's k best of a question may be shuffled, not a row for each of both."""
    from skeinrank.functions import text as tx
    from skeinrank.operators.graph import EntityGraph

    chunks = spark.range(2000).selectExpr("id AS chunk_id", "concat('shared words here w', id % 50, ' x', id) AS text").repartition(4)
    questions = spark.range(30).selectExpr("id AS question_id", "concat('shared words here w', id) AS text")
    g = EntityGraph.build(spark, str(tmp_path / "g"), chunks, tx.tokens)
    for hits in (g.local(questions, 3), g.global_(questions, 3)):
        assert hits.count() == 90
        assert "MapInArrow" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_levels_are_made_once(spark):
    """A plan that holds a level's making in each later one doubles with every level."""
    from skeinrank.operators import chunking

    leaves = spark.createDataFrame([(1, i, f"n{i}", f"text {i}", [f"n{i}"]) for i in range(40)], "doc_id int, ord int, node_id string, text string, ids array<string>")
    tree = chunking.raptor(leaves)
    assert tree._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    assert sorted((r.level, r["count"]) for r in tree.groupBy("level").count().collect()) == [(0, 40), (1, 8), (2, 2), (3, 1)]


def test_texts_that_share_parts_are_embedded_once(spark):
    """The enriched texts of a scorecard are sums of the same parts: one pass of the embedder gives them all, and analysed words are read."""
    from pyspark.sql import functions as F

    from skeinrank.functions import text as tx

    rows = [(1, "law", "One fee. Two fees", "One"), (2, "", "Fees are ΟΔΟΣ", "Fees"), (3, "tax fee", None, None), (4, "law tax", "", None)]
    parts = spark.createDataFrame(rows, "chunk_id long, context string, text string, lead string")
    asked = spark.createDataFrame([(1, "one fee"), (2, "ΟΔΟΣ law tax")], "question_id long, text string")
    joined = lambda *c: parts.select("chunk_id", F.concat_ws("\n\n", *c).alias("text"))
    frames = {"questions": asked, "chunks": parts.select("chunk_id", "text"), "contextual": joined("context", "text"), "both": joined("lead", "context", "text")}
    made_of = {"chunks": ["text"], "contextual": ["context", "text"], "both": ["lead", "context", "text"]}
    labels = []

    def store(df, label):
        labels.append(label)
        return df

    once = retrieve.Corpus(ports.HashedTerms(), tx.terms, store, made_of=made_of, parts=parts, **frames)
    each = retrieve.Corpus(ports.HashedTerms(), tx.terms, **frames)
    ranking = lambda df: sorted(map(tuple, df.collect()))
    for name in made_of:
        assert ranking(once.near(name, 4)) == ranking(each.near(name, 4))
    assert labels == ["parts", "near-chunks", "near-contextual"]
    analysed = frames["contextual"].select("chunk_id", tx.terms(F.col("text")).alias("words"))
    assert ranking(retrieve.bm25(asked, analysed, 4, tx.terms)) == ranking(retrieve.bm25(asked, frames["contextual"], 4, tx.terms))
