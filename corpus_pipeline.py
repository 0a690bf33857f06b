"""The corpus pipeline: five stages over `documents`, each on all rows that the one before kept.

A stage's result is written as Parquet and read again before the next stage is called; so a
stage may first delete the scratch tables of the stage before it. Every stage but the last
returns the columns of `documents`. Of rows that repeat an id and
a text one stays. Null and empty
texts are never rejected as such; they are equal to each other, so one of them stays.
Decisions hold for an id and a text (or its set of shingles), so different texts under one
id, and null ids, are judged each by itself. Other columns are kept whatever their names are, but for the
last stage, which drops them. Texts of any length are judged whole; a severity at the cut is rejected; an
empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinrank.llm import toxicity as toxicity_model
from skeinrank.llm.byte_bpe import bpe_encode
from skeinrank.llm.decontaminate import contamination
from skeinrank.llm.exact_dedup import digests_of, exact_dedup
from skeinrank.llm.ngram_join import class_of, ngram_join
from skeinrank.llm.queries import BAD, GRADE, VOCABULARY
from skeinrank.llm.shared import materialize, release, scratch_paths, settled, short_batches, size_of, table

_own: list[str] = []


def _staged(stage):
    """Deletes what earlier stages of a pipeline left in the shared folder, and notes what this one leaves."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _own)
        short_batches(spark)
        before = set(scratch_paths())
        out = stage(spark, docs, sf_dir)
        _own[:] = [p for p in scratch_paths() if p not in before]
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` under column names that clash with none of an operator's, and the new name of each."""
    names = {c: f"__column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _settled(docs: DataFrame, verdicts: DataFrame, key_of, key_type: T.DataType) -> DataFrame:
    plain, names = _numbered(docs)
    return settled(plain, verdicts, key_of, key_type, names["doc_id"], names["text"]).toDF(*docs.columns)


@_staged
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejection's."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity_model.fit(docs, labels, GRADE, bad_from=BAD)
    plain, names = _numbered(docs)
    judged = toxicity_model.severity(plain, model, text_col=names["text"], keep=tuple(plain.columns))
    return judged.where(F.col("severity") < model.reject).drop("severity").toDF(*docs.columns)


@_staged
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of rows that repeat an id and a text, one."""
    found = exact_dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    # each id and text that is dropped or stands more than once
    some = found.where("group_size > 1").groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("key")).agg(F.count("*").alias("n"), F.every("kept").alias("stays"))
    return _settled(docs, materialize(some.where("n > 1 OR NOT stays").drop("n"), "verdicts"), digests_of, T.BinaryType())


@_staged
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five-word shingles, similarity of 0.8 or more), the one of the smallest id."""
    found = materialize(ngram_join(docs, width=5, p=4, q=5, classes_too=True).where("cls is not null").select("doc_id", "cls", "component"), "found")
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "cls")
    groups = materialize(found.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("members")).where("members > 1"), "groups", size_of(found))
    every = found.join(groups, "component").select(F.col("doc_id").alias("id"), F.col("cls").alias("key"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("cls") == F.col("first.cls"))).alias("stays"))
    return _settled(docs, materialize(every.distinct(), "verdicts", size_of(found)), class_of(5), T.LongType())


@_staged
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    plain, names = _numbered(docs)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias(names["text"]))
    found = contamination(plain, items, id_col=names["doc_id"], text_col=names["text"], keep=tuple(plain.columns))
    return found.where(F.size("spans") == 0).select(*plain.columns).toDF(*docs.columns)


@_staged
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (little-endian uint32), and a digest of what they decode to."""
    coded = bpe_encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=("lang", "source", "n_chars"))
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", decontaminate), ("byte-level BPE", encode)]

#: Neither the fitted model nor BPE has an SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        written = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
