"""Readers and writers of the engine's files, with schemas given, not inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JUDGMENTS = "version string, judgments array<struct<question_id string, text string, query_class string, relevant_refs array<struct<ref string, grade string>>, reference_answer string>>"
RECORDS = (
    "question_id string, query_class string, strategy string, unanswerable boolean, retrieval_status string, generation_status string, judge_status string,"
    " retrieved_structural_ids array<string>, answer_text string, answer_citations array<string>, judge_contexts array<string>, metrics map<string, double>, errors array<string>"
)
EVENTS = "schema_version int, sequence long, event_id string, run_id string, correlation_id string, stage string, event_type string, occurred_at string, payload_hash string, previous_event_hash string, event_hash string"
# What a grade is worth.
GAINS = {"relevant": 1.0, "partially_relevant": 0.5}


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(ord, question_id, text, query_class, refs, reference_answer)."""
    rows = spark.read.json(path, schema=JUDGMENTS, multiLine=True, mode="FAILFAST").select(F.posexplode("judgments").alias("ord", "j"))
    return rows.select("ord", "j.question_id", "j.text", "j.query_class", F.col("j.relevant_refs").alias("refs"), "j.reference_answer")


def qrels(judgments: DataFrame) -> DataFrame:
    """(question_id, ref_id, norm, gain); of a ref judged twice the last grade holds."""
    rows = judgments.select("question_id", F.posexplode("refs").alias("i", "r"))
    last = rows.groupBy("question_id", F.col("r.ref").alias("ref_id")).agg(F.max_by("r.grade", "i").alias("grade"))
    gain = F.coalesce(*(F.when(F.col("grade") == g, F.lit(v)) for g, v in GAINS.items()))
    return last.select("question_id", "ref_id", F.split_part("ref_id", F.lit("::"), F.lit(1)).alias("norm"), gain.alias("gain"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.json(path, schema="train array<string>, validation array<string>, test array<string>", multiLine=True)
    parts = [rows.select(F.lit(p).alias("partition"), F.posexplode(p).alias("ord", "question_id")) for p in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("question_id", "partition", "ord")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each strategy and question, by line. A metric that isn't a finite number is an error."""
    meta = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__line")]
    rows = spark.read.json(path, schema=RECORDS, mode="FAILFAST").select("*", *meta)
    bad = F.exists(F.map_values("metrics"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fault = F.raise_error(F.concat(F.lit("a metric isn't a finite number: "), F.col("question_id")))
    rows = rows.withColumn("metrics", F.when(bad, fault.cast("map<string,double>")).otherwise(F.col("metrics")))
    rest = [c for c in rows.columns if c not in ("strategy", "question_id", "__file", "__from", "__line")]
    # files follow by name, the ranges that tasks read of a file by their start, and the lines of a range as they were read: which
    # task reads a range first doesn't matter
    last = rows.groupBy("strategy", "question_id").agg(F.max_by(F.struct(*rest), F.struct("__file", "__from", "__line")).alias("r"))
    return last.select("question_id", "strategy", *(F.col(f"r.{c}").alias(c) for c in rest))


def replace_strategy(records: DataFrame, path: str) -> None:
    """Overwrites the partitions of the strategies in `records`, no others."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=EVENTS, mode="FAILFAST")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    line = F.split("value", "  ", 2)
    return spark.read.text(path).where("value <> ''").select(F.get(line, F.lit(0)).alias("digest"), F.get(line, F.lit(1)).alias("relative_path"))


def checksum_faults(recorded: DataFrame, found: DataFrame) -> DataFrame:
    both = recorded.withColumnRenamed("digest", "a").join(found.withColumnRenamed("digest", "b"), "relative_path", "full")
    reason = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "modified")
    return both.withColumn("reason", reason).where("reason is not null").select("relative_path", "reason")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(norm_id, source_path, extractor, expected_article_count, source_sha256, enabled) of a corpus manifest (YAML, read on
    the driver: a handful of documents). An enabled document without count or hash is an error."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    names = ["norm_id", "source_path", "extractor", "expected_article_count", "source_sha256", "enabled"]
    rows = [[d[n] if n in ("norm_id", "source_path", "extractor", "enabled") else d.get(n) for n in names] for d in yaml.safe_load(text)["documents"]]
    for r in rows:
        if r[5] and (r[3] is None or r[4] is None):
            raise ValueError(f"{r[0]}: an enabled document needs expected_article_count and source_sha256")
    return spark.createDataFrame(rows, "norm_id string, source_path string, extractor string, expected_article_count long, source_sha256 string, enabled boolean")


def read_run_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests, a file each; `evidence.manifest_faults` says what is wrong with them."""
    from ..operators.evidence import MANIFEST

    return spark.read.json(path, schema=MANIFEST, multiLine=True, mode="FAILFAST")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="sample_id string, dimension string, human_score double", multiLine=True, mode="FAILFAST")


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, sample_id, judge_score)."""
    rows = spark.read.json(path, schema="schema_version int, evidence_schema_version int, run_id string, judge_scores map<string,double>", multiLine=True, mode="FAILFAST")
    return rows.select("run_id", F.explode("judge_scores").alias("sample_id", "judge_score"))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, text) of HTML files: UTF-8, else Windows-1252."""
    from ..functions.text import decoded, html_lite

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("relative_path"), html_lite(decoded(F.col("content"))).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of this machine's own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: stored tables need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skeinrank-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that goes when the application ends."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    temporary(spark, path)
    return f"{path}/{label}"


def temporary(spark: SparkSession, path: str) -> None:
    """A folder that goes when the application ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the folder that all executors share, and read back, so that what follows is made once."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Dealt out to all cores, if the source has fewer partitions than there are cores: a small table in one file. Larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a stored table or index."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
