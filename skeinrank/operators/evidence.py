"""Evidence of a run: what is wrong with its manifest, its artifacts by question, summaries, resuming, and the catalog of published runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unit_score, valid_run_id

# ---------------------------------------------------------------- what is pending, and whether a run may go on


def pending(requested: DataFrame, completed: DataFrame) -> DataFrame:
    """requested(strategy, ord) without completed(strategy), in order of `ord`."""
    return requested.join(completed.select("strategy"), "strategy", "left_anti")


def select_split(split: DataFrame, judgments: DataFrame, partition: str) -> DataFrame:
    """The judgments of one partition with their place `ord` in it; an id without a judgment is an error."""
    if partition not in ("train", "validation", "test"):
        raise ValueError("a partition is train, validation or test")
    own = split.where(F.col("partition") == partition).select("question_id", "ord")
    both = own.join(judgments.withColumn("__known", F.lit(True)), "question_id", "left")
    missing = F.raise_error(F.concat(F.lit("no judgment of question "), F.col("question_id").cast("string")))
    return both.withColumn("question_id", F.when(F.col("__known"), F.col("question_id")).otherwise(missing.cast(split.schema["question_id"].dataType))).drop("__known")


def checkpoint_complete(metrics: Column, expected: Column) -> Column:
    """Of a map of a strategy's metrics: as many answers as expected, and no error of either kind. A missing number isn't complete."""
    return F.coalesce((metrics["answer_n"] == expected) & (metrics["answer_errors"] == 0) & (metrics["errors"] == 0), F.lit(False))


def identity_faults(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, field, previous, current) wherever two tables of the same fields differ (null-safe), all of them at once."""
    fields = [c for c in current.columns if c != key]
    text = lambda f: F.col(f).cast("string") if not isinstance(current.schema[f].dataType.jsonValue(), dict) else F.to_json(f)
    pack = lambda df, name: df.select(key, F.array(*(F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in fields)).alias(name))
    both = pack(previous, "p").join(pack(current, "c"), key, "full")
    filled = lambda a: F.coalesce(a, F.array(*(F.struct(F.lit(f).alias("field"), F.lit(None).cast("string").alias("value")) for f in fields)))
    each = both.select(key, F.explode(F.arrays_zip(filled(F.col("p")).alias("p"), filled(F.col("c")).alias("c"))).alias("z"))
    return each.where(~F.col("z.p.value").eqNullSafe(F.col("z.c.value"))).select(key, F.col("z.p.field").alias("field"), F.col("z.p.value").alias("previous"), F.col("z.c.value").alias("current"))


# ---------------------------------------------------------------- manifests

MANIFEST = (
    "schema_version int, run_id string, status string, git_sha string, started_at string, completed_at string, corpus_hash string, dataset_hash string,"
    " split_hash string, configuration_hash string, models map<string,string>, strategies array<string>, execution map<string,string>, artifact_root_hash string"
)
NEEDED = "run_id status git_sha started_at corpus_hash dataset_hash split_hash configuration_hash".split()
HASHES = "git_sha corpus_hash dataset_hash split_hash configuration_hash".split()


def manifest_faults(manifests: DataFrame) -> DataFrame:
    """(run_id, fault): fields that are missing or empty, a status unknown, a completed run without its time or hash."""
    faults = [F.when(F.coalesce(F.col(c), F.lit("")) == "", f"{c} is missing") for c in NEEDED]
    faults += [F.when(F.col(c).isNull(), f"{c} is missing") for c in ("schema_version", "models", "strategies", "execution")]
    faults += [F.when(~F.col("status").isin("running", "completed"), "unknown status"), F.when((F.col("status") == "completed") & (F.col("completed_at").isNull() | F.col("artifact_root_hash").isNull()), "completed without evidence")]
    return manifests.select("run_id", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def artifacts_missing(manifests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run_id, strategy) that a completed manifest declares and no artifact (run_id, strategy) has."""
    declared = manifests.where("status = 'completed'").select("run_id", F.explode("strategies").alias("strategy")).distinct()
    return declared.join(artifacts.select("run_id", "strategy"), ["run_id", "strategy"], "left_anti")


# ---------------------------------------------------------------- artifacts and summaries


def question_artifacts(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(question_id, strategy, body): a record with its candidates in rank order, as one JSON text; a record without any has an
    empty list. candidates(question_id, strategy, candidate_rank, chunk_id, score); ranks count from 0."""
    rest = [c for c in records.columns if c not in ("question_id", "strategy")]
    own = candidates.groupBy("question_id", "strategy").agg(F.array_sort(F.collect_list(F.struct("candidate_rank", "chunk_id", "score"))).alias("candidates"))
    both = records.join(own, ["question_id", "strategy"], "left")
    empty = F.array().cast(own.schema["candidates"].dataType)
    body = F.to_json(F.struct(F.struct("question_id", "strategy", *rest).alias("question_record"), F.coalesce("candidates", empty).alias("candidate_lineage")), {"ignoreNullFields": "false"})
    return both.select("question_id", "strategy", body.alias("body"))


def merge_summaries(old: DataFrame, new: DataFrame, key: str = "strategy") -> DataFrame:
    """Rows of both; of a key that both have the new one."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def ordered_ids(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """(strategy, question_id, ids): what the hits of a ranking cover, in rank order, each once. ids(chunk_id, ref_id, place)."""
    rows = hits.join(ids, "chunk_id").groupBy("strategy", "question_id", "ref_id").agg(F.min(F.struct("rank", "place")).alias("at"))
    return rows.groupBy("strategy", "question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref_id"))), lambda x: x["ref_id"]).alias("ids"))


def judge_scores_valid(results: DataFrame, names: list[str]) -> DataFrame:
    """The results with `fault`: the first score that isn't a number from 0 to 1, or null."""
    return results.withColumn("fault", F.coalesce(*(F.when(~unit_score(F.col(n)), F.lit(n)) for n in names)))


# ---------------------------------------------------------------- corpora


def source_faults(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """manifest(norm_id, source_path, source_sha256, expected_article_count, enabled), found(digest, relative_path): all that
    is wrong with the enabled documents."""
    on = manifest.where("enabled").join(found.withColumnRenamed("relative_path", "source_path"), "source_path", "left")
    fault = F.when(F.col("source_sha256").isNull() | F.col("expected_article_count").isNull(), "hash or count not given").when(F.col("digest").isNull(), "file not found").when(F.col("digest") != F.col("source_sha256"), "hash differs")
    return on.withColumn("fault", fault).where("fault is not null").select("norm_id", "source_path", "fault")


def document_versions(manifest: DataFrame) -> DataFrame:
    return manifest.where("enabled").select(F.col("norm_id").alias("norm"), F.col("source_sha256").alias("hash"))


def corpus_hash(manifest: DataFrame) -> DataFrame:
    """One row: the digest of the enabled documents' sorted names and hashes."""
    item = F.concat_ws(":", "norm_id", "source_sha256")
    return manifest.where("enabled").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "|"), 256).alias("content_hash"))


def ids_by_norm(chunks: DataFrame) -> DataFrame:
    """(norm, ref_id) of chunks(norm_id, structural_ids), each once."""
    return chunks.select(F.col("norm_id").alias("norm"), F.explode("structural_ids").alias("ref_id")).distinct()


def split_faults(split: DataFrame, judgments: DataFrame) -> DataFrame:
    """(question_id, fault): in the split twice, unknown to the judgments, or of no partition."""
    a = split.groupBy("question_id").agg(F.count("*").alias("n"))
    both = a.join(judgments.select("question_id").distinct().withColumn("known", F.lit(True)), "question_id", "full")
    faults = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicated"), F.when(F.col("known").isNull(), "unknown"), F.when(F.col("n").isNull(), "not selected")))
    return both.select("question_id", F.explode(faults).alias("fault"))


# ---------------------------------------------------------------- published runs


def published(catalog: DataFrame, results: DataFrame, manifests: DataFrame) -> DataFrame:
    """catalog(run_id, title, recommended, latest_run_id), results(run_id, strategies array), manifests(run_id, status, completed_at
    string): each run with `fault`, null if it may be shown, newest first by `place`."""
    r = results.select(F.col("run_id").alias("rid"), "strategies")
    m = manifests.select(F.col("run_id").alias("mid"), "status", "completed_at")
    times = catalog.groupBy("run_id").agg(F.count("*").alias("times"))
    rows = catalog.join(times, "run_id").join(r, F.col("run_id") == F.col("rid"), "left").join(m, F.col("run_id") == F.col("mid"), "left")
    fault = (
        F.when(~valid_run_id(F.col("run_id")), "run id is malformed").when(F.col("times") > 1, "run id is listed twice").when(F.col("rid").isNull() | F.col("mid").isNull(), "files are missing or of another run")
        .when(F.col("status") != "completed", "not completed").when(~F.coalesce(F.col("completed_at").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.lit(False)), "time without a zone").when(~F.coalesce(F.array_contains("strategies", F.col("recommended")), F.lit(False)), "recommended strategy has no metrics")
    )
    out = rows.select("run_id", "title", fault.alias("fault"), (F.col("run_id") == F.col("latest_run_id")).alias("latest")).distinct()
    newest = out.select("run_id").distinct().selectExpr("run_id", "row_number() over (order by run_id desc) as place")  # a catalog is a handful of runs
    return out.join(newest, "run_id")
