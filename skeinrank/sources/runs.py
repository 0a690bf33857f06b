"""Published runs from their JSON files, and digests of files in pieces.

A catalog lists the runs that may be shown. Each has a file of results and a manifest, in folders named after the run, or
`run_id=` and the run. What is wrong with a run becomes its `fault`; no file fails a job.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import valid_run_id

# The largest document in bytes, and the fields that documents must have.
LARGEST = 5 * 1024 * 1024
SAMPLE = "kind string, question_count long, source_split_question_count long, sampling_seed string"
RECOMMENDATION = "strategy string, rationale string, scope string"
ENTRY = f"run_id string, title string, sample struct<{SAMPLE}>, recommendation struct<{RECOMMENDATION}>"
METRIC = (
    "recall_at_k double, precision_at_k double, ndcg_at_k double, mrr double, drm_at_k double, errors long, citation_accuracy double,"
    " faithfulness double, answer_relevancy double, abstention_appropriate double, n long, answer_n long, answer_errors long"
)
RESULTS = (
    "run_id string, mode string, config_path string, embedding struct<provider string, model string>, generation_model string,"
    f" judge_provider string, judge_model string, k long, n_chunks long, metrics map<string, struct<{METRIC}>>"
)
RESULT_FIELDS = "run_id mode config_path embedding generation_model judge_provider judge_model k n_chunks metrics".split()
MANIFEST = "run_id string, status string, git_sha string, completed_at string"
SAMPLE_KIND = "deterministic_stratified_sample"

#: Bytes of a file that are digested as one piece, and that are read at once.
PIECE, READ = 64 * 1024 * 1024, 1024 * 1024


def _names(schema: str) -> list[str]:
    """The fields of a flat schema."""
    return [f.split()[0] for f in schema.split(", ")]


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, text, fault) of the documents that `path` (which may hold wildcards) names; the run is the folder's. Only the length
    of a document beyond LARGEST is read."""
    files = spark.read.format("binaryFile").load(path)
    run = F.regexp_replace(F.regexp_extract("path", "([^/]+)/[^/]+$", 1), "^run_id=", "")
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    small = files.where(F.col("length") <= LARGEST).select(run.alias("run_id"), F.when(utf8, F.col("content").cast("string")).alias("text"), F.when(~utf8, "not UTF-8").alias("fault"))
    large = files.where(F.col("length") > LARGEST).select(run.alias("run_id"), F.lit(None).cast("string").alias("text"), F.lit(f"larger than {LARGEST} bytes").alias("fault"))
    return small.unionByName(large)


def _missing(fields: list[str], of: Column) -> list[Column]:
    return [F.when(of[f].isNull(), f"{f} is missing or of another type") for f in fields]


def _unknown(text: Column, fields: list[str]) -> Column:
    """A fault, if an object has fields beside these."""
    return F.when(F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, fields)))) > 0, "unknown fields")


def _parsed(files: DataFrame, schema: str) -> DataFrame:
    """(run_id, doc, fault): a text that isn't an object has no field of its own, and is told apart by its keys."""
    broken = F.when(F.json_object_keys("text").isNull(), "no JSON object")
    return files.select("run_id", "text", F.from_json("text", schema).alias("doc"), F.coalesce("fault", broken).alias("fault"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, title, sample, recommendation, latest_run_id, fault), a row an entry. What is wrong with the catalog as a whole is
    every entry's fault: a version other than 1, a malformed or repeated id, a latest run that isn't listed, or unknown fields."""
    head = "schema_version int, latest_run_id string, runs array<string>"
    files = _parsed(json_files(spark, path), head)
    each = files.select("doc.latest_run_id", F.coalesce("fault", _unknown(F.col("text"), ["schema_version", "latest_run_id", "runs"]), F.when(~F.col("doc.schema_version").eqNullSafe(F.lit(1)), "another version")).alias("whole"), F.explode_outer("doc.runs").alias("raw"))
    each = each.select("latest_run_id", "whole", "raw", F.from_json("raw", ENTRY).alias("e"))
    e = F.col("e")
    inner = [_unknown(F.get_json_object("raw", f"$.{part}"), _names(fields)) for part, fields in (("sample", SAMPLE), ("recommendation", RECOMMENDATION))]
    own = F.coalesce(
        _unknown(F.col("raw"), ["run_id", "title", "sample", "recommendation"]), *inner, *_missing(["run_id", "title", "sample", "recommendation"], e), *_missing(_names(SAMPLE), e["sample"]), *_missing(_names(RECOMMENDATION), e["recommendation"]),
        F.when(e["sample"]["kind"] != SAMPLE_KIND, "unknown kind of sample"), F.when((e["sample"]["question_count"] <= 0) | (e["sample"]["source_split_question_count"] <= 0), "a sample without questions"), F.when(~valid_run_id(e["run_id"]), "malformed run id"),
    )
    rows = each.select(e["run_id"].alias("run_id"), e["title"].alias("title"), e["sample"].alias("sample"), e["recommendation"].alias("recommendation"), "latest_run_id", F.coalesce("whole", own).alias("fault"))
    listed = rows.groupBy("run_id").agg(F.count("*").alias("times"))
    state = rows.join(listed, "run_id", "left").agg(F.min("fault").alias("first"), F.max("times").alias("times"), F.max((F.col("run_id") == F.col("latest_run_id")).cast("int")).alias("has"))
    verdict = F.coalesce("first", F.when(F.col("times") > 1, "a run is listed twice"), F.when(~F.col("has").eqNullSafe(F.lit(1)), "the latest run isn't listed"))
    return rows.drop("fault").join(F.broadcast(state.select(verdict.alias("fault"))))  # one row: an aggregate without groups


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, doc, fault) of the results; a number that is missing, not finite or of another type is a fault."""
    rows = _parsed(json_files(spark, path), RESULTS)
    d = F.col("doc")
    doubles = [n for n in _names(METRIC) if f"{n} double" in METRIC]
    whole = lambda m: F.forall(F.array(*(m[n].isNotNull() for n in _names(METRIC)), *(~F.isnan(m[n]) & (F.abs(m[n]) != float("inf")) for n in doubles)), lambda good: F.coalesce(good, F.lit(False)))
    wrong = F.coalesce(
        F.when(d["run_id"] != F.col("run_id"), "of another run"), *_missing(RESULT_FIELDS, d),
        *_missing(["provider", "model"], d["embedding"]), F.when((d["k"] <= 0) | (d["n_chunks"] <= 0), "k and n_chunks must be positive"), F.when(F.size(d["metrics"]) < 1, "no metrics"), F.when(~F.forall(F.map_values(d["metrics"]), whole), "a metric isn't a finite number"),
    )
    return rows.select("run_id", "doc", F.coalesce("fault", wrong).alias("fault"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, doc, fault) of the manifests of completed runs."""
    rows = _parsed(json_files(spark, path), MANIFEST)
    d = F.col("doc")
    zone = d["completed_at"].rlike(r"(Z|[+-]\d\d:?\d\d)$") & d["completed_at"].try_cast("timestamp").isNotNull()
    wrong = F.coalesce(F.when(d["run_id"] != F.col("run_id"), "of another run"), F.when(d["status"] != "completed", "not completed"), *_missing(_names(MANIFEST), d), F.when(~F.coalesce(zone, F.lit(False)), "no time with a zone"))
    return rows.select("run_id", "doc", F.coalesce("fault", wrong).alias("fault"))


def published(catalog: DataFrame, results: DataFrame, manifests: DataFrame) -> DataFrame:
    """The catalog's runs with what their files say and `fault`, null if the run may be shown; `latest` marks the designated one. Only
    runs of the catalog are looked up, by id, so no path comes out of a file. `metrics` holds (strategy, metric) pairs."""
    r, m = results.select("run_id", F.col("doc").alias("r"), F.col("fault").alias("rf")), manifests.select("run_id", F.col("doc").alias("m"), F.col("fault").alias("mf"))
    both = catalog.join(r, "run_id", "left").join(m, "run_id", "left")
    absent = F.when(~F.array_contains(F.map_keys("r.metrics"), F.col("recommendation.strategy")), "recommended strategy has no metrics")
    fault = F.coalesce("fault", F.concat(F.lit("results: "), F.coalesce("rf", F.when(F.col("r").isNull(), "no file"))), F.concat(F.lit("manifest: "), F.coalesce("mf", F.when(F.col("m").isNull(), "no file"))), absent)
    return both.select(
        "run_id", "title", fault.alias("fault"), (F.col("run_id") == F.col("latest_run_id")).alias("latest"), F.col("m.completed_at").try_cast("timestamp").alias("completed_at"), "m.git_sha", "r.mode", "r.config_path",
        F.concat_ws("/", "r.embedding.provider", "r.embedding.model").alias("embedding_model"), "r.generation_model", F.concat_ws("/", "r.judge_provider", "r.judge_model").alias("judge_model"), "r.k", F.col("r.n_chunks").alias("chunk_count"),
        "sample", "recommendation", F.map_entries("r.metrics").alias("metrics"),
    )


def run_metrics(runs: DataFrame) -> DataFrame:
    """Of the runs without a fault a row a strategy; errors are those of both stages."""
    each = runs.where("fault is null").select("run_id", F.explode("metrics").alias("m"))
    names = [n for n in _names(METRIC) if n not in ("errors", "answer_errors")]
    return each.select("run_id", F.col("m.key").alias("strategy"), *(F.col(f"m.value.{n}").alias(n) for n in names), (F.col("m.value.errors") + F.col("m.value.answer_errors")).alias("errors"))


# ---------------------------------------------------------------- digests in pieces


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, length) of the files below `root`, without their content."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = lambda path: F.regexp_replace(path, "^file:/+", "file:/").alias("path")
    found = files.select(plain(F.col("path")), "length")
    # a scan leaves empty files out: their names come from the listing that it is made of
    names = spark.createDataFrame([(u,) for u in files.inputFiles()], "uri string")
    names = names.select(plain(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))))
    empty = names.join(found, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"))
    return found.unionByName(empty).select("path", F.substring("path", len(top) + 2, 1 << 30).alias("relative_path"), "length")


def _opened(path: str):
    """A file of any store that Arrow reads, at any position; local paths are those of a folder mounted on all executors."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _digests(ranges: DataFrame) -> DataFrame:
    """ranges(path, relative_path, piece, start, bytes) with `digest`; a task holds READ bytes at a time."""

    def run(frames):
        for f in frames:
            out = []
            for path, start, left in zip(f["path"], f["start"], f["bytes"]):
                h = hashlib.sha256()
                with _opened(path) as file:
                    file.seek(start)
                    while left > 0 and (data := file.read(min(READ, left))):
                        h.update(data)
                        left -= len(data)
                if left > 0:
                    raise OSError(f"{path} became shorter while it was read")
                out.append(h.hexdigest())
            yield pd.DataFrame({"relative_path": f["relative_path"], "piece": f["piece"], "bytes": f["bytes"], "digest": out})

    return ranges.mapInPandas(run, "relative_path string, piece long, bytes long, digest string")


def file_pieces(spark: SparkSession, root: str, piece: int = PIECE) -> DataFrame:
    """(relative_path, piece, bytes, digest): SHA-256 of each `piece` bytes of the files below `root`, counted from 0, so that many
    tasks read a large file and a fault names its place. An empty file is one empty piece."""
    files = _listed(spark, root)
    last = F.greatest(F.ceil(F.col("length") / piece) - 1, F.lit(0)).cast("long")
    each = files.select("path", "relative_path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * piece
    return _digests(each.select("path", "relative_path", "piece", start.alias("start"), F.least(F.lit(piece), F.col("length") - start).alias("bytes")).repartition("path", "piece"))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(digest, relative_path): the plain SHA-256 of each file below `root`, of any size; a file is one task's."""
    files = _listed(spark, root).select("path", "relative_path", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.col("length").alias("bytes"))
    return _digests(files.repartition("path")).select("digest", "relative_path")


def piece_faults(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(relative_path, piece, reason) wherever two tables of pieces differ."""
    key = ["relative_path", "piece"]
    both = recorded.select(*key, F.col("digest").alias("a")).join(found.select(*key, F.col("digest").alias("b")), key, "full")
    reason = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "modified")
    return both.select(*key, reason.alias("reason")).where("reason is not null")
