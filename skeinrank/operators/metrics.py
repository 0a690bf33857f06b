"""Scores of rankings: hits(strategy, question_id, rank, chunk_id), ids(chunk_id, ref_id, norm), qrels(question_id, ref_id, norm, gain)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import failure_runs

NAMES = ["recall", "precision", "mrr", "ndcg", "drm"]


def _share(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _mean(name: str):
    """The mean of values of six digits, half up to six digits: added up as whole numbers, so that no order of rows shows."""
    total, n = F.sum(F.round(F.col(name) * 1_000_000).cast("long")), F.count(name)
    return (F.floor((2 * total + n) / (2 * n)).cast("long") / 1_000_000).alias(name)


def question_metrics(hits: DataFrame, ids: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row a strategy and question with judgments. A judged id counts once, at the first rank that covers
    it; a rank gains its best new id; precision divides by what was returned; the reciprocal rank sees all hits."""
    # of a ref judged twice the last grade holds; here the larger one, as rows have no order
    q = qrels.groupBy("question_id", "ref_id", "norm").agg(F.max("gain").alias("gain"))
    covered = hits.join(ids.select("chunk_id", "ref_id"), "chunk_id").join(q, ["question_id", "ref_id"])
    first = covered.groupBy("strategy", "question_id", "ref_id").agg(F.min("rank").alias("rank"), F.max("gain").alias("gain"))
    found = first.groupBy("strategy", "question_id").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("best"))
    gained = first.where(F.col("rank") <= k).groupBy("strategy", "question_id", "rank").agg(F.max("gain").alias("gain"))
    dcg = gained.groupBy("strategy", "question_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    at_hit = covered.where(F.col("rank") <= k).groupBy("strategy", "question_id").agg(F.count_distinct("rank").alias("hit"))
    shown = hits.where(F.col("rank") <= k).groupBy("strategy", "question_id").agg(F.count("*").alias("shown"))
    norms = q.select("question_id", "norm").distinct()
    good = hits.where(F.col("rank") <= k).join(ids.select("chunk_id", "norm"), "chunk_id").join(norms, ["question_id", "norm"], "left_semi").groupBy("strategy", "question_id").agg(F.count_distinct("rank").alias("fit"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("gain")))
    ideal = q.withColumn("i", place).groupBy("question_id").agg(F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1))).alias("ideal"), F.count("*").alias("judged"))
    frame = hits.select("strategy").distinct().join(ideal)  # strategies are a handful
    for part in (found, dcg, at_hit, shown, good):
        frame = frame.join(part, ["strategy", "question_id"], "left")
    return frame.select(
        "strategy", "question_id",
        F.round(_share(F.col("found"), F.col("judged")), 6).alias("recall"),
        F.round(_share(F.col("hit"), F.col("shown")), 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("mrr"),
        F.round(_share(F.col("dcg"), F.col("ideal")), 6).alias("ndcg"),
        F.round(_share(F.col("shown") - F.coalesce("fit", F.lit(0)), F.col("shown")), 6).alias("drm"),
    )


def scorecard(metrics: DataFrame, k: int = 5, failed: DataFrame | None = None) -> DataFrame:
    """Means by strategy with n, k and how many questions failed: failed(strategy, question_id)."""
    means = metrics.groupBy("strategy").agg(*map(_mean, NAMES), F.count("*").alias("n"))
    if failed is not None:
        n = failed.groupBy("strategy").agg(F.count("*").alias("errors"))
        means = means.join(n, "strategy", "full").fillna(0.0, NAMES).fillna(0, ["n"])
    else:
        means = means.withColumn("errors", F.lit(0).cast("long"))
    return means.select("strategy", *NAMES, "n", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.lit(k).alias("k"))


ANSWER_NAMES = ["faithfulness", "answer_relevancy", "abstention_appropriate"]


def answer_means(records: DataFrame) -> DataFrame:
    """records(strategy, question_id, generation_status, judge_status, metrics map): means over answers that were judged;
    citation accuracy has a count of its own, as unanswerable questions have none. All rates are 0 without rows."""
    good = (F.col("generation_status") == "succeeded") & (F.col("judge_status") == "succeeded")
    value = lambda m: F.when(good, F.col("metrics")[m])
    mean = lambda m: F.round(F.coalesce(F.avg(value(m)), F.lit(0.0)), 6).alias(m)
    failed = (F.col("generation_status") == "failed") | (F.col("judge_status") == "failed")
    return records.groupBy("strategy").agg(mean("citation_accuracy"), *map(mean, ANSWER_NAMES), F.count(value("citation_accuracy")).alias("citation_n"), F.count_if(good).alias("answer_n"), F.count_if(failed).alias("answer_errors"))


UNANSWERABLE = "__unanswerable__"


def record_breakdowns(records: DataFrame, judgments: DataFrame) -> DataFrame:
    """records(strategy, question_id, query_class, retrieval_status, generation_status, metrics map),
    judgments(question_id, norms array): by query class, and by each document that is relevant (a record counts once
    in each). One row a group and metric, with the group's counts; a record without a judgment is an error."""
    both = records.join(judgments.withColumn("__known", F.lit(True)), "question_id", "left")
    norms = F.when(F.coalesce(F.size("norms"), F.lit(0)) > 0, F.array_distinct("norms")).otherwise(F.array(F.lit(UNANSWERABLE)))
    norms = F.when(F.col("__known"), norms).otherwise(F.raise_error(F.concat(F.lit("no judgment of question "), F.col("question_id").cast("string"))))
    rows = both.select(
        "strategy", "question_id", "retrieval_status", "generation_status", "metrics",
        F.explode(F.concat(F.array(F.struct(F.lit("query_class").alias("dimension"), F.coalesce("query_class", F.lit("unknown")).alias("member"))), F.transform(norms, lambda n: F.struct(F.lit("document").alias("dimension"), n.alias("member"))))).alias("g"),
    ).select("*", "g.dimension", "g.member")
    groups = ["dimension", "strategy", "member"]
    counts = rows.groupBy(*groups).agg(F.count("*").alias("selected"), F.count_if(F.col("retrieval_status") == "succeeded").alias("retrieval_succeeded"), F.count_if(F.col("generation_status") == "succeeded").alias("answer_succeeded"))
    values = rows.select(*groups, F.explode_outer("metrics").alias("metric", "value")).where("metric is not null").groupBy(*groups, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))
    return counts.join(values, groups, "left")


def stage_durations(events: DataFrame) -> DataFrame:
    """events(run_id, stage, name, event_type, seconds): seconds from a stage's first start to its last end; null while it is open."""
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("seconds"))
    return events.groupBy("run_id", "stage", "name").agg(F.round(F.max(at("completed")) - F.min(at("started")), 6).alias("seconds"))


def dashboard(card: DataFrame) -> DataFrame:
    """The scorecard in the order of a dashboard: best nDCG first, then best reciprocal rank, then by name."""
    return card.withColumn("place", F.row_number().over(W.orderBy(F.desc("ndcg"), F.desc("mrr"), "strategy")))  # a row a strategy


def result_line(width: int = 14):
    """A fixed-width line of the scorecard."""
    cells = [F.rpad("strategy", width, " ")]
    cells += [F.lpad(F.format_string(f"%.{3}f", F.col(m)), n, " ") for m, n in (("recall", 9), ("precision", 12), ("ndcg", 8), ("mrr", 6), ("drm", 7))]
    return F.concat_ws(" ", *cells, F.lpad(F.col("n").cast("string"), 4, " "), F.lpad(F.col("errors").cast("string"), 6, " "))


def breakdown(metrics: DataFrame, members: DataFrame, dimension: str) -> DataFrame:
    """Means by a group that a question may be in more than one of: members(question_id, member)."""
    return metrics.join(members.distinct(), "question_id").groupBy("strategy", "member").agg(*map(_mean, NAMES), F.count("*").alias("n")).withColumn("dimension", F.lit(dimension))


def citation_accuracy(answers: DataFrame) -> DataFrame:
    """answers(question_id, cited, relevant): shares of distinct citations that are relevant; 0 without citations."""
    cited = F.array_distinct("cited")
    return answers.select("question_id", F.round(_share(F.size(F.array_intersect(cited, F.col("relevant"))), F.size(cited)), 6).alias("citation_accuracy"))


def circuit_breaker(events: DataFrame, partition: str, order: list[str], failed: str, limit: int = 5, segments: int | None = None) -> DataFrame:
    """`status`: skipped after `limit` failures in a row, else failed or succeeded. A key may hold any number of events."""
    runs = failure_runs(events, [partition], order, failed, limit, segments)
    return runs.withColumn("status", F.when(F.col("__open"), "skipped").when(F.col(failed), "failed").otherwise("succeeded")).drop("__open")
