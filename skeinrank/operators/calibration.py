"""Calibration of a judge against human labels: which answers are labelled, the labels and sealed scores, agreement, and the gate.

records(question_id, strategy, query_class, unanswerable, generation_status, judge_status, answer_text, answer_citations,
judge_contexts, metrics map), judgments(question_id, text, query_class, reference_answer, n_refs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import citation_candidates, citations, ordinal_bin, unit_score
from . import records as rec

#: The seed of the selection; whoever wants an earlier sample again gives that sample's.
SEED = "calibration-v2"
# The least number of answers, the gate, and what the features look for.
LEAST, FLOOR, TARGET = 30, 0.60, 0.70
METRIC_OF = {"faithfulness": "faithfulness", "answer_relevancy": "answer_relevancy", "abstention": "abstention_appropriate"}
BASE = ["faithfulness", "answer_relevancy"]
STRONG = ["sac", "sac_contextual", "raptor", "dense"]
CONCEPTS = ["answer_quality:complete", "answer_quality:partial", "citation:unsupported", "language:negation", "language:exception", "reasoning:cross_reference", "claim:numerical"]
NEGATION = r"(?iU)\b(?:não|nunca|sem|veda(?:do|da)?|proibi(?:do|da))\b"
EXCEPTION = r"(?iU)\b(?:salvo|exceto|ressalvad\w*|desde que|a menos que)\b"
NUMERICAL = r"(?U)(?:\d|%|R\$)"
MANY_REFS = ["multi_hop", "section_comparative"]


def dimensions() -> Column:
    return F.when(F.col("unanswerable"), F.array(*map(F.lit, [*BASE, "abstention"]))).otherwise(F.array(*map(F.lit, BASE)))


def usable() -> Column:
    """Answered and judged, with text and contexts, and a score from 0 to 1 in each dimension."""
    score = lambda d: unit_score(F.coalesce(*(F.when(d == k, F.col("metrics")[m]) for k, m in METRIC_OF.items())))
    whole = (F.col("generation_status") == "succeeded") & (F.col("judge_status") == "succeeded") & (F.col("answer_text") != "") & (F.size("judge_contexts") > 0)
    return F.coalesce(whole & F.forall(dimensions(), score), F.lit(False))


def stratum() -> Column:
    return F.struct(
        F.coalesce("query_class", F.lit("unclassified")).alias("query_class"),
        F.when(F.col("unanswerable"), "unanswerable").otherwise("answerable").alias("answerability"),
        F.when(F.col("strategy").isin(STRONG), "strong").otherwise("weak").alias("strength"),
    )


def features(records: DataFrame, judgments: DataFrame) -> DataFrame:
    """(question_id, strategy, stratum, features): the tags a selection has to cover. A record without a judgment is an error."""
    asked = judgments.select("question_id", F.col("text").alias("q"), F.col("query_class").alias("asked_class"), "reference_answer", "n_refs", F.lit(True).alias("known"))
    rows = records.join(asked, "question_id", "left").withColumn("s", stratum())
    given = citation_candidates(F.coalesce("answer_text", F.lit("")))
    good = citations(F.coalesce("answer_text", F.lit("")))
    loose = (F.coalesce(F.col("metrics")["citation_accuracy"], F.lit(1.0)) < 1.0) | (F.size(given) != F.size(good)) | F.exists(given, lambda c: F.contains(c, F.lit(",")))
    text = F.concat_ws("\n", *(F.when(F.col(c) != "", F.col(c)) for c in ("q", "reference_answer", "answer_text")))
    full = (F.col("metrics")["faithfulness"] >= 2 / 3) & (F.col("metrics")["answer_relevancy"] >= 2 / 3)
    tags = F.array(
        F.concat_ws(":", F.lit("stratum"), "s.query_class", "s.answerability", "s.strength"), F.concat(F.lit("class:"), F.col("s.query_class")), F.concat(F.lit("answerability:"), F.col("s.answerability")), F.concat(F.lit("strategy:"), F.col("s.strength")),
        F.when(full, "answer_quality:complete").otherwise("answer_quality:partial"), F.when(loose, "citation:unsupported"), F.when(text.rlike(NEGATION), "language:negation"), F.when(text.rlike(EXCEPTION), "language:exception"),
        F.when(F.col("asked_class").isin(MANY_REFS) | (F.col("n_refs") > 1), "reasoning:cross_reference"), F.when((F.col("asked_class") == "numeric_tabular") | text.rlike(NUMERICAL), "claim:numerical"),
    )
    tags = F.when(F.col("known"), F.array_sort(F.array_compact(tags))).otherwise(F.raise_error(F.concat(F.lit("no judgment of question "), F.col("question_id").cast("string"))))
    return rows.select("question_id", "strategy", F.concat_ws(":", "s.query_class", "s.answerability", "s.strength").alias("stratum"), tags.alias("features"))


def selection_key(seed: str = SEED) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(seed), F.col("question_id").cast("string"), "strategy"), 256)


def select(tagged: DataFrame, size: int, least: int = LEAST, concepts: list[str] | None = None, seed: str = SEED) -> list[tuple]:
    """(question_id, strategy) of a sample of `size`: greedily those that cover most of what is uncovered (of equals the
    smallest key), then the strata in turn, largest key first.

    A cover is sequential; the driver holds the `size` smallest and the `size` largest keys of each distinct
    set of features, which is all that either phase can ever take.
    """
    concepts = CONCEPTS if concepts is None else concepts
    if size < least:
        raise ValueError(f"at least {least} samples are needed")
    if (n := tagged.count()) < size:
        raise ValueError(f"only {n} usable records for {size} requested")
    keyed = tagged.withColumn("key", selection_key(seed))
    kind = W.partitionBy("stratum", "features")
    pool = keyed.withColumn("up", F.row_number().over(kind.orderBy("key"))).withColumn("down", F.row_number().over(kind.orderBy(F.desc("key")))).where((F.col("up") <= size) | (F.col("down") <= 2 * size))
    left = sorted((r.key, r.question_id, r.strategy, r.stratum, frozenset(r.features)) for r in pool.drop("up", "down").collect())
    every = frozenset().union(*(x[4] for x in left))
    if missing := sorted(set(concepts) - every):
        raise ValueError(f"no candidate covers {', '.join(missing)}")
    open_ = {f for f in every if f.startswith(("stratum:", "class:", "answerability:", "strategy:"))} | set(concepts)
    out = []
    while open_:
        best = min(left, key=lambda x: (-len(x[4] & open_), x[0]))
        if len(out) >= size:
            raise ValueError(f"a sample of {size} is too small to cover {', '.join(sorted(open_))}")
        out.append(best[1:3])
        left.remove(best)
        open_ -= best[4]
    strata: dict[str, list] = {}
    for x in left:
        strata.setdefault(x[3], []).append(x[1:3])
    turn = sorted(strata, key=lambda s: tuple(s.split(":")))
    while len(out) < size:
        for s in turn:
            if strata[s] and len(out) < size:
                out.append(strata[s].pop())
    return out


def coverage(tagged: DataFrame) -> DataFrame:
    """Each feature with how many records have it."""
    return tagged.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def sample_id(dimension: Column) -> Column:
    return F.concat_ws("-", F.col("question_id").cast("string"), "strategy", dimension)


def empty_labels(sample: DataFrame) -> DataFrame:
    """(sample_id, dimension, human_score): a row for each dimension a reviewer has to score."""
    return sample.select("question_id", "strategy", F.explode(dimensions()).alias("dimension")).select(sample_id(F.col("dimension")).alias("sample_id"), "dimension", F.lit(None).cast("double").alias("human_score"))


def sealed_scores(sample: DataFrame) -> DataFrame:
    """(sample_id, judge_score), hidden from the reviewer."""
    each = sample.select("question_id", "strategy", "metrics", F.explode(dimensions()).alias("dimension"))
    score = F.coalesce(*(F.when(F.col("dimension") == k, F.col("metrics")[m]) for k, m in METRIC_OF.items()))
    return each.select(sample_id(F.col("dimension")).alias("sample_id"), score.alias("judge_score"))


def merge_labels(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """The expected rows with the scores given before; the ids and dimensions must be the same."""
    if existing.isEmpty():
        return expected
    old = existing.select("sample_id", F.col("dimension").alias("was"), F.col("human_score").alias("given"))
    both = expected.drop("human_score").join(old, "sample_id", "full")
    fault = F.when(F.col("was").isNull() | F.col("dimension").isNull(), "labels belong to another sample").when(F.col("was") != F.col("dimension"), "a dimension changed")
    return both.select("sample_id", F.coalesce("dimension", "was").alias("dimension"), F.when(fault.isNull(), F.col("given")).otherwise(F.raise_error(fault)).alias("human_score"))


def sample_faults(labels: DataFrame, sealed: DataFrame, least: int = LEAST) -> DataFrame:
    """(fault, sample_id) of labels(sample_id, dimension, human_score) against sealed(sample_id, judge_score): repeated, without
    its other side, empty, not one of three scores, a score out of range, a dimension an answer lacks, too few answers."""
    keys = rec.set_difference(labels, sealed, "sample_id").select(F.col("reason").alias("fault"), "sample_id")
    score = F.col("human_score")
    own = F.when(score.isNull(), "no score").when(F.isnan(score) | ~score.isin(0.0, 0.5, 1.0), "not a score").when(~F.endswith("sample_id", F.concat(F.lit("-"), F.col("dimension"))), "another dimension's id")
    bad = labels.select(own.alias("fault"), "sample_id").where("fault is not null")
    wrong = sealed.where(~unit_score(F.col("judge_score"))).select(F.lit("judge score out of range").alias("fault"), "sample_id")
    answers = labels.select(answer_id().alias("a"), "dimension").groupBy("a").agg(F.collect_set("dimension").alias("have"))
    lacking = answers.where(F.size(F.array_intersect("have", F.array(*map(F.lit, BASE)))) < len(BASE)).select(F.lit("a dimension is missing").alias("fault"), F.col("a").alias("sample_id"))
    few = answers.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit(f"fewer than {least} answers").alias("fault"), F.lit(None).cast("string").alias("sample_id"))
    return keys.unionByName(bad).unionByName(wrong).unionByName(lacking).unionByName(few)


def answer_id() -> Column:
    return F.expr("left(sample_id, length(sample_id) - length(dimension) - 1)")


def samples(labels: DataFrame, sealed: DataFrame, least: int = LEAST) -> DataFrame:
    """(sample_id, dimension, judge_score, human_score); any fault is an error."""
    if faults := sample_faults(labels, sealed, least).limit(3).collect():
        raise ValueError("; ".join(f"{f.fault}: {f.sample_id}" for f in faults))
    return labels.join(sealed, "sample_id").select("sample_id", "dimension", "judge_score", "human_score")


def report(rows: DataFrame) -> DataFrame:
    """(scope, weighted_kappa, spearman, false_supported, false_unsupported, abstention_agreement, n, required, passed) overall and by
    dimension. Spearman is null where a side is constant; the gate wants `FLOOR` overall and in each base dimension."""
    both = rows.select(F.explode(F.array(F.lit("overall"), F.col("dimension"))).alias("scope"), "dimension", "judge_score", "human_score")
    pairs = both.select("scope", ordinal_bin(F.col("judge_score")).alias("a"), ordinal_bin(F.col("human_score")).alias("b"))
    raw = both.select("scope", F.col("judge_score").alias("a"), F.col("human_score").alias("b"), "dimension")
    rates = rec.support_rates(raw.where("dimension = 'faithfulness'"), ["scope"]).drop("agreement")
    agree = rec.support_rates(raw.where("dimension = 'abstention'"), ["scope"]).select("scope", F.col("agreement").alias("abstention_agreement"))
    out = rec.kappa(pairs, ["scope"]).withColumnRenamed("kappa", "weighted_kappa").join(rec.spearman(raw, ["scope"]).drop("n"), "scope").join(rates, "scope", "left").join(agree, "scope", "left")
    need = F.col("scope").isin("overall", *BASE)
    return out.fillna(0.0, ["false_supported", "false_unsupported", "abstention_agreement"]).withColumn("required", need).withColumn("passed", ~need | (F.col("weighted_kappa") >= FLOOR))


def gate(reported: DataFrame) -> DataFrame:
    """One row: passed, and the scopes that failed; without the required ones it isn't passed."""
    need = F.col("required")
    failed = F.array_sort(F.collect_list(F.when(need & ~F.col("passed"), F.col("scope"))))
    return reported.agg((F.coalesce(F.every(F.when(need, F.col("passed"))), F.lit(False)) & (F.count_if(need) == len(BASE) + 1)).alias("passed"), failed.alias("failed"), F.lit(FLOOR).alias("floor"), F.lit(TARGET).alias("target"))


def disagreements(rows: DataFrame) -> DataFrame:
    """Samples whose scores fall into different thirds."""
    return rows.where(ordinal_bin(F.col("judge_score")) != ordinal_bin(F.col("human_score")))


def worksheet(sample: DataFrame, judgments: DataFrame) -> DataFrame:
    """(question_id, strategy, text): what a reviewer reads of an answer, without any judge's score."""
    asked = judgments.select("question_id", F.col("text").alias("q"), "reference_answer")
    quote = lambda c: F.concat(F.lit("> "), F.replace(F.trim(c), F.lit("\n"), F.lit("\n> ")))
    shown = F.transform("judge_contexts", lambda c, i: F.concat(F.lit("#### Context "), (i + 1).cast("string"), F.lit("\n\n"), quote(c)))
    head = F.concat(F.lit("## `"), F.concat_ws("-", F.col("question_id").cast("string"), "strategy"), F.lit("`"), F.when(F.col("unanswerable"), " (unanswerable)").otherwise(""))
    parts = F.concat(
        F.array(head, F.lit("### Question"), F.trim("q")), F.when(F.col("reference_answer") != "", F.array(F.lit("### Reference answer"), F.trim("reference_answer"))).otherwise(F.array()),
        F.array(F.lit("### Contexts")), shown, F.array(F.lit("### Answer"), F.trim(F.coalesce("answer_text", F.lit(""))), F.lit("### Scores"), F.array_join(F.transform(dimensions(), lambda d: F.concat(F.lit("| "), d, F.lit(" | |"))), "\n")),
    )
    return sample.join(asked, "question_id").select("question_id", "strategy", F.array_join(parts, "\n\n").alias("text"))
