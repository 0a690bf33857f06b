"""From questions to audited answers, all questions at once: hits, a generated answer, its claims, their citations' checks, a
verifier's verdicts, at most one rewriting, and what became of it. Every call of a model goes through `requests`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..ports import AnswerGenerator, AnswerRewriter, QualityJudge, SupportVerifier
from ..sources.readers import stored
from ..sources.tables import Table
from . import audit
from .requests import ask

# A verifier's verdicts, and the text of an answer that abstains.
VERDICTS = ["supported", "partially_supported", "unsupported", "contradicted"]
ABSTENTION = "Não há evidência suficiente nas fontes recuperadas."
SCORES = ["faithfulness", "answer_relevancy", "abstention_appropriate"]

CONTEXT = "array<struct<rank int, ref_id string, text string>>"


def contexts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, context): a question's k hits with their texts in rank order. chunks(chunk_id, ref_id, text)."""
    rows = hits.select("question_id", "rank", "chunk_id").join(chunks, "chunk_id")
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "ref_id", "text"))).alias("context"))


def generate(questions: DataFrame, context: DataFrame, generator: AnswerGenerator, identity: str, table: Table | None = None) -> DataFrame:
    """(question_id, text, context, answer, fault) of questions(question_id, text): a question without hits is answered from nothing."""
    asked = questions.select("question_id", "text").join(context, "question_id", "left").withColumn("context", F.coalesce("context", F.array().cast(CONTEXT)))
    said = ask(asked, ["text", "context"], lambda r: generator.answer(r["text"], [([c["ref_id"]], c["text"]) for c in r["context"]]), identity, "string", table)
    return said.withColumnRenamed("response", "answer")


def claims_of(answers: DataFrame) -> DataFrame:
    """(question_id, claim, statement, material, cites, refs) of answers(question_id, answer): sentences with what they cite."""
    each = answers.select("question_id", F.posexplode(tx.claims(tx.strip(F.col("answer")))).alias("claim", "statement"))
    refs = tx.citation_candidates(F.col("statement"))
    return each.select("question_id", "claim", "statement", (~tx.abstains(F.col("statement"))).alias("material"), (F.size(refs) > 0).alias("cites"), refs.alias("refs"))


def audited(answers: DataFrame, shown: DataFrame, corpus: DataFrame, versions: DataFrame, verifier: SupportVerifier, table: Table | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims with valid, verdict, fault and supported; checks) of answers(question_id, text, answer).

    shown(question_id, rank, ref_id, text), corpus(ref_id), versions(norm, hash). Only claims that cite, and whose citations all pass,
    go to the verifier, with the first text shown for each citation.
    """
    claims = stored(claims_of(answers), "claims")
    cited = claims.select("question_id", "claim", F.explode("refs").alias("ref_id"))
    parts = tx.ref_parts(F.col("ref_id"))
    cited = cited.withColumn("norm", parts["norm"]).withColumn("well_formed", parts.isNotNull())
    checks = stored(audit.citation_checks(cited, corpus, shown.withColumn("text_hash", F.sha2("text", 256)), versions), "checks")
    good = F.lit(True)
    for c in audit.CHECKS:
        good = good & F.col(c)
    valid = checks.groupBy("question_id", "claim").agg(F.every(good).alias("valid")).where("valid").select("question_id", "claim")
    first = shown.groupBy("question_id", "ref_id").agg(F.min_by("text", "rank").alias("text"))
    place = cited.join(valid, ["question_id", "claim"], "left_semi").join(first, ["question_id", "ref_id"])
    sources = place.groupBy("question_id", "claim").agg(F.array_sort(F.collect_list(F.struct("ref_id", "text"))).alias("cited"))
    to_verify = claims.join(sources, ["question_id", "claim"]).join(answers.select("question_id", F.col("text").alias("question")), "question_id").select("question_id", "claim", "statement", "question", "cited")
    said = ask(
        to_verify, ["question", "statement", "cited"], lambda r: verifier.verify(r["question"], r["statement"], [(c["ref_id"], c["text"]) for c in r["cited"]]), verifier.identity, "string", table,
        lambda v: None if v in VERDICTS else f"no verdict: {v!r}",
    )
    said = said.select("question_id", "claim", F.col("response").alias("verdict"), "fault")
    out = audit.claim_support(claims.join(said, ["question_id", "claim"], "left"), checks)
    return stored(out.drop("refs"), "audited"), checks


def audit_path(answers: DataFrame, shown: DataFrame, corpus: DataFrame, versions: DataFrame, verifier: SupportVerifier, rewriter: AnswerRewriter, table: Callable[[str], Table] | None = None) -> dict[str, DataFrame]:
    """The two passes over answers(question_id, text, answer): `outcomes` (question_id, outcome, rewritten, original_answer, final_answer),
    `first` and `second` (claims), `checks` and `second_checks`. A failed call of either model ends an answer's audit."""
    of = table or (lambda name: None)
    first, checks = audited(answers, shown, corpus, versions, verifier, of("verdicts"))
    judged = audit.outcomes(first).select("question_id", F.col("outcome").alias("before"))
    broken = first.where("fault IS NOT NULL").select("question_id").distinct().withColumn("__broken", F.lit(True))
    # an answer without any claim has none that isn't supported
    state = answers.join(judged, "question_id", "left").join(broken, "question_id", "left").withColumn("before", F.coalesce("before", F.lit("accepted")))
    again = state.where("__broken IS NULL AND before <> 'accepted'")
    usable = audit.valid_sources(checks, shown.groupBy("question_id", "ref_id").agg(F.min_by("text", "rank").alias("text")))
    again = again.join(usable, "question_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    rewritten = ask(again.select("question_id", "text", "answer", "sources"), ["text", "answer", "sources"], lambda r: rewriter.rewrite(r["text"], r["answer"], r["sources"]), rewriter.identity, "string", of("rewritings"))
    rewritten = stored(rewritten.select("question_id", "text", F.col("response").alias("answer"), F.col("fault").alias("rewrite_fault")), "rewritten")
    second, second_checks = audited(rewritten.where("rewrite_fault IS NULL").select("question_id", "text", "answer"), shown, corpus, versions, verifier, of("verdicts"))
    failed = broken.select("question_id").union(rewritten.where("rewrite_fault IS NOT NULL").select("question_id")).union(second.where("fault IS NOT NULL").select("question_id")).distinct().withColumn("__failed", F.lit(True))
    after = audit.outcomes(second).select("question_id", F.col("outcome").alias("after"))
    final = state.join(rewritten.select("question_id", F.col("answer").alias("new")), "question_id", "left").join(after, "question_id", "left").join(failed, "question_id", "left")
    took = F.col("__failed").isNull() & (F.col("before") != "accepted")
    outcome = F.when(F.col("__failed"), "audit_failed").when(F.col("before") == "accepted", "accepted").otherwise(F.coalesce("after", F.lit("accepted")))
    final = final.withColumn("outcome", outcome).withColumn("rewritten", took)
    text = F.when(~F.col("rewritten"), F.col("answer")).when(F.col("outcome") == "abstain", F.lit(ABSTENTION)).otherwise(F.col("new"))
    outcomes = final.select("question_id", "outcome", "rewritten", F.col("answer").alias("original_answer"), text.alias("final_answer"))
    return {"outcomes": stored(outcomes, "outcomes"), "first": first, "second": second, "checks": checks, "second_checks": second_checks}


def judge(answers: DataFrame, judge_: QualityJudge, identity: str, table: Table | None = None) -> DataFrame:
    """(question_id, faithfulness, answer_relevancy, abstention_appropriate, fault) of answers(question_id, text, context, answer): scores from
    0 to 1, or a fault."""

    def fault(scores):
        bad = [n for n in SCORES if not isinstance(scores.get(n), (int, float)) or isinstance(scores.get(n), bool) or not 0 <= scores[n] <= 1]
        return f"no score: {', '.join(bad)}" if bad else None

    said = ask(answers, ["text", "answer", "context"], lambda r: judge_.judge(r["text"], r["answer"], [c["text"] for c in r["context"]]), identity, "struct<" + ", ".join(f"{n}: double" for n in SCORES) + ">", table, fault)
    return said.select("question_id", *(F.col("response")[n].alias(n) for n in SCORES), "fault")
