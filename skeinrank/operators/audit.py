"""Claims and their citations: deterministic checks, support, rates, and the outcome of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json, json_string

CHECKS = ["well_formed", "exists", "in_document", "retrieved", "hash_matches"]


def citation_checks(cited: DataFrame, corpus: DataFrame, retrieved: DataFrame, versions: DataFrame) -> DataFrame:
    """cited(question_id, claim, ref_id, norm, well_formed), corpus(ref_id), retrieved(question_id, ref_id, rank, text_hash), versions(norm, hash)."""
    first = retrieved.groupBy("question_id", "ref_id").agg(F.min_by("text_hash", "rank").alias("text_hash"))
    out = cited.join(corpus.select("ref_id").distinct().withColumn("exists", F.lit(True)), "ref_id", "left")
    out = out.join(versions, "norm", "left").join(first, ["question_id", "ref_id"], "left")
    checks = {"well_formed": F.col("well_formed"), "exists": F.col("exists"), "in_document": F.col("hash").isNotNull(), "retrieved": F.col("text_hash").isNotNull(), "hash_matches": F.col("text_hash") == F.col("hash")}
    return out.select("question_id", "claim", "ref_id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()))


def claim_support(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """claims(question_id, claim, material, verdict): supported if it cites, all its checks pass and the verifier says so; others are never verified."""
    all_pass = F.lit(True)
    for c in CHECKS:
        all_pass = all_pass & F.col(c)
    per = checks.groupBy("question_id", "claim").agg(F.every(all_pass).alias("valid"))
    out = claims.join(per, ["question_id", "claim"], "left")
    return out.withColumn("supported", F.coalesce(F.col("valid") & (F.col("verdict") == "supported"), F.lit(False)))


def outcomes(supported: DataFrame) -> DataFrame:
    """Per answer: accepted when every material claim is supported (also when there is none), with a caveat when any is, else abstain."""
    material = F.col("material")
    return supported.groupBy("question_id").agg(
        F.when(F.coalesce(F.every(F.col("supported") | ~material), F.lit(True)), "accepted").when(F.some(F.col("supported") & material), "accepted_with_caveat").otherwise("abstain").alias("outcome"),
        F.count("*").alias("claims"),
    )


def final_outcomes(first: DataFrame, second: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """After at most one rewrite. first and second have (question_id, claim, material, supported) of an answer and of its
    rewriting; failed(question_id): a model's call failed, which ends the audit. A first audit that isn't accepted
    calls for a rewrite; what the second one says holds, without another."""
    one = outcomes(first).select("question_id", F.col("outcome").alias("before"))
    two = outcomes(second).select("question_id", F.col("outcome").alias("after"))
    both = one.join(two, "question_id", "left")
    both = both.join(failed.select("question_id").distinct().withColumn("__failed", F.lit(True)), "question_id", "left") if failed is not None else both.withColumn("__failed", F.lit(None).cast("boolean"))
    rewritten = F.col("__failed").isNull() & (F.col("before") != "accepted")
    # a rewriting without any claim has no material one that could be unsupported
    outcome = F.when(F.col("__failed"), "audit_failed").when(F.col("before") == "accepted", "accepted").otherwise(F.coalesce("after", F.lit("accepted")))
    return both.select("question_id", outcome.alias("outcome"), rewritten.alias("rewritten"))


def valid_sources(checks: DataFrame, texts: DataFrame) -> DataFrame:
    """(question_id, sources): the cited texts of which all checks pass, each once, as first cited. texts(question_id, ref_id, text)."""
    good = F.lit(True)
    for c in CHECKS:
        good = good & F.col(c)
    rows = checks.where(good).join(texts, ["question_id", "ref_id"])
    first = rows.groupBy("question_id", "text").agg(F.min(F.struct("claim", "ref_id")).alias("at"))
    return first.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("sources"))


def claim_status(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """One word a claim, the first that applies: a malformed citation, one that can't be verified, never verified, else the verdict."""
    per = checks.groupBy("question_id", "claim").agg(F.some(~F.col("well_formed")).alias("bad"), F.some(~(F.col("exists") & F.col("retrieved"))).alias("unseen"))
    status = F.when(F.col("bad"), "malformed_citation").when(F.col("unseen"), "citation_not_verifiable").when(F.col("verdict").isNull(), "not_semantically_verified").otherwise(F.col("verdict"))
    return claims.join(per, ["question_id", "claim"], "left").select("question_id", "claim", status.alias("status"))


def audit_lineage(audits: DataFrame, statuses: DataFrame) -> DataFrame:
    """audits(question_id, outcome, rewritten, original_answer, final_answer), claim statuses: hashes of the answers and a summary of the claims."""
    told = statuses.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim", "status"))), lambda x: F.concat_ws(":", x["claim"].cast("string"), x["status"])).alias("claims"))
    digest = lambda c: F.sha2(json_string(F.col(c)), 256)
    return audits.join(told, "question_id", "left").select("question_id", "outcome", F.col("rewritten").cast("int").alias("rewrite_count"), digest("original_answer").alias("original_answer_hash"), digest("final_answer").alias("final_answer_hash"), F.coalesce("claims", F.array().cast("array<string>")).alias("claims"))


def judge_lineage(results: DataFrame) -> DataFrame:
    """results(question_id, faithfulness, answer_relevancy, abstention_appropriate (JSON numbers as text), rationale): the digest of what the judge gave."""
    body = canonical_json(faithfulness=("number", F.col("faithfulness")), answer_relevancy=("number", F.col("answer_relevancy")), abstention_appropriate=("number", F.col("abstention_appropriate")), abstention_rationale=("string", F.col("rationale")))
    return results.select("question_id", F.sha2(body, 256).alias("raw_output_hash"))


RATES = ["malformed_citation_rate", "nonexistent_citation_rate", "citation_not_in_context_rate", "uncited_material_claim_rate", "unsupported_claim_rate", "rewrite_rate", "rewrite_success_rate", "abstention_rate"]


def rates(audits: DataFrame, claims: DataFrame, checks: DataFrame) -> DataFrame:
    """One row of shares, each 0 where nothing is counted. audits(outcome, rewritten), claims(material, cites, verdict: null
    where a claim wasn't verified), checks as of `citation_checks`. Each citation rate looks only at citations that the one before let pass."""

    def share(part, whole, name):
        return F.round(F.coalesce(F.try_divide(F.count_if(part & whole), F.count_if(whole)), F.lit(0.0)), 6).alias(name)

    true = F.lit(True)
    formed, exists = F.col("well_formed"), F.col("exists")
    material, verified = F.col("material"), F.col("material") & F.col("verdict").isNotNull()
    c = checks.agg(share(~formed, true, RATES[0]), share(~exists, formed, RATES[1]), share(~F.col("retrieved"), formed & exists, RATES[2]))
    m = claims.agg(share(~F.col("cites"), material, RATES[3]), share(F.coalesce(F.col("verdict") != "supported", F.lit(False)), verified, RATES[4]))
    a = audits.agg(share(F.col("rewritten"), true, RATES[5]), share(F.col("outcome").isin("accepted", "accepted_with_caveat"), F.col("rewritten"), RATES[6]), share(F.col("outcome") == "abstain", true, RATES[7]), F.count("*").alias("n"))
    return c.crossJoin(m).crossJoin(a)  # one row each
