import hashlib

import pytest
from pyspark.sql import functions as F

from skeinrank.operators import calibration as cal

SCHEMA = (
    "question_id string, strategy string, query_class string, unanswerable boolean, generation_status string, judge_status string, answer_text string, answer_citations array<string>,"
    " judge_contexts array<string>, metrics map<string,double>"
)
JUDGED = "question_id string, text string, query_class string, reference_answer string, n_refs int"


def rows_of(n=90):
    out, asked = [], []
    for i in range(n):
        kind = ["direct", "multi_hop", "numeric_tabular", None][i % 4]
        m = {"faithfulness": (i % 3) / 2, "answer_relevancy": 1.0, "abstention_appropriate": float(i % 2)}
        text = ["Não vale [N::art-1].", "Vale, salvo engano [x].", "São 5% [N::art-1].", "Talvez"][(i // 4) % 4]
        out.append((f"q{i}", ["dense", "sparse_bm25", "sac"][i % 3], kind, i % 10 == 0, "succeeded", "succeeded", text, [], ["ctx"], m))
        asked.append((f"q{i}", "Qual?", kind, None, 1))
    return out, asked


def loop(tagged, size):
    """The selection as a plain loop over all rows."""
    key = {(q, s): hashlib.sha256(f"{cal.SEED}\0{q}\0{s}".encode()).hexdigest() for q, s, *_ in tagged}
    left = sorted(tagged, key=lambda r: key[r[0], r[1]])
    every = set().union(*(r[3] for r in tagged))
    need = {f for f in every if f.split(":")[0] in ("stratum", "class", "answerability", "strategy")} | set(cal.CONCEPTS)
    out = []
    while need:
        best = max(left, key=lambda r: (len(r[3] & need), [-ord(c) for c in key[r[0], r[1]]]))
        out.append(best[:2])
        left.remove(best)
        need -= best[3]
    strata = {}
    for r in left:
        strata.setdefault(tuple(r[2].split(":")), []).append(r[:2])
    while len(out) < size:
        for s in sorted(strata):
            if strata[s] and len(out) < size:
                out.append(strata[s].pop())
    return out


def test_selection_is_that_of_a_loop(spark):
    rows, asked = rows_of()
    r, j = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, JUDGED)
    tagged = cal.features(r.where(cal.usable()), j)
    plain = [(x.question_id, x.strategy, x.stratum, set(x.features)) for x in tagged.collect()]
    for size in (30, 41, 60):
        assert cal.select(tagged, size) == loop(plain, size)
    assert {"language:negation", "language:exception", "citation:unsupported", "claim:numerical", "reasoning:cross_reference"} <= {x.feature for x in cal.coverage(tagged).collect()}


def test_selection_says_what_is_wrong(spark):
    rows, asked = rows_of()
    r, j = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, JUDGED)
    tagged = cal.features(r, j)
    with pytest.raises(ValueError, match="at least 30"):
        cal.select(tagged, 29)
    with pytest.raises(ValueError, match="only 90"):
        cal.select(tagged, 91)
    with pytest.raises(ValueError, match="language:negation"):
        cal.select(tagged.where(~F.array_contains("features", "language:negation")), 30)
    with pytest.raises(Exception, match="no judgment"):
        cal.features(r, j.limit(3)).collect()


def test_usable(spark):
    good = ("q", "s", None, False, "succeeded", "succeeded", "text", [], ["c"], {"faithfulness": 0.0, "answer_relevancy": 1.0})
    change = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(SCHEMA.split(", "), good))
    bad = [change(generation_status="failed"), change(judge_status=None), change(answer_text=""), change(answer_text=None), change(judge_contexts=[]), change(judge_contexts=None), change(unanswerable=True)]
    bad += [change(metrics=m) for m in ({"faithfulness": 0.5}, {"faithfulness": float("nan"), "answer_relevancy": 1.0}, {"faithfulness": 1.1, "answer_relevancy": 1.0}, None)]
    assert [r.x for r in spark.createDataFrame([good, *bad], SCHEMA).select(cal.usable().alias("x")).collect()] == [True] + [False] * len(bad)


def test_labels_report_and_gate(spark):
    rows, _ = rows_of(40)
    r = spark.createDataFrame(rows, SCHEMA)
    labels, sealed = cal.empty_labels(r), cal.sealed_scores(r)
    assert labels.count() == sealed.count() == 84
    assert {x.fault for x in cal.sample_faults(labels, sealed).collect()} == {"no score"}
    full = labels.join(sealed, "sample_id").select("sample_id", "dimension", F.col("judge_score").alias("human_score"))
    assert cal.sample_faults(full, sealed).count() == 0
    faults = {x.fault for x in cal.sample_faults(full.where("sample_id not like 'q1-%-faithfulness'").limit(50).union(full.limit(1)), sealed).collect()}
    assert {"duplicate", "missing left"} <= faults
    report = cal.report(cal.samples(full, sealed))
    assert {x.scope: x.weighted_kappa for x in report.collect()} == {"overall": 1.0, "faithfulness": 1.0, "answer_relevancy": 1.0, "abstention": 1.0}
    assert {x.scope: x.spearman for x in report.collect()}["answer_relevancy"] is None
    assert cal.gate(report).first().passed and not cal.gate(report.where("scope = 'overall'")).first().passed
    worse = cal.report(full.join(sealed, "sample_id").withColumn("human_score", F.when(F.col("dimension") == "faithfulness", 1 - F.col("human_score")).otherwise(F.col("human_score"))))
    assert cal.gate(worse).first().failed == ["faithfulness"] or "faithfulness" in cal.gate(worse).first().failed
    assert cal.merge_labels(labels, full).where("human_score is null").count() == 0 and cal.merge_labels(labels, full.limit(0)).count() == 84
    with pytest.raises(Exception, match="another sample"):
        cal.merge_labels(labels, full.limit(3)).collect()
    with pytest.raises(ValueError):
        cal.samples(labels, sealed)
