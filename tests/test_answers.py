"""The request step and the path from questions to audited answers, against plain versions."""

import pytest
from pyspark.sql import functions as F

from skeinrank import ports
from skeinrank.operators import answers
from skeinrank.operators.requests import ask, response_table

LOG = "calls.txt"


def counting(folder, reply):
    """A model that notes its calls in a file, as it runs in other processes."""

    def call(row):
        with open(f"{folder}/{LOG}", "a") as f:
            f.write(row["q"] + "\n")
        return reply(row)

    return call


def calls(folder):
    try:
        with open(f"{folder}/{LOG}") as f:
            return sorted(f.read().split())
    except FileNotFoundError:
        return []


def test_each_request_is_made_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i int, q string").repartition(3).where("q IS NOT NULL")
    table = response_table(spark, str(tmp_path / "t"))
    said = ask(df, ["q"], counting(tmp_path, lambda r: r["q"].upper()), "m1", "string", table)
    assert sorted((r.i, r.response, r.fault) for r in said.collect()) == [(1, "A", None), (2, "A", None), (3, "B", None)]
    assert said.count() == 3 and calls(tmp_path) == ["a", "b"]
    # a second run makes no call; a new request and another model do
    more = df.union(spark.createDataFrame([(9, "c")], df.schema))
    assert sorted(r.response for r in ask(more, ["q"], counting(tmp_path, lambda r: r["q"].upper()), "m1", "string", table).collect()) == ["A", "A", "B", "C"]
    assert calls(tmp_path) == ["a", "b", "c"]
    ask(df, ["q"], counting(tmp_path, lambda r: "x"), "m2", "string", table)
    assert calls(tmp_path) == ["a", "a", "b", "b", "c"]
    assert table.read().count() == 5


def test_faults_are_tried_twice_and_not_kept(spark, tmp_path):
    df = spark.createDataFrame([("good",), ("bad",), ("raises",)], "q string")

    def reply(r):
        if r["q"] == "raises":
            raise OSError("gone")
        return {"score": 0.5 if r["q"] == "good" else 7.0}

    table = response_table(spark, str(tmp_path / "t"))
    check = lambda x: None if x["score"] <= 1 else "out of range"
    said = {r.q: (r.response, r.fault) for r in ask(df, ["q"], counting(tmp_path, reply), "m", "struct<score: double>", table, check).collect()}
    assert said["good"][0].score == 0.5 and said["bad"] == (None, "out of range") and said["raises"] == (None, "OSError: gone")
    assert calls(tmp_path) == ["bad", "bad", "good", "raises", "raises"] and table.read().count() == 1
    ask(df, ["q"], counting(tmp_path, reply), "m", "struct<score: double>", table, check)
    assert calls(tmp_path).count("good") == 1 and calls(tmp_path).count("bad") == 4


def test_null_fields_nested_fields_and_no_request(spark):
    df = spark.createDataFrame([(None, [("x", 1)]), ("q", None)], "q string, c array<struct<a string, b int>>")
    said = ask(df, ["q", "c"], lambda r: [r["q"] or "none", str(len(r["c"] or []))], "m", "array<string>")
    assert sorted(r.response for r in said.collect()) == [["none", "1"], ["q", "0"]]
    assert ask(df.where("false"), ["q"], lambda r: 1 / 0, "m", "string").count() == 0


class Scripted:
    """Says and denies what its lists hold."""

    identity = "scripted"

    def __init__(self, denied=(), broken=(), second=""):
        self.denied, self.broken, self.second = denied, broken, second

    def verify(self, question, claim, cited):
        if any(b in claim for b in self.broken):
            raise TimeoutError("no answer")
        return "unsupported" if any(d in claim for d in self.denied) else "supported"

    def rewrite(self, question, answer, sources):
        if self.second is None:
            raise TimeoutError("no answer")
        return self.second


def path(spark, answer, model, shown=(("n::1", "One."), ("n::2", "Two."))):
    said = spark.createDataFrame([(1, "q", answer)], "question_id int, text string, answer string")
    seen = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(shown, 1)], "question_id int, rank int, ref_id string, text string")
    corpus = spark.createDataFrame([("n::1",), ("n::2",)], "ref_id string")
    versions = spark.createDataFrame([("n", "One.")], "norm string, t string").select("norm", F.sha2("t", 256).alias("hash"))
    out = answers.audit_path(said, seen, corpus, versions, model, model)
    r = out["outcomes"].head()
    return r.outcome, r.rewritten, r.final_answer


def test_outcomes(spark):
    good, bad = "One holds [n::1].", "Two holds [n::2]."  # the second source has another version's hash
    assert path(spark, good, Scripted()) == ("accepted", False, good)
    assert path(spark, "Não consta.", Scripted()) == ("accepted", False, "Não consta.")
    assert path(spark, "", Scripted()) == ("accepted", False, "")
    assert path(spark, f"{good} {bad}", Scripted(second=good)) == ("accepted", True, good)
    assert path(spark, f"{good} {bad}", Scripted(second=f"{good} {bad}")) == ("accepted_with_caveat", True, f"{good} {bad}")
    assert path(spark, bad, Scripted(second=bad)) == ("abstain", True, answers.ABSTENTION)
    assert path(spark, "One without a source.", Scripted(second="Still none.")) == ("abstain", True, answers.ABSTENTION)
    assert path(spark, good, Scripted(broken=["One"])) == ("audit_failed", False, good)
    assert path(spark, bad, Scripted(second=None)) == ("audit_failed", False, bad)
    assert path(spark, good, Scripted(denied=["One"], second="Other words [n::1].")) == ("accepted", True, "Other words [n::1].")


def test_a_judge_out_of_range_is_a_fault(spark):
    class Judge:
        def judge(self, question, answer, contexts):
            return {"faithfulness": 1.0, "answer_relevancy": 1.5 if answer == "b" else 0.25, "abstention_appropriate": 0}

    df = spark.createDataFrame([(1, "q", "a", [(1, "r", "t")]), (2, "q", "b", [])], f"question_id int, text string, answer string, context {answers.CONTEXT}")
    got = {r.question_id: (r.answer_relevancy, r.fault) for r in answers.judge(df, Judge(), "j").collect()}
    assert got == {1: (0.25, None), 2: (None, "no score: answer_relevancy")}


def test_answers_of_questions(spark):
    q = spark.createDataFrame([(1, "Where is it?"), (2, "nobody knows")], "question_id int, text string")
    hits = spark.createDataFrame([(1, 2, 20), (1, 1, 10)], "question_id int, rank int, chunk_id int")
    chunks = spark.createDataFrame([(10, "n::1", " It [here] is. More."), (20, "n::2", "  ")], "chunk_id int, ref_id string, text string")
    model = ports.Extractive(2)
    said = {r.question_id: r.answer for r in answers.generate(q, answers.contexts(hits, chunks), model, model.identity).collect()}
    assert said == {1: "Segundo a fonte, where is It (here) is [n::1].", 2: answers.ABSTENTION}


@pytest.mark.parametrize("text", ["A [n::1]. B [x]. \"C\" não consta."])
def test_claims(spark, text):
    got = answers.claims_of(spark.createDataFrame([(1, text)], "question_id int, answer string")).orderBy("claim").collect()
    assert [(r.statement, r.material, r.cites, r.refs) for r in got] == [("A [n::1].", True, True, ["n::1"]), ("B [x].", True, True, ["x"]), ('"C" não consta.', False, False, [])]
