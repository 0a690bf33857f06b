import numpy as np

from skeinrank.llm import toxicity
from skeinrank.llm.queries import BAD, GRADE, op10_toxicity
from skeinrank.llm.toxicity import CumulativeLink, fit, fit_ordinal, severity

from .helpers import SF, crowded, frame


def test_recovers_an_ordinal_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 3))
    w, t = np.array([1.5, -1.0, 0.0]), np.array([-0.5, 1.0])
    z = x @ w + rng.logistic(size=6000)
    grade = (z > t[0]).astype(int) + (z > t[1])
    got_w, got_t = fit_ordinal(x, grade, 3)
    assert np.allclose(got_w, w, atol=0.15) and np.allclose(got_t, t, atol=0.15)
    model = CumulativeLink(np.zeros(3, np.uint64), got_w, got_t)
    assert abs(model.severity(x).mean() - grade.mean()) < 0.02


def test_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels.where("doc_id % 2 = 0"), GRADE, bad_from=BAD)
    rows = severity(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    said = [(r.severity >= model.reject, r.toxic == 1) for r in rows]
    assert sum(a and not b for a, b in said) <= 0.005 * len(said)
    assert sum(a and b for a, b in said) >= 0.8 * sum(b for _, b in said)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]


def test_query_by_its_labels(spark):
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in op10_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    said = [(rows[i].rejected, t == 1) for i, t in labels.items() if i in rows]
    assert sum(a and not b for a, b in said) <= 0.01 * len(said)
    assert sum(a and b for a, b in said) >= 0.6 * sum(b for _, b in said)
    assert len(rows) == 1000


def test_odd_rows_and_empty(spark):
    df = crowded(frame(spark), "id", "grade", "severity", "x")
    labels = spark.createDataFrame([(0, 1, 1), (3, None, 1), (3, 0, None), (11, 1, 0), (11, 0, 1), (999, 1, 1)], "doc_id long, toxic int, quality int")
    model = fit(df, labels, GRADE, bad_from=BAD)
    got = severity(df, model).collect()
    assert len(got) == 13 and all(0 <= r.severity <= 2 for r in got)
    assert severity(frame(spark, []), model).count() == 0
    none = fit(df, labels.limit(0), "toxic")
    assert not any(r.severity >= none.reject for r in severity(df, none).collect())


def test_held_out_in_every_language(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels.where("doc_id % 2 = 0"), GRADE, bad_from=BAD)
    rows = severity(docs, model, keep=("doc_id", "lang")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        bad = [r.severity >= model.reject for r in rows if r.lang == lang and r.toxic == 1]
        assert sum(bad) >= 0.8 * len(bad), (lang, sum(bad), len(bad))
    said = [r.toxic for r in rows if r.severity >= model.reject]
    assert sum(said) >= 0.9 * len(said)


def test_cut_keeps_its_precision():
    bad = np.array([True] * 32 + [False] + [True] + [False] * 9)
    at = np.linspace(1, 0, 43)
    assert at[34] < toxicity._cut(at, bad) < at[33]
    assert toxicity._cut(np.zeros(43), bad & (at > 0.5)) == float("inf")
