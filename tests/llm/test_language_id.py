import math
import zlib
from collections import Counter

from skeinrank.llm import language_id
from skeinrank.llm.language_id import NaiveBayes, bucket_counts, fit, predict
from skeinrank.llm.queries import op1_language_id
from pyspark.sql import functions as F

from .helpers import SF, crowded, frame


def test_parts_count_as_the_whole(monkeypatch):
    text = "Größe und Länge, naïve œuvre 日本 " * 20
    whole = bucket_counts(text)
    assert whole.sum() == 3 * len(text) - 3
    monkeypatch.setattr(language_id, "PART", 37)
    assert (bucket_counts(text) == whole).all()


def test_held_out_accuracy(spark):
    rows = op1_language_id(spark, SF.replace("0.001", "0.01")).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in out) > 0.97 * len(out)


def plain_bayes(labelled, text):
    """Naive Bayes as it stands in a textbook, over the same buckets."""
    seen, docs = {}, Counter()
    for lang, t in labelled:
        docs[lang] += 1
        own = seen.setdefault(lang, Counter())
        for b, n in enumerate(bucket_counts(t).tolist()):
            own[b] += n
    score = {}
    counts = bucket_counts(text)
    for lang, own in seen.items():
        total = sum(own.values()) + language_id.ALPHA * language_id.BUCKETS
        score[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((own[b] + language_id.ALPHA) / total) for b, n in enumerate(counts.tolist()) if n)
    best = min(score, key=lambda k: (-score[k], k))
    return best, 1 / sum(math.exp(v - score[best]) for v in score.values())


def test_equals_plain_naive_bayes(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(df, fit(df.where("doc_id % 2 = 0")), keep={"doc_id": F.col("doc_id")}).collect()}
    for i, text, _ in rows[:12]:
        lang, score = plain_bayes([(lang, t) for j, t, lang in rows if j % 2 == 0], text)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9


def test_many_languages(spark):
    df = spark.range(700).selectExpr("id doc_id", "concat(decode(unhex(hex(19968 + id)), 'UTF-16BE'), decode(unhex(hex(19968 + 3 * id)), 'UTF-16BE'), decode(unhex(hex(19968 + id)), 'UTF-16BE')) text", "'l' || id lang")
    model = fit(df)
    assert len(model.languages) == 700 and model.log.shape == (1 << 14, 700)
    got = predict(df, model, keep={"lang": F.col("lang")}).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * 700


def test_odd_rows_and_empty(spark):
    df = crowded(frame(spark), "score", "id", "__lang")
    model = fit(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(df, model, keep={"doc_id": F.col("doc_id")}).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] in model.languages
    assert set(model.languages) == {"en", "de"}
    none = fit(frame(spark, []))
    assert {r.lang_pred for r in predict(df, none).collect()} == {"und"}
    assert predict(frame(spark, []), model).count() == 0


def test_sample_bound(spark):
    df = spark.range(2000).selectExpr("id doc_id", "'a' || id text", "if(id % 2 = 0, 'x', 'y') lang")
    model = fit(df, max_rows=200)
    assert isinstance(model, NaiveBayes) and model.languages == ["x", "y"]


def test_a_rare_language_is_drawn(spark):
    rows = [(i, f"the quick brown fox number {i} runs over the lazy dog", "en") for i in range(3000)] + [(5000 + i, "η γρήγορη καφέ αλεπού", "el") for i in range(2)] + [(None, "the end", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, max_rows=30)
    assert model.languages == ["el", "en"]
    flat = model.log[:, 0]
    assert flat.max() > flat.min()  # not the row of a language without texts
    assert model.predict(["η αλεπού", "the dog", None, "123", ""])[:1] == [("el", model.predict(["η αλεπού"])[0][1])]
    assert [x[0] for x in model.predict(["the dog", None, "123", ""])] == ["en", "und", "und", "und"]


def test_null_id_is_not_held_out(spark, tmp_path):
    rows = [(None, "ein kleiner Text", "de"), (1, "a small text", "en"), (4, "ein Text", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.held_out for r in op1_language_id(spark, str(tmp_path)).collect()} == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in (None, 1, 4)}
