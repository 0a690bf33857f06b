"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of labelled texts in every task, adds the counts up by language
and bucket, and brings a matrix of (languages x buckets) to the driver. Its size is bounded: the
more languages, the fewer buckets (with over 16,384 labels it grows by 8 KB for each). The log-probability matrix is
broadcast; scoring counts each text's buckets sparsely and multiplies in numpy.

The fit may use a bounded sample: `max_rows` labelled rows, about, taken by a hash of the
id (all when there are fewer), and `LEAST` of each language that has them. Every text is scored whole.

Edge cases: a null text, or one without letters, is `und` with score 0; with no labelled
row every text is `und`; labels that are null are left out of training; ties go to the
language first by name; repeated rows score alike; texts of any length are counted a part at a
time; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import let_go, mix64, sliced

#: Buckets, n-gram lengths, and labelled rows to fit on (about).
BUCKETS, ORDERS, MAX_ROWS = 1 << 15, (1, 2, 3), 20_000
#: Rows of a language that are drawn at least, about, if it has them.
LEAST = 200
#: Cells of the matrix that is broadcast (128 MB): with more than 512 languages there are fewer buckets, but these at least.
CELLS, FEWEST = 1 << 24, 1 << 10
#: Additive smoothing.
ALPHA = 0.5
#: Characters counted at a time.
PART = 1 << 20


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of the lower-cased text's n-grams, repeats included."""
    out, most = [], max(ORDERS)
    for lo in range(0, len(text), PART):
        c = np.frombuffer(text[lo : lo + PART + most - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        rolled = np.zeros(len(c), np.uint64)
        for n in range(1, most + 1):
            if len(c) < n:
                break
            rolled = rolled[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                # the overlap with the next part counts there, but for what begins here
                begin = rolled[:PART] if lo + PART < len(text) else rolled
                out.append((mix64(begin) & np.uint64(buckets - 1)).astype(np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def bucket_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's n-grams stand in the lower-cased text."""
    return np.bincount(grams(text, buckets), minlength=buckets)


class NaiveBayes:
    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        """counts: languages x buckets; documents: rows of each language."""
        self.languages = languages
        smooth = counts + ALPHA
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).T if languages else np.zeros((counts.shape[1], 0))
        self.prior = np.log(documents / documents.sum()) if languages else np.zeros(0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text: the batch's counts are a sparse matrix, multiplied once."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        own = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        rows, buckets, times = sparse_counts([texts[i] for i in own], self.log.shape[0])
        begin = np.flatnonzero(np.diff(rows, prepend=-1))
        scores = np.add.reduceat(times[:, None] * self.log[buckets], begin) + self.prior if len(begin) else []
        for i, score in zip(own, scores):  # a text with a letter has one n-gram at least
            best = int(score.argmax())
            out[i] = self.languages[best], float(1 / np.exp(score - score[best]).sum())
        return out


def sparse_counts(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, times) of what isn't zero, by row."""
    rows, at, times = [], [], []
    for i, text in enumerate(texts):
        sorted_ = np.sort(grams(text, buckets))
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
        rows.append(np.full(len(first), i))
        at.append(sorted_[first])
        times.append(np.diff(np.append(first, len(sorted_))))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(rows), join(at), join(times)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS, buckets: int = BUCKETS) -> NaiveBayes:
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("string").alias("id")).where("lang is not null and text is not null")
    documents = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    buckets = min(buckets, max(FEWEST, 1 << (CELLS // max(1, len(documents))).bit_length() - 1))
    total = sum(documents.values())
    if total > max_rows:  # a language of few rows keeps `LEAST` of them
        share = [(k, int(min(1.0, max(max_rows / total, LEAST / n)) * (1 << 30))) for k, n in documents.items()]
        share = labelled.sparkSession.createDataFrame(share, "lang string, share long")
        rows = rows.join(F.broadcast(share), "lang").where(  # a row for each of the matrix that is broadcast later
            F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share")
        )
    names = sorted(documents)

    def count(batches):
        own: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "text"):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                own.setdefault(lang, np.zeros(buckets, np.int64))
                own[lang] += bucket_counts(text.as_py(), buckets)
        for lang, c in own.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    got = rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), buckets), np.int64)
    place = {n: i for i, n in enumerate(names)}
    counts[[place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return NaiveBayes(names, counts, np.array([documents[n] for n in names], float))


def predict(docs: DataFrame, model: NaiveBayes, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """`keep` (columns by name), lang_pred and score (the posterior of the language predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*(c.alias(n) for n, c in (keep or {}).items()), F.col(f"`{text_col}`").alias("__text"))
    carried = source.schema.fields[:-1]

    def run(batches):
        let_go()
        for batch in sliced(batches, "__text"):
            got = shared.value.predict(batch["__text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in carried), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], [*(f.name for f in carried), "lang_pred", "score"])

    return source.mapInArrow(run, T.StructType([*carried, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
