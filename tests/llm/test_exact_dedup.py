import hashlib

import numpy as np
from pyspark.sql import functions as F

from skeinrank.llm.exact_dedup import build_filter, exact_dedup, folded, screen

from .helpers import SF, crowded, frame


def test_filter_has_no_false_negative():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        own = build_filter(keys)
        assert screen(own, keys).all()
        assert screen(own, rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.02


def order(row):
    return tuple((x is not None, x) for x in row)


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(folded(r.text), []).append(r.doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((r.doc_id, keep[folded(r.text)], len(groups[folded(r.text)]), r.doc_id == keep[folded(r.text)], hashlib.sha256(folded(r.text)).hexdigest()) for r in rows), key=order)


def result(df, side, **more):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in exact_dedup(df, side, **more).collect()), key=order)


def test_odd_rows_for_any_split(spark):
    df = crowded(frame(spark), "digest", "old", "id")
    for side in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0, F.lit(None).cast("boolean")):
        assert result(df, side) == brute(df.collect())


def test_repeated_and_null_ids_for_any_split(spark):
    rows = [(1, "a"), (4, "A"), (4, "zzz"), (2, "a"), (None, "a"), (None, "n"), (None, "N"), (3, "ZZZ"), (4, "zzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for side in (F.col("doc_id") < 3, F.col("doc_id") % 2 == 0, F.isnull("doc_id"), F.col("doc_id").isNotNull(), F.col("text") == "a", F.length("text") == 1, F.lit(True), F.lit(False)):
        assert result(df, side) == brute(df.collect())


def test_a_stored_snapshot_is_read_again(spark, tmp_path, monkeypatch):
    from skeinrank.llm import exact_dedup as ed

    path = str(tmp_path / "snapshot-1")
    df = frame(spark)
    old = F.col("doc_id") % 2 == 0
    assert result(df, old, snapshot_path=path) == brute(df.collect())
    monkeypatch.setattr(ed, "_filters", lambda *a: 1 / 0)
    more = df.union(spark.createDataFrame([(21, "Hello, World! mit license", None, None, None), (23, "new", None, None, None)], df.schema))
    assert result(more, old, snapshot_path=path) == brute(more.collect())


def test_empty(spark):
    assert exact_dedup(frame(spark, []), F.lit(True)).count() == 0


def test_query(spark):
    from skeinrank.llm.queries import op7_exact_dedup

    got = sorted((tuple(r) for r in op7_exact_dedup(spark, SF).collect()), key=order)
    assert got == brute(spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("Same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = result(df, F.col("doc_id") < 1500)
    assert got == brute(df.collect())
