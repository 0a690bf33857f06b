"""Vector code compression and hard-negative mining, against plain loops."""

import hashlib
import math
import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from skeinrank.llm import hard_negatives as hn
from skeinrank.llm.vector_codes import bounds_of, compress, nearest

from .helpers import SF, crowded

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def some(n, d=16, seed=3, labels=3, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, spread, d)], int(rng.integers(0, labels))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.5] * (d - 1) + [None], 1), (n + 2, [float("nan")] + [0.5] * (d - 1), 1), (n + 3, [float("inf")] * d, 0), (n + 4, [0.25] * d, None), (n + 5, [], 2), (n + 6, [1.0] * (d + 8), 2)]
    return rows + [(5, rows[5][1], rows[5][2]), (n + 7, rows[7][1], rows[7][2]), (n + 8, [0.0] * d, 0), (n + 9, [1e30] * d, 0)]


def whole(rows, scale, limit):
    kept = [(i, [max(-limit, min(limit, math.floor(x * scale))) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = len(min(kept, key=lambda r: (r[0] is None, r[0]))[1]) if kept else 0
    return [r for r in kept if len(r[1]) == d]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = whole(rows, 4096, 1 << 27)
    edges = bounds_of(len(kept[0][1]), parts)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    out = {}
    books = [[r[1][a:b] for r in first] for a, b in zip(edges, edges[1:])]

    def assign(p):
        a, b = edges[p], edges[p + 1]
        return [min((sum((x - y) ** 2 for x, y in zip(r[1][a:b], c)), e) for e, c in enumerate(books[p])) for r in kept]

    for p in range(parts):
        for _ in range(rounds):
            got = assign(p)
            for e in range(len(books[p])):
                own = [r[1][edges[p] : edges[p + 1]] for r, (_, at) in zip(kept, got) if at == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
        out[p] = assign(p)
    codes = [("".join(f"{out[p][i][1]:02x}" for p in range(parts)), sum(out[p][i][0] for p in range(parts))) for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((r[0], *c) for r, c in zip(kept, codes)), key=repr), digest


def test_nearest_is_exact_and_skips_entries():
    rng = np.random.default_rng(1)
    for d, size in ((8, 4096), (5, 3), (1, 10), (16, 1 << 27)):
        x, c = rng.integers(-size, size + 1, (3000, d)), rng.integers(-size, size + 1, (16, d))
        c[3], x[0] = c[7], c[7]  # a tie
        at, far, exact = nearest(x, c)
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (far == every.min(1)).all()
        assert at[0] == 3
        if d == 8:
            assert exact < 0.8 * every.size
    x = np.repeat(rng.integers(-4096, 4096, (10, 1)), 8, 1) + rng.integers(-50, 50, (10, 8))
    assert nearest(np.repeat(x, 50, 0), x)[2] <= 4 * 500  # clustered: one of each level and the nearest


def test_codes_against_loops(spark):
    from skeinrank.llm.vector_codes import books_digest

    for rows in (some(60), some(10, d=13), some(40, d=8, spread=0.01)):
        coded, books = compress(crowded(vectors(spark, rows), "v", "x", "code"), label_col="label")
        got = sorted(((r.vec_id, bytes(r.code).hex(), r.error) for r in coded.collect()), key=repr)
        want, digest = plain_codes(rows)
        assert got == want
        assert books_digest(books) == digest
    assert compress(vectors(spark, []))[0].count() == 0
    assert compress(vectors(spark, [(1, None, 2)]))[0].count() == 0


def oracle(name, sf=SF):
    from skeinrank.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{os.path.join(sf, 'embeddings.parquet')}')")
    return sorted(con.execute(ORACLE_SQL[name]).fetchall())


def test_queries_against_sql(spark):
    from skeinrank.llm.queries import op12_vector_codes, op13_hard_negatives

    assert sorted(tuple(r) for r in op12_vector_codes(spark, SF).collect()) == oracle("op12_vector_codes")
    assert sorted(tuple(r) for r in op13_hard_negatives(spark, SF).collect()) == oracle("op13_hard_negatives")


def plain_negatives(rows, anchor, positives=5, negatives=3):
    kept = [r for r in whole([r for r in rows if r[0] is not None and r[2] is not None], 256, 1 << 23)]
    out = []
    for a in kept:
        if not anchor(a[0]):
            continue
        score = lambda r: sum(x * y for x, y in zip(a[1], r[1]))
        best = sorted((-score(r), r[0]) for r in kept if r[2] == a[2] and r[0] != a[0])[:positives]
        for s, p in best:
            within = sorted((-score(r), r[0]) for r in kept if r[2] != a[2] and 50 * -s <= 100 * score(r) <= 95 * -s)[:negatives]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n) in enumerate(within)]
    return sorted(out)


def test_negatives_against_loops(spark, monkeypatch):
    for rows, block in ((some(120), 2048), (some(90, seed=9, labels=2) + [(None, [1.0] * 16, 1)], 3), (some(30, d=8, labels=1), 4)):
        df = crowded(vectors(spark, rows), "id", "v", "code", "left")
        got = sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 5 == 0, block=block).collect())
        assert got == plain_negatives(rows, lambda i: i % 5 == 0)
    monkeypatch.setattr(hn, "SCORES", 64)  # a few rows at a time
    rows = some(80, seed=4)
    assert sorted(tuple(r) for r in hn.hard_negatives(vectors(spark, rows), F.col("vec_id") % 9 == 0).collect()) == plain_negatives(rows, lambda i: i % 9 == 0)


def test_no_anchor_and_no_row(spark):
    assert hn.hard_negatives(vectors(spark, some(10)), F.lit(False)).count() == 0
    empty = hn.hard_negatives(vectors(spark, []), F.lit(True))
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-256, 256, (200, 16))
    edges = bounds_of(16, 4)
    books = [x[:9, a:b] for a, b in zip(edges, edges[1:])]
    found = [nearest(x[:, a:b], c) for (a, b), c in zip(zip(edges, edges[1:]), books)]
    code, left = np.stack([f[0] for f in found], 1), np.sqrt(np.stack([f[1] for f in found], 1))
    own = hn.Anchors(np.arange(20), np.zeros(20), x[:20], books, edges)
    low, high = own.bounds(np.arange(20), code, left)
    exact = x[:20] @ x.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 4 * np.abs(exact).mean() + 1e6
