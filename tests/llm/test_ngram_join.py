import random
import re

import numpy as np
import pytest

from skeinrank.llm import ngram_join as nj
from skeinrank.llm.ngram_join import Schemes, forest, ngram_join, signatures

from .helpers import SF, crowded, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_of(text, width=4):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def brute(docs, width=4, p=85, q=100):
    sets = [(i, set_of(t, width)) for i, t in docs]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(k)
    for k, (_, s) in enumerate(sets):
        common = {}
        for t in s:
            for j in holders[t]:
                if j < k:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if q * n >= p * len(s | sets[j][1]):
                a, b = find(k), find(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets))


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1])] = [f"e{rng.randrange(10**6)}"]
    return " ".join(w)


def copies(seed=1):
    rng = random.Random(seed)
    docs, passage = [], [f"p{i}" for i in range(30)]
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([4, 6, 9, 14, 25, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            docs.append(edited(rng, base, rng.randrange(0, 1 + len(base) // 12)))
        docs.append(" ".join(passage + base[:40]))
        docs.append(" ".join(base[:40] + passage))
    return list(enumerate(docs))


@pytest.mark.parametrize("p,q", [(85, 100), (4, 5), (1, 2)])
def test_similar_sets_share_a_signature(p, q):
    rng = np.random.default_rng(0)
    schemes = Schemes(p, q)
    for n in [5, 6, 7, 12, 13, 30, 100, 400]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, schemes.most(n, n) + 2)
            b = np.unique(np.concatenate([a[drop // 2 :], rng.integers(0, 2**63, drop - drop // 2).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if schemes.similar(common, len(a), len(b)) and common < max(len(a), len(b)):
                assert np.intersect1d(signatures(a, schemes)[0], signatures(b, schemes)[0]).size
                assert len(forest([a, b], None, schemes)) == len(forest([a], [b], schemes)) == 1


@pytest.mark.parametrize("hot", [2, 64])
def test_copies(spark, hot, monkeypatch):
    monkeypatch.setattr(nj, "TILE_SETS", 8)
    docs = copies()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in ngram_join(df, hot=hot).collect()) == brute(docs)


def test_five_words(spark):
    docs = copies(7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join(df, 5, 4, 5, hot=4).collect()) == brute(docs, 5, 4, 5)


def test_odd_rows_and_empty(spark):
    df = crowded(frame(spark), "cls", "n", "info", "id")
    assert sorted(tuple(r) for r in ngram_join(df).collect()) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert ngram_join(frame(spark, [])).count() == 0


def test_loose_sets_meet_in_tiles(spark, monkeypatch):
    """A large group of which many sets don't link to the hub."""
    monkeypatch.setattr(nj, "TILE_SETS", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, edited(rng, base, rng.randrange(0, 5))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for hot in (2, 16):
        assert sorted(tuple(r) for r in ngram_join(df, hot=hot).collect()) == brute(docs)


def test_sets_beyond_the_fields_of_small_ones(spark):
    """Over 100,000 shingles, where spare segments are more than their field holds; a passage is shared by many."""
    rng = random.Random(4)
    long = [f"v{i}" for i in range(110_000)]
    docs = [(i, edited(rng, long, n)) for i, n in enumerate((0, 10, 2000, 4700))]
    docs += [(10 + i, " ".join(long[:40] + [f"o{i}x{k}" for k in range(20)])) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in ngram_join(df, hot=4).collect()) == brute(docs)


def test_size_codes_never_part_similar_sets():
    for p, q in ((85, 100), (4, 5), (1, 2)):
        schemes = Schemes(p, q)
        a = np.unique(np.geomspace(1, 1e9, 4000).astype(np.int64))
        b = a * q // p
        assert schemes.may(nj.size_code(a), nj.size_code(b)).all() and nj.size_code(10**12) < 1 << 12


def test_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(80)]
    docs = [(1, " ".join(base)), (None, " ".join(base[:78])), (2, " ".join(base[2:78])), (1, "something else altogether, quite short"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join(df, classes_too=True).collect()}
    assert got == {(1, 77): 1, (None, 75): 1, (2, 73): 1, (1, 2): 1, (None, 0): None}


def test_query(spark):
    from skeinrank.llm.queries import op3_ngram_join

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op3_ngram_join(spark, SF).collect()) == brute(docs)


def test_components_in_rounds_and_at_once(spark):
    from skeinrank.llm.shared import components

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(900, 900 + i) for i in range(1, 50)]
    up = {}
    for a, b in edges:
        group = up.setdefault(a, {a}) | up.setdefault(b, {b})
        for x in group:
            up[x] = group
    want = {x: min(g) for x, g in up.items() if len(g) > 1}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for last in (0, 1 << 20):
        assert {r.node: r.component for r in components(df, last_edges=last).collect()} == want


def test_a_task_ends_a_long_chain(spark):
    from skeinrank.llm.shared import components

    got = components(spark.range(700_000).selectExpr("id a", "id + 1 b"))
    assert sorted(got.agg({"component": "max", "node": "count"}).first()) == [0, 700_001]
