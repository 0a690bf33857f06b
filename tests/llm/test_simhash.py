import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skeinrank.llm import simhash
from skeinrank.llm.simhash import ball_size, fingerprint, flips, met, simhash_dedup, simhash_links

from .helpers import SF, crowded, frame

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(text):
    """The fingerprint by its definition."""
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    runs = [w[i : i + 4] for i in range(len(w) - 3)] if len(w) > 3 else [w] if w else []
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=4):
    """The smallest fingerprint that links lead to, of each, by comparing all."""
    f = np.unique(np.array(fps, np.uint64))
    up = np.arange(len(f))
    near = np.bitwise_count(f[:, None] ^ f[None]) <= radius
    while True:
        new = np.where(near, up[None], len(f)).min(1)
        if (new == up).all():
            return dict(zip(f.tolist(), f[up].tolist()))
        up = new


def brute(rows):
    own = [(r.doc_id, plain(r.text)) for r in rows]
    root = linked([f for _, f in own])
    low = {}
    for i, f in own:
        low[root[f]] = min((x for x in (low.get(root[f]), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", low[root[f]]) for i, f in own), key=repr)


def result(df):
    return sorted((tuple(r) for r in simhash_dedup(df).collect()), key=repr)


def test_odd_rows(spark):
    df = crowded(frame(spark), "f", "id", "fingerprint", "component_id")
    assert result(df) == brute(df.collect())


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b c"), (5, "A"), (7, None), (3, ""), (5, "b c d e f g")], "doc_id long, text string").repartition(3)
    assert result(df) == brute(df.collect())
    assert simhash_dedup(frame(spark, [])).count() == 0


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i % 91}x{i % 7}" for i in range(3000)) + " \n " + "y" * 5000 + " end"
    whole = fingerprint(text.encode())
    for part in (1, 7, 100):
        monkeypatch.setattr(simhash, "PART", part)
        assert fingerprint(text.encode()) == whole == plain(text)


def groups_of(spark, fps, **more):
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in np.unique(np.array(fps, np.uint64))], "f long").repartition(4)
    edges = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in simhash_links(df, **more).collect()]
    assert all(np.bitwise_count(a ^ b) <= 64 for a, b in edges)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return {f: find(f) for f in root}


def test_links_at_every_distance_and_cut_of_large_groups(spark):
    rng = np.random.default_rng(5)
    fps = []
    for d in range(8):  # pairs d bits apart
        for _ in range(15):
            f = rng.integers(0, 2**64, dtype=np.uint64)
            fps += [f, f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, d, replace=False)))]
    centre = rng.integers(0, 2**64, dtype=np.uint64)
    fps += [centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False))) for _ in range(150)]
    fps += [np.uint64(0), np.uint64(2**64 - 1), np.uint64(15), np.uint64(31), np.uint64(2**63)]
    want = linked(fps)
    assert groups_of(spark, fps) == want
    # a bar so low that large prefixes are cut down to whole variants
    assert groups_of(spark, fps, target=4000, most=2100) == want


def test_a_ball_is_dealt_out_once():
    assert ball_size(64, 2) == 2081 == len(set(flips(64, 2).tolist()))
    f = np.array([0x123456789ABCDEF0], np.uint64)
    twin = f ^ np.uint64(0b1111)
    both = np.concatenate([f, twin])
    # the two halves of a distance of four meet under six variants, all of the same first bits
    a, b = met(both, both >> np.uint64(56), 8, 2)
    assert (len(a), set(a.tolist() + b.tolist())) == (1, set(both.tolist()))
    assert len(met(both, both >> np.uint64(56), 8, 1)[0]) == 0


def test_odd_radius(spark):
    with pytest.raises(ValueError):
        simhash_links(spark.range(2).select(F.col("id").alias("f")), radius=3)


def test_query(spark):
    from skeinrank.llm.queries import op11_simhash

    assert sorted((tuple(r) for r in op11_simhash(spark, SF).collect()), key=repr) == brute(spark.read.parquet(f"{SF}/documents.parquet").collect())
