"""SimHash near-duplicates: meet-in-the-middle ball hashing over 64-bit fingerprints.

Two fingerprints that differ in at most 2h bits have a value in common that is at most h bits
from either. So every distinct fingerprint emits its ball, all variants within h bits (2,081 of
them for h = 2), and those that meet on a variant are linked, as the ball is symmetric: whoever
shares a variant differs in 2h bits at most. A variant's owners therefore need a star, not all
pairs; each edge is verified all the same.

The shuffle is on the variants' first bits: of the variants that share them a fingerprint's come
as one row, and the receiving task writes them out. For k first bits a fingerprint takes
1 + k + k(k-1)/2 rows instead of 2,081. k follows from the number of fingerprints, so that a
prefix has `TARGET` variants on average. A prefix with more than `MOST` (a large group of near
copies shares most of its bits) is cut by more bits, again and again, down to whole variants, of
which 2,081 different fingerprints at most share one. So no task's memory grows with a group.

Fingerprints that are equal are one before anything is emitted; no fingerprint passes the driver.

Edge cases: a document without words (null, empty or white space only) has the fingerprint zero,
and is linked like any other; one of fewer words than a shingle has one shingle, its words; texts
of any length are hashed whole, a piece at a time; repeated rows are copies like any other; a
component whose ids are all null has a null name, and null ids name no other; other columns, of any
name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER_TABLE, _roots, components, let_go, materialize, size_of, sliced, text_buffer

BITS = 64
#: Variants of a prefix on average and at most, and bits by which a prefix with more is cut.
TARGET, MOST, STEP = 1 << 20, 1 << 23, 8
#: Bytes of a text whose words are held at a time.
PART = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(data: bytes, width: int, seed: int):
    """Arrays of the XXH64 of each shingle of the lower-cased text, repeats included."""
    held: list[bytes] = []
    any_, at = False, 0
    while at < len(data):
        end = len(data)
        if end - at > PART and (m := _SPACE.search(data, at + PART)):
            end = m.start()
        held += data[at:end].translate(LOWER_TABLE).split()
        at = end
        if len(held) >= width:
            any_ = True
            yield np.array([xxhash.xxh64_intdigest(b" ".join(held[i : i + width]), seed) for i in range(len(held) - width + 1)], np.uint64)
            held = held[len(held) - width + 1 :]
    if held and not any_:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def fingerprint(data: bytes, width: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; zero without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(data, width, seed):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f) of each document; f holds the fingerprint's 64 bits as a long."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        let_go()
        for batch in sliced(batches, "text"):
            buf, off = text_buffer(batch["text"])
            own = np.array([fingerprint(buf[a:b].tobytes(), width, seed) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(own.view(np.int64))], ["id", "f"])

    return source.mapInArrow(run, T.StructType([source.schema["id"], T.StructField("f", T.LongType())]))


# ---------------------------------------------------------------- balls


@functools.cache
def flips(bits: int, most: int) -> np.ndarray:
    """All values of `bits` bits with `most` ones at most, fewest first."""
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in itertools.combinations(range(bits), n)], np.uint64)


def ball_size(bits: int, most: int) -> int:
    return sum(math.comb(bits, n) for n in range(most + 1))


def _left(at: int, half: int):
    """Bits that a row's variants may still differ in beyond its prefix of `at` bits."""
    return F.lit(half) - F.bit_count(F.shiftrightunsigned("f", BITS - at).bitwiseXOR(F.col("key")))


def _cut(rows: DataFrame, at: int, more: int, half: int) -> DataFrame:
    """rows(f, key) of prefixes of `at` bits, dealt to those of `more` bits more."""
    masks = F.array(*(F.lit(int(m)).cast("long") for m in flips(more, half)))
    left = _left(at, half) if at else F.lit(half)
    own = F.shiftrightunsigned("f", BITS - at - more).bitwiseAND(F.lit((1 << more) - 1).cast("long"))
    each = rows.select("f", "key", left.alias("left"), own.alias("own"), F.explode(masks).alias("mask")).where(F.bit_count("mask") <= F.col("left"))
    return each.select("f", F.shiftleft("key", more).bitwiseOR(F.col("own").bitwiseXOR(F.col("mask"))).alias("key"))


def _prefixes(fps: DataFrame, n: int, half: int, target: int, most: int) -> list[tuple[int, DataFrame]]:
    """(bits, rows(f, key)): every variant of every fingerprint belongs to one row of one of them, and none of the prefixes begins another."""
    at = min(30, max(1, math.ceil(math.log2(max(2, n * ball_size(BITS, half) / target)))))
    level, out = _cut(fps.select("f", F.lit(0).cast("long").alias("key")), 0, at, half), []
    while True:
        sizes = F.element_at(F.array(*(F.lit(ball_size(BITS - at, r)) for r in range(half + 1))), _left(at, half) + 1)
        large = level.groupBy("key").agg(F.sum(sizes).alias("n")).where(F.col("n") > most).select("key") if at < BITS else None
        if large is None or (large := materialize(large, f"large-{at}", 0)).isEmpty():
            return [*out, (at, level)]
        out.append((at, level.join(large, "key", "left_anti")))
        more = min(STEP, BITS - at)
        level = materialize(_cut(level.join(large, "key", "left_semi").select("f", "key"), at, more, half), f"cut-{at}")
        at += more


#: Bits of the table that tells variants with several owners from most others.
_SCREEN = 20


def met(f: np.ndarray, key: np.ndarray, at: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) between the owners of each variant: rows (f, key) of whole prefixes of `at` bits."""
    low = BITS - at
    gone = np.bitwise_count((f >> np.uint64(low)) ^ key)
    base = f & np.uint64((1 << low) - 1) | key << np.uint64(low)
    parts, owners = [], []
    for r in range(half + 1):
        own = np.flatnonzero(gone == half - r)
        if len(own):
            parts.append((base[own][:, None] ^ flips(low, min(r, low))[None]).ravel())
            owners.append((own, len(parts[-1]) // len(own)))
    none = np.zeros(0, np.uint64)
    if not parts:
        return none, none
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    if not len(twice):
        return none, none
    place = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SCREEN)
    screen = np.zeros(1 << _SCREEN, bool)
    screen[place(twice)] = True
    values, holders = [], []
    for v, (own, size) in zip(parts, owners):
        hit = np.flatnonzero(screen[place(v)])
        hit = hit[twice[np.minimum(np.searchsorted(twice, v[hit]), len(twice) - 1)] == v[hit]]
        values.append(v[hit])
        holders.append(f[own[hit // size]])
    v, h = np.concatenate(values), np.concatenate(holders)
    order = np.lexsort((h, v))
    v, h = v[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    a = h[np.repeat(first, np.diff(np.append(first, len(v))))]
    pairs = np.unique(np.stack([a, h], 1)[a != h], axis=0)
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * half]
    return pairs[:, 0], pairs[:, 1]


def _meetings(rows: DataFrame, at: int, half: int, target: int) -> DataFrame:
    """Edges (a, b) of rows(f, key); each task's are put together to a spanning forest before they leave it."""
    sizes = np.array([ball_size(BITS - at, r) for r in range(half, -1, -1)])

    def run(batches):
        let_go()
        f, key, own = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(upto):
            nonlocal f, key, own, a, b
            x, y = met(f[:upto].view(np.uint64), key[:upto].view(np.uint64), at, half)
            f, key, own = f[upto:], key[upto:], own[upto:]
            a, b = np.concatenate([a, x.view(np.int64)]), np.concatenate([b, y.view(np.int64)])
            if len(a) > 500_000:
                a, b = _roots(a, b)

        for batch in batches:
            x, y = batch["f"].to_numpy(), batch["key"].to_numpy()
            gone = np.bitwise_count((x.view(np.uint64) >> np.uint64(BITS - at)) ^ y.view(np.uint64))
            f, key, own = np.concatenate([f, x]), np.concatenate([key, y]), np.concatenate([own, sizes[gone]])
            while own.sum() > target:  # whole prefixes only: the last may go on
                cut = int(np.searchsorted(key, key[np.searchsorted(np.cumsum(own), target)])) or int(np.searchsorted(key, key[0], "right"))
                if cut == len(key):
                    break
                found(cut)
            if len(a) > 250_000:
                a, b = _roots(a, b)
                if len(a) > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = a[:0], b[:0]
        found(len(f))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(a, b)], ["a", "b"])

    return rows.select("f", "key").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def simhash_links(fps: DataFrame, radius: int = 4, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Edges (a, b), written, between the distinct fingerprints fps(f), that join all that differ in `radius` bits or fewer (an even number)."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number of bits, so that both halves are equal")
    out = None
    for at, rows in _prefixes(fps, fps.count(), radius // 2, target, most):
        part = _meetings(rows, at, radius // 2, target)
        out = part if out is None else out.unionByName(part)
    return materialize(out, "links")


def simhash_dedup(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (id, fingerprint: 16 hex digits, component_id: the smallest id that links lead to, its own included)."""
    rows = materialize(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    room = size_of(rows)
    fps = materialize(rows.groupBy("f").agg(F.min("id").alias("low")), "distinct", room)
    groups = components(simhash_links(fps.select("f"), radius))
    named = groups.join(fps, groups["node"] == fps["f"]).select("f", "low", "component")
    lowest = materialize(named.groupBy("component").agg(F.min("low").alias("component_id")), "lowest", room)
    of_group = named.join(lowest, "component").select("f", "component_id")
    of_all = fps.join(of_group, "f", "left").select("f", F.coalesce("component_id", "low").alias("component_id"))
    out = rows.join(materialize(of_all, "components-of", room), "f", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
