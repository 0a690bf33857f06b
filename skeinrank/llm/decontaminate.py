"""Benchmark decontamination by suffix arrays of the training text.

The documents of a task form shards of some hundred thousand words. A shard's suffix array holds
the positions where a benchmark passage can begin (those whose first few words stand
somewhere in a benchmark item), sorted by the words that follow; every suffix of every
benchmark item is then found in it by binary search. The neighbours of its place give the
longest verbatim match, the range of suffixes that begin with its window gives every
location. Words are compared by 64-bit hashes, the suffixes' order is that of the hashes.

Nothing is shuffled, and the documents are read once. The benchmark is broadcast in blocks
of at most `block_words` words, a size that is counted, not assumed; a task reads one
block after the other for each shard and holds one at a time, with shards that are larger
the more blocks there are. Items shorter than the seed have blocks of their own, so that
they don't make the others' suffix arrays dense.

Edge cases: a null or empty text has no words; an item without words is ignored, one of
fewer words than a window is a window itself; repeated items count under each id; repeated
documents give repeated rows, however many blocks there are; an empty benchmark finds
nothing. A shard holds at least one whole document, so memory follows the longest one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ALNUM_WORDS, let_go, lowered, sliced, text_buffer, words

#: Words of a window, of a shard of documents, and of a block of benchmark items.
WINDOW, SHARD_WORDS, BLOCK_WORDS = 10, 250_000, 5_000_000
#: Shards grow with the number of blocks, up to so many times SHARD_WORDS.
LARGEST_SHARD = 8
#: Words that must agree before a position enters the suffix array.
SEED = 3


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(29)
    return out


class Suffixes:
    """All suffixes of a block of benchmark items that hold a window: their item, first word, words to the item's end, and words of a window."""

    def __init__(self, items: list[tuple[object, np.ndarray]], window: int):
        self.ids = [i for i, h in items if len(h)]
        lists = [h for _, h in items if len(h)]
        size = np.array([len(h) for h in lists], np.int64)
        self.words = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        begin = np.cumsum(size) - size
        need = np.minimum(size, window)
        rest = np.repeat(begin + size, size) - np.arange(len(self.words))
        item = np.repeat(np.arange(len(lists)), size)
        whole = rest >= need[item] if len(lists) else np.zeros(0, bool)
        self.at, self.item, self.rest, self.need = np.flatnonzero(whole), item[whole], rest[whole], need[item][whole]
        self.seed = int(min([SEED, *need]))
        self.seeds = np.unique(_rolling(self.words, self.seed)[self.at]) if self.seed else np.zeros(0, np.uint64)
        self.depth = int(size.max(initial=0))


def _suffix_array(w: np.ndarray, end: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """`pos` sorted by the words from there to its text's end: groups that still tie are refined a word at a time."""
    order, group = pos.copy(), np.zeros(len(pos), np.int64)
    live = np.arange(len(pos))
    for d in range(depth):
        if not len(live):
            break
        p = order[live] + d
        inside = p < end[order[live]]
        key = np.where(inside, w[np.minimum(p, len(w) - 1)], np.uint64(0))
        by = np.lexsort((key, inside, group[live]))
        order[live] = order[live][by]
        g, key, inside = group[live], key[by], inside[by]
        new = np.ones(len(live), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1]) | (inside[1:] != inside[:-1])
        name = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        group[live] = name
        _, inverse, count = np.unique(name, return_inverse=True, return_counts=True)
        live = live[(count[inverse] > 1) & inside]
    return order


def _agree(w: np.ndarray, end: np.ndarray, pos: np.ndarray, sw: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Leading words that each position and each benchmark suffix have in common, at most `most`."""
    out = np.zeros(len(pos), np.int64)
    live = np.arange(len(pos))
    d = 0
    while len(live):
        p = pos[live] + d
        live = live[(d < most[live]) & (p < end[pos[live]])]
        live = live[w[pos[live] + d] == sw[at[live] + d]]
        out[live] += 1
        d += 1
    return out


def _lower_bound(w, end, sa, s: Suffixes, length: np.ndarray, after: bool) -> np.ndarray:
    """For each benchmark suffix cut to `length` words: the first place whose suffix isn't less (or, with `after`, is greater)."""
    lo, hi = np.zeros(len(s.at), np.int64), np.full(len(s.at), len(sa), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        pos, at, most = sa[mid], s.at[open_], length[open_]
        same = _agree(w, end, pos, s.words, at, most)
        full = same == most
        short = pos + same >= end[pos]
        less = np.where(full, after, short | (w[np.minimum(pos + same, len(w) - 1)] < s.words[np.minimum(at + same, len(s.words) - 1)]))
        less = np.where(~full & short, True, less)
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    return lo


def find(w: np.ndarray, bounds: np.ndarray, s: Suffixes):
    """In a shard of words with rows `bounds`: (position, words, suffix) of every window found, and each suffix's longest match."""
    none = np.zeros(0, np.int64)
    longest = np.zeros(len(s.at), np.int64)
    if not len(s.at) or not len(w):
        return none, none, none, longest
    end = np.repeat(bounds[1:], np.diff(bounds))
    rolled = _rolling(w, s.seed)
    place = np.searchsorted(s.seeds, rolled)
    pos = np.flatnonzero((place < len(s.seeds)) & (s.seeds[np.minimum(place, len(s.seeds) - 1)] == rolled))
    pos = pos[pos + s.seed <= end[pos]]
    if not len(pos):
        return none, none, none, longest
    sa = _suffix_array(w, end, pos, s.depth)
    lo = _lower_bound(w, end, sa, s, s.rest, False)
    for side in (lo - 1, lo):
        ok = np.flatnonzero((side >= 0) & (side < len(sa)))
        longest[ok] = np.maximum(longest[ok], _agree(w, end, sa[side[ok]], s.words, s.at[ok], s.rest[ok]))
    hit = np.flatnonzero(longest >= s.need)
    cut = Suffixes.__new__(Suffixes)
    cut.at, cut.words = s.at[hit], s.words
    first = _lower_bound(w, end, sa, cut, s.need[hit], False)
    last = _lower_bound(w, end, sa, cut, s.need[hit], True)
    n = last - first
    which = np.repeat(hit, n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return sa[np.repeat(first, n) + inside], s.need[which], which, longest


def _covered(cover: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)


def _rows_found(bounds: np.ndarray, cover: np.ndarray, found: list[tuple[np.ndarray, list, np.ndarray]]):
    """Per row: merged spans as [begin, end, ...], item ids, and the longest match of any of its suffixes.

    `found` has for each block (position, item id, longest match) of every window found.
    """
    n = len(bounds) - 1
    items: list[set] = [set() for _ in range(n)]
    longest = np.zeros(n, np.int64)
    for at, ids, most in found:
        row = np.searchsorted(bounds, at, "right") - 1
        np.maximum.at(longest, row, most)
        for r, i in zip(row.tolist(), ids):
            items[r].add(i)
    hit = np.cumsum(cover[:-1]) > 0
    for r in range(n):
        if not longest[r]:
            yield [], [], 0
            continue
        step = np.diff(np.concatenate([[0], hit[bounds[r] : bounds[r + 1]].view(np.int8), [0]]))
        spans = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).ravel().tolist()
        yield spans, sorted(items[r]), int(longest[r])


def _blocks(spark, bench: DataFrame, n: int, window: int) -> list:
    """Broadcast blocks, each made of two sets of suffixes: the items of fewer words than the seed, and the others."""
    out = []
    for k in range(n):
        rows = bench.where(F.col("block") == k).select("item", "text").toArrow()
        buf, off = text_buffer(rows["text"])
        _, h, b = words(lowered(buf), off, ALNUM_WORDS)
        items = [(i, h[b[j] : b[j + 1]]) for j, i in enumerate(rows["item"].to_pylist())]
        parts = [[x for x in items if (len(x[1]) < SEED) == short] for short in (True, False)]
        out.append(spark.sparkContext.broadcast([Suffixes(p, window) for p in parts if p]))
    return out


def _read(block, keep: bool):
    """A block's suffixes; unless it is to be kept, the worker lets it go with the caller."""
    got = block.value
    if not keep:
        block.__dict__.pop("_value", None)
    return got


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, `keep`, n_words, spans (array of begin, end, ... in words), items (array of item ids as strings) and longest (words; of matches that hold a window)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))
    # a word takes two bytes or more with its separator
    weight = F.coalesce(F.sum((F.octet_length("text") + 2) / 2), F.lit(0.0))
    n = max(1, math.ceil(bench.agg(weight.cast("double")).first()[0] / block_words))
    blocks = _blocks(spark, bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n, window)
    carried = [f for f in docs.schema.fields if f.name in (id_col, *keep)]
    schema = T.StructType([*carried, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType())])
    source = docs.select(*(F.col(f"`{f.name}`") for f in carried), F.col(f"`{text_col}`").alias("__text"))
    shard_words = SHARD_WORDS * min(n, LARGEST_SHARD)

    def run(batches):
        let_go()

        def shard(held):
            w, bounds = np.concatenate([x[1] for x in held]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in held]))])
            cover, found = np.zeros(len(w) + 1, np.int64), []
            for block in blocks:
                for s in _read(block, n == 1):
                    at, size, which, longest = find(w, bounds, s)
                    _covered(cover, at, size)
                    found.append((at, [s.ids[i] for i in s.item[which].tolist()], longest[which]))
            got = _rows_found(bounds, cover, found)
            for batch, _, b in held:
                mine = [next(got) for _ in range(len(b) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[f.name] for f in carried), pa.array(np.diff(b), pa.int64()), pa.array([x[0] for x in mine], pa.list_(pa.int64())), pa.array([x[1] for x in mine], pa.list_(pa.string())), pa.array([x[2] for x in mine], pa.int64())],
                    [f.name for f in schema.fields],
                )

        held, n_held = [], 0
        for batch in sliced(batches, "__text"):
            buf, off = text_buffer(batch["__text"])
            _, h, b = words(lowered(buf), off, ALNUM_WORDS)
            held.append((batch.drop_columns(["__text"]) if carried else batch, h, b))
            n_held += len(h)
            if n_held >= shard_words:
                yield from shard(held)
                held, n_held = [], 0
        if held:
            yield from shard(held)

    return source.mapInArrow(run, schema)
