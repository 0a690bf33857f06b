"""N-gram Jaccard join: which documents' shingle sets are similar, and the groups they form.

Sets that are equal form one class and are joined once. Two sets of a similarity of at
least p/q differ in at most H = (q-p)(|r|+|s|)/(q+p) shingles. Sizes are cut into bands such
that a set's partners lie in its own band or a neighbour; a band's scheme hashes shingles
into m = H + 1 + g segments, so similar sets agree on g + 1 segments at least. A set's
signatures are its segments' contents and, for a few segments, the contents less one
shingle (one-deletion neighbourhoods: two segments that differ by one shingle meet there).

Allocation by cost: a segment may be left out as long as what is left must still meet
every partner: g segments are free to go, and one more for each one-deletion segment. The
empty segments go first, as all sets share them; then, once frequencies are known, those
whose contents more than `hot` sets share. What a passage in many documents fills goes
that way, and no pair is lost. A set whose hot segments are too many for that (one of a
large group of near copies) keeps them all.

Buckets of few sets give candidate pairs, which a parity sketch screens (it never drops a
similar pair). Buckets of many give a star each, not pairs. The connected components of
both are verified exactly in two steps. First every set meets its component's hub, the set
of most candidates; those that link to it need no comparison among themselves any more.
Only the sets left loose meet all others: loose sets and members are dealt out in tiles,
each pair of a loose tile and a tile is one task, which screens by sketches, skips what is
joined already and returns a spanning forest. No task holds more than two tiles, however
large the group, and a group whose sets link to its hub costs one comparison a set.

Edge cases: documents without words (null, empty or white space only) have no shingles and
no links; one of fewer words than a shingle has one shingle; rows that repeat are copies
like any other; sets are fetched by their own name, so ids may repeat with other texts or
be null; null ids are carried along, but name no group unless alone; other columns
are ignored; an empty table gives no rows. Shingles and classes are named by 64-bit hashes;
two classes under one name would raise an error, not merge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE_WORDS, Marks, components, id_hash, let_go, lowered, materialize, mix64, size_of, sliced, text_buffer, words

#: Sets of a bucket from which on it is hot; sets and shingles of a tile, about.
HOT, TILE_SETS, TILE_SHINGLES = 16, 512, 2_000_000
#: Segments of a scheme that have one-deletion neighbourhoods.
DELETIONS = 2


# ---------------------------------------------------------------- sets


def shingles(buf: np.ndarray, off: np.ndarray, width: int):
    """Per row its sorted distinct shingle hashes."""
    _, h, b = words(lowered(buf), off, SPACE_WORDS)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        rolled = mix64(rolled * np.uint64(0xA24BAED4963EE407) + h[i : i + len(rolled)])
    for lo, hi in zip(b[:-1].tolist(), b[1:].tolist()):
        if hi - lo >= width:
            yield np.unique(rolled[lo : hi - width + 1])
        elif hi > lo:
            one = np.full(1, hi - lo, np.uint64)
            for x in h[lo:hi]:
                one = mix64(one * np.uint64(0x9FB21C651E98DF25) + x)
            yield one
        else:
            yield rolled[:0]


def class_names(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    both = [mix64(np.array([mix64(tokens ^ np.uint64(k)).sum(dtype=np.uint64) + np.uint64(len(tokens))])) for k in (0x5BF0A8B1, 0x71C9E3D7)]
    return int(both[0].view(np.int64)[0]), int(both[1].view(np.int64)[0])


def sketch(tokens: np.ndarray) -> bytes:
    """Parity bits: as many bits differ between two sketches as shingles between the sets, at most."""
    bits = 1 << max(10, (len(tokens) - 1).bit_length())
    at = (mix64(tokens ^ np.uint64(0x33)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(s: np.ndarray, to: int) -> np.ndarray:
    """Sketches (one a row) cut to `to` bytes: the halves' parities add up."""
    while s.shape[1] > to:
        s = s[:, : s.shape[1] // 2] ^ s[:, s.shape[1] // 2 :]
    return s


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(-1, dtype=np.int64)


# ---------------------------------------------------------------- schemes


class Schemes:
    """Size bands and their segments for a threshold of p/q."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.starts = p, q, [1, 2]

    def _grow(self) -> None:
        last = self.starts[-1]
        self.starts.append(max(last + 1, (last - 1) * self.q // self.p + 1))

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self._grow()
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def budget(self, band: int) -> int:
        """How many shingles two similar sets can differ in when the smaller one is in `band`."""
        while len(self.starts) <= band + 1:
            self._grow()
        top = self.starts[band + 1] - 1
        return (self.q - self.p) * (top + top * self.q // self.p) // (self.q + self.p)

    def spare(self, budget: int) -> int:
        return 1 + budget // 16

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, budget) of each scheme that a set of n shingles takes part in; a budget of 0 means equal sets."""
        k = self.band(n)
        return [(i, h) for i in (k, k - 1) if i >= 0 and (h := self.budget(i)) > 0]

    def may(self, a, b):
        """Of size codes: False only if no such sets can be similar."""
        return np.abs(a - b) <= CODES * np.log(self.q / self.p) + 1

    def can(self, a, b):
        return self.q * np.minimum(a, b) >= self.p * np.maximum(a, b)

    def most(self, a, b):
        return (self.q - self.p) * (a + b) // (self.q + self.p)

    def similar(self, common: int, a: int, b: int) -> bool:
        return self.q * common >= self.p * (a + b - common)


#: The fields of a signature's info, from the low bits: size's code 12, segment 32, in the deletion part 1,
#: one-deletion 1, usable deletion segments 3, spare segments less empty ones + 1024 11, band's parity 1.
#: More than 1023 spare segments count as 1023 (then fewer hot buckets can be left out, and none is wrongly);
#: with fewer than -1024 no bucket can be left out anyway.
def _info(n, segment, listed, deletion, usable, slack, band):
    return (band & 1) << 60 | size_code(n) | segment << 12 | listed << 44 | deletion << 45 | usable << 46 | (min(max(slack, -1024), 1023) + 1024) << 49


#: Codes grow by one with each 1 % of a set's size: 12 bits are enough for any set.
CODES = 100


def size_code(n):
    return np.floor(CODES * np.log(np.maximum(n, 1))).astype(np.int64)


def signatures(tokens: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray]:
    sigs, infos = [], []
    n = len(tokens)
    own = mix64(tokens ^ np.uint64(0xA5))
    for band, budget in schemes.of(n):
        spare = schemes.spare(budget)
        m = budget + 1 + spare
        segment = (mix64(tokens ^ np.uint64((band + 1) * 0x10001)) % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, own)
        size = np.bincount(segment, minlength=m)
        salt = mix64(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
        listed = np.arange(m) < DELETIONS
        usable = int((listed & (size >= 2)).sum())
        slack = spare - int((size == 0).sum())
        out = size > 0 if slack + usable >= 0 else np.ones(m, bool)
        at = np.flatnonzero(out)
        sigs.append(mix64(total[at] ^ salt[at]))
        infos.append(_info(np.full(len(at), n), at, listed[at].astype(np.int64), 0, usable, slack, band))
        less = np.flatnonzero((segment < DELETIONS) & (size[segment] >= 2))
        if len(less):
            s = segment[less]
            sigs.append(mix64((total[s] - own[less]) ^ salt[s]))
            infos.append(_info(np.full(len(less), n), s, 1, 1, usable, slack, band))
    if not sigs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sigs).view(np.int64), np.concatenate(infos)


# ---------------------------------------------------------------- plan


def _rows(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, cls, cls2, sketch) for each document."""

    def run(batches):
        let_go()
        for batch in sliced(batches, "text"):
            sets = list(shingles(*text_buffer(batch["text"]), width))
            names = [class_names(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                ["id", "n", "cls", "cls2", "sketch"],
            )

    schema = T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n", "cls", "cls2")), T.StructField("sketch", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def _signature_rows(docs: DataFrame, width: int, schemes: Schemes) -> DataFrame:
    """(sig, cls, info); a task emits a class once, so copies hardly count."""

    def run(batches):
        let_go()
        seen: set[int] = set()
        for batch in sliced(batches, "text"):
            sig, cls, info = [], [], []
            for s in shingles(*text_buffer(batch["text"]), width):
                if not len(s) or (name := class_names(s)[0]) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                a, b = signatures(s, schemes)
                sig.append(a)
                info.append(b)
                cls.append(np.full(len(a), name, np.int64))
                if sum(map(len, sig)) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, cls, info)], ["sig", "cls", "info"])
                    sig, cls, info = [], [], []
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, cls, info)], ["sig", "cls", "info"])

    return docs.select("text").mapInArrow(run, "sig long, cls long, info long")


def _buckets(rows: DataFrame, schemes: Schemes, hot: int) -> DataFrame:
    """Rows sorted by signature: candidate pairs (a, b, null) of small buckets, and the rows (sig, cls, info) of hot ones."""

    def pairs(sig, cls, info, begin, size):
        """Of the small buckets: all pairs whose sizes allow it and of which one side is undiminished."""
        code, gone = info & 0xFFF, (info >> 45) & 1
        left = np.repeat(size, size) - (np.arange(len(sig)) - np.repeat(begin, size))  # rows to the bucket's end
        out = []
        for d in range(1, int(size.max(initial=1))):
            i = np.flatnonzero(left > d)
            if not len(i):
                break
            j = i + d
            ok = (cls[i] != cls[j]) & schemes.may(code[i], code[j]) & (gone[i] + gone[j] < 2)
            i, j = i[ok], j[ok]
            out.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])]))
        x = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        x = x[:, np.lexsort(x[::-1])]
        new = np.ones(x.shape[1], bool)
        new[1:] = (x[:, 1:] != x[:, :-1]).any(0)
        return x[:, new]

    def batch_of(a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c) if c is not None else pa.nulls(len(a), pa.int64())], ["a", "b", "info"])

    def distinct(sig, cls, info):
        """One row a class and kind of signature: a class comes from every task that holds a copy."""
        kind = (info >> 45) & 1
        order = np.lexsort((kind, cls, sig))
        sig, cls, info, kind = sig[order], cls[order], info[order], kind[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]) | (kind[1:] != kind[:-1])
        return sig[new], cls[new], info[new]

    def emit(sig, cls, info):
        sig, cls, info = distinct(sig, cls, info)
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(begin, len(sig)))
        many = np.repeat(size > hot, size)
        some = np.repeat((size > 1) & (size <= hot), size)
        if some.any():
            s = size[(size > 1) & (size <= hot)]
            a, b = pairs(sig[some], cls[some], info[some], np.cumsum(s) - s, s)
            if len(a):
                yield batch_of(a, b, None)
        if many.any():
            yield batch_of(sig[many], cls[many], info[many])

    def run(batches):
        let_go()
        held: list[np.ndarray] = []
        n, gone = 0, None  # gone: a hot bucket some of whose rows went out already

        def settled(x):
            if x.shape[1] and x[0, 0] == gone:
                cut = int(np.searchsorted(x[0], gone, "right"))
                yield batch_of(*distinct(*x[:, :cut]))
                x = x[:, cut:]
            if x.shape[1]:
                yield from emit(*x)

        for batch in batches:
            held.append(np.stack([batch[c].to_numpy() for c in ("sig", "cls", "info")]))
            n += held[-1].shape[1]
            if n < 400_000:
                continue
            x = np.concatenate(held, 1)
            last = int(np.searchsorted(x[0], x[0, -1]))  # the last bucket may go on
            yield from settled(x[:, :last])
            x = x[:, last:]
            if x.shape[1] > 100_000:
                gone = x[0, 0]
                yield batch_of(*distinct(*x))
                x = x[:, :0]
            held, n = [x], x.shape[1]
        if n:
            yield from settled(np.concatenate(held, 1))

    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "a long, b long, info long")


def _screened(pairs: DataFrame, sketches: DataFrame, schemes: Schemes) -> DataFrame:
    """Pairs whose sketches differ in no more bits than similar sets may."""

    def run(batches):
        let_go()
        for batch in batches:
            a, b, na, nb = (batch[c].to_numpy() for c in ("a", "b", "na", "nb"))
            sa, sb = batch["sa"].to_pylist(), batch["sb"].to_pylist()
            size = np.array([min(len(x), len(y)) for x, y in zip(sa, sb)], np.int64)
            keep = np.zeros(len(a), bool)
            for width in np.unique(size).tolist():
                at = np.flatnonzero(size == width)
                x, y = (np.concatenate([_folded(np.frombuffer(s[i], np.uint8)[None], width) for i in at]) for s in (sa, sb))
                keep[at] = _differ(x, y) <= schemes.most(na[at], nb[at])
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    side = lambda k: sketches.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def ngram_join(docs: DataFrame, width: int = 4, p: int = 85, q: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, classes_too: bool = False) -> DataFrame:
    """Per document: (id, n_shingles, component_id): the smallest id that links lead to, its own included.

    With `classes_too` also cls and component: the names of the document's set and of its group, whatever the ids are (null without words).
    """
    schemes = Schemes(p, q)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(_rows(source, width), "sets")
    classes = materialize(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("low"), F.max("n").alias("n"), F.min("cls2").alias("c1"), F.max("cls2").alias("c2"), F.first("sketch").alias("sketch")), "classes", size_of(rows))
    if not classes.where("c1 <> c2").isEmpty():
        raise RuntimeError("two different sets share a 64-bit name")

    found = materialize(_buckets(_signature_rows(source, width, schemes), schemes, hot), "buckets")
    pairs = materialize(_screened(found.where("info is null").select("a", "b").distinct(), classes, schemes), "pairs", size_of(found))
    # hot buckets: a set may leave them out while its other segments suffice
    part = lambda shift, bits: F.shiftrightunsigned("info", shift).bitwiseAND(F.lit((1 << bits) - 1))
    rows_hot = found.where("info is not null").select(F.col("a").alias("sig"), F.col("b").alias("cls"), part(12, 32).alias("segment"), part(44, 1).alias("listed"), part(45, 1).alias("gone"), part(46, 3).alias("usable"), part(49, 11).alias("slack"), part(60, 1).alias("scheme"))
    own = F.when((F.col("gone") == 0), F.col("segment"))
    need = rows_hot.groupBy("cls", "scheme", "slack", "usable").agg(F.count_distinct(own).alias("own"), F.count_distinct(F.when(F.col("listed") == 1, F.col("segment"))).alias("listed"))
    need = need.where("slack - 1024 - own + usable - listed < 0").select("cls", "scheme")
    kept = materialize(rows_hot.join(need, ["cls", "scheme"]).select("sig", "cls").distinct(), "hot", size_of(found))
    low = materialize(kept.groupBy("sig").agg(F.min("cls").alias("a")), "hubs", size_of(found))
    stars = kept.join(low, "sig").where("cls <> a").select("a", F.col("cls").alias("b"))

    edges = pairs.union(stars)
    room = size_of(classes)
    blocks = components(edges)
    degree = edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    hubs = materialize(blocks.join(degree, "node").groupBy("component").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"), F.count("*").alias("members")), "block-hubs", room)
    links = components(_verified(source, blocks.join(hubs, "component"), classes, width, schemes))
    names = links.join(classes.select(F.col("cls").alias("node"), "low"), "node")
    lowest = materialize(names.groupBy("component").agg(F.min("low").alias("component_id"), F.min("node").alias("first")), "lowest", room)
    named = links.join(lowest, "component").select(F.col("node").alias("cls"), "component_id", "first")
    of_class = classes.select("cls", "low").join(named, "cls", "left").select("cls", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("first", "cls").alias("component"))
    out = rows.select("id", "n", "cls").join(materialize(of_class, "of-class", room), "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *(["cls", "component"] if classes_too else []))


def class_of(width: int):
    """Of an Arrow column of texts the names of their sets, null for the empty one."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([class_names(s)[0] if len(s) else None for s in shingles(*text_buffer(texts), width)], pa.int64())

    return run


def _sets_of(source: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(cls, tokens) of the rows whose id members(low) marks, each class once a task: the wanted ones and few others, so that other texts aren't shuffled."""
    marks = Marks(members.select(id_hash("low").alias("h")))

    def run(batches):
        let_go()
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(marks.hits(batch["h"].to_numpy())))
            for part in sliced([batch] if len(batch) else [], "text"):
                names, sets = [], []
                for s in shingles(*text_buffer(part["text"]), width):
                    if len(s) and (name := class_names(s)[0]) not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(name)
                        names.append(name)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["cls", "tokens"])

    return source.select("text", id_hash("id").alias("h")).mapInArrow(run, "cls long, tokens binary")


def _verified(source: DataFrame, blocks: DataFrame, classes: DataFrame, width: int, schemes: Schemes) -> DataFrame:
    """Edges (a, b) that join all that links join: blocks(node, component, hub, members)."""
    members = materialize(blocks.join(classes.select(F.col("cls").alias("node"), "low", "n"), "node").withColumnRenamed("node", "cls"), "members", 3 * size_of(classes))
    sets = materialize(_sets_of(source, members, width).join(members, "cls").select("cls", "component", "hub", "members", "n", "tokens").dropDuplicates(["cls"]), "members-sets", size_of(source))
    hubs = sets.where("cls = hub").select("component", F.col("tokens").alias("hub_tokens"))

    def meet(batches):
        let_go()
        for batch in batches:
            linked = []
            for a, b in zip(batch["tokens"], batch["hub_tokens"]):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                linked.append(bool(schemes.can(len(a), len(b))) and schemes.similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield pa.RecordBatch.from_arrays([batch["cls"], batch["hub"], batch["component"], batch["members"], batch["n"], pa.array(linked, pa.bool_())], ["cls", "hub", "component", "members", "n", "linked"])

    asked = sets.where("cls <> hub").join(hubs, "component")
    met = materialize(asked.mapInArrow(meet, "cls long, hub long, component long, members long, n long, linked boolean"), "met", size_of(sets))
    stars = met.where("linked").select(F.col("hub").alias("a"), F.col("cls").alias("b"))

    # the loose sets meet all others of their component but the hub
    open_ = met.where("members > 2").groupBy("component").agg(
        F.count_if(~F.col("linked")).alias("loose"), F.ceil(F.greatest(F.count("*") / TILE_SETS, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"),
        F.ceil(F.greatest(F.count_if(~F.col("linked")) / TILE_SETS, F.sum(F.when(~F.col("linked"), F.col("n"))) / TILE_SHINGLES)).cast("int").alias("loose_tiles"),
    )
    open_ = materialize(open_.where("loose > 0").drop("loose"), "open", size_of(members))
    part = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    left = materialize(met.join(open_, "component").select("cls", "component", "linked", "tiles", "loose_tiles"), "left", size_of(members))
    rest = left.join(sets.select("cls", "tokens"), "cls")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ones = rest.where("not linked").withColumn("t", part("loose_tiles")).withColumn("u", each("tiles")).withColumn("one", F.lit(True))
    others = rest.withColumn("u", part("tiles")).withColumn("t", each("loose_tiles")).withColumn("one", F.lit(False))
    columns = ["component", "t", "u", "one", "cls", "linked", "tokens"]

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cls")
        one, two = frame[frame["one"]], frame[~frame["one"]]
        tokens = lambda f: [np.frombuffer(x, np.uint64) for x in f["tokens"]]
        edges = forest(tokens(one), tokens(two), schemes, np.flatnonzero(two["linked"].to_numpy(bool)))
        a, b = one["cls"].to_numpy(), two["cls"].to_numpy()
        edges = [(a[i], b[j]) for i, j in edges if a[i] != b[j]]
        return pd.DataFrame({"a": [x for x, _ in edges], "b": [y for _, y in edges]}, dtype=np.int64)

    more = ones.select(*columns).unionByName(others.select(*columns)).groupBy("component", "t", "u").applyInPandas(verify, "a long, b long")
    # written before they are contracted: a stage with two steps in Python doubles the workers that stay
    return stars.unionByName(materialize(more, "verified"))


def forest(one: list[np.ndarray], two: list[np.ndarray] | None, schemes: Schemes, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) between two lists of sets (or within one) that join all that links join; the places `joined` of the second are one already."""
    other = one if two is None else two
    if not one or not other:
        return []
    na, nb = np.array([len(x) for x in one]), np.array([len(x) for x in other])
    own_a = [np.frombuffer(sketch(x), np.uint8)[None] for x in one]
    own_b = own_a if two is None else [np.frombuffer(sketch(x), np.uint8)[None] for x in other]
    widths = np.array([x.shape[1] for x in own_b])
    at_width = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
    tables = {(w, w): np.concatenate([own_b[k] for k in at]) for w, at in at_width.items()}
    up = list(range(len(one) + (0 if two is None else len(other))))
    shift = 0 if two is None else len(one)

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    if joined is not None and len(joined):
        for k in joined.tolist():
            up[shift + k] = shift + int(joined[0])
    found = []
    for i in range(len(one)):
        near, bits = [], []
        for w, at in at_width.items():
            ok = schemes.can(na[i], nb[at])
            if two is None:
                ok &= at > i
            if not ok.any():
                continue
            to = min(w, own_a[i].shape[1])
            if (w, to) not in tables:
                tables[w, to] = _folded(tables[w, w], to)
            d = _differ(_folded(own_a[i], to), tables[w, to][ok])
            at = at[ok]
            ok = d <= schemes.most(na[i], nb[at])
            near += at[ok].tolist()
            bits += d[ok].tolist()
        for k in (near[x] for x in np.argsort(bits, kind="stable")):
            if find(i) == find(shift + k):
                continue
            common = len(np.intersect1d(one[i], other[k], assume_unique=True))
            if schemes.similar(common, len(one[i]), len(other[k])):
                up[max(find(i), find(shift + k))] = min(find(i), find(shift + k))
                found.append((i, k))
    return found
