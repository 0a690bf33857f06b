"""Exact dedup of an incoming batch against an immutable snapshot.

Every text is folded (A-Z to a-z) and digested once. A snapshot never changes, so what is
made of it is written once under its path and only read from then on: its rows' digests,
its distinct digests dealt to buckets, and for each bucket a static binary-fuse filter
over the digests' first 64 bits. The batch's distinct digests are screened by their
bucket's filter: those it rejects are certainly new and are grouped among themselves;
those it passes are joined to the bucket's exact digests, and the bytes of all texts under
a digest that both sides have are compared. Of equal texts the row with the largest id stays.

Only digests are shuffled for all rows. A digest that a third of the rows share is counted
map-side, and read back by a join of two written tables, where Spark splits a skewed key.
Whole texts travel only for digests found on both sides, once a task: a task compares the
bytes of its own rows under a digest and passes one of them on. A bounded bitmap tells
those digests; when it fills up (beyond some 8 million) other texts travel, too.

Edge cases: null counts as empty, and empty texts equal each other; a null id loses to any
other; rows that repeat an id and its text are flagged alike, and count as often as they
stand; different texts under one id are judged each by itself; empty inputs give no rows;
other columns are ignored. Two texts under one digest would be kept apart between the sides.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER_TABLE, Marks, let_go, materialize, mix64, size_of, sliced

#: Digests of a filter's bucket, about; the number of buckets follows the snapshot.
KEYS_PER_FILTER = 1_000_000
#: Bytes of texts a task holds to compare its own rows before it passes them on and starts anew.
HELD_BYTES = 32 << 20


# ---------------------------------------------------------------- binary-fuse filter


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys ^ np.uint64(seed))
    base = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    one = (base + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    two = (base + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([base, one, two]).astype(np.int64), ((h ^ (h >> np.uint64(37))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A three-wise binary-fuse filter with 8-bit fingerprints of 64-bit keys: about 9 bits a key."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 1)
    segment = 1 << max(2, min(18, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) if n > 1 else 4.0
    segments = max(1, math.ceil(n * factor / segment) - 2)
    seed = 1
    while True:
        at, print_ = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        member = np.zeros(size, np.int64)
        ids = np.arange(len(keys))
        for row in at:
            np.bitwise_xor.at(member, row, ids)
        rounds, left = [], len(keys)
        ready = np.flatnonzero(count == 1)
        while len(ready):
            key, first = np.unique(member[ready], return_index=True)
            slot = ready[first]
            rounds.append((key, slot))
            left -= len(key)
            touched = at[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(member, touched, np.tile(key, 3))
            touched = np.unique(touched)
            ready = touched[count[touched] == 1]
        if not left:
            break
        seed += 1
        if seed % 16 == 0:
            segments += max(1, segments // 8)
    cells = np.zeros((segments + 2) * segment, np.uint8)
    for key, slot in reversed(rounds):
        # the key's own slot is still zero here, so the three cells' xor is that of the other two
        cells[slot] = print_[key] ^ cells[at[0, key]] ^ cells[at[1, key]] ^ cells[at[2, key]]
    return np.array([seed, segment, segments], "<i8").tobytes() + cells.tobytes()


def screen(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """False where a key is certainly absent."""
    seed, segment, segments = np.frombuffer(filter_[:24], "<i8").tolist()
    cells = np.frombuffer(filter_, np.uint8, offset=24)
    at, print_ = _slots(keys.astype(np.uint64), seed, segment, segments)
    return (cells[at[0]] ^ cells[at[1]] ^ cells[at[2]]) == print_


# ---------------------------------------------------------------- the operator


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8").translate(LOWER_TABLE)


def digests_of(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(folded(t.as_py())).digest() for t in texts], pa.binary())


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches):
        let_go()
        for b in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["id"], digests_of(b["text"])], ["id", "digest"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("digest", T.BinaryType())]))


def _keys(digests: pa.Array) -> np.ndarray:
    """The first 64 bits of 32-byte digests."""
    return np.frombuffer(b"".join([x[:8] for x in digests.to_pylist()]), "<u8")


def _sides(rows: DataFrame, label: str) -> DataFrame:
    """(digest, n, last) of (id, digest)."""
    return materialize(rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("last")), label, size_of(rows))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


class Snapshot:
    """What is made of a snapshot's rows: rows(id, digest), digests(digest, n, last), filters(bucket, filter)."""

    def __init__(self, rows: DataFrame, digests: DataFrame, filters: DataFrame, buckets: int):
        self.rows, self.digests, self.filters, self.buckets = rows, digests, filters, buckets

    @classmethod
    def build(cls, docs: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> Snapshot:
        """From docs(id, text)."""
        rows = materialize(_digests(docs), "old-rows")
        digests = _sides(rows, "old-digests")
        # at least a bucket for each shuffle partition: a bucket is one task's work
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(digests.count() / keys_per_filter))
        return cls(rows, digests, materialize(_filters(digests.select("digest", _bucket(buckets).alias("bucket")), buckets), "filters", size_of(digests)), buckets)

    @classmethod
    def at(cls, path: str, docs: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> Snapshot:
        """The snapshot kept under `path`; made of `docs` if it isn't there yet. A path names one immutable snapshot."""
        spark = docs.sparkSession
        root = path.rstrip("/")
        try:
            buckets = spark.read.parquet(f"{root}/whole").first().buckets  # written last
        except AnalysisException:
            made = cls.build(docs, keys_per_filter)
            for name in ("rows", "digests", "filters"):
                getattr(made, name).write.mode("overwrite").parquet(f"{root}/{name}")
            spark.range(1).select(F.lit(made.buckets).alias("buckets")).write.mode("overwrite").parquet(f"{root}/whole")
            buckets = made.buckets
        return cls(*(spark.read.parquet(f"{root}/{name}") for name in ("rows", "digests", "filters")), buckets)


def _filters(digests: DataFrame, buckets: int) -> DataFrame:
    """A row for each bucket that has digests; a task holds the keys of one bucket at a time."""

    def run(batches):
        let_go()
        bucket, keys = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([build_filter(np.concatenate(keys))], pa.binary())], ["bucket", "filter"])

        for batch in batches:
            own = batch["bucket"].to_numpy()
            cuts = np.flatnonzero(np.diff(own)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                if lo == hi:
                    continue
                if keys and own[lo] != bucket:
                    yield done()
                    keys = []
                bucket = int(own[lo])
                keys.append(_keys(batch["digest"].slice(lo, hi - lo)))
        if keys:
            yield done()

    return digests.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, filter binary")


def _screened(new: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests of new(digest) that their bucket's filter passes."""

    def run(batches):
        let_go()
        bucket, filter_ = None, b""
        for batch in batches:
            own, given, maybe = batch["bucket"].to_numpy(), batch["filter"].is_valid().to_numpy(zero_copy_only=False), np.zeros(len(batch), bool)
            cuts = np.flatnonzero((np.diff(own) != 0) | given[1:] | given[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                if lo == hi:
                    continue
                if given[lo]:  # a bucket's filter comes before its digests
                    bucket, filter_ = int(own[lo]), batch["filter"][lo].as_py()
                elif own[lo] == bucket:
                    maybe[lo:hi] = screen(filter_, _keys(batch["digest"].slice(lo, hi - lo)))
            if maybe.any():
                yield pa.RecordBatch.from_arrays([batch["digest"].filter(pa.array(maybe))], ["digest"])

    asked = new.select(_bucket(snapshot.buckets).alias("bucket"), F.lit(None).cast("binary").alias("filter"), "digest")
    both = asked.unionByName(snapshot.filters.withColumn("digest", F.lit(None).cast("binary")))
    return both.repartition(snapshot.buckets, "bucket").sortWithinPartitions("bucket", F.isnull("filter")).mapInArrow(run, "digest binary")


def _texts_of(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, text): of the marked digests' texts, each task's different ones, folded."""
    marks = Marks(digests.select(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("h")))

    def run(batches):
        let_go()
        held: dict[bytes, bytes] = {}
        size = 0
        for batch in sliced(batches, "text"):
            found = digests_of(batch["text"]).to_pylist()
            hit = marks.hits(np.array([int.from_bytes(x[:7], "big") for x in found], np.int64))
            own, texts = [], []
            for k in np.flatnonzero(hit).tolist():
                text = folded(batch["text"][k].as_py())
                if held.get(found[k]) == text:  # compared: the bytes are those of one passed on
                    continue
                if size > HELD_BYTES:
                    held, size = {}, 0
                held[found[k]] = text
                size += len(text)
                own.append(found[k])
                texts.append(text)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(texts, pa.binary())], ["digest", "text"])

    return docs.select("text").mapInArrow(run, "digest binary, text binary")


def exact_dedup(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text", keys_per_filter: int = KEYS_PER_FILTER, snapshot_path: str | None = None) -> DataFrame:
    """Per row of `docs` (a snapshot's rows are those where `in_snapshot`): (id, digest, keep_id, group_size, kept).

    With `snapshot_path` the snapshot's filters and digests are kept there and used again.
    """
    rows_in = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(in_snapshot, F.lit(False)).alias("old"), F.col(f"`{text_col}`").alias("text"))
    source = rows_in.where("old").select("id", "text")
    old = Snapshot.build(source, keys_per_filter) if snapshot_path is None else Snapshot.at(snapshot_path, source, keys_per_filter)
    new_rows = materialize(_digests(rows_in.where("not old").select("id", "text")), "new-rows")
    new = _sides(new_rows, "new-digests")

    both = materialize(_screened(new.select("digest"), old).join(old.digests.select("digest"), "digest"), "both", size_of(new))
    samples = _texts_of(rows_in, both).join(both, "digest").groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    same = samples.where("a = b").select("digest", F.lit(True).alias("same"))

    side = old.digests.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    groups = (
        side.join(same, "digest", "left")
        .withColumn("team", F.when(F.col("same"), F.lit(2)).otherwise(F.col("old").cast("int")))
        .groupBy("digest", "team")
        .agg(F.sum("n").alias("group_size"), F.max("last").alias("keep_id"), F.collect_set("old").alias("olds"))
        .select("digest", F.explode("olds").alias("old"), "group_size", "keep_id")
    )
    groups = materialize(groups, "groups", size_of(old.digests) + size_of(new))
    rows = old.rows.withColumn("old", F.lit(True)).unionByName(new_rows.withColumn("old", F.lit(False)))
    return rows.join(groups, ["digest", "old"]).select(F.col("id").alias(id_col), "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
