"""Line dedup by overlapping three-line windows.

Each three consecutive lines of a document are one window, named by a 128-bit hash of their
bytes. Of a window that occurs more than once anywhere, the occurrence first by (id, line)
stays; every later one marks the lines it covers, and the union of what a document's
windows cover is removed. A later occurrence that overlaps the first in the same document
removes only the lines beyond it.

Windows are counted map-side by hash (fixed-size keys, never texts), and only those that repeat
are joined back, by two written tables, so that a window in a third of all documents is
split by Spark. Removed lines are gathered by document, which has at most its own lines of
them. Documents that lose nothing (as a bounded bitmap of ids tells) pass without a shuffle;
the others are joined to their removed lines and cut once.

Edge cases: a null text counts as empty and stays null; a text has one line more than
newlines; texts of fewer than three lines have no windows and stay as they are; rows that
repeat an id and a text are one document (all of them lose the same lines), different texts
under one id are documents of their own, in the order of a hash; rows without an id are left
alone and count for nothing; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Marks, id_hash, let_go, materialize, parted, size_of, sliced

LINES = 3


def _name(text: bytes) -> int:
    """A text's own name, beside its id."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _windows(rows: DataFrame, lines: int) -> DataFrame:
    def run(batches):
        let_go()
        for batch in sliced(batches, "text"):
            ids, name, at, key = [], [], [], []
            for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                if i is None or t is None:
                    continue
                data = t.encode("utf-8")
                own = [xxhash.xxh3_128_digest(x) for x in data.split(b"\n")]
                n = max(0, len(own) - lines + 1)
                ids += [i] * n
                name += [_name(data)] * n
                at += range(n)
                key += [xxhash.xxh3_128_digest(b"".join(own[k : k + lines])) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch["id"].type), pa.array(name, pa.int64()), pa.array(at, pa.int32()), pa.array(key, pa.binary())], ["id", "name", "at", "key"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("name", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("key", T.BinaryType())]))


def _named(rows: DataFrame, marks: Marks) -> DataFrame:
    """The marked rows with their texts' names."""

    def run(batches):
        let_go()
        for batch in batches:
            got = batch.filter(pa.array(marks.hits(batch["h"].to_numpy()))).drop_columns(["h"])
            for part in sliced([got] if len(got) else [], "text"):
                yield part.append_column("name", pa.array([_name((t or "").encode("utf-8")) for t in part["text"].to_pylist()], pa.int64()))

    return rows.withColumn("h", id_hash("id")).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("name", T.LongType())]))


def _cut(rows: DataFrame) -> DataFrame:
    """(id, text, removed): the text loses its removed lines."""

    def run(batches):
        let_go()
        for batch in sliced(batches, "text"):
            out = []
            for t, gone in zip(batch["text"].to_pylist(), batch["removed"].to_pylist()):
                if gone:
                    left = t.split("\n")
                    for k in reversed(gone):
                        left[k] = None
                    t = "\n".join(x for x in left if x is not None)
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, pa.string()), batch["n_lines"], batch["removed"]], ["id", "text", "n_lines", "removed"])

    return rows.mapInArrow(run, rows.schema)


def line_dedup(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, removed): the text without the removed lines, and their numbers from 0 in order."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    windows = materialize(_windows(rows, lines), "windows")
    room = size_of(windows)
    place = F.struct("id", "name", "at")
    counted = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = materialize(counted.where("first <> last").select("key", "first"), "repeated", room)
    later = windows.join(repeated, "key").where(place != F.col("first"))
    own = (F.col("first.id") == F.col("id")) & (F.col("first.name") == F.col("name"))
    begin = F.when(own, F.greatest("at", F.col("first.at") + lines)).otherwise(F.col("at"))
    spans = later.select("id", "name", begin.alias("a"), (F.col("at") + lines).alias("b")).where("a < b")
    removed = spans.select("id", "name", F.explode(F.sequence("a", F.col("b") - 1)).alias("line")).distinct()
    removed = materialize(removed.groupBy("id", "name").agg(F.array_sort(F.collect_list("line")).alias("removed")), "removed", room)

    marks = Marks(removed.select(id_hash("id").alias("h")))
    # newlines are counted, the lines not made
    n_lines = (F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long")
    none = F.array().cast("array<int>")
    passed = parted(rows, marks, "id", False).select("id", "text", n_lines.alias("n_lines"), none.alias("removed"))
    joined = _named(rows, marks).join(removed, ["id", "name"], "left").select("id", "text", n_lines.alias("n_lines"), F.coalesce("removed", none).alias("removed"))
    return passed.unionByName(_cut(joined)).select(F.col("id").alias(id_col), "text", "n_lines", "removed")
