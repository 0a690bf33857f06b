"""Token counts of documents in flat token files, by a scan for the end-of-document id.

A token file is a flat run of little-endian ids without an index; it comes as blocks
(file, block, data), cut anywhere. Every block is scanned on its own: one vectorised
comparison finds the separators, their distances are the counts of the documents that lie
within. Documents that cross blocks are stitched by a prefix scan over the blocks' summaries:
a running count of separators numbers the documents, a running maximum of the last
separator's place gives the tokens that each block takes over from those before it.

`write_token_files` writes such files from texts, one a task, by Python's own file calls, so
its folder has to be mounted on all executors; `write_tokens` makes blocks in a table
instead. `read_token_files` cuts files into ranges of bytes, which tasks read on their own;
files of stores that can't be mounted come whole from Spark's reader (2 GB at most).

Edge cases: an empty document (null or empty text) counts 0; tokens after the last separator
are a document that is not closed; empty blocks and an empty file do no harm (an empty file
has no documents); a block whose bytes aren't whole ids is an error; repeated rows are
documents of their own; other columns of the input are ignored.
"""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import codec, read_ranks
from .shared import materialize, size_of, sliced

#: Ids of a block that is written.
BLOCK_IDS = 1 << 18


def write_tokens(docs: DataFrame, ranks_path: str, pattern: str, eod: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, block, data, ids): blocks of token files, and in `ids` the documents closed in each, in order."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = source.schema["id"].dataType
    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))])

    def run(batches):
        own, file = codec(*shared.value), TaskContext.get().partitionId()
        end = np.array([eod], f"<u{width}").tobytes()
        parts, size, block, ids, kind = [], 0, 0, [], None
        limit = BLOCK_IDS * width

        def cut(data, done):
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([data], pa.binary()), pa.array([done], pa.list_(kind))], ["file", "block", "data", "ids"])

        for batch in batches:
            kind = batch["id"].type
            for i, t in zip(batch["id"].to_pylist(), batch["text"]):
                tokens = np.frombuffer(own.encode(t.as_py()), "<u4")
                if len(tokens) and int(tokens.max()) >= 1 << 8 * width:
                    raise ValueError(f"an id does not fit {width} bytes")
                data = tokens.astype(f"<u{width}").tobytes() + end
                while size + len(data) > limit:  # the separator is not in what goes out
                    room = limit - size
                    yield cut(b"".join([*parts, data[:room]]), ids)
                    data, parts, size, ids, block = data[room:], [], 0, [], block + 1
                parts.append(data)
                size += len(data)
                ids.append(i)
        if size:
            yield cut(b"".join(parts), ids)

    return source.mapInArrow(run, schema)


def local_path(path: str) -> str | None:
    """The path of a file that Python can open, if it is one."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_token_files(docs: DataFrame, folder: str, ranks_path: str, pattern: str, eod: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, first, ids): flat files written to `folder` when the rows are made, and their documents in order, from the
    `first` on. A task's retry writes another file; only those of the rows returned count."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("first", T.LongType()), T.StructField("ids", T.ArrayType(source.schema["id"].dataType))])
    end = np.array([eod], f"<u{width}").tobytes()

    def run(batches):
        own, task = codec(*shared.value), TaskContext.get()
        path, first, out = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}.bin", 0, None
        for batch in sliced(batches, "text"):
            if out is None:
                os.makedirs(folder, exist_ok=True)
                out = open(path, "wb")  # noqa: SIM115
            for t in batch["text"]:
                tokens = np.frombuffer(own.encode(t.as_py()), "<u4")
                if len(tokens) and int(tokens.max()) >= 1 << 8 * width:
                    raise ValueError(f"an id does not fit {width} bytes")
                out.write(tokens.astype(f"<u{width}").tobytes() + end)
            out.flush()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first]), pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch["id"])], ["file", "first", "ids"])
            first += len(batch)
        if out is not None:
            os.fsync(out.fileno())
            out.close()

    return source.mapInArrow(run, schema)


def read_token_files(spark: SparkSession, path: str | list[str], width: int = 2, only: DataFrame | None = None) -> DataFrame:
    """(file, block, data) of flat files of ids; of those that only(name) names, if it is given."""
    size = BLOCK_IDS * width
    files = spark.read.format("binaryFile").load(path)
    if only is not None:  # before anything is read
        files = files.join(only.select("name").distinct(), F.element_at(F.split("path", "/"), -1) == F.col("name"), "left_semi")
    paths = [path] if isinstance(path, str) else path
    if all(local_path(p) is not None for p in paths):

        def ranges(batches):
            for batch in batches:
                for file, block in zip(batch["file"].to_pylist(), batch["block"].to_pylist()):
                    with open(local_path(file), "rb") as f:
                        f.seek(block * size)
                        data = f.read(size)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([data], pa.binary())], ["file", "block", "data"])

        # only names and lengths are listed; a large file's ranges go to many tasks
        each = files.where("length > 0").select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
        return each.repartition("file", "block").mapInArrow(ranges, "file string, block long, data binary")

    def pieces(batches):
        for batch in batches:
            for file, data in zip(batch["path"].to_pylist(), batch["content"]):
                data = data.as_buffer()
                for k, lo in enumerate(range(0, data.size, size)):
                    piece = data.slice(lo, min(size, data.size - lo)).to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), pa.array([piece], pa.binary())], ["file", "block", "data"])

    return files.select("path", "content").mapInArrow(pieces, "file string, block long, data binary")


def token_counts(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """(file, doc, first_token, n_tokens, closed): each document's place in its file, counted from 0, and its tokens without the separator.

    The prefix scan is over the blocks' summaries (four numbers each); the separators' places are stored and joined to its result.
    """
    source = blocks.select("file", "block", "data")

    def run(batches):
        for batch in batches:
            n, ends = [], []
            for data in batch["data"]:
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", f"<u{width}")
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == eod))
            yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    found = source.mapInArrow(run, T.StructType([source.schema["file"], source.schema["block"], T.StructField("n", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]))
    found = materialize(found, "separators", size_of(source))
    by_block = W.partitionBy("file").orderBy("block")
    before = by_block.rowsBetween(W.unboundedPreceding, -1)
    each = found.select("file", "block", "n", F.size("ends").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("e"))
    each = each.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("last", F.col("start") + F.col("e") + 1)
    # `open`: where what a block begins with was begun; the file's last block also ends what no separator closes
    placed = each.select("file", "block", "start", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("docs"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("open"), F.lead("block").over(by_block).isNull().alias("final"), F.coalesce("last", F.max("last").over(before), F.lit(0)).alias("tail"))
    placed = placed.join(found, ["file", "block"])
    end = F.col("start") + F.col("n")
    marks = F.transform("ends", lambda e: F.struct((F.col("start") + e).alias("at"), F.lit(True).alias("closed")))
    marks = F.when(F.col("final") & (end > F.col("tail")), F.concat(marks, F.array(F.struct(end.alias("at"), F.lit(False).alias("closed"))))).otherwise(marks)
    out = placed.withColumn("marks", marks).select("file", "docs", "open", "marks", F.posexplode("marks").alias("k", "mark"))
    first = F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("marks", F.col("k") - 1)["at"] + 1)
    return out.select("file", (F.col("docs") + F.col("k")).cast("long").alias("doc"), first.alias("first_token"), (F.col("mark.at") - first).alias("n_tokens"), F.col("mark.closed").alias("closed"))
